"""The boundary to image and model work: what a plug-in has to offer, and the statistics that need no image library.

Detectors, OCR engines, inpainting and drawing need libraries that an installation may lack. They come as kernels; a
missing kernel is a clear error, never an invented result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from importlib.util import find_spec
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each kernel with the packages that its usual implementations need.
KERNELS = {
    "decode": ("cv2",), "encode": ("cv2",), "detect": ("torch", "transformers"), "threshold_boxes": ("cv2",), "crop": ("cv2",), "prepare_ocr": ("cv2",),
    "ocr": ("pytesseract",), "ocr_vertical": ("manga_ocr",), "segment": ("cv2",), "stroke_mask": ("cv2",), "inpaint": ("cv2",), "erase": ("cv2",), "glyphs": ("PIL",), "draw": ("PIL",),
}


class KernelUnavailable(RuntimeError):
    """A kernel has no implementation in this installation."""


class Kernels:
    """Implementations by name; made lazily, once per worker."""

    def __init__(self, made: dict[str, Callable[[], Callable[..., Any]]] | None = None) -> None:
        self.made, self.ready = dict(made or {}), {}

    def register(self, name: str, make: Callable[[], Callable[..., Any]]) -> None:
        if name not in KERNELS:
            raise ValueError(f"no such kernel: {name}")
        self.made[name] = make

    def get(self, name: str) -> Callable[..., Any]:
        if name not in self.ready:
            if name not in self.made:
                missing = [p for p in KERNELS.get(name, ()) if find_spec(p) is None]
                raise KernelUnavailable(f"kernel {name} is not registered" + (f"; its usual packages are missing: {', '.join(missing)}" if missing else ""))
            self.ready[name] = self.made[name]()
        return self.ready[name]

    def first_of(self, *names: str) -> Callable[..., Any]:
        """The first of the kernels that works: any error of one gives way to the next."""

        def run(*args: Any) -> Any:
            error: Exception | None = None
            for name in names:
                try:
                    return self.get(name)(*args)
                except Exception as e:
                    error = e
            raise error or KernelUnavailable("no kernel given")

        return run


def apply_kernel(images: DataFrame, kernels: Kernels, name: str, schema: str, key: str = "path", content: str = "content") -> DataFrame:
    """A kernel over binary images: ``key``, the kernel's columns, and the error of an image that it failed on."""
    kernels.get(name)  # a missing kernel is known before a job starts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kernel = kernels.get(name)
        for rows in batches:
            out = []
            for k, data in zip(rows["key"], rows["content"], strict=True):
                try:
                    out.append({"key": k, "error": None} | kernel(bytes(data)))
                except Exception as e:
                    out.append({"key": k, "error": f"{type(e).__name__}: {e}"})
            names = ["key", *[c.strip().split(" ")[0] for c in schema.split(",")], "error"]
            yield pd.DataFrame(out, columns=names)

    return images.select(F.col(key).alias("key"), F.col(content).alias("content")).mapInPandas(run, f"key string, {schema}, error string").withColumnRenamed("key", key)


def decodable(content: Column) -> Column:
    """Whether bytes begin like one of the known image formats; null content is not."""
    head = F.hex(F.substring(content, 1, 12))
    webp = head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")
    return F.coalesce(head.startswith("89504E470D0A1A0A") | head.startswith("FFD8FF") | head.startswith("424D") | webp, F.lit(False))


def components(mask: np.ndarray, least_area: int = 20) -> list[tuple[int, int, int, int, int]]:
    """(x, y, width, height, area) of the 8-connected components of a mask, in the order of their first pixel.

    Runs of each row are joined with those that they touch in the row above: no per-pixel work.
    """
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    stats: list[list[int]] = []
    above: list[tuple[int, int, int]] = []
    for y, row in enumerate(np.asarray(mask, bool)):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], row.view(np.int8), [0]])))
        here = []
        for x0, x1 in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            label = len(parent)
            parent.append(label)
            stats.append([x0, y, x1, y + 1, x1 - x0])
            for a0, a1, other in above:
                if a0 <= x1 and a1 >= x0:
                    a, b = sorted((root(label), root(other)))
                    parent[b] = a
            here.append((x0, x1, label))
        above = here
    joined: dict[int, list[int]] = {}
    for i, (x0, y0, x1, y1, area) in enumerate(stats):
        s = joined.setdefault(root(i), [x0, y0, x1, y1, 0])
        s[0], s[1], s[2], s[3], s[4] = min(s[0], x0), min(s[1], y0), max(s[2], x1), max(s[3], y1), s[4] + area
    return [(x0, y0, x1 - x0, y1 - y0, area) for x0, y0, x1, y1, area in joined.values() if area >= least_area]


def interior_accepted(votes: Column, text_area: Column, mask_area: Column, box_area: Column, contact: Column, perimeter: Column) -> Column:
    """Whether a segmented bubble interior holds: text votes, its share of the box, and how much it touches the border."""
    share = lambda a, b: F.coalesce(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))
    return (share(votes, text_area) >= 0.4) & (share(mask_area, box_area) >= 0.2) & (share(contact, perimeter) <= 0.2)


def is_flat(deviation: Column, red: Column, green: Column, blue: Column) -> Column:
    """Whether an interior is one light colour."""
    return (deviation < 20) & (F.least(red, green, blue) > 150)


def pixel_statistics(pixels: DataFrame, key: str) -> DataFrame:
    """(key, paper, red, green, blue, deviation) from pixels (key, level, r, g, b): medians and population deviation."""
    median = lambda c: F.percentile(c, 0.5)
    return pixels.groupBy(key).agg(median("level").alias("paper"), median("r").alias("red"), median("g").alias("green"), median("b").alias("blue"), F.stddev_pop("level").alias("deviation"))


def label_vote(labels: DataFrame, key: str) -> DataFrame:
    """(key, label, votes): the label most pixels have, background apart; the smaller of equals."""
    counts = labels.where("label <> 0").groupBy(key, "label").agg(F.count("*").alias("votes"))
    return counts.groupBy(key).agg(F.max_by("label", F.struct("votes", -F.col("label"))).alias("label"), F.max("votes").alias("votes"))


def edge_strokes(strokes: DataFrame, width: Column, height: Column) -> DataFrame:
    """Strokes (x, y, w, h) of a crop without long ones that touch its edge."""
    touches = (F.col("x") <= 0) | (F.col("y") <= 0) | (F.col("x") + F.col("w") >= width) | (F.col("y") + F.col("h") >= height)
    return strokes.where(~(touches & ((F.col("w") > 0.6 * width) | (F.col("h") > 0.6 * height))))


def or_masks(masks: DataFrame, key: str) -> DataFrame:
    """(key, mask): packed masks (as rows of 64-bit words: key, word, bits) of a region put together."""
    return masks.groupBy(key, "word").agg(F.bit_or("bits").alias("bits"))
