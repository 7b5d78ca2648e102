"""Box geometry as Column expressions over ``struct<x0,y0,x1,y1>`` boxes (half-open pixels).

Guards are explicit: sides never negative, no division by zero under ANSI, a null box gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x0:int,y0:int,x1:int,y1:int>"


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("int").alias("x0"), y0.cast("int").alias("y0"), x1.cast("int").alias("x1"), y1.cast("int").alias("y1"))


def _side(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), b - a)


def area(b: Column) -> Column:
    """Area; a negative side counts as 0."""
    return F.when(b.isNotNull(), (_side(b["x0"], b["x1"]) * _side(b["y0"], b["y1"])).cast("bigint"))


def intersection(a: Column, b: Column) -> Column:
    """Area that two boxes share."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when(a.isNotNull() & b.isNotNull(), (F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)).cast("bigint"))


def overlap(a: Column, b: Column) -> Column:
    """Shared area over the smaller area; 0 if that is 0. The division stays: a product differs at exact bounds."""
    smaller = F.least(area(a), area(b))
    return F.when(smaller <= 0, F.lit(0.0)).otherwise(intersection(a, b).cast("double") / smaller)


def union_of(boxes: Column) -> Column:
    """The bounding box of an array of boxes; null for none."""
    low = lambda side: F.array_min(F.transform(boxes, lambda b: b[side]))
    high = lambda side: F.array_max(F.transform(boxes, lambda b: b[side]))
    return F.when(F.size(boxes) > 0, box(low("x0"), low("y0"), high("x1"), high("y1")))


def union_agg(b: Column) -> Column:
    """The bounding box of a group."""
    return box(F.min(b["x0"]), F.min(b["y0"]), F.max(b["x1"]), F.max(b["y1"]))


def clip(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Sides rounded half to even and cut to the image; null if nothing is left."""
    inside = lambda v, most: F.greatest(F.lit(0), F.least(most, F.rint(v).cast("int")))
    cut = box(inside(x0, width), inside(y0, height), inside(x1, width), inside(y1, height))
    return F.when((cut["x1"] > cut["x0"]) & (cut["y1"] > cut["y0"]), cut)


def pad(b: Column, by: Column, width: Column, height: Column) -> Column:
    """The box widened on all sides and cut to the image; the box itself if nothing is left."""
    return F.coalesce(clip(b["x0"] - by, b["y0"] - by, b["x1"] + by, b["y1"] + by, width, height), b)


def from_center(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A box in fractions of the image around its centre, as pixels."""
    return clip((cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height, width, height)


def upscale(width: Column, height: Column, least: int = 512) -> Column:
    """The whole factor that brings a small page's longer side to ``least``."""
    longest = F.greatest(width, height)
    return F.when(longest < least, F.greatest(F.lit(1), F.ceil(F.lit(float(least)) / longest).cast("int"))).otherwise(1)


def glyph_size(text_area: Column, text: Column) -> Column:
    """About the size of one character: the text's area shared by its characters."""
    return F.sqrt(text_area / F.greatest(F.lit(1), F.length(text)))


def boxes_area(boxes: Column) -> Column:
    """The sum of the boxes' areas, negative sides and all."""
    sides = F.transform(boxes, lambda b: ((b["x1"] - b["x0"]) * (b["y1"] - b["y0"])).cast("bigint"))
    return F.aggregate(sides, F.lit(0).cast("bigint"), lambda x, y: x + y)


def lettering_area(interior: Column, bubble: Column, text: Column, width: Column, height: Column) -> Column:
    """Where a translation may go: the bubble's interior, else the bubble less 15 %, else the text's box made wider."""
    dx, dy = (bubble["x1"] - bubble["x0"]) * 0.15, (bubble["y1"] - bubble["y0"]) * 0.15
    inset = box(F.rint(bubble["x0"] + dx), F.rint(bubble["y0"] + dy), F.rint(bubble["x1"] - dx), F.rint(bubble["y1"] - dy))
    wish = F.rint((text["y1"] - text["y0"]) * 0.6 - (text["x1"] - text["x0"])).cast("int")
    extra = F.greatest(F.lit(0), F.floor(wish / 2).cast("int"))
    wide = box(text["x0"] - extra, text["y0"], text["x1"] + extra, text["y1"])
    return F.coalesce(interior, F.when(bubble.isNotNull(), inset), pad(wide, F.lit(0), width, height))


def font_bounds(longest: Column, glyph: Column, square: Column) -> Column:
    """Smallest and largest lettering size of a region on a page."""
    least = F.greatest(F.lit(8), F.rint(longest * 0.012).cast("int"))
    page = F.greatest(least, F.rint(longest * 0.04).cast("int"))
    wish = F.rint(glyph * F.when(square, 0.65).otherwise(1.1)).cast("int")
    return F.struct(least.alias("least"), F.least(page, F.greatest(least, wish)).alias("most"))


def component_padding(b: Column) -> Column:
    """How far a text component's box is widened."""
    shorter = F.least(b["x1"] - b["x0"], b["y1"] - b["y0"])
    return F.greatest(F.lit(4), F.floor(shorter * 0.25).cast("int"))


def stroke_width(size: Column, bubble: Column) -> Column:
    """The outline of lettering outside bubbles; 0 inside."""
    return F.when(bubble.isNull(), F.greatest(F.lit(1), F.floor(size / 8).cast("int"))).otherwise(0)


def is_candidate(b: Column, width: Column, height: Column) -> Column:
    """Whether a component's box may be text: not too thin, small, large or long."""
    w, h = b["x1"] - b["x0"], b["y1"] - b["y0"]
    page = width.cast("bigint") * height
    least, most = F.greatest(F.lit(25), F.floor(page * 0.00035)), F.greatest(F.lit(100), F.floor(page * 0.45))
    long = F.greatest(w, h).cast("double") / F.greatest(F.lit(1), F.least(w, h))
    return (w >= 6) & (h >= 6) & (w.cast("bigint") * h >= least) & (w.cast("bigint") * h <= most) & (long <= 12)


def vertical(b: Column) -> Column:
    """Whether a text box holds a vertical line."""
    return (b["y1"] - b["y0"]) > 1.5 * (b["x1"] - b["x0"])
