import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from komagrid.operators import layout as ly
from komagrid.operators import raster


def test_balanced_lines_are_the_best_split():
    r = random.Random(4)
    width = lambda w: float(len(w))
    for _ in range(200):
        words = ["x" * r.randint(1, 6) for _ in range(r.randint(1, 7))]
        slots = [r.randint(4, 14) for _ in range(r.randint(1, 3))]
        best = None
        for cuts in itertools.combinations(range(1, len(words)), len(slots) - 1):
            lines = [" ".join(words[a:b]) for a, b in itertools.pairwise((0, *cuts, len(words)))]
            if all(len(line) <= s for line, s in zip(lines, slots, strict=True)):
                cost = sum(((s - len(line)) / s) ** 2 for line, s in zip(lines, slots, strict=True))
                best = cost if best is None else min(best, cost)
        got = ly.balanced_lines(words, slots, width)
        if best is None:
            assert got is None
        else:
            assert abs(sum(((s - len(line)) / s) ** 2 for line, s in zip(got, slots, strict=True)) - best) < 1e-9
            assert " ".join(got) == " ".join(words)


def test_fit_in_an_oval():
    y, x = np.mgrid[:160, :200]
    mask = ((x - 100) / 100) ** 2 + ((y - 80) / 80) ** 2 <= 1
    size, lines = ly.fit("THIS IS A SENTENCE THAT HAS TO FIT".split(), mask, 40, 8)
    assert size > 8 and len({cx for _, cx, _ in lines}) == 1
    assert " ".join(t for t, _, _ in lines) == "THIS IS A SENTENCE THAT HAS TO FIT"
    assert ly.fit(["A" * 500], mask, 40, 8) is None


def test_row_spans():
    mask = np.array([[1, 1, 0, 1, 1, 1, 0], [0, 0, 0, 0, 0, 0, 0], [1, 1, 1, 1, 1, 1, 1]], bool)
    left, right = ly.row_spans(mask, 4)
    assert left.tolist() == [3, 4, 0] and right.tolist() == [6, 4, 7]


def test_wrap_and_letter(spark):
    df = spark.createDataFrame([(1, "one two three"), (2, ""), (3, None), (4, "w" * 99)], "k int, t string")
    got = {r.k: (r.n_lines, r.lines) for r in ly.wrap(df, "k", "t", 4, 60.0).collect()}
    assert got == {1: (2, ["ONE TWO", "THREE"]), 2: (None, None), 3: (None, None), 4: (None, None)}
    box = "struct<x0:int,y0:int,x1:int,y1:int>"
    regions = spark.createDataFrame([("a", "hello there", (10, 10, 110, 60), 20, 8, None), ("b", "", (0, 0, 9, 9), 20, 8, None)], f"region_id string, translation string, area {box}, most int, least int, mask binary")
    got = {r.region_id: (r["size"], [x.text for x in r.lines or []]) for r in ly.letter(regions).collect()}
    assert got["a"][0] >= 8 and " ".join(got["a"][1]) == "HELLO THERE" and got["b"] == (None, [])


def test_fonts(spark):
    df = spark.createDataFrame([("abc",), ("ab é",), ("漢",)], "t string")
    fonts = [("plain", frozenset(range(97, 123))), ("wide", frozenset([*range(97, 123), 0xE9]))]
    assert [r[0] for r in df.select(ly.best_font(F.col("t"), fonts)).collect()] == ["plain", "wide", "plain"]


def flood(mask, least):
    seen, out = np.zeros_like(mask), []
    for y, x in zip(*np.nonzero(mask), strict=True):
        if not seen[y, x]:
            stack, cells = [(y, x)], []
            seen[y, x] = True
            while stack:
                cy, cx = stack.pop()
                cells.append((cy, cx))
                for ny in range(max(0, cy - 1), min(mask.shape[0], cy + 2)):
                    for nx in range(max(0, cx - 1), min(mask.shape[1], cx + 2)):
                        if mask[ny, nx] and not seen[ny, nx]:
                            seen[ny, nx] = True
                            stack.append((ny, nx))
            ys, xs = zip(*cells, strict=True)
            if len(cells) >= least:
                out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(cells)))
    return out


def test_components_against_flood_fill():
    r = np.random.default_rng(1)
    for _ in range(20):
        mask = r.random((23, 31)) < 0.4
        assert sorted(raster.components(mask, 3)) == sorted(flood(mask, 3))


def test_kernels():
    kernels = raster.Kernels({"decode": lambda: lambda data: {"size": len(data)}})
    with pytest.raises(raster.KernelUnavailable, match="cv2"):
        kernels.get("inpaint")
    assert kernels.first_of("detect", "decode")(b"ab") == {"size": 2}


def test_pixel_rules(spark):
    votes = spark.createDataFrame([("r", 0), ("r", 0), ("r", 0), ("r", 2), ("r", 2), ("r", 1), ("r", 1)], "k string, label int")
    assert tuple(raster.label_vote(votes, "k").first()) == ("r", 1, 2)
    pixels = spark.createDataFrame([("r", 10, 1, 2, 3), ("r", 20, 3, 4, 5)], "k string, level int, r int, g int, b int")
    assert tuple(raster.pixel_statistics(pixels, "k").first()) == ("r", 15.0, 2.0, 3.0, 4.0, 5.0)
    row = spark.range(1).select(raster.is_flat(F.lit(19.9), F.lit(151), F.lit(200), F.lit(255)), raster.decodable(F.lit(bytes.fromhex("89504E470D0A1A0A00"))), raster.decodable(F.lit(None).cast("binary"))).first()
    assert tuple(row) == (True, True, False)
