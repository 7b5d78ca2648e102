"""From detections to ordered text regions, one page at a time and many pages at once.

A page's boxes are tens, so a page is one row with arrays and the order-dependent steps are folds inside the JVM; pages
need one shuffle by page and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from komagrid.functions import geometry as g

BUBBLE = 0


def likely(detections: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Detections whose score is above the threshold and whose box is not empty."""
    return detections.where((F.col("score") > F.lit(threshold)) & F.col("box").isNotNull())


def suppress_array(items: Column, same: bool, most: float) -> Column:
    """The items (structs with ``box``, and ``label`` if ``same``) that overlap none kept before them."""

    def keep(kept: Column, item: Column) -> Column:
        def hides(k: Column) -> Column:
            over = g.overlap(item["box"], k["box"]) > F.lit(most)
            return (k["label"] == item["label"]) & over if same else over

        return F.when(F.exists(kept, hides), kept).otherwise(F.concat(kept, F.array(item)))

    return F.aggregate(items, F.filter(items, lambda x: F.lit(False)), keep)


def suppress(detections: DataFrame, page: str = "page_id", most: float = 0.7) -> DataFrame:
    """Detections without those hidden by a better one of their label: best first, ties in the order they came."""
    order = F.struct((-F.col("score")).alias("s"), F.col("det_ord").alias("o"), "label", "score", "box", "det_ord")
    pages = detections.groupBy(page).agg(F.array_sort(F.collect_list(order)).alias("all"))
    kept = pages.select(page, F.explode(suppress_array(F.col("all"), True, most)).alias("d"))
    return kept.select(page, F.col("d.det_ord").alias("det_ord"), F.col("d.label").alias("label"), F.col("d.score").alias("score"), F.col("d.box").alias("box"))


def prune(boxes: DataFrame, page: str = "page_id", most: float = 0.75) -> DataFrame:
    """Candidate boxes (with the page's width and height) from the top down without those hidden by an earlier one."""
    fit = boxes.where(g.is_candidate(F.col("box"), F.col("width"), F.col("height")))
    order = F.struct(F.col("box.y0").alias("y"), F.col("box.x0").alias("x"), F.col("box_ord").alias("o"), "box", "box_ord")
    pages = fit.groupBy(page).agg(F.array_sort(F.collect_list(order)).alias("all"))
    return pages.select(page, F.explode(suppress_array(F.col("all"), False, most)).alias("b")).select(page, F.col("b.box_ord").alias("box_ord"), F.col("b.box").alias("box"))


def box_order(boxes: Column) -> Column:
    """Text boxes of one bubble in reading order: columns from the right, else lines from the top; ties as they came.

    ``boxes``: array of structs with ``box`` and ``o``.
    """
    columns = F.forall(boxes, lambda b: (b["box"]["y1"] - b["box"]["y0"]) >= (b["box"]["x1"] - b["box"]["x0"]))
    key = lambda v, b: F.struct(v.alias("k"), b["o"].alias("o"), b["box"].alias("box"))
    right = F.array_sort(F.transform(boxes, lambda b: key(-b["box"]["x1"], b)))
    top = F.array_sort(F.transform(boxes, lambda b: key(b["box"]["y0"], b)))
    return F.transform(F.when(columns, right).otherwise(top), lambda x: x["box"])


def assign_bubbles(detections: DataFrame, page: str = "page_id") -> DataFrame:
    """Each text box with its bubble: the one that covers most of it, if that is more than half; the first of equals.

    (page, det_ord, box, bubble_ord, bubble). An equi-join on the page with an overlap condition.
    """
    text = detections.where(F.col("label") != BUBBLE).select(page, "det_ord", "box")
    bubbles = detections.where(F.col("label") == BUBBLE).select(page, F.col("det_ord").alias("bubble_ord"), F.col("box").alias("bubble"))
    shared = g.intersection(F.col("box"), F.col("bubble"))
    pairs = text.join(bubbles, page).withColumn("shared", shared).where("shared > 0")
    best = pairs.groupBy(page, "det_ord").agg(F.max_by(F.struct("bubble_ord", "bubble", "shared"), F.struct("shared", -F.col("bubble_ord"))).alias("b"))
    joined = text.join(best, [page, "det_ord"], "left")
    inside = F.col("b.shared") > 0.5 * g.area(F.col("box"))
    return joined.select(page, "det_ord", "box", F.when(inside, F.col("b.bubble_ord")).alias("bubble_ord"), F.when(inside, F.col("b.bubble")).alias("bubble"))


def group_regions(detections: DataFrame, page: str = "page_id") -> DataFrame:
    """Regions of each page from the top, the rightmost first in a row: page, region_ord, boxes, text_box, bubble."""
    assigned = assign_bubbles(detections, page)
    # a free box is a region of its own, regions of bubbles come before it
    key = F.when(F.col("bubble_ord").isNotNull(), F.struct(F.lit(0).alias("free"), F.col("bubble_ord").alias("n"))).otherwise(F.struct(F.lit(1).alias("free"), F.col("det_ord").alias("n")))
    grouped = assigned.groupBy(page, key.alias("key")).agg(
        F.collect_list(F.struct("box", F.col("det_ord").alias("o"))).alias("items"), F.first("bubble").alias("bubble"), F.min("det_ord").alias("first")
    )
    ordered = grouped.withColumn("boxes", box_order(F.array_sort(F.col("items"), lambda a, b: a["o"] - b["o"])))
    ordered = ordered.withColumn("text_box", g.union_of(F.col("boxes")))
    place = F.struct(F.col("text_box.y0").alias("y"), (-F.col("text_box.x1")).alias("x"), F.col("key.free").alias("f"), F.col("first").alias("o"), "boxes", "text_box", "bubble")
    pages = ordered.groupBy(page).agg(F.array_sort(F.collect_list(place)).alias("all"))
    return pages.select(page, F.posexplode("all").alias("region_ord", "r")).select(page, "region_ord", F.col("r.boxes").alias("boxes"), F.col("r.text_box").alias("text_box"), F.col("r.bubble").alias("bubble"))


def reading_order_array(items: Column, right_to_left: Column) -> Column:
    """Items (structs ``box``, ``ord``) in reading order: rows of boxes that overlap vertically, from the top down.

    A region joins the first row that it overlaps by more than half of the lower of the two heights, and widens it.
    """
    by_top = F.array_sort(F.transform(items, lambda i: F.struct(i["box"]["y0"].alias("top"), i["ord"].alias("ord"), i["box"].alias("box"))))
    row_type = "array<struct<y0:int,y1:int,members:array<struct<top:int,ord:int,box:struct<x0:int,y0:int,x1:int,y1:int>>>>>"

    def place(rows: Column, item: Column) -> Column:
        y0, y1 = item["box"]["y0"], item["box"]["y1"]
        fits = F.transform(rows, lambda r: (F.least(y1, r["y1"]) - F.greatest(y0, r["y0"])) > 0.5 * F.least(y1 - y0, r["y1"] - r["y0"]))
        at = F.coalesce(F.array_position(fits, F.lit(True)), F.lit(0))
        wider = F.transform(
            rows,
            lambda r, i: F.when(i + 1 == at, F.struct(F.least(r["y0"], y0).alias("y0"), F.greatest(r["y1"], y1).alias("y1"), F.concat(r["members"], F.array(item)).alias("members"))).otherwise(r),
        )
        return F.when(at > 0, wider).otherwise(F.concat(rows, F.array(F.struct(y0.alias("y0"), y1.alias("y1"), F.array(item).alias("members")))))

    rows = F.aggregate(by_top, F.array().cast(row_type), lambda rows, item: place(rows, item).cast(row_type))

    def row(r: Column) -> Column:
        keyed = F.transform(r["members"], lambda m, i: F.struct(F.when(right_to_left, -m["box"]["x1"]).otherwise(m["box"]["x0"]).alias("k"), i.alias("i"), m["ord"].alias("ord")))
        return F.transform(F.array_sort(keyed), lambda m: m["ord"])

    return F.flatten(F.transform(rows, row))


def reading_order(regions: DataFrame, right_to_left: Column, page: str = "page_id", order: str = "region_ord", box: str = "text_box") -> DataFrame:
    """(page, ``order``, place): the place of each region in the order in which its page is read."""
    pages = regions.withColumn("_rtl", right_to_left).groupBy(page).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).cast("int").alias("ord"), F.col(box).cast(g.BOX).alias("box")))).alias("items"), F.bool_or("_rtl").alias("_rtl")
    )
    return pages.select(page, F.posexplode(reading_order_array(F.col("items"), F.col("_rtl"))).alias("place", order))


def union_masks(*sources: DataFrame) -> DataFrame:
    """All boxes of several detectors, repeated ones included."""
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other)
    return out
