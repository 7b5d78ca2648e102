"""Queries over the boxes of pages: geometry, suppression, grouping and reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from komagrid.functions import geometry as g
from komagrid.operators import regions as rg
from komagrid.plans.texts import REGIONS_SQL, regions

WIDTH, HEIGHT = 1200, 1700
DETECTIONS_SQL = f"""
    (SELECT page_id, region_ord * 2 AS det_ord, 0 AS label, (region_id * 37 % 100) / 100.0::DOUBLE AS score, bubble_box AS box FROM {REGIONS_SQL} WHERE bubble_box IS NOT NULL
     UNION ALL SELECT page_id, region_ord * 2 + 1, 1, (region_id * 53 % 100) / 100.0::DOUBLE, text_box FROM {REGIONS_SQL} WHERE text_box IS NOT NULL)"""


def detections(spark: SparkSession, folder: str) -> DataFrame:
    """Bubbles and text boxes of the regions as a detector would give them; the scores are made up from the ids."""
    rows = regions(spark, folder)
    score = lambda n: ((F.col("region_id") * n) % 100 / F.lit(100.0)).alias("score")
    bubbles = rows.where("bubble_box is not null").select("page_id", (F.col("region_ord") * 2).alias("det_ord"), F.lit(0).alias("label"), score(37), F.col("bubble_box").alias("box"))
    texts = rows.where("text_box is not null").select("page_id", (F.col("region_ord") * 2 + 1).alias("det_ord"), F.lit(1).alias("label"), score(53), F.col("text_box").alias("box"))
    return bubbles.unionByName(texts)


def _sides(b: str) -> list:
    return [F.col(f"{b}.{s}").alias(s) for s in ("x0", "y0", "x1", "y1")]


def box_overlap(spark: SparkSession, folder: str) -> DataFrame:
    a, b = F.col("text_box"), F.col("bubble_box")
    return regions(spark, folder).where("text_box is not null and bubble_box is not null").select(
        "region_id", g.area(a).alias("area"), g.intersection(a, b).alias("shared"), F.round(g.overlap(a, b), 6).alias("overlap")
    )


def clip_boxes(spark: SparkSession, folder: str) -> DataFrame:
    w, h = F.lit(WIDTH), F.lit(HEIGHT)
    b = F.col("text_box")
    rows = regions(spark, folder).where("text_box is not null").withColumn("box", g.clip(b["x0"] * 2.5 - 300, b["y0"] * 1.5, b["x1"] * 2.5 - 300, b["y1"] * 1.5, w, h))
    return rows.select("region_id", *_sides("box"), F.col("box").isNull().alias("empty"))


def union_boxes(spark: SparkSession, folder: str) -> DataFrame:
    rows = regions(spark, folder).where("text_box is not null").groupBy("page_id").agg(g.union_agg(F.col("text_box")).alias("box"))
    return rows.select("page_id", *_sides("box"))


def lettering_bounds(spark: SparkSession, folder: str) -> DataFrame:
    rows = regions(spark, folder).where("text_box is not null and text is not null")
    glyph = g.glyph_size(g.area(F.col("text_box")), F.col("text"))
    bounds = rows.select("region_id", "bubble_box", g.font_bounds(F.lit(HEIGHT), glyph, F.col("target_lang") == "ja").alias("b"))
    return bounds.select("region_id", F.col("b.least").alias("least"), F.col("b.most").alias("most"), g.stroke_width(F.col("b.most"), F.col("bubble_box")).alias("stroke"))


def lettering_areas(spark: SparkSession, folder: str) -> DataFrame:
    none = F.lit(None).cast(g.BOX)
    rows = regions(spark, folder).where("text_box is not null")
    return rows.select("region_id", g.lettering_area(none, F.col("bubble_box"), F.col("text_box"), F.lit(WIDTH), F.lit(HEIGHT)).alias("box")).select("region_id", *_sides("box"))


def likely_detections(spark: SparkSession, folder: str) -> DataFrame:
    return rg.likely(detections(spark, folder)).select("page_id", "det_ord", "label", "score")


def suppressed(spark: SparkSession, folder: str) -> DataFrame:
    return rg.suppress(rg.likely(detections(spark, folder))).select("page_id", "det_ord", "label")


def pruned_boxes(spark: SparkSession, folder: str) -> DataFrame:
    boxes = detections(spark, folder).select("page_id", F.col("det_ord").alias("box_ord"), "box", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))
    return rg.prune(boxes).select("page_id", "box_ord")


def assigned_bubbles(spark: SparkSession, folder: str) -> DataFrame:
    return rg.assign_bubbles(detections(spark, folder)).select("page_id", "det_ord", "bubble_ord")


def grouped_regions(spark: SparkSession, folder: str) -> DataFrame:
    return rg.group_regions(detections(spark, folder)).select("page_id", "region_ord", F.size("boxes").alias("n_boxes"), *_sides("text_box"))


def reading_order(spark: SparkSession, folder: str) -> DataFrame:
    rows = regions(spark, folder).where("text_box is not null")
    return rg.reading_order(rows, F.lit(True)).select("page_id", "region_ord", "place")


QUERIES = {
    f.__name__: f
    for f in (box_overlap, clip_boxes, union_boxes, lettering_bounds, lettering_areas, likely_detections, suppressed, pruned_boxes, assigned_bubbles, grouped_regions, reading_order)
}
AREA = "greatest(0, {0}.x1 - {0}.x0)::BIGINT * greatest(0, {0}.y1 - {0}.y0)"
SHARED = "(greatest(0, least({0}.x1, {1}.x1) - greatest({0}.x0, {1}.x0))::BIGINT * greatest(0, least({0}.y1, {1}.y1) - greatest({0}.y0, {1}.y0)))"
SMALLER = f"least({AREA}, {AREA.replace('{0}', '{1}')})"
RATIO = f"(CASE WHEN {SMALLER} <= 0 THEN 0 ELSE {SHARED}::DOUBLE / {SMALLER} END)"


def _fold(order: str, hides: str, most: float) -> str:
    return f"""
        SELECT page_id, unnest(list_transform(list_reduce(list_transform(list({{'o': det_ord, 'l': label, 'b': box}} ORDER BY {order}), lambda d: [d]), lambda kept, d:
            CASE WHEN len(list_filter(kept, lambda k: {hides} {RATIO.format("d[1].b", "k.b")} > {most})) > 0 THEN kept ELSE list_concat(kept, d) END), lambda k: k.o)) AS det_ord"""


JOINS_ROW = "nullif(list_position(list_transform(a, lambda v: (least(c[1].y1, v.y1) - greatest(c[1].y0, v.y0)) > 0.5 * least(c[1].y1 - c[1].y0, v.y1 - v.y0)), true), 0)"
ORACLES = {
    "box_overlap": f"""
        SELECT region_id, {AREA.format("text_box")} AS area, {SHARED.format("text_box", "bubble_box")} AS shared, round({RATIO.format("text_box", "bubble_box")}, 6) AS overlap
        FROM {REGIONS_SQL} WHERE text_box IS NOT NULL AND bubble_box IS NOT NULL""",
    "clip_boxes": f"""
        WITH c AS (SELECT region_id, greatest(0, least({WIDTH}, round_even(text_box.x0 * 2.5 - 300, 0)))::INT AS x0, greatest(0, least({HEIGHT}, round_even(text_box.y0 * 1.5, 0)))::INT AS y0,
                          greatest(0, least({WIDTH}, round_even(text_box.x1 * 2.5 - 300, 0)))::INT AS x1, greatest(0, least({HEIGHT}, round_even(text_box.y1 * 1.5, 0)))::INT AS y1 FROM {REGIONS_SQL} WHERE text_box IS NOT NULL)
        SELECT region_id, CASE WHEN x1 > x0 AND y1 > y0 THEN x0 END AS x0, CASE WHEN x1 > x0 AND y1 > y0 THEN y0 END AS y0, CASE WHEN x1 > x0 AND y1 > y0 THEN x1 END AS x1,
               CASE WHEN x1 > x0 AND y1 > y0 THEN y1 END AS y1, NOT (x1 > x0 AND y1 > y0) AS empty FROM c""",
    "union_boxes": f"SELECT page_id, min(text_box.x0) AS x0, min(text_box.y0) AS y0, max(text_box.x1) AS x1, max(text_box.y1) AS y1 FROM {REGIONS_SQL} WHERE text_box IS NOT NULL GROUP BY page_id",
    "lettering_bounds": f"""
        WITH r AS (SELECT region_id, bubble_box, greatest(8, round_even({HEIGHT} * 0.012, 0))::INT AS least_, greatest(greatest(8, round_even({HEIGHT} * 0.012, 0)), round_even({HEIGHT} * 0.04, 0))::INT AS page,
                          round_even(sqrt(({AREA.format("text_box")})::DOUBLE / greatest(1, length(text))) * (CASE WHEN target_lang = 'ja' THEN 0.65 ELSE 1.1 END)::DOUBLE, 0)::INT AS wish
                   FROM {REGIONS_SQL} WHERE text_box IS NOT NULL AND text IS NOT NULL), m AS (SELECT *, least(page, greatest(least_, wish)) AS most_ FROM r)
        SELECT region_id, least_ AS least, most_ AS most, (CASE WHEN bubble_box IS NULL THEN greatest(1, most_ // 8) ELSE 0 END)::INT AS stroke FROM m""",
    "likely_detections": f"SELECT page_id, det_ord, label, score FROM {DETECTIONS_SQL} WHERE score > 0.35::DOUBLE",
    "suppressed": f"WITH k AS ({_fold('score DESC, det_ord', 'd[1].l = k.l AND', 0.7)} FROM {DETECTIONS_SQL} WHERE score > 0.35::DOUBLE GROUP BY page_id) SELECT k.page_id, k.det_ord, label FROM k JOIN {DETECTIONS_SQL} d ON d.page_id = k.page_id AND d.det_ord = k.det_ord",
    "pruned_boxes": f"""
        SELECT page_id, det_ord AS box_ord FROM ({_fold('box.y0, box.x0, det_ord', '', 0.75)} FROM {DETECTIONS_SQL}
        WHERE box.x1 - box.x0 >= 6 AND box.y1 - box.y0 >= 6 AND (box.x1 - box.x0) * (box.y1 - box.y0) BETWEEN greatest(25, floor({WIDTH * HEIGHT} * 0.00035)) AND greatest(100, floor({WIDTH * HEIGHT} * 0.45))
          AND greatest(box.x1 - box.x0, box.y1 - box.y0)::DOUBLE / greatest(1, least(box.x1 - box.x0, box.y1 - box.y0)) <= 12 GROUP BY page_id)""",
    "assigned_bubbles": f"""
        WITH d AS (SELECT * FROM {DETECTIONS_SQL}), p AS (SELECT t.page_id, t.det_ord, b.det_ord AS bo, {SHARED.format("t.box", "b.box")} AS s FROM d t JOIN d b ON t.page_id = b.page_id AND t.label <> 0 AND b.label = 0),
             m AS (SELECT page_id, det_ord, arg_max({{'bo': bo, 's': s}}, {{'v': s, 'nb': -bo}}) AS best FROM p WHERE s > 0 GROUP BY ALL)
        SELECT t.page_id, t.det_ord, CASE WHEN best.s > 0.5 * {AREA.format("t.box")} THEN best.bo END AS bubble_ord FROM d t LEFT JOIN m ON m.page_id = t.page_id AND m.det_ord = t.det_ord WHERE t.label <> 0""",
    "reading_order": f"""
        WITH r AS (SELECT page_id, region_ord, text_box AS b, row_number() OVER (PARTITION BY page_id ORDER BY text_box.y0, region_ord) AS o FROM {REGIONS_SQL} WHERE text_box IS NOT NULL),
             f AS (SELECT page_id, list_reduce(list([{{'y0': b.y0, 'y1': b.y1, 'm': [{{'k': -b.x1, 'o': o, 'i': region_ord}}]}}] ORDER BY o), lambda a, c:
                       CASE WHEN {JOINS_ROW} IS NULL THEN list_concat(a, c) ELSE list_transform(a, lambda w, n: CASE WHEN n = {JOINS_ROW}
                           THEN {{'y0': least(w.y0, c[1].y0), 'y1': greatest(w.y1, c[1].y1), 'm': list_concat(w.m, c[1].m)}} ELSE w END) END) AS rows FROM r GROUP BY page_id),
             g AS (SELECT page_id, flatten(list_transform(rows, lambda w: list_transform(list_sort(w.m), lambda x: x.i))) AS ids FROM f)
        SELECT page_id, unnest(ids) AS region_ord, (generate_subscripts(ids, 1) - 1)::INT AS place FROM g""",
    "lettering_areas": f"""
        WITH r AS (SELECT region_id, text_box AS t, bubble_box AS b, greatest(0, floor(round_even((text_box.y1 - text_box.y0) * 0.6::DOUBLE - (text_box.x1 - text_box.x0), 0) / 2))::INT AS e FROM {REGIONS_SQL} WHERE text_box IS NOT NULL),
             c AS (SELECT *, greatest(0, least({WIDTH}, t.x0 - e)) AS cx0, greatest(0, least({HEIGHT}, t.y0)) AS cy0, greatest(0, least({WIDTH}, t.x1 + e)) AS cx1, greatest(0, least({HEIGHT}, t.y1)) AS cy1 FROM r),
             i AS (SELECT *, cx1 > cx0 AND cy1 > cy0 AS inside, (b.x1 - b.x0) * 0.15::DOUBLE AS dx, (b.y1 - b.y0) * 0.15::DOUBLE AS dy FROM c)
        SELECT region_id, CASE WHEN b IS NOT NULL THEN round_even(b.x0 + dx, 0)::INT WHEN inside THEN cx0 ELSE t.x0 - e END AS x0, CASE WHEN b IS NOT NULL THEN round_even(b.y0 + dy, 0)::INT WHEN inside THEN cy0 ELSE t.y0 END AS y0,
               CASE WHEN b IS NOT NULL THEN round_even(b.x1 - dx, 0)::INT WHEN inside THEN cx1 ELSE t.x1 + e END AS x1, CASE WHEN b IS NOT NULL THEN round_even(b.y1 - dy, 0)::INT WHEN inside THEN cy1 ELSE t.y1 END AS y1 FROM i""",
    "grouped_regions": f"""
        WITH d AS {DETECTIONS_SQL}, t AS (SELECT page_id, det_ord, box FROM d WHERE label <> 0), b AS (SELECT page_id, det_ord AS n, box AS bubble FROM d WHERE label = 0),
             s AS (SELECT page_id, det_ord, n, greatest(0, least(box.x1, bubble.x1) - greatest(box.x0, bubble.x0)) * greatest(0, least(box.y1, bubble.y1) - greatest(box.y0, bubble.y0)) AS shared FROM t JOIN b USING (page_id)),
             best AS (SELECT * FROM s WHERE shared > 0 QUALIFY row_number() OVER (PARTITION BY page_id, det_ord ORDER BY shared DESC, n) = 1),
             a AS (SELECT t.*, CASE WHEN shared > 0.5 * greatest(0, box.x1 - box.x0) * greatest(0, box.y1 - box.y0) THEN n END AS n FROM t LEFT JOIN best USING (page_id, det_ord)),
             g AS (SELECT page_id, n IS NULL AS free, coalesce(n, det_ord) AS k, count(*)::INT AS n_boxes, min(box.x0) AS x0, min(box.y0) AS y0, max(box.x1) AS x1, max(box.y1) AS y1, min(det_ord) AS first FROM a GROUP BY ALL)
        SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY y0, x1 DESC, free, first) - 1)::INT AS region_ord, n_boxes, x0, y0, x1, y1 FROM g""",
}
