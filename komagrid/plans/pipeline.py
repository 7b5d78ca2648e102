"""The way of a page in one plan: detections and OCR tokens to ordered, read and translated regions.

One shuffle by page serves suppression, grouping and reading order; translation goes through its backends page by page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from komagrid.functions import languages
from komagrid.operators import ocr, regions
from komagrid.operators import translation as tr


def page_regions(detections: DataFrame, right_to_left: bool, threshold: float = 0.35) -> DataFrame:
    """(page_id, place, region_ord, boxes, text_box, bubble) of pages in reading order."""
    grouped = regions.group_regions(regions.suppress(regions.likely(detections, threshold)))
    order = regions.reading_order(grouped, F.lit(right_to_left))
    return grouped.join(order, ["page_id", "region_ord"])


def read_regions(found: DataFrame, tokens: DataFrame, source: str) -> DataFrame:
    """``found`` with the text of each region: its boxes read in order, those with text joined.

    ``tokens``: page_id, box (as detected), tok_ord, block, par, line, text, conf.
    """
    separator = next(row[7] for row in languages.LANGUAGES if row[0] == source)
    boxes = found.select("page_id", "region_ord", F.posexplode("boxes").alias("box_ord", "box"), F.col("bubble").isNotNull().alias("in_bubble"))
    key = F.concat_ws("/", F.col("page_id").cast("string"), F.to_json("box"))
    keyed = tokens.withColumn("region_id", key)
    read = ocr.region_text(keyed, boxes.select(key.alias("region_id"), F.lit(separator).alias("separator"), "in_bubble").dropDuplicates(["region_id"]))
    texts = boxes.withColumn("region_id", key).join(read.select("region_id", "text"), "region_id", "left").groupBy("page_id", "region_ord").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("box_ord", "text"))), lambda x: x["text"]).alias("texts")
    )
    return found.join(texts, ["page_id", "region_ord"]).withColumn("text", ocr.box_texts(F.col("texts"), F.lit(separator))).drop("texts")


def translate_pages(detections: DataFrame, tokens: DataFrame, source: str, target: str, backends: tr.Backends, order: str, right_to_left: bool | None = None, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(regions with text, translation and failed, new cache) of many pages."""
    rtl = source == "ja" if right_to_left is None else right_to_left
    read = read_regions(page_regions(detections, rtl), tokens, source)
    texts = read.select(F.col("page_id").cast("string").alias("page"), F.col("place").alias("ord"), "text")
    done, cache = tr.translate(texts, source, target, backends, order, cache)
    found = done.select(F.col("page").alias("_page"), F.col("ord").alias("place"), "translation")
    out = read.withColumn("_page", F.col("page_id").cast("string")).join(found, ["_page", "place"]).drop("_page")
    return out.withColumn("failed", tr.is_failed(F.col("text"), F.col("translation"))), cache
