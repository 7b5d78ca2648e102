"""The queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from komagrid.llm import codepoints, lang, langid, lines, mixing, packing, pairs, residue, scan, survivors
from komagrid.session import table


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    regions = table(spark, folder, "region_info").select(
        F.lit("region_info").alias("record_kind"), F.col("region_id").alias("record_id"), F.col("text").alias("source"), "translation", "target_lang", "manga_id"
    )
    history = table(spark, folder, "context_history").select(
        F.lit("context_history").alias("record_kind"), F.col("history_id").alias("record_id"), "source", "translation", "target_lang", F.lit(None).cast("string").alias("manga_id")
    )
    return regions.unionByName(history)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    dictionaries = lang.fit(table(spark, folder, "documents"))
    return pairs.defects(_pairs(spark, folder), dictionaries, lines.titles(table(spark, folder, "manga")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "lang", "text")
    left_out = residue.residue(documents.select("doc_id", "text"))
    return langid.find(documents, table(spark, folder, "chapters"), table(spark, folder, "region_info"), table(spark, folder, "manga"), left_out)


def p2_segments(spark: SparkSession, folder: str) -> DataFrame:
    """The runs of sentences of one language in each document and region text, with confidence."""
    documents = table(spark, folder, "documents")
    texts = documents.select(F.lit("documents").alias("record_kind"), F.col("doc_id").alias("record_id"), "manga_id", "text").unionByName(
        table(spark, folder, "region_info").select(F.lit("region_info").alias("record_kind"), F.col("region_id").alias("record_id"), "manga_id", "text")
    )
    return langid.segments(texts, lang.fit(documents), lines.titles(table(spark, folder, "manga")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return scan.find(table(spark, folder, "region_info"), lines.titles(table(spark, folder, "manga")))


def p3_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Both texts of every region as continuous paragraphs."""
    return scan.repaired(table(spark, folder, "region_info"), lines.titles(table(spark, folder, "manga")))


def _names(spark: SparkSession, folder: str) -> DataFrame:
    """(name_id, side, name): names as noted, source and target."""
    names = table(spark, folder, "context_names")
    return names.select("name_id", F.lit("source").alias("side"), F.col("source").alias("name")).unionByName(names.select("name_id", F.lit("target").alias("side"), F.col("target").alias("name")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    texts = (
        table(spark, folder, "region_info").select(F.lit("region_info").alias("record_kind"), F.col("region_id").alias("record_id"), "text")
    ).unionByName(_names(spark, folder).select(F.lit("context_names").alias("record_kind"), F.col("name_id").alias("record_id"), F.col("name").alias("text")))
    return codepoints.forms_found(texts.where("record_id is not null and text is not null"), "text", ["record_kind", "record_id"])


def p4_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The text of every region in the one form."""
    texts = table(spark, folder, "region_info").select("region_id", "text").where("region_id is not null")
    return codepoints.with_unified(texts, "text", "unified").select("region_id", "unified")


def p4_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names of each side that compare equal in the one form: how many spellings each had."""
    one = codepoints.with_unified(_names(spark, folder).where("name is not null").withColumnRenamed("name", "spelling"), "spelling", "name")
    return one.groupBy("side", "name").agg(F.countDistinct("spelling").alias("spellings"), F.countDistinct("name_id").alias("notes")).where("spellings > 1")


def _releases(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    members = survivors.prepare(table(spark, folder, "chapters"), table(spark, folder, "feeds"))
    return members, survivors.survivors(members)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return survivors.representatives(*_releases(spark, folder))


def p5_survivors(spark: SparkSession, folder: str) -> DataFrame:
    return _releases(spark, folder)[1].select(
        "release_id", "n_records", *survivors.FIELDS, *(F.array_join(f"all_{f}", "|").alias(f"all_{f}") for f in survivors.FIELDS)
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "n_tokens")
    return packing.split_items(packing.pack(docs, table(spark, folder, "pack_specs")))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "n_tokens")
    return packing.containers(packing.pack(docs, table(spark, folder, "pack_specs")))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Targets that the drawn mix cannot reach with all permitted epochs; the cap is then checked as defined."""
    return p7_shares(spark, folder).where("exhausted and capped").select("mix_name", "source")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "n_tokens", "n_chars")
    return mixing.mix_report(docs, table(spark, folder, "mix_targets"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "n_tokens", "n_chars")
    return mixing.mix(docs, table(spark, folder, "mix_targets"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue(table(spark, folder, "documents").select("doc_id", "text"))


def p8_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and tokens that stay once residue is left out, by source."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source", "n_tokens")
    return residue.without_residue(docs).groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": "SELECT spec_name, doc_id FROM documents, pack_specs WHERE n_tokens > capacity",
        "p7_found": """
            WITH s AS (SELECT source, sum(n_tokens) AS n FROM documents GROUP BY source),
                 t AS (SELECT sum(n_tokens) AS total FROM documents)
            SELECT mix_name, m.source FROM mix_targets m CROSS JOIN t LEFT JOIN s ON s.source = m.source
            WHERE m.weight * t.total > m.max_repeats * coalesce(s.n, 0)""",
    }
