"""Queries over the catalogue, jobs and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from komagrid.functions import text as t
from komagrid.operators import catalogue as c
from komagrid.operators import jobs as j
from komagrid.plans.texts import REGIONS_SQL, regions
from komagrid.session import table

NOW = "2026-02-01 00:00:00"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Part names as file names; the endings come from the keys, so that stems collide."""
    ends = F.element_at(F.array(*map(F.lit, (".png", ".JPG", ".txt", "", ".webp"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, folder, "part").select((F.col("p_partkey") % 97).alias("batch_id"), F.col("p_partkey").cast("int").alias("ord"), F.concat(F.lit("f"), (F.col("p_partkey") % 3).cast("string"), F.lit("/"), "p_name", ends).alias("path"), (F.col("p_size") * 700_000).cast("bigint").alias("size"))


FILES_SQL = """
    (SELECT p_partkey % 97 AS batch_id, p_partkey::INT AS ord, 'f' || (p_partkey % 3) || '/' || p_name || (['.png', '.JPG', '.txt', '', '.webp'])[p_partkey % 5 + 1] AS path, (p_size * 700000)::BIGINT AS size FROM part)"""
BASE_SQL = "regexp_extract(path, '([^/]*)$', 1)"
END_SQL = rf"(CASE WHEN regexp_matches({BASE_SQL}, '(?s)^\.*[^.].*\.[^.]+$') THEN regexp_extract({BASE_SQL}, '(\.[^.]+)$', 1) ELSE '' END)"


def chapter_order(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, folder, "chapters").select("record_id", "manga_id", "language", "chapter", "group_name", "pages")
    order = Window.partitionBy("manga_id", "language").orderBy(c.chapter_key(F.col("chapter"), F.col("group_name")), "record_id")
    return c.readable(rows).select("record_id", F.row_number().over(order).alias("place"))


def chapter_labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chapters").select("record_id", t.chapter_label(F.col("volume"), F.col("chapter"), F.col("title")).alias("label"))


def title_languages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "manga").select("id", F.array_join(c.distinct_languages(F.col("languages")), ",").alias("languages"))


def chapter_search(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chapters")
    return rows.where(t.matches_query(" Lantern ", F.col("chapter"), F.col("title"), F.col("group_name"))).select("record_id")


def link_ids(spark: SparkSession, folder: str) -> DataFrame:
    links = table(spark, folder, "chapters").select("record_id", F.when(F.col("record_id") % 2 == 0, F.concat(F.lit("https://mangadex.org/chapter/"), F.upper("id"), F.lit("/1"))).otherwise(F.col("id")).alias("link"))
    return links.select("record_id", t.link_kind(F.col("link")).alias("kind"), t.link_id(F.col("link")).alias("found"))


def output_names(spark: SparkSession, folder: str) -> DataFrame:
    return files(spark, folder).select("ord", t.safe_stem(F.col("path")).alias("stem"), t.output_name(F.col("path")).alias("output_name"), t.is_image(F.col("path")).alias("is_image"))


def natural_order(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    # numbered per batch, whose size is that of an upload
    return files(spark, folder).select("ord", F.row_number().over(Window.partitionBy("batch_id").orderBy(t.natural_key(F.col("path")), "ord")).alias("place"))


def accepted_uploads(spark: SparkSession, folder: str) -> DataFrame:
    return j.accept_uploads(files(spark, folder))[1]


def batch_titles(spark: SparkSession, folder: str) -> DataFrame:
    return j.batch_title(files(spark, folder))


def upload_names(spark: SparkSession, folder: str) -> DataFrame:
    return j.upload_names(j.accept_uploads(files(spark, folder))[0])


def _done_pages(spark: SparkSession, folder: str) -> DataFrame:
    return regions(spark, folder).groupBy("job_id", "page_idx").agg(F.count_if(F.coalesce("failed", F.lit(False))).alias("n_failed"))


def pages_todo(spark: SparkSession, folder: str) -> DataFrame:
    wanted = table(spark, folder, "jobs").where("total > 0").select(F.col("id").alias("job_id"), F.explode(F.sequence(F.lit(0), F.col("total") - 1)).alias("page_idx"))
    # every seventh page has no output yet
    return j.todo(wanted, _done_pages(spark, folder).where("page_idx % 7 <> 2")).select("job_id", "page_idx")


def job_summary(spark: SparkSession, folder: str) -> DataFrame:
    pages = _done_pages(spark, folder).withColumn("state", F.when(F.col("page_idx") % 11 == 3, "failed").otherwise("done"))
    rows = j.summary(table(spark, folder, "jobs"), pages)
    return rows.select("job_id", "status", "total", F.size("completed").alias("n_completed"), "n_failed_pages", "untranslated", F.round("progress", 6).alias("progress"))


def job_elapsed(spark: SparkSession, folder: str) -> DataFrame:
    jobs = table(spark, folder, "jobs")
    return jobs.select("id", j.elapsed(F.col("started"), F.col("finished"), F.lit(1.8e9)).alias("seconds"), j.download_kind(F.col("total"), F.col("kind")).alias("download"))


def active_jobs(spark: SparkSession, folder: str) -> DataFrame:
    jobs = table(spark, folder, "jobs")
    wanted = table(spark, folder, "chapters").select(F.col("id").alias("chapter_id")).distinct()
    return j.new_jobs(wanted, jobs, ["chapter_id"])


def job_status(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a log of jobs: the meaning of its types as states is made up."""
    states = F.element_at(F.array(*map(F.lit, ("queued", "running", "done", "error", "cancelled"))), (F.col("event_id") % 97 % 5 + 1).cast("int"))
    events = table(spark, folder, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 97 < 5, states).otherwise("running").alias("status"))
    return j.status_of(events)


def expired_loads(spark: SparkSession, folder: str) -> DataFrame:
    loads = regions(spark, folder).select("region_id", F.col("loaded_at").alias("modificationTime"))
    return j.expired(loads, F.lit(NOW).cast("timestamp").cast("double")).select("region_id")


QUERIES = {
    f.__name__: f
    for f in (
        chapter_order, chapter_labels, title_languages, chapter_search, link_ids, output_names, natural_order, accepted_uploads, batch_titles, upload_names, pages_todo, job_summary, job_elapsed,
        active_jobs, job_status, expired_loads,
    )
}
DONE_SQL = f"(SELECT job_id, page_idx, count(*) FILTER (failed) AS n_failed FROM {REGIONS_SQL} GROUP BY ALL)"
ORACLES = {
    "chapter_order": """
        SELECT record_id, row_number() OVER (PARTITION BY manga_id, language ORDER BY coalesce(try_cast(chapter AS DOUBLE), 'infinity'::DOUBLE), lower(coalesce(group_name, '')), record_id) AS place FROM chapters WHERE pages > 0""",
    "chapter_labels": """
        SELECT record_id, concat_ws(' - ', concat_ws(' ', 'Vol. ' || nullif(volume, ''), coalesce('Ch. ' || nullif(chapter, ''), 'Oneshot')), nullif(title, '')) AS label FROM chapters""",
    "title_languages": "SELECT id, array_to_string(list_sort(list_distinct(list_filter(languages, lambda l: coalesce(l, '') <> ''))), ',') AS languages FROM manga",
    "chapter_search": "SELECT record_id FROM chapters WHERE contains(lower(concat_ws(' ', chapter, title, group_name)), 'lantern')",
    "link_ids": "SELECT record_id, CASE WHEN record_id % 2 = 0 THEN 'chapter' ELSE 'unknown' END AS kind, lower(id) AS found FROM chapters",
    "output_names": rf"""
        SELECT ord, trim(regexp_replace(left({BASE_SQL}, length({BASE_SQL}) - length({END_SQL})), '[<>:"/\\|?*\x00-\x1f]+', '_', 'g'), ' .') AS stem,
               left({BASE_SQL}, length({BASE_SQL}) - length({END_SQL})) || CASE WHEN lower({END_SQL}) = '.png' THEN '.png' ELSE '.jpg' END AS output_name,
               lower({END_SQL}) IN ('.png', '.jpg', '.jpeg', '.webp', '.bmp') AS is_image FROM {FILES_SQL}""",
    "natural_order": rf"""
        SELECT ord, row_number() OVER (PARTITION BY batch_id ORDER BY list_transform(regexp_extract_all(path, '\D*\d*'), lambda x:
            {{'t': lower(regexp_extract(x, '^(\D*)', 1)), 'd': coalesce(try_cast(regexp_extract(x, '(\d*)$', 1) AS HUGEINT), -1)}}), ord) AS place FROM {FILES_SQL}""",
    "accepted_uploads": f"""
        WITH f AS (SELECT *, CASE WHEN lower({END_SQL}) NOT IN ('.png', '.jpg', '.jpeg', '.webp', '.bmp') THEN 'skipped' WHEN size > 20971520 THEN 'too_big' END AS why FROM {FILES_SQL}),
             d AS (SELECT * EXCLUDE why, coalesce(why, CASE WHEN row_number() OVER (PARTITION BY batch_id, path, size, why IS NULL ORDER BY ord) > 1 THEN 'duplicate' END) AS why FROM f),
             o AS (SELECT * EXCLUDE why, coalesce(why, CASE WHEN row_number() OVER (PARTITION BY batch_id, why IS NULL ORDER BY ord) > 500 THEN 'over_limit' END) AS why FROM d)
        SELECT batch_id, count(*) FILTER (why IS NULL) AS n_accepted, coalesce(sum(size) FILTER (why IS NULL), 0)::BIGINT AS bytes, count(*) FILTER (why = 'skipped') AS n_skipped, count(*) FILTER (why = 'too_big') AS n_too_big,
               count(*) FILTER (why = 'duplicate') AS n_duplicate, count(*) FILTER (why = 'over_limit') AS n_over_limit FROM o GROUP BY batch_id""",
    "batch_titles": rf"""
        SELECT batch_id, CASE WHEN count(*) = 1 THEN regexp_replace(regexp_extract(min(path), '([^/]*)$', 1), '\.[^.]+$', '') WHEN count(DISTINCT regexp_extract(path, '^([^/]+)/', 1)) = 1 THEN min(regexp_extract(path, '^([^/]+)/', 1)) END AS title
        FROM {FILES_SQL} GROUP BY batch_id""",
    "pages_todo": f"""
        WITH w AS (SELECT id AS job_id, unnest(generate_series(0, total - 1))::INT AS page_idx FROM jobs WHERE total > 0)
        SELECT job_id, page_idx FROM w WHERE NOT EXISTS (SELECT 1 FROM {DONE_SQL} d WHERE d.job_id = w.job_id AND d.page_idx = w.page_idx AND d.page_idx % 7 <> 2)""",
    "job_summary": f"""
        WITH p AS (SELECT job_id, count(*) FILTER (page_idx % 11 <> 3) AS c, count(*) FILTER (page_idx % 11 = 3) AS f, sum(n_failed) FILTER (page_idx % 11 <> 3) AS u FROM {DONE_SQL} GROUP BY job_id)
        SELECT id AS job_id, status, total, coalesce(c, 0)::INT AS n_completed, coalesce(f, 0) AS n_failed_pages, coalesce(u, 0)::BIGINT AS untranslated,
               CASE WHEN total > 0 THEN round((coalesce(c, 0) + coalesce(f, 0)) / total, 6) ELSE 0 END AS progress FROM jobs LEFT JOIN p ON id = job_id""",
    "active_jobs": "SELECT DISTINCT id AS chapter_id FROM chapters WHERE id NOT IN (SELECT chapter_id FROM jobs WHERE chapter_id IS NOT NULL AND status IN ('queued', 'running', 'done'))",
    "job_status": """
        WITH e AS (SELECT user_id AS job_id, event_id AS seq, CASE WHEN event_id % 97 < 5 THEN (['queued', 'running', 'done', 'error', 'cancelled'])[event_id % 97 % 5 + 1] ELSE 'running' END AS status FROM events)
        SELECT job_id, coalesce(arg_min(status, CASE WHEN status IN ('done', 'error', 'cancelled') THEN seq END), arg_max(status, seq)) AS status FROM e GROUP BY job_id""",
    "expired_loads": f"SELECT region_id FROM {REGIONS_SQL} WHERE epoch(loaded_at) < epoch(TIMESTAMP '{NOW}') - 259200",
    "job_elapsed": """
        SELECT id, CASE WHEN coalesce(started, 0) > 0 THEN round_even(coalesce(nullif(finished, 0), 1.8e9) - started, 1) ELSE 0 END AS seconds,
               CASE WHEN total = 1 AND kind = 'upload' THEN 'image' ELSE 'archive' END AS download FROM jobs""",
}
