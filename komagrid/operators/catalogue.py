"""Catalogue payloads as rows: titles, chapters, page addresses, and the order in which they are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from komagrid.functions import languages
from komagrid.functions import text as t

TITLE = "struct<title:map<string,string>,altTitles:array<map<string,string>>,originalLanguage:string,availableTranslatedLanguages:array<string>>"
RELATION = "array<struct<id:string,type:string,attributes:string>>"
CHAPTER = (
    f"struct<id:string,attributes:struct<volume:string,chapter:string,title:string,translatedLanguage:string,pages:int,externalUrl:string>,relationships:{RELATION}>"
)
MANGA = f"struct<id:string,attributes:{TITLE},relationships:{RELATION}>"
PAGES = "struct<baseUrl:string,chapter:struct<hash:string,data:array<string>,dataSaver:array<string>>>"
# The languages in which a title is preferred.
TITLE_ORDER = ("en", "ja-ro", "ko-ro", "zh-ro")


def pick_title(titles: Column, alternatives: Column) -> Column:
    """A title by language preference, an English alternative, the first title, or 'Untitled'."""
    given = lambda c: F.nullif(c, F.lit(""))
    english = F.filter(F.coalesce(alternatives, F.array().cast("array<map<string,string>>")), lambda a: F.coalesce(F.try_element_at(a, F.lit("en")), F.lit("")) != "")
    return F.coalesce(
        *[given(F.try_element_at(titles, F.lit(k))) for k in TITLE_ORDER],
        F.try_element_at(F.try_element_at(english, F.lit(1)), F.lit("en")),
        F.try_element_at(F.map_values(titles), F.lit(1)),
        F.lit("Untitled"),
    )


def relationship(relations: Column, kind: str) -> Column:
    """The first related record of a kind."""
    return F.try_element_at(F.filter(relations, lambda r: r["type"] == kind), F.lit(1))


def distinct_languages(codes: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(codes, lambda c: F.coalesce(c, F.lit("")) != "")))


def flatten_titles(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(id, title, original_language, languages) of title payloads in JSON."""
    d = payloads.select(F.from_json(F.col(column), MANGA).alias("m"))
    a = "m.attributes."
    return d.select(
        "m.id", pick_title(F.col(a + "title"), F.col(a + "altTitles")).alias("title"), F.col(a + "originalLanguage").alias("original_language"),
        distinct_languages(F.coalesce(F.col(a + "availableTranslatedLanguages"), F.array().cast("array<string>"))).alias("languages"),
    )


def flatten_chapters(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """The eight fields of chapter payloads in JSON, with their defaults, and the related title's id and name."""
    d = payloads.select(F.from_json(F.col(column), CHAPTER).alias("c"))
    group = F.get_json_object(relationship(F.col("c.relationships"), "scanlation_group")["attributes"], "$.name")
    manga = relationship(F.col("c.relationships"), "manga")
    title = F.from_json(manga["attributes"], TITLE)
    return d.select(
        "c.id", F.col("c.attributes.volume").alias("volume"), F.col("c.attributes.chapter").alias("chapter"), F.coalesce("c.attributes.title", F.lit("")).alias("title"),
        F.col("c.attributes.translatedLanguage").alias("language"), F.coalesce("c.attributes.pages", F.lit(0)).alias("pages"), F.coalesce(group, F.lit("")).alias("group"),
        F.col("c.attributes.externalUrl").alias("external_url"), manga["id"].alias("manga_id"),
        F.when(manga["attributes"].isNotNull(), pick_title(title["title"], title["altTitles"])).otherwise("").alias("manga_title"),
    )


def readable(chapters: DataFrame) -> DataFrame:
    return chapters.where("pages > 0")


def chapter_key(chapter: Column, group: Column) -> Column:
    """Chapters by number, those without one last, then by group."""
    return F.struct(F.coalesce(chapter.try_cast("double"), F.lit(float("inf"))).alias("number"), F.lower(F.coalesce(group, F.lit(""))).alias("group"))


def page_urls(payloads: DataFrame, key: str = "chapter_id", column: str = "payload", saver: bool = False) -> DataFrame:
    """(key, page, url) of a chapter's pages, full size or data-saving."""
    d = payloads.select(key, F.from_json(F.col(column), PAGES).alias("p"))
    names, kind = ("p.chapter.dataSaver", "data-saver") if saver else ("p.chapter.data", "data")
    return d.select(key, "p", F.posexplode(names).alias("page", "name")).select(key, "page", F.concat_ws("/", "p.baseUrl", F.lit(kind), "p.chapter.hash", "name").alias("url"))


def resolve_links(links: DataFrame, titles: DataFrame, chapters: DataFrame, column: str = "link") -> DataFrame:
    """``links`` with kind, manga_id and chapter_id; a bare id is tried as a chapter, then as a title."""
    parsed = links.withColumns({"kind": t.link_kind(F.col(column)), "_id": t.link_id(F.col(column))})
    by_chapter = chapters.select(F.col("id").alias("_id"), F.col("manga_id").alias("_of")).dropDuplicates(["_id"])
    by_title = titles.select(F.col("id").alias("_id"), F.lit(True).alias("_title")).dropDuplicates(["_id"])
    out = parsed.join(by_chapter, "_id", "left").join(by_title, "_id", "left")
    as_chapter = F.col("kind").isin("chapter", "unknown") & F.col("_of").isNotNull()
    as_title = F.col("kind").isin("manga", "unknown") & F.col("_title")
    return out.withColumns({"chapter_id": F.when(as_chapter, F.col("_id")), "manga_id": F.when(as_chapter, F.col("_of")).when(as_title, F.col("_id"))}).drop("_id", "_of", "_title")


def fetch_report(fetches: DataFrame, own_domain: str = "mangadex.org") -> DataFrame:
    """Fetches (url, ...) that are reported: those whose host is not of the catalogue's own domain."""
    host = F.lower(F.try_parse_url(F.col("url"), F.lit("HOST")))
    return fetches.where(host.isNotNull() & ~(host.endswith(own_domain)))


def language_labels(codes: Column, options: Column) -> Column:
    """A language's label: its own name, else the option's text, else the code."""
    name = languages.language_name(codes)
    return F.when(name != codes, name).otherwise(F.coalesce(F.nullif(options, F.lit("")), codes))
