"""Best representative of each duplicate group: one surviving record per release.

Releases are the components that shared ids and shared (manga, language, chapter number, group) keys give; texts are
brought to one form of characters first. Which value of a field is right is inferred with a latent two-sided quality
model: each source has, for each field, a sensitivity (how often it states a true value) and a specificity (how often it
refrains from a false one), and each stated value is true or not; expectation-maximisation fits both to the patterns of
agreement of all releases of two or more records. Every value judged true is kept, the likeliest goes into the record.
A release of one record is that record: nothing is to be judged, and it is not shuffled.

Defined results: a record without an id, or without number or group, is linked by what it has, or stands alone; a
null or stand-in field states nothing; 0 pages state nothing; a null trust, time or feed ranks lowest; repeated rows of
a record_id count once (the last fetched); an empty table gives no release.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from komagrid.llm import codepoints
from komagrid.session import bounded_rows, cut

# Entries that stand for no value.
STAND_INS = ("", "-", "--", "n/a", "na", "none", "null", "nil", "unknown", "?", "??", "tbd", "tba", "—", "–", ".", "...", "undefined", "nan")
FIELDS = ("chapter", "group_name", "pages", "volume")
#: Patterns (which sources state a value, which state another one) that the model is fitted on: sets of feeds, not records.
MAX_PATTERNS = 500_000
EM_ROUNDS = 30
TEXTS = ["language", "chapter", "group_name", "volume", "title"]


def narrow(text: Column) -> Column:
    """Blanks as one, none at the ends, full-width signs as ASCII; the characters themselves are in one form already."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    ascii_ = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    return F.trim(F.translate(F.regexp_replace(text, "[\\p{Z}\\s]+", " "), wide, ascii_))


def filled(text: Column) -> Column:
    """The trimmed text, or null where it stands for nothing."""
    t = narrow(text)
    return F.when(F.lower(t).isin(*STAND_INS), F.lit(None)).otherwise(t)


def number_key(text: Column) -> Column:
    """A chapter or volume number apart from its spelling: ' 1', '1.0', '001', 'Ch. 1' and full-width '１' are '1'."""
    t = filled(text)
    n = F.regexp_extract(t, r"(\d+(?:[.,]\d+)?)", 1)
    whole = F.regexp_extract(t, r"^\D*\d+(?:[.,]\d+)?\D*$", 0)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(n, ",", "."), r"^0+(?=\d)", ""), r"(\.\d*?)0+$", "$1")
    plain = F.regexp_replace(plain, r"\.$", "")
    return F.when(t.isNull(), F.lit(None)).when(F.length(whole) > 0, plain).otherwise(F.lower(F.regexp_replace(t, "[^\\p{L}\\p{N}]+", "")))


def name_key(text: Column) -> Column:
    """A name without case, blanks, brackets and punctuation."""
    t = F.regexp_replace(F.lower(filled(text)), "[^\\p{L}\\p{N}]+", "")
    return F.when(F.length(t) > 0, t)


def spelling_keys(names: DataFrame, column: str) -> DataFrame:
    """(column, spelled): rare misspellings of a frequent name as that name.

    Names with the same set of letters meet; the most frequent stands for those that differ from it by one letter
    written twice or by two neighbours exchanged. The table holds distinct names only.
    """
    counted = names.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_name")).agg(F.count("*").alias("_n"))
    letters = F.array_join(F.array_sort(F.array_distinct(F.split(F.col("_name"), ""))), "")
    counted = counted.withColumn("_letters", letters)
    order = Window.partitionBy("_letters").orderBy(F.desc("_n"), "_name")
    best = F.first("_name").over(order)
    distance = F.levenshtein(F.col("_name"), F.col("_best"))
    sorted_ = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    doubled = (distance == 1) & (F.length("_name") == F.length("_best") + 1)
    exchanged = (distance == 2) & (sorted_(F.col("_name")) == sorted_(F.col("_best")))
    return counted.withColumn("_best", best).select(F.col("_name").alias(column), F.when(doubled | exchanged, F.col("_best")).otherwise(F.col("_name")).alias("spelled"))


def components(edges: DataFrame, left: str, right: str, most_rounds: int = 60) -> DataFrame:
    """(left, label) for a bipartite graph: the same label for all ``left`` that are connected over ``right``; those that
    are connected with no other are left out.

    Smallest labels travel over distinct edges, with a jump to the label's own label in each round; each round is
    checkpointed. Nothing is collected but the number of changes.
    """
    edges = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null").distinct()
    # what stands alone on either side connects nothing: only the rest goes through the rounds
    linking = edges.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").select("b")
    edges = cut(edges.join(linking, "b", "left_semi"))
    labels = edges.select("a", F.col("a").alias("label")).distinct()
    for _ in range(most_rounds):
        over = edges.join(labels, "a").groupBy("b").agg(F.min("label").alias("label"))
        near = edges.join(over, "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, "a").select("a", "label", F.least("label", "near").alias("new"))
        jump = step.select(F.col("a").alias("new"), F.col("new").alias("far"))
        step = step.join(jump, "new", "left").select("a", "label", F.least("new", F.coalesce("far", "new")).alias("new"))
        step = cut(step)
        changed = step.where("new <> label").limit(1).count()
        labels = step.select("a", F.col("new").alias("label"))
        if not changed:
            return labels.select(F.col("a").alias(left), "label")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def prepare(records: DataFrame, feeds: DataFrame) -> DataFrame:
    """One row per record with its keys, release, trust and the number of filled fields, checkpointed."""
    last = Window.partitionBy("record_id").orderBy(F.desc_nulls_last("fetched_at"), F.desc_nulls_last("updated_at"))
    wanted = ["record_id", "id", "manga_id", "language", "chapter", "group_name", "volume", "title", "pages", "feed_id", "updated_at", "fetched_at"]
    once = records.select(*wanted).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    once = codepoints.unified_columns(once, TEXTS)
    once = once.withColumns({"chapter_key": number_key(F.col("chapter")), "group_raw": name_key(F.col("group_name")), "volume_key": number_key(F.col("volume"))})
    once = cut(once)
    # few names are misspelled: only those are joined
    spelled = spelling_keys(once, "group_raw").where("spelled <> group_raw")
    once = once.join(spelled, "group_raw", "left").withColumn("group_key", F.coalesce("spelled", "group_raw"))
    trust = feeds.groupBy("feed_id").agg(F.max("trust").alias("trust"))
    once = once.join(trust, "feed_id", "left").withColumn("trust", F.coalesce("trust", F.lit(-1)))
    pages = F.when(F.col("pages") > 0, F.col("pages"))
    given = [filled(F.col(c)).isNotNull() for c in ("volume", "chapter", "title", "group_name")] + [pages.isNotNull()]
    language = F.lower(F.regexp_extract(narrow(F.col("language")), "^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    key = F.when(
        F.col("chapter_key").isNotNull() & F.col("group_key").isNotNull() & F.col("manga_id").isNotNull(),
        F.concat_ws("\u0001", "manga_id", F.when(F.length(language) > 0, language).otherwise(F.coalesce("language", F.lit(""))), "chapter_key", "group_key"),
    )
    node = F.coalesce(F.concat(F.lit("i"), "id"), F.concat(F.lit("r"), F.col("record_id").cast("string")))
    once = once.withColumns({"node": node, "key": key, "pages_key": pages, "n_filled": sum((g.cast("int") for g in given), F.lit(0))})
    once = cut(once.select("record_id", "node", "key", "feed_id", "trust", "updated_at", "n_filled", filled(F.col("group_name")).alias("group_shown"), "chapter_key", "group_key", "pages_key", "volume_key"))
    labels = components(once, "node", "key")
    # nodes of releases of two or more records: linked with another, or of several records themselves
    several = once.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    many = labels.select("node", "label").unionByName(several.withColumn("label", F.col("node"))).groupBy("node").agg(F.min("label").alias("label"))
    return cut(once.join(many, "node", "left").withColumn("release", F.coalesce("label", "node")).withColumn("alone", F.col("label").isNull()).drop("label", "node", "key"))


def claims(members: DataFrame) -> DataFrame:
    """(release, field, value, shown, feeds that state it, feeds that state any value of the field), hot groups summed first."""
    values = {"chapter": "chapter_key", "group_name": "group_key", "pages": "pages_key", "volume": "volume_key"}
    # numbers are shown in their plain form, names as the most trusted source writes them
    shown = {f: F.col("group_shown") if f == "group_name" else F.col(v).cast("string") for f, v in values.items()}
    stated = members.select(
        "release", "feed_id", "trust", "updated_at",
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(v).cast("string").alias("value"), shown[f].alias("shown")) for f, v in values.items()])).alias("x"),
    ).select("release", F.coalesce("feed_id", F.lit(-1)).alias("feed"), "trust", "updated_at", "x.field", "x.value", "x.shown").where("value is not null")
    by_feed = stated.groupBy("release", "field", "value", "feed").agg(
        F.max("trust").alias("trust"), F.max("updated_at").alias("updated_at"), F.max_by("shown", F.struct("updated_at", "shown")).alias("shown")
    )
    facts = by_feed.groupBy("release", "field", "value").agg(
        F.array_sort(F.collect_set("feed")).alias("yes"), F.max("trust").alias("trust"), F.max("updated_at").alias("updated_at"), F.max_by("shown", F.struct("trust", "updated_at", "shown")).alias("shown"),
    )
    facts = cut(facts)
    cover = facts.groupBy("release", "field").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("yes")))).alias("cover"))
    return facts.join(cover, ["release", "field"])


def fit_quality(facts: DataFrame, rounds: int = EM_ROUNDS) -> tuple[dict, dict, list[tuple[str, str, str, float]]]:
    """(sensitivity, specificity) by (field, source), and (field, yes, cover, p) of each pattern, from all facts.

    A pattern is which sources state a value and which state any value of its field; facts of one pattern have the same
    probability, so expectation-maximisation runs over the patterns with their counts. They are sets of sources, whose
    number does not grow with the records; more than ``MAX_PATTERNS`` are an error.
    """
    key = lambda c: F.to_json(c)
    counted = facts.groupBy("field", key(F.col("yes")).alias("yes"), key(F.col("cover")).alias("cover")).agg(F.count("*").alias("n"))
    rows = bounded_rows(counted, MAX_PATTERNS, "patterns of sources")
    rows.sort(key=lambda r: (r[0], r[1], r[2]))
    yes, cover = [set(json.loads(r[1])) for r in rows], [json.loads(r[2]) for r in rows]
    sources = sorted({(r[0], s) for r, c in zip(rows, cover, strict=True) for s in c})
    at = {k: i for i, k in enumerate(sources)}
    # one entry for each source of each pattern
    pattern = np.array([i for i, c in enumerate(cover) for _ in c], np.int64)
    source = np.array([at[rows[i][0], s] for i, c in enumerate(cover) for s in c], np.int64)
    said = np.array([s in yes[i] for i, c in enumerate(cover) for s in c], bool)
    n = np.array([r[3] for r in rows], float)
    sens, spec, p = np.full(len(sources), 0.8), np.full(len(sources), 0.9), np.full(len(rows), 0.6)
    for _ in range(rounds if rows else 0):
        odds = np.log(0.6 / 0.4) + np.bincount(pattern, np.where(said, np.log(sens / (1 - spec))[source], np.log((1 - sens) / spec)[source]), len(rows))
        p = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        true, false = (n * p)[pattern], (n * (1 - p))[pattern]
        total = lambda weight: np.bincount(source, weight, len(sources))
        # priors: a source is right more often than not
        new_sens = np.clip((total(true * said) + 8) / (total(true) + 10), 1e-3, 1 - 1e-3)
        new_spec = np.clip((total(false * ~said) + 9) / (total(false) + 10), 1e-3, 1 - 1e-3)
        new_spec = np.maximum(new_spec, 1 - 0.9 * new_sens)  # that a source states a value never counts against it
        change = max(np.abs(new_sens - sens).max(), np.abs(new_spec - spec).max())
        sens, spec = new_sens, new_spec
        if change < 1e-4:
            break
    named = [(f, str(s)) for f, s in sources]
    return dict(zip(named, sens.tolist(), strict=True)), dict(zip(named, spec.tolist(), strict=True)), [(r[0], r[1], r[2], float(x)) for r, x in zip(rows, p, strict=True)]


def judged(facts: DataFrame) -> DataFrame:
    """The facts with ``p``, the probability that each is true."""
    _, _, patterns = fit_quality(facts)
    known = facts.sparkSession.createDataFrame(patterns, "field string, yes_key string, cover_key string, p double")
    keyed = facts.withColumns({"yes_key": F.to_json("yes"), "cover_key": F.to_json("cover")})
    return keyed.join(F.broadcast(known), ["field", "yes_key", "cover_key"]).drop("yes_key", "cover_key")  # at most MAX_PATTERNS


def survivors(members: DataFrame) -> DataFrame:
    """One row per release: the likeliest value of each field, every value judged true, and the release's extremes."""
    many, alone = members.where("not alone"), members.where("alone")
    facts = judged(cut(claims(many)))
    # of the values judged true the likeliest; where the model leaves two alike, the one more sources state
    rank = F.struct((F.col("p") >= 0.5).alias("true"), F.round("p", 6).alias("p"), F.size("yes").alias("votes"), "trust", "updated_at", "value", "shown")
    best = facts.groupBy("release", "field").agg(
        F.max(rank)["shown"].alias("value"), F.array_sort(F.collect_set(F.when(F.col("p") >= 0.5, F.col("shown")))).alias("all")
    )
    wide = best.groupBy("release").agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS],
        *[F.max(F.when(F.col("field") == f, F.col("all"))).alias(f"all_{f}") for f in FIELDS],
    )
    extremes = many.groupBy("release").agg(
        F.count("*").alias("n_records"), F.max("trust").alias("max_trust"), F.max("updated_at").alias("max_updated"), F.max("n_filled").alias("max_filled"),
        F.min("record_id").alias("release_id"),
    )
    own = {"chapter": F.col("chapter_key"), "group_name": F.col("group_shown"), "pages": F.col("pages_key").cast("string"), "volume": F.col("volume_key")}
    single = alone.select(
        "release", F.lit(1).cast("bigint").alias("n_records"), F.col("trust").alias("max_trust"), F.col("updated_at").alias("max_updated"), F.col("n_filled").alias("max_filled"),
        F.col("record_id").alias("release_id"), *[c.alias(f) for f, c in own.items()], *[F.when(c.isNotNull(), F.array(c)).alias(f"all_{f}") for f, c in own.items()],
    )
    return extremes.join(wide, "release", "left").unionByName(single).withColumn("pages", F.col("pages").cast("int"))


def representatives(members: DataFrame, surviving: DataFrame) -> DataFrame:
    """The records at least as trusted, recent and complete as every other of their release of two or more."""
    both = members.where("not alone").join(surviving.where("n_records >= 2").select("release", "max_trust", "max_updated", "max_filled"), "release")
    return both.where("trust = max_trust and updated_at <=> max_updated and n_filled = max_filled").select("record_id").distinct()
