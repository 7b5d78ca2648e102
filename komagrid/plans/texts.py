"""Queries over texts: clean-up, casing, languages, words, translation and its context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from komagrid.functions import languages as lg
from komagrid.functions import text as t
from komagrid.operators import layout, ocr
from komagrid.operators import translation as tr
from komagrid.session import table

BLANKS = r"[\s\p{Z}\x{0085}\x{001c}-\x{001f}]"


def _squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{BLANKS}+', ' ', 'g'))"


def _names_sql() -> str:
    names = {k: v for k, v in lg.OTHER_NAMES.items()} | {r[0]: r[1] for r in lg.LANGUAGES}
    return "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in names.items()) + ") AS names(code, name)"


TRANSLATORS_SQL = "(VALUES " + ", ".join(f"('{r[0]}', '{r[2]}')" for r in lg.LANGUAGES) + ") AS tr(code, translator)"


def regions(spark: SparkSession, folder: str) -> DataFrame:
    """region_info with each region once, as it was delivered first."""
    rows = table(spark, folder, "region_info")
    first = rows.groupBy("region_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "region_id"]), F.struct("loaded_at", "text", "translation")).alias("x"))
    return first.select("region_id", "x.*")


REGIONS_SQL = "(SELECT * FROM region_info QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY loaded_at NULLS FIRST, text NULLS FIRST, translation NULLS FIRST) = 1)"
HISTORY_SQL = "(SELECT * FROM context_history QUALIFY row_number() OVER (PARTITION BY history_id ORDER BY added_at) = 1)"


def history(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "context_history").dropDuplicates(["history_id"])


def language_summary(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("lang", t.clean_text(F.col("text")).alias("text"))
    docs = docs.withColumns({"letters": t.letter_count(F.col("text")), "upper": F.length(F.regexp_replace("text", r"[^\p{Lu}]", ""))})
    named = docs.groupBy("lang").agg(F.count("*").alias("n_documents"), F.sum("letters").alias("n_letters"), F.sum("upper").alias("n_upper"))
    return named.withColumns({"name": lg.language_name(F.col("lang")), "supported": lg.is_supported(F.col("lang"))})


def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", t.clean_text(F.col("text")).alias("cleaned"))


def caps_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return regions(spark, folder).select("region_id", F.round(t.upper_share(F.col("text")), 6).alias("share"), t.enough_letters(F.col("text")).alias("kept"))


def sentence_case(spark: SparkSession, folder: str) -> DataFrame:
    return regions(spark, folder).where("text is not null").select("region_id", t.sentence_case(F.col("text")).alias("cased"))


def spanish_marks(spark: SparkSession, folder: str) -> DataFrame:
    misread = F.replace(F.col("text"), F.lit("¡"), F.lit("i"))
    return regions(spark, folder).where("text is not null").select("region_id", t.spanish_marks(misread).alias("marked"))


def join_lines(spark: SparkSession, folder: str) -> DataFrame:
    return regions(spark, folder).where("text is not null").select("region_id", t.join_lines(F.split("text", "\n"), F.lit(" ")).alias("joined"))


def prepared_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The sources of jobs of a known language; those of other jobs are not prepared at all."""
    known = F.broadcast(lg.languages(spark).select("code"))  # as many rows as there are languages
    rows = regions(spark, folder).join(table(spark, folder, "jobs").select(F.col("id").alias("job_id"), F.col("source_lang").alias("code")), "job_id").join(known, "code")
    return rows.select("region_id", t.prepare_source(F.col("text"), F.col("code")).alias("prepared"))


def clean_results(spark: SparkSession, folder: str) -> DataFrame:
    return regions(spark, folder).select("region_id", t.clean_result(F.col("translation")).alias("cleaned"))


def length_guard(spark: SparkSession, folder: str) -> DataFrame:
    rows = regions(spark, folder).where("text is not null and translation is not null")
    return rows.select("region_id", t.length_guard(F.col("text"), F.col("translation")).isNull().alias("dropped"))


def language_pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "jobs").groupBy("source_lang", "target_lang").count().withColumnRenamed("count", "n_jobs")
    return pairs.withColumn("error", lg.pair_error(F.col("source_lang"), F.col("target_lang")))


def language_names(spark: SparkSession, folder: str) -> DataFrame:
    codes = table(spark, folder, "chapters").select(F.col("language").alias("code")).distinct()
    return codes.select("code", lg.language_name(F.col("code")).alias("name"), lg.is_supported(F.col("code")).alias("supported"))


def preferred_sources(spark: SparkSession, folder: str) -> DataFrame:
    offered = table(spark, folder, "manga").select("id", F.posexplode("languages").alias("ord", "code"))
    return lg.preferred_source(offered, "id", ["ja", "ko", "zh", "en"], "en")


def word_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text is not null")
    return ocr.word_frequencies(docs).select("lang", "word", F.round("zipf", 6).alias("zipf"))


def word_corrections(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text is not null")
    words = docs.select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"(?U)([\w£€]+)"), 1)).alias("word"))
    return ocr.correct_words(words, ocr.word_frequencies(docs)).where("corrected <> word")


def token_confidence(spark: SparkSession, folder: str) -> DataFrame:
    rows = regions(spark, folder).where("text is not null").select("region_id", "conf", F.posexplode(F.split("text", "[ \n]")).alias("tok_ord", "text"))
    tokens = rows.select("region_id", "tok_ord", F.lit(1).alias("block"), F.lit(1).alias("par"), F.lit(1).alias("line"), "text", (F.coalesce("conf", F.lit(-1.0)) + F.col("tok_ord") % 7).alias("conf"))
    return ocr.region_confidence(tokens).select("region_id", F.round("confidence", 6).alias("confidence"))


def failed_regions(spark: SparkSession, folder: str) -> DataFrame:
    rows = regions(spark, folder)
    return rows.select("region_id", tr.is_failed(F.col("text"), F.col("translation")).alias("is_failed"), tr.is_lettered(F.col("translation")).alias("is_lettered"))


def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    return tr.page_texts(regions(spark, folder))


def cache_hits(spark: SparkSession, folder: str) -> DataFrame:
    cache = history(spark, folder).where("translation <> ''").groupBy(F.col("source").alias("prepared"), F.lit("x").alias("src"), F.col("target_lang").alias("dst")).agg(F.min("translation").alias("cached"))
    rows = regions(spark, folder).where("text is not null").select("region_id", F.col("text").alias("prepared"), F.lit("x").alias("src"), F.col("target_lang").alias("dst"))
    hits, misses = tr.cache_split(rows, cache)
    return hits.select("region_id", F.col("cached").alias("translation")).unionByName(misses.select("region_id", F.lit(None).cast("string").alias("translation")))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return history(spark, folder).select("chapter_id", "page", F.col("history_id").alias("seq"), "source", "translation")


def rolling_context(spark: SparkSession, folder: str) -> DataFrame:
    rows = tr.rolling_context(_pairs(spark, folder))
    said = F.array_join(F.transform("history", lambda h: F.concat_ws("=", h["source"], h["translation"])), "|")
    return rows.select("chapter_id", "page", F.size("history").alias("n_pairs"), said.alias("said"))


def glossary(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "context_names").dropDuplicates(["name_id"])
    return tr.glossary(names).select("chapter_id", "source", "target", "place")


def prompts(spark: SparkSession, folder: str) -> DataFrame:
    context = tr.rolling_context(_pairs(spark, folder))
    page = _pairs(spark, folder).groupBy("chapter_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "source"))), lambda x: x["source"]).alias("texts"))
    names = glossary(spark, folder).groupBy("chapter_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "source", "target"))), lambda n: F.struct(n["source"].alias("source"), n["target"].alias("target"))).alias("names"))
    rows = context.join(page, ["chapter_id", "page"]).join(names, "chapter_id", "left")
    return rows.select("chapter_id", "page", tr.prompt(F.lit("Japanese"), F.lit("English"), F.coalesce("names", F.array().cast(names.schema["names"].dataType)), F.col("history"), F.col("texts")).alias("prompt"))


def translation_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Every text of the tables through two backends: one that knows texts of few words only, one that gives all back."""
    backends = tr.Backends({
        "short": lambda texts, src, dst, context=None: [x.lower() if len(x.split()) <= 4 else None for x in texts],
        "loud": lambda texts, src, dst, context=None: [x.upper() for x in texts],
    })
    rows = regions(spark, folder).select(F.col("page_id").cast("string").alias("page"), F.col("region_ord").alias("ord"), "text")
    return tr.translate(rows, "es", "en", backends, "short,loud")[0].select("page", "ord", "translation")


def balanced_wrap(spark: SparkSession, folder: str) -> DataFrame:
    return layout.wrap(regions(spark, folder), "region_id", "translation", 12, 120.0)


QUERIES = {
    f.__name__: f
    for f in (
        language_summary, clean_text, caps_ratio, sentence_case, spanish_marks, join_lines, prepared_sources, clean_results, length_guard, language_pairs, language_names, preferred_sources,
        word_frequencies, word_corrections, token_confidence, failed_regions, page_texts, cache_hits, rolling_context, glossary, prompts, translation_fallback, balanced_wrap,
    )
}
CLEAN = _squeezed(r"regexp_replace(text, '[|_\\\[\]{}<>~=]+', ' ', 'g')")
SENTENCE_SQL = rf"""
    CASE WHEN length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) >= 4
          AND length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) >= 0.8 * length(regexp_replace(text, '[^\p{{L}}]', '', 'g'))
    THEN array_to_string(list_transform(regexp_extract_all(lower(text), '(?s)(.*?[.!?…][\s\p{{Z}}\x{{0085}}\x{{001c}}-\x{{001f}}]+|.+)'), lambda p:
        regexp_extract(p, '(?s)^([¿¡"''«(\-]*)(.*)$', 1) ||
        CASE WHEN regexp_matches(substr(regexp_extract(p, '(?s)^([¿¡"''«(\-]*)(.*)$', 2), 1, 1), '[\p{{L}}\p{{N}}\p{{M}}_]')
             THEN upper(substr(regexp_extract(p, '(?s)^([¿¡"''«(\-]*)(.*)$', 2), 1, 1)) ELSE substr(regexp_extract(p, '(?s)^([¿¡"''«(\-]*)(.*)$', 2), 1, 1) END ||
        substr(regexp_extract(p, '(?s)^([¿¡"''«(\-]*)(.*)$', 2), 2)), '')
    ELSE text END"""
TRIMMED = rf"regexp_replace(coalesce(text, ''), '^{BLANKS}+|{BLANKS}+$', '', 'g')"
LONE_I = rf"regexp_replace(regexp_replace({SENTENCE_SQL}, '(^|[^\p{{L}}\p{{M}}\p{{N}}_])i($|[^\p{{L}}\p{{M}}\p{{N}}_])', '\1I\2', 'g'), '(^|[^\p{{L}}\p{{M}}\p{{N}}_])i($|[^\p{{L}}\p{{M}}\p{{N}}_])', '\1I\2', 'g')"
UNESCAPED = "replace(replace(replace(replace(replace(translation, '&quot;', '\"'), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
ORACLES = {
    "language_summary": rf"""
        WITH d AS (SELECT lang, {CLEAN} AS text FROM documents)
        SELECT lang, count(*) AS n_documents, sum(length(regexp_replace(text, '[^\p{{L}}]', '', 'g')))::BIGINT AS n_letters, sum(length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')))::BIGINT AS n_upper,
               coalesce(any_value(name), lang) AS name, any_value(translator) IS NOT NULL AS supported
        FROM d LEFT JOIN {_names_sql()} ON lang = names.code LEFT JOIN {TRANSLATORS_SQL} ON lang = tr.code GROUP BY lang""",
    "clean_text": f"SELECT doc_id, {CLEAN} AS cleaned FROM documents",
    "caps_ratio": rf"""
        SELECT region_id, round(length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) / nullif(length(regexp_replace(text, '[^\p{{L}}]', '', 'g')), 0), 6) AS share,
               CASE WHEN length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) >= 2 THEN text ELSE '' END AS kept FROM {REGIONS_SQL}""",
    "sentence_case": f"SELECT region_id, {SENTENCE_SQL} AS cased FROM {REGIONS_SQL} WHERE text IS NOT NULL",
    "join_lines": rf"""
        SELECT region_id, coalesce((list_reduce(list_transform(string_split(text, chr(10)), lambda l: [l]), lambda a, b:
            CASE WHEN a[1] = '' THEN b WHEN regexp_matches(a[1], '(?s)\p{{L}}-$') AND regexp_matches(b[1], '^\p{{L}}') THEN [left(a[1], length(a[1]) - 1) || b[1]] ELSE [a[1] || ' ' || b[1]] END))[1], '') AS joined
        FROM {REGIONS_SQL} WHERE text IS NOT NULL""",
    "length_guard": f"""
        SELECT region_id, (CASE WHEN {_squeezed("translation")} = '' THEN 0 ELSE len(string_split({_squeezed("translation")}, ' ')) END) >
               2 * (CASE WHEN {_squeezed("text")} = '' THEN 0 ELSE len(string_split({_squeezed("text")}, ' ')) END) + 2 AS dropped
        FROM {REGIONS_SQL} WHERE text IS NOT NULL AND translation IS NOT NULL""",
    "language_pairs": f"""
        SELECT source_lang, target_lang, count(*) AS n_jobs,
               CASE WHEN any_value(s.translator) IS NULL THEN 'unsupported source' WHEN target_lang IS NULL OR target_lang NOT IN ('en', 'vi') THEN 'unsupported target'
                    WHEN any_value(s.translator) = target_lang THEN 'same language' END AS error
        FROM jobs LEFT JOIN {TRANSLATORS_SQL.replace("AS tr", "AS s")} ON source_lang = s.code GROUP BY source_lang, target_lang""",
    "language_names": f"""
        SELECT DISTINCT language AS code, coalesce(name, language) AS name, translator IS NOT NULL AS supported
        FROM chapters LEFT JOIN {_names_sql()} ON language = names.code LEFT JOIN {TRANSLATORS_SQL} ON language = tr.code""",
    "preferred_sources": f"""
        WITH o AS (SELECT id, unnest(languages) AS code, generate_subscripts(languages, 1) AS ord FROM manga), r AS (SELECT id, o.code, ord FROM o JOIN {TRANSLATORS_SQL} ON o.code = tr.code)
        SELECT id, coalesce(arg_min(code, CASE WHEN code <> 'en' THEN nullif(list_position(['ja', 'ko', 'zh', 'en'], code), 0) END), arg_min(code, ord)) AS source FROM r GROUP BY id""",
    "word_frequencies": r"""
        WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '([\p{L}'']+)')) AS word FROM documents WHERE lang IS NOT NULL), c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL)
        SELECT lang, word, round(log10(n * 1e9 / sum(n) OVER (PARTITION BY lang)), 6) AS zipf FROM c""",
    "token_confidence": f"""
        WITH r AS (SELECT region_id, coalesce(conf, -1) AS conf, unnest(string_split_regex(text, '[ \\n]')) AS tok, generate_subscripts(string_split_regex(text, '[ \\n]'), 1) - 1 AS o FROM {REGIONS_SQL} WHERE text IS NOT NULL),
             k AS (SELECT region_id, conf + o % 7 AS conf, length({_squeezed("tok")}) AS n FROM r)
        SELECT region_id, round(sum(conf * n) / nullif(sum(n), 0), 6) AS confidence FROM k WHERE n > 0 AND conf >= 0 GROUP BY region_id""",
    "failed_regions": f"SELECT region_id, coalesce(text, '') <> '' AND translation IS NULL AS is_failed, coalesce(translation, '') <> '' AS is_lettered FROM {REGIONS_SQL}",
    "page_texts": f"""
        SELECT page_id, coalesce(string_agg(nullif(text, ''), chr(10) ORDER BY region_ord, text), '') AS source, coalesce(string_agg(nullif(translation, ''), chr(10) ORDER BY region_ord, translation), '') AS translation,
               count(*) FILTER (coalesce(text, '') <> '' AND translation IS NULL) AS n_failed FROM {REGIONS_SQL} GROUP BY page_id""",
    "cache_hits": f"""
        WITH c AS (SELECT source, target_lang, min(translation) AS translation FROM {HISTORY_SQL} WHERE translation <> '' GROUP BY ALL)
        SELECT region_id, c.translation FROM {REGIONS_SQL} r LEFT JOIN c ON r.text = c.source AND r.target_lang = c.target_lang WHERE text IS NOT NULL""",
    "rolling_context": f"""
        WITH h AS (SELECT * FROM {HISTORY_SQL}), p AS (SELECT DISTINCT chapter_id, page FROM h),
             e AS (SELECT p.chapter_id, p.page, h.page AS hp, history_id, source || '=' || translation AS x FROM p JOIN h ON h.chapter_id = p.chapter_id AND h.page < p.page AND source <> '' AND translation <> ''),
             l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY chapter_id, page ORDER BY hp DESC, history_id DESC) <= 40)
        SELECT p.chapter_id, p.page, count(x) AS n_pairs, coalesce(string_agg(x, '|' ORDER BY hp, history_id), '') AS said FROM p LEFT JOIN l USING (chapter_id, page) GROUP BY ALL""",
    "glossary": """
        WITH n AS (SELECT * FROM context_names QUALIFY row_number() OVER (PARTITION BY name_id ORDER BY ord) = 1),
             g AS (SELECT chapter_id, source, arg_max(target, ord) AS target, min(ord) AS f FROM n WHERE source <> '' AND target <> '' GROUP BY ALL)
        SELECT chapter_id, source, target, row_number() OVER (PARTITION BY chapter_id ORDER BY f, source) AS place FROM g""",
    "spanish_marks": rf"""
        SELECT region_id, regexp_replace(replace(text, '¡', 'i'), '(^|[\s\p{{Z}}¿"''(])i([A-ZÁÉÍÓÚÑ])', '\1¡\2', 'g') AS marked FROM {REGIONS_SQL} WHERE text IS NOT NULL""",
    "prepared_sources": rf"""
        WITH r AS (SELECT region_id, source_lang AS code, {TRIMMED} AS text FROM {REGIONS_SQL} x JOIN jobs ON jobs.id = x.job_id JOIN {TRANSLATORS_SQL} ON source_lang = tr.code)
        SELECT region_id, CASE code WHEN 'ja' THEN regexp_replace(replace(replace(text, '．．．', '…'), '...', '…'), '[ー〜~]{{2,}}', 'ー', 'g')
               WHEN 'en' THEN {LONE_I} ELSE {SENTENCE_SQL} END AS prepared FROM r""",
    "clean_results": f"SELECT region_id, {_squeezed(UNESCAPED)} AS cleaned FROM {REGIONS_SQL}",
    "word_corrections": rf"""
        WITH n AS (SELECT lang, unnest(regexp_extract_all(lower(text), '([\p{{L}}'']+)')) AS word FROM documents WHERE lang IS NOT NULL), k AS (SELECT lang, word, count(*) AS n FROM n GROUP BY ALL),
             f AS (SELECT lang, word, log10(n * 1e9 / sum(n) OVER (PARTITION BY lang)) AS zipf FROM k),
             w AS (SELECT DISTINCT lang, unnest(regexp_extract_all(text, '([\p{{L}}\p{{M}}\p{{N}}_£€]+)')) AS word FROM documents WHERE text IS NOT NULL AND lang IN ({", ".join(f"'{x}'" for x in ocr.CORRECTED)})),
             own AS (SELECT w.lang, w.word, coalesce(zipf, 0) AS own FROM w LEFT JOIN f ON f.lang = w.lang AND f.word = lower(w.word)),
             rare AS (SELECT * FROM own WHERE length(word) >= 3 AND own < {ocr.KNOWN_ZIPF}),
             c(bad, good) AS (VALUES {", ".join(f"('{b}', '{g}')" for b, g in [(b, g) for b, all_ in ocr.CONFUSIONS.items() for g in all_] + list(ocr.PAIRS))}),
             one AS (SELECT DISTINCT lang, word, own, left(word, i - 1) || good || substr(word, i + length(bad)) AS v FROM (SELECT *, unnest(generate_series(1, length(word))) AS i FROM rare) JOIN c ON substr(word, i, length(bad)) = bad
                     UNION SELECT lang, word, own, substr(word, 2) FROM rare WHERE length(word) >= 5),
             two AS (SELECT DISTINCT lang, word, own, left(v, i - 1) || good || substr(v, i + length(bad)) AS v FROM (SELECT *, unnest(generate_series(1, length(v))) AS i FROM one WHERE v <> word) JOIN c ON substr(v, i, length(bad)) = bad),
             every AS (SELECT lang, word, own, v, 1 AS step FROM one UNION ALL SELECT lang, word, own, v, 2 FROM (FROM two EXCEPT FROM one)),
             best AS (SELECT e.lang, e.word, own, step, arg_max(v, (zipf, v)) AS v, max(zipf) AS zipf FROM every e JOIN f ON f.lang = e.lang AND f.word = lower(v) WHERE v <> e.word AND regexp_full_match(v, '\p{{L}}+') GROUP BY ALL),
             answer AS (SELECT lang, word, arg_min(v, step) AS v FROM best WHERE zipf >= {ocr.NEEDED_ZIPF} AND zipf - own >= {ocr.NEEDED_GAIN} GROUP BY ALL),
             cased AS (SELECT lang, word, CASE WHEN word = upper(word) THEN upper(v) WHEN left(word, 1) = upper(left(word, 1)) AND left(word, 1) <> lower(left(word, 1)) THEN upper(left(v, 1)) || substr(v, 2) ELSE v END AS corrected FROM answer)
        SELECT * FROM cased WHERE corrected <> word""",
    "prompts": f"""
        WITH h AS (SELECT * FROM {HISTORY_SQL}), p AS (SELECT chapter_id, page, string_agg(n || ': ' || to_json(source)::VARCHAR, chr(10) ORDER BY n) AS texts
                   FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id, page ORDER BY history_id) AS n FROM h) GROUP BY ALL),
             e AS (SELECT p.chapter_id, p.page, h.page AS hp, history_id, to_json(source)::VARCHAR || ' => ' || to_json(translation)::VARCHAR AS x FROM p JOIN h ON h.chapter_id = p.chapter_id AND h.page < p.page AND source <> '' AND translation <> ''),
             l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY chapter_id, page ORDER BY hp DESC, history_id DESC) <= 40),
             s AS (SELECT chapter_id, page, string_agg(x, chr(10) ORDER BY hp, history_id) AS said FROM l GROUP BY ALL),
             n AS (SELECT * FROM context_names QUALIFY row_number() OVER (PARTITION BY name_id ORDER BY ord) = 1),
             g AS (SELECT chapter_id, source, arg_max(target, ord) AS target, min(ord) AS f FROM n WHERE source <> '' AND target <> '' GROUP BY ALL),
             k AS (SELECT chapter_id, string_agg(source || ' => ' || target, chr(10) ORDER BY f, source) AS names FROM g GROUP BY ALL)
        SELECT chapter_id, page, '[languages]' || chr(10) || 'Japanese => English' || coalesce(chr(10) || chr(10) || '[names: keep these spellings]' || chr(10) || names, '')
               || coalesce(chr(10) || chr(10) || '[said before on earlier pages, for reference]' || chr(10) || said, '') || chr(10) || chr(10) || '[to translate, by number]' || chr(10) || texts AS prompt
        FROM p LEFT JOIN s USING (chapter_id, page) LEFT JOIN k USING (chapter_id)""",
    "translation_fallback": rf"""
        WITH r AS (SELECT page_id::VARCHAR AS page, region_ord AS ord, {TRIMMED} AS text FROM {REGIONS_SQL} x), p AS (SELECT page, ord, {SENTENCE_SQL} AS text FROM r)
        SELECT page, ord, CASE WHEN text = '' THEN '' WHEN len(string_split({_squeezed("text")}, ' ')) <= 4 THEN {_squeezed("lower(text)")} ELSE {_squeezed("replace(upper(text), 'ẞ', 'SS')")} END AS translation FROM p""",
}
