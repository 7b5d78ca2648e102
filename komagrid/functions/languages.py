"""The language dimension and the rules about pairs of languages.

The dimension is a literal table; joins against it are broadcast joins whatever the other side's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "ord int, code string, name string, translator string, nllb string, tesseract string, tesseract_vertical string, square_glyphs boolean, word_separator string, variant_of string"

# The languages that can be read, in their order.
LANGUAGES = (
    ("ja", "Japanese", "ja", "jpn_Jpan", None, "jpn_vert", True, "", None),
    ("ko", "Korean", "ko", "kor_Hang", "kor", "kor_vert", True, " ", None),
    ("zh", "Chinese (Simplified)", "zh-CN", "zho_Hans", "chi_sim", "chi_sim_vert", True, "", None),
    ("zh-hk", "Chinese (Traditional)", "zh-TW", "zho_Hant", "chi_tra", "chi_tra_vert", True, "", None),
    ("en", "English", "en", "eng_Latn", "eng", None, False, " ", None),
    ("es", "Spanish", "es", "spa_Latn", "spa", None, False, " ", None),
    ("es-la", "Spanish (Latin America)", "es", "spa_Latn", "spa", None, False, " ", "es"),
    ("pt", "Portuguese", "pt", "por_Latn", "por", None, False, " ", None),
    ("pt-br", "Portuguese (Brazil)", "pt", "por_Latn", "por", None, False, " ", "pt"),
    ("id", "Indonesian", "id", "ind_Latn", "ind", None, False, " ", None),
    ("fr", "French", "fr", "fra_Latn", "fra", None, False, " ", None),
    ("it", "Italian", "it", "ita_Latn", "ita", None, False, " ", None),
    ("de", "German", "de", "deu_Latn", "deu", None, False, " ", None),
    ("ru", "Russian", "ru", "rus_Cyrl", "rus", None, False, " ", None),
    ("tr", "Turkish", "tr", "tur_Latn", "tur", None, False, " ", None),
    ("pl", "Polish", "pl", "pol_Latn", "pol", None, False, " ", None),
    ("vi", "Vietnamese", "vi", "vie_Latn", "vie", None, False, " ", None),
)
# The languages that can be written.
TARGETS = ("en", "vi")
# Names of catalogue languages that cannot be read.
OTHER_NAMES = {
    "ar": "Arabic", "bg": "Bulgarian", "bn": "Bengali", "ca": "Catalan", "cs": "Czech",
    "da": "Danish", "el": "Greek", "fa": "Persian", "fi": "Finnish", "he": "Hebrew",
    "hi": "Hindi", "hu": "Hungarian", "ja-ro": "Japanese (romanized)", "ko-ro": "Korean (romanized)",
    "zh-ro": "Chinese (romanized)", "lt": "Lithuanian", "mn": "Mongolian", "ms": "Malay",
    "my": "Burmese", "ne": "Nepali", "nl": "Dutch", "no": "Norwegian", "ro": "Romanian",
    "sv": "Swedish", "th": "Thai", "tl": "Filipino", "uk": "Ukrainian",
}


def languages(spark: SparkSession) -> DataFrame:
    """The dimension with its order."""
    return spark.createDataFrame([(i, *row) for i, row in enumerate(LANGUAGES)], SCHEMA)


def source_languages(spark: SparkSession, include_variants: bool = False) -> DataFrame:
    """Languages to read; regional variants are hidden unless asked for."""
    rows = languages(spark)
    return rows if include_variants else rows.where("variant_of is null")


def target_languages(spark: SparkSession) -> DataFrame:
    return languages(spark).where(F.col("code").isin(*TARGETS))


def with_language(df: DataFrame, column: str, strict: bool = True) -> DataFrame:
    """``df`` with the attributes of its language code; an unknown code is an error, or null attributes if not strict."""
    dim = languages(df.sparkSession).drop("ord").withColumnRenamed("code", "_code")
    out = df.join(F.broadcast(dim), F.col(column) == F.col("_code"), "left")
    if strict:
        known = F.when(F.col("_code").isNull(), F.raise_error(F.concat(F.lit("unsupported language: "), F.coalesce(F.col(column), F.lit("null"))))).otherwise(F.col("_code"))
        out = out.withColumn("_code", known).where(F.col("_code").isNotNull())
    return out.drop("_code")


def language_name(code: Column) -> Column:
    """The display name of a code: of a readable language, else of another catalogue language, else the code."""
    names = {row[0]: row[1] for row in LANGUAGES} | {k: v for k, v in OTHER_NAMES.items() if k not in {r[0] for r in LANGUAGES}}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), code)


def _translator(code: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for r in LANGUAGES for x in (r[0], r[2])]), code)


def pair_error(source: Column, target: Column) -> Column:
    """Null for a pair that can be translated, else what is wrong with it."""
    return (
        F.when(_translator(source).isNull(), F.lit("unsupported source"))
        .when(target.isNull() | ~target.isin(*TARGETS), F.lit("unsupported target"))
        .when(_translator(source) == _translator(target), F.lit("same language"))
    )


def is_supported(code: Column) -> Column:
    """Whether a catalogue code is a language that can be read."""
    return _translator(code).isNotNull()


def ordered_for_choice(codes: DataFrame, column: str = "code") -> DataFrame:
    """Catalogue languages as they are offered: readable ones first, then by name."""
    named = codes.withColumns({"name": language_name(F.col(column)), "supported": is_supported(F.col(column))})
    return named.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("supported"), "name", column)))


def preferred_source(available: DataFrame, key: str, order: list[str], target: str) -> DataFrame:
    """(key, source): the first of ``order`` that is readable and not the target, else the first readable one offered.

    ``available``: key, ord, code.
    """
    rank = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("code"))
    readable = available.where(is_supported(F.col("code")))
    wanted = F.when((rank > 0) & (F.col("code") != target), rank)
    return readable.groupBy(key).agg(F.coalesce(F.min_by("code", wanted), F.min_by("code", "ord")).alias("source"))
