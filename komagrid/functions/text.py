"""Text scalars as Column expressions: line joining, clean-up, casing, names, links and labels.

``BLANK`` is every blank that Unicode splitting knows; Java's classes are ASCII unless asked otherwise.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = r"(?U)[\s\x1c-\x1f\x85]"
# Signs that scanning leaves in a text.
JUNK = r"[|_\\\[\]{}<>~=]+"
# Image files that are pages.
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".webp", ".bmp")
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def squeeze(text: Column) -> Column:
    """Runs of any blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{BLANK}+", " "))


def clean_text(text: Column) -> Column:
    """Runs of scanning junk as a blank, then blanks squeezed."""
    return squeeze(F.regexp_replace(text, JUNK, " "))


def join_lines(lines: Column, separator: Column) -> Column:
    """Lines as one text; a word hyphenated at a line end is made whole where the script has blanks."""

    def step(text: Column, line: Column) -> Column:
        cut = (F.length(separator) > 0) & text.rlike(r"(?s)\p{L}-$") & line.rlike(r"^\p{L}")
        whole = F.concat(F.substring(text, F.lit(1), F.length(text) - 1), line)
        return F.when(text == "", line).when(cut, whole).otherwise(F.concat(text, separator, line))

    return F.aggregate(lines, F.lit(""), step)


def spanish_marks(text: Column) -> Column:
    """A lower-case i in the place of an opening exclamation mark."""
    return F.regexp_replace(text, "(^|(?U)[\\s¿\"'(])i(?=[A-ZÁÉÍÓÚÑ])", "$1¡")


def letter_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def upper_share(text: Column) -> Column:
    """Upper-case letters over letters; null without letters."""
    return F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) / F.nullif(letter_count(text), F.lit(0))


def enough_letters(text: Column) -> Column:
    """The text if it has two letters or more, else ''."""
    return F.when(letter_count(text) >= 2, text).otherwise("")


def sentence_case(text: Column) -> Column:
    """Text in capitals (four letters or more, four fifths upper) with capitals only where sentences begin."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(?Us)(.*?[.!?…][\s\x1c-\x1f]+|.+)"), 1)
    opening = r"(?s)^([¿¡\"'«(\-]*)(.*)$"

    def capital(part: Column) -> Column:
        head, rest = F.regexp_extract(part, opening, 1), F.regexp_extract(part, opening, 2)
        first = F.substring(rest, 1, 1)
        return F.concat(head, F.when(first.rlike(r"(?U)\w"), F.upper(first)).otherwise(first), F.substring(rest, F.lit(2), F.length(rest)))

    shouted = (letter_count(text) >= 4) & (F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) >= 0.8 * letter_count(text))
    return F.when(shouted, F.array_join(F.transform(parts, capital), "")).otherwise(text)


def prepare_source(text: Column, code: Column) -> Column:
    """Text tidied for translation, by language: Japanese dots and long vowels, else casing, and a lone English i."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{BLANK}+|{BLANK}+$", "")
    japanese = F.regexp_replace(F.replace(F.replace(text, F.lit("．．．"), F.lit("…")), F.lit("..."), F.lit("…")), "[ー〜~]{2,}", "ー")
    cased = sentence_case(text)
    return F.when(code == "ja", japanese).when(code == "en", F.regexp_replace(cased, r"(?U)\bi\b", "I")).otherwise(cased)


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else " ".join(html.unescape(t).split()))


def clean_result(text: Column) -> Column:
    """Character references resolved and blanks squeezed; only texts with a reference go through Python."""
    return F.when(F.contains(text, F.lit("&")), _unescape(F.when(F.contains(text, F.lit("&")), text))).otherwise(squeeze(text))


def word_count(text: Column) -> Column:
    t = squeeze(text)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def length_guard(source: Column, output: Column) -> Column:
    """An output far longer than its source as null."""
    return F.when(word_count(output) <= 2 * word_count(source) + 2, output)


def quota_guard(output: Column, marker: str = "WARNING") -> Column:
    """An output that holds a backend's quota marker as null."""
    return F.when(~F.contains(F.upper(output), F.lit(marker.upper())), output)


def layout_words(text: Column, uppercase: bool = True) -> Column:
    """The words to be lettered."""
    t = squeeze(F.upper(text) if uppercase else text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def _base(name: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(F.replace(name, F.lit("\\"), F.lit("/")), "/+$", ""), "([^/]*)$", 1)


def file_suffix(name: Column) -> Column:
    """The extension with its dot as it is written; '' for none, for dots in front only, and for a dot at the end."""
    base = _base(name)
    return F.when(base.rlike(r"(?s)^\.*[^.].*\.[^.]+$"), F.regexp_extract(base, r"(\.[^.]+)$", 1)).otherwise("")


def file_stem(name: Column) -> Column:
    base, end = _base(name), file_suffix(name)
    return F.substring(base, F.lit(1), F.length(base) - F.length(end))


def safe_stem(name: Column) -> Column:
    """A file name without folder and extension, signs that no file system takes as '_', no blanks or dots around."""
    return F.btrim(F.regexp_replace(file_stem(name), r'[<>:"/\\|?*\x00-\x1f]+', "_"), F.lit(" ."))


def output_name(name: Column) -> Column:
    """A translated page keeps its name; PNG stays, anything else is JPEG."""
    return F.concat(file_stem(name), F.when(F.lower(file_suffix(name)) == ".png", ".png").otherwise(".jpg"))


def is_image(name: Column) -> Column:
    return F.lower(file_suffix(name)).isin(*IMAGE_SUFFIXES)


def archive_name(title: Column, label: Column, target: Column) -> Column:
    """'title - label [language].zip' without signs that no file system takes; without a label the title alone."""
    name = F.when(label.isNotNull(), F.concat(title, F.lit(" - "), label)).otherwise(F.coalesce(F.nullif(title, F.lit("")), F.lit("Translated pages")))
    return F.concat(F.trim(F.regexp_replace(F.concat(name, F.lit(" ["), target, F.lit("]")), r'[<>:"/\\|?*]+', "")), F.lit(".zip"))


def natural_key(name: Column) -> Column:
    """A key that sorts 'page2' before 'page10': pairs of text in lower case and number."""
    text = F.regexp_extract_all(name, F.lit(r"(\D*)(\d*)"), 1)
    digits = F.regexp_extract_all(name, F.lit(r"(\D*)(\d*)"), 2)
    return F.zip_with(text, digits, lambda t, d: F.struct(F.lower(t).alias("t"), d.try_cast("decimal(38,0)").alias("d")))


def link_kind(link: Column, host: str = "mangadex.org") -> Column:
    """'manga', 'chapter', 'unknown' for a bare id, or null for no link of the catalogue."""
    found = F.regexp_extract(F.trim(link), rf"{host.replace('.', chr(92) + '.')}/(title|manga|chapter)/{UUID}", 1)
    return (
        F.when(found == "chapter", "chapter").when(found != "", "manga").when(F.trim(link).rlike(f"^{UUID}$"), "unknown")
    )


def link_id(link: Column, host: str = "mangadex.org") -> Column:
    found = F.regexp_extract(F.trim(link), rf"{host.replace('.', chr(92) + '.')}/(?:title|manga|chapter)/({UUID})", 1)
    return F.lower(F.when(found != "", found).when(F.trim(link).rlike(f"^{UUID}$"), F.trim(link)))


def chapter_label(volume: Column, chapter: Column, title: Column) -> Column:
    """'Vol. v Ch. c - title'; 'Oneshot' without a number."""
    given = lambda c: F.nullif(c, F.lit(""))
    label = F.concat_ws(" ", F.concat(F.lit("Vol. "), given(volume)), F.coalesce(F.concat(F.lit("Ch. "), given(chapter)), F.lit("Oneshot")))
    return F.concat_ws(" - ", label, given(title))


def single_title(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^.]+$", "")


def format_bytes(size: Column) -> Column:
    """Bytes for people: KB below a megabyte, MB with one decimal above."""
    return F.when(size < 1024 * 1024, F.concat(F.greatest(F.lit(1), F.round(size / 1024)).cast("bigint").cast("string"), F.lit(" KB"))).otherwise(
        F.concat(F.format_string("%.1f", size / (1024 * 1024)), F.lit(" MB"))
    )


def format_duration(seconds: Column) -> Column:
    """'m min s s' from a minute on, else 's s'."""
    whole = F.round(seconds).cast("bigint")
    return F.when(whole < 60, F.format_string("%d s", whole)).otherwise(F.format_string("%d min %d s", (whole / 60).cast("bigint"), whole % 60))


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {noun}")).otherwise(F.lit(f" {noun}s")))


def matches_query(query: str, *parts: Column) -> Column:
    """Whether a search text is part of a row's texts, in one case."""
    return F.contains(F.lower(F.concat_ws(" ", *parts)), F.lit(query.strip().lower()))


def known_backends(setting: Column, known: list[str]) -> Column:
    """The names of a comma-separated setting that are known, in its order."""
    return F.filter(F.transform(F.split(setting, ","), F.trim), lambda x: x.isin(*known))
