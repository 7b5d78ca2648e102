"""The lines of a scanned page's text: running headers, page numbers, and lines put together to paragraphs."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame

from komagrid.session import bounded_rows

MAX_TITLES = 200_000

# What stands before a page number.
PAGE_WORDS = r"(?:p|pg|pp|page|pag|pág|página|pagina|seite|s|стр|с|trang|tr|hal|halaman|no|nr|№)"
PAGE_NUMBER = re.compile(
    rf"^\s*[-–—~·•\[(|<«*=]*\s*(?:{PAGE_WORDS}\.?\s*)?\d{{1,4}}(?:\s*/\s*\d{{1,4}})?\s*[-–—~·•\])|>»*=]*\s*$|^\s*第?\s*\d{{1,4}}\s*(?:页|頁|ページ|쪽|페이지)\s*$", re.IGNORECASE
)
BARE_NUMBER = re.compile(r"^\s*\d{1,4}\s*$")
ROMAN = re.compile(r"^\s*[-–—~·•\[(|]*\s*(?=[ivxlc]{2,9}\b)c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})\s*[-–—~·•\])|]*\s*$")
HEADER_REST = re.compile(r"^(?:chapter|ch|vol|volume|episode|ep|part|no|page|p|presents?|by|the|and|scans?|team|translations?|group|[\W\d_])*$", re.IGNORECASE)
NOT_WORD = re.compile(r"[\W_]+")
CJK = re.compile(r"[぀-ヿ㐀-鿿、。！？「」]")
WORD = re.compile(r"[^\W_]+")
SENTENCE_END = re.compile(r"[.!?…]\s*$")
BREAKS = re.compile(r"[\r\n]+")
LINE_END = re.compile(r"[ \t]*[\r\n]+[ \t]*")
CUT_WORD = re.compile(r"(?<=[^\W\d_])[-‐¬=­][ \t]*[\r\n]+[ \t]*(?=[^\W\d_])")


def squash(text: str) -> str:
    """Letters and digits only, in one case: how headers are compared."""
    return NOT_WORD.sub("", text).casefold()


class Title(NamedTuple):
    """A title squashed, and its longest word in lower case: no line without that word carries the title."""

    flat: str
    probe: str
    short: bool = False


def titles(manga: DataFrame) -> dict[str, Title]:
    """The title of each manga: a dimension of at most ``MAX_TITLES`` rows."""
    rows = bounded_rows(manga.select("id", "title"), MAX_TITLES, "manga")
    return {
        i: Title(flat, max(WORD.findall(title.lower()), key=len), len(flat) < (3 if CJK.search(flat) else 5))
        for i, title in rows
        if i and title and (flat := squash(title))
    }


def known_titles(titles: dict[str, Title]) -> frozenset[str]:
    """The squashed titles that a line alone is known by."""
    return frozenset(t.flat for t in titles.values() if not t.short)


NUMBER_WORDS = ("chapter", "ch", "volume", "vol", "episode", "ep", "page", "p")
HEADER_BEFORE = re.compile(r"^(?:\d|(?:chapter|ch|volume|vol|episode|ep)(?=\d))++")
NUMBER_MARKS = " \t-–—~·•[](|)<>«»*="
NUMBER_ENDS = "页頁ジ쪽지ivxlc"  # the last characters of page numbers besides digits


def _without_number(flat: str) -> str:
    """A squashed line without one number, and the word before it, at its end."""
    bare = flat.rstrip("0123456789")
    if len(bare) == len(flat):
        return flat
    return next((bare[: -len(w)] for w in NUMBER_WORDS if bare.endswith(w)), bare)


def is_header(line: str, title: Title | None, known: frozenset[str] = frozenset(), most_rest: int = 40) -> bool:
    """Whether a line is a running header: the text's own title, or one of the ``known`` ones (squashed) where the text's
    is not known, with nothing but chapter, number and presenter around it. A title too short to be more than a word
    needs such a number or presenter beside it."""
    if title is not None:
        if title.probe not in line.lower():
            return False
        flat = squash(line)
        at = flat.find(title.flat)
        if at < 0:
            return False
        rest = flat[:at] + flat[at + len(title.flat) :]
        if title.short:
            return 0 < len(rest) <= most_rest and any(c.isdigit() for c in rest) and bool(HEADER_REST.match(rest))
        return len(rest) <= 6 or (len(rest) <= most_rest and bool(HEADER_REST.match(rest) or flat[:at].endswith("presents")))
    if not known or CJK.search(line) or (len(line) > 50 and SENTENCE_END.search(line)):
        return False
    core = HEADER_BEFORE.sub("", squash(line))
    while True:
        if core in known or ("presents" in core and core.partition("presents")[2] in known):
            return True
        shorter = _without_number(core)
        if shorter == core:
            return False
        core = shorter


def is_page_number(line: str) -> bool:
    """Whether a line is a page number and nothing else."""
    core = line.strip(NUMBER_MARKS)
    if len(core) > 24:  # the longest word for a page, two numbers of four digits and what is between them; blanks as one
        if not core[-1].isdigit() or len(core := " ".join(core.split())) > 24:
            return False
    if not core or not (core[-1].isdigit() or core[-1] in NUMBER_ENDS or core[-1].isspace()):
        return False
    return bool(PAGE_NUMBER.match(core)) or bool(ROMAN.match(core))


def body_lines(text: str, title: Title | None, known: frozenset[str] = frozenset()) -> list[str]:
    """The lines without headers and page numbers at the edges of the text."""
    lines = [x for x in BREAKS.split(text) if x.strip()] if "\n" in text or "\r" in text else [text] if text.strip() else []
    while lines and (is_header(lines[0], title, known) or is_page_number(lines[0])):
        lines.pop(0)
    while lines and (is_header(lines[-1], title, known) or (is_page_number(lines[-1]) and _ends(lines[-2:-1]))):
        lines.pop()
    return lines


def _ends(before: list[str]) -> bool:
    return not before or bool(re.search(r"[.!?…。！？\"」』”)]\s*$", before[0]))


def paragraph(lines: list[str], join_cut: bool = True) -> str:
    """Lines put together: no blank between lines of a script that has none. Words that a line end cuts are made whole, or
    keep their hyphen where that is left to evidence (``join_cut=False``)."""
    if len(lines) == 1:
        return lines[0].strip()
    text = "\n".join(lines)
    text = CUT_WORD.sub("", text) if join_cut else CUT_WORD.sub(lambda m: m.group()[0], text)
    parts = LINE_END.split(text)
    out = [parts[0]]
    tail = parts[0]
    for part in parts[1:]:
        tight = tail and part and (CJK.match(tail[-1]) or (tail[-1].isdigit() and CJK.search(tail[-6:]))) and (CJK.match(part[0]) or (part[0].isdigit() and CJK.search(part[:6])))
        out.append("" if tight else " ")
        out.append(part)
        tail = part if len(part) >= 6 else tail[-6:] + ("" if tight else " ") + part
    return "".join(out).strip()
