"""Visually identical text with different characters: one consistent form, vectorised over Arrow batches.

A batch of strings becomes one numpy array of code points; everything after that is gathers from
lookup tables, offset arithmetic and pairwise composition over the whole batch. No string is handled alone.

Defined results: a null stays null and has no form; an empty text stays empty; marks without a composed
character stay as they are; rows keep their order, number and extra columns.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMS = ("width", "combining", "invisible", "space", "lookalike")
WIDTH, COMBINING, INVISIBLE, SPACE, LOOKALIKE = (1 << i for i in range(5))

TOP = 0x110000

# Zero-width characters.
ZERO_WIDTH = (0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F,
              0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0xFEFF)

# Letters of Cyrillic and Greek that are drawn like Latin ones.
CYRILLIC_LATIN = dict(zip("АВЕКМНОРСТУХЅІЈаеорсухѕіјһԁԛԝ", "ABEKMHOPCTYXSIJaeopcyxsijhdqw", strict=True))
GREEK_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναρικυχγ", "ABEZHIKMNOPTYXovapikuxy", strict=True))
# Ideographs that are drawn like katakana.
HAN_KATAKANA = dict(zip("力卜八口工夕二千才一匕", "カトハロエタニチオーヒ", strict=True))
# Katakana words that follow a number written as an ideograph.
KATAKANA_COUNTERS = ("ページ", "カ", "ヶ", "ヵ", "キロ", "メートル", "センチ", "グラム", "トン", "パーセント", "ドル", "ユーロ", "ポイント",
                     "シーズン", "セット", "チーム", "クラス", "コマ", "ヘクタール", "リットル", "ミリ", "ラウンド", "ケース")

LATIN, CYRILLIC, GREEK, KATAKANA, HIRAGANA, HAN, HANGUL = (1 << i for i in range(7))
MARK, LETTER, DIGIT = 1 << 7, 1 << 8, 1 << 9
L_JAMO, V_JAMO, T_JAMO = 1 << 10, 1 << 11, 1 << 12
DISTINCT = 1 << 13  # a letter that no other script has in the same shape
SPECIAL, EXPANDS, JOINS, ALIKE, KANA_ALIKE = (1 << i for i in range(5))


@lru_cache(maxsize=1)
def tables() -> dict[str, np.ndarray]:
    """The lookup tables, built from the Unicode database once per process."""
    kind = np.zeros(TOP, np.uint16)
    for start, end, flag in (
        (0x41, 0x250, LATIN), (0x1E00, 0x1F00, LATIN), (0x2C60, 0x2C80, LATIN), (0xA720, 0xA800, LATIN),
        (0x370, 0x400, GREEK), (0x1F00, 0x2000, GREEK), (0x400, 0x530, CYRILLIC), (0x1C80, 0x1C90, CYRILLIC),
        (0x30A1, 0x30FB, KATAKANA), (0x30FC, 0x3100, KATAKANA), (0x31F0, 0x3200, KATAKANA), (0x3041, 0x3097, HIRAGANA),
        (0x3400, 0x4DC0, HAN), (0x4E00, 0xA000, HAN), (0xF900, 0xFB00, HAN), (0x20000, 0x32000, HAN),
        (0x3005, 0x3008, HAN), (0xAC00, 0xD7A4, HANGUL), (0x1100, 0x1200, HANGUL),
    ):
        kind[start:end] |= flag
    plain = np.zeros(TOP, np.uint32)
    plain[:] = np.arange(TOP, dtype=np.uint32)
    width = np.zeros(TOP, bool)
    marks, ccc = [], np.zeros(TOP, np.uint8)
    for cp in range(0x30000):
        if 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7A4 or 0x17000 <= cp < 0x1B000:
            if 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7A4:
                kind[cp] |= LETTER
            continue
        category = unicodedata.category(chr(cp))
        if category[0] == "L":
            kind[cp] |= LETTER
        elif category == "Nd":
            kind[cp] |= DIGIT
        elif category in ("Mn", "Mc"):
            kind[cp] |= MARK
            marks.append(cp)
            ccc[cp] = unicodedata.combining(chr(cp))
        if not kind[cp] & LETTER:
            kind[cp] &= ~np.uint16(LATIN | GREEK | CYRILLIC)
    kind[0x20000:0x32000] |= LETTER
    for start, end in ((0xFF10, 0xFF1A), (0xFF21, 0xFF3B), (0xFF41, 0xFF5B)):
        plain[start:end] = np.arange(start - 0xFEE0, end - 0xFEE0)
        width[start:end] = True
    for cp in (*range(0xFF66, 0xFF9E), *range(0xFFA1, 0xFFDD)):
        if len(mapped := unicodedata.normalize("NFKC", chr(cp))) == 1 and mapped != chr(cp):
            plain[cp] = ord(mapped)
            width[cp] = True
    plain[0xFF9E], plain[0xFF9F] = 0x3099, 0x309A
    width[[0xFF9E, 0xFF9F]] = True
    invisible = np.zeros(TOP, bool)
    invisible[list(ZERO_WIDTH)] = True
    space = np.zeros(TOP, bool)
    for cp in range(0xA0, 0x3001):
        space[cp] = unicodedata.category(chr(cp)) == "Zs"
    plain[space] = 0x20
    kind[0x1100:0x1113] |= L_JAMO
    kind[0x1161:0x1176] |= V_JAMO
    kind[0x11A8:0x11C3] |= T_JAMO
    pairs, composed = [], []
    for cp in range(0xA0, 0x1D200):
        if 0x3400 <= cp < 0xFB00 and not 0xF900 <= cp:
            continue
        parts = unicodedata.decomposition(chr(cp)).split()
        if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
            pairs.append(int(parts[0], 16) << 21 | int(parts[1], 16))
            composed.append(cp)
    order = np.argsort(np.array(pairs, np.int64))
    expand = {0xFB00: "ff", 0xFB01: "fi", 0xFB02: "fl", 0xFB03: "ffi", 0xFB04: "ffl", 0xFB05: "st", 0xFB06: "st"}
    extra = np.zeros(TOP, np.int64)
    for cp, to in expand.items():
        extra[cp] = len(to) - 1
    to_latin, to_cyrillic, to_greek = (np.zeros(TOP, np.uint32) for _ in range(3))
    for a, b in CYRILLIC_LATIN.items():
        to_latin[ord(a)] = ord(b)
        to_cyrillic[ord(b)] = ord(a)
    for a, b in GREEK_LATIN.items():
        to_latin[ord(a)] = ord(b)
        to_greek[ord(b)] = ord(a)
    for a, b in CYRILLIC_LATIN.items():
        if to_greek[ord(b)]:
            to_greek[ord(a)] = to_greek[ord(b)]
            to_cyrillic[to_greek[ord(b)]] = ord(a)
    alike = to_latin.astype(bool) | to_cyrillic.astype(bool) | to_greek.astype(bool)
    kind[((kind & (LATIN | CYRILLIC | GREEK)) > 0) & ~alike] |= DISTINCT
    to_katakana, to_han = np.zeros(TOP, np.uint32), np.zeros(TOP, np.uint32)
    for a, b in HAN_KATAKANA.items():
        to_katakana[ord(a)] = ord(b)
        to_han[ord(b)] = ord(a)
    # one byte per code point says which steps a batch needs at all
    flags = (width | invisible | space).astype(np.uint8) * SPECIAL
    flags |= (extra > 0).astype(np.uint8) * EXPANDS
    flags |= ((kind & (MARK | V_JAMO | T_JAMO)) > 0).astype(np.uint8) * JOINS
    flags |= (((kind & (CYRILLIC | GREEK)) > 0) | (to_katakana > 0)).astype(np.uint8) * ALIKE
    flags |= (to_han > 0).astype(np.uint8) * KANA_ALIKE
    return {
        "kind": kind, "plain": plain, "width": width, "invisible": invisible, "space": space, "ccc": ccc,
        "pairs": np.array(pairs, np.int64)[order], "composed": np.array(composed, np.uint32)[order],
        "extra": extra, "expand": expand, "to_latin": to_latin, "to_cyrillic": to_cyrillic, "to_greek": to_greek,
        "to_katakana": to_katakana, "to_han": to_han, "flags": flags,
    }


def codepoints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts of an Arrow string array, and where each text begins (one more than texts)."""
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=begins[1:])
    return points, begins[offsets - offsets[0]]


def strings(points: np.ndarray, begins: np.ndarray, nulls: np.ndarray | None = None) -> pa.Array:
    """The Arrow strings of code points, with the same whole-batch conversion backwards."""
    data = points.astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8")
    sizes = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    at = np.zeros(len(points) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    large = pa.Array.from_buffers(pa.large_string(), len(begins) - 1, [None, pa.py_buffer(at[begins].tobytes()), pa.py_buffer(data)])
    out = large.cast(pa.string())
    if nulls is not None and nulls.any():
        import pyarrow.compute as pc

        out = pc.if_else(pa.array(~nulls), out, pa.scalar(None, pa.string()))
    return out


def _keep(mask: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where texts begin once only the masked code points stay."""
    at = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=at[1:])
    return at[begins]


def _flag(forms: np.ndarray, hits: np.ndarray, begins: np.ndarray, flag: int) -> None:
    """Set ``flag`` on the texts that hold a hit."""
    if hits.any():
        at = np.zeros(len(hits) + 1, np.int64)
        np.cumsum(hits, out=at[1:])
        forms[(at[begins[1:]] - at[begins[:-1]]) > 0] |= flag


def _compose(points: np.ndarray, begins: np.ndarray, was_mark: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Put marks and jamo together with their base until nothing composes any more."""
    t = tables()
    kind, ccc = t["kind"], t["ccc"]
    if not ((kind[points] & (MARK | V_JAMO | T_JAMO)) > 0).any():
        return points, begins
    # a composed character before a mark is taken apart first, or marks of a lower class could not pass its own
    joined = np.flatnonzero((kind[points[1:]] & MARK) > 0)
    apart = {int(c): d for c in np.unique(points[joined]) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and not 0xAC00 <= c < 0xD7A4}
    if apart:
        extra = np.zeros(len(points), np.int64)
        # one gather for each distinct character, however often it stands
        places = {c: joined[points[joined] == c] for c in apart}
        for c, d in apart.items():
            extra[places[c]] = len(d) - 1
        at = np.zeros(len(points) + 1, np.int64)
        np.cumsum(1 + extra, out=at[1:])
        wide, was_mark = np.repeat(points, 1 + extra), np.repeat(was_mark, 1 + extra)
        for c, d in apart.items():
            for i, x in enumerate(d):
                wide[at[places[c]] + i] = ord(x)
        points, begins = wide, at[begins]
    # canonical order: the marks behind a starter (or a text's start) by their class, equal ones as they stand
    c = ccc[points]
    starts = c == 0
    starts[begins[begins < len(points)]] = True
    if ((c[:-1] > c[1:]) & ~starts[1:]).any():
        order = np.argsort(np.cumsum(starts) * 256 + c, kind="stable")
        points, was_mark = points[order], was_mark[order]
    while len(points) > 1:
        # each mark meets the starter before it unless a mark of its own class stands between
        k, c, here = kind[points], ccc[points], np.arange(len(points))
        text_start = np.zeros(len(points), bool)
        text_start[begins[begins < len(points)]] = True
        starter = np.maximum.accumulate(np.where((c == 0) | text_start, here, 0))
        right = here[1:][~text_start[1:] & ((k[1:] & (MARK | V_JAMO | T_JAMO)) > 0)]
        base = starter[right - 1]
        open_ = (base == right - 1) | ((c[right] > 0) & (c[right - 1] < c[right]))
        right, base = right[open_ & (c[base] == 0)], base[open_ & (c[base] == 0)]
        if not len(right):
            break
        first, second = points[base], points[right]
        out = np.zeros(len(right), np.uint32)
        jamo = ((k[base] & L_JAMO) > 0) & ((k[right] & V_JAMO) > 0)
        out[jamo] = 0xAC00 + ((first[jamo] - 0x1100) * 21 + (second[jamo] - 0x1161)) * 28
        lv = ((k[right] & T_JAMO) > 0) & (first >= 0xAC00) & (first < 0xD7A4)
        lv[lv] = (first[lv] - 0xAC00) % 28 == 0
        out[lv] = first[lv] + second[lv] - 0x11A7
        keys = first.astype(np.int64) << 21 | second
        found = np.minimum(np.searchsorted(t["pairs"], keys), len(t["pairs"]) - 1)
        pair = t["pairs"][found] == keys
        out[pair] = t["composed"][found[pair]]
        right, base, out = right[out > 0], base[out > 0], out[out > 0]
        if not len(right):
            break
        # of a starter's marks the first, and no starter that is itself joined in this pass
        one = np.r_[True, base[1:] != base[:-1]] & ~np.isin(base, right)
        right, base, out = right[one], base[one], out[one]
        flags = np.zeros(len(points), bool)
        flags[right] = was_mark[right]
        _flag(forms, flags, begins, COMBINING)
        points[base] = out
        stay = np.ones(len(points), bool)
        stay[right] = False
        begins = _keep(stay, begins)
        points, was_mark = points[stay], was_mark[stay]
    return points, begins


def _beside(k: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kinds of the code points before and after each, 0 at a text's ends."""
    prev, nxt = np.r_[np.uint16(0), k[:-1]], np.r_[k[1:], np.uint16(0)]
    prev[begins[:-1][begins[:-1] < len(k)]] = 0
    ends = begins[1:] - 1
    nxt[ends[ends >= 0]] = 0
    return prev, nxt


def _lookalikes(points: np.ndarray, begins: np.ndarray, forms: np.ndarray) -> np.ndarray:
    """Replace letters of another script inside words, judged by the letters that only one script has."""
    t = tables()
    k = t["kind"][points]
    row_of = None
    hits = np.zeros(len(points), bool)
    foreign = (k & (CYRILLIC | GREEK)) > 0
    if foreign.any():
        # only texts with such a letter are looked at
        row_of = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
        rows = np.zeros(len(begins) - 1, bool)
        rows[row_of[foreign]] = True
        part = np.flatnonzero(rows[row_of])
        p, kk, r = points[part], k[part], row_of[part]
        letter = (kk & (LETTER | MARK)) > 0
        starts = np.flatnonzero(letter & np.r_[True, ~letter[:-1] | (r[1:] != r[:-1])])
        word = np.cumsum(np.isin(np.arange(len(p)), starts)) - 1
        n = len(starts)
        scripts = (LATIN, CYRILLIC, GREEK)
        count = np.zeros((3, n), np.int64)
        own = np.zeros((3, n), np.int64)
        text_own = np.zeros((3, len(begins) - 1), np.int64)
        text_all = np.zeros((3, len(begins) - 1), np.int64)
        for i, s in enumerate(scripts):
            is_s = letter & ((kk & s) > 0)
            is_own = is_s & ((kk & DISTINCT) > 0)
            count[i] = np.bincount(word[is_s], minlength=n)
            own[i] = np.bincount(word[is_own], minlength=n)
            text_own[i] = np.bincount(r[is_own], minlength=len(begins) - 1)
            text_all[i] = np.bincount(r[is_s], minlength=len(begins) - 1)
        if n:
            wr = r[starts]
            # order of evidence: letters only this script has, all letters of the word, those of the text
            score = own * 1_000_000 + np.minimum(count, 999) * 1_000 + np.minimum(text_own[:, wr], 999)
            lone = own.sum(0) == 0
            score[:, lone] = (text_own[:, wr] * 1_000_000 + text_all[:, wr] * 1_000 + count)[:, lone]
            best = score.argmax(0)
            # a word all of whose letters are drawn alike belongs to the text's script only if the text has no sign of its own
            for i, to in enumerate((t["to_latin"], t["to_cyrillic"], t["to_greek"])):
                other = letter & ((kk & (LATIN | CYRILLIC | GREEK)) > 0) & ((kk & scripts[i]) == 0) & (best[word] == i) & (to[p] > 0)
                own_script = np.select([(kk & LATIN) > 0, (kk & CYRILLIC) > 0], [0, 1], 2)
                mixed = count[i][word] > 0
                stray = ~mixed & (text_own[own_script, r] == 0) & lone[word]
                other &= mixed | stray
                points[part[other]] = to[p[other]]
                hits[part[other]] = True
    han = t["to_katakana"][points] > 0
    if han.any():
        prev, nxt = _beside(k, begins)
        before, after = (prev & KATAKANA) > 0, (nxt & KATAKANA) > 0
        prev_han, next_han = (prev & HAN) > 0, (nxt & HAN) > 0
        numeral = np.isin(points, np.array([ord(c) for c in "一二八千"], np.uint32))
        swap = han & ((before & after) | (before & ~next_han & ~numeral) | (after & ~prev_han & ~numeral))
        eight = han & (points == ord("八")) & ((before & ~next_han) | (after & ~prev_han & ~before))
        rest = np.flatnonzero(eight & ~swap)
        if len(rest):
            until = np.repeat(begins[1:], np.diff(begins))[rest]
            counted = np.zeros(len(rest), bool)
            for word in KATAKANA_COUNTERS:
                same = rest + len(word) < until  # within the text
                for j, c in enumerate(word, 1):
                    same &= points[np.minimum(rest + j, len(points) - 1)] == ord(c)
                counted |= same
            swap[rest[before[rest] | ~counted]] = True
        points[swap] = t["to_katakana"][points[swap]]
        hits |= swap
    kata = (t["to_han"][points] > 0) & ((k & KATAKANA) > 0)
    if kata.any():
        if row_of is None:
            row_of = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
        kana = np.bincount(row_of[((k & (HIRAGANA | KATAKANA)) > 0) & ~kata], minlength=len(begins) - 1)
        prev, nxt = _beside(k, begins)
        swap = kata & (kana[row_of] == 0) & ((prev & HAN) > 0) & ((nxt & HAN) > 0) & ~hits
        points[swap] = t["to_han"][points[swap]]
        hits |= swap
    _flag(forms, hits, begins, LOOKALIKE)
    return points


def unify(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points in the one form, where texts begin, forms found in each text as bits)."""
    t = tables()
    points, begins = codepoints(texts)
    forms = np.zeros(len(texts), np.uint8)
    points = points.copy()
    if not len(points):
        return points, begins, forms
    steps = int(np.bitwise_or.reduce(t["flags"][points]))
    if not steps:
        return points, begins, forms
    was_mark = (t["kind"][points] & (MARK | V_JAMO | T_JAMO)) > 0 if steps & JOINS else np.zeros(len(points), bool)
    if steps & SPECIAL:
        _flag(forms, t["width"][points], begins, WIDTH)
        _flag(forms, t["space"][points], begins, SPACE)
        gone = t["invisible"][points]
        if gone.any():
            _flag(forms, gone, begins, INVISIBLE)
            begins = _keep(~gone, begins)
            points, was_mark = points[~gone], was_mark[~gone]
        points = t["plain"][points]
    if steps & EXPANDS:
        extra = t["extra"][points]
        at = np.zeros(len(points) + 1, np.int64)
        np.cumsum(1 + extra, out=at[1:])
        wide = np.repeat(points, 1 + extra)
        was_mark = np.repeat(was_mark, 1 + extra)
        for cp, to in t["expand"].items():
            where = at[:-1][points == cp]
            for i, c in enumerate(to):
                wide[where + i] = ord(c)
        points, begins = wide, at[begins]
    if steps & (JOINS | SPECIAL):
        points, begins = _compose(points, begins, was_mark, forms)
    if steps & (ALIKE | KANA_ALIKE):
        points = _lookalikes(points, begins, forms)
    return points, begins, forms


def _strs(points: np.ndarray, begins: np.ndarray) -> list[str]:
    whole = points.astype("<u4", copy=False).tobytes().decode("utf-32-le", "replace")
    at = begins.tolist()
    return [whole[a:b] for a, b in zip(at, at[1:], strict=False)]


def unify_texts(texts: pa.Array) -> list[str]:
    """The texts in the one form as Python strings ('' for null), for operators that go on in Python."""
    points, begins = codepoints(texts)
    out = _strs(points, begins)
    # a text without a code point that some step looks for stays as it is
    hits = np.flatnonzero(tables()["flags"][points[: begins[-1]]])
    if len(hits):
        some = np.unique(np.searchsorted(begins, hits, "right") - 1)
        points, begins, _ = unify(texts.take(pa.array(some)))
        for i, text in zip(some.tolist(), _strs(points, begins), strict=True):
            out[i] = text
    return out


def with_unified(df: DataFrame, column: str, unified: str | None = "unified", forms: str = "forms") -> DataFrame:
    """``df`` with its text column in the one form and the forms it had (bits of ``FORMS``).

    ``unified=None`` leaves the text out when only the forms are asked for. New columns must not exist yet.
    """
    added = [x for x in (unified, forms) if x]
    if clash := [x for x in added if x in df.columns]:
        raise ValueError(f"columns already there: {clash}")
    schema = T.StructType([*df.schema.fields, *(T.StructField(x, T.StringType() if x == unified else T.IntegerType()) for x in added)])
    place = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place)
            points, begins, found = unify(texts)
            out = list(batch.columns)
            if unified:
                out.append(strings(points, begins, np.asarray(texts.is_null())))
            out.append(pa.array(found.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names, *added])

    return df.mapInArrow(run, schema)


def unified_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the text columns named in the one form, in one pass; a null stays null."""
    places = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(batch.columns)
            for i in places:
                points, begins, _ = unify(out[i])
                out[i] = strings(points, begins, np.asarray(out[i].is_null()))
            yield pa.RecordBatch.from_arrays(out, names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def forms_found(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """One distinct row (keys, form) for each form in the texts of each key."""
    flagged = with_unified(df.select(*keys, column), column, unified=None, forms="forms").where("forms > 0")
    names = F.array(*[F.when(F.col("forms").bitwiseAND(1 << i) > 0, F.lit(name)) for i, name in enumerate(FORMS)])
    return flagged.select(*keys, F.explode(F.array_compact(names)).alias("form")).distinct()
