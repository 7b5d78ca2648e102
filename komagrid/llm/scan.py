"""Noise in text from scanned pages: cut words, misread characters, running headers and page numbers.

Three steps. Counts of words, of three-character windows (scripts without blanks, and Hangul) and of cut words over all
texts. In SQL, rare words meet frequent ones through anagram hashes: the hash of a word is the sum of the fifth
powers of its characters, so a confusion of characters is a fixed difference, and a rare word joins the frequent word
whose hash differs by the confusions it can hold; cut words are judged by whether the joined or the hyphenated
form occurs elsewhere. Then every text is gone through once with these verdicts: edge lines off, words joined, ranked
corrections applied. Up to ``MOST_VERDICTS`` of them are held by each worker; of more, each text is given those that
it can need by a join on their keys, behind a Bloom filter of fixed size. Both ways give the same result.

Defined results: a null, empty or wordless text has no noise but a page number or header; a text made of marks stays
as it is; rows of one region_id with different texts give the noise of each; extra columns are ignored; a hyphen at a
line end stays where nothing says that it cuts a word (compounds, stammering); a word with a digit inside is misread only
if the word it is a misreading of occurs.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from komagrid.llm import codepoints, lines
from komagrid.llm.langid import _table
from komagrid.session import cut, spread

NOISES = ("hyphen_break", "misread", "running_header", "page_number")
P = (1 << 61) - 1
#: How many times as frequent as a misreading its word must be: for letters, and for digits or signs inside a word.
RATIO, RATIO_SIGN = 10, 2
#: How many times as frequent as a misread window its right form must be, and from how many occurrences on this is enough;
#: below, the windows of two characters on both sides must say so too.
RATIO_WINDOW, STEADY, RATIO_FEW = 25, 40, 2
#: Verdicts held by each worker; with more of them, texts meet theirs by join.
MOST_VERDICTS = 400_000
#: Bits of the filter before that join.
FILTER_BITS = 63 << 21
LOCAL_WORDS, LOCAL_TEXTS, MEMO = 500_000, 20_000, 100_000

# What characters are misread as, right and wrong.
CONFUSIONS = (
    "e € n ri o 0 s 5 t f i l h li i | m rn d cl g 9 a 4 u ii c e l 1 t 7 i 1 b 6 w vv g 6 f £ b 8 rn m l | z 2 s $ e c l i f t li h cl d o q y v i ! t + l ! q g 0 o B 8 nn m ri n vv w ii u k lc a o"
    " о 0 и н п л з 3 ы ь1 б 6 ш щ н и л п ч 4 в 8 т г г т е с с е ц ч"
).split()
# The same inside a window of scripts without blanks.
WINDOW_CONFUSIONS = (
    "い り り い ま ほ は ほ ほ ま め ぬ ぬ め さ ち ち さ る ろ ろ る わ れ れ ね ね わ き さ た に け げ が か か が ぎ き く ぐ ぐ く こ ご ご こ さ ざ ざ さ し じ じ し す ず ず す せ ぜ そ ぞ ぞ そ た だ だ た ち ぢ て で で て と ど ど と"
    " ば は ば ぱ ぱ ば は ば び ひ ひ び ぶ ふ ふ ぶ べ へ へ べ ぼ ほ ほ ぼ ソ ン ン ソ シ ツ ツ シ ク ケ ケ ク ク タ タ ク チ テ テ チ ラ ヲ ウ ワ ワ ウ コ ユ ユ コ ナ メ ス ヌ ヌ ス っ つ つ っ ッ ツ ー 一 一 ー"
    " 日 目 目 日 人 入 入 人 我 找 找 我 在 左 左 在 来 束 束 来 未 末 末 未 土 士 士 土 大 太 太 大 大 犬 犬 大 千 干 干 千 问 间 间 问 休 体 体 休 王 玉 玉 王 贝 见 见 贝 天 夫 夫 天 力 刀 刀 力 己 已 已 己 鸟 乌 白 自 自 白 田 由 由 田 午 牛 牛 午"
    " 水 氷 氷 水 木 本 本 木 今 令 令 今 名 各 各 名 待 侍 侍 待 持 待 待 持 石 右 右 石 方 万 万 方 手 毛 毛 手 上 土 土 上 下 不 不 下 兵 丘 向 问 晚 晩 拾 捨 捨 拾 們 門 们 门 门 们 这 込 没 設 老 者 者 老 金 全 全 金 書 昼 鳥 烏 烏 鳥 特 持 持 特 侯 候 候 侯"
).split()
# Vowels of Hangul that are misread as each other.
HANGUL_VOWELS = "ᅡ ᅵ ᅵ ᅡ ᅥ ᅵ ᅵ ᅥ ᅳ ᅮ ᅳ ᅩ ᅮ ᅳ ᅩ ᅮ ᅩ ᅳ ᅮ ᅩ ᅡ ᅣ ᅣ ᅡ ᅥ ᅧ ᅧ ᅥ ᅢ ᅦ ᅦ ᅢ ᅩ ᅭ ᅭ ᅩ ᅡ ᅥ ᅥ ᅡ".split()

STRAY = r"|¦_\\~^=<>{}\[\]`*#£€¬§°"
MARK_ALONE = re.compile(rf"(?<!\S)[{STRAY}]+(?!\S)")
PAIRED = re.compile(r"\[([^\[\]\n]+)\]|\{([^{}\n]+)\}|<([^<>\n]+)>")
MARK_ATTACHED = re.compile(rf"(?<=[^\W_])[.,!?…]?[{STRAY}]+(?=\s|$|[.,!?…])|(?<=[.,!?…。！？])[|¦_\\~^=<>{{}}\[\]`*]+(?=\s|$)|(?<!\S)[|¦_\\~^=<>{{}}\[\]`]+(?=[^\W\d_])")
MARK_CJK = re.compile(r"(?<=[぀-ヿ㐀-鿿。、！？])\s?[|¦_\\~^=<>{}\[\]`*#]+\s?(?=[぀-ヿ㐀-鿿。、！？]|$)")
CUT = re.compile(r"(?<![^\W\d_])([^\W\d_]++)([-‐¬=])(\s*)([^\W\d_]+)")
MARK = re.compile("[-‐¬=]")
AFTER = re.compile(r"[\w£€]*")
EDGE = ".,!?…:;\"'«»¿¡()“”‘’—–-。！？、，・「」『』（）：；" + "|¦_\\~^=<>{}[]`*#•·"
WORDISH = re.compile(r"[a-zà-ɏḀ-ỿа-яё]")
WINDOWED = re.compile(r"[぀-ヿ㐀-鿿가-힣]")
TOKEN = re.compile(r"(?:(?<![0-9€£])[0-9€£]++)?[a-zà-ɏḀ-ỿа-яё][a-zà-ɏḀ-ỿа-яё0-9€£]*(?:['’|$][a-zà-ɏḀ-ỿа-яё0-9€£]+)*")
SUSPECT = re.compile(rf"[{STRAY}0-9$]")
STAMMER = re.compile(r"^([^\W\d_])-(?=\1)")
DIGIT = re.compile(r"\d+")
HANGUL = re.compile(r"[가-힣]")
WORD = re.compile(r"[^\W\d_]")


def anagram(text: str) -> int:
    """The sum of the fifth powers of the characters, of jamo for Hangul."""
    if HANGUL.search(text):
        text = unicodedata.normalize("NFD", text)
    return sum(pow(ord(c), 5, P) for c in text) % P


def confusions() -> list[tuple[str, str, str, int, bool]]:
    """(kind, right, wrong, difference of hashes, whether the wrong form has a digit or sign)."""
    out = []
    for kind, flat in (("w", CONFUSIONS), ("g", WINDOW_CONFUSIONS), ("g", HANGUL_VOWELS)):
        for right, wrong in zip(flat[::2], flat[1::2], strict=True):
            sign = not wrong.isalpha()
            out.append((kind, right, wrong, (sum(pow(ord(c), 5, P) for c in right) - sum(pow(ord(c), 5, P) for c in wrong)) % P, sign))
    return out


def lowered(text: str) -> str:
    """The text in lower case, each character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def tokens(text: str) -> list[str]:
    """Words of scripts with letters (a text in lower case), without the marks around them."""
    return TOKEN.findall(text)


def has_windows(text: str) -> bool:
    return not text.isascii() and WINDOWED.search(text) is not None


def windows(text: str) -> list[str]:
    """Three characters around each of a script without blanks, and of Hangul; numbers are 0, ends a blank."""
    if not has_windows(text):
        return []
    t = " " + DIGIT.sub("0", " ".join(text.split())) + " "
    return [t[i : i + 3] for i in range(len(t) - 2) if "぀" <= t[i + 1] <= "鿿" or "가" <= t[i + 1] <= "힣"]


def edge_lines(text: str, title: lines.Title | None, known: frozenset[str]) -> tuple[list[str], bool, bool]:
    """(other lines, whether there was a header, whether there was a page number) of a text."""
    rest = [x for x in lines.BREAKS.split(text) if x.strip()] if "\n" in text or "\r" in text else [text] if text.strip() else []
    header = number = False
    while rest:
        if lines.is_header(rest[0], title, known):
            header = True
        elif lines.is_page_number(rest[0]) and (len(rest) == 1 or not lines.BARE_NUMBER.match(rest[0]) or header):
            number = True
        else:
            break
        rest.pop(0)
    if len(rest) == 1:  # just looked at
        return rest, header, number
    while rest:
        if lines.is_header(rest[-1], title, known):
            header = True
        elif lines.is_page_number(rest[-1]) and (len(rest) == 1 or lines._ends(rest[-2:-1])):
            number = True
        else:
            break
        rest.pop()
    return rest, header, number


def cuts(body: str) -> list[tuple[str, str, str, str, int, int]]:
    """(left, mark, blank, right, from, to) of every place where a word may be cut."""
    out = []
    if not MARK.search(body):
        return out
    for m in CUT.finditer(body):
        left, mark, blank, right = m.groups()
        if len(left) == 1 and right[:1] == left:  # stammering
            continue
        out.append((left, mark, "1" if blank else "0", right, m.start(), m.end()))
    return out


def _before(body: str, at: int) -> str:
    """What of a word stands right before a place."""
    start = at
    while start and (body[start - 1].isalnum() or body[start - 1] in "_£€"):
        start -= 1
    return body[start:at]


def _fields(regions: DataFrame) -> DataFrame:
    return spread(regions.where("region_id is not null").select(F.col("region_id").cast("bigint"), "manga_id", "text", "translation"))


def count(regions: DataFrame, titles: dict[str, lines.Title]) -> DataFrame:
    """(kind, key, h, n): words (w), their pairs (b), windows (g), hyphenated forms (c), cut words (h) and those joined (j), checkpointed."""
    shared = regions.sparkSession.sparkContext.broadcast(titles)
    names = ["kind", "key", "h", "n"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        title, known = shared.value, lines.known_titles(shared.value)
        seen: dict[str, Counter] = {k: Counter() for k in "wgchbj"}

        def rows() -> Iterator[pa.RecordBatch]:
            for kind, counter in seen.items():
                items = list(counter.items())
                for i in range(0, len(items), 50_000):
                    part = items[i : i + 50_000]
                    if kind == "b":
                        part = [("\t".join(k), n) for k, n in part]
                    yield _table([(kind, k, anagram(k) if kind in "wgj" else None, n) for k, n in part], names, types)
                counter.clear()

        def spread_out() -> None:
            # each distinct text once, however often it came
            for body, n in bodies.items():
                if found := cuts(body):
                    for left, mark, blank, right, a, b in found:
                        seen["h"][f"{left}\t{mark}\t{blank}\t{right}"] += n
                        seen["j"][_before(body, a) + left + right + AFTER.match(body, b).group()] += n
                        if blank == "0":
                            seen["c"][left + "-" + right] += n
                    for *_, a, b in reversed(found):
                        if body[a:b].split() != [body[a:b]]:
                            body = body[:a] + " " + body[b:]
                words = tokens(body)
                followed = zip(words, words[1:], strict=False)
                around = windows(lines.paragraph(body.split("\n"))) if has_windows(body) else ()
                if n == 1:
                    seen["w"].update(words)
                    seen["b"].update(followed)
                    seen["g"].update(around)
                else:
                    for kind, keys in (("w", words), ("b", followed), ("g", around)):
                        counter = seen[kind]
                        for k in keys:
                            counter[k] += n
            bodies.clear()

        bodies: Counter = Counter()
        for batch in batches:
            manga = batch.column(1).to_pylist()
            for column in (2, 3):
                for m, text in zip(manga, codepoints.unify_texts(batch.column(column)), strict=True):
                    if text and (rest := edge_lines(text, title.get(m), known)[0]):
                        bodies[lowered("\n".join(rest))] += 1
            if len(bodies) > LOCAL_TEXTS:
                spread_out()
            if sum(map(len, seen.values())) > LOCAL_WORDS:
                yield from rows()
        spread_out()
        yield from rows()

    part = _fields(regions).mapInArrow(run, "kind string, key string, h bigint, n bigint")
    return cut(part.groupBy("kind", "key").agg(F.first("h").alias("h"), F.sum("n").alias("n")))


def misreadings(counts: DataFrame) -> DataFrame:
    """(key, to): rare words and windows with the most frequent form that they are a misreading of."""
    pairs = confusions()
    entry = lambda x: F.struct(F.lit(x[1]).alias("r"), F.lit(x[2]).alias("w"), F.lit(x[3]).alias("d"), F.lit(x[4]).alias("s"))
    words = F.array(*[entry(x) for x in pairs if x[0] == "w"])
    grams = F.array(*[entry(x) for x in pairs if x[0] == "g" and not "ᄀ" <= x[1] < "ሀ"])
    vowels = F.array(*[entry(x) for x in pairs if x[0] == "g" and "ᄀ" <= x[1] < "ሀ"])
    bigrams = counts.where("kind = 'b'").select(F.split("key", "\t").alias("p"), F.col("n").alias("b")).select(F.col("p")[0].alias("one"), F.col("p")[1].alias("two"), "b")
    # a cut word may be misread as well
    joined = counts.where("kind = 'j'").join(counts.where("kind = 'w'").select("key"), "key", "left_anti").select(F.lit("w").alias("kind"), "key", "h", "n")
    counts = counts.where("kind in ('w', 'g')")
    rare = counts.unionByName(joined).withColumn("middle", F.when(F.col("kind") == "g", F.substring("key", 2, 1)).otherwise(F.col("key")))
    hangul = F.col("middle").rlike("^[가-힣]$")
    holds = (
        F.when(F.col("kind") == "w", F.filter(words, lambda x: F.contains(F.col("key"), x["w"])))
        .when(hangul, vowels)
        .otherwise(F.filter(grams, lambda x: F.col("middle") == x["w"]))
    )
    rare = rare.withColumn("holds", holds).where("size(holds) > 0")
    # one confusion, or two in a word: the differences of their hashes
    one = F.transform("holds", lambda x: F.struct(x["d"].alias("d"), x["s"].alias("s"), (F.length(x["r"]) - F.length(x["w"])).alias("l"), F.lit(1).alias("e")))
    two = F.flatten(
        F.transform("holds", lambda x, i: F.transform(F.slice(F.col("holds"), i + 1, F.size("holds")), lambda y: F.struct(
            F.pmod(x["d"] + y["d"], F.lit(P)).alias("d"), (x["s"] & y["s"]).alias("s"),
            (F.length(x["r"]) - F.length(x["w"]) + F.length(y["r"]) - F.length(y["w"])).alias("l"), F.lit(2).alias("e"),
        )))
    )
    guesses = rare.select("kind", "key", "h", "n", "middle", F.explode(F.when((F.col("kind") == "w") & (F.length("key") >= 5), F.concat(one, two)).otherwise(one)).alias("x"))
    guesses = guesses.select("kind", "key", "n", F.pmod(F.col("h") + F.col("x.d"), F.lit(P)).alias("h"), F.col("x.s").alias("sign"), F.col("x.l").alias("grown"), F.col("x.e").alias("errors"))
    frequent = counts.where("n >= 3").select("kind", "h", F.col("key").alias("to"), F.col("n").alias("to_n"))
    same_place = (F.col("kind") == "w") | ((F.substring("key", 1, 1) == F.substring("to", 1, 1)) & (F.substring("key", 3, 1) == F.substring("to", 3, 1)))
    clean = ~F.col("to").rlike(r"[0-9€£$|]") | (F.col("kind") == "g")
    enough = F.col("to_n") >= F.col("n") * F.when(F.col("kind") == "g", F.lit(RATIO_FEW)).when(F.col("sign"), F.lit(RATIO_SIGN)).when(F.col("errors") == 2, F.lit(2 * RATIO)).otherwise(F.lit(RATIO))
    matched = guesses.join(frequent, ["kind", "h"]).where(
        enough & clean & same_place & (F.col("to") != F.col("key")) & (F.length("to") == F.length("key") + F.col("grown"))
        & (F.levenshtein("key", "to") <= F.when(F.col("kind") == "g", 1).otherwise(2 * F.col("errors"))) & (F.length("to") >= F.when(F.col("kind") == "w", 3).otherwise(3))
    )
    # ranked: the fewest errors, then the most frequent form
    ranked = cut(matched.groupBy("kind", "key").agg(F.max_by(F.struct("to", "n", "to_n", "sign"), F.struct(-F.col("errors"), "to_n", "to")).alias("x")).select("kind", "key", "x.*"))
    sure = ranked.where("sign and kind = 'w'").select("kind", "key", "to").unionByName(_windows_backed(ranked.where("kind = 'g'"), counts))
    # a word of letters only may be one of another language: its neighbours must be those of the frequent word
    doubt = ranked.where("not sign and kind = 'w'")

    def beside(mine: str, other: str) -> DataFrame:
        seen = doubt.join(bigrams.withColumnRenamed(mine, "key"), "key").select("key", "to", "n", F.col(other).alias("near"), "b")
        usual = bigrams.select(F.col(mine).alias("to"), F.col(other).alias("near"), F.col("b").alias("usual"))
        return seen.join(usual, ["to", "near"]).where(F.col("usual") >= 3 * F.col("b")).groupBy("key").agg((F.sum("b") / F.max("n")).alias("share"))

    backed = beside("one", "two").unionByName(beside("two", "one")).where("share >= 0.5").select("key").distinct()
    return sure.unionByName(doubt.join(backed, "key", "left_semi").select("kind", "key", "to"))


def _windows_backed(ranked: DataFrame, counts: DataFrame) -> DataFrame:
    """(kind, key, to) of windows whose right form is frequent enough, by itself or with both of its halves."""
    grams = counts.where("kind = 'g'")
    side = lambda at: grams.groupBy(F.substring("key", at, 2).alias("two")).agg(F.sum("n").alias("m"))
    many = (F.col("to_n") >= STEADY) & (F.col("to_n") >= RATIO_WINDOW * F.col("n"))
    few = ranked.where(~many)
    for at, name in ((1, "left"), (2, "right")):
        halves = side(at)
        for form in ("key", "to"):
            few = few.withColumn("two", F.substring(form, at, 2)).join(halves.withColumnRenamed("m", f"{name}_{form}"), "two").drop("two")
    backed = few.where(F.col("left_to") >= RATIO * F.col("left_key")).where(F.col("right_to") >= RATIO * F.col("right_key"))
    return ranked.where(many).select("kind", "key", "to").unionByName(backed.select("kind", "key", "to"))


def cut_words(counts: DataFrame) -> DataFrame:
    """(kind 'h', key, to): cut words whose joined form is meant, by where joined and hyphenated forms occur.

    Where neither occurs, a line end cuts a word unless both parts are words of their own, as in a compound or a stammer.
    """
    part = lambda i: F.col("p")[i]
    cand = counts.where("kind = 'h'").select("key", F.split("key", "\t").alias("p"))
    cand = cand.select("key", part(0).alias("one"), part(1).alias("mark"), (part(2) == "1").alias("blank"), part(3).alias("two"), F.concat(part(0), part(3)).alias("joined"), F.concat_ws("-", part(0), part(3)).alias("hyphened"))
    words = counts.where("kind = 'w'").select("key", "n")
    hyphened = counts.where("kind = 'c'").select("key", "n")
    for name, among in (("joined", words), ("hyphened", hyphened), ("one", words), ("two", words)):
        cand = cand.join(among.select(F.col("key").alias(name), F.col("n").alias(f"n_{name}")), name, "left")
    j, c, one, two = (F.coalesce(f"n_{x}", F.lit(0)) for x in ("joined", "hyphened", "one", "two"))
    at_line_end = F.when((j == 0) & (c == 0), (one == 0) | (two == 0)).otherwise(j >= c)
    meant = F.col("mark").isin("¬", "=") | F.when(F.col("blank"), at_line_end).otherwise((j >= 3) & (j >= 10 * c))
    return cand.where(meant).select(F.lit("h").alias("kind"), "key", F.col("joined").alias("to"))


class Repairer:
    """Finds and repairs the noise of one text; made once per task."""

    def __init__(self, titles: dict[str, lines.Title], verdicts: dict[str, dict[str, str]]) -> None:
        self.titles, self.known = titles, lines.known_titles(titles)
        self.hold(verdicts)

    def hold(self, verdicts: dict[str, dict[str, str]]) -> None:
        """Judge by these verdicts from now on."""
        self.words, self.windows, self.cuts = (verdicts.get(k, {}) for k in "wgh")
        middles = {k[1:2] for k in self.windows}
        self.middles = re.compile("[" + re.escape("".join(sorted(middles))) + "]") if middles else None
        self.memo: dict[str, tuple[str, ...]] = {}

    def tests(self, text: str, manga: str | None) -> set[tuple[str, str]]:
        """(kind, key) of all verdicts that a unified text can need, whatever they say."""
        body = lowered("\n".join(edge_lines(text, self.titles.get(manga), self.known)[0]))
        out: set[tuple[str, str]] = set()
        bodies = [body]
        if found := cuts(body):
            out.update(("h", f"{left}\t{mark}\t{blank}\t{right}") for left, mark, blank, right, _, _ in found)
            # words and windows of the text as it is, and with each cut word joined
            bodies += [body[:a] + left + right + body[b:] for left, _, _, right, a, b in found]
            whole = body
            for left, _, _, right, a, b in reversed(found):
                whole = whole[:a] + left + right + whole[b:]
            bodies.append(whole)
        for x in bodies:
            out.update(("w", k) for k in tokens(x))
            if WINDOWED.search(x):
                out.update(("g", k) for k in windows(lines.paragraph(x.split("\n"), join_cut=False)))
        return out

    def noise(self, text: str, manga: str | None) -> list[str]:
        """The kinds of noise of a unified text."""
        rest, header, number = edge_lines(text, self.titles.get(manga), self.known)
        out = ["running_header"] if header else []
        if number:
            out.append("page_number")
        body = lowered("\n".join(rest))
        if (got := self.memo.get(body)) is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            got = self.memo[body] = self._inside(body)
        return out + list(got)

    def _inside(self, body: str) -> tuple[str, ...]:
        if not WORD.search(body):
            return ()
        body, hit = self._joined(body, body)
        return (*(("hyphen_break",) if hit else ()), *(("misread",) if self.misread(body) else ()))

    def _joined(self, low: str, body: str) -> tuple[str, bool]:
        """``body`` with its cut words joined where the verdicts say so; ``low`` is the same in lower case."""
        hit = False
        for left, mark, blank, right, a, b in reversed(cuts(low)):
            if f"{left}\t{mark}\t{blank}\t{right}" in self.cuts:
                hit = True
                body = body[: a + len(left)] + body[b - len(right) :]
        return body, hit

    def misread(self, body: str) -> bool:
        if not self.words.keys().isdisjoint(TOKEN.findall(body)):
            return True
        if SUSPECT.search(body):
            if any(c in body for c in "[{<"):
                body = PAIRED.sub(r"\1\2\3", body)
            if MARK_ALONE.search(body) or MARK_ATTACHED.search(body):
                return True
        if has_windows(body):
            whole = lines.paragraph(body.split("\n"), join_cut=False)
            if MARK_CJK.search(whole):
                return True
            if self.middles is not None and self.middles.search(whole):
                return not self.windows.keys().isdisjoint(windows(whole))
        return False

    def repair(self, text: str, manga: str | None) -> str:
        """The text as one paragraph: edge lines off, cut words joined, marks out, misread words put right."""
        rest, _, _ = edge_lines(text, self.titles.get(manga), self.known)
        body = "\n".join(rest)
        if not WORD.search(body):
            return body.strip()
        body = lines.paragraph(self._joined(lowered(body), body)[0].split("\n"), join_cut=False)
        low = lowered(body)
        pieces, end = [], 0
        for m in TOKEN.finditer(low):
            if to := self.words.get(m.group()):
                was = body[m.start() : m.end()]
                pieces += [body[end : m.start()], to.upper() if was.isupper() and len(was) > 1 else to[:1].upper() + to[1:] if was[:1].isupper() else to]
                end = m.end()
        body = "".join([*pieces, body[end:]])
        marks = PAIRED.sub(r"\1\2\3", body) if any(c in body for c in "[{<") else body
        if MARK_ALONE.search(marks) or MARK_ATTACHED.search(marks) or MARK_CJK.search(marks):
            body = MARK_CJK.sub("", MARK_ALONE.sub(" ", MARK_ATTACHED.sub(lambda m: m.group()[0] if m.group()[0] in ".,!?…" else "", body)))
        body = " ".join(body.split())
        if self.windows and WINDOWED.search(body):
            chars = list(body)
            for i, c in enumerate(chars):
                if WINDOWED.match(c):
                    around = (("0" if chars[i - 1].isdigit() else chars[i - 1]) if i else " ") + c + (("0" if chars[i + 1].isdigit() else chars[i + 1]) if i + 1 < len(chars) else " ")
                    if to := self.windows.get(lowered(around)):
                        chars[i] = to[1]
            body = "".join(chars)
        return body


def _verdicts(regions: DataFrame, titles: dict[str, lines.Title]) -> tuple[DataFrame, dict[str, dict[str, str]] | None]:
    """All verdicts, checkpointed, and the same as dictionaries if they are few enough for each worker to hold."""
    counts = count(regions, titles)
    found = cut(misreadings(counts).unionByName(cut_words(counts).select("kind", "key", "to")))
    if found.count() > MOST_VERDICTS:
        return found, None
    held: dict[str, dict[str, str]] = {}
    rows = found.toArrow()
    for kind, key, to in zip(*(rows.column(c).to_pylist() for c in ("kind", "key", "to")), strict=True):
        held.setdefault(kind, {})[key] = to
    return found, held


def _with_own_verdicts(rows: DataFrame, found: DataFrame, titles: dict[str, lines.Title]) -> DataFrame:
    """``rows`` with ``held``: for each text the verdicts that it can need, by a join on their keys."""
    context = rows.sparkSession.sparkContext
    place = F.pmod(F.xxhash64(F.concat("kind", F.lit("\t"), "key")), F.lit(FILTER_BITS))
    bits = found.select(place.alias("p")).groupBy((F.col("p") / 63).cast("int").alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 63 as int))")).alias("bits")).toArrow()
    filter_ = np.zeros(FILTER_BITS // 63, np.int64)  # its size does not depend on the verdicts
    filter_[bits.column("slot").to_numpy()] = bits.column("bits").to_numpy()
    shared = context.broadcast((titles, filter_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer, maybe = Repairer(shared.value[0], {}), shared.value[1]

        def passes(kind: str, key: str) -> bool:
            h = xxhash.xxh64_intdigest(f"{kind}\t{key}", seed=42)
            at = (h - (1 << 64) if h >= 1 << 63 else h) % FILTER_BITS
            return bool(int(maybe[at // 63]) >> (at % 63) & 1)

        for batch in batches:
            row_keys, manga = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for column in (2, 3):
                for row, m, text in zip(row_keys, manga, codepoints.unify_texts(batch.column(column)), strict=True):
                    if text:
                        out += [(row, *x) for x in repairer.tests(text, m) if passes(*x)]
            yield _table(out, ["row", "kind", "key"], [pa.int64(), pa.string(), pa.string()])

    keyed = rows.withColumn("row", F.xxhash64("region_id", "manga_id", "text", "translation"))
    tests = keyed.select("row", "manga_id", "text", "translation").mapInArrow(run, "row bigint, kind string, key string")
    own = tests.join(found, ["kind", "key"]).groupBy("row").agg(F.collect_set(F.struct("kind", "key", "to")).alias("held"))
    return keyed.join(own, "row", "left").select("region_id", "manga_id", "text", "translation", "held")


def _judged(regions: DataFrame, titles: dict[str, lines.Title], each: Callable[[Repairer, list, list, list[list]], pa.RecordBatch], schema: str) -> DataFrame:
    """``each`` over batches of all regions: (repairer, ids, manga, [texts, translations]), a null as None."""
    found, held = _verdicts(regions, titles)
    rows = _fields(regions)
    if held is None:
        rows = _with_own_verdicts(rows, found, titles)
    shared = regions.sparkSession.sparkContext.broadcast((titles, held or {}))
    own = held is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(*shared.value)
        for batch in batches:
            ids, manga = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = []
            for column in (2, 3):
                null = batch.column(column).is_null().to_pylist()
                texts.append([None if n else t for n, t in zip(null, codepoints.unify_texts(batch.column(column)), strict=True)])
            if not own:
                yield each(repairer, ids, manga, texts)
                continue
            for i, verdicts in enumerate(batch.column(4).to_pylist()):
                mine: dict[str, dict[str, str]] = {}
                for v in verdicts or ():
                    mine.setdefault(v["kind"], {})[v["key"]] = v["to"]
                repairer.hold(mine)
                yield each(repairer, ids[i : i + 1], manga[i : i + 1], [x[i : i + 1] for x in texts])

    return rows.mapInArrow(run, schema)


def find(regions: DataFrame, titles: dict[str, lines.Title]) -> DataFrame:
    """(region_id, field, noise), distinct."""

    def each(repairer: Repairer, ids: list, manga: list, texts: list[list]) -> pa.RecordBatch:
        rows = [(i, field, noise) for field, column in zip(("text", "translation"), texts, strict=True) for i, m, text in zip(ids, manga, column, strict=True) if text for noise in repairer.noise(text, m)]
        return _table(rows, ["region_id", "field", "noise"], [pa.int64(), pa.string(), pa.string()])

    return _judged(regions, titles, each, "region_id bigint, field string, noise string").distinct()


def repaired(regions: DataFrame, titles: dict[str, lines.Title]) -> DataFrame:
    """(region_id, text, translation) with both fields as continuous readable paragraphs; a null stays null."""

    def each(repairer: Repairer, ids: list, manga: list, texts: list[list]) -> pa.RecordBatch:
        done = [[None if t is None else repairer.repair(t, m) for m, t in zip(manga, column, strict=True)] for column in texts]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, pa.string()) for x in done)], names=["region_id", "text", "translation"])

    return _judged(regions, titles, each, "region_id bigint, text string, translation string")
