"""Template residue and error-page text.

Slots are induced by alignment: delimited tokens are taken out of the texts with the words around them. A token is a slot
that kept its variable name, default or blank if its delimiters have no other use, if the same name stands elsewhere
in such delimiters, or if records of the same surroundings hold different names there. Error pages and script notices
are lines that open the way such pages do, or, whatever their wording, lines whose masked form stands alone as whole
pages and whose windows of words occur in no other line: prose that repeats shares its windows with lines that hold other
names or neighbours. Phrases name the kind of such a page. Stand-in prose is known by its phrases, by a vocabulary grown
from its seed words over the whole corpus, and by letters that stand together in no language (keys struck at random).
A line that speaks of such things inside a story neither opens so nor stands alone.

Defined results: a null or empty text is no case; a document has one kind, the first of error_page, script_notice,
placeholder, filler; repeated rows of a document count once; texts are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from komagrid.llm import lang
from komagrid.session import cut, spread

KINDS = ("error_page", "script_notice", "placeholder", "filler")

NAME = r"[A-Za-z][A-Za-z0-9_. -]{0,40}?"
# Delimiters that text does not use otherwise.
SURE_SLOTS = (
    r"\{\{\s*" + NAME + r"\s*\}\}", r"\$\{\s*" + NAME + r"\s*\}", r"#\{\s*" + NAME + r"\s*\}", r"%\(\s*" + NAME + r"\s*\)[sd]", r"<%=?\s*" + NAME + r"\s*%>",
    r"\[\[\s*" + NAME + r"\s*\]\]", r"@@\s*" + NAME + r"\s*@@", r"__[A-Z][A-Z0-9_]{1,30}__", r"%[A-Z][A-Z0-9_]{1,30}%", r"\{%\s*" + NAME + r"\s*%\}",
    r"\[(?:INSERT|ENTER|ADD|Insert|Enter|Add|insert) [^\[\]\n]{1,40}\]", r"[\[<{(](?:Your|YOUR|your) [^\[\]\n<>{}()]{1,30}[\]>})]", r"\[(?:TBD|TBA|TODO|PLACEHOLDER|TITLE|NAME|DATE)\]",
)
MAYBE_SLOTS = (r"\{[A-Za-z][A-Za-z0-9_.]{1,30}\}", r"<[A-Za-z][A-Za-z0-9_.]{1,30}>", r"\[[a-z]+(?:[_.][a-z]+)+\]", r"(?<![\w_])_{4,}(?![\w_])", r"\[\s{1,12}\]")
SLOT = re.compile("|".join((*SURE_SLOTS, *MAYBE_SLOTS)))
SURE = re.compile("^(?:" + "|".join(SURE_SLOTS) + ")$")
SLOT_SIGNS = ("{", "%", "[", "<", "@@", "__", "(")

# How script notices speak, in the languages of the corpus.
SCRIPT_WORDS = r"javascript|java script|ジャバスクリプト|자바스크립트|джаваскрипт|\bscripts? (?:and cookies )?(?:to be |must be |has to be |need to be )?(?:turned on|allowed|enabled|on\b)|\b(?:allow|enable|block) (?:scripts?|them)\b|<noscript"
SCRIPT_ASK = (
    r"enabl|turn(?:ed)? (?:it )?on|allow|disabled|require|need|bật|activ|habilit|ative|aktivier|abilita|aktifkan|nyalakan|включ|有効|启用|開啟|打开|켜|active[rz]|atver"
)
# How error pages open, in the languages of the corpus.
ERROR_WORD = r"(?:error|http error|fehler|erreur|errore|erro|error de servidor|lỗi|galat|kesalahan|ошибка|エラー|错误|錯誤|오류|에러)"
ERROR_OPENINGS = (
    rf"^{ERROR_WORD}\s*:?\s*[1-5]\d\d\b", rf"^{ERROR_WORD}\s*[:：]\s*\S",
    r"^http(?:/[\d.]+)?\s*[45]\d\d\b", r"^(?:http\s*)?[45]\d\d[ :：\-–—]+(?:not found|forbidden|bad gateway|bad request|internal server|service|gateway|unauthorized|gone|too many|server error|error|page|access|payment|method|request|proxy|conflict|length|precondition|unavailable|temporarily)",
    r"^(?:the )?(?:service|server|site|website|page|servizio|servicio|serviço|service|dienst|der dienst|layanan|dịch vụ|сервис|сайт|сервер|сервис)\b[^.!?\n]{0,30}?\b(?:temporarily|unavailable|not available|indisponible|no disponible|non disponibile|indisponível|nicht verfügbar|nicht erreichbar|tidak tersedia|không khả dụng|недоступен|недоступна|under maintenance|down for|is down|overloaded|busy|timed out)",
    r"^(?:access denied|forbidden|permission denied|too many requests|bad gateway|gateway time|internal server error|page not found|not found|request timed? ?out|connection (?:timed|reset|refused)|this page (?:isn'?t (?:available|working)|has wandered|can(?:'|no)t be (?:reached|found|displayed|loaded)|could not be|does(?:n't| not) exist|no longer exists)|the page you (?:requested|are looking|were looking)|the requested (?:url|page)|oops[!.,][^\n]{0,30}\b(?:page|site|error|went wrong)\b|sorry, (?:the|this) page|we can(?:'|no)t find (?:the|that) page|rate limit|something went wrong|an (?:unexpected |internal )?error (?:has )?occurred|página no encontrada|pagina non trovata|page introuvable|seite nicht gefunden|página não encontrada|halaman tidak ditemukan|không tìm thấy trang|страница не найдена|доступ запрещ|acceso denegado|accès refusé|zugriff verweigert|accesso negato|acesso negado|akses ditolak|truy cập bị từ chối)",
    r"^(?:máy chủ|server (?:sedang|đang)|sunucu|der server|le serveur|il server|el servidor|o servidor|сервер)\b[^\n]{0,60}(?:bảo trì|pemeliharaan|sibuk|wartung|überlastet|maintenance|manutenzione|mantenimiento|manutenção|обслуживани|перегруж|lại sau|later|später|lagi nanti|plus tard|più tardi|más tarde|mais tarde|позже)",
    r"^(?:ただいま)?サーバー[^\n]{0,40}(?:混み合|メンテナンス|エラー|応答)", r"^お探しのページ", r"^(?:ただいま)?メンテナンス中", r"^アクセス(?:が)?(?:拒否|できません)", r"^ページが(?:見つかりません|表示できません)",
    r"^服务器[^\n]{0,30}(?:忙|维护|错误|稍后|无响应)", r"^(?:您|你)(?:访问|请求|要找)的(?:页面|网页)", r"^(?:访问被拒绝|页面不存在|网站正在维护|系统维护|服务暂时不可用|服务不可用|请求过多)",
    r"^서버[^\n]{0,30}(?:점검|오류|응답|혼잡)", r"^(?:요청하신|찾으시는) 페이지", r"^(?:접근이 거부|접속이 거부|페이지를 찾을 수 없|서비스(?:를|가)? ?(?:일시|이용))", r"^(?:Сервис|Сайт|Страница)[^\n]{0,30}(?:недоступ|не найден|обслуживани)",
)
# Stand-in phrases.
FILLER_LINES = (
    r"^(?:your |the |some |a |my )?(?:[^\W\d_]|[' ]){1,30} (?:goes|go|comes|will go|to go) here\b", r"^(?:your|sample|dummy|placeholder|example|filler) (?:text|content|title|description|copy)\b[^.!?]{0,20}(?:here)?[.!]?",
    r"^(?:write|add|put|insert|enter|type|describe)\b[^.!?]{0,60}\b(?:here|for this (?:series|chapter|page|volume|manga|title))\s*[.!]?", r"\blorem ipsum\b",
    r"^(?:this is (?:a |an |some )?)?(?:placeholder|dummy|sample|filler|test) (?:text|content|paragraph)\b", r"^\S{1,4}(?:asdf|qwer|zxcv|hjkl)\S*$", r"\b(?:asdf|qwerty|zxcv|hjkl)[a-z]*\b.*\b(?:asdf|qwer|zxcv|hjkl)[a-z]*\b",
    r"^([^\W\d_]{1,12})(?:[\W_]+\1){2,}[\W_]*$",
)
FILLER_DEFAULT = r"^[\w ]{1,30}[:：]\s*(?:TBD|TBA|TODO|FIXME|XXX+|to be (?:added|written|announced|done|filled in))\.?$"
# Words of the usual Latin stand-in text, the seed of its vocabulary.
SEED_WORDS = ("lorem ipsum dolor amet consectetur adipiscing elit sed eiusmod tempor incididunt labore magna aliqua veniam nostrud exercitation ullamco laboris nisi aliquip"
              " commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa"
              " officia deserunt mollit anim vestibulum pellentesque curabitur praesent vivamus maecenas phasellus suspendisse nullam quam erat orci tellus mauris").split()  # fmt: skip
SURE_SEEDS = tuple(w for w in SEED_WORDS if w not in ("sed", "esse", "non", "sint", "sunt", "quam", "culpa", "anim"))


def any_of(patterns: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(f"(?:{p})" for p in patterns), re.IGNORECASE)


SCRIPT, ASK, OPENING = any_of((SCRIPT_WORDS,)), any_of((SCRIPT_ASK,)), any_of(ERROR_OPENINGS)
PHRASE, DEFAULT = any_of(FILLER_LINES), any_of((FILLER_DEFAULT,))
# What a text must hold (in lower case) for its lines to be looked at.
LINE_SIGNS = ("script", "スクリプト", "스크립트", "скрипт", "error", "fehler", "erreur", "erro", "galat", "kesalahan", "lỗi", "ошибк", "エラー", "错误", "錯誤", "오류", "에러", "unavailable", "available", "disponib", "indispon", "verfügbar", "erreichbar",
              "недоступ", "not found", "gefunden", "encontrad", "trovat", "introuvable", "ditemukan", "tìm thấy", "見つかりません", "不存在", "찾을 수", "denied", "refusé", "verweigert", "negado", "negato", "ditolak", "từ chối", "запрещ", "拒",
              "try again", "retry", "reload", "maintenance", "bảo trì", "점검", "メンテナンス", "维护", "混み合", "server", "máy chủ", "サーバー", "服务器", "서버", "сервер", "сервис", "rate limit", "too many requests", "http", "gateway", "forbidden", "timed out", "timeout",
              "time out", "overloaded", "oops", "went wrong", "this page", "the page", "requested url", "can't find that page", "页面", "ページが", "お探しのページ", "페이지", "layanan", "dienst", "dịch vụ", "tersedia", "khả dụng")
FILLER_SIGNS = ("here", "text", "content", "placeholder", "dummy", "filler", "sample", "write ", "add ", "put ", "insert ", "enter ", "type ", "describe ", "lorem", "asdf", "qwer", "zxcv", "hjkl", "tbd", "tba", "todo", "fixme", "xxx", "to be ", "paragraph")
SPEAKER = re.compile(r"^[^\s:：]{1,16}[:：]\s*(?=\S{3})")
SLOT_TRIM = re.compile(r"^\W*(?:insert|enter|add|your)\s+|\s+here\W*$|^_+|_+$|\)[sd]$", re.IGNORECASE)
DOTTED = re.compile(r"^\W?[A-Za-z]+(?:[_.][A-Za-z0-9]+)+\W?$")
BLANK = re.compile(r"^_{4,}$|^\[\s+\]$")
NOT_ALNUM = re.compile(r"[\W_]+")
DIGITS = re.compile(r"\d+")
MASKED = re.compile(r"(?<![0-9A-Za-z])[A-Za-z]*\d[0-9A-Za-z]*")
STOP = re.compile(r"(?<=[.!?)])\s+|(?<=[。！？])\s*(?=\S)")
PIECE = re.compile(r"[぀-ヿ㐀-鿿]+|[^\W_぀-ヿ㐀-鿿]+|#")
NOTICE = re.compile(SCRIPT_WORDS + r"|\bjs\b|\bscripts?\b", re.IGNORECASE)
SENTENCE = re.compile(r"[\r\n]+|(?<=[.!?])\s+")
LATIN = re.compile(r"[a-z]+")
SEEDS = frozenset(SURE_SEEDS)
COLUMNS = "doc_id string, kind string, value string, around string, sure boolean, n_seeds int, words array<string>, hashes array<bigint>"
#: Windows of whole-page templates that each worker holds; more of them are joined by shuffle.
MOST_WINDOWS = 1_000_000
#: A template's least number of windows, of its pages, and the parts of its documents and of its windows.
LEAST_WINDOWS, LEAST_ALONE, PART_ALONE, PART_SHARED = 3, 2, 0.25, 0.2
#: A window is shared if it stands in other lines this many times as often as the template stands anywhere.
PART_ELSEWHERE = 0.3
#: Lines of so many words and letters are tried for letters that stand together in no language, up to this share of them.
JUNK_WORDS, JUNK_LETTERS, JUNK_SHARE = 5, 24, 0.45


def h64(text: str) -> int:
    """A 64-bit hash as a signed number."""
    return xxhash.xxh64_intdigest(text) - (1 << 63)


@lru_cache(maxsize=1)
def letter_pairs() -> frozenset[str]:
    """The pairs of letters of words in Latin script, of all languages' ordinary sentences together."""
    words = {w for text in lang.SEED.values() for w in LATIN.findall(unicodedata.normalize("NFD", text)) if w}
    count = Counter(a + b for w in words for a, b in pairwise(w))
    return frozenset(count)


@lru_cache(maxsize=200_000)
def _known_pairs(word: str) -> tuple[int, int]:
    """(pairs of letters that a language has, all pairs) of a word; none for what is no word in Latin letters."""
    word = word.strip(".,;:!?\"'()")
    return (sum(a + b in letter_pairs() for a, b in pairwise(word)), len(word) - 1) if LATIN.fullmatch(word) else (0, 0)


def is_junk(line: str) -> bool:
    """Whether a line in lower case is of keys struck at random: many of its pairs of letters are in no language."""
    tokens = line.split()
    if len(tokens) < JUNK_WORDS:
        return False
    counted = [_known_pairs(x) for x in tokens]
    words, pairs = sum(n > 0 for _, n in counted), sum(n for _, n in counted)
    if words < JUNK_WORDS or pairs + words < JUNK_LETTERS or words < 0.9 * len(tokens):
        return False
    return sum(k for k, _ in counted) <= JUNK_SHARE * pairs


def openings(line: str) -> list[str]:
    """The masked form of a line by its first sentence, its first two and three, and whole: what follows may be a footer."""
    masked = MASKED.sub("#", SPEAKER.sub("", line))
    out = [x for m in list(STOP.finditer(masked))[:3] if (x := masked[: m.start()])]
    return out + [masked] if masked not in out else out


def windows(sentence: str) -> list[str]:
    """Each three words of a sentence, each six characters where a script has no blanks."""
    out, words = [], []
    for piece in PIECE.findall(sentence.lower()):
        if "぀" <= piece[0] <= "鿿":
            out += [piece[i : i + 6] for i in range(max(1, len(piece) - 5))]
        else:
            words.append(piece)
    return out + [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else out


def layout(text: str) -> Iterator[tuple]:
    """The openings of all lines of a text ('lines'), and what may be a whole page ('page': opening, lines below)."""
    parts = [x for line in re.split(r"[\r\n]+", text) if (x := line.strip())]
    every = [openings(x) for x in parts]
    yield "lines", None, None, None, None, None, list({h64(x) for line in every for x in line})
    # a page: the line, a title above it, what may be footers below it
    for at in range(2 if len(parts) <= 4 else 0):
        if at < len(parts) <= at + 3 and not (PHRASE.search(parts[at]) or DEFAULT.search(parts[at]) or len(SEEDS.intersection(LATIN.findall(parts[at].lower()))) >= 2):
            for x in every[at]:
                yield "page", x, "\n".join(o[-1] for o in every[at + 1 :]), None, None, None, [h64(x)]


class Scanner:
    """Takes what may be residue out of a text; made once per task."""

    def __init__(self) -> None:
        self.signs = ahocorasick.Automaton()
        for word, what in (*((w, 1) for w in LINE_SIGNS), *((w, 2) for w in FILLER_SIGNS), *((w, 4) for w in SURE_SEEDS)):
            self.signs.add_word(word, what | (self.signs.get(word) if word in self.signs else 0))
        self.signs.make_automaton()

    def __call__(self, text: str) -> Iterator[tuple]:
        """(kind, value, around, sure, n_seeds, words) of each find."""
        if any(sign in text for sign in SLOT_SIGNS):
            for m in SLOT.finditer(text):
                slot = m.group()
                name = NOT_ALNUM.sub("", SLOT_TRIM.sub("", slot)).lower()
                around = DIGITS.sub("#", text[max(0, m.start() - 12) : m.start()]) + "\u0001" + DIGITS.sub("#", text[m.end() : m.end() + 12])
                yield "slot", name, around, bool(SURE.match(slot) or DOTTED.match(slot) or BLANK.match(slot)), None, None
        low = text.lower()
        signs = 0
        for _, what in self.signs.iter(low):
            signs |= what
        parts = [x.strip() for x in re.split(r"[\r\n]+", text)]
        parts = [x for x in parts if x]
        defaults = 0
        for at, line in enumerate(parts):
            said = SPEAKER.sub("", line)
            if signs & 1:
                masked = DIGITS.sub("#", said)
                alone = len(parts) <= 2 and at == len(parts) - 1
                if SCRIPT.search(said) and ASK.search(said):
                    yield "script_notice", masked, None, alone, None, None
                elif OPENING.search(said):
                    yield "error_page", masked, None, alone, None, None
            if signs & 2:
                if PHRASE.search(said):
                    yield "filler", None, None, True, None, None
                defaults += bool(DEFAULT.search(line))
            else:
                tokens = said.split(None, 3)
                if len(tokens) >= 3 and tokens[0] == tokens[1] == tokens[2] and PHRASE.search(said):
                    yield "filler", None, None, True, None, None
            if len(said) >= JUNK_LETTERS and said.isascii() and is_junk(said.lower()):
                yield "filler", None, None, True, None, None
        if defaults >= 2 or (defaults and len(parts) <= 2):
            yield "filler", None, None, True, None, None
        if signs & 4:
            for sentence in SENTENCE.split(low):
                words = LATIN.findall(sentence)
                if len(words) >= 4:
                    seeds = len(SEEDS.intersection(words))
                    if seeds:
                        yield "prose", None, None, False, seeds, words


def candidates(docs: DataFrame) -> DataFrame:
    """Everything that may be residue, in one pass over the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner()
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64())]
        names = ["doc_id", "kind", "value", "around", "sure", "n_seeds", "words", "hashes"]
        for batch in batches:
            rows = [
                (i, *found, *[None] * (7 - len(found)))
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for found in chain(scan(text), layout(text))
            ]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return docs.mapInArrow(run, COLUMNS)


def elsewhere(docs: DataFrame, own: DataFrame, pool: DataFrame) -> DataFrame:
    """(w, others): how often the windows of ``own`` stand in lines that no opening of which is in ``pool``.

    Up to ``MOST_WINDOWS`` windows are held by each worker with the pool, so only counts go on; more are joined.
    """
    wanted = own.select("w").distinct()
    held = None
    if wanted.count() <= MOST_WINDOWS and pool.count() <= MOST_WINDOWS:
        held = docs.sparkSession.sparkContext.broadcast(tuple(x.toArrow().column(0).to_numpy() for x in (wanted, pool.select("h"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, known = (set(x.tolist()) for x in held.value) if held is not None else (None, None)
        met: dict[str, tuple[int, ...]] = {}
        totals: Counter = Counter()

        def record(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["ws", "covers", "n"])

        for batch in batches:
            counted = Counter(x for text in batch.column(1).to_pylist() for line in re.split(r"[\r\n]+", text) if (x := line.strip()))
            rows = []
            for line, n in counted.items():
                forms = openings(line)
                masked, heads = forms[-1], [h64(x) for x in forms]
                last = len(heads) - 1
                for i, sentence in enumerate(STOP.split(masked)):
                    covers = heads[min(i, last) :]
                    if keys is not None and not known.isdisjoint(covers):
                        continue
                    if (found := met.get(sentence)) is None:
                        if len(met) >= 200_000:
                            met.clear()
                        every = {h64(w) for w in windows(sentence)}
                        found = met[sentence] = tuple(every if keys is None else keys & every)
                    if keys is None:
                        rows.append((list(found), covers, n))
                    else:
                        for h in found:
                            totals[h] += n
            if rows:
                yield record(rows)
        yield record([([h], [], n) for h, n in totals.items()])

    each = docs.mapInArrow(run, "ws array<bigint>, covers array<bigint>, n bigint")
    if held is None:
        each = each.groupBy("ws", "covers").agg(F.sum("n").alias("n")).withColumn("place", F.xxhash64("ws", "covers"))
        covered = each.select("place", F.explode("covers").alias("h")).join(pool.select("h"), "h", "left_semi").select("place").distinct()
        each = each.join(covered, "place", "left_anti")
    counted = each.select(F.explode("ws").alias("w"), "n").groupBy("w").agg(F.sum("n").alias("others"))
    return counted if held is not None else counted.join(wanted, "w", "left_semi")


def templates(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(value, h): masked lines that stand alone as whole pages and share their windows with no other line."""
    page = found.where("kind = 'page'").select("doc_id", "value", F.col("hashes")[0].alias("h"), F.expr("if(around = '', array(), split(around, '\n'))").alias("below"))
    page = cut(page.distinct())
    alone_at_all = cut(page.groupBy("value", "h").agg(F.countDistinct("doc_id").alias("a")).where(F.col("a") >= LEAST_ALONE))
    usual = found.where("kind = 'lines'").select(F.explode("hashes").alias("h")).join(alone_at_all.select("h"), "h", "left_semi").groupBy("h").agg(F.count("*").alias("n"))
    maybe = alone_at_all.join(usual, "h").where(F.col("a") >= PART_ALONE * F.col("n"))
    footer = page.select("doc_id", "h", F.explode("below").alias("value")).groupBy("value").agg(F.countDistinct("h").alias("heads"), F.countDistinct("doc_id").alias("docs")).where("heads >= 2 and docs >= 2")
    pool = maybe.select("value", F.lit(True).alias("head"), F.col("n").alias("n")).unionByName(footer.select("value", F.lit(False).alias("head"), F.col("docs").alias("n")))
    pool = pool.groupBy("value").agg(F.max("n").alias("n"), F.max("head").alias("head"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_pylist()
            own = [list({h64(w) for s in STOP.split(value) for w in windows(s)}) for value in values]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([h64(v) for v in values], pa.int64()), pa.array(own, pa.list_(pa.int64()))], names=["value", "n", "head", "h", "ws"])

    pool = cut(pool.mapInArrow(run, "value string, n bigint, head boolean, h bigint, ws array<bigint>"))
    own = pool.select("h", "n", F.explode("ws").alias("w"))
    shared = F.coalesce(F.col("others"), F.lit(0)) > PART_ELSEWHERE * F.col("n")
    judged = own.join(elsewhere(docs, own, pool), "w", "left").groupBy("h").agg(F.count("*").alias("n_windows"), F.count_if(shared).alias("n_shared"))
    closed = cut(pool.drop("ws").join(judged.where(F.col("n_shared") <= PART_SHARED * F.col("n_windows")), "h"))
    # pages again, with nothing below but footers
    known = closed.select(F.col("value").alias("foot"))
    below = page.where("size(below) > 0").select("doc_id", "h", F.size("below").alias("size"), F.posexplode("below").alias("at", "foot"))
    footed = below.join(known, "foot", "left_semi").groupBy("doc_id", "h", "size").count().where("count = size").select("doc_id", "h")
    alone = page.where("size(below) = 0").select("doc_id", "h").unionByName(footed).distinct().groupBy("h").agg(F.count("*").alias("n_alone"))
    whole = closed.where((F.col("n_windows") >= LEAST_WINDOWS) & F.col("head")).join(alone, "h")
    return whole.where((F.col("n_alone") >= LEAST_ALONE) & (F.col("n_alone") >= PART_ALONE * F.col("n"))).select("value", "h")


def placeholders(found: DataFrame) -> DataFrame:
    """Documents with a slot that still holds its name, default or blank."""
    slots = found.where("kind = 'slot'").select("doc_id", F.col("value").alias("name"), "around", "sure")
    known = slots.where("sure and name <> ''").select("name").distinct().withColumn("known", F.lit(True))
    aligned = slots.where("not sure").groupBy("around").agg(F.countDistinct("name").alias("fills")).where("fills >= 2")
    doubtful = slots.where("not sure").join(known, "name", "left").join(aligned, "around", "left").where("known or fills >= 2")
    return slots.where("sure").select("doc_id").unionByName(doubtful.select("doc_id"))


def pages(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, residue): error pages and script notices, whole or as a line of a document."""
    whole = templates(found, docs)
    kind = F.when(F.col("value").rlike("(?iu)" + NOTICE.pattern), F.lit("script_notice")).otherwise(F.lit("error_page"))
    held = found.where("kind = 'lines'").select("doc_id", F.explode("hashes").alias("h")).join(whole.select("h", kind.alias("residue")), "h").select("doc_id", "residue")
    strict = found.where("kind in ('script_notice', 'error_page')").select("doc_id", F.col("kind").alias("residue"))
    return strict.unionByName(held)


def fillers(found: DataFrame) -> DataFrame:
    """Documents with stand-in prose: by phrase, by default entries, or by a vocabulary grown from its seeds.

    A word belongs to it if four tenths of its sentences that hold a seed hold three; a sentence is stand-in prose if
    seven tenths of its words belong to it.
    """
    prose = found.where("kind = 'prose'").withColumn("sentence", F.monotonically_increasing_id())
    core = (F.col("n_seeds") >= 3).cast("int")
    grown = prose.select(F.explode(F.array_distinct("words")).alias("w"), core.alias("core")).groupBy("w").agg(F.sum("core").alias("inside"), F.count("*").alias("n"))
    grown = grown.where("inside >= 1 and inside * 10 >= n * 4").select("w")
    each = prose.select("doc_id", "sentence", F.size("words").alias("n"), F.explode("words").alias("w"))
    known = each.join(grown, "w").groupBy("doc_id", "sentence", "n").count().where("count * 10 >= n * 7")
    return found.where("kind = 'filler'").select("doc_id").unionByName(known.select("doc_id"))


def residue(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, residue): the documents that hold residue, with its one kind."""
    kind = docs.schema[doc_id].dataType
    source = spread(docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null"))
    found = cut(candidates(source))
    every = (
        pages(found, source)
        .unionByName(placeholders(found).withColumn("residue", F.lit("placeholder")))
        .unionByName(fillers(found).withColumn("residue", F.lit("filler")))
    )
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("residue"))
    return every.groupBy("doc_id").agg(F.min_by("residue", rank).alias("residue")).select(F.col("doc_id").cast(kind).alias(doc_id), "residue")


def without_residue(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that hold residue; ids that are null stay."""
    return docs.join(residue(docs, doc_id, text).select(doc_id), doc_id, "left_anti")
