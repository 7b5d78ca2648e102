"""Broken prompt and response pairs: which defect the translation of a text has, if any.

The response is compressed with its prompt as a raw-content dictionary (a copy takes hardly more than the prompt itself
does), with each language's dictionary (wrong language) and with a dictionary of refusals (a refusal is made small by it); what it says by its last words is judged by a terminal-context model, the
share of each context that ends a sentence anywhere in the corpus, together with the usual proportion of lengths.
Contexts are counted exactly over all pairs; the pairs whose defect hangs on one are joined with its counts.

Defined results: a pair whose source is null, empty or without words, or holds only a name, a sound, a number, a header
or a page number, is no case; a null translation of any other is 'empty'; ``failed`` does not matter; a pair has
one defect at most, in the order empty, refusal, copy, wrong_language, truncated; repeated rows count once.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from komagrid.llm import codepoints, lang, lines
from komagrid.llm.langid import MIN_CONFIDENCE, _table
from komagrid.session import cut, spread

DEFECTS = ("empty", "refusal", "copy", "wrong_language", "truncated")
BIN = 0.05
#: Sentences and contexts counted by a worker before they are handed on.
LOCAL_SENTENCES, LOCAL_CONTEXTS, LOCAL_TEXTS = 100_000, 500_000, 20_000
#: Texts whose reading a worker keeps, as many texts come more than once.
MEMO = 30_000
#: A copy: how much of what a text takes by itself, beyond what its prompt takes after itself, is left after the prompt.
COPY_LEFT, COPY_LENGTHS = 0.45, (0.6, 1.7)
#: A refusal: what is left of a text after the dictionary of refusals.
REFUSAL_LEFT = 0.75

# Stand-ins for a missing translation (squashed to letters and digits).
STAND_INS = frozenset(
    "na null none nil blank empty untranslated nottranslated notranslation missing tbd tba todo undefined nan notavailable noresult error failed"
    " chưadịch khôngcóbảndịch trống khôngcó".split()
)

# How a translator declines, per language; the seed of the refusal dictionary.
REFUSALS = (
    "i'm sorry, but i can't translate this text. i cannot help with translating this content. i am unable to provide a translation for this bubble. as a language model, i cannot assist with that request."
    " this request can't be processed. i must decline to translate this entry. there isn't enough context for me to translate it. the content of this entry isn't something i can translate."
    " translating this passage goes against my guidelines. i won't be able to translate that line. i don't feel comfortable rendering this dialogue. unfortunately, i apologize, apologies, sorry, i can't provide a translation.",
    "tôi không thể dịch đoạn này. tôi không thể hỗ trợ dịch nội dung này. tôi xin lỗi nhưng tôi phải từ chối dịch câu thoại này. nội dung này vi phạm nguyên tắc nên tôi không dịch được."
    " yêu cầu dịch này không thể được xử lý. rất tiếc, thành thật xin lỗi, tôi không có đủ ngữ cảnh để dịch. với tư cách là một mô hình ngôn ngữ, tôi không thể giúp.",
)
SPEAKS_OF_IT = re.compile(
    r"\btranslat|\bthis (?:request|content|passage|entry|dialogue|text|bubble)\b|\blanguage model\b|\bguidelines?\b|\bpolic(?:y|ies)\b|\bas an ai\b|\brender(?:ing)? (?:this|that|the) (?:dialogue|line|text|bubble)"
    r"|\bdịch\b|\bmô hình ngôn ngữ\b|\bnguyên tắc\b|\bchính sách\b|\byêu cầu này\b|翻訳|翻译|번역|\btradu|перев[ое]|übersetz|terjemah"
)
DECLINES = re.compile(
    r"\b(?:can(?:'|no)t|cannot|can not|won't|will not|unable|not able|decline|refuse|isn't something|not something|isn't enough|not enough|against|don't feel|do not feel|not comfortable|violat\w*|not allowed|not permitted)\b"
    r"|không thể|từ chối|không dịch được|vi phạm|không (?:được phép|có đủ|đủ)|できません|できない|无法|不能|없습니다|할 수 없|no puedo|não posso|je ne peux|non posso|kann (?:ich )?(?:das |dies)?.*nicht|не могу|tidak (?:bisa|dapat)"
)
WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
#: Sounds made of syllables; each place has one way on, so that a long word is read once.
SOUND = re.compile(
    r"^(?:he(?!e)|hừm|[hm]|e++h|u(?:gh|f++)?|[ao]|wow|t?s++k|sh|j[ae]|[ồơ]|[うおあえんーっはへほふハフ]|[아오어으흠음하허호흐]|[嗯哦啊哈呵哎唉咦喔噢]|х(?=[ам])|(?<=[оа])х|[мао]|(?<=[ао])й)++$"
)
DRESS = re.compile(r"^\W*(?:translation|translated text|translated|output|answer|result|response|bản dịch|dịch|english|vietnamese|en|vi)\s*[:：]\s*", re.IGNORECASE)
# One of these is in every text that speaks of translating.
SPEAKING = re.compile("|".join(("transl", "this request", "this content", "this passage", "this entry", "this dialogue", "this text", "this bubble", "language model", "guideline", "polic", "as an ai", "render", "dịch", "mô hình", "nguyên tắc",
            "chính sách", "yêu cầu này", "翻", "번역", "tradu", "перев", "bersetz", "terjemah")))


def _context(words: list[str], i: int) -> tuple[str, str]:
    """The last word alone and with the word before it."""
    last = words[i]
    return last, (words[i - 1] if i else "^") + " " + last


def _open(text: str) -> bool:
    """Whether a text breaks off with dots."""
    return text.rstrip(lang.CLOSING).endswith(("..", "…"))


def _parts(text: str, title: lines.Title | None, known: frozenset[str]) -> tuple[str, list[str]]:
    """The paragraph of a text without headers and page numbers, in lower case, and its sentences."""
    body = lines.paragraph(lines.body_lines(text, title, known) or [""])
    return body, [s for s in lang.sentences(body) if WORD.search(s)]


def corpus_statistics(pairs: DataFrame, known: frozenset[str]) -> tuple[DataFrame, dict]:
    """Counts over all pairs: (target, k, n, final) of word contexts and of those that end a sentence, checkpointed, and the
    usual lengths by script and target."""
    shared = pairs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths: Counter = Counter()
        titles = shared.value
        seen: Counter = Counter()
        every: Counter = Counter()
        final: Counter = Counter()

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return _table(rows, ["kind", "target", "k", "n", "final"], [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()])

        def spread() -> None:
            for (target, s), n in seen.items():
                words = WORD.findall(s)
                if all(SOUND.match(w) for w in words):
                    continue
                for i in range(len(words)):
                    for k in _context(words, i):
                        every[target, k] += n
                if lang.ends(s) and not _open(s):
                    for k in _context(words, len(words) - 1):
                        final[target, k] += n
            seen.clear()

        def contexts() -> Iterator[pa.RecordBatch]:
            items = list(every.items())
            for i in range(0, len(items), 50_000):
                yield table([("context", target, k, n, final[target, k]) for (target, k), n in items[i : i + 50_000]])
            every.clear()
            final.clear()

        def read() -> None:
            # each distinct text once, however often it came
            for (target, text), sources in texts.items():
                body, parts = _parts(text, None, titles)
                n = sum(sources.values())
                for x in parts:
                    seen[target, x] += n
                if len(body) >= 8:
                    for (script, size), k in sources.items():
                        if size >= 8:
                            lengths[script, target, round(math.log(len(body) / size) / BIN)] += k
            texts.clear()

        texts: dict[tuple[str, str], Counter] = defaultdict(Counter)
        for batch in batches:
            targets = batch.column(2).to_pylist()
            for source, text, target in zip(batch.column(0).to_pylist(), codepoints.unify_texts(batch.column(1)), targets, strict=True):
                if text and target is not None:
                    texts[target, text.lower()][lang.script_of(source) if len(source) >= 8 else "", len(source)] += 1
            if len(texts) > LOCAL_TEXTS:
                read()
            if len(seen) > LOCAL_SENTENCES:
                spread()
            if len(every) > LOCAL_CONTEXTS:
                yield from contexts()
        read()
        spread()
        yield from contexts()
        yield table([(f"length-{script}", target, str(k), n, 0) for (script, target, k), n in lengths.items()])

    part = pairs.select("source", "translation", "target_lang").mapInArrow(run, "kind string, target string, k string, n bigint, final bigint")
    total = cut(part.groupBy("kind", "target", "k").agg(F.sum("n").alias("n"), F.sum("final").alias("final")))
    # lengths are few: a bin for each script, target language and proportion
    counts: dict[tuple[str, str], list[tuple[int, int]]] = {}
    for kind, target, k, n in total.where("kind <> 'context'").select("kind", "target", "k", "n").collect():
        counts.setdefault((kind[7:], target), []).append((int(k), n))
    usual = {}
    for key, counted in counts.items():
        counted.sort()
        half, run_ = sum(n for _, n in counted) / 2, 0
        for k, n in counted:
            run_ += n
            if run_ >= half:
                usual[key] = k * BIN
                break
    return total.where("kind = 'context'").select("target", "k", "n", "final"), usual


class Judge:
    """Judges pairs; made once per task."""

    def __init__(self, dictionaries: dict[str, bytes], lengths: dict, titles: dict[str, lines.Title]) -> None:
        self.classify = lang.Classifier(dictionaries)
        self.lengths = lengths
        self.titles, self.known = titles, lines.known_titles(titles)
        # sentences of one word that the corpus knows as sentences, not as names
        self.said = {lines.squash(x) for raw in dictionaries.values() for x in raw.decode("utf-8", "ignore").split("\n") if len(x) <= 40}
        self.small = zs.ZstdCompressionParameters(window_log=14, chain_log=8, hash_log=11, search_log=2, min_match=3, target_length=16, strategy=zs.STRATEGY_GREEDY, write_content_size=False, write_dict_id=False)
        self.plain = zs.ZstdCompressor(compression_params=self.small)
        self.frame = len(self.plain.compress(b""))

        def made(raw: bytes) -> zs.ZstdCompressor:
            d = zs.ZstdCompressionDict(raw, dict_type=zs.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=self.small)
            return zs.ZstdCompressor(dict_data=d, compression_params=self.small)

        self.refusals = [made(r.encode()) for r in REFUSALS]
        self.sources: dict[tuple, tuple] = {}
        self.tellings: dict[tuple, tuple] = {}

    def copied(self, prompt: str, text: str) -> bool:
        """Whether a squashed text is its prompt given back, by what it takes with the prompt as its dictionary.

        0 is what the prompt itself takes after itself, 1 what the text takes alone. A text too short for a difference of
        bytes is compared as it is.
        """
        if len(text) < 4 or not COPY_LENGTHS[0] <= len(text) / len(prompt) <= COPY_LENGTHS[1]:
            return False
        raw, own = text.encode(), prompt.encode()
        after = zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(own, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=self.small)
        least, alone = len(after.compress(own)), len(self.plain.compress(raw))
        if alone - least < 4:
            return text == prompt
        return len(after.compress(raw)) - least <= COPY_LEFT * (alone - least)

    def content(self, parts: list[str]) -> int:
        """0: no dialogue or narration; 1: one word, known as a sentence; 2: more."""
        if parts and len(set(WORD.findall(parts[0]))) >= 3:
            return 2
        words = [w for s in parts for w in WORD.findall(s)]
        words = [w for w in words if not w.isdigit()]
        if not words:
            return 0
        flat = "".join(words)
        if SOUND.match(flat) or all(SOUND.match(w) for w in words):
            return 0
        if len(words) == 1:
            cjk = lines.CJK.match(flat)
            if cjk and len(flat) > 4 and not re.fullmatch("[ァ-ヺー]+", flat):
                return 2
            return 1 if flat.replace("-", "").replace("'", "").casefold() in self.said else 0
        stem = {w[2:] if w[1:2] == "-" else w for w in words}
        if len(stem) == 1:
            return 1 if flat.casefold() in self.said else 0
        return 2

    def refusal(self, text: str) -> bool:
        """Whether the dictionary of refusals makes a text small that speaks of translating; that it declines is checked."""
        if not SPEAKING.search(text):
            return False
        raw = text.encode()
        alone = max(1, len(self.plain.compress(raw)) - self.frame)
        if min(len(r.compress(raw)) - self.frame for r in self.refusals) > REFUSAL_LEFT * alone:
            return False
        return bool(SPEAKS_OF_IT.search(text) and DECLINES.search(text))

    def _key(self, low: str, title: lines.Title | None) -> tuple[str, str | None]:
        """What the reading of a text depends on: its title only if it may stand there."""
        return low, title.flat if title is not None and title.probe in low else "" if title is not None else None

    def source(self, low: str, title: lines.Title | None) -> tuple[str, list[str], int]:
        """(body, sentences, content) of a source in lower case."""
        key = self._key(low, title)
        if (got := self.sources.get(key)) is None:
            if len(self.sources) >= MEMO:
                self.sources.clear()
            body, parts = _parts(low, title, self.known)
            got = self.sources[key] = body, parts, self.content(parts)
        return got

    def told(self, low: str, title: lines.Title | None) -> tuple[str, list[str], bool, dict[str, float], str]:
        """(body, sentences, whether it is a refusal, letters by language, script) of a translation in lower case."""
        key = self._key(low, title)
        if (got := self.tellings.get(key)) is None:
            if len(self.tellings) >= MEMO:
                self.tellings.clear()
            body, parts = _parts(DRESS.sub("", low), title, self.known)
            weight: dict[str, float] = {}
            for s in parts:
                code, confidence = self.classify(lang.DIGITS.sub("0", s))
                if code and confidence >= MIN_CONFIDENCE:
                    weight[code] = weight.get(code, 0) + len(s)
            got = self.tellings[key] = body, parts, bool(parts) and self.refusal(body), weight, lang.script_of(body)
        return got

    def truncated(self, source: str, s_parts: list[str], text: str, t_parts: list[str], target: str) -> bool | tuple[str, str, bool, float]:
        """Whether a text stops too early, or what that hangs on: its last word, that with the one before, whether the source
        ends, and the length."""
        if not t_parts:
            return True
        s_ends, t_ends, s_open, t_open = lang.ends(source), lang.ends(text), _open(source), _open(text)
        if t_ends and len(t_parts) >= len(s_parts) and (s_open or not t_open):
            return False
        usual = self.lengths.get((lang.script_of(source), target))
        length = math.exp(math.log(max(len(text), 1) / max(len(source), 1)) - usual) if usual is not None else 1.0
        fewer = len(t_parts) < len(s_parts)
        words = WORD.findall(t_parts[-1])
        if not t_ends:
            if re.search(r"[,;:，、]\s*$", text) and not re.search(r"[,;:，、]\s*$", source):
                return True
            if s_ends:
                return True if fewer or length <= 0.7 else (*_context(words, len(words) - 1), True, length)
            if fewer and length < 0.8:
                return True
            return (*_context(words, len(words) - 1), False, length) if length < 0.92 else False
        if t_open and not s_open:
            return True if fewer or length <= 0.6 else (*_context(words, len(words) - 1), True, length)
        if fewer and length < 0.87:
            return True
        return False

    def __call__(self, source: str, text: str | None, target: str, manga: str | None) -> str | tuple[str, str, bool, float] | None:
        """The defect of a pair of unified texts, or none, or what hangs on the counts of its last context."""
        title = self.titles.get(manga)
        body, s_parts, content = self.source(source.lower(), title)
        if not content:
            return None
        stripped = (text or "").strip().lower()
        if len(stripped) <= 40 and (not (flat := lines.squash(stripped)) or flat in STAND_INS):
            return "empty"
        t_body, t_parts, refusal, weight, script = self.told(stripped, title)
        if not t_parts:
            return "empty" if content == 2 else None
        if refusal and not self.refusal(body):
            return "refusal"
        total = sum(weight.values())
        # a copy is not in the target language
        if weight.get(target, 0.0) < 0.6 * total or not total:
            if lang.script_of(body) == script and self.copied(lines.squash(body), lines.squash(t_body)):
                return "copy"
        if weight:
            best = max(weight, key=weight.get)
            if best != target and weight.get(target, 0.0) < 0.25 * total and weight[best] >= 0.4 * len(t_body):
                return "wrong_language"
        elif script != "latin" and target in lang.BY_SCRIPT["latin"]:
            return "wrong_language"
        cut_off = self.truncated(body, s_parts, t_body, t_parts, target)
        return ("truncated" if cut_off else None) if isinstance(cut_off, bool) else cut_off


def stopped(doubtful: DataFrame, contexts: DataFrame) -> DataFrame:
    """Of the pairs whose defect hangs on their last context, those that are truncated.

    Evidence is the share of the context's other occurrences that end a sentence: of the last two words, or of the last
    word where the two are found fewer than three times.
    """
    counts = lambda k: contexts.select("target", F.col("k").alias(k), F.struct("n", "final").alias(f"of_{k}"))
    met = doubtful.join(counts("two"), ["target", "two"], "left").join(counts("one"), ["target", "one"], "left")
    n_two, n_one = (F.coalesce(F.col(f"of_{k}.n") - 1, F.lit(0)) for k in ("two", "one"))
    final = lambda k: F.coalesce(F.col(f"of_{k}.final"), F.lit(0))
    n = F.when(n_two < 3, n_one).otherwise(n_two)
    met = met.withColumn("seen", F.greatest(n, F.lit(0))).withColumn("ends", F.least(F.when(n_two < 3, final("one")).otherwise(final("two")), F.col("seen")))
    share = F.when(F.col("seen") > 0, F.col("ends") / F.col("seen")).otherwise(F.lit(0.0))
    early = (share < 0.2) & (F.col("length") < F.when(F.col("seen") < 2, 0.92).otherwise(0.85))
    cut_off = F.when(F.col("ended"), ~((share >= 0.5) & (F.col("seen") >= 5))).otherwise(early)
    return met.where(cut_off).select("record_kind", "record_id", F.lit("truncated").alias("defect"))


def defects(pairs: DataFrame, dictionaries: dict[str, bytes], titles: dict[str, lines.Title]) -> DataFrame:
    """(record_kind, record_id, defect), distinct. ``pairs``: record_kind, record_id, source, translation, target_lang, manga_id."""
    pairs = pairs.where("record_id is not null and source is not null").select("record_kind", "record_id", "source", "translation", "target_lang", "manga_id")
    pairs = spread(pairs)
    known = lines.known_titles(titles)
    contexts, lengths = corpus_statistics(pairs, known)
    shared = pairs.sparkSession.sparkContext.broadcast((dictionaries, lengths, titles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(*shared.value)
        for batch in batches:
            kinds, ids, targets, manga = (batch.column(k).to_pylist() for k in (0, 1, 4, 5))
            rows = []
            for kind, i, source, text, target, m in zip(kinds, ids, codepoints.unify_texts(batch.column(2)), codepoints.unify_texts(batch.column(3)), targets, manga, strict=True):
                defect = judge(source, text, target, m)
                if isinstance(defect, tuple):
                    rows.append((kind, i, None, target, *defect))
                elif defect:
                    rows.append((kind, i, defect, None, None, None, None, None))
            yield _table(rows, names, [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.float64()])

    names = ["record_kind", "record_id", "defect", "target", "one", "two", "ended", "length"]
    judged = cut(pairs.mapInArrow(run, "record_kind string, record_id bigint, defect string, target string, one string, two string, ended boolean, length double"))
    found = judged.where("defect is not null").select("record_kind", "record_id", "defect").unionByName(stopped(judged.where("defect is null"), contexts))
    # a record that comes in several versions has the first of their defects
    rank = F.array_position(F.array(*[F.lit(d) for d in DEFECTS]), F.col("defect"))
    return found.groupBy("record_kind", "record_id").agg(F.min_by("defect", rank).alias("defect"))
