"""Compression classification: the language whose dictionary makes a text smallest.

One zstandard raw-content dictionary per language, fitted on a bounded sample of labelled documents (``SAMPLE_DOCS`` per
language, the smallest hashes of the id, of each at most ``SAMPLE_CHARS`` characters) after a seed text that covers
languages without documents. Labels of the sample may be wrong and its texts mixed, so only sentences that the sample as a
whole puts under their label are kept, evenly thinned out to ``DICT_BYTES``. The bounds hold for the fit only.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import zstandard as zs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from komagrid.session import bounded_rows

LANGS = ("ja", "ko", "zh", "en", "es", "pt", "id", "fr", "it", "de", "ru", "vi")
#: Documents per language that the dictionaries are fitted on; the rest of the corpus is classified only.
SAMPLE_DOCS = 120
SAMPLE_CHARS = 1 << 16
DICT_BYTES = 48 * 1024
MEMO = 200_000
#: The confidence of a short sentence that only one language's dictionary holds as it is.
KNOWN = 0.7

# Other codes and names of the languages.
ALIASES = {
    "jpn": "ja", "jp": "ja", "japanese": "ja", "kor": "ko", "kr": "ko", "korean": "ko", "zho": "zh", "chi": "zh", "cn": "zh", "chinese": "zh", "cmn": "zh",
    "eng": "en", "english": "en", "spa": "es", "spanish": "es", "por": "pt", "portuguese": "pt", "ind": "id", "in": "id", "indonesian": "id", "fra": "fr",
    "fre": "fr", "french": "fr", "ita": "it", "italian": "it", "deu": "de", "ger": "de", "german": "de", "rus": "ru", "russian": "ru", "vie": "vi", "vn": "vi",
    "vietnamese": "vi",
}

#: A few ordinary sentences per language, so that each has a dictionary even where the corpus has no text of it.
SEED = {
    "ja": "これは私の本です。今日はとても天気がいいですね。どうしてここに来たのですか。彼は何も言わなかった。明日また会いましょう。ありがとうございます。それは違うと思います。",
    "ko": "이것은 나의 책이에요. 오늘은 날씨가 아주 좋네요. 왜 여기에 왔어요? 그는 아무 말도 하지 않았다. 내일 다시 만나요. 정말 고맙습니다. 그건 아니라고 생각해요.",
    "zh": "这是我的书。今天天气很好。你为什么来这里？他什么也没有说。我们明天再见面吧。非常感谢你。我觉得不是这样的。",
    "en": "this is my book. the weather is very nice today. why did you come here? he did not say anything. we will see each other again tomorrow. thank you very much for your help. i think that is not what they were looking for.",
    "es": "este es mi libro. hoy hace muy buen tiempo. ¿por qué has venido aquí? él no dijo nada. nos vemos otra vez mañana. muchas gracias por tu ayuda. creo que eso no es lo que estaban buscando.",
    "pt": "este é o meu livro. hoje o tempo está muito bom. por que você veio aqui? ele não disse nada. nós nos vemos de novo amanhã. muito obrigado pela sua ajuda. acho que não é isso que eles estavam procurando.",
    "id": "ini buku saya. hari ini cuacanya sangat bagus. mengapa kamu datang ke sini? dia tidak mengatakan apa-apa. kita akan bertemu lagi besok. terima kasih banyak atas bantuannya. saya kira bukan itu yang mereka cari.",
    "fr": "ceci est mon livre. il fait très beau aujourd'hui. pourquoi es-tu venu ici ? il n'a rien dit. nous nous reverrons demain. merci beaucoup pour votre aide. je pense que ce n'est pas ce qu'ils cherchaient.",
    "it": "questo è il mio libro. oggi il tempo è molto bello. perché sei venuto qui? lui non ha detto niente. ci vediamo di nuovo domani. grazie mille per il vostro aiuto. penso che non sia quello che stavano cercando.",
    "de": "das ist mein buch. heute ist das wetter sehr schön. warum bist du hierher gekommen? er hat nichts gesagt. wir sehen uns morgen wieder. vielen dank für ihre hilfe. ich glaube, das ist nicht das, was sie gesucht haben.",
    "ru": "это моя книга. сегодня очень хорошая погода. почему ты пришёл сюда? он ничего не сказал. мы увидимся снова завтра. большое спасибо за вашу помощь. я думаю, это не то, что они искали.",
    "vi": "đây là cuốn sách của tôi. hôm nay thời tiết rất đẹp. tại sao bạn lại đến đây? anh ấy không nói gì cả. ngày mai chúng ta sẽ gặp lại nhau. cảm ơn bạn rất nhiều vì đã giúp đỡ. tôi nghĩ đó không phải là thứ họ đang tìm.",
}

SCRIPTS = (
    ("kana", re.compile("[ぁ-ヿ]")), ("han", re.compile("[㐀-鿿]")), ("hangul", re.compile("[가-힣]")), ("cyrillic", re.compile("[Ѐ-ӿ]")), ("latin", re.compile("[a-zà-ɏḀ-ỿ]")),
)
#: Languages a text can be in, by the script of most of its letters.
BY_SCRIPT = {
    "kana": ("ja",), "han": ("zh", "ja"), "hangul": ("ko",), "cyrillic": ("ru",), "latin": ("en", "es", "pt", "id", "fr", "it", "de", "vi"),
}

SPEAKER = re.compile(r"^[^\s:：]{1,16}[:：]\s*(?=\S)")
SENTENCE = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+|(?<=[。！？])[」』”）]*\s*|(?<=…)(?=[぀-鿿가-힣])")
CLOSING = " \t\r\n\"'»”’)]」』）"
FULL = frozenset(".!?…。！？")
NOT_LATIN = re.compile("[Ѐ-ӿ぀-ヿ㐀-鿿가-힣]")
DIGITS = re.compile(r"\d+")
UNWORD = re.compile(r"[^\w'’]+|[\d_]+")


def canonical_label(label: Column) -> Column:
    """The code of a label in whatever spelling, regional variants included; null where it names no language."""
    base = F.regexp_extract(F.lower(F.trim(label)), "^([\\p{L}]+)(?:[-_ ].*)?$", 1)
    known = F.create_map(*[F.lit(x) for kv in (ALIASES | {c: c for c in LANGS}).items() for x in kv])
    return F.try_element_at(known, base)


def ends(text: str) -> bool:
    """Whether a text ends like a sentence."""
    return text.rstrip(CLOSING)[-1:] in FULL


def script_of(text: str) -> str:
    """The script of most letters; kana makes a text Japanese where it has its share."""
    if text.isascii() or not NOT_LATIN.search(text):
        return "latin"
    found = [(name, r) for name, r in SCRIPTS if r.search(text)]
    if len(found) == 1:
        return found[0][0]
    counts = {name: len(r.findall(text)) for name, r in found}
    if counts.get("kana", 0) * 8 >= counts.get("han", 0) and counts.get("kana", 0) + counts.get("han", 0) >= max(counts.get("latin", 0), counts.get("hangul", 0), counts.get("cyrillic", 0)) and "kana" in counts:
        return "kana"
    return max(counts, key=counts.get)


def sentences(text: str) -> list[str]:
    """The sentences of one paragraph (a line of a document, or a region with its lines joined)."""
    return [s for s in SENTENCE.split(text) if s]


def _grams(s: str) -> list[str]:
    s = " " + UNWORD.sub(" ", s) + " "
    return [s[i : i + 3] for i in range(len(s) - 2)] + s.split()


def document_sentences(text: str) -> list[str]:
    return [s for line in text.split("\n") for s in sentences(SPEAKER.sub("", line.strip()))]


def clean_sample(sample: dict[str, list[str]]) -> dict[str, list[str]]:
    """The distinct sentences of each label that all labels together agree on, by their word and letter statistics."""
    split = {lang: [s for t in texts for s in document_sentences(t)] for lang, texts in sample.items()}
    counts = {lang: Counter(g for s in (*ss, *sentences(SEED.get(lang, ""))) for g in _grams(s)) for lang, ss in split.items()}
    totals = {lang: sum(c.values()) or 1 for lang, c in counts.items()}
    vocabulary = len(set().union(*counts.values())) if counts else 0

    times = {lang: Counter(ss) for lang, ss in split.items()}

    def score(code: str, grams: list[str], own: int) -> float:
        """The likelihood under a label's other sentences."""
        count, total, mine = counts[code], totals[code] - own * len(grams), Counter(grams)
        return sum(n * math.log((max(0, count[g] - own * n) + 0.5) / (total + 0.5 * vocabulary)) for g, n in mine.items())

    out: dict[str, list[str]] = {}
    for lang, ss in split.items():
        kept = []
        for s in dict.fromkeys(ss):
            grams = _grams(s)
            # a sentence that the label repeats speaks for itself; a single one doesn't
            if len(s) > 5 and max(counts, key=lambda k: score(k, grams, int(k == lang and times[lang][s] == 1))) == lang:
                kept.append(s)
        out[lang] = kept
    return out


def fit(documents: DataFrame, sample_docs: int = SAMPLE_DOCS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """The dictionaries, from at most ``sample_docs`` labelled documents per language."""
    labelled = documents.select(F.col(doc_id).alias("id"), canonical_label(F.col(lang)).alias("code")).where("code is not null and id is not null")
    # the candidates are the ids of small hash; only ids and labels travel
    order = Window.partitionBy("code").orderBy(F.xxhash64("id"), "id")
    counted = labelled.groupBy("code").agg(F.count("*").alias("n"))
    rate = labelled.join(F.broadcast(counted), "code").where(
        (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)) <= F.greatest(F.lit(4.0 * sample_docs), F.lit(0.0)) / F.col("n")
    )
    chosen = rate.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample_docs).select("id", "code")
    rows = bounded_rows(
        documents.select(F.col(doc_id).alias("id"), F.substring(text, 1, SAMPLE_CHARS).alias("t")).where("t is not null").join(F.broadcast(chosen), "id").select("code", "t"),
        sample_docs * len(LANGS) * 4, "the sample of labelled documents",
    )
    return dictionaries([(r[0], r[1]) for r in rows])


def dictionaries(labelled: list[tuple[str, str]]) -> dict[str, bytes]:
    """Dictionaries from (language, text) pairs, each of at most ``DICT_BYTES``."""
    from unicodedata import normalize

    sample: dict[str, list[str]] = {code: [] for code in LANGS}
    for code, t in sorted(labelled):
        sample[code].append(DIGITS.sub("0", normalize("NFKC", t).lower()))
    kept = clean_sample(sample)
    return {code: "\n".join((*_thinned(kept[code], DICT_BYTES - len(SEED[code].encode())), SEED[code])).encode() for code in LANGS}


def _thinned(lines: list[str], most: int) -> list[str]:
    """Lines of at most ``most`` bytes together, taken evenly from all of them."""
    sizes = [len(x.encode()) + 1 for x in lines]
    total, passed, kept, out = sum(sizes), 0, 0, []
    for line, size in zip(lines, sizes, strict=True):
        passed += size
        if total <= most or kept + size <= most * passed // total:
            kept += size
            out.append(line)
    return out


class Classifier:
    """Chooses the language of sentences; made once per task from the dictionaries."""

    def __init__(self, dictionaries_: dict[str, bytes]) -> None:
        def compressor(raw: bytes, **params: int) -> zs.ZstdCompressor:
            p = zs.ZstdCompressionParameters.from_level(params.pop("level"), write_content_size=False, write_dict_id=False, **params)
            d = zs.ZstdCompressionDict(raw, dict_type=zs.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            return zs.ZstdCompressor(dict_data=d, compression_params=p)

        self.fast = {k: compressor(v, level=1) for k, v in dictionaries_.items()}
        # short sentences need matches of three bytes
        self.fine = {k: compressor(v, level=5, min_match=3, strategy=zs.STRATEGY_BTOPT, search_log=4, target_length=32) for k, v in dictionaries_.items()}
        self.plain = zs.ZstdCompressor(compression_params=zs.ZstdCompressionParameters.from_level(1, write_content_size=False))
        # whole sentences that one language alone has: what compression would find, for sentences too short for margins
        self.known: dict[str, str | None] = {}
        for code, raw in dictionaries_.items():
            for line in raw.decode("utf-8", "ignore").split("\n"):
                if len(line) <= 40 and ends(line):
                    flat = UNWORD.sub("", line)
                    self.known[flat] = code if self.known.get(flat, code) == code else None
        self.memo: dict[str, tuple[str | None, float]] = {}

    @staticmethod
    def candidates(text: str) -> tuple[str, ...]:
        script = script_of(text)
        # a sentence of five ideographs without kana is not Japanese
        return ("zh",) if script == "han" and len(text) >= 5 and len(SCRIPTS[1][1].findall(text)) >= 5 else BY_SCRIPT[script]

    def holds(self, sentence: str, code: str) -> bool:
        """Whether a sentence stands in one language's dictionary alone, as a whole."""
        return self.known.get(UNWORD.sub("", sentence)) == code

    def __call__(self, sentence: str) -> tuple[str | None, float]:
        """(language, confidence) of a sentence in lower case with digits as 0; no language where the margin is narrow."""
        got = self.memo.get(sentence)
        if got is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            got = self.memo[sentence] = self._judge(sentence)
        return got

    def _judge(self, sentence: str) -> tuple[str | None, float]:
        words = UNWORD.sub(" ", sentence).strip()
        codes = self.candidates(words)
        latin = codes is BY_SCRIPT["latin"]
        if latin or codes == ("ru",) or codes == ("ko",):
            distinct = set(words.split())
            if len(distinct) < 2 or len(words) < 5:
                return None, 0.0
        elif len(words) < 2:  # no blanks between words
            return None, 0.0
        if len(words) <= 24 and not latin and codes != ("ru",) and len(codes) > 1 and (known := self.known.get(UNWORD.sub("", sentence))):
            return known, KNOWN
        raw = sentence.encode()
        if len(codes) == 1:
            # its script decides; what the dictionary saves is the confidence
            base, size = len(self.plain.compress(raw)), len(self.fast[codes[0]].compress(raw))
            letters = len(words.replace(" ", ""))
            return codes[0], round(max(0.5, min(1.0, 0.6 + (base - size) / max(base, 1))), 4) if letters >= 3 else 0.5
        sizes = sorted((len(self.fast[c].compress(raw)), c) for c in codes)
        (best, code), (second, _) = sizes[0], sizes[1]
        if len(raw) < 28 or second - best < max(4, 0.08 * second):
            fine = {c: len(self.fine[c].compress(raw)) for c in codes}
            both = sorted((n + 2 * fine[c], c) for n, c in sizes)
            (best, code), (second, _) = both[0], both[1]
            if second - best < max(4, 0.05 * second):
                known = self.known.get(UNWORD.sub("", sentence))
                return (known, KNOWN) if known else (None, 0.0)
        return code, round(min(1.0, 0.5 + (second - best) / second), 4)
