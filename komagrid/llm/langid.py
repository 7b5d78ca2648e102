"""Missing or wrong language labels, and the languages of mixed texts, by compression classification.

Every sentence of every text is encoded with each language's dictionary (``lang``); the smallest wins unless the margin is
narrow. A record's language is that of most of its text; it is mixed if two languages have a whole sentence each.

Defined results: a null, empty or wordless text has no language and no issue; a label in another spelling or of a regional
variant is right; a label that names no language is missing; the label of a mixed text is not judged; repeated rows
give one row each (a region that was delivered again adds to its chapter's letters once more); texts of any length are read whole, sentence by sentence.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from komagrid.llm import codepoints, lang, lines
from komagrid.session import cut, spread

#: Share of a record's judged text that its language must have.
MAJORITY = 0.6
MIN_CONFIDENCE = 0.54


def is_whole(sentence: str, code: str) -> bool:
    """Whether a judged sentence is a whole one that makes a mix: it ends, and is more than a borrowed word."""
    if not lang.ends(sentence):
        return False
    words = lang.UNWORD.sub(" ", sentence).split()
    if code in ("ja", "zh"):
        return sum(map(len, words)) >= 5
    return len(words) >= (2 if code in ("ko", "ru") else 3) and sum(map(len, words)) >= 8


def judge(parts: list[str], classify: lang.Classifier) -> tuple[dict[str, float], list[str], list[tuple[str, str | None, float]]]:
    """(letters by language, languages with a whole sentence, (sentence, language, confidence)) of a text's sentences."""
    weight: dict[str, float] = defaultdict(float)
    whole: dict[str, bool] = {}
    each = []
    for s in parts:
        code, confidence = classify(s)
        each.append((s, code, confidence))
        if code and confidence >= MIN_CONFIDENCE:
            weight[code] += len(s)
            if code not in whole and (is_whole(s, code) or (lang.ends(s) and classify.holds(s, code))):
                whole[code] = True
    return weight, list(whole), each


def prepared(texts: list[str]) -> list[str]:
    return [lang.DIGITS.sub("0", t.lower()) for t in texts]


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def document_languages(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """(doc_id, label, lang, share, confidence, mixed) of each document; lang null where no sentence could be judged.

    ``docs``: doc_id, lang, text. ``mixed`` is the list of languages with a whole sentence, null if fewer than two.
    """
    model = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = lang.Classifier(model.value)
        for batch in batches:
            out = []
            ids, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, label, text in zip(ids, labels, prepared(codepoints.unify_texts(batch.column(2))), strict=True):
                weight, whole, each = judge(lang.document_sentences(text), classify)
                total = sum(weight.values())
                best = max(weight, key=weight.get) if weight else None
                sure = [c * len(s) for s, k, c in each if k == best]
                letters = sum(len(s) for s, k, _ in each if k == best)
                out.append((i, label, best, weight[best] / total if best else None, sum(sure) / letters if best and letters else None, sorted(whole) if len(whole) > 1 else None))
            yield _table(out, ["doc_id", "label", "lang", "share", "confidence", "mixed"], [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.string())])

    rows = docs.select(F.col("doc_id").cast("bigint"), "lang", "text").where("doc_id is not null and text is not null")
    return spread(rows).mapInArrow(run, "doc_id bigint, label string, lang string, share double, confidence double, mixed array<string>")


def segments(texts: DataFrame, dictionaries: dict[str, bytes], titles: dict[str, lines.Title]) -> DataFrame:
    """(record_kind, record_id, segment, lang, confidence, n_sentences): runs of sentences of one language, in order.

    ``texts``: record_kind, record_id, manga_id, text. Documents are read line by line, regions as one paragraph without
    headers and page numbers. A sentence of no language goes with those before it; a text of no language gives one
    segment without one. Repeated rows of one record give the same segments once.
    """
    model = texts.sparkSession.sparkContext.broadcast((dictionaries, titles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify, title = lang.Classifier(model.value[0]), model.value[1]
        for batch in batches:
            out = []
            kinds, ids, manga = (batch.column(k).to_pylist() for k in range(3))
            for kind, i, m, text in zip(kinds, ids, manga, prepared(codepoints.unify_texts(batch.column(3))), strict=True):
                parts = lang.document_sentences(text) if kind == "documents" else lang.sentences(lines.paragraph(lines.body_lines(text, title.get(m)) or [""]))
                runs: list[list] = []
                for s, code, confidence in judge(parts, classify)[2]:
                    if code is None and runs:
                        runs[-1][3] += 1
                    elif runs and runs[-1][0] in (code, None):
                        runs[-1][0] = code
                        runs[-1][1] += confidence * len(s)
                        runs[-1][2] += len(s)
                        runs[-1][3] += 1
                    else:
                        runs.append([code, confidence * len(s), len(s) if code else 0, 1])
                out += [(kind, i, n, code, round(c / w, 4) if w else None, k) for n, (code, c, w, k) in enumerate(runs)]
            yield _table(out, ["record_kind", "record_id", "segment", "lang", "confidence", "n_sentences"], [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32()])

    rows = texts.select("record_kind", F.col("record_id").cast("bigint"), "manga_id", "text").where("record_id is not null and text is not null")
    return spread(rows).mapInArrow(run, "record_kind string, record_id bigint, segment int, lang string, confidence double, n_sentences int").distinct()


def region_languages(regions: DataFrame, dictionaries: dict[str, bytes], titles: dict[str, lines.Title]) -> DataFrame:
    """(kind, key, lang, letters): for each mixed region its languages (kind 'mixed', key region_id), and what the
    regions of each chapter add up to (kind 'chapter', key chapter_id), summed within the batch first.

    ``regions``: region_id, chapter_id, manga_id, text.
    """
    model = regions.sparkSession.sparkContext.broadcast((dictionaries, titles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = lang.Classifier(model.value[0])
        title = model.value[1]
        for batch in batches:
            votes: dict[tuple[str, str], float] = defaultdict(float)
            out = []
            ids, chapters, manga = (batch.column(k).to_pylist() for k in range(3))
            for i, chapter, m, text in zip(ids, chapters, manga, prepared(codepoints.unify_texts(batch.column(3))), strict=True):
                body = lines.body_lines(text, title.get(m))
                if not body:
                    continue
                weight, whole, _ = judge(lang.sentences(lines.paragraph(body)), classify)
                if chapter is not None:
                    for code, w in weight.items():
                        votes[chapter, code] += w
                if len(whole) > 1 and i is not None:
                    out += [("mixed", str(i), code, None) for code in whole]
            out += [("chapter", chapter, code, w) for (chapter, code), w in votes.items()]
            yield _table(out, ["kind", "key", "lang", "letters"], [pa.string(), pa.string(), pa.string(), pa.float64()])

    rows = regions.select("region_id", "chapter_id", "manga_id", "text").where("text is not null")
    return spread(rows).mapInArrow(run, "kind string, key string, lang string, letters double")


def issues(languages: DataFrame, key: str, label: str = "label") -> DataFrame:
    """(key, issue, lang): 'missing' or 'wrong' for records whose language has the majority of their judged text."""
    code = lang.canonical_label(F.col(label))
    judged = languages.where(F.col("lang").isNotNull() & (F.col("share") >= MAJORITY)).withColumn("_code", code)
    return judged.where("_code is null or _code <> lang").select(key, F.when(F.col("_code").isNull(), "missing").otherwise("wrong").alias("issue"), "lang")


def chapter_languages(votes: DataFrame) -> DataFrame:
    """(id, lang, share) of each chapter from the letters of its regions."""
    summed = votes.groupBy("key", "lang").agg(F.sum("letters").alias("letters"))
    return summed.groupBy(F.col("key").alias("id")).agg(
        F.max_by("lang", F.struct("letters", "lang")).alias("lang"), (F.max("letters") / F.sum("letters")).alias("share")
    )


def find(documents: DataFrame, chapters: DataFrame, regions: DataFrame, manga: DataFrame, residue: DataFrame) -> DataFrame:
    """(record_kind, record_id, issue, lang) over all three tables; ``residue`` has the doc_ids left out."""
    dictionaries = lang.fit(documents)
    of_docs = cut(document_languages(documents, dictionaries))  # read twice
    bad_label = issues(of_docs.where("mixed is null"), "doc_id")
    mixed = of_docs.where("mixed is not null").select("doc_id", F.lit("mixed").alias("issue"), F.explode("mixed").alias("lang"))
    doc_rows = bad_label.unionByName(mixed).join(residue.select("doc_id"), "doc_id", "left_anti")
    of_regions = cut(region_languages(regions, dictionaries, lines.titles(manga)))
    region_rows = of_regions.where("kind = 'mixed'").select(F.col("key").cast("bigint").alias("record_id"), F.lit("mixed").alias("issue"), "lang")
    by_chapter = chapter_languages(of_regions.where("kind = 'chapter'"))
    records = chapters.select("record_id", "id", F.col("language").alias("label")).where("record_id is not null")
    chapter_rows = issues(records.join(by_chapter, "id"), "record_id")
    return (
        doc_rows.select(F.lit("documents").alias("record_kind"), F.col("doc_id").alias("record_id"), "issue", "lang")
        .unionByName(region_rows.select(F.lit("region_info").alias("record_kind"), "record_id", "issue", "lang"))
        .unionByName(chapter_rows.select(F.lit("chapters").alias("record_kind"), "record_id", "issue", "lang"))
        .distinct()
    )
