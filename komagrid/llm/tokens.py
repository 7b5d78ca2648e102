"""Sizes of texts in tokens of a public tokenizer, for packing and mixing by another tokenizer than the table's own.

The vocabulary file stays where it is; its path is a parameter and must be readable on every worker. Special tokens'
strings inside a text count as ordinary text. Defined results: a null text has a null size, an empty one 0.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BYTES = "bytes"


def counter(path: str, pattern: str | None = None) -> Callable[[list[str]], list[int]]:
    """A function from texts to their numbers of tokens; the kind of file is told by its ending.

    ``pattern`` splits words for rank files (.tiktoken); ``BYTES`` as a path counts UTF-8 bytes.
    """
    if path == BYTES:
        return lambda texts: [len(t.encode()) for t in texts]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if not pattern:
            raise ValueError("a rank file needs the pattern that splits words")
        encoding = tiktoken.Encoding("sizes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1)]
    raise ValueError(f"unknown kind of tokenizer file: {path}")


def with_sizes(docs: DataFrame, path: str, text: str = "text", size: str = "size", pattern: str | None = None) -> DataFrame:
    """``docs`` with the number of tokens of each text; the column must not exist yet."""
    if size in docs.columns:
        raise ValueError(f"column already there: {size}")
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(size, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, pattern)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            sizes = iter(count([t for t in texts if t is not None]))
            column = pa.array([None if t is None else next(sizes) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, size])

    return docs.mapInArrow(run, schema)
