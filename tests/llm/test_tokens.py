from pathlib import Path

import pytest

from komagrid.llm import packing, tokens

FOLDER = Path("/opt/tokenizers")
TEXTS = ["The rain will stop.", "", None, "雨は朝までにやむ。", "<|endoftext|>", "a" * 20_000]


def test_bytes(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r["size"] for r in tokens.with_sizes(df, tokens.BYTES).collect()}
    assert got == {i: None if t is None else len(t.encode()) for i, t in enumerate(TEXTS)}
    with pytest.raises(ValueError, match="already"):
        tokens.with_sizes(df, tokens.BYTES, size="text")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"])
def test_tokenizers(spark, name):
    if not (FOLDER / name).exists():
        pytest.skip("no vocabulary files")
    import public_tokenizers

    pattern = public_tokenizers.PATTERN if name.endswith(".tiktoken") else None
    df = spark.createDataFrame(list(enumerate(TEXTS[:5])), "doc_id long, text string")
    got = {r.doc_id: r["size"] for r in tokens.with_sizes(df, str(FOLDER / name), pattern=pattern).collect()}
    assert got[1] == 0 and got[2] is None and 4 <= got[0] <= 8 and got[4] > 1
    specs = spark.createDataFrame([("s", 8)], "spec_name string, capacity long")
    placed = packing.pack(tokens.with_sizes(df, str(FOLDER / name), pattern=pattern), specs, size="size")
    assert {r.doc_id for r in placed.collect()} == {0, 1, 2, 3, 4}


def test_unknown_kind():
    with pytest.raises(ValueError, match="unknown"):
        tokens.counter("vocab.txt")
