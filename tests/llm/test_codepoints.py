import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from komagrid.llm import codepoints as cp


def forms(text):
    _, _, found = cp.unify(pa.array([text], pa.string()))
    return {name for i, name in enumerate(cp.FORMS) if found[0] >> i & 1}


@pytest.mark.parametrize(
    ("text", "unified", "found"),
    [
        ("Ｔｏｓｅ １７", "Tose 17", {"width"}),
        ("ｷﾞﾙﾄﾞの", "ギルドの", {"width"}),
        ("café", "café", {"combining"}),
        ("ậ", "ậ", {"combining"}),
        ("한국".encode().decode(), "한국", set()),
        (unicodedata.normalize("NFD", "한국"), "한국", {"combining"}),
        (unicodedata.normalize("NFD", "ガギ"), "ガギ", {"combining"}),
        ("Ne‌da﻿bo", "Nedabo", {"invisible"}),
        ("a b　c", "a b c", {"space"}),
        ("Kаhami", "Kahami", {"lookalike"}),
        ("Мизy", "Мизу", {"lookalike"}),
        ("ΝO WAΥ", "NO WAY", {"lookalike"}),
        ("誰かセ力を見たか", "誰かセカを見たか", {"lookalike"}),
        ("八ページ、二階、夕飯、力が", "八ページ、二階、夕飯、力が", set()),
        ("「はい！」、1.", "「はい！」、1.", set()),
        ("x̱y", "x̱y", set()),
        ("Привет world", "Привет world", set()),
        ("́", "́", set()),
        ("", "", set()),
        (None, "", set()),
    ],
)
def test_forms(text, unified, found):
    assert cp.unify_texts(pa.array([text], pa.string())) == [unified]
    assert forms(text) == found


@settings(max_examples=2000, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aeoᄀ가ᅡᆨéậ゙̣́̂カ漢​ 😀x")), max_size=6))
def test_batches_are_the_same_as_single_texts(texts):
    together = cp.unify_texts(pa.array(texts, pa.string()))
    assert together == [cp.unify_texts(pa.array([t], pa.string()))[0] for t in texts]


@settings(max_examples=2000, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeoubcvnéậặ́́̂̈ .")))
def test_composition_is_canonical(text):
    got = cp.unify_texts(pa.array([text]))[0]
    assert got == unicodedata.normalize("NFC", text)
    assert cp.unify_texts(pa.array([got]))[0] == got


def test_only_texts_with_another_form_are_rewritten(monkeypatch):
    texts = pa.array(["zz", "plain", None, "Ｔｏｓｅ", "", "đã ổn", "Kаhami", "漢字、한국", "a\u00a0b", "😀", "yy"]).slice(1, 9)
    whole = cp.strings(*cp.unify(texts)[:2]).to_pylist()
    seen = []
    unify = cp.unify
    monkeypatch.setattr(cp, "unify", lambda x: seen.extend(x.to_pylist()) or unify(x))
    assert cp.unify_texts(texts) == whole
    assert seen == ["Ｔｏｓｅ", "Kаhami", "a\u00a0b"]


def test_strings_round_trip():
    texts = ["a", "", "漢字", "😀é", "x" * 100_000]
    points, begins = cp.codepoints(pa.array(texts))
    assert cp.strings(points, begins).to_pylist() == texts
    sliced = pa.array(["zz", *texts, "yy"]).slice(1, len(texts))
    points, begins = cp.codepoints(sliced)
    assert cp.strings(points, begins).to_pylist() == texts


def test_operator(spark):
    rows = [(1, "Ｔ", "keep"), (1, "Ｔ", "keep"), (2, None, None), (3, "plain", "x")]
    df = spark.createDataFrame(rows, "id long, text string, extra string")
    out = cp.with_unified(df, "text").orderBy("id").collect()
    assert [(r.id, r.unified, r.forms, r.extra) for r in out] == [(1, "T", 1, "keep"), (1, "T", 1, "keep"), (2, None, 0, None), (3, "plain", 0, "x")]
    assert [tuple(r) for r in cp.forms_found(df, "text", ["id"]).collect()] == [(1, "width")]
    assert cp.forms_found(df.limit(0), "text", ["id"]).count() == 0
    with pytest.raises(ValueError, match="already"):
        cp.with_unified(df, "text", unified="extra")
