import pytest

from komagrid.llm import lang, lines, pairs
from tests_llm_samples import SAMPLES

SCHEMA = "record_kind string, record_id long, source string, translation string, target_lang string, manga_id string, extra int"
TITLES = {"m": lines.Title("thegardenofkazu", "garden")}
JA = "雨は朝までにやむだろう。渡し船に乗るお金が足りない。"
EN = "The rain will stop before morning. We don't have enough money for the ferry."
CASES = [
    (JA, EN, None), (JA, None, "empty"), (JA, " … ", "empty"), (JA, "[untranslated]", "empty"), (JA, "N/A", "empty"),
    (JA, "I'm sorry, but I can't translate this text.", "refusal"), (JA, "As a language model, this request can't be processed.", "refusal"), (JA, "Yêu cầu dịch này không thể được xử lý.", "refusal"),
    (JA, JA, "copy"), (JA, f"Translation: {JA}", "copy"), ("No tenemos dinero\nsuficiente para el ferri.", '"no tenemos dinero suficiente para el ferri"', "copy"),
    (JA, "Der Regen wird vor dem Morgen aufhören. Wir haben nicht genug Geld für die Fähre.", "wrong_language"), (JA, "비는 아침이 되기 전에 그칠 거야. 배를 탈 돈이 부족해.", "wrong_language"),
    (JA, "The rain will stop before mor", "truncated"), (JA, "The rain will stop before morning.", "truncated"), (JA, "The rain will stop before morning. We don't have...", "truncated"),
    ("雨は朝までにやむだろう", "The rain will stop before morning", None), ("ごめん、君とは一緒に行けない。", "I'm sorry, I can't go with you.", None),
    ("Kazu!", "Kazu!", None), ("Ha ha ha!", "Ha ha ha!", None), ("8?!", "8?!", None), ("- 12 -", "", None), ("The Garden of Kazu / 2", "", None), ("", "", None), (None, None, None), ("…", "", None),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [("region_info", i, s, t, "en", "m", 0) for i, (s, t, _) in enumerate(CASES)]
    rows += [("region_info", 1000 + i, JA if i % 2 else "雨は朝までにやむだろう。", EN if i % 2 else "The rain will stop before morning.", "en", None, 0) for i in range(80)]
    rows += [("context_history", 3, JA, "null", "en", None, 0)] * 2 + [("context_history", None, JA, "", "en", None, 0)]
    return pairs.defects(spark.createDataFrame(rows, SCHEMA), lang.dictionaries(SAMPLES), TITLES).collect()


def test_defects(found):
    got = {r.record_id: r.defect for r in found if r.record_kind == "region_info"}
    expected = {i: d for i, (_, _, d) in enumerate(CASES) if d}
    assert {i: (CASES[i], got.get(i)) for i in set(got) | set(expected) if i < 1000 and got.get(i) != expected.get(i)} == {}
    assert not [i for i in got if i >= 1000]


def test_repeated_records_count_once(found):
    assert [(r.record_id, r.defect) for r in found if r.record_kind == "context_history"] == [(3, "empty")]


def test_empty_table(spark):
    assert pairs.defects(spark.createDataFrame([], SCHEMA), lang.dictionaries([]), {}).count() == 0


def test_long_texts(spark):
    text = "The rain will stop before morning. " * 5000
    rows = [("region_info", 1, text, text, "vi", None, 0), ("region_info", 2, JA * 2000, EN * 2000, "en", None, 0)]
    got = {r.record_id: r.defect for r in pairs.defects(spark.createDataFrame(rows, SCHEMA), lang.dictionaries(SAMPLES), {}).collect()}
    assert got == {1: "copy"}


def test_contexts_are_counted_exactly(spark):
    # two contexts that shared one of 65,536 buckets
    import zlib

    first: dict[int, str] = {}
    for n in range(10_000):
        two = f"w{n} kazu"
        other = first.setdefault(zlib.crc32(two.encode()) % 65_536, two)
        if other != two:
            break
    rows = [("region_info", i, JA, f"The rain says {x}.", "en", None, 0) for i, x in enumerate([two] * 6 + [f"{other} again"] * 4)]
    contexts, _ = pairs.corpus_statistics(spark.createDataFrame(rows, SCHEMA), frozenset())
    assert {r.k: (r.n, r.final) for r in contexts.collect() if r.k in (two, other)} == {two: (6, 6), other: (4, 0)}


def test_hostile_words_are_read_once():
    import time

    from komagrid.llm import lines

    began = time.perf_counter()
    assert pairs.SOUND.match("ha" * 10_000)
    assert not pairs.SOUND.match("ha" * 10_000 + "z")
    assert not pairs.SOUND.match("heh" * 10_000 + "z")
    assert not lines.is_header("a" + "1" * 10_000 + "b", None, frozenset({"somewhere"}))
    assert not lines.is_page_number("1 " * 10_000 + "x")
    assert time.perf_counter() - began < 0.5


def test_headers_of_any_length():
    from komagrid.llm import lines

    long_title = "the very long tale " * 12
    title = lines.Title(lines.squash(long_title), "tale")
    assert lines.is_header(long_title + " Chapter 12", title)
    assert lines.is_header(long_title + " Chapter 12", None, frozenset({title.flat}))
    assert lines.is_header("Chapter 3 Blade 2 p 17", None, frozenset({"blade2"}))
    short = lines.Title("run", "run", True)
    assert lines.is_header("Run - Chapter 5", short) and not lines.is_header("Run!", short)
    assert lines.is_header("銀色の森 第3話", lines.Title("銀色の森", "銀色の森"), most_rest=40)
    assert lines.is_page_number("- - - - - - - - - - - - 112 - - - - - - - - - - -")


PROMPT = "the rain will stop before morning. we don't have enough money for the ferry."


@pytest.mark.parametrize(
    ("text", "copy"),
    [
        (PROMPT, True), ("the rain will stop before morning! we don't have enough money... for the ferry", True), ("the rain will stop before the morning. we do not have enough money for a ferry.", True),
        ("the rain will stop before morning. we don't have enough money", True), ("mưa sẽ tạnh trước khi trời sáng. chúng ta không đủ tiền đi phà.", False),
        ("la pluie va s'arrêter avant le matin. nous n'avons pas assez d'argent.", False), ("morning", False), ("", False),
    ],
)
def test_copies_by_compression(dictionaries, text, copy):
    judge = pairs.Judge(dictionaries, {}, {})
    assert judge.copied(lines.squash(PROMPT), lines.squash(text)) == copy


@pytest.mark.parametrize(
    ("text", "refusal"),
    [
        ("i'm sorry, but i can't help with translating this content.", True), ("this request can't be processed.", True), ("i must decline to translate the passage.", True),
        ("i'm sorry, i can't go with you.", False), ("the translation club can't meet in the tower because the old lighthouse keeper has lost every single key he had.", False),
    ],
)
def test_refusals_by_dictionary(dictionaries, text, refusal):
    assert pairs.Judge(dictionaries, {}, {}).refusal(text) == refusal
