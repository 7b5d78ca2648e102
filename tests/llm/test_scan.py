import random

from komagrid.llm import lines, scan

SCHEMA = "region_id long, manga_id string, text string, translation string, extra int"
TITLES = {"m": lines.Title("thegardenofkazu", "garden")}
BASE = ["The rain will stop before morning.", "My hands are shaking again.", "We don't have enough money for the ferry.", "Guarda-chuva vermelho, peut-être.", "Close the window before the clock tower wakes up.", "この扉に書かれた文字が読めない。"]


def table(spark, rows):
    filler = [(1000 + i, "m", BASE[i % len(BASE)], BASE[(i + 1) % len(BASE)], 0) for i in range(300)]
    return spark.createDataFrame([(*r, 0) for r in rows] + filler, SCHEMA)


CASES = [
    (1, "m", "The ra-\nin will stop before morning.", None, {"hyphen_break"}),
    (2, "m", "My hands are sha- king again.", None, {"hyphen_break"}),
    (3, "m", "Guarda-\nchuva vermelho.", None, set()),
    (4, "m", "M-My hands are shaking again.", None, set()),
    (5, "m", "My hands are - shaking again.", None, set()),
    (6, "m", "We don't have en0ugh money for the ferry.", None, {"misread"}),
    (7, "m", "Close the vvindow before the clock tower wakes up.", None, {"misread"}),
    (8, "m", "My hands ¦¦ are shaking again.", None, {"misread"}),
    (9, "m", "The Garden of Kazu / 2\nMy hands are shaking again.", None, {"running_header"}),
    (10, "m", "- 59 -", None, {"page_number"}),
    (11, "m", "My hands are shaking again.\n126 |", None, {"page_number"}),
    (12, "m", "8?!", None, set()),
    (13, "m", "|~^*", None, set()),
    (14, "m", "この扉に書かれた文字が読ぬない。", None, {"misread"}),
    (15, None, "", "", set()),
    (16, None, None, None, set()),
    (17, "m", "The tower of 2 clocks (3 bells) costs 5 coins.", None, set()),
    (18, "m", "x" * 100_000, None, set()),
    (19, "m", "the mp3s and b2b and h2o here.", None, set()),
    (20, "m", "My rain-\nhands are shaking again.", None, set()),
    (21, "m", "I-\nI don't have enough money for the ferry.", None, set()),
    (22, "m", "My hands are sha-\nk1ng again.", None, {"hyphen_break", "misread"}),
    (23, "m", "My hands are sh\u0130-\nking again.", None, {"hyphen_break"}),
]


def test_noise(spark):
    df = table(spark, [c[:4] for c in CASES] + [CASES[0][:4]])
    got = {}
    for r in scan.find(df, TITLES).where("region_id < 1000").collect():
        assert r.field == "text"
        got.setdefault(r.region_id, set()).add(r.noise)
    assert got == {c[0]: c[4] for c in CASES if c[4]}


def test_translation_field(spark):
    df = table(spark, [(1, "m", "My hands are shaking again.", "p. 12")])
    assert {tuple(r) for r in scan.find(df, TITLES).where("region_id < 1000").collect()} == {(1, "translation", "page_number")}


def test_repair(spark):
    rows = [(1, "m", "The Garden of Kazu / 2\nThe ra-\nin will\nstop before morning.\n126 |", None), (2, "m", "Close the VVindow before the clock tower ¦ wakes up.", ""), (3, None, None, "|~")]
    got = {r.region_id: (r.text, r.translation) for r in scan.repaired(table(spark, rows), TITLES).where("region_id < 1000").collect()}
    assert got == {1: ("The rain will stop before morning.", None), 2: ("Close the Window before the clock tower wakes up.", ""), 3: (None, "|~")}


def test_compounds_and_stammering_stay(spark):
    rows = [(1, "m", "He is well-\nknown here.", None), (2, "m", "I-\nI don't know.", None), (3, "m", "We don't have en0ugh mo-\nney for the ferry ¦ now.", "Cl0se the win-\ndow!")]
    rows += [(10, "m", "All is well and known, I say.", None)]
    got = {r.region_id: (r.text, r.translation) for r in scan.repaired(table(spark, rows), TITLES).where("region_id < 10").collect()}
    assert got[1][0] == "He is well-known here." and got[2][0] == "I-I don't know."
    assert got[3] == ("We don't have enough money for the ferry now.", "Close the window!")


def test_verdicts_by_join_give_the_same(spark, monkeypatch):
    """Beyond MOST_VERDICTS each text gets its own verdicts by join: the same noise and the same repaired texts."""
    # a misread word that is cut as well: its two verdicts must meet
    rows = [c[:4] for c in CASES] + [(30, "m", "Close the vvin-\ndow before the clock tower wakes up.", "The Garden of Kazu\nMy hands are sha-\nking agaln.")]
    rows += [(i, "m", "Close the vvindow before the clock tower wakes up.", None) for i in range(31, 34)]
    df = table(spark, rows)
    whole, texts = (sorted(map(repr, f(df, TITLES).collect())) for f in (scan.find, scan.repaired))
    monkeypatch.setattr(scan, "MOST_VERDICTS", 0)
    assert sorted(map(repr, scan.find(df, TITLES).collect())) == whole
    assert sorted(map(repr, scan.repaired(df, TITLES).collect())) == texts


def test_rare_windows_have_evidence(spark):
    """A misread character is found where its window is rare, if the halves on both sides say so: in small tables too."""
    names = "トピラカネリダゴミセ"
    base = [f"{a}は扉を開けて{b}を待っている。" for a in names for b in names]
    rows = [(i, "m", t, None, 0) for i, t in enumerate(base)] + [(900, "m", "ラは扉を閉ぬた。", None, 0), (901, "m", "ラほ扉を開けてネを待っている。", None, 0)]
    got = {(r.region_id, r.noise) for r in scan.find(spark.createDataFrame(rows, SCHEMA), {}).collect()}
    assert (901, "misread") in got and {i for i, _ in got} <= {900, 901}


def test_anagram_differences():
    r = random.Random(1)
    for kind, right, wrong, d, _ in scan.confusions():
        if kind == "w":
            word = "".join(r.choice("abcdef") for _ in range(4))
            assert (scan.anagram(word + wrong) + d) % scan.P == scan.anagram(word + right)
    assert scan.anagram("tops") == scan.anagram("stop") and (scan.anagram("다") != scan.anagram("디"))


def test_empty(spark):
    assert scan.find(spark.createDataFrame([], SCHEMA), {}).count() == 0


def test_hostile_texts_are_read_once():
    import time

    began = time.perf_counter()
    repairer = scan.Repairer({}, {"w": {"k1ng": "king"}})
    for text in ("x" * 50_000 + " 5-5", "1" * 50_000 + " a", "~" * 50_000 + "a", "a-" * 20_000, "[" * 50_000, "-\n" * 20_000):
        repairer.noise(text, None)
        repairer.repair(text, None)
        scan.windows(text)
    assert time.perf_counter() - began < 5
