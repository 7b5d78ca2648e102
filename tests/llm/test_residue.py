import pytest

from komagrid.llm import residue as rs

CASES = [
    ("The chapter {{ title }} is out.", "placeholder"), ("Hello %(name)s", "placeholder"), ("[INSERT TITLE HERE]\nok text", "placeholder"), ("${group} wrote this", "placeholder"),
    ("By __AUTHOR__ and others", "placeholder"), ("%TITLE% starts", "placeholder"), ("A {title} here", "placeholder"), ("[Your name] wrote", "placeholder"),
    ("Lorem ipsum dolor sit amet. Amet dolor lorem ipsum velit magna.", "filler"), ("Synopsis goes here.", "filler"), ("xxx xxx xxx xxx", "filler"), ("Item A: TBD\nItem B: TBD", "filler"),
    ("Error 503: something went wrong.", "error_page"), ("404 Not Found\nThe page you requested could not be located on this server.", "error_page"), ("エラー504：お探しのページは見つかりませんでした。", "error_page"),
    ("He ran.\nService temporarily unavailable\nShe ran.", "error_page"), ("Please enable JavaScript to view this page.", "script_notice"), ("Vui lòng bật JavaScript để xem trang này.", "script_notice"),
    ("Kari wrote {quietly} in the margin.", None), ("It was 100% the baker's idea, told us <3.", None), ("The robot only says 'error' when it is hungry.", None), ("Room 404 is at the end of the corridor.", None),
    ("A sign reads: service unavailable until spring.", None), ("The old knight Sir Lorem bows.", None), ("She joined the JavaScript club to be near the window seat.", None),
    ("皮诺韦：一、一、一段回忆。", None), ("", None), (None, None), ("x" * 200_000, None),
]


def test_cases(spark):
    rows = [(i, text, "extra") for i, (text, _) in enumerate(CASES)]
    rows += rows[:2]
    got = {r.doc_id: r.residue for r in rs.residue(spark.createDataFrame(rows, "doc_id long, text string, residue string")).collect()}
    assert got == {i: kind for i, (_, kind) in enumerate(CASES) if kind}


def test_repeated_whole_pages(spark):
    page = "Sorry! Retry later (12)."
    rows = [(1, page), (2, f"My Title\n{page}"), (3, f"One.\nTwo.\n{page}"), (4, "He said retry later."), (5, "Try to reload, she said.\nNo.\nYes.")]
    got = {r.doc_id for r in rs.residue(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got in ({1, 2, 3}, set()) and 5 not in got


def test_slots_by_alignment(spark):
    rows = [(1, "dear {reader} of this"), (2, "dear {viewer} of this"), (3, "so {quietly} it goes"), (4, "so {quietly} it goes")]
    assert {r.doc_id for r in rs.residue(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1, 2}


def test_left_out(spark):
    rows = [(1, "Synopsis goes here."), (2, "A real text."), (None, "no id"), (3, None)]
    kept = rs.without_residue(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 2), (False, 3), (True, None)]


def test_empty(spark):
    assert rs.residue(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("line", ["HTTP 503", "502 Bad gateway", "Access denied.", "服务器繁忙，请稍后再试。"])
def test_openings(line):
    assert [x[0] for x in rs.Scanner()(line)] == ["error_page"]


def test_pages_in_any_wording(spark):
    page, notice, footer = "Your visit has ended. Sign in anew to go on with volume 3.", "Our viewer is idle without JS; switch that on in the settings.", "Powered by pagecache"
    rows = [page, f"My Title\n{page}", f"He ran.\n{page} {footer}\nShe ran.\nNo.", notice, notice, f"One.\n{notice}\nTwo."]
    # prose that repeats alone, with other names and neighbours elsewhere
    rows += ["Readers asked whether Kazu and the captain are related."] * 2 + ["Readers asked whether Pimi and the captain are related. It rains.", "So Readers asked whether Rula and the captain are related."]
    # prose that stands alone at times only
    rows += ["The robot only says beep when it is very hungry."] * 2 + [f"Line {c}.\nThe robot only says beep when it is very hungry.\nEnd {c}." for c in "abcdefg"]
    got = {r.doc_id: r.residue for r in rs.residue(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got == dict.fromkeys(range(3), "error_page") | dict.fromkeys(range(3, 6), "script_notice")


def test_footers_in_the_same_line_and_trace_ids(spark):
    page = "Internal exception while rendering view 'chapter' (trace {})"
    rows = [page.format("7d111cf1"), "My Title\n" + page.format("6eab16"), page.format("49a666") + " Retry\nShe ran.\nNo.\nYes.\nSo.", page.format("1bd848")]
    assert {r.doc_id: r.residue for r in rs.residue(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()} == dict.fromkeys(range(4), "error_page")


@pytest.mark.parametrize(
    ("line", "junk"),
    [
        ("jff wwq sjqflfd qqjdlw kwj slask asdd qqed fee", True), ("Nopizu taught me how to hold a sword and a lamp.", False), ("ref 8tddz agr pg16 nsw19 qqw kkf jjw wqd", False),
        ("Jutro wszystko moze byc inne, powiedzial stary kapitan.", False), ("qwx", False), ("", False),
    ],
)
def test_keys_struck_at_random(line, junk):
    assert rs.is_junk(line.lower()) == junk


def test_a_slot_repeated_by_many_hands(spark):
    """Templates in words that no list holds, repeated thousands of times, are found by repetition alone."""
    rows = [(i, f"Der Vorhang bleibt heute zu, Platz {i}, komm ein andermal wieder.") for i in range(3000)]
    rows += [(5000 + i, f"Erzählung {i}. Der Wind trug den Sand über Haus {i} hinweg, und niemand sprach.\nEin Absatz.\nNoch einer.\nDas Ende {i}.\nNachwort.") for i in range(50)]
    got = {r.doc_id for r in rs.residue(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(range(3000))


def test_windows_by_join_give_the_same(spark, monkeypatch):
    page, footer = "Your visit has ended. Sign in anew to go on with volume 3.", "Powered by pagecache"
    rows = [page, f"My Title\n{page}", f"He ran.\n{page} {footer}\nShe ran.\nNo.", "The stair creaks tonight and nobody is home.", "The stair creaks tonight and nobody is home.", "Kari: The stair creaks tonight and Kazu sleeps.\nOh."]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    held = sorted(map(tuple, rs.residue(docs).collect()))
    monkeypatch.setattr(rs, "MOST_WINDOWS", 0)
    assert sorted(map(tuple, rs.residue(docs).collect())) == held and {i for i, _ in held} >= {0, 1, 2}
