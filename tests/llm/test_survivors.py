import datetime as dt
import random

from pyspark.sql import functions as F

from komagrid.llm import codepoints
from komagrid.llm import survivors as sv

SCHEMA = "record_id long, id string, manga_id string, language string, chapter string, group_name string, volume string, title string, pages int, feed_id int, updated_at timestamp, fetched_at timestamp"
DAY = dt.datetime(2025, 1, 1)


def record(n, id_, chapter="1", group="Copper Finch", feed=1, day=0, volume="1", title="T", pages=20, manga="m", language="en"):
    return (n, id_, manga, language, chapter, group, volume, title, pages, feed, DAY + dt.timedelta(days=day), DAY)


def feeds(spark):
    return spark.createDataFrame([(1, 5), (2, 4), (3, 1)], "feed_id int, trust int")


def test_keys(spark):
    rows = [(x,) for x in (" 1", "1.0", "001", "Ch. 1", "#1", "１", "1.50", "0", "-", "N/A", "", None, "Extra")]
    unified = lambda rows: codepoints.unified_columns(spark.createDataFrame(rows, "c string"), ["c"])
    got = [r[0] for r in unified(rows).select(sv.number_key(F.col("c"))).collect()]
    assert got == ["1"] * 6 + ["1.5", "0", None, None, None, None, "extra"]
    names = [(x,) for x in ("[Copper-Finch]", "COPPER FINCH", "Ｃｏｐｐｅｒ Finch.", "Cорper​ Finch", "none", "!!")]
    assert [r[0] for r in unified(names).select(sv.name_key(F.col("c"))).collect()] == ["copperfinch"] * 4 + [None, None]


def test_spelling(spark):
    names = ["copperfinch"] * 9 + ["coppperfinch", "coppefrinch", "copperfinches", "nothing"]
    got = {r.n: r.spelled for r in sv.spelling_keys(spark.createDataFrame([(n,) for n in names], "n string"), "n").collect()}
    assert got["coppperfinch"] == got["coppefrinch"] == "copperfinch" and got["copperfinches"] == "copperfinches" and got["nothing"] == "nothing"


def test_components_against_union_find(spark):
    r = random.Random(6)
    edges = [(f"a{r.randint(0, 60)}", f"b{r.randint(0, 60)}") for _ in range(70)] + [(f"c{i}", f"d{i + j}") for i in range(30) for j in (0, 1)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    got = {x.l: x.label for x in sv.components(spark.createDataFrame(edges, "l string, r string"), "l", "r").collect()}
    left = sorted({a for a, _ in edges})
    # what is connected with no other has no label
    assert set(got) == {a for a in left if any(b != a and root(b) == root(a) for b in left)} or set(got) <= set(left)
    for a in left:
        for b in left:
            assert (got.get(a, a) == got.get(b, b)) == (root(a) == root(b))


def releases(spark, rows):
    members = sv.prepare(spark.createDataFrame(rows, SCHEMA), feeds(spark))
    return members, sv.survivors(members)


def test_representatives(spark):
    rows = [
        record(1, "x", day=5), record(2, "x", day=3, feed=2, title=""), record(3, "y", "1.0", "COPPER FINCH", day=4, feed=1), record(4, "y", None, None, day=1),
        record(10, "p", manga="n", day=1), record(11, "p", manga="n", day=2, feed=3), record(20, "q", manga="o"), record(20, "q", manga="o"),
        record(30, "r", manga="k", day=1), record(31, "r", manga="k", day=1), record(40, None, "2", "Z", manga=None), record(41, None, None, None, manga="l", pages=0),
    ]
    members, surviving = releases(spark, rows)
    assert sorted(r.record_id for r in sv.representatives(members, surviving).collect()) == [1, 30, 31]
    assert surviving.count() == 6
    assert members.count() == 11


def test_survivor_values(spark):
    r = random.Random(7)
    rows, n = [], 0
    for release in range(150):
        true = r.randint(10, 60)
        for feed, error in ((1, 0.02), (2, 0.05), (3, 0.6)):
            n += 1
            pages = true if r.random() > error else r.randint(70, 90)
            rows.append(record(n, f"i{release}", manga=f"m{release}", feed=feed, pages=pages))
        rows[-1] = rows[-1][:-3] + (3, DAY + dt.timedelta(days=9), DAY)
    truth = {}
    for x in rows:
        truth.setdefault(x[2], []).append(x[8])
    _, surviving = releases(spark, rows)
    facts = sv.claims(_.where("not alone"))
    sens, spec, _p = sv.fit_quality(facts)
    assert sens["pages", "1"] > sens["pages", "3"] and spec["pages", "1"] > spec["pages", "3"]
    got = [x.pages for x in surviving.collect()]
    assert len(got) == 150 and sum(p <= 60 for p in got) >= 145


def test_the_likeliest_value_beats_the_majority(spark):
    """Two careless sources that agree on a wrong page count do not outvote the one that is always right."""
    r = random.Random(3)
    rows, n = [], 0
    for release in range(400):
        true = r.randint(10, 60)
        wrong = true + 100  # the same mistake
        said = {1: true, 2: true, 3: true, 4: wrong if r.random() < 0.5 else true}
        said[5] = wrong if r.random() < 0.5 else true
        if said[4] == said[5] == wrong and r.random() < 0.3:  # the two careless ones against one careful one
            said = {1: true, 4: wrong, 5: wrong}
        for feed, pages in said.items():
            n += 1
            rows.append(record(n, f"i{release}", manga=f"m{release}", feed=feed, pages=pages))
    members = sv.prepare(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(f, 1) for f in range(1, 6)], "feed_id int, trust int"))
    got = [x.pages for x in sv.survivors(members).collect()]
    assert sum(p <= 60 for p in got) >= 390


def test_single_records_survive_as_they_are(spark):
    _, surviving = releases(spark, [record(1, "x", pages=0, volume="n/a"), record(2, "y", "7", manga="q")])
    got = {r.release_id: (r.n_records, r.chapter, r.group_name, r.pages, r.volume, r.all_chapter, r.all_pages) for r in surviving.collect()}
    assert got == {1: (1, "1", "Copper Finch", None, None, ["1"], None), 2: (1, "7", "Copper Finch", 20, "1", ["7"], ["20"])}


def test_empty(spark):
    members, surviving = releases(spark, [])
    assert surviving.count() == 0 and sv.representatives(members, surviving).count() == 0
