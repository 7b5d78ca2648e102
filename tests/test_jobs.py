import json
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from komagrid.operators import catalogue as c
from komagrid.operators import jobs as j
from komagrid.sources import catalogue as source
from komagrid.sources import images


def test_unique_names_against_plain_python(spark):
    r = random.Random(2)
    batches = [["a_2", "a", "a"], ["A", "a", "a_2", "a"], []] + [[r.choice(["a", "A", "b", "a_2", "a_3", "B_2"]) for _ in range(r.randint(1, 8))] for _ in range(40)]
    expected = []
    for stems in batches:
        used, names = set(), []
        for stem in stems:
            name, n = stem, 2
            while name.lower() in used:
                name, n = f"{stem}_{n}", n + 1
            used.add(name.lower())
            names.append(name)
        expected.append(names)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(batches)], "i int, s array<string>")
    assert [r.n for r in df.orderBy("i").select(j.unique_names_array(F.col("s")).alias("n")).collect()] == expected


def test_upload_names(spark):
    rows = [("b", 0, "x/Page.PNG"), ("b", 1, "y\\page.jpg"), ("b", 2, "???"), ("b", 3, "")]
    got = {r.ord: r.output_name for r in j.upload_names(spark.createDataFrame(rows, "batch_id string, ord int, path string")).collect()}
    assert got == {0: "Page.png", 1: "page_2.jpg", 2: "_.png", 3: "page_004.png"}


def test_uploads(spark):
    rows = [("b", 0, "f/1.png", 10), ("b", 1, "f/1.png", 10), ("b", 2, "f/x.txt", 1), ("b", 3, "f/2.jpg", 21 * 1024 * 1024), ("b", 4, "f/1.png", 11)]
    rows += [("c", i, f"{i}.png", 1) for i in range(502)]
    accepted, counts = j.accept_uploads(spark.createDataFrame(rows, "batch_id string, ord int, path string, size long"))
    got = {r.batch_id: (r.n_accepted, r.bytes, r.n_skipped, r.n_too_big, r.n_duplicate, r.n_over_limit) for r in counts.collect()}
    assert got == {"b": (2, 21, 1, 1, 1, 0), "c": (500, 500, 0, 0, 0, 2)} and accepted.count() == 502
    assert {r.batch_id: r.title for r in j.batch_title(accepted).collect()} == {"b": "f", "c": None}


def test_pages_and_summary(spark):
    outputs = spark.createDataFrame([("/o/001.png",), ("/o/010.jpg",), ("/o/1000.png",), ("/o/pages.zip",)], "path string")
    assert sorted(tuple(r) for r in j.finished_pages(outputs).collect()) == [(0, "001.png"), (9, "010.jpg")]
    jobs = spark.createDataFrame([("a", "running", 4), ("b", "queued", 0)], "id string, status string, total int")
    pages = spark.createDataFrame([("a", 2, "done", 1), ("a", 0, "done", 2), ("a", 1, "failed", None)], "job_id string, page_idx int, state string, n_failed int")
    got = {r.job_id: (r.completed, r.n_failed_pages, r.untranslated, r.progress) for r in j.summary(jobs, pages).collect()}
    assert got == {"a": ([0, 2], 1, 3, 0.75), "b": ([], 0, 0, 0.0)}
    all_pages = spark.createDataFrame([("a", i) for i in range(4)], "job_id string, page_idx int")
    assert sorted(r.page_idx for r in j.todo(all_pages, pages.select("job_id", "page_idx")).collect()) == [3]


def test_status(spark):
    rows = [("a", 0, "queued"), ("a", 1, "running"), ("b", 0, "queued"), ("b", 1, "cancelled"), ("b", 2, "running")]
    got = {r.job_id: r.status for r in j.status_of(spark.createDataFrame(rows, "job_id string, seq int, status string")).collect()}
    assert got == {"a": "running", "b": "cancelled"}
    wanted = spark.createDataFrame([("x", 1), ("x", 1), ("y", 2)], "key string, n int")
    old = spark.createDataFrame([("y", "done"), ("x", "error")], "key string, status string")
    assert [r.key for r in j.new_jobs(wanted, old, ["key"]).collect()] == ["x"]


def test_elapsed(spark):
    rows = [(10.0, 12.25), (10.0, None), (None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "s double, f double").select(j.elapsed(F.col("s"), F.col("f"), F.lit(20.06))).collect()]
    assert got == [2.2, 10.1, 0.0]


def test_files(spark, tmp_path):
    pages = spark.createDataFrame([("001.png", bytearray(b"x")), ("002.jpg", bytearray(b"yy")), ("no/such.png", bytearray(b"z"))], "file_name string, content binary")
    written = {r.file_name: (r.size, r.error is None) for r in j.write_pages(pages, str(tmp_path / "job")).collect()}
    assert written["001.png"] == (1, True) and written["no/such.png"] == (None, False)
    path = j.build_archive(str(tmp_path / "job"), ["001.png", "002.jpg"])
    assert zipfile.ZipFile(path).namelist() == ["001.png", "002.jpg"]
    before = path.stat().st_mtime_ns
    j.build_archive(str(tmp_path / "job"), ["001.png", "002.jpg"])
    assert path.stat().st_mtime_ns == before
    names = [r.name for r in images.in_natural_order(images.read_images(spark, str(tmp_path / "job"))).collect()]
    assert names == ["001.png", "002.jpg"]
    os.utime(tmp_path / "job" / "001.png", (0, 0))
    gone = j.remove_expired(images.read_images(spark, str(tmp_path), recursive=True), 4 * 24 * 3600.0, str(tmp_path))
    assert gone == ["job"] and not (tmp_path / "job").exists()


def test_archive_state(spark):
    pages = spark.createDataFrame([("a", 5.0), ("a", 7.0), ("b", 1.0)], "job_id string, mtime double")
    archives = spark.createDataFrame([("a", 6.0)], "job_id string, mtime double")
    assert {r.job_id: r.stale for r in j.archive_state(pages, archives).collect()} == {"a": True, "b": True}


CHAPTERS = [
    {"id": f"c{i}", "attributes": {"volume": None, "chapter": n, "title": None, "translatedLanguage": lang, "pages": p, "externalUrl": None},
     "relationships": [{"id": "g", "type": "scanlation_group", "attributes": {"name": g}}, {"id": "m1", "type": "manga", "attributes": {"title": {"ko-ro": "K", "xx": "X"}}}]}
    for i, (n, lang, p, g) in enumerate([("10.5", "en", 3, "B"), ("2", "en", 3, "A"), (None, "en", 3, "C"), ("2", "en", 0, "Z"), ("1", "fr", 2, "A")])
]


def test_paged_source_and_order(spark, tmp_path):
    many = CHAPTERS + [{"id": f"x{i}", "attributes": {"translatedLanguage": "de", "pages": 1}, "relationships": []} for i in range(1200)]
    (tmp_path / "manga").mkdir()
    (tmp_path / "manga" / "feed.json").write_text(json.dumps({"data": many}))
    source.register(spark)
    feed = spark.read.format("catalogue").option("root", str(tmp_path)).option("path", "manga/feed").load()
    assert feed.count() == 1205 and feed.rdd.getNumPartitions() == 3
    english = feed.where("language = 'en'")
    assert english.rdd.getNumPartitions() == 1
    chapters = c.readable(c.flatten_chapters(english))
    ordered = chapters.orderBy(c.chapter_key(F.col("chapter"), F.col("group")), "id").collect()
    assert [r.id for r in ordered] == ["c1", "c0", "c2"]
    assert (ordered[0].group, ordered[0].title, ordered[0].manga_id, ordered[0].manga_title) == ("A", "", "m1", "K")
    with pytest.raises(Exception, match="not found"):
        spark.read.format("catalogue").option("root", str(tmp_path)).option("path", "nothing").load().count()


def test_titles(spark):
    rows = [
        ({"title": {"en": ""}, "altTitles": [{"fr": "F"}, {"en": "E"}], "originalLanguage": "ja", "availableTranslatedLanguages": ["vi", None, "en", "vi"]},),
        ({"title": {"fr": "first", "de": "second"}},), ({"title": {}},), ({"title": {"ja-ro": "J", "ko-ro": "K"}},),
    ]
    payloads = spark.createDataFrame([(json.dumps({"id": str(i), "attributes": a}),) for i, (a,) in enumerate(rows)], "payload string")
    got = {r.id: (r.title, r.languages) for r in c.flatten_titles(payloads).collect()}
    assert got == {"0": ("E", ["en", "vi"]), "1": ("first", []), "2": ("Untitled", []), "3": ("J", [])}


def test_page_urls_and_links(spark):
    payload = json.dumps({"baseUrl": "https://n", "chapter": {"hash": "h", "data": ["1.png", "2.png"], "dataSaver": ["1.jpg"]}})
    df = spark.createDataFrame([("c", payload)], "chapter_id string, payload string")
    assert [r.url for r in c.page_urls(df).orderBy("page").collect()] == ["https://n/data/h/1.png", "https://n/data/h/2.png"]
    assert [r.url for r in c.page_urls(df, saver=True).collect()] == ["https://n/data-saver/h/1.jpg"]
    a, b = "0a1b2c3d-0000-4000-8000-0123456789ab", "0a1b2c3d-0000-4000-8000-0123456789ac"
    links = spark.createDataFrame([(a,), (b,), ("zz",)], "link string")
    got = {r.link: (r.kind, r.manga_id, r.chapter_id) for r in c.resolve_links(links, spark.createDataFrame([(b,)], "id string"), spark.createDataFrame([(a, "m")], "id string, manga_id string")).collect()}
    assert got == {a: ("unknown", "m", a), b: ("unknown", b, None), "zz": (None, None, None)}
    fetches = spark.createDataFrame([("https://img.mangadex.org/1",), ("https://node.example/1",), ("bad",)], "url string")
    assert [r.url for r in c.fetch_report(fetches).collect()] == ["https://node.example/1"]
