import threading
import time

from pyspark.sql import functions as F

from komagrid.functions import geometry as g
from komagrid.operators import ocr
from komagrid.operators import translation as tr
from komagrid.sources import catalogue as cat


def test_a_failed_address_is_resolved_once_more(spark):
    def get(url):
        if "stale" in url:
            raise OSError("gone")
        return url.encode()

    pages = spark.createDataFrame([("c", 1, "http://a/1"), ("c", 2, "http://stale/2"), ("d", 1, "http://stale/stale")], "chapter_id string, page int, url string")
    got = {(r.chapter_id, r.page): (bytes(r.content) if r.content else None, r.error) for r in cat.download(pages, lambda c, p: f"http://{'stale' if c == 'd' else 'b'}/{p}", get).collect()}
    assert got == {("c", 1): (b"http://a/1", None), ("c", 2): (b"http://b/2", None), ("d", 1): (None, "OSError: gone")}


def test_requests_of_all_threads_are_apart():
    began = time.monotonic()
    threads = [threading.Thread(target=cat.Turns.wait, args=(0.05,)) for _ in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert time.monotonic() - began >= 0.2


def test_pauses():
    assert cat.pause_asked({"X-RateLimit-Retry-After": "130"}, 0, lambda: 100.0) == 30.0
    assert cat.pause_asked({"Retry-After": "7"}, 1) == 7.0 and [cat.pause_asked({}, i) for i in range(3)] == [1.0, 2.0, 4.0]


def test_a_page_is_sent_once_though_batches_cut_it(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = spark.createDataFrame([(str(p), o, f"t{o}") for p in range(3) for o in range(8)], "page string, ord int, text string")
        backends = tr.Backends({"count": lambda texts, src, dst, context=None: [f"{len(texts)}"] * len(texts)})
        assert {r.translation for r in tr.translate(rows, "es", "en", backends, "count")[0].collect()} == {"8"}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_context_of_pages_without_pairs(spark):
    pairs = [("c", p, p * 10 + i, f"s{p}.{i}", "t" if p != 2 else "") for p in range(1, 6) for i in range(3)]
    got = {r.page: [h.source for h in r.history] for r in tr.rolling_context(spark.createDataFrame(pairs, "chapter_id string, page int, seq int, source string, translation string"), most=4).collect()}
    assert got == {1: [], 2: ["s1.0", "s1.1", "s1.2"], 3: ["s1.0", "s1.1", "s1.2"], 4: ["s1.2", "s3.0", "s3.1", "s3.2"], 5: ["s3.2", "s4.0", "s4.1", "s4.2"]}


def test_boxes_from_fractions(spark):
    row = spark.range(1).select(g.from_center(F.lit(0.5), F.lit(0.5), F.lit(0.2), F.lit(0.4), F.lit(100), F.lit(200)).alias("b")).first()
    assert tuple(row.b) == (40, 60, 60, 140)


def test_corrections_take_the_first_step_that_answers(spark):
    freq = spark.createDataFrame([("en", "house", 5.0), ("en", "mouse", 4.0), ("en", "rare", 1.0)], "lang string, word string, zipf double")
    words = spark.createDataFrame([("en", "nouse"), ("en", "NOUSE"), ("en", "rnouse"), ("en", "house"), ("xx", "nouse"), ("en", "zzzz")], "lang string, word string")
    got = {(r.lang, r.word): r.corrected for r in ocr.correct_words(words, freq).collect()}
    assert got == {("en", "nouse"): "house", ("en", "NOUSE"): "HOUSE", ("en", "rnouse"): "mouse", ("en", "house"): "house", ("en", "zzzz"): "zzzz"}
