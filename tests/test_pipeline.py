import sys
import time

from pyspark import cloudpickle
from pyspark.sql import functions as F

from komagrid.functions.geometry import BOX
from komagrid.operators import translation as tr
from komagrid.operators.queue import Job, JobQueue
from komagrid.plans import pipeline

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def loud(texts, src, dst, context=None):
    return [None if "bad" in t else t.upper() for t in texts]


def test_pages(spark):
    bubble, left, right, free = (0, 0, 300, 100), (10, 10, 60, 90), (200, 10, 250, 90), (400, 300, 500, 340)
    detections = spark.createDataFrame([(1, 0, 0, 0.9, bubble), (1, 1, 1, 0.9, left), (1, 2, 1, 0.8, right), (1, 3, 1, 0.9, free), (1, 4, 1, 0.3, (600, 0, 700, 50)), (1, 5, 1, 0.5, left)], f"page_id int, det_ord int, label int, score double, box {BOX}")
    words = [(1, right, 0, 1, 1, 1, "first", 60.0), (1, left, 0, 1, 1, 1, "sec-", 60.0), (1, left, 1, 1, 1, 2, "ond", 60.0), (1, free, 0, 1, 1, 1, "bad", 90.0)]
    tokens = spark.createDataFrame(words, f"page_id int, box {BOX}, tok_ord int, block int, par int, line int, text string, conf double")
    done, cache = pipeline.translate_pages(detections, tokens, "es", "en", tr.Backends({"loud": loud}), "loud", right_to_left=True)
    got = [(r.place, r.text, r.translation, r.failed) for r in done.orderBy("place").collect()]
    assert got == [(0, "first second", "FIRST SECOND", False), (1, "bad", None, True)]
    assert [r.translation for r in cache.collect()] == ["FIRST SECOND"]


def wait(job):
    for _ in range(300):
        if job.status not in ("queued", "running"):
            return job.status
        time.sleep(0.1)
    return job.status


def test_queue(spark):
    jobs, seen = JobQueue(spark), []

    def page(i):
        if i == 1:
            raise ValueError("unreadable")
        return str(spark.range(i + 1).count())

    first = jobs.submit(Job(("a",), lambda job: job.each_page([0, 1, 2], page), on_page=lambda job: seen.append(len(job.pages) + len(job.failed_pages))))
    again = jobs.submit(Job(("a",), lambda job: None))
    broken = jobs.submit(Job(("b",), lambda job: 1 / 0))
    stopped = jobs.submit(Job(("c",), lambda job: job.each_page([0], page)))
    jobs.cancel(stopped.id)
    assert again is first and wait(first) == "done" and first.pages == {0: "1", 2: "3"} and first.failed_pages == [1] and seen == [1, 2, 3]
    assert wait(broken) == "error" and "ZeroDivisionError" in broken.error
    assert wait(stopped) == "cancelled" and stopped.pages == {}
    assert jobs.cancel("none") is None


def test_running_job_is_cancelled(spark):
    jobs = JobQueue(spark)

    def slow(job):
        while not job.cancelled.is_set():
            time.sleep(0.05)
        spark.range(1).where(F.lit(True)).count()

    job = jobs.submit(Job(("slow",), slow))
    while job.status != "running":
        time.sleep(0.05)
    jobs.cancel(job.id)
    assert wait(job) == "cancelled"
