"""The states of jobs as a stream: one aggregate per job, kept inside the JVM's state store.

A final state stays: the first of done, error or cancelled counts, whatever comes after it; until then the last event does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINAL = ("done", "error", "cancelled")
STATES = ("queued", "running", *FINAL)


def job_states(events: DataFrame, time: str | None = None, late: str = "1 day") -> DataFrame:
    """Each job's state and page counts after every batch of events (job_id, seq, event), in update mode.

    Events are states, 'page_done' and 'page_failed'. With a ``time`` column events come in windows of a day, and
    those older than ``late`` are dropped with their state; without one the state of every job is kept.
    """
    keys = ["job_id"]
    if time:
        events = events.withWatermark(time, late).withColumn("day", F.window(time, "1 day"))
        keys.append("day")
    is_state, is_final = F.col("event").isin(*STATES), F.col("event").isin(*FINAL)
    states = events.groupBy(*keys).agg(
        F.coalesce(F.min_by("event", F.when(is_final, F.col("seq"))), F.max_by("event", F.when(is_state, F.col("seq")))).alias("status"),
        F.count_if(F.col("event") == "page_done").alias("n_done"), F.count_if(F.col("event") == "page_failed").alias("n_failed"),
    )
    return states.select("job_id", "status", "n_done", "n_failed", F.coalesce(F.col("status").isin(*FINAL), F.lit(False)).alias("finished"))
