from komagrid.streaming import jobs


def test_states_of_a_stream(spark, tmp_path):
    first = [("a", 0, "queued"), ("a", 1, "running"), ("a", 2, "page_done"), ("b", 0, "queued")]
    second = [("a", 3, "page_failed"), ("a", 4, "done"), ("b", 1, "cancelled"), ("b", 2, "running")]
    schema = "job_id string, seq int, event string"
    folder = str(tmp_path / "events")
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(folder)
    stream = jobs.job_states(spark.readStream.schema(schema).parquet(folder))
    query = stream.writeStream.format("memory").queryName("job_states").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        spark.createDataFrame(second, schema).coalesce(1).write.mode("append").parquet(folder)
        query.processAllAvailable()
    finally:
        query.stop()
    rows = {tuple(r) for r in spark.table("job_states").collect()}
    assert rows == {("a", "running", 1, 0, False), ("b", "queued", 0, 0, False), ("a", "done", 1, 1, True), ("b", "cancelled", 0, 0, True)}
