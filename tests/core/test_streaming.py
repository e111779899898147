from pyspark.sql import functions as F

from tidemark.streaming import state, windows


def drain(query):
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()


def test_windows_on_a_stream_equal_the_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = str(tmp_path / "in")
    events.write.parquet(folder)
    stream = windows.with_event_time(spark.readStream.schema(events.schema).parquet(folder))
    out = windows.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("tumbling_test").trigger(availableNow=True).start()
    drain(out)
    got = {(str(r.window_start), r.event_type, r.n, r.k) for r in spark.table("tumbling_test").collect()}
    assert got == {(str(r.window_start), r.event_type, r.n, r.k) for r in windows.tumbling(events).collect()}


def test_running_states_keep_the_newest_value(spark, tmp_path):
    rows = [(1, 10.0, "a"), (1, 30.0, "c"), (1, 20.0, "b"), (2, 5.0, None)]
    df = spark.createDataFrame(rows, "entity_id long, seconds double, k string")
    for i in range(4):
        df.filter(F.col("seconds") == rows[i][1]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = state.running_states(stream, ("k",)).writeStream.outputMode("update").format("memory").queryName("states_test").trigger(availableNow=True)
    drain(query.option("checkpointLocation", str(tmp_path / "ckpt")).start())
    final = spark.table("states_test").groupBy("entity_id").agg(F.max("n").alias("n"), F.max_by("k", "n").alias("k"), F.max("last_seen").alias("t"))
    assert {(r.entity_id, r.n, r.k, r.t) for r in final.collect()} == {(1, 3, "c", 30.0), (2, 1, None, 5.0)}


def test_a_failing_batch_goes_to_the_dead_letters(spark, tmp_path):
    def fail(batch, number):
        raise ValueError("broken")

    state.isolated(fail, str(tmp_path / "dead"))(spark.range(3), 7)
    got = spark.read.parquet(str(tmp_path / "dead"))
    assert got.count() == 3 and {(r._batch, r._reason) for r in got.collect()} == {(7, "ValueError: broken")}
