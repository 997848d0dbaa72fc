"""The streaming breaker takes the same decisions as the batch one; logs are appended once."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators.health import breaker_states
from tessera.sources.tables import INDEX_SCHEMA, append_log, export_json, read_first, read_index, snapshot, table
from tessera.streaming.breakers import append_batches, breaker_stream
from tessera.streaming.timers import debounced_stream, freshness_now, freshness_stream, ordered_breakers, replayed, throttle_stream

DATA = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    e = table(spark, DATA, "events")
    failed = F.col("event_type") == "error"
    checks = e.select(F.col("user_id").alias("key"), "event_id", "ts", failed.alias("failed"), (failed & (F.col("value") > 200)).alias("hard"))
    path = f"{tmp_path}/checks"
    checks.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(checks.schema).parquet(path)
    q = breaker_stream(stream).writeStream.format("memory").queryName("breakers").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("breakers").select("key", "event_id", "skipped", "status", "failures").collect()}
    want = {tuple(r) for r in breaker_states(checks).select("key", "event_id", "skipped", "status", "failures").collect()}
    assert got == want and len(got) == checks.count()


def test_logs_and_documents(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, day string")
    append_log(df, f"{tmp_path}/log", "day")
    append_log(df, f"{tmp_path}/log", "day")
    assert spark.read.parquet(f"{tmp_path}/log").filter("day = 'a'").count() == 2
    snapshot(df, f"{tmp_path}/snap")
    snapshot(df, f"{tmp_path}/snap")
    assert spark.read.parquet(f"{tmp_path}/snap").count() == 2
    q = append_batches(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/snap"), f"{tmp_path}/out", f"{tmp_path}/c2")
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    index = spark.createDataFrame([("1", [("s", "n")])], "version string, sources array<struct<id: string, name: string>>")
    export_json(index, f"{tmp_path}/index")
    assert read_index(spark, f"{tmp_path}/index").select("id", "host").first() == ("s", None)
    assert read_first(spark, [f"{tmp_path}/none", f"{tmp_path}/index"], INDEX_SCHEMA).count() == 1
    assert read_first(spark, [f"{tmp_path}/none"], INDEX_SCHEMA).count() == 0


def test_debounced_stream_gives_each_interval_once_and_drops_late_rows(spark, tmp_path):
    rows = [(1, i, dt.datetime(2024, 1, 1, h, m), float(i)) for i, (h, m) in enumerate([(0, 5), (0, 59), (0, 30), (3, 0), (5, 0)])]
    schema = "key long, event_id long, ts timestamp, value double"
    for i, part in enumerate([rows[:4], rows[4:], [(1, 9, dt.datetime(2024, 1, 1, 0, 58), 9.0)], [(None, None, dt.datetime(2024, 1, 9), None)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = debounced_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in").withWatermark("ts", "10 minutes"))
        q = q.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        got = [(r.start.hour, r.event_id) for r in spark.read.schema("key long, start timestamp, event_id long, value double").parquet(f"{tmp_path}/out").orderBy("start").collect()]
        assert got == [[(0, 1)], [(0, 1), (3, 3)], [(0, 1), (3, 3)], [(0, 1), (3, 3), (5, 4)]][i]
        assert sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"]) == (i == 2)


def test_debounced_intervals_are_open_until_the_watermark_passes_their_end(spark, tmp_path):
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    schema = "key long, event_id long, ts timestamp, value double"
    for part in [[(1, 0, at(5, 5), 0.0)], [(2, 1, at(5, 59), 1.0)], [(1, 2, at(5, 20), None)], [(None, None, at(23, 0), None)]]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = debounced_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in").withWatermark("ts", "10 minutes"))
        q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.schema("key long, start timestamp, event_id long, value double").parquet(f"{tmp_path}/out").collect()
    assert sorted((r.key, r.start.hour, r.event_id) for r in got) == [(1, 5, 2), (2, 5, 1)]
    assert "TransformWithState" not in out._jdf.queryExecution().analyzed().toString()


def test_gaps_wait_for_rows_in_between(spark, tmp_path):
    rows = [(1, 1, dt.datetime(2024, 1, 1, 0, 0)), (1, 2, dt.datetime(2024, 1, 1, 0, 8)), (1, 3, dt.datetime(2024, 1, 1, 0, 4)), (2, 4, dt.datetime(2024, 1, 1, 0, 0))]
    events = spark.createDataFrame(rows, "key long, event_id long, ts timestamp").repartition(4)
    got = replayed(spark, events, "2030-01-01", "1 day", throttle_stream, f"file://{tmp_path}/r", 1).filter("key is not null")
    assert {(r.key, r.too_soon, r.n) for r in got.groupBy("key").agg(F.max_by("too_soon", "n").alias("too_soon"), F.max("n").alias("n")).collect()} == {(1, 2, 3), (2, 0, 1)}


def test_gaps_of_many_keys_share_states(spark, tmp_path):
    schema, got = "key long, event_id long, ts timestamp", {}
    for day in range(1, 5):
        rows = [(k << 54 | k, 9, dt.datetime(2024, 1, day, 23 * (i > 2), 4 * i)) for k in range(40) for i in (5, 0, 4, 1, 3, 2)]
        spark.createDataFrame([*rows, (None, 0, dt.datetime(2024, 1, day, 23, 59))], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = throttle_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in").withWatermark("ts", "1 hour"), parts=2)
        keep = lambda batch, number: got.update({r.key: (r.too_soon, r.n) for r in batch.orderBy("n").collect()})
        out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        # the last three of a day wait for the next day
        assert got == {k << 54 | k: (4 * day - 2, 6 * day - 3) for k in range(40)}
    assert spark.read.format("statestore").option("path", f"{tmp_path}/c").option("stateVarName", "done").load().count() == 2


def test_entries_expire_with_the_watermark(spark, tmp_path):
    rows = [("a", i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=1800 * i), 7200) for i in range(40)] + [("b", 99, dt.datetime(2024, 1, 1), 60)]
    entries = spark.createDataFrame(rows, "key string, event_id long, ts timestamp, ttl long").repartition(3)
    given = replayed(spark, entries, "2024-01-02 19:30:00", "1 day", freshness_stream, f"file://{tmp_path}/r", 1)
    assert {(r.key, r.n, r.fresh) for r in freshness_now(given).collect()} == {("a", 40, 5), ("b", 1, 0)}


def test_ordered_breakers_equal_the_batch_for_rows_in_any_order(spark, tmp_path):
    e = table(spark, DATA, "events").filter("user_id < 6")
    failed = F.col("event_type") == "error"
    checks = e.select(F.col("user_id").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), failed.alias("failed"), (failed & (F.col("value") > 200)).alias("hard"))
    shuffled = checks.repartition(5, F.xxhash64("event_id"))
    got = replayed(spark, shuffled, "2040-01-01", "60 days", ordered_breakers, f"file://{tmp_path}/r", 2).filter("key is not null")
    want = breaker_states(checks.withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    columns = ["key", "event_id", "skipped", "status", "failures"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
