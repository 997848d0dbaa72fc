"""Stored roll-ups and tables in buckets: only what is new is read, only what is touched is written, failures leave the old state."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import keyed
from tessera.sources.buckets import BucketTable
from tessera.sources.clustered import PagedLog, write_clustered
from tessera.sources.postings import Postings
from tessera.streaming import rollups

T0 = dt.datetime(2024, 1, 1)
CHECKS = "key long, check string, event_id long, ts timestamp_ntz, ok boolean"


def some_checks(first, n):
    return [(i % 3, f"c{i % 2}", i, T0 + dt.timedelta(hours=7 * i), i % 5 != 0) for i in range(first, first + n)]


def status(df):
    return sorted(tuple(r) for r in rollups.latest_status(df).collect())


def test_rollup_reads_only_new_files(spark, tmp_path):
    store, log = rollups.RollupStore(spark, f"file://{tmp_path}/parts"), f"file://{tmp_path}/log"
    rows, read = [], []
    assert store.parts().count() == 0
    for k in range(3):
        more = some_checks(100 * k, 20)
        rows += more
        spark.createDataFrame(more, CHECKS).coalesce(1).write.mode("append").parquet(log)
        q = store.follow(spark.readStream.schema(CHECKS).parquet(log), f"file://{tmp_path}/c")
        q.awaitTermination()
        read.append(sum(p["numInputRows"] for p in q.recentProgress))
        if k == 1:
            store.compact()
        want = rollups.day_parts(spark.createDataFrame(rows, CHECKS))
        assert status(store.parts()) == status(want)
        assert sorted(map(tuple, rollups.day_report(store.parts()).collect())) == sorted(map(tuple, rollups.day_report(want).collect()))
    assert read == [20, 20, 20]
    assert sorted(p.name for p in (tmp_path / "parts").iterdir()) == ["batch=2", "upto=1"]


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    store = rollups.RollupStore(spark, f"file://{tmp_path}/parts")
    checks = spark.createDataFrame(some_checks(0, 30), CHECKS)
    store.put(checks, 0)
    store.put(checks, 0)
    assert store.parts().agg(F.sum("n")).first()[0] == 30
    store.compact()
    store.put(checks, 0)  # after its merge, too
    store.compact()
    assert store.parts().agg(F.sum("n")).first()[0] == 30


def test_an_unfinished_merge_is_not_read(spark, tmp_path):
    store = rollups.RollupStore(spark, f"file://{tmp_path}/parts")
    store.put(spark.createDataFrame(some_checks(0, 10), CHECKS), 0)
    (tmp_path / "parts" / "upto=5").mkdir()  # without _SUCCESS
    assert store.parts().agg(F.sum("n")).first()[0] == 10


def test_latest_rows_decide_over_days(spark):
    rows = [(1, "a", 1, T0, True), (1, "a", 2, T0 + dt.timedelta(days=1), False), (1, "b", 3, T0, True), (2, "a", 4, T0, None), (None, "a", 5, T0, True)]
    parts = rollups.day_parts(spark.createDataFrame(rows, CHECKS))
    assert {tuple(r) for r in rollups.latest_status(parts).collect()} == {(1, 2, "degraded"), (2, 1, "unknown"), (None, 1, "healthy")}


# --- buckets ----------------------------------------------------------------------------------------------------


def table_of(spark, tmp_path, n=200):
    t = BucketTable(spark, f"file://{tmp_path}/t", ["k"], 8)
    t.append(spark.range(n).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit(None).cast("int").alias("w")))
    return t


def upsert(old, new):
    return keyed.upsert(old, new, ["k"])


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    t = table_of(spark, tmp_path)
    before = t.manifest()["folders"]
    new = spark.createDataFrame([(3, "new", 1), (3, "new", 0), (999, "more", None)], "k long, v string, w int")
    want = sorted(map(tuple, upsert(t.rows(), new).collect()))
    touched = t.change(new, upsert)
    after = t.manifest()["folders"]
    assert len(touched) <= 2 and {int(b) for b in after if after[b] != before.get(b)} == set(touched)
    assert sorted(map(tuple, t.rows().collect())) == want and t.version() == 2
    files = {p for p in (tmp_path / "t" / "data").glob("*/_bucket=*/*.parquet")}
    t.vacuum()
    assert {p for p in (tmp_path / "t" / "data").glob("*/_bucket=*/*.parquet")} < files and sorted(map(tuple, t.rows().collect())) == want


def test_a_write_that_fails_leaves_the_old_state(spark, tmp_path, monkeypatch):
    t = table_of(spark, tmp_path)
    want = sorted(map(tuple, t.rows().collect()), key=repr)
    new = spark.createDataFrame([(3, "new", 1)], "k long, v string, w int")

    def lost(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(BucketTable, "_commit", lost)
        with pytest.raises(OSError):
            t.change(new, upsert)
    assert sorted(map(tuple, t.rows().collect()), key=repr) == want and t.version() == 1
    t.change(new, upsert)
    assert t.look_up(3).collect()[0].v == "new"


def test_of_two_writers_the_second_fails(spark, tmp_path):
    t = table_of(spark, tmp_path)
    state = t.manifest()
    t.change(spark.createDataFrame([(3, "new", 1)], "k long, v string, w int"), upsert)
    with pytest.raises(Exception, match="exist"):
        t._commit(1, state)
    assert t.look_up(3).first().v == "new"


def test_look_up_reads_one_bucket(spark, tmp_path):
    t = table_of(spark, tmp_path)
    one = t.look_up(7)
    assert [r.k for r in one.collect()] == [7] and len({f.rsplit("/", 2)[1] for f in one.inputFiles()}) == 1
    assert t.look_up(12345).count() == 0


def test_deletes_nulls_and_inserts(spark, tmp_path):
    t = table_of(spark, tmp_path, 20)
    new = spark.createDataFrame([(None, "none", 1), (5, "dup", 2)], "k long, v string, w int")
    t.change(new, lambda old, more: keyed.insert_ignore(old, more, ["k"]))
    assert t.look_up(None).first().v == "none" and t.look_up(5).first().v == "old"
    t.change(new, lambda old, more: old.join(more.select(F.col("k").alias("x")), F.col("k").eqNullSafe(F.col("x")), "left_anti"))
    assert t.look_up(None).count() == 0 and t.look_up(5).count() == 0 and t.rows().count() == 19
    assert t.change(new.limit(0), upsert) == []


# --- postings ---------------------------------------------------------------------------------------------------


def rows_read(df):
    """Rows that the scans of a frame's plan gave when it ran."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if hasattr(p, "plan") and "QueryStage" in p.getClass().getSimpleName():
            todo.append(p.plan())
            continue
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
        if "Scan" in p.getClass().getSimpleName():
            total += p.metrics().apply("numOutputRows").value()
    return total


def test_postings_find_what_a_scan_finds_and_read_less(spark, tmp_path):
    import random

    r = random.Random(3)
    words = [a + b + c for a in ("th", "an", "re") for b in ("ing", "er", "on") for c in ("", "s", "ed")]
    rows = [(i, " ".join(r.choice(words) for _ in range(30)) + (" Zebra" if i % 500 == 7 else "") + (" okapi" if i % 2 else ""), i) for i in range(4000)]
    rows += [(1, None, 0), (None, "ZEBRA é日本語", 0), (None, "ZEBRA é日本語", 0), (5, "", 0), (6, "ze", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` long").repartition(4)
    index = Postings(spark, f"file://{tmp_path}/index", row_group=20_000)
    index.build(docs, "text")
    for keyword in ("zebra", "ÉB", "é日本", "ing re", "okapi", "ze", "", "absent", "zebrab"):
        want = docs.filter(F.contains(F.lower("text"), F.lower(F.lit(keyword))))
        assert sorted(map(tuple, index.search(keyword).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr), keyword
    assert index.search("zebra").columns == docs.columns
    assert rows_read(index.search("zebra")) < rows_read(index.search("okapi")) / 2


def test_postings_take_a_row_for_a_run_of_a_block(spark, tmp_path):
    rows = [(i, "licence" if i % 2 else "License \U0001f600\U0001f600!") for i in range(1000)]
    index = Postings(spark, f"file://{tmp_path}/index")
    index.build(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "text")
    assert spark.read.parquet(f"{tmp_path}/index/postings").groupBy("run", "block").count().agg({"count": "max"}).first()[0] <= 2
    assert spark.read.parquet(f"{tmp_path}/index/postings").count() < 1000
    for keyword, odd in (("CENS", 0), ("icence", 1), ("\U0001f600\U0001f600!", 0)):
        assert sorted(r.doc_id for r in index.search(keyword).collect()) == [i for i in range(1000) if i % 2 == odd]


def test_postings_of_nothing(spark, tmp_path):
    index = Postings(spark, f"file://{tmp_path}/index")
    index.build(spark.createDataFrame([], "doc_id long, text string"), "text")
    assert index.search("zebra").count() == 0 and index.search("").count() == 0


# --- logs in order ----------------------------------------------------------------------------------------------


def test_pages_of_a_log_read_their_own_ranges(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        log = PagedLog(spark, f"file://{tmp_path}/log")
        log.build(spark.range(2000).select((F.col("id") % 10).alias("a"), "id").repartition(3), F.desc("a"), F.col("id"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(((i % 10, i) for i in range(2000)), key=lambda x: (-x[0], x[1]))
    for limit, offset in ((None, None), (0, 0), (7, 1234), (1000, 700), (50, 1990), (5, 5000)):
        page = log.page(limit, offset)
        assert [tuple(r) for r in page.collect()] == want[(offset or 0) : (offset or 0) + (limit or 50)]
    deep = log.page(10, 1500)
    assert rows_read(deep) <= 600 and "Window" not in deep._jdf.queryExecution().toString()
    a, i = want[1233]
    upto = (F.col("a") > a) | (F.col("a") == a) & (F.col("id") <= i)
    assert [tuple(r) for r in log.page_after(upto, 20).collect()] == want[1234:1254]
    assert [tuple(r) for r in log.page_after(F.lit(False), 3).collect()] == want[:3] and log.page_after(F.lit(True), 3).count() == 0
    assert log.count() == 2000


def test_pages_of_an_empty_log(spark, tmp_path):
    log = PagedLog(spark, f"file://{tmp_path}/log")
    log.build(spark.range(3), "id")
    assert log.page(5, 3).count() == 0 and log.page(5, 2).first().id == 2


def test_look_ups_open_few_row_groups(spark, tmp_path):
    df = spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("name"), (F.col("id") % 7).alias("x"))
    write_clustered(df, f"file://{tmp_path}/c", ["id"], {"name": 50_000}, row_group=200_000)
    rows = spark.read.parquet(f"file://{tmp_path}/c")
    name = df.filter("id = 77777").first().name
    by_key, by_name = rows.filter("id = 77777"), rows.filter(F.col("name") == name)
    assert by_key.first().name == name and by_name.first().id == 77777
    assert rows_read(by_key) <= 25_000 and rows_read(by_name) <= 25_000
    assert rows_read(rows.filter("name = 'none'")) <= 25_000
