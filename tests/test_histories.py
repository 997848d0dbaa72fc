"""Long histories of hot keys in segments, and similar titles with hot parts, against loops."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import health, segments, similarity
from tessera.operators.stored import Rounds

T0 = dt.datetime(2024, 1, 1)


def log(n=600, seed=1, keys=(1, 1, 1, 1, 1, 1, 1, 1, 1, 2, None)):
    """Rows (key, event_id, ts, failed, hard, recover, cooldown_ms, error, value); one key has most of them, times repeat."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        failed = r.random() < (0.9 if i % 200 < 120 else 0.3)
        own = r.choice([None, 1000, 400_000])
        out.append((r.choice(keys), i, T0 + dt.timedelta(seconds=r.randint(0, 3000)), failed, failed and r.random() < 0.1, r.random() < 0.02, own, f"e{i}", r.random() * 100))
    return out


SCHEMA = "key long, event_id long, ts timestamp_ntz, failed boolean, hard boolean, recover boolean, cooldown_ms long, error string, value double"


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(log(), SCHEMA).repartition(3)


def by_key(rows):
    out = {}
    for x in sorted(rows, key=lambda x: (x[2], x[1])):
        out.setdefault(x[0], []).append(x)
    return out


def test_a_hot_key_spreads_over_segments(events):
    sizes = {(r.key, r._seg): r.n for r in segments.with_segments(events, "key", "ts").groupBy("key", "_seg").agg(F.count("*").alias("n")).collect()}
    hot = [n for (k, _), n in sizes.items() if k == 1]
    assert sum(sizes.values()) == 600 and len(hot) > 50 and max(hot) <= 3 * sum(hot) / len(hot)
    whole = segments.with_segments(events, "key", "ts", share=2).groupBy("key").agg(F.max("_seg").alias("s")).collect()
    assert {r.key for r in whole if r.s == segments.WHOLE} == {2, None}


def test_segments_follow_the_times(events):
    rows = segments.with_segments(events, "key", "ts").select("key", "_seg", "ts").collect()
    for key in (1, 2, None):
        own = sorted((r.ts, r._seg) for r in rows if r.key == key)
        assert [s for _, s in own] == sorted(s for _, s in own)


def test_ewma_of_hot_keys_equals_the_fold(events):
    got = {r.key: (r.ewma, r.n) for r in health.ewma(events, "key", "value", ["ts", "event_id"]).collect()}
    for key, rows in by_key(log()).items():
        avg = rows[0][8]
        for x in rows[1:]:
            avg = 0.7 * avg + 0.3 * x[8]
        assert got[key] == (pytest.approx(avg), len(rows))


def test_ewma_parts_of_two_runs_merge(spark, events):
    order = ["ts", "event_id"]
    cut = T0 + dt.timedelta(seconds=1234)
    old = health.ewma_parts(events.filter(F.col("ts") < cut), "key", "value", order)
    new = health.ewma_parts(events.filter(F.col("ts") >= cut), "key", "value", order).withColumn("_seg", F.col("_seg") + 1000)
    want = {r.key: (pytest.approx(r.ewma), r.n) for r in health.ewma(events, "key", "value", order).collect()}
    assert {r.key: (r.ewma, r.n) for r in health.merge_ewma(old.unionByName(new), "key").collect()} == want


def test_ewma_windows_hold_a_segment_at_most(events):
    plan = health.ewma(events, "key", "value", ["ts", "event_id"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    over_rows = [line for line in windows if "row_number" in line]
    assert over_rows and all("_seg" in line.split("], [")[1] for line in over_rows)
    assert all("Aggregate" in plan.splitlines()[plan.splitlines().index(line) + 1] for line in windows if line not in over_rows)  # one row a segment


def test_ewma_leaves_out_missing_values(spark):
    df = spark.createDataFrame([(1, None, 1), (1, 100.0, 2), (1, None, 3), (1, 200.0, 4), (2, None, 1)], "k int, v double, t int")
    assert [(r.k, r.n, round(r.ewma, 6)) for r in health.ewma(df, "k", "v", ["t"]).collect()] == [(1, 2, 130.0)]
    assert health.ewma(df.limit(0), "k", "v", ["t"]).count() == 0


def test_failure_runs_of_hot_keys(events):
    got = {r.event_id: r.failures for r in health.failure_runs(events, "key", F.col("failed"), ["ts", "event_id"]).collect()}
    want = {}
    for rows in by_key(log()).values():
        run = 0
        for x in rows:
            run = run + 1 if x[3] else 0
            want[x[1]] = run
    assert got == want and max(want.values()) >= 12


def test_failure_runs_through_segments_without_a_success(spark):
    df = spark.createDataFrame([(7, i, i != 0) for i in range(500)], "k int, t int, failed boolean")
    out = health.failure_runs(df, "k", F.col("failed"), ["t"])
    assert out.columns == ["k", "t", "failed", "failures"]
    assert [r.failures for r in out.orderBy("t").collect()] == list(range(500))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_breakers_of_hot_keys(spark, seed):
    rows = log(seed=seed)
    got = {r.event_id: (r.skipped, r.status, r.failures, r.blocked_until, r.last_error) for r in health.breaker_states(spark.createDataFrame(rows, SCHEMA).repartition(3), 60_000).collect()}
    want = {}
    for own in by_key(rows).values():
        b = health.Breaker()
        for _, event, ts, failed, hard, recover, cooldown, error, _ in own:
            at, taken = (ts - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1), True
            if recover:
                b.recover()
            else:
                taken = b.step(at, failed, hard, (cooldown or 60_000) * 1000, error)
            want[event] = (not taken, b.status, b.failures, b.until and dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=b.until), b.error)
    assert got == want and sum(x[0] for x in want.values()) > 50


def test_breakers_blocked_through_many_segments(spark):
    rows = [(1, i, T0 + dt.timedelta(seconds=i), True, False) for i in range(400)] + [(1, 400, None, True, False)]
    df = spark.createDataFrame(rows, "key long, event_id long, ts timestamp_ntz, failed boolean, hard boolean")
    got = health.breaker_states(df).orderBy(F.col("ts").asc_nulls_first()).collect()
    assert [r.failures for r in got[:3]] == [1, 2, 3] and all(r.skipped and r.blocked_until == got[2].blocked_until for r in got[3:])


def test_rounds_are_deleted(spark, tmp_path):
    rounds = Rounds(spark, f"file://{tmp_path}")
    a, b = rounds.keep(spark.range(3)), rounds.keep(spark.range(4))
    rounds.drop(a)
    assert b.count() == 4 and len(list(tmp_path.glob("*/*"))) == 1


# --- similar titles ---------------------------------------------------------------------------------------------


def brute_pairs(spark, titles):
    pairs = spark.createDataFrame(list(itertools.combinations(sorted(set(titles)), 2)), "a string, b string")
    return {tuple(x) for x in pairs.filter(similarity.similar(F.col("a"), F.col("b"))).collect()}


def test_titles_of_all_lengths_lose_no_pair(spark):
    r = random.Random(5)
    words = ["one", "piece", "dark", "moon", "第一", "話", "ab", "z"]
    titles = {"".join(r.choice(words) for _ in range(r.randint(0, 9))) for _ in range(130)}
    titles |= {t[:k] + r.choice("xyz") + t[k:] for t in list(titles)[:40] for k in [r.randint(0, len(t))]}
    df = spark.createDataFrame([(t,) for t in titles] + [(None,)], "t string")
    assert {tuple(x) for x in similarity.similar_pairs(df).collect()} == brute_pairs(spark, titles)


@pytest.mark.parametrize("threshold", [0.6, 0.9, 1.0])
def test_titles_at_other_thresholds(spark, threshold):
    r = random.Random(6)
    titles = sorted({"".join(r.choice("abcdefg") for _ in range(r.randint(0, 12))) for _ in range(90)})
    pairs = spark.createDataFrame(list(itertools.combinations(titles, 2)), "a string, b string")
    want = {tuple(x) for x in pairs.filter(similarity.similar(F.col("a"), F.col("b"), threshold)).collect()}
    assert {tuple(x) for x in similarity.similar_pairs(spark.createDataFrame([(t,) for t in titles], "t string"), threshold).collect()} == want
    with pytest.raises(ValueError):
        similarity.candidate_pairs(spark.createDataFrame([], "t string"), 0.5)


def test_a_run_that_all_titles_have_gives_few_candidates(spark):
    r = random.Random(7)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    part = lambda n: "".join(r.choice(letters) for _ in range(n))
    titles = [part(12) + "abcdefghijklmnopqrstuvwxyz" + part(12) for _ in range(400)]
    titles += [titles[0][:45] + part(5), "chapter" + part(30), "chapter" + part(31)]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    candidates = similarity.candidate_pairs(df)
    assert {tuple(sorted(x)) for x in candidates.collect()} == {tuple(sorted((titles[0], titles[400])))}
    joined = similarity._common_runs(df.distinct(), 0.75)
    assert joined.count() <= 2 * len(titles)


def test_empty_title_is_a_projection(spark):
    df = spark.createDataFrame([("",), ("",), ("abc",), ("xyz",)], "t string")
    assert {tuple(x) for x in similarity.candidate_pairs(df).collect()} == {("", "abc"), ("", "xyz")}
    assert similarity.candidate_pairs(df.limit(0)).count() == 0
