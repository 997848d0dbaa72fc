"""Streams with state and event-time timers: debounced writes, minimum intervals, breakers, freshness of entries.

All of them wait for the watermark, so rows may come in any order within its delay and give what the batch queries give. Rows
later than the watermark are dropped and counted by Spark (numRowsDroppedByWatermark), rows without a key only move it on. State
is freed by timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tessera.operators.health import DAY_MS, Breaker

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_US = 3_600_000_000


def _processed(stream: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    """Processors need the state store that keeps its state on disk."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return stream.groupBy(*keys).transformWithStateInPandas(processor, schema, mode, "EventTime")


def _rows(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True)


def debounced_stream(events: DataFrame, interval_us: int = HOUR_US) -> DataFrame:
    """(key, start, event_id, value) of the last event of each key and interval of events(key, event_id, ts, value), a stream with a
    watermark on ts; given once, when the watermark has passed the interval. A row is late if its interval has been given. Append
    mode. The states are those of an aggregate by window: no Python, no timer for each key and interval."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    # a test of the key alone would go below the watermark, which rows without a key move on
    keyed = events.filter(F.when(F.col("key").isNotNull(), F.col("ts")).isNotNull())
    last = keyed.groupBy("key", F.window("ts", f"{interval_us} microseconds").alias("interval")).agg(F.max(F.struct("ts", "event_id", "value")).alias("last"))
    return last.select("key", F.col("interval.start").alias("start"), "last.event_id", "last.value")


class _Gaps(StatefulProcessor):
    """Takes the events of one part of the keys in order: they wait, as arrays, until the watermark has passed them."""

    def __init__(self, least_us: int) -> None:
        self.least_us = least_us

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "keys binary, us binary")
        self.done = handle.getValueState("done", "keys binary, last_us binary, too_soon binary, n binary")

    def _timer(self, us: np.ndarray) -> None:
        at, set_to = int(us.min()) // 1000 + 1, list(self.handle.listTimers())
        if not set_to or at < min(set_to):
            for old in set_to:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues):
        new = _rows(rows)
        keys, us = new.key.to_numpy(dtype=np.int64), new.us.to_numpy(dtype=np.int64)
        self.waiting.appendValue((keys.tobytes(), us.tobytes()))
        self._timer(us)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        held = [[np.frombuffer(x, dtype=np.int64) for x in row] for row in self.waiting.get()]
        keys, us = (np.concatenate(x) for x in zip(*held, strict=True))
        ready = us < upto
        self.waiting.clear()
        if not ready.all():
            self.waiting.appendValue((keys[~ready].tobytes(), us[~ready].tobytes()))
            self.handle.registerTimer(int(us[~ready].min()) // 1000 + 1)
        if not ready.any():
            return
        known, last, soon, n = (np.frombuffer(x, dtype=np.int64) for x in (self.done.get() if self.done.exists() else (b"",) * 4))
        every, of = np.unique(np.concatenate([known, keys[ready]]), return_inverse=True)
        # a key's last event so far comes before those that are ready
        at = np.concatenate([last, us[ready]])
        order = np.lexsort((at, of))
        owner, at = of[order], at[order]
        same = owner[1:] == owner[:-1]
        more = np.bincount(of[len(known) :], minlength=len(every))
        close = np.bincount(owner[1:][same & (np.diff(at) < self.least_us)], minlength=len(every))
        close[of[: len(known)]] += soon
        total = more.copy()
        total[of[: len(known)]] += n
        self.done.update(tuple(x.astype(np.int64).tobytes() for x in (every, at[np.append(~same, True)], close, total)))
        yield pd.DataFrame({"key": every, "too_soon": close, "n": total})[more > 0]

    def close(self) -> None:
        pass


def throttle_stream(events: DataFrame, least_us: int = 300_000_000, parts: int = 512) -> DataFrame:
    """(key, too_soon, n) so far: how many of a key's events(key, event_id, ts) follow the one before sooner than least_us; a stream with
    a watermark on ts. A row for each key and batch in which the watermark passes events of it. Update mode; the row with the
    greatest n of a key is the newest. Keys are dealt out to `parts` states, each with its keys' events as arrays."""
    # a test of the key alone would go below the watermark, which rows without a key move on
    keyed = events.filter(F.when(F.col("key").isNotNull(), F.col("ts")).isNotNull())
    keyed = keyed.select("key", "ts", F.unix_micros("ts").alias("us"), F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"))
    return _processed(keyed, ["part"], _Gaps(least_us), "key long, too_soon long, n long", "update")


class _Breakers(StatefulProcessor):
    """Takes a key's checks in order, as the batch breaker does: they wait until the watermark has passed them."""

    def __init__(self, cooldown_ms: int) -> None:
        self.cooldown_us = cooldown_ms * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, event_id long, failed boolean, hard boolean")
        self.breaker = handle.getValueState("breaker", "status string, failures long, until long, error string")

    def _wait(self, rows: list[tuple]) -> None:
        if not rows:
            self.waiting.clear()
            return
        self.waiting.put(rows)
        self.handle.registerTimer(min(r[0] for r in rows) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues):
        if pd.isna(key[0]):
            return iter([])
        new = _rows(rows)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        held = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        self._wait(held + [(int(us), int(e), bool(f), bool(h)) for us, e, f, h in zip(new.us, new.event_id, new.failed, new.hard, strict=True)])
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(x) for x in self.waiting.get())
        self._wait([x for x in held if x[0] >= upto])
        state, out = Breaker(*(self.breaker.get() if self.breaker.exists() else ())), []
        for us, event_id, failed, hard in held:
            if us < upto:
                taken = state.step(us, failed, hard, self.cooldown_us)
                out.append((key[0], event_id, not taken, state.status, state.failures))
        if out:
            self.breaker.update((state.status, state.failures, state.until, state.error))
            yield pd.DataFrame(out, columns=["key", "event_id", "skipped", "status", "failures"])

    def close(self) -> None:
        pass


def ordered_breakers(checks: DataFrame, cooldown_ms: int = DAY_MS) -> DataFrame:
    """(key, event_id, skipped, status, failures) after every check of checks(key, event_id, ts, failed, hard), a stream with a watermark on
    ts whose rows may come in any order within its delay; a check is taken when the watermark has passed it. Append mode."""
    keyed = checks.select("key", "event_id", "ts", F.unix_micros("ts").alias("us"), F.coalesce("failed", F.lit(False)).alias("failed"), F.coalesce("hard", F.lit(False)).alias("hard"))
    return _processed(keyed, ["key"], _Breakers(cooldown_ms), "key long, event_id long, skipped boolean, status string, failures long", "append")


class _Fresh(StatefulProcessor):
    """Counts entries and those not yet expired at the watermark: a count for each hour, and the seconds of each hour."""

    def init(self, handle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "n long, step long, ttl long, hours array<long>, counts array<long>")
        self.seconds = handle.getMapState("seconds", "hour long", "at array<long>, many array<long>")

    def _given(self, key, now_s: int, n: int, step: int, ttl: int, hours: dict[int, int]):
        """Drop what has expired before now_s, wait for what expires next, give the counts."""
        for hour in sorted(hours):
            if (hour + 1) * 3600 + ttl <= now_s:
                self.seconds.removeKey((hour,))
                del hours[hour]
                continue
            at, many = (np.array(x, dtype=np.int64) for x in self.seconds.getValue((hour,)))
            stay = at + ttl >= now_s
            if stay.any():
                if not stay.all():
                    self.seconds.updateValue((hour,), (at[stay].tolist(), many[stay].tolist()))
                    hours[hour] = int(many[stay].sum())
                self.handle.registerTimer((int(at[stay].min()) + ttl + 1) * 1000)
                break
            self.seconds.removeKey((hour,))
            del hours[hour]
        self.sums.update((n, step + 1, ttl, list(hours), list(hours.values())))
        return pd.DataFrame({"key": [key[0]], "part": [key[1]], "step": [step + 1], "n": [n], "fresh": [sum(hours.values())]})

    def handleInputRows(self, key, rows, timerValues):
        if pd.isna(key[0]):
            return
        new = _rows(rows)
        n, step, ttl, hours, counts = self.sums.get() if self.sums.exists() else (0, 0, int(new.ttl.iloc[0]), [], [])
        known = dict(zip(hours, counts, strict=True))
        seconds = new.us.to_numpy() // 1_000_000
        for hour in np.unique(seconds // 3600).tolist():
            at, many = (np.array(x, dtype=np.int64) for x in (self.seconds.getValue((hour,)) if self.seconds.containsKey((hour,)) else ([], [])))
            own = seconds[seconds // 3600 == hour]
            every, where = np.unique(np.concatenate([at, own]), return_inverse=True)
            sums = np.bincount(where, weights=np.concatenate([many, np.ones(len(own))])).astype(np.int64)
            self.seconds.updateValue((hour,), (every.tolist(), sums.tolist()))
            known[hour] = int(sums.sum())
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        yield self._given(key, timerValues.getCurrentWatermarkInMs() // 1000, n + len(new), step, ttl, known)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        n, step, ttl, hours, counts = self.sums.get()
        yield self._given(key, timerValues.getCurrentWatermarkInMs() // 1000, n, step, ttl, dict(zip(hours, counts, strict=True)))

    def close(self) -> None:
        pass


def freshness_stream(entries: DataFrame, parts: int = 16) -> DataFrame:
    """(key, part, step, n, fresh) of entries(key, event_id, ts, ttl), a stream with a watermark on ts: how many entries a key has had, and
    how many are at most ttl seconds (one number a key) older than the watermark. A key is spread over `parts` states by event_id,
    each no larger than its ttl has seconds; freshness_now() puts them together. Update mode."""
    keyed = entries.select("key", "ts", "ttl", F.unix_micros("ts").alias("us"), F.pmod(F.xxhash64("event_id"), F.lit(parts)).cast("int").alias("part"))
    return _processed(keyed, ["key", "part"], _Fresh(), "key string, part int, step long, n long, fresh long", "update")


def freshness_now(given: DataFrame) -> DataFrame:
    """(key, n, fresh) from the newest row of each part."""
    last = given.groupBy("key", "part").agg(F.max_by(F.struct("n", "fresh"), "step").alias("x"))
    return last.groupBy("key").agg(F.sum("x.n").alias("n"), F.sum("x.fresh").alias("fresh"))


def replayed(spark: SparkSession, events: DataFrame, end: str, delay: str, operator, folder: str, files: int = 2) -> DataFrame:
    """What a stream operator gives for events(..., ts) that arrive a few files at a time and end with a row of nulls at the time `end`,
    which moves the watermark there less the delay. The rows it gives are written to a table in the folder."""
    source, out, checkpoint = (f"{folder}/{name}" for name in ("source", "given", "checkpoint"))
    events.write.parquet(source)
    last = spark.range(1).select(*[F.lit(end).cast("timestamp").alias(c) if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in events.dtypes])
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(source).withWatermark("ts", delay)
    result = operator(stream)
    mode = "append" if operator in (debounced_stream, ordered_breakers) else "update"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    def run() -> None:
        result.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    run()
    last.write.mode("append").parquet(source)
    run()
    return spark.read.schema(result.schema).parquet(*[f"{out}/batch=*"])
