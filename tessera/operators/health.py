"""Health over append-only check logs: roll-ups, latency averages, failure runs and circuit breakers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.segments import PARTS, WHOLE, later, with_segments
from tessera.operators.stored import Rounds

DAY_MS = 86_400_000
#: Microseconds that stand for a null time: before all others.
NO_TIME = -(1 << 61)


def rollup(ok: Column, none: str = "unknown") -> Column:
    """healthy if all checks are ok, degraded if any is, else unhealthy; `none` where there are no checks."""
    return F.when(F.count(ok) == 0, F.lit(none)).when(F.bool_and(ok), F.lit("healthy")).when(F.bool_or(ok), F.lit("degraded")).otherwise(F.lit("unhealthy"))


def ewma_parts(df: DataFrame, key: str, value: str, order: list[str], keep: float = 0.7) -> DataFrame:
    """(key, _seg, n, decayed, first): one row for each segment of a key's history, which merge_ewma() puts together. order: the time
    and what decides between equal times. Rows without a value change nothing and don't count.

    A segment of n values turns an average a into keep ** n * a + decayed, where each value in decayed weighs
    (1 - keep) * keep ** (values after it in the segment); such maps of neighbouring segments compose.
    """
    rows = with_segments(df.filter(F.col(value).isNotNull()), key, order[0])
    after = F.row_number().over(Window.partitionBy(key, "_seg").orderBy(*[F.desc(c) for c in order])) - 1
    rows = rows.withColumn("_w", F.lit(1.0 - keep) * F.pow(F.lit(keep), after))
    return rows.groupBy(key, "_seg").agg(F.count("*").alias("n"), F.sum(F.col(value) * F.col("_w")).alias("decayed"), F.min_by(value, F.struct(*order)).alias("first"))


def merge_ewma(parts: DataFrame, key: str, keep: float = 0.7) -> DataFrame:
    """(key, ewma, n) of ewma_parts() of consecutive stretches of the log, numbered by _seg: those of one run, or stored ones of
    earlier runs and of newer rows."""
    moved = parts.withColumn("_a", later(key, "n"))
    total = moved.groupBy(key).agg(F.sum(F.col("decayed") * F.pow(F.lit(keep), F.col("_a"))).alias("_s"), F.sum("n").alias("n"), F.min_by("first", "_seg").alias("_f"))
    return total.select(key, (F.col("_s") + F.pow(F.lit(keep), F.col("n")) * F.col("_f")).alias("ewma"), "n")


def ewma(df: DataFrame, key: str, value: str, order: list[str], keep: float = 0.7) -> DataFrame:
    """Per key the last value of avg = keep * avg + (1 - keep) * value, where the first value starts it, and the number of values."""
    return merge_ewma(ewma_parts(df, key, value, order, keep), key, keep)


def failure_runs(df: DataFrame, key: str, failed: Column, order: list[str]) -> DataFrame:
    """Adds `failures`: how many failures in a row end at the row, 0 for a success. order: the time and what decides between equal
    times. Runs are counted in each segment of a key's history; a row before the first success of its segment adds the run that
    the segments before it end with, which a few rows per hot key tell."""

    def counted(rows: DataFrame) -> DataFrame:
        upto = Window.partitionBy(key, "_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = rows.withColumn("_ok", F.coalesce(F.sum((~F.col("_failed")).cast("long")).over(upto), F.lit(0)))
        inside = Window.partitionBy(key, "_seg", "_ok").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return out.withColumn("failures", F.sum(F.col("_failed").cast("long")).over(inside))

    rows = with_segments(df.withColumn("_failed", failed), key, order[0])
    hot = counted(rows.select(key, *order, "_failed", "_seg").filter(F.col("_seg") != WHOLE))
    ends = hot.groupBy(key, "_seg").agg(F.max("_ok").alias("ok"), F.max_by("failures", F.struct(*order)).alias("run"))
    by_seg = Window.partitionBy(key).orderBy("_seg")
    ends = ends.withColumn("part", F.sum(F.when(F.col("ok") > 0, 1).otherwise(0)).over(by_seg.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = ends.withColumn("run", F.sum("run").over(Window.partitionBy(key, "part").orderBy("_seg").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    carry = ends.select(F.col(key).alias("_key"), F.col("_seg").alias("_at"), F.lag("run").over(by_seg).alias("_carry")).filter("_carry > 0")
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_seg") == F.col("_at"))
    out = counted(rows).join(F.broadcast(carry), same, "left")
    first = F.when((F.col("_ok") == 0) & F.col("_failed"), F.coalesce("_carry", F.lit(0))).otherwise(F.lit(0))
    return out.withColumn("failures", F.col("failures") + first).drop("_failed", "_seg", "_ok", "_key", "_at", "_carry")


class Breaker:
    """State of one key: status, failures in a row, blocked until when (microseconds), last error."""

    def __init__(self, status: str = "unknown", failures: int = 0, until: int | None = None, error: str | None = None) -> None:
        self.status, self.failures, self.until, self.error = status, failures, until, error

    def recover(self) -> None:
        """Someone opens the key again by hand."""
        self.__init__()

    def step(self, at: int, failed: bool, hard: bool, cooldown: int, error: str | None = None) -> bool:
        """Take one check; False if it is skipped because the key is blocked."""
        if self.status == "blocked":
            if at < self.until:
                return False
            self.status, self.failures, self.until = "unknown", 0, None
        if not failed:
            self.__init__("healthy")
            return True
        self.failures, self.error = self.failures + 1, error
        if hard or self.failures >= 3:
            self.status, self.until = "blocked", at + cooldown
        else:
            self.status = "degraded" if self.failures >= 2 else "healthy"
        return True


BREAKER_SCHEMA = "key long, event_id long, ts timestamp_ntz, skipped boolean, status string, failures long, blocked_until timestamp_ntz, last_error string"
#: Columns that checks may have besides, and what counts where they are missing or null.
OPTIONAL = {"recover": ("boolean", False), "cooldown_ms": ("long", None), "error": ("string", None)}


_ENTRY = "struct<status: string, failures: long, until: long, error: string>"
#: Rounds in which segments are run again because the state they are entered with has changed; a key has fewer segments.
MOST_ROUNDS = PARTS + 2


def _run_breakers(rows: DataFrame, cooldown_ms: int, ends_only: bool) -> DataFrame:
    """Run every segment of rows(key, event_id, ts, failed, hard, recover, cooldown_ms, error, _seg, _entry) from the state it is entered
    with, null for a fresh one: the state after every check, or only (key, _seg, _end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, ends = None, Breaker(), []
        for batch in batches:
            ats = batch.column("ts").cast(pa.int64()).fill_null(NO_TIME).to_pylist()
            names = ("key", "_seg", "_entry", "failed", "hard", "recover", "cooldown_ms", "error")
            rows = []
            for time, (k, seg, entry, failed, hard, recover, own, error) in zip(ats, zip(*(batch.column(c).to_pylist() for c in names), strict=True), strict=True):
                if (k, seg) != at:
                    if at is not None:
                        ends.append((*at, vars(state)))
                    at, state = (k, seg), Breaker(**entry) if entry else Breaker()
                taken = True
                if recover:
                    state.recover()
                else:
                    taken = state.step(time, bool(failed), bool(hard), (own or cooldown_ms) * 1000, error)
                rows.append((not taken, state.status, state.failures, state.until, state.error))
            if ends_only:
                continue
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = (pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.string())
            skipped, status, failures, until, errors = (pa.array(list(c), t) for c, t in zip(cols, types, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("event_id"), batch.column("ts"), skipped, status, failures, until.cast(pa.timestamp("us")), errors],
                names=["key", "event_id", "ts", "skipped", "status", "failures", "blocked_until", "last_error"],
            )
        if ends_only:
            if at is not None:
                ends.append((*at, vars(state)))
            kind = pa.struct([("status", pa.string()), ("failures", pa.int64()), ("until", pa.int64()), ("error", pa.string())])
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in ends], t) for i, t in enumerate((pa.int64(), pa.int32(), kind))], names=["key", "_seg", "_end"])

    ordered = rows.repartition("key", "_seg").sortWithinPartitions("key", "_seg", "ts", "event_id")
    return ordered.mapInArrow(run, f"key long, _seg int, _end {_ENTRY}" if ends_only else BREAKER_SCHEMA)


def breaker_states(checks: DataFrame, cooldown_ms: int = DAY_MS) -> DataFrame:
    """State after every check of checks(key, event_id, ts, failed, hard), with the error of the last failure.

    If there are such columns, cooldown_ms is the key's own cooldown, error the failure's text, and a row with recover is no check
    but opens its key by hand. Checks are taken by ts (null first), then event_id; those equal in both come in any order.

    The state depends on all earlier checks of its key. A hot key's history is cut into segments that run side by side, at first
    all from a fresh state; as long as a segment ends otherwise than the next one was entered, the next one is run again. Most
    segments forget how they were entered (a success, or a block that has run out), so this settles in a few rounds, and after
    at most one round for each segment. Rows are read as a stream, never held together.
    """
    more = [F.col(c).cast(t) if c in checks.columns else F.lit(value).cast(t).alias(c) for c, (t, value) in OPTIONAL.items()]
    rows = with_segments(checks.select(F.col("key").cast("long"), "event_id", "ts", "failed", "hard", *more), "key", "ts")
    rounds = Rounds(checks.sparkSession)
    hot = rounds.keep(rows.filter(F.col("_seg") != WHOLE).withColumn("_entry", F.lit(None).cast(_ENTRY)))
    if not hot.limit(1).count():
        rounds.drop(hot)
        return _run_breakers(rows.withColumn("_entry", F.lit(None).cast(_ENTRY)), cooldown_ms, False)
    table = rounds.keep(_run_breakers(hot, cooldown_ms, True).withColumn("_entry", F.lit(None).cast(_ENTRY)))
    row = F.col("_key").eqNullSafe(F.col("key")) & (F.col("_at") == F.col("_seg"))
    place = [F.col("key").alias("_key"), F.col("_seg").alias("_at")]
    for _ in range(MOST_ROUNDS):
        # _entry: what the segment was last run from; _due: how the one before it ends
        due = table.withColumn("_due", F.lag("_end").over(Window.partitionBy("key").orderBy("_seg")))
        changed = due.filter(~F.coalesce("_due", _fresh()).eqNullSafe(F.coalesce("_entry", _fresh())))
        if not changed.limit(1).count():
            break
        again = hot.drop("_entry").join(F.broadcast(changed.select(*place, F.col("_due").alias("_entry"))), row)
        new = _run_breakers(again, cooldown_ms, True).select(*place, F.col("_end").alias("_new"))
        before, table = table, rounds.keep(due.join(F.broadcast(new), row, "left").select("key", "_seg", F.coalesce("_new", "_end").alias("_end"), F.col("_due").alias("_entry")))
        rounds.drop(before)
    else:
        raise RuntimeError("breakers did not settle")
    rounds.drop(hot)
    entered = rows.join(F.broadcast(table.select(*place, "_entry")), row, "left")
    return _run_breakers(entered, cooldown_ms, False)


def _fresh() -> Column:
    values = (("status", "unknown", "string"), ("failures", 0, "long"), ("until", None, "long"), ("error", None, "string"))
    return F.struct(*[F.lit(v).cast(t).alias(n) for n, v, t in values])
