"""The circuit breaker as a Structured Streaming operator, and log upkeep on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.health import DAY_MS, Breaker


def breaker_stream(checks: DataFrame, cooldown_ms: int = DAY_MS) -> DataFrame:
    """State after every check of a stream checks(key, event_id, ts, failed, hard); rows of a micro-batch are taken in order of ts.

    State a key: three fields in the state store. Late rows are taken when they come.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        b = Breaker(*(state.get if state.exists else ("unknown", 0, None)))
        pdf = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        rows = []
        for event, ts, failed, hard in zip(pdf.event_id, pdf.ts, pdf.failed, pdf.hard, strict=True):
            taken = b.step(ts.value // 1000, bool(failed), bool(hard), cooldown_ms * 1000)
            rows.append((key[0], event, not taken, b.status, b.failures))
        state.update((b.status, b.failures, b.until))
        yield pd.DataFrame(rows, columns=["key", "event_id", "skipped", "status", "failures"])

    return checks.groupBy("key").applyInPandasWithState(
        step, "key long, event_id long, skipped boolean, status string, failures long", "status string, failures long, until long", "append", GroupStateTimeout.NoTimeout
    )


def append_batches(stream: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Write a stream to a Parquet log, once over what is there or at an interval."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
