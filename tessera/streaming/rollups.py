"""Health roll-ups that are kept up to date: partial aggregates of each micro-batch are stored, and only those are merged.

A part has a row for each key, check and day; parts of any batches merge by sums and newest rows. A batch's parts go to a folder
named by the batch, so a batch that is run again after a failure replaces what it wrote before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.health import rollup
from tessera.operators.stored import delete
from tessera.sources.tables import exists

PART = "key long, check string, day date, n long, n_ok long, last_ts timestamp_ntz, last_id long, last_ok boolean"


def day_parts(checks: DataFrame) -> DataFrame:
    """Partial aggregates of checks(key, check, event_id, ts, ok): a row for each key, check and day."""
    last = F.max(F.struct("ts", "event_id", "ok")).alias("last")
    by_day = checks.groupBy("key", "check", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), last)
    return by_day.select("key", "check", "day", "n", "n_ok", F.col("last.ts").alias("last_ts"), F.col("last.event_id").alias("last_id"), F.col("last.ok").alias("last_ok"))


def merged(parts: DataFrame, *by: str) -> DataFrame:
    """Parts of several batches or days as one, by key and check and what else is named."""
    last = F.max(F.struct("last_ts", "last_id", "last_ok")).alias("last")
    return parts.groupBy("key", "check", *by).agg(F.sum("n").alias("n"), F.sum("n_ok").alias("n_ok"), last).select("key", "check", *by, "n", "n_ok", "last.*")


def latest_status(parts: DataFrame, none: str = "unknown") -> DataFrame:
    """(key, checks, status): the roll-up over the newest row of each check of a key."""
    return merged(parts).groupBy("key").agg(F.count("*").alias("checks"), rollup(F.col("last_ok"), none).alias("status"))


def day_report(parts: DataFrame) -> DataFrame:
    """(day, n, n_ok, keys): checks of a day, those that were ok, and the keys that had any."""
    return parts.groupBy("day").agg(F.sum("n").alias("n"), F.sum("n_ok").alias("n_ok"), F.count_distinct("key").alias("keys"))


class RollupStore:
    """Parts in a folder: `upto=N`, all parts of the batches up to N, and `batch=M` of later ones."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def put(self, checks: DataFrame, batch: int) -> None:
        """The parts of one batch, for foreachBatch; the same batch again replaces them, one that is merged already is left out."""
        if batch > self._merged_upto():
            day_parts(checks).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def follow(self, checks: DataFrame, checkpoint: str):
        """Put a stream of checks into the store as far as it goes now; the checkpoint remembers which files have been read."""
        return checks.writeStream.foreachBatch(self.put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _numbers(self, kind: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not exists(self.spark, self.path):
            return []
        names = [s.getPath().getName() for s in at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)]
        whole = [int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=") and exists(self.spark, f"{self.path}/{n}/_SUCCESS")]
        return sorted(whole)

    def _merged_upto(self) -> int:
        return max(self._numbers("upto"), default=-1)

    def _folders(self) -> list[str]:
        upto = self._merged_upto()
        batches = [f"{self.path}/batch={n}" for n in self._numbers("batch") if n > upto]
        return ([f"{self.path}/upto={upto}"] if upto >= 0 else []) + batches

    def parts(self) -> DataFrame:
        """All parts; a folder counts once its writer has finished."""
        folders = self._folders()
        return self.spark.read.schema(PART).parquet(*folders) if folders else self.spark.createDataFrame([], PART)

    def compact(self) -> None:
        """Merge all parts into one folder. Readers take either the old folders or, once it is finished, the new one."""
        batches, upto = self._numbers("batch"), self._merged_upto()
        new = max([upto, *batches])
        if new == upto:
            return
        parts = self.parts()
        merged(parts, "day").select(*parts.columns).write.parquet(f"{self.path}/upto={new}")
        for n in batches:
            delete(self.spark, f"{self.path}/batch={n}")
        if upto >= 0:
            delete(self.spark, f"{self.path}/upto={upto}")


def replayed_parts(spark: SparkSession, checks: DataFrame, folder: str, files: int = 2) -> DataFrame:
    """The parts that a store has after checks arrived as a stream, a few files at a time."""
    path = f"{folder}/{uuid.uuid4().hex}"
    checks.write.parquet(f"{path}/log")
    store = RollupStore(spark, f"{path}/parts")
    store.follow(spark.readStream.schema(checks.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/log"), f"{path}/checkpoint").awaitTermination()
    store.compact()
    return store.parts()
