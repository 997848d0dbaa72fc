"""Logs in order, for pages and look-ups that read only their own files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_GROUP = 16 << 20
_IN_PART = (1 << 33) - 1


class PagedLog:
    """A log at `path`, sorted in ranges. Every row knows its range and its place in it, and how many rows the ranges have is a small
    table, so that page k is found without sorting or skipping."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, df: DataFrame, *order: Column | str) -> None:
        """Sort and write the rows. Nulls stand where the order has them; rows that are equal in the order stay in one order for good."""
        m = F.monotonically_increasing_id()
        placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", m)
        placed = placed.withColumn("_part", F.shiftright("_m", 33).cast("int")).withColumn("_at", F.col("_m").bitwiseAND(F.lit(_IN_PART))).drop("_m")
        placed.write.partitionBy("_part").parquet(f"{self.path}/rows")
        self._rows().groupBy("_part").agg(F.count("*").alias("n")).write.parquet(f"{self.path}/sizes")

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def _ranges(self) -> list[tuple[int, int, int]]:
        """(range, rows before it, rows in it): one for each range."""
        out, before = [], 0
        for part, n in sorted((r[0], r.n) for r in self.spark.read.parquet(f"{self.path}/sizes").collect()):
            out.append((part, before, n))
            before += n
        return out

    def page(self, limit: int | None = None, offset: int | None = None) -> DataFrame:
        """The rows at the places from offset on; a limit of 0 or none is 50. Only ranges with rows of the page are read."""
        first, last = offset or 0, (offset or 0) + (limit or 50)
        own = [(p, max(0, first - b), min(n, last - b)) for p, b, n in self._ranges() if b < last and b + n > first]
        where = [(F.col("_part") == p) & (F.col("_at") >= a) & (F.col("_at") < z) for p, a, z in own]
        rows = self._rows().filter(reduce(lambda x, y: x | y, where, F.lit(False)))
        return rows.orderBy("_part", "_at").limit(last - first).drop("_part", "_at")  # top rows, not a sort of all

    def count(self) -> int:
        return sum(n for _, _, n in self._ranges())

    def page_after(self, is_upto: Column, limit: int | None = None) -> DataFrame:
        """The page behind a cursor: is_upto tells, in the log's order, which rows come up to it. Only the range that the cursor falls into
        is counted, found by the ranges' first rows."""
        at = self._rows().filter(F.col("_at") == 0).filter(is_upto).agg(F.max("_part")).first()[0]
        if at is None:
            return self.page(limit, 0)
        before = next(b for p, b, _ in self._ranges() if p == at)
        return self.page(limit, before + self._rows().filter((F.col("_part") == at) & is_upto).count())


def write_clustered(df: DataFrame, path: str, by: list[str], look_up: dict[str, int] | None = None, row_group: int = ROW_GROUP) -> None:
    """Write rows clustered by some columns, with Bloom filters for others: name and about how many values a file has. A look-up by the
    first of `by` opens the row groups around it, one by a filtered column those that may hold the value."""
    out = df.repartitionByRange(*by).sortWithinPartitions(*by).write.option("parquet.block.size", row_group)
    for name, values in (look_up or {}).items():
        out = out.option(f"parquet.bloom.filter.enabled#{name}", "true").option(f"parquet.bloom.filter.expected.ndv#{name}", values)
    out.parquet(path)
