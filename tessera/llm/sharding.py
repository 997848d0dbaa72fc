"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

How many rows each input bucket sends to each shard is drawn first, exactly: the rows of a uniformly shuffled table
that fall into the shards are, bucket by bucket, multivariate hypergeometric. Then every bucket permutes its rows on its
own, sends runs of the drawn lengths to the shards, and every shard permutes what it got. All row work is DataFrame
operations; the driver only sees one count for each bucket.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

ROWS_PER_BUCKET = 1_000_000
LEAST_BUCKETS = 256


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` items taken from good + bad items are good: inversion outwards from the mode.

    Works for any size (the usual library routine stops at 10**9 items) in about as many steps as the standard deviation.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    lg = math.lgamma

    def log_choose(n: int, k: int) -> float:
        return lg(n + 1) - lg(k + 1) - lg(n - k + 1)

    top = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    left = right = top
    down, up = mode, mode
    u = rng.random() - top
    while u > 0 and (down > low or up < high):
        if up < high:
            right *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= right
            if u <= 0:
                return up
        if down > low:
            left *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= left
            if u <= 0:
                return down
    return mode


def communication_matrix(buckets: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Counts bucket x shard with exactly these row and column sums, drawn as a uniform shuffle would make them."""
    assert sum(buckets) == sum(shards)
    rng, left, out = random.Random(seed), list(shards), []
    for size in buckets:
        row, draws, rest = [], size, sum(left)
        for s, room in enumerate(left):
            k = hypergeometric(rng, room, rest - room, draws)
            row.append(k)
            rest -= room
            draws -= k
            left[s] -= k
        out.append(row)
    return out


def exact_shards(df: DataFrame, n_shards: int, seed: int = 1, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The rows with `shard` (0 to n_shards - 1) and `slot` (place in the shard, gapless from 0).

    Every order of the rows is equally likely up to the hash's quality; shard sizes differ by one at most. Nulls, empty texts
    and repeated rows are rows like any other (a row's number, not its content, decides its place); an empty table gives
    an empty result. Columns named shard or slot are replaced. The input is written once to the shared folder, so that
    row numbers are the same in every pass and after the loss of an executor.
    """
    spark = df.sparkSession
    rows = common.store(df.drop("shard", "slot").withColumn("_rid", F.monotonically_increasing_id()), "shard-rows")
    n = rows.count()
    n_buckets = max(LEAST_BUCKETS, -(-n // rows_per_bucket))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), "_rid"), F.lit(n_buckets)).cast("int"))
    counts = {r["_bucket"]: r["count"] for r in rows.groupBy("_bucket").count().collect()}  # one row for each bucket
    sizes = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    order = sorted(counts)
    matrix = communication_matrix([counts[b] for b in order], sizes, seed)
    ends = spark.createDataFrame(
        [(b, [sum(row[: s + 1]) for s in range(n_shards)]) for b, row in zip(order, matrix, strict=True)], "_bucket int, _ends array<long>"
    )
    # permute inside the bucket, then cut the permuted bucket into the drawn runs
    local = Window.partitionBy("_bucket").orderBy(F.xxhash64(F.lit(seed + 1), "_rid"), "_rid")
    sent = (
        rows.withColumn("_rank", F.row_number().over(local) - 1)
        .join(ends, "_bucket")
        .withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))).cast("int"))
        .drop("_ends", "_rank", "_bucket")
    )
    # permute again inside the shard: random parts of bounded size, numbered one after the other
    n_parts = max(16, -(-sizes[0] // rows_per_bucket)) if n else 1
    sent = sent.withColumn("_part", F.pmod(F.xxhash64(F.lit(seed + 2), "_rid"), F.lit(n_parts)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sent.groupBy("shard", "_part").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    again = Window.partitionBy("shard", "_part").orderBy(F.xxhash64(F.lit(seed + 3), "_rid"), "_rid")
    return (
        sent.withColumn("_rank", F.row_number().over(again) - 1)
        .join(firsts, ["shard", "_part"])
        .withColumn("slot", (F.col("_first") + F.col("_rank")).cast("long"))
        .drop("_first", "_rank", "_part", "_rid")
    )
