"""Importance resampling towards a target: hashed n-grams weigh each document by how much more often the target has them.

Features are exploded word n-grams, put into a fixed number of buckets by crc32. Both sides' counts are aggregated by bucket, the
log ratio of their smoothed shares is a bucket's gain, and a document's weight is the mean gain of its features. A Gumbel number
fixed by the document's id is added, so the highest scores are a draw without replacement. Spark's own functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .decontamination import words_of

BUCKETS, ORDERS, SEED, PERCENT, LEAST_WORDS = 10_000, (1, 1), 2024, 10, 20
_IN_PARTITION = (1 << 33) - 1


def ngrams(words: Column, orders: tuple[int, int] = ORDERS) -> Column:
    """All runs of orders[0] to orders[1] consecutive words, joined by a space, with repeats."""

    def runs(n: int) -> Column:
        if n == 1:
            return words
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.concat(*[runs(n) for n in range(orders[0], orders[1] + 1)])


def bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def bucket_counts(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, orders: tuple[int, int] = ORDERS) -> DataFrame:
    """(bucket, s, t): features of docs and of the target in each bucket that either has; at most `buckets` rows."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        features = df.select(F.explode(ngrams(words_of(F.col("text")), orders)).alias("f"))
        return features.groupBy(bucket(F.col("f"), buckets).alias("bucket")).agg(F.count("*").alias(name))

    both = counted(docs, "s").join(counted(target, "t"), "bucket", "full")
    return both.select("bucket", F.coalesce("s", F.lit(0)).cast("long").alias("s"), F.coalesce("t", F.lit(0)).cast("long").alias("t"))


def bucket_gains(counts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain): floored thousandths of the log ratio of the smoothed shares."""
    total = counts.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    s, t = (float(n) + buckets for n in total)
    ratio = (F.col("t") + 1.0) * F.lit(s) / ((F.col("s") + 1.0) * F.lit(t))
    return counts.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Floored thousandths of a Gumbel number that seed and doc_id decide; a null doc_id counts as an empty one."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranks(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with their rank (from 1) in the order: sorted in ranges, numbered inside each, and moved up by the sizes of the ranges
    before. The sorted rows are stored once, so that numbers and sizes are those of the same rows."""
    m = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", m)
    placed = placed.withColumn("_part", F.shiftright("_m", 33).cast("int")).withColumn("_at", F.col("_m").bitwiseAND(F.lit(_IN_PARTITION)))
    placed = common.store(placed.drop("_m"), "ranks")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def resample(
    docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, orders: tuple[int, int] = ORDERS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS
) -> DataFrame:
    """For each row of docs: doc_id, n_features, weight, score, rank (null where it isn't drawn).

    docs needs doc_id and text, target text; other columns are ignored. Null and empty texts have no features and weight 0.
    Drawn are `percent` of the rows with at least `least_words` words, by score, then smaller doc_id (rows without one last), then
    the text's hash; repeated rows are rows like others and take ranks one after the other. Empty docs give no rows, an empty
    target makes rare features weigh most.
    """
    gains = bucket_gains(common.store(bucket_counts(docs, target, buckets, orders), "bucket-counts"), buckets)
    words = docs.select("doc_id", F.xxhash64("text").alias("t"), words_of(F.col("text")).alias("w"))
    each = words.select("doc_id", "t", F.size("w").alias("n_words"), F.posexplode_outer(ngrams(F.col("w"), orders)).alias("pos", "f"))
    each = each.withColumn("bucket", bucket(F.col("f"), buckets)).drop("f").join(F.broadcast(gains), "bucket", "left")
    # rows that repeat are summed together and parted again: no number of a row has to outlive a lost executor
    copies = F.count_if(F.col("pos").isNull() | (F.col("pos") == 0))
    summed = each.groupBy("doc_id", "t", "n_words").agg(copies.alias("copies"), F.count("bucket").alias("n"), F.coalesce(F.sum("gain"), F.lit(0)).alias("gain"))
    one = summed.select("doc_id", "t", "n_words", "copies", F.expr("n div copies").alias("n_features"), F.expr("gain div copies").alias("gain"))
    mean = F.when(F.col("n_features") == 0, F.lit(0)).otherwise(F.expr("(gain - pmod(gain, n_features)) div n_features")).cast("long")
    scored = one.withColumn("weight", mean).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = common.store(scored.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies", "gain"), "scored")
    able = F.col("n_words") >= least_words
    drawn = scored.filter(able).count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("t").asc(), F.col("copy").asc()]
    ranked = ranks(scored.filter(able), order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = ["doc_id", "n_features", "weight", "score"]
    rest = scored.filter(~able).select(*out, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*out, "rank").unionByName(rest)
