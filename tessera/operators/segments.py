"""Long histories of one key, cut into segments that are worked on side by side.

What depends on all earlier rows of a key is computed inside each segment, summed up in a row a segment, and carried over those
few rows. Only hot keys are cut, at quantiles of their times; every other key is one segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is hot with more than one row in so many. There are fewer hot keys than this, whatever the input.
SHARE = 1000
#: Segments of a hot key, about equal in rows. Rows of one key and one time stay together.
PARTS = 64
WHOLE = -1


def with_segments(df: DataFrame, key: str, time: str, share: int = SHARE, parts: int = PARTS) -> DataFrame:
    """df with _seg: the segment of the row's time in its key's history, counted from 0, or WHOLE for a key that isn't hot.

    The cuts are a table of at most share * parts numbers; they are a function of the rows alone, so every branch of a plan sees
    the same segments. A null key is a key like others, null times come first.
    """
    at = F.unix_micros(F.col(time).cast("timestamp")) if df.schema[time].dataType.simpleString().startswith("timestamp") else F.col(time).cast("double")
    rows = df.select(F.col(key).alias("_k"), at.alias("_at"))
    counts = rows.groupBy("_k").agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    hot = counts.join(F.broadcast(total), F.col("_n") * share > F.col("_total")).select(F.col("_k").alias("_hot"))
    same = F.col("_k").eqNullSafe(F.col("_hot"))
    quantiles = F.percentile_approx("_at", [i / parts for i in range(1, parts)], 100 * parts)
    cuts = rows.join(F.broadcast(hot), same).groupBy("_hot").agg(F.array_sort(F.array_distinct(F.coalesce(quantiles, F.array()))).alias("_cuts"))
    out = df.join(F.broadcast(cuts), F.col(key).eqNullSafe(F.col("_hot")), "left")
    number = F.size(F.filter("_cuts", lambda c: c < at))
    return out.withColumn("_seg", F.when(F.col("_cuts").isNull(), F.lit(WHOLE)).otherwise(F.coalesce(number, F.lit(0)))).drop("_hot", "_cuts")


def later(key: str, column: str) -> Column:
    """The sum of a column over the key's later segments."""
    w = Window.partitionBy(key).orderBy("_seg").rowsBetween(1, Window.unboundedFollowing)
    return F.coalesce(F.sum(column).over(w), F.lit(0))
