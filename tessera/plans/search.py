"""Federated keyword search as one plan: corpora to one shape, filter, union, counts by source, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.keyed import top_per_key
from tessera.sources.tables import table

#: corpus -> columns of an item's number and its text, and rank among sources
CORPORA = {"documents": ("doc_id", "text", 0), "benchmark": ("item_id", "text", 1), "conversations": ("conv_id", "text", 1), "pages": ("page_id", "html", 2)}


def matches(text: Column, keyword: str) -> Column:
    return F.coalesce(F.contains(F.lower(text), F.lit(keyword.lower())), F.lit(False))


def hits(spark: SparkSession, sf_dir: str, keyword: str, corpora: dict = CORPORA) -> DataFrame:
    """(source, rank, item, hit) for every row of every corpus: only two columns of each are read."""
    out = None
    for name, (key, text, rank) in corpora.items():
        one = table(spark, sf_dir, name).select(F.lit(name).alias("source"), F.lit(rank).alias("rank"), F.col(key).alias("item"), matches(F.col(text), keyword).alias("hit"))
        out = one if out is None else out.unionByName(one)
    return out


def aggregated_search(spark: SparkSession, sf_dir: str, keyword: str = "ing") -> DataFrame:
    """Per source: rows searched, results, first item found, and its rank in the answer."""
    found = hits(spark, sf_dir, keyword)
    by = found.groupBy("source", "rank").agg(
        F.count("*").alias("searched"), F.count_if("hit").alias("results"), F.min(F.when(F.col("hit"), F.col("item"))).alias("first_item")
    )
    return by.select("source", "rank", "searched", "results", "first_item", (F.col("results") > 0).alias("ok"))


def summary(groups: DataFrame) -> DataFrame:
    return groups.agg(F.sum("results").alias("total"), F.count("*").alias("sources"), F.count_if(~F.col("ok")).alias("empty"))


def outcome(asked: DataFrame) -> DataFrame:
    """One row about asked(state, results): results in all, sources searched, failed and skipped."""
    state = F.col("state")
    return asked.agg(
        F.coalesce(F.sum(F.when(state == "ok", F.col("results"))), F.lit(0)).alias("total_results"), F.count_if(state != "skipped").alias("searched"),
        F.count_if(state == "failed").alias("failed"), F.count_if(state == "skipped").alias("skipped"),
    )


def grouped(found: DataFrame, each: int = 20) -> DataFrame:
    """(source, results, items): of each source the number of hits and the first `each` items as an array, one page of them."""
    hit = found.filter("hit")
    first = top_per_key(hit.select("source", "item"), ["source"], [F.col("item")], each)
    items = first.groupBy("source").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return hit.groupBy("source").agg(F.count("*").alias("results")).join(items, "source")
