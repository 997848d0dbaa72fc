"""A search of many sources as one plan: the URL that each source's rule makes of a keyword, the page fetched from it, and the rows
that the rule finds on the page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.extract.nodes import page_nodes
from tessera.extract.selectors import RESULT_FIELDS, item_fields, result_columns, rule_fields
from tessera.functions import urls as U
from tessera.operators.stored import Rounds


def requests(spark: SparkSession, keywords: DataFrame, rules: list[dict]) -> DataFrame:
    """(keyword, source_id, url) of every keyword(keyword) for every rule with a search path."""
    known = [F.struct(F.lit(r["id"]).alias("id"), F.lit(r["search"]["path"]).alias("path"), F.lit(r["host"]).alias("host")) for r in rules if r["search"].get("path")]
    if not known:
        return keywords.limit(0).select("keyword", F.lit("").alias("source_id"), F.lit("").alias("url"))
    each = keywords.select("keyword", F.inline(F.array(*known)))
    return each.select("keyword", F.col("id").alias("source_id"), U.full_url(U.apply_keyword(F.col("path"), F.col("keyword")), F.col("host")).alias("url"))


def search_sources(spark: SparkSession, keywords: DataFrame, pages: DataFrame, rules: list[dict]) -> DataFrame:
    """Result rows of keywords(keyword) at all sources: keyword, source_id, url and the columns of search_rows().

    pages(url, html) are what has been fetched; a request without a page has no rows. Pages meet their requests in one join, all of
    them are parsed in one pass, and the node rows are written by source, so that each rule reads its own. Rules are few and
    come as documents; keywords and pages may be many. Rows without a title go.
    """
    asked = requests(spark, keywords.distinct(), rules)
    fetched = pages.select("url", "html").join(asked, "url")
    keyed = fetched.select(F.struct("keyword", "source_id", "url").alias("request"), "html")
    rounds = Rounds(spark)
    nodes = rounds.keep(page_nodes(keyed, "request", "html").withColumn("source_id", F.col("_key.source_id")), "source_id")
    parts = []
    for rule in rules:
        own = nodes.filter(F.col("source_id") == rule["id"]).drop("source_id")
        found = item_fields(own, rule["search"]["item"], rule_fields(rule)).filter("title <> ''")
        parts.append(found.select("_key.keyword", "_key.source_id", "_key.url", F.col("_ord").alias("ord"), *result_columns(rule)))
    empty = spark.createDataFrame([], "keyword string, source_id string, url string, ord long, " + ", ".join(f"{c} string" for c in RESULT_FIELDS.values()) + ", weight int")
    out = rounds.keep(reduce(DataFrame.unionByName, parts, empty))
    rounds.drop(nodes)
    return out
