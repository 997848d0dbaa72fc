"""Readers: Parquet tables, JSON rule documents with explicit schemas, and ordered fall-back locations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The formats of a registry's documents.
RULE_SCHEMA = (
    "id STRING, name STRING, host STRING, language STRING, weight INT, enabledByDefault BOOLEAN, mode STRING, version STRING, riskLevel STRING, "
    "search STRUCT<path: STRING, item: STRING, title: STRING, url: STRING, cover: STRING, latest: STRING, status: STRING, updateTime: STRING>, "
    "detail STRUCT<title: STRING, cover: STRING, author: STRING, description: STRING, status: STRING, latestChapter: STRING>, "
    "chapters STRUCT<list: STRING, title: STRING, url: STRING>, images STRUCT<list: STRING, srcAttr: STRING>"
)
SOURCE_SCHEMA = (
    "id STRING, name STRING, host STRING, enabled BOOLEAN, language STRING, weight INT, tags ARRAY<STRING>, mode STRING, "
    "search STRUCT<url: STRING, method: STRING, keywordParam: STRING, responseType: STRING, listSelector: STRING, titleSelector: STRING, coverSelector: STRING, "
    "detailUrlSelector: STRING, latestChapterSelector: STRING, statusSelector: STRING, updateTimeSelector: STRING>, headers MAP<STRING, STRING>, timeoutMs INT"
)
INDEX_SCHEMA = (
    "version STRING, updatedAt STRING, count INT, sources ARRAY<STRUCT<id: STRING, name: STRING, language: STRING, host: STRING, version: STRING, riskLevel: STRING, "
    "enabledByDefault: BOOLEAN, url: STRING, status: STRING, failureCount: INT>>"
)
MANIFEST_SCHEMA = "name STRING, version STRING, updatedAt STRING, sourceCount INT, minClientVersion STRING, indexUrl STRING"
AD_SCHEMA = "enabled BOOLEAN, configUrl STRING, updatedAt STRING"
HEALTH_SCHEMA = (
    "generatedAt STRING, total INT, checked INT, networkCheckEnabled BOOLEAN, stateChanges INT, items ARRAY<STRUCT<id: STRING, name: STRING, host: STRING, status: STRING, "
    "riskLevel: STRING, ok: BOOLEAN, reason: STRING, checkedAt: STRING, consecutiveFailures: INT, consecutiveSuccesses: INT, totalFailures: INT, previousStatus: STRING>>"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents of one file or folder; fields that don't fit are null."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row for each source that a registry index lists."""
    return read_documents(spark, path, INDEX_SCHEMA).selectExpr("inline(sources)")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_documents(spark, path, MANIFEST_SCHEMA)


def read_health(spark: SparkSession, path: str) -> DataFrame:
    """One row for each source that a health report lists."""
    return read_documents(spark, path, HEALTH_SCHEMA).selectExpr("inline(items)")


def read_ads(spark: SparkSession, path: str) -> DataFrame:
    """The advertisement settings: off if they are missing or can't be read."""
    found = read_first(spark, [path], AD_SCHEMA).agg(F.first("enabled", True).alias("enabled"), F.first("configUrl", True).alias("configUrl"), F.first("updatedAt", True).alias("updatedAt"))
    return found.select(F.coalesce("enabled", F.lit(False)).alias("enabled"), F.coalesce("configUrl", F.lit("")).alias("configUrl"), "updatedAt")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_first(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The documents of the first location that exists; none, no rows."""
    for path in paths:
        if exists(spark, path):
            return read_documents(spark, path, schema)
    return spark.createDataFrame([], schema)


def snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append_log(df: DataFrame, path: str, by: str | None = None) -> None:
    """Append rows to a log; `by` names a column (such as the day) whose values become folders that later reads can skip."""
    out = df.write.mode("append")
    (out.partitionBy(by) if by else out).parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
