"""Tables that an operator writes for itself into a folder that all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; the warehouse where a local session names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


class Rounds:
    """Tables of one run, in a folder of their own below `folder`: keep() writes one and reads it back, drop() deletes tables that
    nothing reads any more."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.path, self.paths = spark, f"{folder or shared_folder(spark) + '/rounds'}/{uuid.uuid4().hex}", {}

    def keep(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """by: a column whose values become folders that later reads can skip."""
        path = f"{self.path}/{len(self.paths)}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path, out
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            delete(self.spark, self.paths[id(df)][0])


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
