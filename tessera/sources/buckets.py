"""Keyed tables in buckets, so that a keyed write rewrites only the buckets that its keys fall into.

Rows lie in folders by the hash of their key. A manifest names the folder of each bucket; a write puts new folders beside the old
ones and then, in one rename, a new manifest in place. Whoever reads has one manifest's state, a write that fails before the
rename has changed nothing, and of two writes at a time the second one to finish fails.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.stored import delete
from tessera.sources.tables import exists

BUCKETS = 64


class BucketTable:
    """The table at `path`; `keys` are the columns that a row is known by. A null key is a key like others."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    # --- manifests ------------------------------------------------------------------------------------------------

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the newest manifest, 0 before the first write."""
        jvm, fs = self._fs()
        if not exists(self.spark, f"{self.path}/manifests"):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests"))]
        return max([int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n)], default=0)

    def manifest(self) -> dict:
        """{"schema": ..., "folders": {bucket: folder}} of the newest state."""
        now = self.version()
        text = self.spark.read.text(f"{self.path}/manifests/{now:012d}.json").first()[0] if now else '{"schema": null, "folders": {}}'
        return json.loads(text)

    def _commit(self, after: int, manifest: dict) -> None:
        """Put the manifest in place as the one after version `after`; fails if someone else has."""
        jvm, fs = self._fs()
        Path = jvm.org.apache.hadoop.fs.Path
        draft, place = Path(f"{self.path}/manifests/.{uuid.uuid4().hex}"), Path(f"{self.path}/manifests/{after + 1:012d}.json")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        # a rename that doesn't replace
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(fs.makeQualified(draft), fs.makeQualified(place), none)

    # --- rows -----------------------------------------------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/{f}" for b, f in manifest["folders"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(manifest["schema"]).parquet(*folders) if folders else self.spark.createDataFrame([], manifest["schema"])

    def rows(self) -> DataFrame:
        return self._read(self.manifest())

    def look_up(self, *key) -> DataFrame:
        """The rows of one key: reads its bucket only."""
        manifest = self.manifest()
        kinds = self._read(manifest, []).schema
        given = [F.lit(v).cast(kinds[k].dataType) for k, v in zip(self.keys, key, strict=True)]
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(*given), F.lit(self.buckets)).alias("b")).first().b
        out = self._read(manifest, [bucket])
        for k, v in zip(self.keys, given, strict=True):
            out = out.filter(F.col(k).eqNullSafe(v))
        return out

    def _write(self, df: DataFrame, buckets: list[int]) -> dict[str, str]:
        """Write rows into new folders and name those of the buckets; a bucket without rows has none."""
        folder = f"data/{uuid.uuid4().hex}"
        out = df.withColumn("_bucket", self._bucket())
        out.repartition(max(1, min(self.buckets, len(buckets))), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        return {str(b): f"{folder}/_bucket={b}" for b in buckets if exists(self.spark, f"{self.path}/{folder}/_bucket={b}")}

    def change(self, new: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the buckets that new's keys fall into by how(their rows, new); returns their numbers. `how` must not move a row to
        another key. The columns are those of the first write."""
        at, manifest = self.version(), self.manifest()
        touched = sorted(r.b for r in new.select(self._bucket().alias("b")).distinct().collect())  # at most one for each bucket
        if not touched:
            return []
        if manifest["schema"] is None:
            manifest["schema"] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema)
        old = self._read(manifest, touched)
        folders = {b: f for b, f in manifest["folders"].items() if int(b) not in touched}
        folders |= self._write(how(old, new.select(*old.columns)).select(*old.columns), touched)
        self._commit(at, {"schema": manifest["schema"], "folders": folders})
        return touched

    def append(self, new: DataFrame) -> list[int]:
        return self.change(new, lambda old, more: old.unionByName(more))

    def vacuum(self) -> None:
        """Delete folders and manifests that the newest state doesn't name. Nobody may be writing or reading an older state."""
        jvm, fs = self._fs()
        Path = jvm.org.apache.hadoop.fs.Path
        now, used = self.version(), set(self.manifest()["folders"].values())
        for run in fs.listStatus(Path(f"{self.path}/data")):
            for bucket in fs.listStatus(run.getPath()):
                name = f"data/{run.getPath().getName()}/{bucket.getPath().getName()}"
                if name not in used:
                    delete(self.spark, f"{self.path}/{name}")
        for old in fs.listStatus(Path(f"{self.path}/manifests")):
            if old.getPath().getName() != f"{now:012d}.json":
                delete(self.spark, f"{self.path}/manifests/{old.getPath().getName()}")
