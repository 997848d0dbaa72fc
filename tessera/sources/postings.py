"""Substring search by postings: which texts hold which runs of three characters.

The index is three tables: postings ordered by run, how many texts each run has, and the texts under their numbers. A posting is a run, a
block of 64 texts with numbers in a row, and a bit for each of them, so that common runs take a row a block. A search reads the
counts of the keyword's runs, the postings of the few rarest ones, and of the texts only the row groups that may hold one of
the candidates; what it reads shrinks with the rarity of the keyword.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.stored import delete

#: So many of a keyword's rarest runs are looked up; a candidate has all of them.
RAREST = 3
#: Up to so many candidates are looked up by number; more are joined.
BY_NUMBER = 2000
ROW_GROUP = 4 << 20
#: Bits of a text's number that are its place in a block.
BLOCK_BITS = 6


def run_codes(text: str) -> np.ndarray:
    """A number for each run of three characters of a text: 21 bits a character."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:]


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, block, texts) of the texts of each batch; a block that two batches share has rows from both."""
    for batch in batches:
        ids = batch.column("_id").to_numpy()
        blocks = ids >> BLOCK_BITS
        cuts = np.flatnonzero(np.diff(blocks, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True):
            codes = [run_codes(t) for t in batch.column("_low").slice(a, b - a).to_pylist()]
            code = np.concatenate(codes)
            if not len(code):
                continue
            bit = np.repeat(np.uint64(1) << (ids[a:b] & (1 << BLOCK_BITS) - 1).astype(np.uint64), [len(c) for c in codes])
            order = np.argsort(code)
            code = code[order]
            first = np.flatnonzero(np.diff(code, prepend=-1))
            texts = np.bitwise_or.reduceat(bit[order], first).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(code[first]), pa.array(np.full(len(first), blocks[a])), pa.array(texts)], names=["run", "block", "texts"])


class Postings:
    """The index in the folder `path`. Letters count alike; a text of any length and repeated or keyless rows are held like others, null
    texts are never found."""

    def __init__(self, spark: SparkSession, path: str, row_group: int = ROW_GROUP) -> None:
        self.spark, self.path, self.row_group = spark, path.rstrip("/"), row_group

    def _write(self, df: DataFrame, name: str, *order: str) -> None:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
        df.write.option("parquet.block.size", self.row_group).parquet(f"{self.path}/{name}")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def build(self, docs: DataFrame, text: str) -> None:
        """Index docs by the column `text`; all its columns are kept."""
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        # numbers rise within a file, and files have ranges of their own
        texts = docs.filter(F.col(text).isNotNull()).select(F.lower(text).alias("_low"), row.alias("_row")).withColumn("_id", F.monotonically_increasing_id())
        self._write(texts, "texts")
        # found once and kept, as ranges are drawn from a first look at the rows
        self._write(self._read("texts").select("_id", "_low").mapInArrow(_block_rows, "run long, block long, texts long"), "blocks")
        self._write(self._read("blocks"), "postings", "run", "block")
        delete(self.spark, f"{self.path}/blocks")
        self._write(self._read("postings").groupBy("run").agg(F.sum(F.bit_count("texts")).alias("n")), "counts", "run")

    def search(self, keyword: str) -> DataFrame:
        """The rows whose text has the keyword. A keyword shorter than a run is looked for in all texts."""
        texts, low = self._read("texts"), F.lower(F.lit(keyword))
        held = F.contains("_low", low)
        wanted = np.unique(run_codes(self.spark.range(1).select(low).first()[0])).tolist()
        if not wanted:
            return texts.filter(held).select("_row.*")
        counts = sorted((r.n, r.run) for r in self._read("counts").filter(F.col("run").isin(wanted)).collect())
        if len(counts) < len(wanted):
            return texts.filter(F.lit(False)).select("_row.*")
        rarest = [run for _, run in counts[:RAREST]]
        each = [F.bit_or(F.when(F.col("run") == run, F.col("texts"))) for run in rarest]
        both = self._read("postings").filter(F.col("run").isin(rarest)).groupBy("block").agg(reduce(Column.bitwiseAND, each).alias("texts")).filter("texts <> 0")
        places = F.filter(F.sequence(F.lit(0), F.lit((1 << BLOCK_BITS) - 1)), lambda k: F.getbit("texts", k) == 1)
        found = both.select("block", F.explode(places).alias("place")).select((F.shiftleft("block", BLOCK_BITS) + F.col("place")).alias("_id"))
        some = [r[0] for r in found.limit(BY_NUMBER + 1).collect()] if counts[0][0] <= BY_NUMBER else None
        near = texts.filter(F.col("_id").isin(some)) if some is not None else texts.join(found, "_id", "left_semi")
        return near.filter(held).select("_row.*")
