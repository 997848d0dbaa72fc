"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file row is a block of whole documents. The block's ids are replaced by their rank in the block's own frequency order
(rank 0 is the commonest), so that common ids take one byte; `ranks` lists the ids in that order. Two bits of `control` hold
the byte length of each rank, four ranks to a byte; `data` holds the ranks' bytes, low byte first. Blocks stand in
ascending order of doc_id: by `part`, then `block`. Container: Parquet, which any store that Spark reaches can hold.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

BLOCK_IDS = 1_000_000
FILE_SCHEMA = "part int, block int, first long, n_ids long, doc_ids array<long>, counts array<int>, ranks binary, control binary, data binary"
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1  # control byte -> four lengths


def encode_block(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(ranks, control, data) of a block of ids."""
    n = np.bincount(ids)
    order = np.argsort(-n, kind="stable")[: np.count_nonzero(n)]
    rank_of = np.zeros(len(n), dtype=np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    rank = rank_of[ids]
    length = np.ones(len(ids), dtype=np.uint8)
    places = [slice(None)]  # of the ranks that have a byte more
    for b in range(1, 4):
        if len(order) <= 1 << (8 * b):
            break
        places.append(np.flatnonzero(rank >= np.uint32(1 << (8 * b))))
        length[places[b]] += 1
    off = np.cumsum(length, dtype=np.int64) - length
    data = np.empty(int(off[-1]) + int(length[-1]) if len(ids) else 0, dtype=np.uint8)
    for b, at in enumerate(places):
        data[off[at] + b] = (rank[at] >> np.uint32(8 * b)).astype(np.uint8)
    code = np.zeros(-(-len(ids) // 4) * 4, dtype=np.uint8)
    code[: len(ids)] = length - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    return order.astype("<u4").tobytes(), control.tobytes(), data.tobytes()


def decode_block(ranks: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    """The block's ids: lengths by table lookup of the control bytes, then one gather for each byte place."""
    length = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n].astype(np.int64)
    off = np.cumsum(length) - length
    raw = np.frombuffer(data, dtype=np.uint8)
    rank = raw[off].astype(np.uint32)
    for b in range(1, int(length.max(initial=1))):
        has = np.flatnonzero(length > b)
        rank[has] |= raw[off[has] + b].astype(np.uint32) << np.uint32(8 * b)
    return np.frombuffer(ranks, dtype="<u4")[rank]


def _encode_partition(path: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = tokens.encoder(path), TaskContext.get().partitionId()
        schema = pa.schema(
            [("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))]
            + [(c, pa.binary()) for c in ("ranks", "control", "data")]
        )
        held, docs, counts, block, first = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, docs, counts, block, first
            ids = np.concatenate(held)
            row = [part, block, first, len(ids), docs, counts, *encode_block(ids)]
            block, first = block + 1, first + len(ids)
            held, docs, counts = [], [], []
            return pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for a, b in tokens.text_runs(batch.column("text")):
                run_ids = batch.column("doc_id").slice(a, b - a).to_pylist()
                ids, n = tokens.with_end(*enc.ids(batch.column("text").slice(a, b - a).to_pylist()), end_id)
                ends, cut, k = np.cumsum(n), 0, 0
                have = sum(map(len, held))
                for i in range(len(n)):  # close a block at the first document that fills it
                    if have + ends[i] - cut >= block_ids:
                        held.append(ids[cut : ends[i]])
                        docs += run_ids[k : i + 1]
                        counts += n[k : i + 1].tolist()
                        yield flush()
                        cut, k, have = int(ends[i]), i + 1, 0
                held.append(ids[cut:])
                docs += run_ids[k:]
                counts += n[k:].tolist()
        if docs:
            yield flush()

    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole text (null: empty) of docs(doc_id, text) and write blocks in ascending doc_id order.

    A null doc_id sorts first; rows with one doc_id keep the order of their texts; an empty table writes no block.
    One shuffle (a range partitioning by doc_id); ids are ranked and coded as they are made, in blocks of bounded size.
    """
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_encode_partition(vocabulary, end_id, block_ids), FILE_SCHEMA).write.option("compression", "zstd").parquet(path)


def _decode(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                n = row["n_ids"].as_py()
                ids = decode_block(*(row[c].as_buffer() for c in ("ranks", "control", "data")), n).astype("<u4")
                counts = row["counts"].values.to_numpy().astype(np.int64)
                ends = np.cumsum(counts)
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                out = [pa.array([row["part"].as_py()] * len(counts), pa.int32()), row["doc_ids"].values, pa.array(row["first"].as_py() + ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
                names = ["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.view(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, its ids."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    schema = "part int, doc_id long, start_in_part long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = files.mapInArrow(_decode(with_ids), schema)
    # one row for each part: the sum of what stands before it
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    out = rows.join(parts, "part").withColumn("start", F.col("base") + F.col("start_in_part"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def roundtrip(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Write token files to the shared folder and read them back."""
    path = common.new_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, vocabulary, end_id)
    return read_token_files(docs.sparkSession, path)
