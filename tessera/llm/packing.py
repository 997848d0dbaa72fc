"""Packing of pieces into sequences: a configuration linear program over the length histogram.

The histogram has at most one entry for each length up to the sequence size, whatever the number of rows, so the plan is
made on the driver from it alone. Lengths are grouped to units; multiplicative weights solve the covering program whose
columns are whole sequences (configurations), each found by a knapsack dynamic program under the current weights. The
solution is rounded so that every configuration holds real pieces; the last place of each, known by its class only, and what the
rounding leaves over, with all short pieces, are then filled by best fit on exact lengths. The plan says which ranks of a length go where; executors look ranks up in it.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

SIZE = 4096
UNIT = 16
#: Pieces of fewer tokens are kept out of the program: they fill the gaps.
SHORT = 512
#: Most rounds of the program, the share of a demand that one round meets at most, and how fast weights fall with it.
ROUNDS, STEP, SHARP = 3000, 0.1, 10.0
ROWS_PER_PART = 1_000_000


def _knapsack(sizes: np.ndarray, prices: np.ndarray, room: int) -> np.ndarray:
    """How often each size stands in a dearest configuration of the given room (unbounded knapsack)."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.argsort(sizes, kind="stable")
    s, p = sizes[order], prices[order]
    fits = np.searchsorted(s, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            value = best[c - s[:k]] + p[:k]
            j = int(value.argmax())
            if value[j] > best[c]:
                best[c], pick[c] = value[j], j
    out, c = np.zeros(len(sizes), dtype=np.int64), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            out[order[pick[c]]] += 1
            c -= int(s[pick[c]])
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """Whole configurations with multiplicities that use no size more often than demanded.

    Multiplicative weights: a size's weight falls exponentially with the share of its demand that is met; each round adds
    a step of the dearest configuration, until all demand is met. Scaled so that no share exceeds one, then rounded to whole
    sequences as far as the demand allows.
    """
    if not len(sizes):
        return []
    met, taken = np.zeros(len(sizes)), {}
    for _ in range(rounds):
        weight = sizes / room * np.exp(-SHARP * (met - met.min()))
        a = _knapsack(sizes, weight, room)
        use = a > 0
        x = STEP * (demand[use] / a[use]).min()
        met[use] += x * a[use] / demand[use]
        key = a.tobytes()
        taken[key] = taken.get(key, 0.0) + x
        if met.min() >= 1:
            break
    out, left, scale = [], demand.copy(), max(1.0, float(met.max()))
    for key, x in sorted(taken.items(), key=lambda kv: -kv[1]):
        a = np.frombuffer(key, dtype=np.int64)
        use = a > 0
        m = min(int(np.ceil(x / scale)), int((left[use] // a[use]).min()))
        if m > 0:
            left -= m * a
            out.append((a, m))
    return out


class _Plan:
    """Runs of equal sequences with room left, and the placements made: (length, count, first sequence, offset)."""

    def __init__(self, size: int) -> None:
        self.size, self.n = size, 0
        self.placed: list[tuple[int, int, int, int]] = []
        self.rooms: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first, count)
        self.keys: list[int] = []

    def free(self, room: int, first: int, count: int) -> None:
        if room not in self.rooms:
            self.rooms[room] = []
            bisect.insort(self.keys, room)
        self.rooms[room].append((first, count))

    def best_fit(self, length: int, count: int) -> None:
        while count:
            at = bisect.bisect_left(self.keys, length)
            if at == len(self.keys):  # open new sequences, as full of this length as they get
                per = self.size // length
                full, rest = divmod(count, per)
                for k in range(per):
                    if full:
                        self.placed.append((length, full, self.n, k * length))
                if full:
                    self.free(self.size - per * length, self.n, full)
                    self.n += full
                for k in range(rest):
                    self.placed.append((length, 1, self.n, k * length))
                if rest:
                    self.free(self.size - rest * length, self.n, 1)
                    self.n += 1
                return
            room = self.keys[at]
            first, n = self.rooms[room].pop()
            if not self.rooms[room]:
                del self.rooms[room]
                self.keys.pop(at)
            k = min(n, count)
            self.placed.append((length, k, first, self.size - room))
            if n > k:
                self.free(room, first + k, n - k)
            self.free(room - length, first, k)
            count -= k


def plan(histogram: dict[int, int], size: int = SIZE, unit: int = UNIT, short: int = SHORT, rounds: int = ROUNDS) -> tuple[list[tuple[int, int, int, int]], int]:
    """Placements (length, count, first sequence, offset) of all pieces, and the number of sequences."""
    made = _Plan(size)
    left = dict(histogram)
    long = sorted((n for n in histogram if short <= n < size), reverse=True)
    by_class: dict[int, list[int]] = {}
    for n in long:
        by_class.setdefault(-(-n // unit), []).append(n)
    sizes = np.array(sorted(by_class), dtype=np.int64)
    demand = np.array([sum(histogram[n] for n in by_class[int(s)]) for s in sizes], dtype=np.int64)
    for a, m in configurations(sizes, demand, size // unit, rounds):
        runs = [(0, made.n, m)]  # (tokens in it, first, count): split wherever a length of the class runs out
        made.n += m
        # the smallest piece is left to the exact fit below: of all pieces left, the one that closes the gap best
        kinds = np.flatnonzero(a)
        open_slot = kinds[0] if a.sum() > 1 else -1
        for j in kinds[::-1]:
            lengths = by_class[int(sizes[j])]
            for _ in range(a[j] - (j == open_slot)):
                new = []
                for used, first, count in runs:
                    while count:
                        while not left[lengths[0]]:
                            lengths.pop(0)
                        n = lengths[0]
                        k = min(count, left[n])
                        left[n] -= k
                        made.placed.append((n, k, first, used))
                        new.append((used + n, first, k))
                        first, count = first + k, count - k
                runs = new
        for used, first, count in runs:
            made.free(size - used, first, count)
    for n in sorted(left, reverse=True):
        if left[n]:
            made.best_fit(n, left[n])
    return made.placed, made.n


def _pieces(path: str, end_id: int, size: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for batch in batches:
            for a, b in tokens.text_runs(batch.column("text")):
                ids, counts = tokens.with_end(*enc.ids(batch.column("text").slice(a, b - a).to_pylist()), end_id)
                ids = ids.astype("<u4")
                n_pieces = -(-counts // size)
                row = np.repeat(np.arange(len(counts)), n_pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                start = piece * size
                length = np.minimum(size, counts[row] - start)
                at = (np.cumsum(counts) - counts)[row] + start
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * x : 4 * (x + n)]) for x, n in zip(at.tolist(), length.tolist(), strict=True)]
                doc = batch.column("doc_id").slice(a, b - a).take(pa.array(row))
                out = [doc, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.view(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def pieces_of(docs: DataFrame, vocabulary: str, end_id: int = 1, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Token pieces of every whole text (null: empty): doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(_pieces(vocabulary, end_id, size, with_ids), schema)


def _look_up(starts: np.ndarray, base: np.ndarray, offset: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = (batch.column("length").to_numpy() << 44) + batch.column("_rank").to_numpy()
            at = np.searchsorted(starts, key, side="right") - 1
            keep = [n for n in batch.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in keep), pa.array(base[at] + key - starts[at]), pa.array(offset[at])], names=[*keep, "sequence_id", "offset"]
            )

    return run


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """pieces with sequence_id and offset added; needs a column `length` from 1 to size, other columns are kept.

    Repeated rows are packed each on its own; columns named sequence_id or offset are replaced; an empty table stays empty.
    Pieces of one length are numbered in parts of bounded size, so a length that most rows have makes no large task.
    """
    spark = pieces.sparkSession
    pieces = common.store(pieces.drop("sequence_id", "offset").withColumn("_rid", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    placed, _ = plan(histogram, size)
    order = sorted(range(len(placed)), key=lambda i: placed[i][0])
    n = np.array([placed[i][1] for i in order], dtype=np.int64)
    length = np.array([placed[i][0] for i in order], dtype=np.int64)
    total = np.cumsum(n) - n
    first_of = total[np.searchsorted(length, length, side="left")] if len(n) else total
    starts = (length << 44) + total - first_of
    look_up = _look_up(starts, np.array([placed[i][2] for i in order], dtype=np.int64), np.array([placed[i][3] for i in order], dtype=np.int64))
    n_parts = max(64, sum(histogram.values()) // ROWS_PER_PART)
    pieces = pieces.withColumn("_part", F.pmod(F.xxhash64("_rid"), F.lit(n_parts)).cast("int"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = pieces.groupBy("length", "_part").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("length", "_part").orderBy("_rid")
    ranked = pieces.withColumn("_r", F.row_number().over(inside) - 1).join(firsts, ["length", "_part"])
    ranked = ranked.withColumn("_rank", (F.col("_r") + F.col("_first")).cast("long")).drop("_r", "_first", "_part", "_rid")
    kept = [f for f in ranked.schema.fields if f.name != "_rank"]
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*kept, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(look_up, schema)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, size: int = SIZE) -> DataFrame:
    return pack(pieces_of(docs, vocabulary, end_id, size), size)
