"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

U64 = np.uint64
_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors see; one of our own only where a local session names none (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _ROOTS[app], ignore_errors=True)
    return f"file://{_ROOTS[app]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write the frame once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def store_parts(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """store() of frames of one schema, one after the other, into one table; each one's shuffle files go before the next is written."""
    path = ""
    for df in parts:
        spark, schema = df.sparkSession, df.schema
        path = path or new_path(spark, name)
        df.write.mode("append").option("compression", "zstd").parquet(path)
        del df
        clean(spark)
    out = spark.read.schema(schema).parquet(path)
    out._stored_at = path
    return out


def store_bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """store() in buckets of a key by which df is dealt out to spark.sql.shuffle.partitions tasks: joins on it don't move these rows again."""
    spark = df.sparkSession
    path, named = new_path(spark, name), f"tessera_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, key).saveAsTable(named)
    out = spark.table(named)
    out._stored_at, out._named = path, named
    return out


def drop(*stored: DataFrame) -> None:
    """Delete tables of store() that nothing reads any more."""
    for df in stored:
        if named := getattr(df, "_named", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {named}")
        remove(df.sparkSession, df._stored_at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours wherever it is stored."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


# --- word and shingle hashing (numpy, whole batches at once) -------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), element by element."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BASE = U64(0x9E3779B97F4A7C15 | 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of texts as they lie in memory, and where each text starts, with the end of the last; null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, places, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(places, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, dtype=np.uint8)
    return raw, at - at[0]


def word_spans(data: np.ndarray, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words (runs that hold no ASCII white space); a word also ends at the bounds given."""
    word = ~_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    if bounds is not None:
        at = bounds[:-1][bounds[1:] > bounds[:-1]]
        first[at] = word[at]
        at = bounds[1:][bounds[1:] > bounds[:-1]] - 1
        last[at] = word[at]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of the text; A-Z count as a-z."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return hash_spans(data, *word_spans(data))


def column_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts of a column, one text after the other, and where each text's words start, with the last end."""
    data, bounds = text_bytes(texts)
    starts, ends = word_spans(data, bounds)
    return hash_spans(data, starts, ends), np.searchsorted(starts, bounds)


_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=U64)
#: Words beyond so many bytes are hashed one by one.
LONG_WORD = 256


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the lower-cased bytes of each span: eight bytes at a time, of all spans at once."""
    if not len(starts):
        return np.empty(0, dtype=U64)
    low = np.zeros(len(data) + 8, dtype=np.uint8)
    np.take(_LOWER, data, out=low[: len(data)])
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=low, strides=(1,))
    left = ends - starts
    out = mix((eight[starts] & _LOW_BYTES[np.minimum(left, 8)]) + left.astype(U64) * _BASE)
    more = np.flatnonzero(left > 8)
    huge = more[left[more] > LONG_WORD]
    for i in huge.tolist():
        out[i] = xxhash.xxh64_intdigest(low[starts[i] : ends[i]].tobytes())
    more, k = more[left[more] <= LONG_WORD], 8
    while len(more):
        rest = left[more] - k
        out[more] = mix(out[more] * _BASE + (eight[starts[more] + k] & _LOW_BYTES[np.minimum(rest, 8)]))
        more, k = more[rest > 8], k + 8
    return out


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all runs of `width` words, in order; a shorter text counts as one run, an empty one has none."""
    n = len(words)
    if not n:
        return words
    if n < width:
        short = np.array([n], dtype=U64)
        for k in range(n):
            short = mix(short * _BASE + words[k : k + 1])
        return short
    out = np.zeros(n - width + 1, dtype=U64)
    for j in range(width):
        out *= _BASE
        out += words[j : n - width + 1 + j]
    return mix(out)


def column_shingles(words: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """shingle_hashes() of many texts' words one after the other, with the bounds of each text's shingles."""
    n = np.diff(bounds)
    many = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    ends = np.concatenate([[0], np.cumsum(many)])
    every = shingle_hashes(words, width) if len(words) >= width else np.empty(0, dtype=U64)
    out = np.empty(int(ends[-1]), dtype=U64)
    long = np.flatnonzero(n >= width)
    of = np.arange(int(many[long].sum()))
    shift = np.cumsum(many[long]) - many[long]
    out[of + np.repeat(ends[:-1][long] - shift, many[long])] = every[of + np.repeat(bounds[:-1][long] - shift, many[long])]
    for i in np.flatnonzero((n > 0) & (n < width)).tolist():
        out[ends[i]] = shingle_hashes(words[bounds[i] : bounds[i + 1]], width)[0]
    return out, ends


def to_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks, and several share an executor."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def clean(spark: SparkSession) -> None:
    """Let Spark delete shuffles of frames that are gone: it does so only when the driver collects its garbage, which an operator of
    many jobs would otherwise pile up."""
    give_back()
    spark.sparkContext._jvm.System.gc()


def size_checked(df: DataFrame, most_rows: int) -> tuple[DataFrame, bool]:
    """The frame, as a broadcast only if its row count is within the bound; and whether it is."""
    small = df.limit(most_rows + 1).count() <= most_rows
    return (F.broadcast(df) if small else df), small


# --- filters of bounded size over keys of all rows ---------------------------------------------------------------

# The primes of the 64-bit hash that F.xxhash64 computes.
_P1, _P2, _P3, _P4, _P5 = map(U64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U64(by)) | (x >> U64(64 - by))


def hash_of_longs(keys: np.ndarray) -> np.ndarray:
    """F.xxhash64 of a column of longs."""
    h = (U64(42 + 8) + _P5) ^ (_turned(keys.astype(np.int64).view(U64) * _P2, 31) * _P1)
    h = _turned(h, 27) * _P1 + _P4
    h = (h ^ (h >> U64(33))) * _P2
    h = (h ^ (h >> U64(29))) * _P3
    return h ^ (h >> U64(32))


def key_filter(keys: DataFrame, most_bits: int) -> np.ndarray:
    """A filter over a column of longs, of most_bits bits (a power of two; fewer for a few keys). It lets every key pass, and few
    others up to a key for sixteen bits: to thin rows out before an exact join. The driver gets its words, most_bits / 64 at most."""
    key = F.col(f"`{keys.columns[0]}`")
    n_bits = 1 << 20 if keys.limit(1 << 16).count() < 1 << 16 else most_bits
    most = F.lit(n_bits - 1)
    h = F.xxhash64(key)
    places = keys.filter(key.isNotNull()).select(F.explode(F.array(h.bitwiseAND(most), F.shiftrightunsigned(h, 32).bitwiseAND(most))).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(n_bits // 64, dtype=U64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(U64)
    del words
    give_back()
    return out


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    h, most = hash_of_longs(keys), U64(64 * len(bits) - 1)
    one, two = h & most, (h >> U64(32)) & most
    return ((bits[one >> U64(6)] >> (one & U64(63))) & (bits[two >> U64(6)] >> (two & U64(63))) & U64(1)).astype(bool)


def in_filter_column(bits_of, key) -> Column:
    """Whether a column of longs passes the filter in the broadcast bits_of: only the keys go through Python."""

    @arrow_udf("boolean")
    def passes(k: pa.Array) -> pa.Array:
        return pa.array(in_filter(bits_of.value, k.to_numpy()), pa.bool_())

    return passes(key)


#: Bits of the filter that parts marked rows from others. It thins well up to some four million marked rows; with many more of them it
#: lets every row pass, and the join behind it then moves all rows.
MARK_BITS = 1 << 26


def by_place(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named by their places, and the new name of each: Python stages can't take names with a dot. toDF(*df.columns)
    turns the names back."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


def row_key() -> Column:
    """A number for a row: doc_id and text decide."""
    return F.xxhash64("doc_id", F.xxhash64("text"))


def marked_rows(docs: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs, in two parts: (row) of rows surely not in marks(doc_id, t, ...), and (row, doc_id, t, and the columns of marks, null for
    rows without a mark) of the others. t is xxhash64(text); marks have a row for each doc_id (or null) and t at most.

    Rows are kept as one struct, so that no column of docs can clash. Only the second part, few rows, moves.
    """
    spark = docs.sparkSession
    names = [c for c in marks.columns if c not in ("doc_id", "t")]
    bits = spark.sparkContext.broadcast(key_filter(marks.select(F.xxhash64("doc_id", "t").alias("k")), MARK_BITS))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64("text").alias("t"), row_key().alias("k"))
    rows = rows.withColumn("maybe", in_filter_column(bits, F.col("k")))
    some = rows.filter("maybe").select("row", "doc_id", "t").alias("r")
    on = F.col("r.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("r.t") == F.col("m.t"))
    joined = some.join(marks.alias("m"), on, "left").select("r.row", "r.doc_id", "r.t", *[f"m.{c}" for c in names])
    return rows.filter("not maybe").select("row"), joined


class Places:
    """Numbers 0, 1, 2 ... of distinct 64-bit keys in the order they were added; look-ups take whole arrays."""

    def __init__(self) -> None:
        self._n, self._bits = 0, 10
        self._all = np.empty(1 << 8, dtype=U64)
        self._clear()

    def _clear(self) -> None:
        self._key, self._place = np.zeros(1 << self._bits, dtype=U64), np.full(1 << self._bits, -1, dtype=np.int32)

    def __len__(self) -> int:
        return self._n

    def keys(self) -> np.ndarray:
        return self._all[: self._n]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self._bits)).astype(np.int64)

    def add(self, keys: np.ndarray) -> None:
        """keys: distinct, and none of them known."""
        n = self._n + len(keys)
        if n > len(self._all):
            self._all = np.concatenate([self._all[: self._n], np.empty(n // 2 + len(keys), dtype=U64)])
        self._all[self._n : n] = keys
        first, self._n = self._n, n
        if 3 * n > 1 << self._bits:
            self._bits = int(4 * n).bit_length()
            self._clear()
            first = 0
        todo = np.arange(first, n)
        slot = self._slot(self._all[first:n])
        while len(todo):
            free = np.flatnonzero(self._place[slot] < 0)
            self._place[slot[free]] = todo[free]  # of several, one gets the slot
            won = np.zeros(len(todo), dtype=bool)
            won[free] = self._place[slot[free]] == todo[free]
            self._key[slot[won]] = self._all[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & ((1 << self._bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for unknown ones."""
        slot = self._slot(keys)
        place = self._place[slot]
        out = np.where(self._key[slot] == keys, place, -1).astype(np.int64)
        todo = np.flatnonzero((out < 0) & (place >= 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & ((1 << self._bits) - 1)
            place = self._place[slot]
            hit = (self._key[slot] == keys[todo]) & (place >= 0)
            out[todo[hit]] = place[hit]
            go = ~hit & (place >= 0)
            todo, slot = todo[go], slot[go]
        return out
