"""Language identification by partial matching: the language whose context tree codes a text in the fewest bits.

For every language a tree of byte contexts up to ORDER bytes is counted once and then frozen. A byte's code length is that of
the longest context seen in training; a context that never saw the byte pays its escape, q / (n + q) for q different bytes
in n, and leaves the byte to the next shorter context; below the empty context all 256 bytes are alike. Because the counts
are frozen, a byte's code length depends on it and the ORDER bytes before it only: tables hold those lengths for all
languages at once, and a text is scored by array look-ups, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Places, by_place, drop, give_back, store
from .tokens import text_runs

ORDER = 4
#: The trees are fitted on about so many documents of each language at most, chosen by a hash of doc_id ...
TRAIN_DOCS = 3000
#: ... and hold so many byte strings of ORDER + 1 bytes, shared evenly: the commonest of each language. Shorter strings are all held.
TREE_STRINGS = 400_000
#: Bits of code length that count as one bit of evidence in the score (neighbouring bytes are not independent).
TEMPER = 8.0
#: A text that its best language codes in more bits a byte than this is in none of the languages.
FOREIGN_BITS = 6.5

_U = np.uint64
#: Bytes as the trees see them: a-z and bytes outside ASCII as they are, all else one blank.
_SEEN = np.full(256, 32, dtype=np.uint8)
_SEEN[97:123] = np.arange(97, 123)
_SEEN[65:91] = np.arange(97, 123)
_SEEN[128:] = np.arange(128, 256)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def seen_bytes(text: str) -> np.ndarray:
    """The lower-cased text as bytes, with runs of everything but letters as one blank."""
    b = _SEEN[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    if not len(b):
        return b
    keep = np.ones(len(b), dtype=bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
    return b[keep]


def _strings(b: np.ndarray) -> np.ndarray:
    """For each byte the ORDER bytes before it (blanks before the text) and itself, as one number."""
    padded = np.concatenate([np.full(ORDER, 32, dtype=np.uint8), b])
    out = np.zeros(len(b), dtype=_U)
    for k in range(ORDER + 1):
        out = (out << _U(8)) | padded[k : k + len(b)]
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for a, b in text_runs(batch.column("text")):
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(langs[a:b], batch.column("text").slice(a, b - a).to_pylist(), strict=True):
                by.setdefault(lang, []).append(_strings(seen_bytes(text)))
            for lang, parts in by.items():
                code, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(n)], names=["lang", "code", "n"])


def _places(keys: np.ndarray) -> Places:
    out = Places()
    out.add(keys)
    return out


class Model:
    """Code lengths under the frozen trees of `langs`: for each order the strings known to any language, with a row of lengths,
    and the contexts known to any, with a row of escapes. `shorter` has code, lang_at and n of all strings of 1 to ORDER bytes, by
    order; without it they are those of the strings given."""

    def __init__(self, langs: list[str], code: np.ndarray, lang_at: np.ndarray, n: np.ndarray, shorter: list[tuple] | None = None) -> None:
        self.langs, width = langs, len(langs)
        self.levels: list[tuple] = []
        below = None  # lengths of the level before, by string
        for k in range(ORDER + 1):
            mask = _U((1 << (8 * (k + 1))) - 1)
            of, at, many = shorter[k] if shorter and k < ORDER else (code & mask, lang_at, n)
            known = np.unique(of)
            contexts, ctx_of = np.unique(known >> _U(8), return_inverse=True)
            count = np.zeros((len(known), width))
            np.add.at(count, (np.searchsorted(known, of), at), many)
            total, kinds = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
            np.add.at(total, ctx_of, count)
            np.add.at(kinds, ctx_of, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(kinds > 0, np.log2((total + kinds) / kinds), 0.0)
                own = np.log2((total + kinds)[ctx_of] / count)
            if below is None:
                less = np.full((len(known), width), 8.0)
            else:
                less = below[1][np.searchsorted(below[0], known & (mask >> _U(8)))]
            bits = np.where(count > 0, own, escape[ctx_of] + less)
            below = (known, bits)
            self.levels.append((_places(known), bits.astype(np.float32), _places(contexts), escape.astype(np.float32)))

    def bits(self, strings: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Code length of each string's last byte in every language."""
        table, bits, contexts, escape = self.levels[order]
        at = table.find(strings)
        out = bits[at]
        new = np.flatnonzero(at < 0)
        if len(new):
            s = strings[new]
            c = contexts.find(s >> _U(8))
            less = self.bits(s & _U((1 << (8 * order)) - 1), order - 1) if order else np.full((len(new), len(self.langs)), 8.0, dtype=np.float32)
            out[new] = less + np.where((c >= 0)[:, None], escape[c], np.float32(0))
        return out


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model | None:
    """A model of the non-null lang values of docs(doc_id, text, lang) that aren't held out; None if there are none."""
    known = docs.filter(~held_out(F.col("doc_id"))).filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    per = [(r["lang"], min(1.0, train_docs / r["count"])) for r in known.groupBy("lang").count().collect()]
    if not per:
        return None
    share = F.create_map(*[F.lit(x) for pair in per for x in pair])[F.col("lang")]  # a literal: texts that aren't chosen never move
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    counted = chosen.select("lang", "text").mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counted = store(counted, "byte-strings")
    sizes = {r["lang"]: r["count"] for r in counted.groupBy("lang").count().collect()}
    if not sizes:
        drop(counted)
        return None
    langs = sorted(sizes)

    def arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = df.select("lang", "code", "n").toArrow()
        at = np.searchsorted(np.array(langs, dtype=object), np.array(rows.column("lang").to_pylist(), dtype=object))
        return rows.column("code").to_numpy().view(_U), at.astype(np.int64), rows.column("n").to_numpy()

    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    longest = arrays(counted.withColumn("_place", F.row_number().over(by_count)).filter(F.col("_place") <= _share(list(sizes.values()), TREE_STRINGS)))
    masks = [(1 << (8 * (k + 1))) - 1 for k in range(ORDER)]
    shorter = [arrays(counted.groupBy("lang", F.col("code").bitwiseAND(F.lit(m)).alias("code")).agg(F.sum("n").alias("n"))) for m in masks]
    drop(counted)
    give_back()
    return Model(langs, *longest, shorter)


def _share(sizes: list[int], most: int) -> int:
    """The most that each may have, so that all together have at most `most`: what small ones leave goes to the others."""
    left = len(sizes)
    for size in sorted(sizes):
        if size * left > most:
            return max(1, most // left)
        most, left = most - size, left - 1
    return max(sizes)


def judge(model: Model | None, column: pa.Array) -> Iterator[tuple[int, int, list[str], np.ndarray, np.ndarray]]:
    """For parts (first, last) of a column of texts: languages, scores, and bits a byte."""
    for a, b in text_runs(column, 1_000_000):
        texts = [t if t and any(map(str.isalpha, t)) else "" for t in column.slice(a, b - a).to_pylist()]
        parts = [seen_bytes(t) for t in texts]
        size = np.array([len(p) for p in parts])
        lang, score, cost = ["und"] * (b - a), np.zeros(b - a), np.zeros(b - a)
        full = np.flatnonzero(size)
        if model is not None and len(full):
            bits = model.bits(np.concatenate([_strings(parts[i]) for i in full]))
            starts = np.cumsum(size[full]) - size[full]
            total = np.add.reduceat(bits.astype(np.float64), starts, axis=0)
            best = total.argmin(axis=1)
            least = total[np.arange(len(full)), best]
            score[full] = 1 / np.exp2(np.maximum(least[:, None] - total, -1000 * TEMPER) / TEMPER).sum(axis=1)
            cost[full] = least / size[full]
            for i, k in zip(full, best, strict=True):
                lang[i] = model.langs[k]
        yield a, b, lang, score, cost


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, *made in judge(shared.value, batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, made)], names=[batch.schema.names[0], "lang_pred", "score", "bits_per_byte"])

    return run


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score (0 to 1) and bits_per_byte of every whole text of docs(key, text); nothing else is read.

    A null text or one without letters is `und` with score 0; of equally short codes the first language by name wins. Repeated
    rows get equal results; an empty table gives no rows; without a model everything is `und`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(key, "text")
    return kept.mapInArrow(_predict(shared), f"{key} {kept.schema[key].dataType.simpleString()}, lang_pred string, score double, bits_per_byte double")


def identify(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits_per_byte for every row of docs(doc_id, text, lang)."""
    made = predict(docs.select("doc_id", "text"), train(docs, train_docs))
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def _accept(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, lang, _, cost in judge(shared.value, batch.column(text)):
                ok = pa.array([x != "und" and c <= FOREIGN_BITS for x, c in zip(lang, cost, strict=True)], pa.bool_())
                yield batch.slice(a, b - a).filter(ok)

    return run


def accepted(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The rows of docs, columns as they are, whose text is in one of the languages that docs itself names.

    Rejected are null texts, texts without letters and texts that no language codes in FOREIGN_BITS bits a byte.
    """
    model = train(docs, train_docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, names = by_place(docs)
    return rows.mapInArrow(_accept(shared, names["text"]), rows.schema).toDF(*docs.columns)
