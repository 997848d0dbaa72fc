"""Benchmark decontamination by a prefix-filtered set join on word shingles.

Every benchmark window (ten consecutive words, or a whole shorter item) must occur whole in a document to count, so one
shingle of it is a necessary prefix: the one that is rarest in the corpus, in an order of shingles by corpus count.
Document positions are joined on that shingle only; the place of the shingle in the window gives the window's place in the
document, length and position bounds cut those that stick out, and the words are then compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Most prefix shingles, and contaminated rows, that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Bits of the map of prefix shingles that thins the corpus before a shuffle join: one row for 64 of them at most.
MAP_BITS = 1 << 25


def words_of(text: Column) -> Column:
    """The words of a text: runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words, key, len) of every window; items without words have none."""
    w = items.select("item_id", words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    cut = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, window))).alias("words"))
    return cut.withColumn("key", F.sha2(F.array_join("words", " "), 256)).withColumn("len", F.size("words")).distinct()


def _document_shingles(docs: DataFrame) -> DataFrame:
    return docs.select("_row", "words", F.size("words").alias("n"), F.posexplode("words").alias("pos", "w1")).withColumn(
        "w2", F.coalesce(F.get("words", F.col("pos") + 1), F.lit(""))
    )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").withColumn("_row", F.struct("doc_id", F.xxhash64("text").alias("t")))


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """For each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    docs needs doc_id and text, items item_id and text; other columns are ignored. A null or empty text has no words and is
    clean. Rows that repeat, and rows without a doc_id, are judged each on their own text; an empty benchmark leaves everything
    clean, and empty docs give no rows.
    """
    return judged(docs, items, window, broadcast_rows).drop("_row")


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, whose own text holds no window of the items, with or without a doc_id."""
    bad, _ = common.size_checked(common.store(judged(docs, items, window, broadcast_rows).filter("contaminated").select("_row").distinct(), "contaminated"), broadcast_rows)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct("doc_id", F.xxhash64("text").alias("t")).alias("_row"))
    return rows.join(bad, "_row", "left_anti").select("row.*")


def _mapped(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose long h may be one of keys(h): a bit map in rows of 64 bits, broadcast, of a size that MAP_BITS bounds."""
    bit = F.col("h").bitwiseAND(F.lit(MAP_BITS - 1))
    words = keys.select(bit.alias("p")).groupBy(F.shiftright("p", 6).alias("_w"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("_b"))
    near = rows.withColumn("_w", F.shiftright(bit, 6)).join(F.broadcast(words), "_w")
    return near.filter("shiftrightunsigned(_b, cast(h & 63 as int)) & 1 = 1").drop("_w", "_b")


def judged(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """contaminated() with _row, a struct of doc_id and the text's hash."""
    docs = _keyed(docs)
    tokens = docs.select("_row", words_of(F.col("text")).alias("words"))
    windows = common.store(benchmark_windows(items, window), "bench-windows")
    texts = windows.select("key", "words", "len").distinct()
    # shingles of two words (one word for a window of one word: w2 is then free)
    shingles = texts.select("key", "words", "len", F.posexplode("words").alias("off", "w1")).withColumn("w2", F.get("words", F.col("off") + 1))
    shingles = shingles.filter(F.col("w2").isNotNull() | (F.col("len") == 1))
    vocabulary, small = common.size_checked(shingles.filter("len > 1").select("w1", "w2").distinct(), broadcast_rows)
    seen = _document_shingles(tokens).select("w1", "w2")
    if small:  # count only the benchmark's shingles, in place
        counted = seen.join(vocabulary, ["w1", "w2"]).groupBy("w1", "w2").agg(F.count("*").alias("seen"))
    else:
        counted = seen.groupBy("w1", "w2").agg(F.count("*").alias("seen")).join(vocabulary, ["w1", "w2"])
    rarest = Window.partitionBy("key").orderBy(F.coalesce("seen", F.lit(0)), F.xxhash64("w1", "w2"), "off")
    prefix = (
        shingles.join(counted, ["w1", "w2"], "left")
        .withColumn("r", F.row_number().over(rarest))
        .filter((F.col("r") == 1) & (F.col("seen").isNotNull() | (F.col("len") == 1)))
        .select("w1", "w2", "off", "key", F.col("words").alias("want"), "len")
    )
    prefix = common.store(prefix, "bench-prefix")

    start = F.col("pos") - F.col("off")

    def occurrences(of: DataFrame, on: list[str]) -> DataFrame:
        of, small = common.size_checked(of, broadcast_rows)
        places = _document_shingles(tokens)
        if small:
            found = places.join(of, on).filter((start >= 0) & (start + F.col("len") <= F.col("n")))
            return found.filter(F.slice("words", start + 1, F.col("len")) == F.col("want")).select("_row", start.alias("start"), "len", "key")
        # places that the map of prefixes lets pass meet prefixes by a hash of the shingle; texts move once, to the windows that may occur in them
        of = of.select(F.xxhash64(*on).alias("h"), "off", "len", "key")
        at = _mapped(places.select("_row", "n", "pos", F.xxhash64(*on).alias("h")), of).join(of, "h")
        at = at.filter((start >= 0) & (start + F.col("len") <= F.col("n"))).select("_row", F.struct(start.alias("start"), "len", "key").alias("c"))
        at = at.groupBy("_row").agg(F.collect_set("c").alias("c"))
        words = docs.select("_row", "text").join(at, "_row").select("_row", "c", words_of(F.col("text")).alias("words"))
        held = F.filter("c", lambda c: F.sha2(F.array_join(F.slice("words", c["start"] + 1, c["len"]), " "), 256) == c["key"])
        return words.select("_row", F.inline(held)).select("_row", "start", "len", "key")

    hits = occurrences(prefix.filter("len > 1"), ["w1", "w2"])
    single = prefix.filter("len = 1").drop("w2")
    if single.limit(1).count():
        hits = hits.unionByName(occurrences(single, ["w1"]))
    hits = common.store(hits, "bench-hits")
    # words inside any occurrence: the union of the document's intervals, folded in order of their starts
    spans = hits.groupBy("_row").agg(F.array_sort(F.collect_set(F.struct("start", "len"))).alias("spans"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit"))

    def fold(acc: Column, s: Column) -> Column:
        end = s["start"] + s["len"]
        return F.struct(
            F.greatest(acc["end"], end).alias("end"),
            (acc["hit"] + F.greatest(end - F.greatest(acc["end"], s["start"]), F.lit(0))).cast("long").alias("hit"),
        )

    spans = spans.select("_row", F.aggregate("spans", zero, fold)["hit"].alias("n_hit"))
    found = (
        hits.select("_row", "key").distinct().join(windows.select("key", "item_id"), "key").select("_row", F.col("item_id").cast("string").alias("item")).distinct()
    )
    found = found.groupBy("_row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    counts = docs.select("doc_id", "_row", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    joined = counts.join(spans.join(found, "_row"), "_row", "left")
    return joined.select(
        "_row",
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
