"""Exact n-gram Jaccard self-join with a token-group matrix.

Documents are sets of word shingles. Similar documents are first gathered into groups (verified links from min-hash
bands), and the matrix stores each group's union of prefix tokens as rows (token, group). A document and a foreign group can
only hold a link if enough of the document's prefix tokens occur in the group's union: a prefix holds the n - ceil(0.75 n) + k
rarest tokens of a set, so linked sets share k of them, and more the nearer their sizes are. Only groups that reach that
bound are opened: sets and members are held against the group's core, what more than half of its members hold, and only members that
share enough edits of the core with a set meet it; the pairs found are compared exactly. Links between a group's own members cannot
change components, and one link to a group is as good as many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import connected
from .tokens import text_runs

WIDTH = 5
PERCENT = 75
BANDS, BAND_ROWS = 8, 2
RUN_BYTES = 500_000
#: Cells of the table of token counts that orders tokens by rarity, and most bits of the filter before the fetch of sets.
CELLS, FILTER_BITS = 1 << 16, 1 << 24
#: Bits of the map of each set that bounds a pair's overlap before the sets are fetched.
BITMAP = 512
#: Tables of so many rows at most are broadcast; larger ones are joined by a shuffle, of which skewed parts are split.
SMALL_ROWS = 500_000
#: A token in more rows than this is matched by a pre-aggregated join instead of a window over its rows.
HEAVY = 1_000_000
_A = common.mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """For each text of a column its distinct hashed shingles in ascending order."""
    shingles, bounds = common.column_shingles(*common.column_words(texts), width)
    return [np.unique(shingles[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _totals(values: np.ndarray, bounds: np.ndarray, how: np.ufunc) -> np.ndarray:
    """how.reduce of each part of values; empty parts give 0."""
    out = np.zeros(len(bounds) - 1, dtype=values.dtype)
    full = bounds[1:] > bounds[:-1]
    if full.any():
        out[full] = how.reduceat(values, bounds[:-1][full])
    return out


def fingerprints(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, as longs; 0 for the empty set."""
    size = np.diff(bounds)
    total = _totals(common.mix(values * np.uint64(0xD6E8FEB86659FD93)), bounds, np.add) ^ size.astype(np.uint64)
    return common.to_long(np.where(size > 0, total, np.uint64(0)))


def _bitmaps(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """BITMAP bits for each set: those that its tokens hash to."""
    on = np.zeros((len(bounds) - 1, BITMAP), dtype=bool)
    on[np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), ((values >> np.uint64(20)) & np.uint64(BITMAP - 1)).astype(np.int64)] = True
    return np.packbits(on, axis=1).view(np.int64)


def _cell(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(48)).astype(np.int64)


def _lists(rows: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Rows of equal length as lists, null where not valid."""
    flat = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.int64()))
    return pc.if_else(pa.array(valid), flat, pa.nulls(len(rows), pa.list_(pa.int64())))


def _profile(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, dtype=np.int64)
        names = ["doc_id", "t", "k", "n", "fp", "mins", "bits", "counts"]
        for batch in batches:
            for a, b in text_runs(batch.column("text"), RUN_BYTES):
                sets = shingle_sets(batch.column("text").slice(a, b - a), width)
                size = np.array([len(s) for s in sets], dtype=np.int64)
                bounds, values = np.concatenate([[0], np.cumsum(size)]), np.concatenate(sets)
                counts += np.bincount(_cell(values), minlength=CELLS)
                mins = common.to_long(np.stack([_totals(values * x, bounds, np.minimum) for x in _A], axis=1))
                own = [batch.column(c).slice(a, b - a) for c in ("doc_id", "t", "k")]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(size), pa.array(fingerprints(values, bounds)), _lists(mins, size > 0), _lists(_bitmaps(values, bounds), size > 0), pa.nulls(b - a, pa.list_(pa.int64()))],
                    names=names,
                )
        nothing = [pa.nulls(1, pa.int64())] * 5 + [pa.nulls(1, pa.list_(pa.int64()))] * 2
        yield pa.RecordBatch.from_arrays([*nothing, pa.array([counts.tolist()], pa.list_(pa.int64()))], names=names)

    return run


def extra(n):
    """How many prefix tokens a linked pair must share, by set size."""
    return 1 + n // 20


def _prefix(level: np.ndarray, heavy: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_runs(batch.column("text"), RUN_BYTES):
                tokens, n_of = [], []
                sets = [s for s in shingle_sets(batch.column("text").slice(a, b - a), width) if len(s)]
                for s in sets:
                    n = len(s)
                    take = min(n, n - -(-PERCENT * n // 100) + extra(n))
                    order = level[_cell(s)].astype(np.uint64) << np.uint64(56) | s >> np.uint64(8)  # rarest first, then by hash
                    tokens.append(s[np.argpartition(order, take - 1)[:take]] if take < n else s)
                    n_of.append(take)
                if tokens:
                    token = np.concatenate(tokens)
                    fps = fingerprints(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(common.to_long(token)), pa.array(np.repeat(fps, n_of)), pa.array(heavy[_cell(token)])], names=["token", "fp", "heavy"]
                    )

    return run


def shared_prefix_tokens(docs: DataFrame, counts: np.ndarray, width: int, heavy_rows: int = HEAVY) -> DataFrame:
    """(token, fp) for the prefix tokens that two different sets have."""
    level = np.floor(np.log2(counts + 1)).astype(np.uint8)
    heavy = counts > heavy_rows
    rows = docs.select("text").mapInArrow(_prefix(level, heavy, width), "token long, fp long, heavy boolean")
    of = Window.partitionBy("token")
    light = rows.filter("not heavy").select("token", "fp").withColumn("lo", F.min("fp").over(of)).withColumn("hi", F.max("fp").over(of))
    found = light.filter("lo <> hi").select("token", "fp")
    if heavy.any():
        hot = rows.filter("heavy").select("token", "fp").distinct()
        keys = hot.groupBy("token").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi").select("token")
        found = found.unionByName(hot.join(keys, "token"))
    return found.distinct()


def _sets(bits_of, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(common.in_filter(bits_of.value, batch.column("k").to_numpy())))
            for a, b in text_runs(batch.column("text"), RUN_BYTES):
                s = shingle_sets(batch.column("text").slice(a, b - a), width)
                bounds, values = np.cumsum([0, *map(len, s)]), np.concatenate(s)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(common.to_long(values)))
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(a, b - a), pa.array(fingerprints(values, bounds)), lists], names=["k", "fp", "s"])

    return run


def fetch_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(fp, s) of the sets wanted(fp, k), made anew from the texts of the rows with the keys k.

    A filter of bounded size drops most other documents before hashing; the join behind it is exact.
    """
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(common.key_filter(wanted.select("k"), FILTER_BITS))
    made = docs.select(common.row_key().alias("k"), "text").mapInArrow(_sets(bits, width), "k long, fp long, s array<long>")
    return made.join(wanted.select("fp", "k"), ["fp", "k"]).select("fp", "s").dropDuplicates(["fp"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    joined = pairs.join(sets.select(F.col("fp").alias("a"), F.col("s").alias("s_a")), "a").join(sets.select(F.col("fp").alias("b"), F.col("s").alias("s_b")), "b")
    both = F.size(F.array_intersect("s_a", "s_b"))
    return joined.withColumn("both", both).filter(100 * F.col("both") >= PERCENT * (F.size("s_a") + F.size("s_b") - F.col("both"))).select("a", "b")


def _possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose sizes and bitmaps allow the similarity: a token whose bit the other set lacks isn't shared."""
    p = pairs
    for x in ("a", "b"):
        p = p.join(sets.select(F.col("fp").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")), x)

    def alone(x: str, y: str):
        return sum((F.bit_count(F.col(f"bits_{x}")[k].bitwiseAND(F.bitwise_not(F.col(f"bits_{y}")[k]))) for k in range(BITMAP // 64)), F.lit(0))

    most = F.least(F.col("n_a") - alone("a", "b"), F.col("n_b") - alone("b", "a"))
    return p.filter((100 + PERCENT) * most >= PERCENT * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _band_rows(sets: DataFrame) -> DataFrame:
    """(band, key, fp, c) for the min-hash band buckets that hold several sets; c is how many."""
    keys = F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(*[F.col("mins")[b * BAND_ROWS + r] for r in range(BAND_ROWS)]).alias("key")) for b in range(BANDS)])
    rows = sets.select("fp", F.explode(keys).alias("k")).select("fp", "k.band", "k.key")
    full = rows.groupBy("band", "key").agg(F.count("*").alias("c")).filter("c > 1")
    return common.store(rows.join(full, ["band", "key"]), "band-rows")


def _star_pairs(bands: DataFrame, score: DataFrame) -> DataFrame:
    """Each set with the head of every bucket it is in, the one of the highest score: as many pairs as bucket entries."""
    scored = bands.join(score, "fp", "left")
    heads = scored.groupBy("band", "key").agg(F.max_by("fp", F.struct(F.coalesce("score", F.lit(0)), F.xxhash64("fp", "band", "key"))).alias("head"))
    pairs = bands.join(heads, ["band", "key"]).filter("fp <> head")
    return common.store(pairs.select(F.least("fp", "head").alias("a"), F.greatest("fp", "head").alias("b")).distinct(), "star-pairs")


def _star_links(sets: DataFrame, content: DataFrame) -> DataFrame:
    """Verified links between similar sets, never all pairs of a bucket. Near copies resemble the text they were made from more
    than each other: heads are first the sets with the fullest buckets, then those that most links lead to."""
    bands = _band_rows(sets)
    first = _star_pairs(bands, bands.groupBy("fp").agg(F.sum("c").alias("score")))
    links = common.store(verified(_possible(first, sets), content), "star-links")
    degree = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("score"))
    second = _star_pairs(bands, degree)
    more = common.store(verified(_possible(second.join(first, ["a", "b"], "left_anti"), sets), content), "star-links")
    every = common.store(links.unionByName(more), "star-links")
    common.drop(bands, first, links, second, more)
    return every


def _behind(n: str) -> str:
    """How many tokens of a set of n stand behind its prefix (SQL)."""
    return f"greatest(0, (3 * {n} + 3) div 4 - 1 - {n} div 20)"


def _shared(n_a: str, n_b: str) -> str:
    """How many prefix tokens sets of these sizes share at least if they link (SQL): their overlap has at least 3/7 of both sizes,
    and what isn't in the longer rest behind a prefix is in both prefixes."""
    return f"((3 * ({n_a} + {n_b}) + 6) div 7 - greatest({_behind(n_a)}, {_behind(n_b)}))"


def _member_pairs(asking: DataFrame, members: DataFrame, content: DataFrame) -> DataFrame:
    """(a, b) of asking(a, n_a, g) and members(b, n, g, size): one member that surely links if there is such, else those that may.

    A group's core p is what more than half of its members hold. With D the part of p that a set lacks and E what it has besides,
    |a & b| = |a & p| - |D_b - D_a| + |E_a & E_b|. What a lacks of the overlap, after |a & p|, must therefore come from edits that it
    shares with b, and all members that differ from p only in edits of their own are passed over at once.
    """
    held = common.store(members.join(content.select(F.col("fp").alias("b"), "s"), "b"), "group-members")
    core = held.select("g", "size", F.explode("s").alias("x")).groupBy("g", "x").agg(F.count("*").alias("c"), F.first("size").alias("size"))
    core = core.filter("2 * c > size").groupBy("g").agg(F.collect_list("x").alias("p"))
    core = held.select("g", "n").distinct().join(core, "g", "left").select("g", "n", F.coalesce("p", F.array().cast("array<long>")).alias("p"))
    core = common.store(core, "group-cores")
    edits = common.store(held.drop("n").join(core, "g").select("g", "b", F.array_except("p", "s").alias("lacks"), F.array_except("s", "p").alias("extra")), "group-edits")
    nearest = edits.groupBy("g").agg(F.min(F.size("lacks")).alias("least"), F.min_by("b", F.struct(F.size("lacks"), "b")).alias("nearest"))
    asked = asking.join(content.select(F.col("fp").alias("a"), "s"), "a").join(core, "g").join(nearest, "g")
    asked = asked.select("a", "g", "least", "nearest", F.array_except("p", "s").alias("lacks"), F.array_except("s", "p").alias("extra"), F.expr("(3 * (n_a + n) + 6) div 7 - n_a").alias("more"))
    asked = common.store(asked.withColumn("more", F.col("more") + F.size("extra")), "asked-cores")
    sure = asked.filter("more + least <= 0").select("a", F.col("nearest").alias("b"))
    # beyond that, so many edits must be shared; where the core itself is enough, those by which it is lacked count too
    some = asked.filter("more + least > 0").select("a", "g", F.expr("if(more > 0, more, more + least)").alias("shared"), F.explode(F.expr("if(more > 0, extra, concat(extra, lacks))")).alias("x"))
    edit = common.store(edits.select("g", "b", F.explode(F.concat("extra", "lacks")).alias("x")), "edits")
    known = common.store(some.join(edit.groupBy("g", "x").agg(F.count("*").alias("c")), ["g", "x"]), "asked-edits")
    # who shares so many has one of the rarest of them
    own = Window.partitionBy("a", "g")
    rare = known.withColumn("upto", F.row_number().over(own.orderBy("c", "x"))).withColumn("has", F.count("*").over(own)).filter("upto <= has - shared + 1")
    maybe = rare.select("a", "g", "x").join(edit, ["g", "x"]).select("a", "b").distinct()
    pairs = common.store(sure.unionByName(maybe), "member-pairs")
    common.drop(held, core, edits, asked, edit, known)
    return pairs


def _matrix_pairs(tokens: DataFrame, sets: DataFrame, groups: DataFrame, content: DataFrame) -> DataFrame:
    """Pairs of sets in different components that the token-group matrix can't exclude.

    Groups are the sets of one component and one size, so that the bound is exact for every member.
    """
    rows = tokens.join(sets.select("fp", "n"), "fp").join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("c", F.coalesce("component", "fp"))
    every = common.store(rows.select("token", "fp", "n", "c", F.xxhash64("c", "n").alias("g")), "prefix-rows")
    mixed = every.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("token")
    rows = common.store(every.join(mixed, "token"), "mixed-rows")
    common.drop(every)
    size = common.store(rows.groupBy("g").agg(F.countDistinct("fp").alias("size")).filter("size > 1"), "group-sizes")
    sizes, _ = common.size_checked(size, SMALL_ROWS)  # as a broadcast, rows need not meet by their group, of which one may be large
    one = F.coalesce("size", F.lit(1))
    matrix = rows.select("token", "g", F.col("c").alias("c_g"), F.col("n").alias("n_g")).distinct().join(sizes, "g", "left").withColumn("size", one)
    queries = rows.join(sizes, "g", "left").select("token", "fp", "n", "c", F.col("g").alias("g_q"), one.alias("size_q"))
    # the smaller group's members ask the larger group
    asked = queries.join(matrix, "token").filter("c <> c_g and 4 * least(n, n_g) >= 3 * greatest(n, n_g) and (size_q < size or (size_q = size and g_q < g))")
    seen = asked.groupBy("fp", "g").agg(F.count("*").alias("seen"), F.first("n").alias("n"), F.first("n_g").alias("n_g"))
    opened = common.store(seen.filter(F.expr(f"seen >= {_shared('n', 'n_g')}")).select("fp", "g"), "opened")
    members = rows.select("g", F.col("fp").alias("b"), "n").distinct()
    asking = opened.withColumnRenamed("fp", "a").join(sets.select(F.col("fp").alias("a"), F.col("n").alias("n_a")), "a").join(sizes, "g", "left")
    asking = common.store(asking, "asking")
    alone = asking.filter("size is null").select("a", "g").join(members, "g").select("a", "b")
    several = members.join(sizes, "g").join(opened.select("g").distinct(), "g", "left_semi")
    pairs = alone.unionByName(_member_pairs(asking.filter("size > 1"), several, content))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = common.store(pairs, "matrix-pairs")
    common.drop(rows, opened, size, asking)
    return pairs


def jaccard_rows(docs: DataFrame, width: int = WIDTH, heavy_rows: int = HEAVY) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, t (xxhash64 of the text), n_shingles, component (a number that the rows of one
    component share, null without shingles) and component_id, as a stored table."""
    docs = docs.select("doc_id", "text")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("t"), common.row_key().alias("k"), "text")
    profile = common.store(keyed.mapInArrow(_profile(width), "doc_id long, t long, k long, n long, fp long, mins array<long>, bits array<long>, counts array<long>"), "profiles")
    rows = profile.filter("counts is null").select("doc_id", "t", "k", "n", "fp", "mins", "bits")
    sets = rows.filter("n > 0").groupBy("fp").agg(F.first("n").alias("n"), F.min("doc_id").alias("rep"), F.min("k").alias("k"), F.first("mins").alias("mins"), F.first("bits").alias("bits"))
    sets = common.store(sets, "sets")
    cells = profile.filter("counts is not null").select(F.posexplode("counts").alias("cell", "c")).filter("c > 0").groupBy("cell").agg(F.sum("c").alias("c")).toArrow()
    counts = np.zeros(CELLS, dtype=np.int64)
    counts[cells.column("cell").to_numpy()] = cells.column("c").to_numpy()
    shared = common.store(shared_prefix_tokens(docs, counts, width, heavy_rows), "prefix-tokens")
    # a linked set has at least 0.75 n tokens, so it shares extra(0.75 n) prefix tokens at least: other texts aren't needed again
    wanted = shared.groupBy("fp").agg(F.count("*").alias("c")).join(sets, "fp").filter("c >= 1 + ((3 * n + 3) div 4) div 20").drop("c", "rep")
    wanted = common.store(wanted, "wanted-sets")
    tokens = shared.join(wanted.select("fp"), "fp", "left_semi")
    content = common.store(fetch_sets(docs, wanted, width), "set-content")
    common.clean(docs.sparkSession)
    links = _star_links(wanted, content)
    common.clean(docs.sparkSession)
    groups = connected(links)
    pairs = _matrix_pairs(tokens, wanted, groups, content)
    rest = common.store(verified(_possible(pairs, wanted), content), "matrix-links")
    common.drop(shared, wanted, content, links, pairs)
    common.clean(docs.sparkSession)
    merged = connected(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest))
    linked = merged.select(F.col("node").alias("fp"), "component").join(sets.select("fp", "rep"), "fp")
    least = common.store(linked.groupBy("component").agg(F.min("rep").alias("least")), "component-ids")
    small, _ = common.size_checked(least, SMALL_ROWS)
    named = linked.select("fp", "component").join(small, "component")
    named = sets.select("fp", "rep").join(named, "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("component"), F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id")
    )
    found = rows.select("doc_id", "t", "n", "fp").join(named, "fp", "left").select(
        "doc_id", "t", F.col("n").alias("n_shingles"), "component", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
    found = common.store(found, "jaccard-components")
    common.drop(profile, sets, groups, rest, merged, least)
    return found


def jaccard_components(docs: DataFrame, width: int = WIDTH, heavy_rows: int = HEAVY) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_shingles, component_id.

    Two documents link when 100 * |intersection| >= 75 * |union| of their shingle sets; component_id is the smallest doc_id
    that links reach. Null and empty texts and texts of white space have no shingles and stand alone; a text shorter than a
    shingle is one shingle; repeated rows and equal texts link. Rows without a doc_id link like others; a component of such rows
    alone has no component_id. An empty table gives no rows; other columns are ignored. Sets are known by 64-bit hashes of
    shingles and of whole sets.
    """
    return jaccard_rows(docs, width, heavy_rows).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, width: int = WIDTH, heavy_rows: int = HEAVY) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (rows without one come last), of several texts under it the
    one with the least hash, of rows equal in doc_id and text any. Rows without shingles all stay, and so do all columns.
    """
    rows = jaccard_rows(docs, width, heavy_rows).filter("component is not null")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    several = rows.filter(first).groupBy("component").agg(F.min("t").alias("least"), F.count("*").alias("c")).filter("c > 1").select("component", "least")
    marks = rows.filter(~first).select("doc_id", "t", F.lit(False).alias("keep"))
    marks = marks.unionByName(rows.filter(first).join(several, "component").select("doc_id", "t", (F.col("t") == F.col("least")).alias("keep")))
    marks = common.store(marks.distinct(), "near-duplicates")
    rest, some = common.marked_rows(docs, marks)
    some, once = some.filter("keep is null").select("row"), some.filter("keep").dropDuplicates(["doc_id", "t"]).select("row")
    return rest.unionByName(some).unionByName(once).select("row.*")
