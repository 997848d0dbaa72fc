"""Titles that mean the same: candidate pairs by shared parts, the four similarity tests, leader clusters, representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import normalize_title
from tessera.operators.stored import Rounds

THRESHOLD = 0.75
MOST_ROUNDS = 200


def similar(a: Column, b: Column, threshold: float = THRESHOLD) -> Column:
    """Equal, one in the other, alike sets of characters, or a long common run - of normalised titles."""
    chars_a, chars_b = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    alike = F.size(F.array_intersect(chars_a, chars_b)) >= threshold * F.size(F.array_union(chars_a, chars_b))
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    run = F.ceil(F.length(short) * threshold).cast("int")
    common = F.exists(F.sequence(F.lit(1), F.greatest(F.length(short) - run + 1, F.lit(1))), lambda i: F.contains(long, F.substr(short, i, run)))
    return (a == b) | F.contains(a, b) | F.contains(b, a) | ((F.length(a) > 0) & (F.length(b) > 0) & (alike | common))


def _alike_sets(t: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of titles(t) whose sets of characters are alike. Distinct sets are compared, not titles: two alike sets share two of the
    rarest characters of each (a prefix in order of rarity, one longer than for one shared character), and the sizes allow it."""
    sets = t.filter("t <> ''").select("t", F.array_join(F.array_sort(F.array_distinct(F.split("t", ""))), "").alias("s"))
    every = sets.select("s").distinct().select("s", F.length("s").alias("n"), F.explode(F.split("s", "")).alias("c"))
    ranked = every.join(every.groupBy("c").agg(F.count("*").alias("f")), "c").groupBy("s", "n").agg(F.array_sort(F.collect_list(F.struct("f", "c"))).alias("o"))
    least = F.ceil(F.col("n") * threshold).cast("int")
    prefix = ranked.filter("n > 1").withColumn("o", F.slice(F.col("o")["c"], 1, F.col("n") - least + 2))
    twos = F.flatten(F.transform("o", lambda x, i: F.transform(F.slice(F.col("o"), i + 2, F.size("o")), lambda y: F.concat(x, y))))
    keys = prefix.select("s", "n", least.alias("least"), F.explode(twos).alias("two"))
    small = keys.select(F.col("s").alias("y"), "two", F.col("n").alias("size"))
    large = keys.select(F.col("s").alias("x"), "two", F.explode(F.sequence("least", "n")).alias("size"))
    both = large.join(small, ["two", "size"]).filter("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    x, y = F.split("x", ""), F.split("y", "")
    alike = both.filter(F.size(F.array_intersect(x, y)) >= threshold * F.size(F.array_union(x, y)))
    alike = alike.unionByName(sets.select(F.col("s").alias("x"), F.col("s").alias("y")).distinct())
    return alike.join(sets.select(F.col("s").alias("x"), F.col("t").alias("a")), "x").join(sets.select(F.col("s").alias("y"), F.col("t").alias("b")), "y").select("a", "b")


def _common_runs(t: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of titles(t) where a run of threshold * length of a, the shorter one, stands in b too.

    Each such run of a is a window of it. Of every window the rarest piece is looked up, pieces being as long as half of the
    window at least (a power of two); where it is found, the whole window must fit at that place. A piece that all titles have
    is the rarest of no window that also holds another.
    """
    t = t.filter("t <> ''").select("t", F.length("t").alias("n")).withColumn("r", F.ceil(F.col("n") * threshold).cast("int"))

    def level(n: Column) -> Column:
        return F.length(F.bin(n.cast("long"))) - 1

    def pieces(k: Column) -> Column:
        q = F.pow(F.lit(2), k).cast("int")
        return F.transform(F.sequence(F.lit(1), F.col("n") - q + 1), lambda i: F.struct(q.alias("q"), i.alias("p"), F.xxhash64(F.substr("t", i, q)).alias("g")))

    held = t.select("t", "n", F.inline(F.flatten(F.transform(F.sequence(F.lit(0), level(F.col("n"))), pieces))))
    seen = held.groupBy("q", "g").agg(F.count("*").alias("f"))
    own = t.select("t", "n", "r", F.inline(pieces(level(F.col("r"))))).join(seen, ["q", "g"])
    own = own.groupBy("t", "n", "r", "q").agg(F.array_sort(F.collect_list(F.struct("p", "f", "g"))).alias("of"))
    starts = F.sequence(F.lit(1), F.col("n") - F.col("r") + 1)
    rarest = F.transform(starts, lambda o: F.array_min(F.transform(F.slice("of", o, F.col("r") - F.col("q") + 1), lambda x: F.struct(x["f"], x["p"], x["g"]))))
    asked = own.select(F.col("t").alias("a"), F.col("n").alias("na"), "r", "q", F.inline(F.array_distinct(rarest)).alias("f", "p", "g"))
    found = asked.join(held.select(F.col("t").alias("b"), F.col("n").alias("nb"), "q", "g", F.col("p").alias("at")), ["q", "g"]).filter("a <> b and na <= nb")
    shift = F.col("at") - F.col("p")
    first = F.greatest(F.lit(1), F.col("p") + F.col("q") - F.col("r"), F.lit(1) - shift)
    last = F.least(F.col("p"), F.col("na") - F.col("r") + 1, F.col("nb") - F.col("r") + 1 - shift)
    fits = F.exists(F.sequence(first, last), lambda o: F.substr("a", o, F.col("r")) == F.substr("b", o + shift, F.col("r")))
    return found.filter(first <= last).filter(fits).select("a", "b")


def candidate_pairs(titles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b) with a < b: every pair of distinct normalised titles of titles(t) that can pass similar(), and few others.

    Alike sets of characters and common runs are each joined on rare parts; one in the other is a common run of the whole of it;
    the empty title is in all. Null titles are like nothing. threshold: above one half.
    """
    if not 0.5 < threshold <= 1:
        raise ValueError("threshold must be above 0.5 and at most 1")
    t = titles.select("t").filter("t is not null").distinct()
    empty = t.filter("t = ''").select(F.col("t").alias("a"))  # one row at most
    every = _alike_sets(t, threshold).unionByName(_common_runs(t, threshold)).unionByName(t.select(F.col("t").alias("b")).join(F.broadcast(empty), F.lit(True)).select("a", "b"))
    return every.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_pairs(titles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return candidate_pairs(titles, threshold).filter(similar(F.col("a"), F.col("b"), threshold))


def leader_clusters(titles: DataFrame, folder: str, threshold: float = THRESHOLD) -> DataFrame:
    """(t, leader) of titles(t, ord): in order of ord each title joins the first leader that it resembles, or leads itself.

    All titles whose earlier look-alikes are settled are settled together, so a round is a few joins over the pairs and no
    title waits for the whole table. folder: where rounds are written, shared by all executors; the result is one table in it,
    what the rounds wrote is deleted.
    """
    rounds = Rounds(titles.sparkSession, folder)
    own = titles.groupBy("t").agg(F.min("ord").alias("ord"))
    pairs = similar_pairs(titles, threshold)
    pairs = pairs.join(own.withColumnRenamed("t", "a").withColumnRenamed("ord", "oa"), "a").join(own.withColumnRenamed("t", "b").withColumnRenamed("ord", "ob"), "b")
    early = F.when(F.col("oa") < F.col("ob"), F.struct(F.col("a").alias("e"), F.col("oa").alias("oe"), F.col("b").alias("t"))).otherwise(
        F.struct(F.col("b").alias("e"), F.col("ob").alias("oe"), F.col("a").alias("t"))
    )
    edges = rounds.keep(pairs.select(early.alias("x")).select("x.*"))  # e stands before t
    state = rounds.keep(own.select("t", F.lit(None).cast("boolean").alias("leads")))
    for _ in range(MOST_ROUNDS):
        seen = edges.join(state.select(F.col("t").alias("e"), F.col("leads").alias("e_leads")), "e").groupBy("t").agg(
            F.bool_or(F.coalesce("e_leads", F.lit(False))).alias("led"), F.bool_or(F.col("e_leads").isNull()).alias("waits")
        )
        # led by an earlier leader: no leader; nobody earlier left undecided: a leader
        new = F.when(F.col("led"), F.lit(False)).when(~F.coalesce("waits", F.lit(False)), F.lit(True))
        before, state = state, rounds.keep(state.join(seen, "t", "left").select("t", F.coalesce("leads", new).alias("leads")))
        rounds.drop(before)
        if state.filter("leads is null").limit(1).count() == 0:
            break
    else:
        raise RuntimeError("clusters did not settle")
    leaders = state.filter("leads").select(F.col("t").alias("e"))
    joined = edges.join(leaders, "e").groupBy("t").agg(F.min_by("e", "oe").alias("leader"))
    out = rounds.keep(state.join(joined, "t", "left").select("t", F.when(F.col("leads"), F.col("t")).otherwise(F.col("leader")).alias("leader")))
    rounds.drop(edges, state)
    return out


def representatives(rows: DataFrame, cluster: str, weight: str, source: str, name: str, order: str, fill: list[str], cover: str) -> DataFrame:
    """One row a cluster. A single heaviest row wins: its name tells how many rows other sources have, its empty fields come
    from the first row that has them. Among several heaviest, the first with a cover wins as it is, or else the first."""
    heaviest = rows.groupBy(cluster).agg(F.max(weight).alias("_w"))
    top = rows.join(heaviest, cluster).filter(F.col(weight) == F.col("_w"))
    columns = [c for c in rows.columns if c != cluster]
    has = F.coalesce(F.col(cover) != "", F.lit(False))
    best = top.groupBy(cluster).agg(
        F.count("*").alias("_ties"), F.min_by(F.struct(*columns), F.struct((~has).alias("x"), order)).alias("_tied"), F.min_by(F.struct(*columns), F.col(order)).alias("_first")
    )
    best = best.withColumn("_best", F.when(F.col("_ties") == 1, F.col("_first")).otherwise(F.col("_tied"))).select(cluster, "_ties", "_best")
    filled = [F.min_by(F.nullif(c, F.lit("")), F.when(F.coalesce(F.col(c) != "", F.lit(False)), F.col(order))).alias(f"_fill_{c}") for c in fill]
    rest = rows.join(best.select(cluster, F.col("_best")[source].alias("_s")), cluster).groupBy(cluster).agg(F.count_if(F.col(source) != F.col("_s")).alias("_others"), *filled)
    out = best.join(rest, cluster)
    alone = F.col("_ties") == 1
    suffix = F.when(alone & (F.col("_others") > 0), F.concat(F.lit(" +"), F.col("_others").cast("string"))).otherwise(F.lit(""))
    values = {c: F.col("_best")[c] for c in columns}
    values[name] = F.concat(values[name], suffix)
    for c in fill:
        values[c] = F.when(alone & (F.coalesce(values[c], F.lit("")) == ""), F.col(f"_fill_{c}")).otherwise(values[c])
    return out.select(cluster, *[v.alias(c) for c, v in values.items()])


def normalized(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("t", normalize_title(F.col(column)))


def answers(rows: DataFrame, title: str, weight: str, key: str, dedupe: bool = True, folder: str | None = None) -> DataFrame:
    """rows, heaviest first. With dedupe each row has the leader of its cluster of like titles: titles are taken by weight, then by
    key, and the rows of one title are in one cluster."""
    order = [F.coalesce(weight, F.lit(0)).desc(), F.col(key)]
    if not dedupe:
        return rows.orderBy(*order)
    titled = normalized(rows, title)
    ordered = titled.select("t", F.struct((-F.coalesce(weight, F.lit(0))).alias("w"), F.col(key).alias("k")).alias("ord"))
    return titled.join(leader_clusters(ordered, folder), "t", "left").select(*rows.columns, "leader").orderBy(*order)
