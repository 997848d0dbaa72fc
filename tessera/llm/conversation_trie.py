"""Prefix trie of conversations, built level by level.

At each depth the conversations that still share a node are grouped by (parent node, next turn); the group's smallest conv_id
names the child. A node that only one sequence of turns reaches is left alone: the rest of that sequence is a chain and needs no
further grouping. Then the levels are joined in reverse, children into parents, for leaves and savings.

Equal conversations are put together first, so a level has a row for each distinct sequence, and a very common conversation is
one row. Turns are known by two 64-bit hashes of role and text; texts themselves are not shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from . import common

#: Turns of a chain that are summed up at a time.
BLOCK = 1 << 16
#: Ids in one string while they are hashed in order.
CHUNK = 512
_EMPTY = hashlib.sha256(b"").hexdigest()


def turn_places(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, k1, k2, n_bytes) of every turn, pos from 1, and (conv_id, n) of every conversation.

    Turns are in order of turn (null first), then role, then the text's hash; null role or text is empty. Rows without a conv_id
    belong to no conversation and are left out. Turns are sorted in ranges and numbered inside each, so one conversation may be
    as long as the table; a conversation that goes on in the next range is moved up by the turns it had before.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.xxhash64(role, text).alias("k1"), F.xxhash64(F.lit(1), text, role).alias("k2"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    order = ["conv_id", "turn", "role", "k1", "k2"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "k1", "k2", "n_bytes")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column("conv_id").to_numpy()
            if not len(conv):
                continue
            first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            at = np.arange(len(conv)) - np.repeat(first, np.diff(np.append(first, len(conv))))
            if last is not None and conv[0] == last:
                at[: first[1] if len(first) > 1 else len(conv)] += held
            last, held = conv[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(conv), part, dtype=np.int32)), pa.array(at)], names=[*batch.schema.names, "part", "at"])

    schema = StructType([*rows.schema.fields]).add("part", IntegerType()).add("at", LongType())
    placed = common.store(rows.mapInArrow(number, schema), "turns")
    counts = common.store(placed.groupBy("conv_id", "part").agg(F.count("*").alias("n")), "turn-counts")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moved = counts.withColumn("before", F.sum("n").over(earlier)).filter("before > 0").select("conv_id", "part", "before")
    # at most one conversation of each range goes on from the range before
    turns = placed.join(F.broadcast(moved), ["conv_id", "part"], "left").select("conv_id", (F.col("at") + 1 + F.coalesce("before", F.lit(0))).alias("pos"), "k1", "k2", "n_bytes")
    return turns, counts.groupBy("conv_id").agg(F.sum("n").alias("n"))


def rebuilt(turns: DataFrame, convs: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations in which each conv_id c begins with the first h turns of conversation c - c % group (all if it has fewer,
    none if there is none) and goes on with its own turns after its first h; h is crc32 of c in decimal, modulo `most`."""
    c = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"))
    bases = convs.select(F.col("conv_id").alias("base"), "n")
    c = common.store(c.join(bases, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("taken")), "rebuilt")
    columns = ["k1", "k2", "n_bytes"]
    own = turns.join(c.select("conv_id", "h", "taken"), "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), *columns)
    heads = turns.filter(F.col("pos") < most).withColumnRenamed("conv_id", "base").join(c.filter("taken > 0").select("conv_id", "base", "taken"), "base")
    return own.unionByName(heads.filter("pos <= taken").select("conv_id", "pos", *columns)), c.select("conv_id")


def _members_digest(members: DataFrame) -> DataFrame:
    """(conv_id, sha) of members(conv_id, member): SHA-256 of the members in decimal, ascending, joined by commas. Strings of a bounded
    number of ids are made where the ids are; a group's strings then pass through one hash as a stream."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "first", "ids"]
        for batch in batches:
            group, member = batch.column("conv_id").to_numpy(), batch.column("member")
            new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.empty(0, dtype=np.int64)
            cuts = np.concatenate([np.arange(a, b, CHUNK) for a, b in zip(new.tolist(), [*new[1:].tolist(), len(group)])]) if len(new) else new
            text = [",".join(map(str, member[a : min(b, a + CHUNK)].to_pylist())) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(group)])]
            yield pa.RecordBatch.from_arrays([pa.array(group[cuts]), pc.take(member, pa.array(cuts)), pa.array(text, pa.string())], names=names)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, now, h = ["conv_id", "sha"], None, None
        for batch in batches:
            keys, out = [], []
            for group, ids in zip(batch.column("conv_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if group != now:
                    if now is not None:
                        keys.append(now)
                        out.append(h.hexdigest())
                    now, h = group, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.string())], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([h.hexdigest()])], names=names)

    chunks = members.repartitionByRange("conv_id", "member").sortWithinPartitions("conv_id", "member").mapInArrow(strings, "conv_id long, first long, ids string")
    return chunks.repartition("conv_id").sortWithinPartitions("conv_id", "first").mapInArrow(hashed, "conv_id long, sha string")


def _chains(turns: DataFrame, alone: DataFrame) -> DataFrame:
    """(conv_id, pos, m, last, saved) of the turns behind the node where a sequence became alone(conv_id, m, depth, last): saved is the
    sum from the turn to the end, taken block by block."""
    own = turns.join(alone, "conv_id").filter("pos > depth").select("conv_id", "pos", "m", "last", ((F.col("m") - 1) * F.col("n_bytes")).alias("own"))
    one = own.filter("m = 1").select("conv_id", "pos", "m", "last", F.lit(0).cast("long").alias("saved"))
    many = own.filter("m > 1").withColumn("block", F.expr(f"pos div {BLOCK}"))
    blocks = many.groupBy("conv_id", "block").agg(F.sum("own").alias("sum"))
    behind = Window.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("sum").over(behind), F.lit(0)).alias("behind"))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    many = many.withColumn("inside", F.sum("own").over(inside)).join(blocks, ["conv_id", "block"])
    return one.unionByName(many.select("conv_id", "pos", "m", "last", (F.col("inside") + F.col("behind")).alias("saved")))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node of the trie of convs(conv_id) by their turns(conv_id, pos, k1, k2, n_bytes): conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conv_id and pos are distinct in turns, and pos counts from 1. Conversations without turns are members of the root alone;
    without conversations there is no node.
    """
    columns = ["conv_id", "pos", "k1", "k2", "n_bytes"]
    turns = common.store(turns.select(*columns).repartitionByRange("pos", "conv_id").sortWithinPartitions("pos"), "trie-turns")
    marks = turns.select("conv_id", F.lit(1).alias("one"), F.xxhash64("pos", "k1", "k2").alias("a"), F.xxhash64("k2", "k1", "pos").alias("b"))
    every = marks.unionByName(convs.select("conv_id"), allowMissingColumns=True)
    signs = every.groupBy("conv_id").agg(F.count("one").alias("last"), *[F.coalesce(F.bit_xor(c), F.lit(0)).alias(c) for c in ("a", "b")])
    signs = common.store(signs, "trie-signs")
    classes = common.store(signs.groupBy("last", "a", "b").agg(F.min("conv_id").alias("rep"), F.count("*").alias("m")), "trie-classes")

    # downwards: `at` has the live sequences at a depth, with their parent node; `nodes` what they are grouped into
    found = {
        "n_convs": F.sum("m"), "n_classes": F.count("*"), "n_bytes": F.first("n_bytes"), "last": F.max("last"), "ends": F.min(F.when(F.col("last") == F.col("depth"), F.col("rep"))),
    }
    aggregates = [F.min("rep").alias("node"), *[v.alias(k) for k, v in found.items()]]
    start = {"parent": F.lit(None).cast("long"), "k1": F.lit(0).cast("long"), "k2": F.lit(0).cast("long"), "n_bytes": F.lit(0).cast("long"), "depth": F.lit(0).cast("long")}
    at, levels = classes.select("rep", "m", "last", *[v.alias(k) for k, v in start.items()]), []
    while True:
        nodes = common.store(at.groupBy("depth", "parent", "k1", "k2").agg(*aggregates), "trie-level")
        levels.append(nodes)
        depth = len(levels)
        if not nodes.filter("n_classes > 1").limit(1).count():
            break
        same = F.col("l.parent").eqNullSafe(F.col("n.parent")) & (F.col("l.k1") == F.col("n.k1")) & (F.col("l.k2") == F.col("n.k2"))
        shared = nodes.filter("n_classes > 1")
        live = at.alias("l").filter(F.col("last") >= depth).join(shared.alias("n"), same).select("l.rep", "l.m", "l.last", F.col("n.node").alias("parent"))
        turn = turns.filter(F.col("pos") == depth).select(F.col("conv_id").alias("rep"), "k1", "k2", "n_bytes")
        before, at = at, common.store(live.join(turn, "rep").withColumn("depth", F.lit(depth).cast("long")), "trie-live")
        if depth > 1:
            common.drop(before)

    alone = reduce(DataFrame.unionByName, [n.filter("n_classes = 1").select(F.col("node").alias("conv_id"), F.col("n_convs").alias("m"), "depth", "last") for n in levels])
    chains = common.store(_chains(turns, alone), "trie-chains")
    totals = chains.filter("m > 1").join(alone.select("conv_id", (F.col("depth") + 1).alias("pos")), ["conv_id", "pos"]).select(F.col("conv_id").alias("node"), F.col("saved").alias("behind"))
    totals = common.store(totals, "trie-behind")

    # upwards: children into parents
    rolled, below = [], None
    for nodes in reversed(levels):
        up = nodes.join(totals, "node", "left") if below is not None or nodes is levels[-1] else nodes
        if below is not None:
            children = below.groupBy("parent").agg(F.count("*").alias("c"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).withColumnRenamed("parent", "node")
            up = up.join(children, "node", "left")
        else:
            up = up.withColumns({x: F.lit(None).cast("long") for x in ("c", "leaves", "saved")})
        single = F.col("n_classes") == 1
        go_on = F.when(F.col("last") > F.col("depth"), 1).otherwise(0)
        up = up.select(
            "node", "depth", "parent", "n_convs",
            F.when(single, go_on).otherwise(F.coalesce("c", F.lit(0))).cast("long").alias("n_children"),
            F.when(single, 1).otherwise(F.greatest(F.coalesce("leaves", F.lit(0)), F.lit(1))).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("n_bytes") + F.when(single, F.coalesce("behind", F.lit(0))).otherwise(F.coalesce("saved", F.lit(0)))).alias("saved_tokens"),
            "ends",
        )
        below = common.store(up, "trie-rolled")
        rolled.append(below)
    chain = chains.select(
        F.col("conv_id").alias("node"), F.col("pos").alias("depth"), F.col("conv_id").alias("parent"), F.col("m").alias("n_convs"),
        F.when(F.col("pos") < F.col("last"), 1).otherwise(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.when(F.col("pos") == F.col("last"), F.col("conv_id")).alias("ends"),
    )
    nodes = reduce(DataFrame.unionByName, [*rolled, chain])
    same = (F.col("s.last") == F.col("c.last")) & (F.col("s.a") == F.col("c.a")) & (F.col("s.b") == F.col("c.b"))
    members = signs.alias("s").join(classes.filter("m > 1").alias("c"), same).select(F.col("c.rep").alias("conv_id"), F.col("s.conv_id").alias("member"))
    digests = _members_digest(members).withColumnRenamed("conv_id", "ends")
    one = F.sha2(F.col("ends").cast("string"), 256)
    ends = F.when(F.col("ends").isNull(), F.lit(_EMPTY)).otherwise(F.coalesce("sha", one))
    return nodes.join(digests, "ends", "left").select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", ends.alias("ends_sha256")
    )


def conversation_trie(conversations: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """prefix_trie() of the rebuilt() conversations of conversations(conv_id, turn, role, text); other columns are ignored."""
    return prefix_trie(*rebuilt(*turn_places(conversations), group, most))
