"""Conversation trie, SentencePiece codec and importance resampling against brute force, the library and odd tables."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import conversation_trie, importance, piece_codec, tokens

# --- conversation trie ------------------------------------------------------------------------------------------

CONV = "conv_id long, turn long, role string, text string, pos string, part int, k1 string, node string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], CONV).repartition(3)


def brute_trie(rows):
    by = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    built = {}
    for c in by:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = by.get(c - int(math.fmod(c, 5)), [])[:h] + by[c][h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for path, members in nodes.items():
        under = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in under if len(p) == len(path) + 1]
        leaves = [p for p in under if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in under)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in under if p)
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(path))))
        parent = min(nodes[path[:-1]]) if path else None
        out.add((min(members), len(path), parent, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def check_trie(spark, rows):
    assert trie_rows(conversation_trie.conversation_trie(conversations(spark, rows))) == sorted(brute_trie(rows), key=repr)


def test_trie_equals_brute_force_with_shared_beginnings(spark):
    r = random.Random(3)
    rows = []
    for c in range(40):
        rows += [(c, t, r.choice("ua"), r.choice(["hi", "é", "yes", ""])) for t in range(r.randint(1, 14))]
    rows += [(c, t, role, text) for c in (101, 102, 103, 207) for t, (role, text) in enumerate([("u", "same"), ("a", "long " * 30), ("u", "end")] * 5)]
    check_trie(spark, rows)


def test_trie_of_odd_turns(spark):
    rows = [
        (None, 1, "u", "nobody"), (1, None, None, None), (1, 3, "u", "c"), (1, 2, None, "b"), (-3, 1, "u", "x"), (-7, 1, "u", "x"), (7, 1, "u", None), (7, 1, "a", "tie"),
        (11, 5, "u", "q"), (12, 5, "u", "q"), (12, 6, "u", "q"), (4, 0, "a" * 300, "w" * 5000),
    ]
    check_trie(spark, rows)


def test_trie_of_repeated_rows_and_of_nothing(spark):
    rows = [(5, 1, "u", "twice")] * 2 + [(15, 1, "u", "twice")] * 2 + [(25, 2, "u", "twice")]
    check_trie(spark, rows)
    assert conversation_trie.conversation_trie(conversations(spark, []).limit(0)).count() == 0


def test_a_conversation_over_many_ranges_keeps_its_order_and_savings(spark):
    rows = [(c, t, "u", f"t{t}") for c in (10, 20) for t in range(3000)] + [(3, 1, "u", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        turns, counts = conversation_trie.turn_places(df)
        assert turns.filter("conv_id = 20").select(F.min("pos"), F.max("pos"), F.countDistinct("pos")).first()[:] == (1, 3000, 3000)
        by_text = turns.filter("conv_id = 10").join(turns.filter("conv_id = 20").select("pos", "k1"), ["pos", "k1"])
        assert by_text.count() == 3000 and {r.n for r in counts.collect()} == {1, 3000}
        old, conversation_trie.BLOCK = conversation_trie.BLOCK, 64
        got = conversation_trie.prefix_trie(turns, counts.select("conv_id")).filter("conv_id = 10 and depth in (1, 2999)").orderBy("depth").collect()
        conversation_trie.BLOCK = old
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    size = [len(f"t{t}") for t in range(3000)]
    assert [(g.n_convs, g.saved_tokens) for g in got] == [(2, sum(size)), (2, sum(size[2998:]))]


def test_a_hot_conversation_takes_one_row_a_level(spark):
    """A thousand equal conversations are one live sequence; their ids are hashed in strings of bounded length."""
    rows = [(1000 + c, t, "u", f"t{t}") for c in range(1500) for t in range(3)] + [(1, 0, "u", "t0"), (1, 1, "u", "other")]
    turns, counts = conversation_trie.turn_places(conversations(spark, rows))
    got = {(r.conv_id, r.depth): r for r in conversation_trie.prefix_trie(turns, counts.select("conv_id")).collect()}
    assert len(got) == 5 and got[1, 1].n_convs == 1501 and got[1000, 3].n_convs == 1500
    assert got[1000, 3].ends_sha256 == hashlib.sha256(",".join(str(1000 + c) for c in range(1500)).encode()).hexdigest()


# --- SentencePiece codec ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary_path("piece_bpe_32k.model"))


def codec_texts():
    r = random.Random(5)
    names = piece_codec.codec(tokens.vocabulary_path("piece_bpe_32k.model")).pieces
    texts = ["", " ", "  \n\t x", "▁a ▁▁", "é日本🎉\u0000x", "\r\n", "<s></s><0x0A><unk>", "a" * 3000, "the" * 200, "日本語" * 100, *[" " * n + "the" for n in range(14, 36)]]
    for _ in range(1500):
        kinds = [r.choice(names), r.choice("abcdetinorsh "), " " * r.randint(1, 20), chr(r.randint(1, 0xD7FF)), "".join(r.choice("etaoin") for _ in range(r.randint(1, 12)))]
        texts.append("".join(r.choice(kinds) for _ in range(r.randint(0, 14))))
    return texts


def test_codec_equals_the_library(library):
    known, texts = piece_codec.codec(tokens.vocabulary_path("piece_bpe_32k.model")), codec_texts()
    ids, counts = known.ids(texts)
    at = 0
    for text, n, want in zip(texts, counts.tolist(), library.encode(texts), strict=True):
        assert ids[at : at + n].tolist() == want, text
        assert known.decoded(want) == library.decode(want)
        at += n


def test_codec_decodes_ids_that_no_text_has(library):
    known, r = piece_codec.codec(tokens.vocabulary_path("piece_bpe_32k.model")), random.Random(6)
    for _ in range(300):
        ids = [r.choice([r.randint(3, 258), r.randint(3, 258), r.randint(3, 31_999)]) for _ in range(r.randint(1, 9))]
        assert known.decoded(ids) == library.decode(ids)


def test_codec_forgets_without_a_change(library, monkeypatch):
    monkeypatch.setattr(piece_codec, "REMEMBERED", 50)
    monkeypatch.setattr(piece_codec, "PAIRS", 100)
    monkeypatch.setattr(piece_codec, "SIDE_BY_SIDE", 6)
    known, texts = piece_codec.PieceCodec(tokens.vocabulary_path("piece_bpe_32k.model")), codec_texts()[:400]
    for k in range(0, 400, 40):
        assert known.ids(texts[k : k + 40])[0].tolist() == [i for x in library.encode(texts[k : k + 40]) for i in x]


def test_codec_on_odd_rows(spark, library):
    rows = [(1, None, 7), (2, "", 7), (3, "a b", 7), (3, "a b", 7), (None, "x" * 50_000 + " é", 7), (4, " \n", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted((tuple(r) for r in piece_codec.roundtrip(docs, tokens.vocabulary_path("piece_bpe_32k.model")).collect()), key=repr)
    want = []
    for i, text, _ in rows:
        ids = library.encode(text or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert piece_codec.roundtrip(docs.limit(0), tokens.vocabulary_path("piece_bpe_32k.model")).count() == 0


# --- importance resampling --------------------------------------------------------------------------------------


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_resample(docs, target, buckets, orders, percent, least):
    def features(text):
        w = words(text)
        return [" ".join(w[i : i + n]) for n in range(orders[0], orders[1] + 1) for i in range(len(w) - n + 1)]

    place = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in features(text):
                counts[place(f)] += 1
    total_s, total_t = sum(s), sum(t)
    out = []
    for i, text in docs:
        g = [math.floor(1000 * math.log((t[b] + 1.0) * (total_s + buckets) / ((s[b] + 1.0) * (total_t + buckets)))) for b in map(place, features(text))]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for rank, x in enumerate(able[: percent * len(able) // 100], 1):
        x[4] = rank
    return sorted((tuple(x[:5]) for x in out), key=repr)


@pytest.mark.parametrize("orders", [(1, 1), (1, 3)])
def test_resampling_equals_brute_force(spark, orders):
    r = random.Random(8)
    vocabulary = ["alpha", "Beta", "gamma9", "été", "日本", "delta", "I", "x1"]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 2, 5, 20, 30, 300])))) for i in range(150)]
    docs += [(None, None), (900, ""), (901, "!!! ..."), (7, "alpha " * 40), (7, "alpha " * 40), (None, "beta " * 25)]
    target = ["alpha beta alpha", None, "delta", ""]
    d = spark.createDataFrame([(i, x, "c", 5) for i, x in docs], "doc_id long, text string, bucket string, copies int").repartition(4)
    t = spark.createDataFrame([(x, 1) for x in target], "text string, s int")
    got = importance.resample(d, t, buckets=50, orders=orders, percent=30, least_words=5)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute_resample(docs, target, 50, orders, 30, 5)


def test_resampling_of_empty_tables(spark):
    d = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    none = d.limit(0)
    assert importance.resample(none, d).count() == 0
    assert importance.resample(d, none, percent=100, least_words=1).first().rank == 1


def test_ranks_go_through_all_partitions(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("a"), "id").repartition(6)
    got = importance.ranks(rows, [F.col("a").desc(), F.col("id").asc()]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 5001))
    assert [(r.a, r.id) for r in got] == sorted(((i % 7, i) for i in range(5000)), key=lambda x: (-x[0], x[1]))


def test_resampling_uses_no_python(spark):
    d = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    plan = importance.resample(d, d)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
