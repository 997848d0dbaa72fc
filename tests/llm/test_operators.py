"""Corpus operators on small odd tables, against brute force, exact round trips and held-out accuracy."""

import bisect
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, decontamination, html_blocks, jaccard_join, jpeg, lang_id, licences, main_text, media, min_cut, packing, sharding, substring_dedup, token_files, tokens
from tessera.llm.components import connected

SCHEMA = "doc_id long, text string, lang string, source string, shard int, slot long, key string, n long, fp long, length long"
WORDS = [a + b + c for a in ("th", "an", "re", "ou") for b in ("ing", "er", "on") for c in ("", "s", "ed", "ly")]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def odd_rows():
    r = random.Random(7)
    base = prose(r, 80)
    rows = [
        (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "one", "en"), (5, base, "en"), (6, base, "en"), (6, base, "en"), (7, base + " " + prose(r, 3), None),
        (8, prose(r, 9000), "en"), (9, "é ü 日本 🎉 ÀÉ", "fr"), (10, "123 456 !!!", "en"), (11, base.upper(), "de"), (12, prose(r, 60) + " " + base + " " + prose(r, 30), "en"),
    ]
    return [(i, t, lang, "s", 3, 4, "k", 5, 6, 7) for i, t, lang in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- shared helpers ---------------------------------------------------------------------------------------------


def test_word_and_shingle_hashes_follow_the_words():
    r = random.Random(1)
    seen = {}
    for _ in range(300):
        text = "".join(r.choice("aAbB \t\n\v.é") for _ in range(r.randint(0, 30)))
        words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
        hashes = common.word_hashes(text)
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes.tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert len(common.shingle_hashes(common.word_hashes("a b"), 5)) == 1
    assert not len(common.shingle_hashes(common.word_hashes(None), 5))


def test_places():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1 << 63, 50_000, dtype=np.uint64))
    p = common.Places()
    for part in np.array_split(keys, 7):
        p.add(part)
    assert (p.find(keys) == np.arange(len(keys))).all() and (p.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert dict(map(tuple, connected(spark.createDataFrame(edges, "a long, b long")).collect())) == want
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 licences -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def licence_model():
    r = random.Random(1)
    return licences.fit([prose(r, r.randint(3, 60)) for _ in range(300)])


@pytest.mark.parametrize(
    ("text", "family"),
    [
        ("Released under the MIT License.", "mit"), ("Licensed under the Apache License, Version 2.0.", "apache"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("Licensed under CC BY-SA 4.0.", "cc-by-sa"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl"), ("Licensed under the GNU Affero General Public License, version 3.", "agpl"),
        ("All rights reserved.", "proprietary"), ("anings reers ouing", "none"), ("", "none"), ("Licensed under the Foo Bar licence of Utopia", "unknown"),
    ],
)
def test_licence_families(licence_model, text, family):
    assert licence_model.classify(text)[0] in ((family, "none") if family == "unknown" else (family,))


def test_licence_scan(spark, odd, empty):
    with_notice = odd.unionByName(odd.limit(0)).withColumn("text", F.when(F.col("doc_id") == 4, F.lit("anings\n\nReleased under the MIT License.\nreers")).otherwise(F.col("text")))
    rows = {r.doc_id: r for r in licences.licence_scan(with_notice).collect()}
    assert set(rows) == set(range(1, 13))
    assert (rows[4].families, rows[4].n_licences, rows[4].n_paragraphs) == ("mit", 1, 3)
    assert rows[1].n_paragraphs == 0 and rows[1].families == "" and all(rows[k].n_licences == 0 for k in rows if k != 4)
    assert licences.licence_scan(empty).count() == 0


@pytest.mark.parametrize("family", sorted(licences.TEMPLATES))
@pytest.mark.parametrize("mark", ["", " * ", "# ", "// "])
def test_wrapped_notices(licence_model, family, mark):
    import textwrap

    r = random.Random(3)
    for notice in licences.TEMPLATES[family]:
        body = [mark + x for x in textwrap.wrap(notice, 72 if len(notice) > 150 else 40)]
        for text in ([*body, "", prose(r, 30)], [prose(r, 12), mark.rstrip(), *body, mark.rstrip(), prose(r, 40), prose(r, 20)], [prose(r, 9), *body, prose(r, 10), prose(r, 10)]):
            assert {f for _, f, *_ in licence_model.scan(text)} == {family}
    assert [f for _, f, *_ in licence_model.scan(["Released under the MIT License.", "Licensed under CC BY-SA 4.0.", prose(r, 20)])] == ["mit", "cc-by-sa"]
    assert licence_model.scan([prose(r, 10) for _ in range(20)]) == []


def test_training_lines_are_distinct(spark):
    r = random.Random(8)
    common_lines = spark.createDataFrame([(f"{prose(r, 5)} x{k}",) for k in range(200)], "line string")
    often = common_lines.orderBy(F.xxhash64("line")).first().line
    rows = [(k, f"{often}\n" * 20 + f"the {prose(r, 4)} of this {prose(r, 4)}\nPermission is hereby granted, free of charge, to any person obtaining") for k in range(100)]
    cues = licences.train(spark.createDataFrame(rows, "doc_id long, text string")).cues
    assert not {"the", "of", "this"} & cues and {"permission", "granted", "license"} <= cues


# --- 2 token files and 6 packing --------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    from tokenizers import Tokenizer

    path, r = tokens.vocabulary_path(name), random.Random(5)
    lib = Tokenizer.from_file(path)
    lib.encode_special_tokens = True
    alphabet = "aabB 's'tdrevlm  \n\t1239²½é.É,!?-_'\"Σσİßﬁ日本🎉́  \x1c\x00　"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(1500)] + ["don't I'LL <|endoftext|> 'tis", None]
    ids, n = tokens.PieceEncoder(path).ids(texts)
    at = np.cumsum(n) - n
    for t, a, k in zip(texts, at, n, strict=True):
        assert lib.encode(t or "", add_special_tokens=False).ids == ids[a : a + k].tolist(), t


def test_encoder_forgets_without_harm(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    r, path = random.Random(6), tokens.vocabulary_path("byte_bpe_50k.json")
    small, big = tokens.PieceEncoder(path), tokens.PieceEncoder(path)
    for _ in range(20):
        texts = [prose(r, 20) + str(r.random())]
        a, b = small.ids(texts), big.ids(texts)
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


@pytest.mark.parametrize("most", [1, 200, 300, 70_000, 1 << 20])
def test_block_round_trip(most):
    r = np.random.default_rng(1)
    for n in (1, 3, 4, 5, 1000, 100_000):
        ids = r.integers(0, most, n).astype(np.uint32)
        assert (token_files.decode_block(*token_files.encode_block(ids), n) == ids).all()


def test_token_files(spark, odd, empty):
    path = tokens.vocabulary_path("byte_bpe_50k.json")
    out = common.new_path(spark, "test-tokens")
    token_files.write_token_files(odd, out, path, 0, block_ids=500)
    rows = sorted(token_files.read_token_files(spark, out, with_ids=True).collect(), key=lambda r: r.start)
    enc, at = tokens.encoder(path), 0
    want = sorted(((i, t) for i, t, *_ in odd_rows()), key=lambda x: (x[0], x[1] or ""))
    assert [r.doc_id for r in rows] == [i for i, _ in want]
    for r, (_, t) in zip(rows, want, strict=True):
        ids = [*enc.ids([t])[0].tolist(), 0]
        assert (r.start, r.n_tokens, r.ids) == (at, len(ids), ids) and r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)
    assert token_files.roundtrip(empty, path).count() == 0


def check_packing(rows, size):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for off, n in sorted(places):
            assert off == at
            at += n
        assert at <= size
    return len(by)


def test_packing(spark, odd, empty):
    path = tokens.vocabulary_path("word_bpe_49k.json")
    rows = packing.pack_documents(odd, path).collect()
    check_packing(rows, 4096)
    enc = tokens.encoder(path)
    for i, t, *_ in odd_rows():
        ids = np.append(enc.ids([t])[0], 1).astype("<u4")
        own = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i})
        assert own == [(p, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for p, a in enumerate(range(0, len(ids), 4096))]
    assert packing.pack_documents(empty, path).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_tight(spark, seed):
    r = random.Random(seed)
    lengths = [min(4096, int(r.lognormvariate(6.5, 1.1)) + 1) for _ in range(3000)] + [4096] * 50 + [2500] * (200 if seed == 3 else 0)
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "i int, length long")
    used = check_packing(packing.pack(df).collect(), 4096)
    least = max(math.ceil(sum(lengths) / 4096), sum(n > 2048 for n in lengths))
    assert used <= least * 1.01 + 1


def test_the_program_packs_most(spark):
    r = random.Random(1)
    h = collections.Counter(r.randint(300, 3000) for _ in range(20_000))
    sizes = np.array(sorted({-(-n // 16) for n in h}))
    demand = np.array([sum(c for n, c in h.items() if -(-n // 16) == s) for s in sizes])
    done = sum(m * int((a * sizes).sum()) for a, m in packing.configurations(sizes, demand, 256))
    assert done > 0.5 * int((sizes * demand).sum())


# --- 3 languages ------------------------------------------------------------------------------------------------


def test_code_lengths_are_exact():
    r = random.Random(1)
    texts = {"a": ["".join(r.choice("abc ") for _ in range(200)) for _ in range(3)], "b": ["".join(r.choice("bcdé ") for _ in range(200)) for _ in range(3)]}
    count = collections.Counter((lang, int(s)) for lang, ts in texts.items() for t in ts for s in lang_id._strings(lang_id.seen_bytes(t)))
    langs = sorted(texts)
    model = lang_id.Model(langs, np.array([s for _, s in count], dtype=np.uint64), np.array([langs.index(x) for x, _ in count]), np.array(list(count.values())))
    trees = {lang: collections.defaultdict(collections.Counter) for lang in langs}
    for (lang, s), n in count.items():
        raw = s.to_bytes(5, "big")
        for k in range(5):
            trees[lang][raw[4 - k : 4]][raw[4]] += n

    def bits(lang, raw):
        out = 0.0
        for k in range(4, -1, -1):
            seen = trees[lang].get(raw[4 - k : 4])
            if seen:
                total, kinds = sum(seen.values()), len(seen)
                if raw[4] in seen:
                    return out + math.log2((total + kinds) / seen[raw[4]])
                out += math.log2((total + kinds) / kinds)
        return out + 8.0

    probe = lang_id._strings(lang_id.seen_bytes("abc bcd zzz éa xyz ab"))
    got = model.bits(probe)
    want = [[bits(lang, int(s).to_bytes(5, "big")) for lang in langs] for s in probe]
    assert np.allclose(got, want, atol=1e-3)


def test_language_id(spark, odd, empty):
    rows = {r.doc_id: r for r in lang_id.identify(odd).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (1, 2, 3, 10))
    assert rows[8].lang_pred == "en" and 0 < rows[8].score <= 1
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows.values())
    assert lang_id.identify(odd).count() == 13 and lang_id.identify(empty).count() == 0
    assert {r.lang_pred for r in lang_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lang_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.98 * got.count()


def test_a_rare_language_beside_large_ones(spark, monkeypatch):
    monkeypatch.setattr(lang_id, "TREE_STRINGS", 4000)
    r = random.Random(2)
    letters = {"big": "abcdefghijklm", "large": "hijklmnopqrst", "wide": "nopqrstuvwxyz", "rare": "漢字仮名交文書人多"}
    words = {lang: ["".join(r.choice(c) for _ in range(r.randint(2, 6))) for _ in range(400)] for lang, c in letters.items()}
    ids, rows = itertools.count(), []
    for lang, n in (("big", 300), ("large", 300), ("wide", 300), ("rare", 20)):
        rows += [(next(ids), " ".join(r.choice(words[lang]) for _ in range(60)), lang) for _ in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.train(docs)
    assert model.langs == sorted(letters)
    got = lang_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert all(x.lang_pred == x.lang for x in got) and any(x.lang == "rare" for x in got)
    count = collections.Counter()  # orders 0 to 3 are counted whole
    for i, text, lang in rows:
        if lang == "rare" and zlib.crc32(str(i).encode()) % 4 != 2:
            count.update(s.to_bytes(5, "big")[4] for s in map(int, lang_id._strings(lang_id.seen_bytes(text))))
    probe = np.array(sorted(count), dtype=np.uint64)
    want = [math.log2((sum(count.values()) + len(count)) / count[int(c)]) for c in probe]
    assert np.allclose(model.bits(probe, 0)[:, model.langs.index("rare")], want, atol=1e-3)


@pytest.mark.parametrize(("sizes", "most", "share"), [([5, 100, 100], 105, 50), ([5, 6], 100, 6), ([10, 10, 10], 6, 2), ([50], 7, 7)])
def test_shares(sizes, most, share):
    assert lang_id._share(sizes, most) == share and sum(min(x, share) for x in sizes) <= max(most, len(sizes))


# --- 4 pages ----------------------------------------------------------------------------------------------------


def test_minimum_cut_against_all_cuts():
    r = random.Random(3)
    for _ in range(200):
        n = r.randint(1, 7)
        s, t = [r.random() * r.choice((0, 1, 3)) for _ in range(n)], [r.random() * r.choice((0, 1, 3)) for _ in range(n)]
        edges = [(r.randrange(n), r.randrange(n), r.random()) for _ in range(r.randint(0, 10))]

        def cost(side):
            return sum(s[i] for i in range(n) if not side[i]) + sum(t[i] for i in range(n) if side[i]) + sum(c for a, b, c in edges if side[a] != side[b])

        assert cost(min_cut.minimum_cut(s, t, edges)) == pytest.approx(min(map(cost, itertools.product((False, True), repeat=n))))


PAGE = """<html><head><title>T</title></head><body><header class="site"><div class=logo>Site</div><nav><a href=/>Home</a> <a href=/x>X</a></nav></header>
<div id="cookie-notice"><p>We use cookies to make this site better. By using it you agree.</p></div><div class="sidebar"><h3>Recent</h3><ul><li><a href=1>One post</a></ul></div>
<div class="content"><h1>Great story</h1><p>It was a dark night. The wind blew over the hills, and nobody was out.<p>Then <b>sud</b>denly &amp; quietly&nbsp;it ended.<br>All was told.</p>
<form><label>Mail</label><button>Send</button></form></div><div class="comments"><div class="comment"><p>I loved this story a lot. It made me happy for days, thank you.</p></div></div>
<footer>&copy; 2020 <a href=/p>Privacy</a></footer><script>if(a<b){x="</p>"}</script></body></html>"""


def test_main_text(spark):
    broken = ["<p>open", "<<<>>>", "<div", "plain words stand here. And more of them.", "<script>never closed", "<!-- never closed", '<a href="x>unclosed quote</a>']
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (3, "u", ""), *[(10 + i, "u", b) for i, b in enumerate(broken)], (30, "u", PAGE.replace("hills", "hills " * 50_000))]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: r for r in main_text.main_text(pages).collect()}
    assert got[1].text == "Great story It was a dark night. The wind blew over the hills, and nobody was out. Then suddenly & quietly it ended. All was told."
    assert got[2].text == got[3].text == "" and got[1].n_chars == len(got[1].text)
    assert got[30].n_chars > 250_000 and len(got) == 11
    assert main_text.main_text(pages.limit(0)).count() == 0


def test_main_text_is_the_article(spark):
    import html

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in pages.join(main_text.main_text(pages), "page_id").select("html", "text").collect():
        article = re.sub(r"<br>|</?(p|h1)[^>]*>", " ", re.search(r"<article>(.*?)</article>", r["html"], re.S)[1])
        assert r["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", "", article)).split())


def test_blocks_of_deep_markup():
    assert html_blocks.blocks_of("<div>" * 3000 + "deep" + "</div>" * 3000)[0].text == "deep"


@pytest.mark.parametrize(
    "wrap",
    [
        ("<body class='right-sidebar'>", "</body>"), ("<html class='cookies-not-set'><body>", "</body></html>"), ("<body><form id=aspnetForm>", "</form></body>"), ("<body><form><div class='page has-sidebar'>", "</div></form></body>"),
        ("<body><datalist><option>red<option>green</datalist>", "</body>"), ("<body><script>x='<!--'; y=\"</p>\"</script>", "</body>"),
    ],
)
def test_wrappers_of_the_page_are_not_boilerplate(wrap):
    good = [f"Paragraph {k} tells of hills and rivers. It was long ago, and nobody knows the whole story." for k in range(5)]
    page = "<nav><a href=/>Home</a></nav><div class=side><p>Try our other pages, too.</p></div>" + "".join(f"<p>{g}</p>" for g in good) + "<form><label>Mail</label><button>Send</button></form>"
    page += "<div class=comments>" + "<p>I loved this story a lot. It made me happy for days.</p>" * 30 + "</div>"
    blocks = html_blocks.blocks_of(wrap[0] + page + wrap[1])
    assert [b.text for b, ok in zip(blocks, main_text.label(blocks, main_text.PLAIN), strict=True) if ok] == good


# --- 5 sharding -------------------------------------------------------------------------------------------------


def test_hypergeometric_law():
    rng, n = random.Random(1), 4000
    got = collections.Counter(sharding.hypergeometric(rng, 7, 9, 6) for _ in range(n))
    for k in range(7):
        p = math.comb(7, k) * math.comb(9, 6 - k) / math.comb(16, 6)
        assert abs(got[k] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 1e-9
    big = sharding.hypergeometric(rng, 10**12, 10**13, 10**10)
    assert abs(big - 10**10 / 11) < 10 * math.sqrt(10**10)


def test_shards(spark, odd, empty):
    many = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit(1).alias("shard"))
    for df, n in ((odd, 13), (many, 1000), (empty, 0)):
        rows = sharding.exact_shards(df, 24, rows_per_bucket=50).collect()
        sizes = collections.Counter(r["shard"] for r in rows)
        assert len(rows) == n and max(sizes.values(), default=0) - min(sizes.values(), default=0) <= 1
        for s, k in sizes.items():
            assert sorted(r.slot for r in rows if r["shard"] == s) == list(range(k))
        assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r.doc_id for r in df.collect())
    a, b = (sorted((r.doc_id, r["shard"], r.slot) for r in sharding.exact_shards(many, 24, seed=k).collect()) for k in (1, 2))
    assert a != b and a == sorted((r.doc_id, r["shard"], r.slot) for r in sharding.exact_shards(many, 24, seed=1).collect())


# --- 7 repeated passages ----------------------------------------------------------------------------------------


def test_compact_windows_against_all_runs():
    r = np.random.default_rng(1)
    for n, least in ((30, 5), (60, 7), (46, 46), (45, 46)):
        values = r.integers(0, 1 << 62, n).astype(np.uint64)
        got = substring_dedup.compact_windows(values, least)
        for i in range(n):
            for j in range(i + least - 1, n):
                c = i + int(values[i : j + 1].argmin())
                assert sum(a == c and left <= i and j <= right for left, a, right in got) == 1
        assert all(values[left : right + 1].argmin() + left == a and right - left + 1 >= least for left, a, right in got)


def window_keys(words):
    shingles = common.shingle_hashes(words)
    return substring_dedup.windows(shingles, np.array([0, len(shingles)]))[2]


def test_windows_are_joined_compact_windows():
    r = np.random.default_rng(3)
    texts = [r.integers(0, 1 << 62, n).astype(np.uint64) for n in (20, 46, 0, 130, 45, 90)]
    texts[3][60:100] = texts[5][10:50]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    first, last, key = substring_dedup.windows(np.concatenate(texts), bounds)
    of = np.searchsorted(bounds, first, "right") - 1
    named = {}
    for k, values in enumerate(texts):
        own = of == k
        for group in range(substring_dedup.GROUPS):
            both = [substring_dedup.compact_windows(values * m, substring_dedup.LEAST) for m in substring_dedup._MULTIPLIERS[2 * group : 2 * group + 2]]
            # every shortest passage lies in one compact window of each function; the pair of anchors decides the key
            for start in range(len(values) - substring_dedup.LEAST + 1):
                anchors = tuple(values[next(c for left, c, right in w if left <= start <= c < start + substring_dedup.LEAST <= right + 1)] for w in both)
                at = own & (first <= bounds[k] + start) & (last >= bounds[k] + start)
                assert at.sum() == substring_dedup.GROUPS
                keys = set(key[at].tolist())
                named.setdefault((group, anchors), keys)
                assert named[group, anchors] & keys
    assert sum(of == 1) == substring_dedup.GROUPS and not {0, 2, 4} & set(of.tolist())


def test_passages(spark, odd, empty):
    r = random.Random(11)
    passage, edited = prose(r, 70), None
    words = passage.split()
    edited = " ".join([*words[:30], "zzz", *words[31:]])
    rows = [(i, t, *rest) for i, t, *rest in odd_rows()]
    extra = [(100, prose(r, 90) + " " + passage + " " + prose(r, 40)), (101, prose(r, 20) + " " + passage.upper() + "\n" + prose(r, 60)), (102, edited), (103, prose(r, 300)), (104, " ".join(words[:40]) + " " + prose(r, 50))]
    df = spark.createDataFrame(rows + [(i, t, None, None, 1, 2, "", 0, 0, 0) for i, t in extra], SCHEMA).repartition(3)
    got = {(x.doc_id, x.kept_doc_id): x for x in substring_dedup.repeated_passages(df).collect()}
    assert (got[101, 100].first_word, got[101, 100].end_word, got[101, 100].similarity) == (20, 90, 1.0)
    assert got[102, 100].end_word - got[102, 100].first_word == 70 and got[102, 100].similarity >= 0.75
    assert {a for a, _ in got} == {6, 7, 11, 12, 101, 102}
    whole = {(x.doc_id, x.first_word): x for x in substring_dedup.repeated_stretches(df).collect()}
    assert whole[101, 20].kept_doc_ids == [100] and whole[12, 60].kept_doc_ids == [5] and {a for a, _ in whole} == {a for a, _ in got}
    assert [(p.kept_doc_id, p.kept_first_word, p.kept_end_word) for p in whole[101, 20].passages] == [(100, 90, 160)]
    cut = {x.doc_id: x.text for x in substring_dedup.without_repeats(df).collect()}
    assert cut[100] == extra[0][1] and cut[103] == extra[3][1] and cut[104] == extra[4][1] and cut[102] == "" and cut[1] is None
    assert cut[101] == " ".join(extra[1][1].split()[:20]) + " " + extra[1][1].split("\n")[1]
    assert substring_dedup.without_repeats(df).columns == df.columns and substring_dedup.without_repeats(df).count() == df.count()
    assert substring_dedup.repeated_passages(empty).count() == 0


def test_no_exact_passage_is_missed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    words = {r.doc_id: r.text.encode().lower().split() for r in docs.collect()}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][p : p + 50]), i)
    found = collections.defaultdict(set)
    for r in substring_dedup.repeated_passages(docs).collect():
        found[r.doc_id].update(range(r.first_word, r.end_word))
        a, b = words[r.doc_id][r.first_word : r.end_word], words[r.kept_doc_id][r.kept_first_word : r.kept_end_word]
        x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
        assert len(x & y) >= 0.75 * len(x | y) and min(len(a), len(b)) >= 50 and r.kept_doc_id < r.doc_id
    for i, w in words.items():
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < i:
                assert found[i].issuperset(range(p, p + 50))


def test_passages_behind_a_common_first_document(spark):
    r = random.Random(5)
    rows, most = [], 40
    for k in range(most):
        lines = [" ".join(f"w{r.randrange(10**6)}" for _ in range(25)) for _ in range(2)]
        rows += [(1000 * j + k, prose(r, 30) + f" a{k} " + lines[j % 2] + f" b{k} " + prose(r, 30)) for j in range(6)]
        rows += [(10_000 + 100 * k + j, prose(r, 40) + f" c{k}{j} " + " ".join(lines) + f" d{k}{j} " + prose(r, 20)) for j in range(3)]
    got = {(x.doc_id, x.first_word, x.end_word) for x in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(10_000 + 100 * k + j, 41, 91) for k in range(most) for j in (1, 2)}


def test_heads_that_hold_overlapping_parts(spark):
    # three earlier documents hold overlapping parts of a passage, then two hold all of it
    r = random.Random(8)
    rows, n = [], 200
    for k in range(n):
        size = (60, 80, 100)[k % 3]
        p = [f"p{r.randrange(10**7)}" for _ in range(size)]
        cuts = (p[: size * 6 // 10], p[size // 4 : size * 85 // 100], p[size * 4 // 10 :])
        rows += [(1000 * j + k, f"{prose(r, 40)} a{k}{j} {' '.join(cuts[j])} b{k}{j} {prose(r, 30)}") for j in range(3)]
        rows += [(10_000 + 1000 * j + k, f"{prose(r, 30)} c{k}{j} {' '.join(p)} d{k}{j} {prose(r, 30)}") for j in range(2)]
    # tails without doc_id and texts that share one doc_id are documents as well
    rows += [(7777, " ".join(f"q{i}" for i in range(60))), (7777, " ".join(f"s{i}" for i in range(60))), (None, "x " + " ".join(f"s{i}" for i in range(60)))]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for k in range(n):
        size = (60, 80, 100)[k % 3]
        spans = [(x.first_word, x.end_word) for x in found if x.doc_id == 11_000 + k]
        covered = set().union(*(range(a, b) for a, b in spans))
        for start in range(31, 31 + size - 49):  # each exact stretch of 50 words is found whole
            assert any(a <= start and start + 50 <= b for a, b in spans), (k, spans)
        assert covered == set(range(31, 31 + size))
    assert [(x.first_word, x.end_word, x.kept_doc_id) for x in found if x.doc_id is None] == [(1, 61, 7777)]


def test_near_passages_behind_heads_that_hold_parts(spark):
    # three earlier documents hold overlapping parts, too short for passages of their own, of what two later ones nearly share
    r = random.Random(60)
    rows, n, kinds = [], 150, ((60, 1, 35), (80, 2, 45), (100, 3, 48))
    for k in range(n * len(kinds)):
        size, edits, part = kinds[k // n]
        p = [f"p{r.randrange(10**7)}" for _ in range(size)]
        near = list(p)
        for place in r.sample(range(8, size - 8), edits):
            near[place] = f"e{r.randrange(10**7)}"
        for j, at in enumerate((0, (size - part) // 2, size - part)):
            rows.append((1000 * j + k, f"{prose(r, 40)} a{k}{j} {' '.join(p[at : at + part])} b{k}{j} {prose(r, 30)}"))
        rows += [(10_000 + 1000 * j + k, f"{prose(r, 30)} c{k}{j} {' '.join(x)} d{k}{j} {prose(r, 30)}") for j, x in enumerate((p, near))]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    linked = {x.doc_id - 11_000 for x in found if x.kept_doc_id == x.doc_id - 1000 and x.doc_id >= 11_000}
    counts = [sum(k // n == of for k in linked) for of in range(len(kinds))]
    assert min(counts) >= 0.98 * n, counts


def test_near_passages_behind_many_heads_that_hold_parts(spark):
    # more earlier documents than HEADS hold parts, too short for passages of their own, of what two later ones nearly share
    r = random.Random(61)
    rows, n, parts = [], 40, 12
    for k in range(n):
        p = [f"p{r.randrange(10**7)}" for _ in range(60)]
        near = list(p)
        near[r.randrange(8, 52)] = f"e{r.randrange(10**7)}"
        for j in range(parts):
            at = 25 * j // (parts - 1)
            rows.append((1000 * j + k, f"{prose(r, 40)} a{k}x{j} {' '.join(p[at : at + 35])} b{k}x{j} {prose(r, 30)}"))
        rows += [(50_000 + 1000 * j + k, f"{prose(r, 30)} c{k}x{j} {' '.join(x)} d{k}x{j} {prose(r, 30)}") for j, x in enumerate((p, near))]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    linked = {x.doc_id - 51_000 for x in found if x.kept_doc_id == x.doc_id - 1000 and x.doc_id >= 51_000}
    assert len(linked) >= 0.98 * n, sorted(linked)


def test_rare_shingles_of_similar_runs_meet():
    r = np.random.default_rng(3)
    least, level = substring_dedup.LEAST, r.integers(0, 4, substring_dedup.CELLS).astype(np.uint8)
    assert (substring_dedup.HELD, substring_dedup.RARE) == (40, 7)
    for _ in range(300):
        x = r.integers(0, 1 << 64, least, dtype=np.uint64)
        y = x.copy()
        y[r.choice(least, least - substring_dedup.HELD, replace=False)] = r.integers(0, 1 << 64, least - substring_dedup.HELD, dtype=np.uint64)
        a, b = (set(z[substring_dedup.rare_places(z, np.zeros(1, dtype=np.int64), level)[0]].tolist()) for z in (x, r.permutation(y)))
        assert a & b


def test_copies_have_the_first_one_only(spark):
    text, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    rows = [(3, text), (1, text), (2, text), (None, text), (2, other), (5, f"a {other}"), (6, "a b"), (7, "a b"), (1, text)]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(2, 0, 60, 1, 0, 60), (3, 0, 60, 1, 0, 60), (5, 1, 61, 2, 0, 60), (None, 0, 60, 1, 0, 60)]
    assert sorted((tuple(x)[:6] for x in found), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("edit", ["insertion", "deletion", "substitution"])
def test_near_passages_are_found(edit):
    r = np.random.default_rng(4)

    def words(n):
        return r.integers(0, 1 << 62, n).astype(np.uint64)

    met = 0
    for k in range(300):
        p, at = words(60 if k % 2 else 50), int(r.integers(5, 44))
        q = {"insertion": np.insert(p, at, words(1)), "deletion": np.delete(p, at), "substitution": np.concatenate([p[:at], words(1), p[at + 1 :]])}[edit]
        if len(q) < 50:
            q = np.concatenate([q, tail := words(1)])
            p = np.concatenate([p, tail])
        x, y = np.concatenate([words(60), p, words(60)]), np.concatenate([words(35), q, words(80)])
        (found,) = substring_dedup.passages(x, y)
        assert found[:4] == (60, 60 + len(p), 35, 35 + len(q)) and found[4] >= 0.75
        met += len(np.intersect1d(window_keys(x), window_keys(y))) > 0
    assert met >= 0.98 * 300  # the recall that AGREE and GROUPS are set for


def test_starts_without_hope_are_not_joined(monkeypatch):
    r = np.random.default_rng(12)
    kinds = r.integers(0, 1 << 62, 400).astype(np.uint64)
    lines = [kinds[k : k + 9] for k in range(0, 360, 9)]
    tried = []
    monkeypatch.setattr(substring_dedup, "bisect_right", lambda *a: tried.append(1) or bisect.bisect_right(*a))
    # all lines of x come again and again, and y has one of them as often
    x = np.concatenate([lines[0] if k % 2 else lines[k % 8] for k in range(120)])
    y = np.concatenate([lines[0] if k % 2 else lines[20 + k % 8] for k in range(120)])
    assert substring_dedup.passages(x, y) == [] and not tried
    cases = [(np.tile(kinds[:1], 300), np.concatenate([kinds[5:60], np.tile(kinds[:1], 80), kinds[60:90]]))]
    for k in range(200):
        n = int(r.integers(2, 9))
        a, b = (np.concatenate([lines[i] for i in r.integers(0, n, 25)]) for _ in range(2))
        for z in (a, b):
            z[r.integers(0, len(z), 6)] = kinds[r.integers(0, 400, 6)]
        cases.append((a, b))
    got = [substring_dedup.passages(a, b) for a, b in cases]
    monkeypatch.setattr(substring_dedup, "_hopeful", lambda a, at, y, starts, starts_y: np.ones(len(starts), dtype=bool))
    assert got == [substring_dedup.passages(a, b) for a, b in cases]
    assert 0 < sum(map(bool, got)) < len(got)


def test_words_of_copies_are_counted_for_copies_only(spark):
    texts = [None, "", " ", "a", "a  b\tc\n", "\x0bä\fß\r", "x" * 600_000 + " y", *(" ".join("w" * n) for n in (49, 50))]
    batch = pa.RecordBatch.from_pydict({"t": list(range(len(texts))), "text": texts})
    assert [r["n"] for b in substring_dedup._word_counts(iter([batch])) for r in b.to_pylist()] == [len((t or "").split()) for t in texts]
    docs = spark.createDataFrame([(i, i, i // 2, "w " * 60) for i in range(8)], "r long, doc_id long, t long, text string")
    copies = docs.filter("r % 2 = 1").select("r", "t", "doc_id", (F.col("r") - 1).alias("kept_doc_id"))
    plan = substring_dedup._copied(docs, copies)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("ArrowEvalPython") and "regexp" not in plan
    assert substring_dedup._copied(docs, copies).count() == 4


def test_pairs_move_in_as_many_rounds_as_there_are_texts_for(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(60))
    texts = spark.createDataFrame([(k, k, k, f"{text} e{k}") for k in range(9)], "r long, doc_id long, t long, text string")
    want = [(r, h) for r in range(9) for h in range(r)]
    moved, store_parts = [], common.store_parts
    monkeypatch.setattr(common, "store_parts", lambda parts, name: store_parts((moved.append(name) or p for p in parts), name))
    monkeypatch.setattr(substring_dedup, "FEW_PAIRS", 10)
    found = substring_dedup._verified(spark.createDataFrame(want, "r long, head long"), texts).collect()
    assert len(moved) == 4 and sorted((x.doc_id, x.kept_doc_id) for x in found) == want

    # rare shingles meet in rounds of their askers, with the same pairs
    r = np.random.default_rng(8)
    base, rows = [f"w{k}" for k in range(80)], []
    for k in range(12):
        words = list(base)
        for i in r.choice(80, 4, replace=False):
            words[i] = f"n{k}x{i}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once = sorted(map(tuple, substring_dedup.repeated_passages(docs).collect()))
    moved.clear()
    monkeypatch.setattr(substring_dedup, "_rounds", lambda rows, few, most: 3)
    assert once and sorted(map(tuple, substring_dedup.repeated_passages(docs).collect())) == once
    assert moved.count("rare-pairs") == 3


def test_driver_gives_back_filters_and_garbage(spark, monkeypatch):
    cleaned, gone, clean = [], [], common.clean
    monkeypatch.setattr(common, "clean", lambda s: cleaned.append(1) or clean(s))
    kind = type(spark.sparkContext.broadcast(0))
    destroy = kind.destroy
    monkeypatch.setattr(kind, "destroy", lambda self, *a, **b: gone.append(1) or destroy(self, *a, **b))
    stored, store = [], common.store
    monkeypatch.setattr(common, "store", lambda df, name: stored.append(name) or store(df, name))
    docs = spark.createDataFrame([(1, " ".join(f"x{i}" for i in range(60))), (2, " ".join(f"x{i}" for i in range(61)))], "doc_id long, text string")
    assert substring_dedup.repeated_passages(docs).count() == 1
    assert len(cleaned) >= len(stored) > 8 and len(gone) >= 4


def test_wide_gaps_and_repeated_lines(monkeypatch):
    r = np.random.default_rng(6)
    a, b, gap, line = (r.integers(0, 1 << 62, n).astype(np.uint64) for n in (49, 49, 13, 7))
    ((s, e, t, u, similarity),) = substring_dedup.passages(np.concatenate([a, gap, b]), np.concatenate([a, b]))
    assert (s, e, t, u, round(similarity, 3)) == (0, 111, 0, 98, round(90 / 111, 3))
    x, y = np.concatenate([np.tile(line, 40), a, b]), np.concatenate([a, b, np.tile(line, 30)])
    want = [c.tolist() for c in substring_dedup.equal_runs(x, substring_dedup.Indexed(y))]
    monkeypatch.setattr(substring_dedup, "PAIRS_AT_ONCE", 100)
    assert want == [c.tolist() for c in substring_dedup.equal_runs(x, substring_dedup.Indexed(y))]
    assert all((x[s:e] == y[s - d : e - d]).all() for s, e, d in zip(*want, strict=True))


# --- 8 media ----------------------------------------------------------------------------------------------------


def huffman(symbols):
    """(DHT part, code of each symbol): eight or nine bits each, never all ones."""
    symbols = sorted(symbols)
    short = max(0, min(len(symbols), 255 - 2 * max(0, len(symbols) - 250)))
    counts = [0] * 16
    counts[7], counts[8] = short, len(symbols) - short
    codes, code = {}, 0
    for k, s in enumerate(symbols):
        if k == short:
            code <<= 1
        codes[s] = (code, 8 if k < short else 9)
        code += 1
    return bytes(counts) + bytes(symbols), codes


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, v, n):
        self.bits += [v >> (n - 1 - k) & 1 for k in range(n)]

    def done(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        raw = bytes(int("".join(map(str, bits[k : k + 8])), 2) for k in range(0, len(bits), 8))
        return raw.replace(b"\xff", b"\xff\x00")


def number(v):
    n = abs(v).bit_length()
    return n, v if v >= 0 else v + (1 << n) - 1


def write_progressive(comps, width, height, restart=0):
    """A plain progressive encoder for tests: comps are (h, v, grid of rows x cols x 64 coefficients)."""
    dc_table, dc = huffman(range(12))
    ac_table, ac = huffman(range(256))
    seg = lambda kind, body: bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body
    out = [b"\xff\xd8", seg(0xDB, bytes([0]) + bytes(range(1, 65))), seg(0xC2, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(comps)]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v, _) in enumerate(comps)))]
    out.append(seg(0xC4, bytes([0x00]) + dc_table + bytes([0x10]) + ac_table))
    if restart:
        out.append(seg(0xDD, restart.to_bytes(2, "big")))
    hm, vm = max(c[0] for c in comps), max(c[1] for c in comps)
    mr, mc = -(-height // (8 * vm)), -(-width // (8 * hm))

    def sos(ids, a, b, high, low):
        return seg(0xDA, bytes([len(ids), *(x for i in ids for x in (i + 1, 0)), a, b, high << 4 | low]))

    def pieces(units, emit):
        parts, step = [], restart or len(units)
        for k in range(0, len(units), step):
            parts.append(emit(units[k : k + step]))
        return b"".join(p + (bytes([0xFF, 0xD0 + i % 8]) if i + 1 < len(parts) else b"") for i, p in enumerate(parts))

    mcus = [[(i, g[r * v + y][c * h + x]) for i, (h, v, g) in enumerate(comps) for y in range(v) for x in range(h)] for r in range(mr) for c in range(mc)]
    if len(comps) == 1:
        g = comps[0][2]
        mcus = [[(0, b)] for row in g[: -(-height // 8)] for b in row[: -(-width // 8)]]

    def dc_first(units):
        w, last = Writer(), [0] * len(comps)
        for i, b in (x for u in units for x in u):
            n, v = number((b[0] >> 1) - last[i])
            last[i] = b[0] >> 1
            w.put(*dc[n])
            w.put(v, n)
        return w.done()

    def dc_refine(units):
        w = Writer()
        for _, b in (x for u in units for x in u):
            w.put(b[0] & 1, 1)
        return w.done()

    def ac_first(a, z):
        def emit(blocks):
            w, run = Writer(), 0

            def flush():
                nonlocal run
                if run:
                    n = run.bit_length() - 1
                    w.put(*ac[n << 4])
                    w.put(run - (1 << n), n)
                run = 0

            for b in blocks:
                zeros = 0
                for k in range(a, z + 1):
                    v = int(math.copysign(abs(b[k]) >> 1, b[k]))
                    if not v:
                        zeros += 1
                        continue
                    flush()
                    while zeros > 15:
                        w.put(*ac[0xF0])
                        zeros -= 16
                    n, x = number(v)
                    w.put(*ac[zeros << 4 | n])
                    w.put(x, n)
                    zeros = 0
                if zeros:
                    run += 1
                    if run == 32767:
                        flush()
            flush()
            return w.done()

        return emit

    def ac_refine(a, z):
        def emit(blocks):
            w, run, later = Writer(), 0, []

            def flush():
                nonlocal run, later
                if run:
                    n = run.bit_length() - 1
                    w.put(*ac[n << 4])
                    w.put(run - (1 << n), n)
                    for bit in later:
                        w.put(bit, 1)
                run, later = 0, []

            for b in blocks:
                new = [k for k in range(a, z + 1) if abs(b[k]) == 1]
                zeros, held = 0, []
                for k in range(a, z + 1):
                    m = abs(b[k])
                    if m > 1:
                        held.append(m & 1)
                    elif not m:
                        zeros += 1
                        if zeros == 16 and new and k < new[-1]:
                            flush()
                            w.put(*ac[0xF0])
                            for bit in held:
                                w.put(bit, 1)
                            zeros, held = 0, []
                    else:
                        flush()
                        w.put(*ac[zeros << 4 | 1])
                        w.put(b[k] > 0, 1)
                        for bit in held:
                            w.put(bit, 1)
                        zeros, held = 0, []
                if zeros or held:
                    run += 1
                    later += held
            flush()
            return w.done()

        return emit

    out += [sos(range(len(comps)), 0, 0, 0, 1), pieces(mcus, dc_first)]
    for i, (h, v, g) in enumerate(comps):
        own = [b for row in g[: -(-(-(-height * v // vm)) // 8)] for b in row[: -(-(-(-width * h // hm)) // 8)]]
        for a, z in ((1, 5), (6, 63)):
            out += [sos([i], a, z, 0, 1), pieces(own, ac_first(a, z))]
        out += [sos([i], 1, 63, 1, 0), pieces(own, ac_refine(1, 63))]
    out += [sos(range(len(comps)), 0, 0, 1, 0), pieces(mcus, dc_refine), b"\xff\xd9"]
    return b"".join(out)


@pytest.mark.parametrize(("factors", "width", "height", "restart"), [([(1, 1)], 20, 13, 0), ([(1, 1)] * 3, 33, 17, 2), ([(2, 2), (1, 1), (1, 1)], 40, 50, 0), ([(2, 1), (1, 1), (1, 1)], 31, 9, 1)])
def test_decoder_against_a_plain_encoder(factors, width, height, restart):
    r = random.Random(width)
    hm, vm = max(h for h, _ in factors), max(v for _, v in factors)
    mr, mc = -(-height // (8 * vm)), -(-width // (8 * hm))
    comps = []
    for h, v in factors:
        rows, cols = -(-(-(-height * v // vm)) // 8), -(-(-(-width * h // hm)) // 8)
        inside = lambda y, x, rows=rows, cols=cols: y < rows and x < cols
        comps.append((h, v, [[[r.randint(-500, 500)] + [r.choice((0, 0, 0, 1, -1, 2, -7, 100)) if inside(y, x) and r.random() < 0.7 else 0 for _ in range(63)] if len(factors) > 1 or inside(y, x) else [0] * 64 for x in range(mc * h)] for y in range(mr * v)]))
    frame = jpeg.decode_coefficients(write_progressive(comps, width, height, restart))
    for c, (_, _, g) in zip(frame.components.values(), comps, strict=True):
        assert (c.coef == np.array(g).reshape(-1, 64)).all()
    assert jpeg.to_rgb(frame).shape == (height, width, 3)


def test_inverse_transform_against_the_sum():
    r = np.random.default_rng(1)
    coef = r.integers(-50, 50, 64)
    want = np.zeros((8, 8))
    for k, (v, u) in enumerate(jpeg.ZIGZAG):
        for y in range(8):
            for x in range(8):
                scale = (1 if u else 0.5**0.5) * (1 if v else 0.5**0.5) / 4
                want[y, x] += scale * coef[k] * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16)
    assert np.allclose((coef.astype(np.float32) @ jpeg._INVERSE).reshape(8, 8), want, atol=1e-2)
    assert jpeg.ZIGZAG[:6] == [(0, 0), (0, 1), (1, 0), (2, 0), (1, 1), (0, 2)]


def test_payloads(spark, odd, empty):
    rows = {r.doc_id: r for r in media.payload_digest(odd).collect()}
    for i, t, *_ in odd_rows():
        raw = (t or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert rows[5].feature == rows[6].feature and rows[5].media_sha256 == rows[6].media_sha256
    assert media.payload_digest(odd).count() == 13 and media.payload_digest(empty).count() == 0


def test_decode_media(spark):
    good = jpeg.encode_payload(bytes(range(256)) * 3)
    rows = [(1, good, "x"), (2, None, "x"), (3, b"", "x"), (4, b"\xff\xd8junk", "x"), (5, good[: len(good) // 2], "x"), (6, good.replace(b"\xff\xc2", b"\xff\xc0"), "x")]
    got = {r.id: r for r in media.decode_media(spark.createDataFrame(rows, "id int, media binary, error string")).collect()}
    assert got[1].error is None and len(got[1].rgb) == got[1].height * got[1].width * 3
    assert all(got[i].error and got[i].rgb is None for i in (2, 3, 4, 6)) and len(got) == 6


# --- 9 Jaccard join ---------------------------------------------------------------------------------------------


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return sorted((i, len(s), root(i)) for i, s in sets)


def near_copies(seed, n=150):
    r = random.Random(seed)
    rows, texts = [], [prose(r, r.randint(1, 120)) for _ in range(8)] + ["a b", "a b c d", "x"]
    for i in range(n):
        w = r.choice(texts).split()
        for _ in range(r.choice((0, 0, 1, 1, 2, 4, 8))):
            w[r.randrange(len(w))] = r.choice(WORDS)
        rows.append((i, " ".join(w) if r.random() < 0.9 else r.choice((None, "", " ", "\n", prose(r, 40)))))
    return rows


@pytest.mark.parametrize(("seed", "heavy"), [(1, 1_000_000), (2, 10), (3, 1_000_000)])
def test_jaccard_components(spark, seed, heavy):
    rows = near_copies(seed)
    df = spark.createDataFrame([(*x, 1, "k", 2) for x in rows], "doc_id long, text string, n int, token string, component_id int").repartition(3)
    assert sorted(map(tuple, jaccard_join.jaccard_components(df, heavy_rows=heavy).collect())) == brute_components(rows)


def test_jaccard_odd_rows(spark, odd, empty):
    got = sorted(map(tuple, jaccard_join.jaccard_components(odd).collect()))
    assert sorted(set(got)) == brute_components(sorted({(i, t) for i, t, *_ in odd_rows()}, key=str)) and len(got) == 13
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_stored_buckets_are_joined_in_place(spark):
    rows = spark.range(2000).select(F.col("id").alias("r"), F.col("id").alias("t"), F.lit("x").alias("text"))
    texts = common.store_bucketed(rows.repartition(4, "r"), "texts", "r")
    found = spark.range(2000).select(F.col("id").alias("r"), (F.col("id") * 2).alias("t"), F.lit(3).alias("first_word"), F.lit(9).alias("end_word"))
    spans = substring_dedup._with_spans(texts, found.hint("merge"))
    plan = spans._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and not re.search(r"Exchange hashpartitioning[^\n]*\n[^\n]*\n?[^\n]*FileScan", plan)
    assert {r.r for r in spans.collect() if r.spans} == {0} and spans.count() == 2000
    common.drop(texts)
    assert not spark.catalog.tableExists(texts._named)


def test_members_of_an_opened_group_meet_by_shared_edits(spark):
    # 30 members and 30 sets that hold the whole prefix but only 68 of the 80 tokens besides, one of them with a member's edits
    core = list(range(100))
    sets = {b: [*core[:96], *range(1000 * b, 1000 * b + 4)] for b in range(1, 31)}
    sets |= {a: [*core[:80], *range(1000 * a, 1000 * a + 20)] for a in range(31, 61)}
    sets[60] = [*core[:82], *sets[7][96:], *range(60_000, 60_014)]
    tokens = spark.createDataFrame([(t, k) for k, s in sets.items() for t in s[:30]], "token long, fp long")
    rows = spark.createDataFrame([(k, 100) for k in sets], "fp long, n long")
    groups = spark.createDataFrame([(b, 1) for b in range(1, 31)], "node long, component long")
    pairs = {tuple(x) for x in jaccard_join._matrix_pairs(tokens, rows, groups, spark.createDataFrame(list(sets.items()), "fp long, s array<long>")).collect()}
    assert {(a, b) for a in range(1, 31) for b in range(31, 61) if 100 * len({*sets[a]} & {*sets[b]}) >= 75 * len({*sets[a]} | {*sets[b]})} == {(7, 60)}
    assert (7, 60) in pairs and sum(a <= 30 for a, _ in pairs) <= 30


@pytest.mark.parametrize("seed", range(3))
def test_one_linking_member_of_each_group_is_found(spark, seed):
    r = random.Random(seed)
    sets, members, asking = {}, [], []

    def varied(core, n, at_most):
        own = set(core)
        for _ in range(r.randint(0, at_most)):
            own.discard(r.choice(sorted(own)))
        while len(own) < n:
            own.add(r.choice((r.randrange(1000, 1012), r.randrange(10**6))))
        return frozenset(list(own)[:n])

    for g in range(12):
        n = r.randint(4, 30)
        core = frozenset(range(100 * g, 100 * g + n))
        inside = list({varied(core, n, n // 3) for _ in range(r.randint(2, 8))})
        if len(inside) < 2:
            continue
        own = []
        for s in inside:
            sets[len(sets)] = s
            own.append(len(sets) - 1)
        members += [(b, n, g, len(own)) for b in own]
        for _ in range(12):
            m = max(1, n + r.randint(-2, 2))
            sets[len(sets)] = varied(r.choice(inside) if r.random() < 0.5 else core, m, n // 2)
            asking.append((len(sets) - 1, m, g))
    content = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "fp long, s array<long>")
    got = jaccard_join._member_pairs(spark.createDataFrame(asking, "a long, n_a long, g long"), spark.createDataFrame(members, "b long, n long, g long, size long"), content)
    pairs, linked = {tuple(x) for x in got.collect()}, 0
    for a, _, g in asking:
        good = {b for b, _, h, _ in members if h == g and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
        linked += bool(good)
        assert not good or any((a, b) in pairs for b in good)
    assert linked > 10


def test_shared_prefix_bound_holds():
    r = random.Random(5)

    def behind(n):
        return max(0, (3 * n + 3) // 4 - 1 - n // 20)

    for _ in range(3000):
        n, m = r.randint(1, 120), r.randint(1, 120)
        both = r.randint(0, min(n, m))
        if 100 * both < 75 * (n + m - both):
            continue
        order = list(range(n + m - both))
        r.shuffle(order)
        a, b = set(order[:n]), set(order[n - both :])
        pa, pb = set(sorted(a)[: n - behind(n)]), set(sorted(b)[: m - behind(m)])
        assert len(pa & pb) >= (3 * (n + m) + 6) // 7 - max(behind(n), behind(m)) >= 1


# --- 10 decontamination -----------------------------------------------------------------------------------------


def brute_hits(docs, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_decontamination(spark, broadcast_rows):
    r = random.Random(9)
    items = [(i, prose(r, r.choice((0, 1, 2, 5, 10, 11, 25)))) for i in range(30)] + [(90, None), (91, "Solo"), (92, "of of of of of of of of of of of of"), (93, "of of of of of of of of of of of of")]
    docs = [(i, t) for i, t, *_ in odd_rows() if i != 6] + [
        (20 + k, f"{prose(r, 30)}, {r.choice(items)[1] or ''}! {prose(r, 5)} {(r.choice(items)[1] or '').upper()}") for k in range(40)
    ]
    docs += [(80, "of " * 40), (81, "SOLO"), (82, "solos"), (83, "Été é solo-solo")]
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id long, text string, words string, n_hit int").repartition(3)
    b = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, key string")
    got = sorted(map(tuple, decontamination.contaminated(d, b, broadcast_rows=broadcast_rows).collect()))
    assert got == brute_hits(docs, items)


def test_decontamination_of_empty_tables(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontamination.contaminated(odd, none).collect()
    assert len(rows) == 13 and not any(r.contaminated for r in rows)
    assert decontamination.contaminated(empty, spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
