"""Fixtures worked out by hand for the operators that SQL says little about."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.extract.json_rows import json_rows, response_rows
from tessera.extract.selectors import alias_rows, chapter_rows, detail_fields, image_rows, page_fields, page_rows, plain_rows, search_rows
from tessera.functions import text, urls, values
from tessera.operators import health, keyed, similarity
from tessera.sources import tables

CARDS = '<div class="card a"><a href="/x/1">T1</a><a href="/x/2">T2</a></div>'


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


# Selectors and what they give on CARDS.
SELECTORS = [
    ("tag.a@href", "/x/1"),
    ("tag.a.1@text", "T2"),
    ("tag.a.-1@href", "/x/2"),
    ("class.card a@tag.a@href", "/x/1"),
    ("tag.b@text||tag.a@text", "T1"),
    ("tag.a.0@text&&tag.a.1@text", "T1T2"),
    (r"tag.a@text##\d", "T"),
    ("tag.a@text##T##X", "1"),
    (r"tag.a@text##(T)(\d)##$2", ""),
    ("tag.h3@a@text", ""),
    ("div.card > a[href='/x/2']@text", "T2"),
    ("!bad", ""),
    ("tag.a.7@text", ""),
    ("div@tag.a.0@html", "T1"),
    ("div@html", '<a href="/x/1">T1</a><a href="/x/2">T2</a>'),
    ("div@ownText", ""),
    ("&@text", "T1T2"),
    ("div > a.-2@text", "T1"),
    ("p > a@text||div a@text", "T1"),
    ("* a.1@href", "/x/2"),
    ("#x,a[href$='2'],a[href=z]@href", "/x/2"),
    ("a[href^='/x']@nothing", ""),
]


def field_of(spark, page, rule, **more):
    return page_fields(spark.createDataFrame([(1, page)], "id long, html string"), "id", "html", {"f": rule}, **more).first()["f"]


def test_selectors(spark):
    rules = {f"f{k}": rule for k, (rule, _) in enumerate(SELECTORS)}
    pages = spark.createDataFrame([(7, CARDS), (None, None)], "id long, html string")
    got = {r.id: r for r in page_fields(pages, "id", "html", rules).collect()}
    assert [(rule, got[7][f"f{k}"]) for k, (rule, _) in enumerate(SELECTORS)] == SELECTORS
    assert all(got[None][f] == "" for f in rules)


def test_documented_replacement(spark):
    assert field_of(spark, CARDS, "tag.a@text##T##X$", doc_semantics=True) == "X$1"
    assert field_of(spark, CARDS, r"tag.a@text##(T)(\d)##$2", doc_semantics=True) == "1"


def test_nested_items_and_implied_ends(spark):
    page = "<ul><li>a<ul><li>b<li>c</ul></li><li>d<p>e<p>f</ul><table><tr><td>1<td>2<tr><td>3</table><br>x</b></i>"
    pages = spark.createDataFrame([(1, page), (1, page), (2, "<p>only")], "id long, html string")
    rows = page_rows(pages, "id", "html", "li", {"own": "*.0@ownText", "all": "&@text", "deep": "li li@text", "p": "p.1@text"})
    want = [(1, 0, "a", "abc", "b", ""), (1, 1, "b", "b", "", ""), (1, 2, "c", "c", "", ""), (1, 3, "d", "def", "", "f")]
    assert sorted(map(tuple, rows.collect())) == sorted(want * 2)
    cells = page_rows(pages, "id", "html", "none||tr > td", {"t": "&"}).filter("id = 1").dropDuplicates(["ord"])
    assert [r.t for r in cells.orderBy("ord").collect()] == ["1", "2", "3"]


def test_page_plan_has_no_python_behind_the_parse(spark):
    pages = spark.createDataFrame([(1, CARDS)], "id long, html string")
    plan = page_rows(pages, "id", "html", "div a", {"u": "tag.a@href"})._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "CartesianProduct" not in plan


def test_page_rows(spark):
    pages = spark.createDataFrame([(1, CARDS), (2, None), (3, "")], "id long, html string")
    rows = page_rows(pages, "id", "html", "p||div a", {"u": "tag.a@href"}).collect()
    assert [tuple(r) for r in rows] == [(1, 0, "/x/1"), (1, 1, "/x/2")]


def test_search_rows(spark):
    page = '<ul><li class="c"><a href="/x/1">One</a><img data-src="//i.com/1.png"></li><li class="c"><a href="/x/2"></a></li></ul><meta property="og:title" content="Og">'
    rule = {"id": "s1", "host": "https://h.com/#note", "search": {"item": "li.c", "title": "tag.a@text", "url": "tag.a@href", "cover": "img@src||img@data-src"}}
    rows = search_rows(spark.createDataFrame([(1, page)], "id long, html string"), "id", "html", rule).collect()
    assert [(r.ord, r.title, r.detail_url, r.cover, r.status, r.weight) for r in rows] == [(0, "One", "https://h.com/x/1", "https://i.com/1.png", None, 100)]
    fields = {"og": "meta[property=og:title]@content", "odd": "li@&@class", "c": "class.c@class"}
    assert page_fields(spark.createDataFrame([(1, page)], "id long, html string"), "id", "html", fields).select(*fields).first()[:] == ("Og", "", "c")


@pytest.mark.parametrize(
    ("link", "base", "want"),
    [("//c.com/a", "https://h.com", "https://c.com/a"), ("/a", "https://h.com", "https://h.com/a"), ("x/1", "https://h.com", "https://x/1"), ("x", "https://h.com/m", "https://h.com/x"), ("", "https://h.com", "")],
)
def test_resolve(spark, link, base, want):
    assert one(spark, urls.resolve(F.lit(link), F.lit(base))) == want


def test_urls(spark):
    assert one(spark, urls.resolve(F.lit("x/1"), F.lit("https://h.com"), repair=True)) == "https://h.com/x/1"
    assert one(spark, urls.clean_host(F.lit("https://a.com#yc1"))) == "https://a.com"
    assert one(spark, urls.apply_keyword(F.lit("/s?q={{keyword}}"), F.lit("a b"))) == "/s?q=a%20b"
    assert one(spark, urls.apply_keyword(F.lit("/s"), F.lit("a b"))) == "/s?keyword=a%20b"
    assert one(spark, urls.apply_keyword(F.lit("/s?x=1"), F.lit("a b"))) == "/s?x=1&keyword=a%20b"
    assert one(spark, urls.failover_hosts(F.lit("cn.a.com"))) == ["cn.a.com", "www.a.com", "m.a.com"]
    assert one(spark, urls.failover_hosts(F.lit("m.a.com"))) == ["m.a.com"]
    assert one(spark, urls.resolve_plain(F.lit("a"), F.lit("https://h.com/"))) == "https://h.com/a"
    assert one(spark, values.encode_component(F.lit("a b!'()*~é"))) == "a%20b!'()*~%C3%A9"


def test_text(spark):
    assert one(spark, text.normalize_title(F.lit("One-Piece！ (第1話)"))) == "onepiece第1話"
    assert one(spark, text.block_pattern(F.lit("验证码 baidu.com"))) == "redirect"
    assert one(spark, text.block_pattern(F.lit("rate limit"))) == "blocked_pattern"
    assert one(spark, text.block_pattern(F.lit("x"))) is None
    assert [one(spark, text.http_class(F.lit(c))) for c in (403, 404, 429, 503, 418, 200)] == ["HTTP_403", "HTTP_404", "HTTP_429", "HTTP_5XX", "HTTP_OTHER", None]
    assert one(spark, text.error_class(F.lit("getaddrinfo x"))) == "DNS_FAILED"
    assert one(spark, text.header_value(F.lit(" a\r\né "))) == "a"
    assert one(spark, values.trimmed(F.lit("　 a "))) == "a"


@pytest.mark.parametrize(("a", "b", "want"), [("abcd", "abce", True), ("ab", "ba", True), ("abc", "xabcx", True), ("abcdefgh", "abcdwxyz", False), ("", "x", True)])
def test_similar(spark, a, b, want):
    assert one(spark, similarity.similar(F.lit(a), F.lit(b))) is want


def test_candidates_lose_no_pair(spark):
    import itertools
    import random

    r = random.Random(3)
    titles = sorted({"".join(r.choice("abcde") for _ in range(r.randint(0, 7))) for _ in range(150)})
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    got = {tuple(x) for x in similarity.similar_pairs(df).collect()}
    pairs = spark.createDataFrame(list(itertools.combinations(titles, 2)), "a string, b string")
    want = {tuple(x) for x in pairs.filter(similarity.similar(F.col("a"), F.col("b"))).collect()}
    assert got == want


def test_leader_clusters_follow_the_order(spark, tmp_path):
    df = spark.createDataFrame([("abcd", 1), ("abce", 2), ("bcex", 3)], "t string, ord int")
    got = dict(map(tuple, similarity.leader_clusters(df, f"file://{tmp_path}").collect()))
    assert got == {"abcd": "abcd", "abce": "abcd", "bcex": "bcex"}


def test_leader_clusters_against_a_loop(spark, tmp_path):
    import random

    r = random.Random(4)
    titles = sorted({"".join(r.choice("abcdef") for _ in range(r.randint(3, 7))) for _ in range(120)})
    r.shuffle(titles)
    rows = list(enumerate(titles))
    df = spark.createDataFrame([(t, i) for i, t in rows], "t string, ord int")
    near = {tuple(x) for x in similarity.similar_pairs(df).collect()}
    leaders, want = [], {}
    for _, t in rows:
        want[t] = next((x for x in leaders if (min(x, t), max(x, t)) in near), t)
        if want[t] == t:
            leaders.append(t)
    assert dict(map(tuple, similarity.leader_clusters(df, f"file://{tmp_path}").collect())) == want


def test_representatives(spark):
    def best(*rows):
        df = spark.createDataFrame([("k", *r) for r in rows], "c string, w int, s string, n string, o int, cover string, author string")
        return similarity.representatives(df, "c", "w", "s", "n", "o", ["cover", "author"], "cover").first()

    r = best((100, "s1", "A", 0, "", "X"), (90, "s2", "B", 1, "c2", None), (80, "s3", "C", 2, "", "Y"))
    assert (r.n, r.cover, r.author) == ("A +2", "c2", "X")
    r = best((100, "s1", "A", 0, "", None), (100, "s2", "B", 1, "c", None))
    assert (r.n, r.s) == ("B", "s2")
    r = best((100, "s1", "A", 0, None, None), (90, "s2", "B", 1, None, None), (80, "s2", "B", 2, None, None))
    assert r.n == "A +2"


T0 = dt.datetime(2024, 1, 1)


def checks(spark, *events):
    return spark.createDataFrame([(1, i, T0 + dt.timedelta(hours=h), f == "F", False) for i, (f, h) in enumerate(events)], "key long, event_id long, ts timestamp_ntz, failed boolean, hard boolean")


def states(df):
    return [(r.status, r.failures, r.skipped) for r in df.orderBy("event_id").collect()]


def test_breaker(spark):
    run = lambda *e: states(health.breaker_states(checks(spark, *e)))
    assert run(("F", 0), ("F", 1), ("F", 2)) == [("healthy", 1, False), ("degraded", 2, False), ("blocked", 3, False)]
    assert run(("F", 0), ("S", 1), ("F", 2), ("F", 3))[-1] == ("degraded", 2, False)
    assert run(("F", 0), ("F", 1), ("F", 2), ("F", 3), ("F", 27))[-2:] == [("blocked", 3, True), ("healthy", 1, False)]
    assert run(("F", 0), ("F", 1), ("F", 2), ("S", 26))[-1] == ("healthy", 0, False)  # exactly at the end of the block
    assert run() == []


def test_breaker_by_hand(spark):
    rows = [(1, 0, T0, True, True, False, 1000, "a"), (1, 1, T0 + dt.timedelta(milliseconds=500), True, False, False, 1000, "b"), (1, 2, T0 + dt.timedelta(milliseconds=600), False, False, True, None, None)]
    rows += [(1, 3, T0 + dt.timedelta(seconds=2), True, True, None, None, None), (1, 4, T0 + dt.timedelta(hours=23), False, False, None, None, None)]
    df = spark.createDataFrame(rows, "key long, event_id long, ts timestamp_ntz, failed boolean, hard boolean, recover boolean, cooldown_ms long, error string")
    got = [(r.status, r.failures, r.skipped, r.last_error) for r in health.breaker_states(df).orderBy("event_id").collect()]
    assert got == [("blocked", 1, False, "a"), ("blocked", 1, True, "a"), ("unknown", 0, False, None), ("blocked", 1, False, None), ("blocked", 1, True, None)]


def test_ewma_and_rollup(spark):
    df = spark.createDataFrame([(1, 100.0, 1), (1, 200.0, 2)], "k int, v double, t int")
    assert health.ewma(df, "k", "v", ["t"]).first()["ewma"] == pytest.approx(130)
    for given, want in (([True, True], "healthy"), ([True, False], "degraded"), ([False, False], "unhealthy"), ([None], "unknown")):
        assert spark.createDataFrame([(x,) for x in given], "ok boolean").agg(health.rollup(F.col("ok")).alias("s")).first()["s"] == want


def test_keyed_with_nulls_and_empty_tables(spark):
    empty = spark.createDataFrame([], "k int, v int, t int")
    some = spark.createDataFrame([(1, None, 1), (1, 5, 2), (None, 7, 1), (1, 5, 2)], "k int, v int, t int")
    assert keyed.latest_per_key(empty, ["k"], "t").count() == 0
    assert sorted(map(tuple, keyed.latest_per_key(some, ["k"], "t").collect()), key=str) == [(1, 5, 2), (None, 7, 1)]
    assert sorted(map(tuple, keyed.upsert(empty, some, ["k"]).collect()), key=str) == [(1, 5, 2), (None, 7, 1)]
    assert sorted(map(tuple, keyed.insert_ignore(empty, some, ["k"]).collect()), key=str) == [(1, None, 1), (None, 7, 1)]
    assert keyed.insert_ignore(some, some, ["k"]).count() == 4
    assert keyed.page(some, [F.col("t")], 0).count() == 4


def test_rules_that_cannot_be_read(spark):
    deep = "<div>" * 5000 + "<p class=a>Vol 12 end</p>" + "</div>" * 5000
    pages = spark.createDataFrame([(1, deep)], "k int, h string")
    rules = {"plain": "class.a", "named": r"class.a##Vol (?<n>\d+).*##$1", "bad": "class.a##(", "none": r"class.a##x(y)##$1", "trim": "class.a##end", "html": "tag.p@html"}
    got = page_fields(pages, "k", "h", rules).first().asDict()
    assert got == {"k": 1, "plain": "Vol 12 end", "named": "", "bad": "Vol 12 end", "none": "Vol 12 end", "trim": "Vol 12", "html": "Vol 12 end"}
    assert page_rows(pages, "k", "h", "class.b@tag.a[", {"t": "&"}).count() == 0
    assert [r.t for r in page_rows(pages, "k", "h", "::what||class.a", {"t": "class.a"}).collect()] == ["Vol 12 end"]


def test_bracketed_hosts(spark):
    given = spark.createDataFrame([("http://[::1]/x",), ("http://u@[::1]:80/",), ("http://[2001:db8::1]/",), ("http://a.b:80/",)], "u string")
    assert [r.s for r in given.select(urls.is_safe(F.col("u")).alias("s")).collect()] == [False, False, True, True]


def test_chinese_order(spark):
    names = spark.createDataFrame([("中",), ("安",), ("陈",), ("北",), (None,)], "n string")
    assert [r.n for r in names.orderBy(F.collate("n", "zh")).collect()] == [None, "安", "北", "陈", "中"]


def test_server_dialect(spark):
    page = """<title> Site </title><meta name="d" content="About"><div class="bg" style="background: url('/c.jpg')"></div><ul><li data-u="x/1"><b>One</b><img data-original="//i/1"></li><li><b></b></li></ul>"""
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "id long, html string")
    source = {"id": "s", "host": "https://h.com/", "search": {"listSelector": "li", "titleSelector": "b", "detailUrlSelector": "&@data-u", "coverSelector": "img"}}
    source |= {"detail": {"coverSelector": ".bg", "descriptionSelector": "meta[name=d]"}, "chapters": {"listSelector": "li", "titleSelector": "b", "urlSelector": "b"}, "images": {"listSelector": "img", "srcAttribute": "src"}}
    assert [(r.title, r.detail_url, r.cover) for r in plain_rows(pages, "id", "html", source).collect()] == [("One", "https://h.com/x/1", "https://i/1")]
    one, *rest = detail_fields(pages, "id", "html", source).orderBy("id").collect()
    assert (one.title, one.cover, one.description, one.author) == ("Site", "https://h.com/c.jpg", "About", "")
    assert [(r.title, r.cover) for r in rest] == [("", ""), ("", "")]
    assert [tuple(r) for r in chapter_rows(pages, "id", "html", source).collect()] == [(1, 0, "One", "")]
    assert [tuple(r) for r in image_rows(pages, "id", "html", source).collect()] == [(1, 0, "https://i/1")]


def test_alias_and_json_rows(spark):
    pages = spark.createDataFrame([(1, "<p><i>T</i></p><p></p>"), (2, '{"a": [{"t": "J", "u": "/1"}, {"t": null}, 5, {"t": ""}]}'), (3, "{bad"), (4, None), (5, '{"a": {"t": 7}}')], "id long, html string")
    rows = alias_rows(pages, "id", "html", {"id": "s", "host": "h.com", "metadata": {"raw": {"list": "p", "title": "tag.i@text"}}}).collect()
    assert [(r.result_id, r.title, r.detail_url, r.author) for r in rows] == [("s:h.com", "T", "h.com", None)]
    assert alias_rows(pages, "id", "html", {"id": "s"}).count() == 0
    rule = {"id": "s", "host": "https://h.com", "search": {"item": "$.a", "title": "t", "url": "u"}}
    assert [(r.id, r.ord, r.title, r.detail_url, r.cover) for r in json_rows(pages, "id", "html", rule).orderBy("id").collect()] == [(2, 0, "J", "https://h.com/1", None), (5, 0, "7", "https://h.com", None)]
    assert response_rows(pages, "id", "html", rule | {"search": {"item": "p", "title": "tag.i@text"}}).count() == 1


def test_clusters_by_weight(spark):
    rows = spark.createDataFrame([(1, "abcdefgh", 1), (2, "abcdefgx", 5), (3, "zzzz", None), (4, "abcdefgx", 1)], "k int, n string, w int")
    got = similarity.answers(rows, "n", "w", "k", folder=_folder(spark)).collect()
    assert [(r.k, r.leader) for r in got] == [(2, "abcdefgx"), (1, "abcdefgx"), (4, "abcdefgx"), (3, "zzzz")]


def _folder(spark):
    from tessera.queries import folder

    return folder(spark)


def test_registry_readers(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"name": "r", "sourceCount": 2}')
    (tmp_path / "h.json").write_text('{"total": 1, "items": [{"id": "a", "ok": false, "reason": "network-unreachable"}]}')
    (tmp_path / "a.json").write_text("{broken")
    assert tables.read_manifest(spark, f"{tmp_path}/m.json").first().sourceCount == 2
    assert tables.read_health(spark, f"{tmp_path}/h.json").first().reason == "network-unreachable"
    for name in ("a.json", "none.json"):
        assert tuple(tables.read_ads(spark, f"{tmp_path}/{name}").first()) == (False, "", None)


def test_node_rows_are_dealt_out_by_their_number(spark, tmp_path, monkeypatch):
    from tessera.extract import nodes as N
    from tessera.extract.selectors import item_fields

    monkeypatch.setattr(N, "TASK_ROWS", 50)
    html = "<body><ul><li><a href='x'>a</a><ul><li><a>b</a></li></ul></li></ul>" + "<p>c</p>" * 10 + "</body>"
    N.page_nodes(spark.createDataFrame([(i, html) for i in range(40)], "id long, html string"), "id", "html").write.parquet(f"{tmp_path}/nodes")
    stored = spark.read.parquet(f"{tmp_path}/nodes")
    found = item_fields(stored, "ul > li", {"t": "tag.a.0@text", "all": "text"})
    assert N.parts_of(stored) == -(-stored.count() // 50) > 4
    assert f", {N.parts_of(stored)}" in "".join(x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in x)
    assert sorted((r["_key"], r["_ord"], r.t) for r in found.collect()) == [(i, k, "ab"[k]) for i in range(40) for k in range(2)]
