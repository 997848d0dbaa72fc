"""A search of several sources in one plan."""

from pyspark.sql import functions as F

from tessera.plans.source_search import requests, search_sources

PAGE = '<ul><li class="c"><a href="/x/1">One</a><i>ch 3</i></li><li class="c"><a href="//cdn.com/2">Two</a></li><li class="c"><a href="/x/3"></a></li></ul>'
RULES = [
    {"id": "a", "host": "https://a.com/#note", "weight": 7, "search": {"path": "/s?q={{keyword}}", "item": "li.c", "title": "tag.a@text", "url": "tag.a@href", "latest": "tag.i@text"}},
    {"id": "b", "host": "https://b.com", "search": {"path": "/find", "item": "::bad||ul > li", "title": "a@text", "url": "a@href", "cover": "img@src"}},
    {"id": "c", "host": "https://c.com", "search": {"item": "li", "title": "a@text", "url": "a@href"}},
    {"id": "d", "host": "https://d.com", "search": {"path": "/{{keyword}}", "item": "li[", "title": "a@text", "url": "a@href"}},
]


def tables(spark):
    keywords = spark.createDataFrame([("one piece",), ("one piece",), ("x",)], "keyword string")
    pages = [("https://a.com/s?q=one%20piece", PAGE), ("https://b.com/find?keyword=one%20piece", PAGE), ("https://b.com/find?keyword=x", None), ("https://d.com/x", PAGE), ("https://else.com/", PAGE)]
    return keywords, spark.createDataFrame(pages, "url string, html string")


def test_requests_of_every_rule_with_a_path(spark):
    keywords, _ = tables(spark)
    got = {tuple(r) for r in requests(spark, keywords, RULES).collect()}
    assert ("one piece", "a", "https://a.com/s?q=one%20piece") in got and ("x", "b", "https://b.com/find?keyword=x") in got
    assert {r[1] for r in got} == {"a", "b", "d"}
    assert requests(spark, keywords, RULES[2:3]).count() == 0


def test_each_page_is_read_by_its_own_rule(spark):
    rows = search_sources(spark, *tables(spark), RULES).orderBy("source_id", "ord").collect()
    assert [(r.keyword, r.source_id, r.ord, r.title, r.detail_url, r.latest_chapter, r.weight) for r in rows] == [
        ("one piece", "a", 0, "One", "https://a.com/x/1", "ch 3", 7),
        ("one piece", "a", 1, "Two", "https://cdn.com/2", None, 7),
        ("one piece", "b", 0, "One", "https://b.com/x/1", None, 100),
        ("one piece", "b", 1, "Two", "https://cdn.com/2", None, 100),
    ]


def test_a_search_without_sources_or_pages(spark):
    keywords, pages = tables(spark)
    assert search_sources(spark, keywords, pages, []).count() == 0
    assert search_sources(spark, keywords, pages.limit(0), RULES).count() == 0
    assert search_sources(spark, keywords.select(F.lit(None).cast("string").alias("keyword")), pages, RULES).count() == 0
