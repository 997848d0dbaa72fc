"""Fields and rows of HTML pages by a small selector language, evaluated over node rows.

`tag.x`, `class.x y`, `id.x` or CSS (names, #id, .class, [attr], [attr=v], descendants, > and commas) as steps joined by @;
`&` is the element itself, `.N` picks a match, from the end if negative; `@name` at the end takes text, html, ownText or an attribute. `||` tries
alternatives, `&&` joins values, `##` deletes what its patterns match.

Pages are parsed once into node rows, which are written to the shared folder for the run; steps, picks, values and fall-backs are
filters, windows, joins and aggregates over them. What can't be read yields empty text, as the rule sets expect.
"""

from __future__ import annotations

import re

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.extract.nodes import BLOCK, FACTS, Matches, chain, page_nodes, parts_of, step
from tessera.functions.urls import clean_host, resolve, resolve_plain
from tessera.functions.values import trimmed
from tessera.operators.stored import Rounds


class Field:
    """A field's rule: `||` alternatives of `&&` joined chains, and `##` filters."""

    def __init__(self, text: str) -> None:
        head, *self.filters = text.split("##")
        self.choices = [[chain(part.strip()) for part in choice.split("&&")] for choice in head.split("||")]


def _pattern(spark: SparkSession, text: str) -> tuple[str, int] | None:
    """A filter's pattern, named groups in either spelling, and how many groups it has; None if it can't be read."""
    pattern = text.replace("(?P<", "(?<")
    try:
        return pattern, spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern).matcher("").groupCount()
    except IllegalArgumentException:
        return None


def _filtered(spark: SparkSession, value: Column, filters: list[str], doc_semantics: bool) -> Column:
    """A value after its `##` filters: each deletes what it matches, and `$N` takes a group of the pattern before it, if there is one in
    what is left. doc_semantics: a pattern and what to put in its place, or the group to take."""
    if not filters:
        return value
    if doc_semantics:
        known, new = _pattern(spark, filters[0]), filters[1] if len(filters) > 1 else ""
        if known is None:
            return value
        if re.fullmatch(r"\$\d+", new):
            return F.regexp_extract(value, known[0], int(new[1:])) if int(new[1:]) <= known[1] else F.lit("")
        return F.regexp_replace(value, known[0], re.sub(r"([\\$])", r"\\\1", new))
    last = None
    for f in filters:
        if re.fullmatch(r"\$\d+", f) and last is not None:
            if int(f[1:]) <= last[1]:
                value = F.coalesce(F.nullif(F.regexp_extract(value, last[0], int(f[1:])), F.lit("")), value)
        elif (known := _pattern(spark, f)) is not None:
            value, last = F.regexp_replace(value, known[0], ""), known
    return trimmed(value)


def _fields(nodes: DataFrame, scope: list[str], keep: list[str], rules: dict[str, str], parts: int, doc_semantics: bool = False) -> DataFrame:
    """A row for each scope of node rows, dealt out in so many parts: the columns `keep` and one for each rule."""
    spark, fields = nodes.sparkSession, {name: Field(text) for name, text in rules.items()}
    matches, wanted = Matches(nodes, scope, parts), {}
    for field in fields.values():
        for one in [c for choice in field.choices for c in choice if c is not None]:
            if one not in wanted:
                flag = matches.follow(one[0])
                wanted[one] = f"_v{len(wanted)}", matches.value(flag, one[1])
    gathered = matches.rows.groupBy(*keep, *[c for c in scope if c not in keep]).agg(F.count("*").alias("_n"), *[v.alias(n) for n, v in wanted.values()])

    def value(one) -> Column:
        if one is None:
            return F.lit("")
        out = F.coalesce(wanted[one][0], F.lit(""))
        return trimmed(out) if one[1] in ("text", "ownText") else out

    def chosen(field: Field) -> Column:
        tries = [F.concat(*[value(c) for c in choice]) for choice in field.choices]
        return F.coalesce(*[F.nullif(t, F.lit("")) for t in tries], F.lit(""))

    return gathered.select(*keep, *[_filtered(spark, chosen(f), f.filters, doc_semantics).alias(name) for name, f in fields.items()])


def _item_rows(nodes: DataFrame, item: str, parts: int) -> DataFrame:
    """Node rows of each item of a page, numbered by _ord, with a root above it. Of the alternatives the first with a match counts."""
    lists = []
    for x in item.split("||"):
        try:
            lists.append(step(x.strip())[0])
        except ValueError:
            continue
    matches = Matches(nodes, ["_page"], parts)
    flags = [matches.select(matches.root, alternatives) for alternatives in lists]
    for k, flag in enumerate(flags):
        matches.rows = matches.rows.withColumn(f"_any{k}", F.max(flag).over(matches.every))
    is_item = F.coalesce(*[F.when(F.col(f"_any{k}"), F.col(flag)) for k, flag in enumerate(flags)], F.lit(False))
    matches.rows = matches.rows.withColumn("_is", is_item)
    found = matches.rows.filter("_is").select("_page", F.col("node").alias("_item"), F.col("last").alias("_upto"))
    found = found.withColumn("_ord", F.row_number().over(matches.every.orderBy("_item")).cast("long") - 1)
    blocks = F.sequence(F.expr(f"_item div {BLOCK}"), F.expr(f"_upto div {BLOCK}"))
    # what lies in no item is left out before rows are dealt out again
    within = matches.rows.withColumn("_in", F.col("_is") | matches.inside("_is")).filter("_in").select("_key", "_page", *FACTS)
    within, found = within.withColumn("_block", F.expr(f"node div {BLOCK}")), found.withColumn("_block", F.explode(blocks))
    meet = found.repartition(parts, "_page", "_block").join(within.repartition(parts, "_page", "_block"), ["_page", "_block"])
    inside = meet.filter((F.col("node") >= F.col("_item")) & (F.col("node") <= F.col("_upto")))
    first = F.col("node") == F.col("_item")
    inside = inside.withColumn("parent", F.when(first, -1).otherwise(F.col("parent"))).select("_key", "_page", "_ord", *FACTS)
    root = {"node": F.lit(-1), "last": F.col("last"), "parent": F.lit(-2), "tag": F.lit("")}
    none = {c: F.lit(None).cast(nodes.schema[c].dataType) for c in FACTS if c not in root}
    roots = inside.filter("parent = -1").select("_key", "_page", "_ord", *[(root | none)[c].alias(c) for c in FACTS])
    return inside.unionByName(roots)


def page_fields(pages: DataFrame, key: str, html: str, rules: dict[str, str], doc_semantics: bool = False) -> DataFrame:
    """key and one text column for each rule, for every row of pages; a null page is an empty one."""
    rounds = Rounds(pages.sparkSession)
    nodes = rounds.keep(page_nodes(pages, key, html))
    out = rounds.keep(_fields(nodes, ["_page"], ["_key"], rules, parts_of(nodes), doc_semantics).withColumnRenamed("_key", key))
    rounds.drop(nodes)
    return out


def item_fields(nodes: DataFrame, item: str, rules: dict[str, str]) -> DataFrame:
    """_key, _ord and one text column for each rule, of every item on the pages of some stored node rows."""
    parts = parts_of(nodes)
    return _fields(_item_rows(nodes, item, parts), ["_page", "_ord"], ["_key", "_ord"], rules, parts)


def page_rows(pages: DataFrame, key: str, html: str, item: str, rules: dict[str, str]) -> DataFrame:
    """A row for each match of `item` on a page: key, its number and one text column for each rule, read inside the match. An item
    selector that can't be read matches nothing, a filter that can't be read changes nothing."""
    rounds = Rounds(pages.sparkSession)
    nodes = rounds.keep(page_nodes(pages, key, html))
    out = rounds.keep(item_fields(nodes, item, rules).withColumnsRenamed({"_key": key, "_ord": "ord"}))
    rounds.drop(nodes)
    return out


#: Fields of a rule's `search` part and the columns of a result row.
RESULT_FIELDS = {"title": "title", "url": "detail_url", "cover": "cover", "latest": "latest_chapter", "status": "status", "updateTime": "update_time"}


def rule_fields(rule: dict) -> dict[str, str]:
    """The selectors of a rule document's fields."""
    return {f: rule["search"].get(f) or "class.none" for f in RESULT_FIELDS}


def result_columns(rule: dict) -> list[Column]:
    """The columns of a result row from the rule's fields: links are made absolute, missing fields are null, a weight that isn't given
    is 100."""
    host, weight = clean_host(F.lit(rule["host"])), rule.get("weight")
    value = {f: F.nullif(f, F.lit("")) for f in RESULT_FIELDS} | {"url": resolve(F.col("url"), host), "cover": F.nullif(resolve(F.col("cover"), host), F.lit(""))}
    return [*[value[f].alias(c) for f, c in RESULT_FIELDS.items()], F.lit(100 if weight is None else weight).alias("weight")]


def search_rows(pages: DataFrame, key: str, html: str, rule: dict) -> DataFrame:
    """Result rows that a source's rule document finds on its pages; rows without a title go."""
    rows = page_rows(pages, key, html, rule["search"]["item"], rule_fields(rule)).withColumnsRenamed({key: "_key", "ord": "_ord"})
    return rows.filter("title <> ''").select(F.col("_key").alias(key), F.col("_ord").alias("ord"), F.lit(rule["id"]).alias("source_id"), *result_columns(rule))


# The names that a result field goes by in a source's search part or raw record, first match counts.
ALIASES = {
    "item": ["item", "list", "ruleSearchList"], "title": ["title", "ruleSearchName"], "url": ["url", "detailUrl", "ruleSearchNoteUrl"], "cover": ["cover", "ruleSearchCoverUrl"],
    "author": ["author", "ruleSearchAuthor"], "latest_chapter": ["latestChapter", "ruleSearchLastChapter", "latest"], "status": ["status"], "update_time": ["updateTime"],
}
NOTHING = "class.none"


def alias_selectors(source: dict) -> dict[str, str]:
    """The selectors of a source document by field; empty where it has none."""
    search, raw = source.get("search") or {}, (source.get("metadata") or {}).get("raw") or {}
    both = {f: [raw.get(n) if search.get(n) is None else search[n] for n in names] for f, names in ALIASES.items()}
    return {f: next((v.strip() for v in values if isinstance(v, str) and v.strip()), "") for f, values in both.items()}


def alias_rows(pages: DataFrame, key: str, html: str, source: dict) -> DataFrame:
    """The second form of search_rows(): selectors by alias names, an author, the host for rows without a link, and a result_id. Rows
    without a title go; a source without an item selector has no rows."""
    found = alias_selectors(source)
    item = found.pop("item")
    rows = page_rows(pages, key, html, item or NOTHING, {f: s or NOTHING for f, s in found.items()})
    host, name = clean_host(F.lit(source.get("host") or "")), source.get("id") or "unknown"
    detail = F.coalesce(F.nullif(resolve(F.col("url"), host), F.lit("")), host)
    texts = [F.nullif(f, F.lit("")).alias(f) for f in ("author", "latest_chapter", "status", "update_time")]
    number = F.concat(F.lit(f"{name}:"), F.coalesce(F.nullif(detail, F.lit("")), F.col("ord").cast("string")))
    cover = F.nullif(resolve(F.col("cover"), host), F.lit(""))
    return rows.filter("title <> ''").select(
        key, "ord", number.alias("result_id"), F.lit(name).alias("source_id"), F.lit(source.get("name") or name).alias("source_name"), "title", detail.alias("detail_url"), cover.alias("cover"), *texts, F.lit(100).alias("weight")
    )


def _own(selector: str | None) -> str:
    """The server's dialect: plain CSS inside an element, nothing or & for the element itself."""
    return "*.0" if not selector or selector == "&" else selector


def _link(selector: str | None) -> str:
    """selector@attribute, href where none is named."""
    css_part, _, attribute = (selector or "").partition("@")
    return f"{_own(css_part)}@{attribute or 'href'}" if css_part else NOTHING


def _styled(value: str, style: str) -> Column:
    """A value, or the url() of a style if it is empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.regexp_extract(style, r"url\(['\"]?([^'\")]+)['\"]?\)", 1))


def plain_rows(pages: DataFrame, key: str, html: str, source: dict) -> DataFrame:
    """Result rows by a source's plain CSS selectors: covers from src, data-src, data-original or a style; rows without a title go."""
    search = source["search"]
    cover = search.get("coverSelector") or NOTHING
    more = {"latest_chapter": "latestChapterSelector", "status": "statusSelector", "update_time": "updateTimeSelector"}
    rules = {"title": f"{_own(search.get('titleSelector'))}@text", "url": _link(search.get("detailUrlSelector"))}
    rules |= {"cover": f"{cover}@src||{cover}@data-src||{cover}@data-original", "style": f"{cover}@style"}
    rules |= {c: f"{search[s]}@text" if search.get(s) else NOTHING for c, s in more.items()}
    rows, host = page_rows(pages, key, html, search["listSelector"], rules), F.lit(source["host"])
    return rows.filter("title <> ''").select(
        key, "ord", F.lit(source["id"]).alias("source_id"), "title", resolve_plain(_styled("cover", "style"), host).alias("cover"), resolve_plain(F.col("url"), host).alias("detail_url"), *more
    )


def detail_fields(pages: DataFrame, key: str, html: str, source: dict) -> DataFrame:
    """One row a page: title (the page's own without a selector), cover and description (a meta element's content first), author,
    status and latest chapter; empty where nothing is found."""
    detail = source["detail"]
    cover, about = detail.get("coverSelector") or NOTHING, detail.get("descriptionSelector") or NOTHING
    rules = {"title": f"{detail.get('titleSelector') or 'title'}@text", "cover": f"{cover}@content||{cover}@src||{cover}@data-src", "style": f"{cover}@style"}
    rules |= {"description": f"{about}@content||{about}@text"}
    rules |= {c: f"{detail[s]}@text" if detail.get(s) else NOTHING for c, s in {"author": "authorSelector", "status": "statusSelector", "latest_chapter": "latestChapterSelector"}.items()}
    rows = page_fields(pages, key, html, rules)
    return rows.withColumn("cover", resolve_plain(_styled("cover", "style"), F.lit(source["host"]))).drop("style")


def chapter_rows(pages: DataFrame, key: str, html: str, source: dict) -> DataFrame:
    """(key, ord, title, url): the chapters that a page lists, those without a title left out."""
    part = source["chapters"]
    rows = page_rows(pages, key, html, part["listSelector"], {"title": f"{_own(part.get('titleSelector'))}@text", "url": _link(part.get("urlSelector"))})
    return rows.filter("title <> ''").select(key, "ord", "title", resolve_plain(F.col("url"), F.lit(source["host"])).alias("url"))


def image_rows(pages: DataFrame, key: str, html: str, source: dict) -> DataFrame:
    """(key, ord, url): the images that a page shows, by the named attribute or the usual ones of images loaded late."""
    part = source["images"]
    attributes = [a for a in (part.get("srcAttribute"), "data-src", "data-original") if a]
    rows = page_rows(pages, key, html, part["listSelector"], {"url": "||".join(f"*.0@{a}" for a in attributes)})
    return rows.filter("url <> ''").select(key, "ord", resolve_plain(F.col("url"), F.lit(source["host"])).alias("url"))
