"""Result rows from JSON answers by paths, and from answers that may be either JSON or HTML."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.extract.selectors import RESULT_FIELDS, search_rows
from tessera.functions.urls import clean_host, resolve

JSON_START = r"^\s*[\{\[]"


def value_at(body: Column, path: str) -> Column:
    """The text at a path of names and numbers joined by dots, with or without `$.` before it. A number is the place in an array, or
    a name in an object; anything else in a path (wildcards, descents) matches nothing."""
    parts = [p for p in [re.sub(r"^\$\.?", "", path)] if p]
    parts = parts[0].split(".") if parts else []
    if any("'" in p for p in parts):
        return F.lit(None).cast("string")
    forms = product(*[[f"['{p}']", f"[{int(p)}]"] if re.fullmatch(r"[0-9]+", p) else [f"['{p}']"] for p in parts])
    return F.coalesce(*[F.get_json_object(body, "$" + "".join(f)) for f in forms])


def _items(body: Column, rule: dict) -> Column:
    """The items that a rule's path finds in an answer; null for what is no JSON."""
    at = value_at(body, rule["search"]["item"])
    return F.when(body.rlike(JSON_START), F.when(at.startswith("["), F.from_json(at, "array<string>")).when(at.startswith("{"), F.array(at)))


def _field(item: Column, rule: dict, field: str) -> Column:
    path = rule["search"].get(field)
    return F.nullif(value_at(item, path), F.lit("")) if path else F.lit(None).cast("string")


def json_rows(answers: DataFrame, key: str, body: str, rule: dict) -> DataFrame:
    """Result rows, with the columns of search_rows(), of the items that a rule's paths find in JSON answers. Rows without a title go,
    links are made absolute and are the host where there is none; what is no JSON gives no rows."""
    host = clean_host(F.lit(rule["host"]))
    rows = answers.select(key, F.posexplode(_items(F.col(body), rule)).alias("ord", "item"))
    value = {f: _field(F.col("item"), rule, f) for f in RESULT_FIELDS}
    value["url"] = F.coalesce(F.nullif(resolve(value["url"], host), F.lit("")), host)
    value["cover"] = F.nullif(resolve(value["cover"], host), F.lit(""))
    columns = [value[f].alias(c) for f, c in RESULT_FIELDS.items()]
    return rows.select(key, F.col("ord").cast("long").alias("ord"), F.lit(rule["id"]).alias("source_id"), *columns, F.lit(100).alias("weight")).filter("title is not null")


def response_rows(answers: DataFrame, key: str, body: str, rule: dict) -> DataFrame:
    """Rows of answers read as JSON and, of those without any, read as HTML. Each answer tells for itself whether it has any."""
    any_item = F.coalesce(F.exists(_items(F.col(body), rule), lambda x: _field(x, rule, "title").isNotNull()), F.lit(False))
    return json_rows(answers, key, body, rule).unionByName(search_rows(answers.filter(~any_item), key, body, rule))
