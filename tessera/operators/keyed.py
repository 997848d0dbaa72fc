"""Keyed tables as DataFrames: latest rows, upserts, toggles, deletes, fall-backs. Nothing is collected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key; Spark keeps n rows a task before it shuffles."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def latest_per_key(df: DataFrame, keys: list[str], *newest: str) -> DataFrame:
    """One row a key by aggregation: partial results combine before the shuffle, so a key with most rows is no burden."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*newest)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def first_per_key(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def one_per_key(df: DataFrame, keys: list[str], least: bool) -> DataFrame:
    """One row a key: the least or the greatest by its other columns."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    best = (F.min if least else F.max)(F.struct(*rest)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and of each key that only new has one row: the least by its other columns. A null in a key is a value like others."""
    fresh = one_per_key(new, keys, True).alias("n")
    same = reduce(lambda a, b: a & b, [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys])
    return old.unionByName(fresh.join(old.select(*keys).alias("o"), same, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both sides; where both have a key, the new side's fields that aren't null win. Of several new rows with a key the
    greatest by its other columns counts."""
    rest = [c for c in old.columns if c not in keys]
    both = old.alias("o").join(one_per_key(new, keys, False).alias("n"), keys, "full")
    return both.select(*keys, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in rest])


def toggle(have: DataFrame, toggled: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are on exactly one side."""
    a, b = have.select(*keys).distinct().withColumn("_a", F.lit(True)), toggled.select(*keys).distinct().withColumn("_b", F.lit(True))
    return a.join(b, keys, "full").filter(F.col("_a").isNull() | F.col("_b").isNull()).select(*keys)


def conditional_update(df: DataFrame, where: Column, **new: Column) -> DataFrame:
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in new.items()})


def add_column(df: DataFrame, name: str, default: Column) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, default)


def delete_cascade(child: DataFrame, parents_left: DataFrame, key: list[str]) -> DataFrame:
    return child.join(parents_left.select(*key), key, "left_semi")


def first_non_empty(keys: list[str], *choices: DataFrame) -> DataFrame:
    """For each key the rows of the first relation that has any."""
    ranked = None
    for i, c in enumerate(choices):
        c = c.withColumn("_choice", F.lit(i))
        ranked = c if ranked is None else ranked.unionByName(c)
    best = ranked.groupBy(*keys).agg(F.min("_choice").alias("_choice"))
    return ranked.join(best, [*keys, "_choice"], "left_semi").drop("_choice")


def page(df: DataFrame, order: list[Column], limit: int | None = None, offset: int | None = None) -> DataFrame:
    """One page of a sorted log; a limit of 0 or none is 50."""
    return df.orderBy(*order).offset(offset or 0).limit(limit or 50)


def optional_filters(df: DataFrame, states: list[str] | None = None, languages: list[str] | None = None, text: str | None = None, fields: tuple[str, ...] = ()) -> DataFrame:
    """Rows in one of the states, in one of the languages or without one, and with the text in one of the fields (letters count
    alike); what is None filters nothing."""
    if states is not None:
        df = df.filter(F.col("state").isin(states))
    if languages is not None:
        df = df.filter(F.col("lang").isNull() | F.col("lang").isin(languages))
    if text is not None:
        df = df.filter(reduce(lambda a, b: a | b, [F.lower(f).contains(text.lower()) for f in fields], F.lit(False)))
    return df


def import_rows(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """upsert() in which the fields of `keep` (such as the time a row was made) stay the old side's where it has them."""
    rest = [c for c in old.columns if c not in keys]
    both = old.alias("o").join(one_per_key(new, keys, False).alias("n"), keys, "full")
    order = {c: ("o", "n") if c in keep else ("n", "o") for c in rest}
    return both.select(*keys, *[F.coalesce(F.col(f"{a}.{c}"), F.col(f"{b}.{c}")).alias(c) for c, (a, b) in order.items()])


def patch(df: DataFrame, where: Column, column: str, **fields: Column) -> DataFrame:
    """Some fields of a struct column set in the rows that `where` holds for; its other fields stay."""
    new = reduce(lambda c, kv: c.withField(*kv), fields.items(), F.col(column))
    return df.withColumn(column, F.when(where, new).otherwise(F.col(column)))


def candidates(risk: Column, active: Column, reachable: Column, checked: Column, ok: Column, medium_at_most: bool = True, failed_too: bool = False) -> Column:
    """Whether a search may ask a source: active, reachable and of low or medium risk (or just neither high nor blocked); failed_too
    asks those as well whose last check failed."""
    fine = risk.isin("low", "medium") if medium_at_most else ~risk.isin("high", "blocked")
    out = fine & active & reachable
    return F.coalesce(out if failed_too else out & ~(checked & ~ok), F.lit(False))
