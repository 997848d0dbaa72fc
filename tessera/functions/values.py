"""Columns with the value rules of dynamically typed records: empty counts as missing, white space is Unicode's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space that record fields are trimmed of, as a character class.
SPACE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def present(c: Column) -> Column:
    """Null where a text is empty."""
    return F.nullif(c, F.lit(""))


def first_present(*cs: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[present(c) for c in cs])


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def encode_component(c: Column) -> Column:
    """Percent-encoding that keeps letters, digits and - _ . ! ~ * ' ( )."""
    out = F.url_encode(c)
    for have, want in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(have), F.lit(want))
    return out


def first_rule(default: str | None, *rules: tuple[Column, str]) -> Column:
    """The value of the first rule whose condition holds."""
    out = reduce(lambda acc, r: F.when(r[0], F.lit(r[1])) if acc is None else acc.when(r[0], F.lit(r[1])), rules, None)
    return out.otherwise(F.lit(default))


def contains_any(c: Column, *needles: str) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(n) for n in needles])


def rank_of(c: Column, order: list[str], other: int = 9) -> Column:
    """Place of a value in a given order; values not named come last."""
    return F.coalesce(F.element_at(F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))]), c), F.lit(other))
