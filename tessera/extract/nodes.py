"""Pages as rows of their elements, and CSS as columns over those rows.

A page is parsed once into node rows: number in document order, number of its last descendant, parent, tag, id, classes, attributes
and its own pieces of text and markup. Whether an element is inside another is a comparison of numbers, so a step of a selector
is a window in document order over the page, a pick is a running count, and a value is an aggregate over the pieces inside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
TEXT, MARKUP = 0, 1
#: Rows of one batch that leaves Python.
BATCH = 5000
#: Elements that are matched together when elements meet the items they are inside.
BLOCK = 256
#: Node rows of a task that sorts them, once there are enough for all cores.
TASK_ROWS = 250_000
FACTS = ["node", "last", "parent", "tag", "ident", "classes", "attrs", "pieces"]
NODE = "node int, last int, parent int, tag string, ident string, classes array<string>, attrs map<string, string>, pieces array<struct<at: int, kind: int, s: string>>"


class _Rows(HTMLParser):
    """The elements of a page, the page itself first with an empty tag."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows, self.open, self.at = [], [], 0
        self._start("", {})

    def _piece(self, row: dict, kind: int, s: str) -> None:
        row["pieces"].append((self.at, kind, s))
        self.at += 1

    def _start(self, tag: str, attrs: dict[str, str]) -> dict:
        row = {"node": len(self.rows), "last": 0, "parent": self.open[-1]["node"] if self.open else -1, "tag": tag, "ident": attrs.get("id"), "classes": attrs.get("class", "").split(), "attrs": attrs, "pieces": []}
        self.rows.append(row)
        self.open.append(row)
        return row

    def _end(self) -> None:
        row = self.open.pop()
        row["last"] = len(self.rows) - 1
        if row["tag"] and row["tag"] not in VOID:
            self._piece(row, MARKUP, f"</{row['tag']}>")

    def handle_starttag(self, tag, attrs):
        if self.open[-1]["tag"] in IMPLIED.get(tag, ()):
            self._end()
        known = {k: v or "" for k, v in attrs}
        row = self._start(tag, known)
        self._piece(row, MARKUP, f"<{tag}{''.join(f' {k}=\"{v}\"' for k, v in known.items())}>")
        if tag in VOID:
            self._end()

    def handle_endtag(self, tag):
        depth = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k]["tag"] == tag), 0)
        while depth and len(self.open) > depth:
            self._end()

    def handle_data(self, data):
        self._piece(self.open[-1], TEXT, data)

    def finish(self) -> list[dict]:
        self.close()
        while self.open:
            self._end()
        return self.rows


def page_nodes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Node rows of pages, with _key and a number _page for each row of pages. A null page is an empty one: it has the page's own row."""
    schema = pa.schema([
        ("node", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("ident", pa.string()), ("classes", pa.list_(pa.string())),
        ("attrs", pa.map_(pa.string(), pa.string())), ("pieces", pa.list_(pa.struct([("at", pa.int32()), ("kind", pa.int32()), ("s", pa.string())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, page in enumerate(batch.column("html").to_pylist()):
                parser = _Rows()
                parser.feed(page or "")
                rows = parser.finish()
                for a in range(0, len(rows), BATCH):
                    some = [r | {"attrs": list(r["attrs"].items()), "pieces": [dict(zip(("at", "kind", "s"), p, strict=True)) for p in r["pieces"]]} for r in rows[a : a + BATCH]]
                    columns = [pa.array([r[f.name] for r in some], f.type) for f in schema]
                    own = [batch.column(c).take(pa.array([i] * len(some))) for c in ("_key", "_page")]
                    yield pa.RecordBatch.from_arrays([*own, *columns], names=["_key", "_page", *FACTS])

    given = pages.select(F.col(key).alias("_key"), F.monotonically_increasing_id().alias("_page"), F.col(html).alias("html"))
    return given.mapInArrow(run, f"_key {pages.schema[key].dataType.simpleString()}, _page long, {NODE}")


def parts_of(nodes: DataFrame) -> int:
    """How many parts stored node rows are dealt out in, so that a task's share doesn't grow with the table."""
    n = nodes.count()
    return max(1, min(nodes.sparkSession.sparkContext.defaultParallelism, n // 10_000), -(-n // TASK_ROWS))


# --- the text of selectors --------------------------------------------------------------------------------------

_SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)|#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:([~^$*]?=)[\"']?([^\"'\]]*)[\"']?)?\]")


def _compound(text: str) -> tuple[tuple, ...]:
    parts, at = [], 0
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m:
            raise ValueError(f"selector not understood: {text}")
        parts.append(m.groups())
        at = m.end()
    return tuple(parts)


def css(selector: str) -> tuple[tuple[tuple[str, tuple], ...], ...]:
    """Alternatives, each a row of (combinator, compound)."""
    out = []
    for one in selector.split(","):
        steps, joint = [], " "
        for word in one.replace(">", " > ").split():
            if word == ">":
                joint = ">"
            else:
                steps.append((joint, _compound(word)))
                joint = " "
        if steps:
            out.append(tuple(steps))
    return tuple(out)


def step(text: str) -> tuple[tuple, int | None]:
    """A step of a chain: its alternatives and which of the matches it picks."""
    pick = None
    if m := re.search(r"\.(-?\d+)$", text):
        pick, text = int(m[1]), text[: m.start()]
    if text.startswith("class."):
        text = "." + ".".join(text[6:].split())
    elif text.startswith("tag."):
        text = text[4:]
    elif text.startswith("id."):
        text = "#" + text[3:]
    return css(text), pick


def chain(text: str) -> tuple[tuple, str] | None:
    """Steps and kind of value; None if it can't be read. @ starts a new step only before tag., class. or id.; else the value's name."""
    steps, value = [], "text"
    while True:
        m = re.search(r"@(?=tag\.|class\.|id\.)", text)
        first = text.find("@")
        if m and m.start() == first:
            steps.append(text[:first])
            text = text[first + 1 :]
            continue
        if first >= 0:
            text, value = text[:first], text[first + 1 :]
        steps.append(text)
        break
    try:
        return tuple(step(s) for s in steps if s and s != "&"), value
    except ValueError:
        return None


# --- selectors over node rows -----------------------------------------------------------------------------------


def _fits(parts: tuple[tuple, ...]) -> Column:
    """Whether an element fits tag, id, classes and attributes."""
    out = F.lit(True)
    for name, ident, cls, attr, op, value in parts:
        if name and name != "*":
            out &= F.col("tag") == name.lower()
        if ident:
            out &= F.coalesce(F.col("ident") == ident, F.lit(False))
        if cls:
            out &= F.array_contains("classes", cls)
        if attr:
            have = F.try_element_at("attrs", F.lit(attr))
            test = {None: have.isNotNull(), "=": have == value, "^=": have.startswith(value or ""), "$=": have.endswith(value or ""), "*=": have.contains(value or ""), "~=": F.array_contains(F.split(have, r"\s+"), value or "")}[op]
            out &= F.coalesce(test, F.lit(False))
    return out


class Matches:
    """Node rows with a flag column for each step that has been asked for. Rows are of one scope where its columns agree; the scope's
    root is the row with an empty tag, everything else lies inside it."""

    def __init__(self, rows: DataFrame, scope: list[str], parts: int) -> None:
        self.rows, self.scope, self.parts, self.known, self.root = rows.repartition(parts, *scope).withColumn("_root", F.col("tag") == ""), scope, parts, {}, "_root"
        self.order = Window.partitionBy(*scope).orderBy("node")
        self.every = Window.partitionBy(*scope)

    def _add(self, what: tuple, value: Column) -> str:
        name = self.known[what] = f"_f{len(self.known)}"
        self.rows = self.rows.withColumn(name, value)
        return name

    def inside(self, flag: str) -> Column:
        """Inside an element that has the flag: the farthest end of those that began before lies behind."""
        if flag == self.root:
            return ~F.col(self.root)
        before = self.order.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.max(F.when(F.col(flag), F.col("last"))).over(before) >= F.col("node"), F.lit(False))

    def _below(self, flag: str) -> Column:
        """A child of an element that has the flag; parents are looked up among the node rows."""
        have = self.rows.filter(F.col(flag)).select(*[F.col(c).alias(f"_p_{c}") for c in self.scope], F.col("node").alias("_p_node"))
        same = F.col("parent") == F.col("_p_node")
        for c in self.scope:
            same &= F.col(c) == F.col(f"_p_{c}")
        have = have.repartition(self.parts, *[f"_p_{c}" for c in self.scope], "_p_node")
        met = self.rows.repartition(self.parts, *self.scope, "parent").join(have, same, "left").withColumn("_child", F.col("_p_node").isNotNull())
        self.rows = met.drop("_p_node", *[f"_p_{c}" for c in self.scope]).repartition(self.parts, *self.scope)
        return F.col("_child")

    def select(self, inside: str, alternatives: tuple) -> str:
        """The flag of elements inside those flagged `inside` that one of the alternatives matches there."""
        if (inside, alternatives) in self.known:
            return self.known[inside, alternatives]
        found = F.lit(False)
        for steps in alternatives:
            flag = None
            for k, (joint, parts) in enumerate(steps):
                what = (inside, steps[: k + 1], "path")
                if what not in self.known:
                    if k == 0:
                        place = (F.col(inside) | self.inside(inside)) if len(steps) > 1 else self.inside(inside)
                    else:
                        place = self._below(flag) if joint == ">" else self.inside(flag)
                    self._add(what, _fits(parts) & place)
                    self.rows = self.rows.drop("_child")
                flag = self.known[what]
            found |= F.col(flag) & self.inside(inside)
        return self._add((inside, alternatives), found)

    def pick(self, flag: str, number: int) -> str:
        """Of the flagged elements of a scope the one with the number, from the end if it is negative."""
        if (flag, number) in self.known:
            return self.known[flag, number]
        one = F.when(F.col(flag), 1).otherwise(0)
        place = F.sum(one).over(self.order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        want = F.lit(number + 1) if number >= 0 else F.sum(one).over(self.every) + number + 1
        return self._add((flag, number), F.col(flag) & (place == want))

    def follow(self, steps: tuple) -> str:
        flag = self.root
        for alternatives, number in steps:
            flag = self.select(flag, alternatives)
            flag = flag if number is None else self.pick(flag, number)
        return flag

    def value(self, flag: str, kind: str) -> Column:
        """An aggregate over the scope: text, ownText, html or an attribute of the first flagged element; null without one."""
        on = F.col(flag)
        if kind not in ("text", "ownText", "html"):
            first = F.min(F.when(on, F.struct("node", F.coalesce(F.try_element_at("attrs", F.lit(kind)), F.lit("")).alias("v"))))
            return first["v"]
        if ("first", flag) not in self.known:
            self._add(("first", flag), F.min(F.when(on, F.struct("node", "last"))).over(self.every))
        first = F.col(self.known["first", flag])
        here = F.col("node") == first["node"]
        within = here if kind == "ownText" else (F.col("node") >= first["node"]) & (F.col("node") <= first["last"])
        wanted = F.filter("pieces", lambda p: (p["kind"] == TEXT) | (F.lit(kind == "html") & ~here))
        pieces = F.array_sort(F.flatten(F.collect_list(F.when(within, wanted))))
        return F.array_join(F.transform(pieces, lambda p: p["s"]), "")
