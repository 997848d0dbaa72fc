"""Main text of HTML pages by minimum-cut labelling of their blocks.

A classifier's log odds become the terminal capacities of every block: cut a likely content block from the source, or a
likely boilerplate block from the sink, and its odds are paid. Neighbours in the page, and blocks of one container, are tied
by smoothness edges, stronger the nearer they stand in the document. The minimum cut is the cheapest labelling of the page as
a whole; the text is what lies on the content side.

The classifier joins two parts: what the containers' names say (nav, aside, class="comments" ...), and a logistic regression
on the blocks' own numbers, trained on blocks of a bounded sample of the pages whose containers leave no doubt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import FEATURES, SURE, Block, blocks_of, features_of
from .min_cut import minimum_cut
from .tokens import text_runs

#: About so many pages, chosen by a hash of page_id, give the labelled blocks.
TRAIN_PAGES = 2000
#: Log odds of content used where a sample has no blocks of both kinds, in the order of features_of().
PLAIN = np.array([-1.0, 1.0, -2.0, -2.0, 0.8, 0.7, 0.3, -0.5])
NEXT, SAME, NEAR = 0.6, 1.0, 0.5


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums that stand for the labelled blocks: equal rows of rounded features are counted together."""
    for batch in batches:
        for a, b in text_runs(batch.column("html")):
            rows: dict[tuple, int] = {}
            for page in batch.column("html").slice(a, b - a).to_pylist():
                for block in blocks_of(page or ""):
                    if abs(block.mark) >= SURE:
                        key = (block.mark < 0, *(round(x, 1) for x in features_of(block)))
                        rows[key] = rows.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in rows], pa.bool_()), pa.array([list(k[1:]) for k in rows], pa.list_(pa.float64())), pa.array(list(rows.values()), pa.int64())], names=["content", "x", "n"]
            )


def train(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> np.ndarray:
    """Weights of the block classifier, from pages(page_id, html)."""
    n = max(1, pages.count())
    share = int(min(1.0, train_pages / n) * (1 << 20))
    chosen = pages.filter(F.pmod(F.xxhash64("page_id"), F.lit(1 << 20)) < share).select("html")
    # rounded features take a bounded number of values
    rows = chosen.mapInArrow(_samples, "content boolean, x array<double>, n long").groupBy("content", "x").agg(F.sum("n").alias("n")).collect()
    y = np.array([r["content"] for r in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return PLAIN
    x, w = np.array([r["x"] for r in rows]), np.array([r["n"] for r in rows], dtype=float)
    order = np.lexsort([*x.T, y])
    x, y, w = x[order], y[order], w[order]
    w = w * np.where(y > 0, 0.5 / w[y > 0].sum(), 0.5 / w[y == 0].sum())
    beta = PLAIN.copy()
    for _ in range(30):  # Newton steps, held near the plain weights
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (y - p)) - 0.01 * (beta - PLAIN)
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(FEATURES)
        beta = beta + np.linalg.solve(hess, grad)
    return beta


def label(blocks: list[Block], weights: np.ndarray) -> list[bool]:
    """Which blocks are content."""
    if not blocks:
        return []
    odds = np.clip(np.array([features_of(b) for b in blocks]) @ weights, -4, 4)
    # blocks in a row with one container and one kind of evidence are one node
    node, mark, container, size, depth = [], [], [], [], []
    for i, b in enumerate(blocks):
        if not (i and b.parent == container[-1] and abs(b.mark) >= SURE and b.mark == mark[-1]):
            mark.append(b.mark)
            container.append(b.parent)
            depth.append(b.depth)
            size.append(0.0)
        node.append(len(mark) - 1)
        size[-1] += float(odds[i])
    cost = [s - 1.5 * m if abs(m) < SURE else s * 0.2 - 3.0 * m for s, m in zip(size, mark, strict=True)]
    edges, last = [], {}
    for k in range(len(mark)):
        if k:
            far = abs(depth[k] - depth[k - 1]) + (container[k] != container[k - 1])
            edges.append((k - 1, k, SAME if not far else NEXT / far))
        if container[k] in last and last[container[k]] != k - 1:
            edges.append((last[container[k]], k, NEAR))
        last[container[k]] = k
    content = minimum_cut([max(0.0, c) for c in cost], [max(0.0, -c) for c in cost], edges)
    return [content[k] for k in node]


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            for a, b in text_runs(batch.column("html")):
                texts, kept = [], []
                for page in batch.column("html").slice(a, b - a).to_pylist():
                    blocks = blocks_of(page or "")
                    good = [x.text for x, ok in zip(blocks, label(blocks, weights), strict=True) if ok]
                    texts.append(" ".join(good))
                    kept.append(len(good))
                out = [batch.column(n).slice(a, b - a) for n in ("page_id", "url")]
                yield pa.RecordBatch.from_arrays(
                    [*out, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(kept, pa.int32())], names=["page_id", "url", "text", "n_chars", "n_blocks"]
                )

    return run


def main_text(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars and n_blocks for each row of pages(page_id, url, html), from the whole html.

    A null or empty html and a page without content blocks give an empty text; broken markup is read as far as it goes; repeated
    rows give equal rows; other columns are ignored and an empty table gives no rows.
    """
    pages = pages.select("page_id", "url", "html")
    shared = pages.sparkSession.sparkContext.broadcast(train(pages, train_pages))
    return pages.mapInArrow(_extract(shared), "page_id long, url string, text string, n_chars long, n_blocks int")
