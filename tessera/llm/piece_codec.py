"""SentencePiece byte-pair encoding and decoding by a table of last tokens.

Of every prefix of a text the encoding ends in one token, whatever follows. A token ends a prefix if and only if it may stand
behind the last token of the prefix before it, and that depends on the two tokens alone: whether merging them as one text
would leave the border between them. So the matches of the vocabulary's automaton at each place are tested against the table,
one of them passes, and the ids are read from the table backwards.

No token holds two neighbouring characters that aren't neighbours in some token: texts are cut there first, and a worker
remembers the ids of pieces that it has met.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import Places
from .tokens import REMEMBERED, PieceEncoder, text_runs

BLANK = 0x2581
#: Longer pieces are walked one by one, shorter ones of a batch side by side.
SIDE_BY_SIDE = 64
#: Tested pairs of tokens that a worker remembers; beyond that it starts anew (bounded memory, same results).
PAIRS = 2_000_000
NORMAL, BYTE = 1, 6
_CODECS: dict[str, PieceCodec] = {}


class Table:
    """A fixed or growing map from 64-bit keys to numbers, looked up for whole arrays; unknown keys give -1."""

    def __init__(self, keys: np.ndarray | None = None, values: np.ndarray | None = None) -> None:
        self.places, self.values = Places(), np.empty(0, dtype=np.int64)
        if keys is not None:
            self.add(keys, values)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.places.add(keys.astype(np.uint64))
        self.values = np.append(self.values, values)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self.places.find(keys.astype(np.uint64))
        return np.where(at >= 0, self.values[np.maximum(at, 0)] if len(self.values) else -1, -1)


def _blanks(n: int, runs: list[int]) -> list[int]:
    """How n blanks in a row are merged into runs of the given lengths: always the leftmost pair that can be."""
    out = [1] * n
    while (k := next((k for k in range(len(out) - 1) if out[k] + out[k + 1] in runs), None)) is not None:
        out[k : k + 2] = [out[k] + out[k + 1]]
    return out


def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class PieceCodec(PieceEncoder):
    """ids(texts): all ids, one after the other, and the number for each text; decoded(ids): the text."""

    def __init__(self, path: str) -> None:
        sp = _model(path)
        self.size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(self.size)]
        ordinary = [i for i in range(self.size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        bytes_ = [i for i in range(self.size) if sp.is_byte(i)]
        if sp.normalize(" ½  a ") != "▁▁½▁▁a▁" or len(bytes_) != 256:
            raise ValueError("only models without text normalisation and with byte fallback are read")
        self.first_byte = bytes_[0]
        self.out = [b""] * self.size
        for i in ordinary:
            self.out[i] = self.pieces[i].replace(chr(BLANK), " ").encode()
        for i in bytes_:
            self.out[i] = bytes([i - self.first_byte])
        self._automaton(ordinary, sp)
        self.places, self.n_ids, self.flat = Places(), 0, np.empty(1 << 16, dtype=np.uint32)
        self.first, self.count, self.used = (np.empty(0, dtype=np.int64) for _ in range(3))
        self.power = np.ones(64, dtype=np.uint64)
        self.power[1:] = np.uint64(0x9E3779B97F4A7C15)
        self.power = np.multiply.accumulate(self.power)
        self.pairs, self.tested = Table(), {}

    # --- what the vocabulary fixes --------------------------------------------------------------------------------

    def _automaton(self, ordinary: list[int], sp) -> None:
        """Trie of the tokens, characters that stand side by side in one, when tokens are merged, and what merges into what."""
        names = {self.pieces[i]: i for i in ordinary}
        chars = sorted({c for p in names for c in p})
        self.char = np.zeros(0x110001, dtype=np.int16)  # 0: no token has it
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        n = len(chars) + 1
        self.together = np.zeros(n * n, dtype=bool)
        steps, ends = {}, {}
        for p, i in names.items():
            state = 0
            codes = self.char[[ord(c) for c in p]].astype(np.int64)
            self.together[codes[:-1] * n + codes[1:]] = True
            for c in codes.tolist():
                state = steps.setdefault((state, c), len(steps) + 1)
            ends[state] = i
        self.n_chars = n
        self.steps = Table(np.array([s * n + c for s, c in steps]), np.array(list(steps.values())))
        self.step_of = steps
        self.end = np.full(len(steps) + 1, -1, dtype=np.int64)
        self.end[list(ends)] = list(ends.values())
        self.length = np.ones(self.size + 1, dtype=np.int64)
        self.length[ordinary] = [len(self.pieces[i]) for i in ordinary]
        # tokens of blanks alone share the last place in the order; the leftmost is merged first
        self.blanks = np.zeros(self.size + 1, dtype=np.int64)
        for p, i in names.items():
            if not p.strip(chr(BLANK)):
                self.blanks[i] = len(p)
        runs = sorted({1, *self.blanks.tolist()} - {0})
        self.side_by_side = {(a, b) for a in runs for b in runs if _blanks(a + b, runs) == [a, b]}
        self.never = self.size + 1
        by_score = sorted((i for i in ordinary if self.blanks[i] < 2), key=lambda i: (-sp.get_score(i), i))
        rank = {i: r for r, i in enumerate(by_score)}
        self.merged = {}
        for i in by_score:
            p = self.pieces[i]
            for k in range(1, len(p)):
                a, b = names.get(p[:k]), names.get(p[k:])
                if a is not None and b is not None:
                    self.merged[a, b] = rank[i], i
        # how each token grows: the symbols at its left and right border, each from one merge to the next
        self.left, self.right = ([[]] * (self.size + 1) for _ in range(2))
        keep = np.zeros(self.size + 1, dtype=bool)
        for i in ordinary:
            alone = self._grown([names[c] for c in self.pieces[i]], i)
            keep[i] = alone is not None
            if alone:
                self.left[i], self.right[i] = alone
        self.end[self.end >= 0] = np.where(keep[self.end[self.end >= 0]], self.end[self.end >= 0], -1)

    def _grown(self, symbols: list[int], token: int) -> tuple[list, list] | None:
        """Left and right borders of a token's own merging, as (symbol, from, to); None if it doesn't merge into itself."""
        if self.blanks[token]:
            return ([(symbols[0], -1, self.never)],) * 2
        left, right = [[symbols[0], -1, self.never]], [[symbols[-1], -1, self.never]]
        while len(symbols) > 1:
            found = [(self.merged[pair][0], k, self.merged[pair][1]) for k, pair in enumerate(zip(symbols, symbols[1:])) if pair in self.merged]
            if not found:
                return None
            rank, k, new = min(found)
            for at, side in ((0, left), (len(symbols) - 2, right)):
                if k == at:
                    side[-1][2] = rank
                    side.append([new, rank, self.never])
            symbols[k : k + 2] = [new]
        return (left, right) if symbols == [token] else None

    def _fit(self, a: int, b: int) -> bool:
        """Whether the border between tokens a and b outlasts merging them as one text: no symbol at the right border of a and at the
        left border of b, both there at the time, may merge. Of merges at the same time the left one comes first."""
        if self.blanks[a] and self.blanks[b]:
            return (self.blanks[a], self.blanks[b]) in self.side_by_side
        for x, x_from, x_to in self.right[a]:
            for y, y_from, y_to in self.left[b]:
                cross = self.merged.get((x, y))
                if cross and x_from < cross[0] < x_to and y_from < cross[0] <= y_to:
                    return False
        return True

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * (self.size + 1) + b
        known = self.pairs.find(keys)
        if len(new := np.flatnonzero(known < 0)):
            fresh = np.unique(keys[new])
            if len(self.pairs.values) + len(fresh) > PAIRS:
                self.pairs = Table()
                fresh = np.unique(keys)
            self.pairs.add(fresh, np.array([self._fit(*divmod(k, self.size + 1)) for k in fresh.tolist()], dtype=np.int64))
            known = self.pairs.find(keys)
        return known > 0

    # --- encoding -------------------------------------------------------------------------------------------------

    def _points(self, text: str | None) -> np.ndarray:
        text = ((" " + text) if text else "") + "\0"
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        return np.where(points == 32, np.uint32(BLANK), points)

    def _cut(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of pieces: cut wherever no token has the two characters side by side."""
        code = self.char[points].astype(np.int64)
        start = np.ones(len(points), dtype=bool)
        start[1:] = ~self.together[code[:-1] * self.n_chars + code[1:]]
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(points))
        keep = points[starts] != 0x110000
        return starts[keep], ends[keep]

    def _matches(self, code: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, token) of every match of the automaton; last: for each place where its piece ends."""
        at, state = np.arange(len(code)), np.zeros(len(code), dtype=np.int64)
        found = [(np.flatnonzero(code == 0), np.full(int((code == 0).sum()), self.size))]
        depth = 0
        while len(at):
            state = self.steps.find(state * self.n_chars + code[at + depth])
            at, state = at[state >= 0], state[state >= 0]
            token = self.end[state]
            found.append((at[token >= 0], token[token >= 0]))
            depth += 1
            go = at + depth < last[at]
            at, state = at[go], state[go]
        return tuple(np.concatenate(x) for x in zip(*found))

    def _last_tokens(self, points: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each character of the pieces, which lie one after the other, the last token of the piece's prefix that it ends."""
        stop = np.cumsum(size)
        base, last = np.repeat(stop - size, size), np.repeat(stop, size)
        place, token = self._matches(self.char[points].astype(np.int64), last)
        end = place + self.length[token]  # one behind
        table = np.full(len(points), -1, dtype=np.int64)
        start, depth = place - base[place], end - base[place]
        order = np.argsort(depth, kind="stable")
        place, token, end, start = place[order], token[order], end[order], start[order]
        bounds = np.searchsorted(depth[order], np.arange(1, int(size.max()) + 2))
        for k in range(int(size.max())):
            of = slice(bounds[k], bounds[k + 1])
            p, t, e = place[of], token[of], end[of]
            before = table[np.maximum(p - 1, 0)]
            ok = start[of] == 0
            test = np.flatnonzero(~ok & (before >= 0))
            ok[test] = self._fits(before[test], t[test])
            table[e[ok] - 1] = t[ok]
        return table

    def _last_tokens_of_one(self, points: np.ndarray) -> np.ndarray:
        """The same for one long piece, place by place."""
        code, table = self.char[points].tolist(), [-1] * len(points)
        for at in range(len(code)):
            before = table[at - 1] if at else self.size
            if code[at] == 0:
                table[at] = self.size
                continue
            state = 0
            for e in range(at, len(code)):
                state = self.step_of.get((state, code[e]), -1)
                if state < 0:
                    break
                token = int(self.end[state])
                if token >= 0 and table[e] < 0:
                    pair = before, token
                    if pair not in self.tested:
                        if len(self.tested) > PAIRS:
                            self.tested.clear()
                        self.tested[pair] = self._fit(*pair)
                    if self.tested[pair]:
                        table[e] = token
        return np.array(table)

    def _learn(self, hashes: np.ndarray, points: np.ndarray, size: np.ndarray) -> None:
        """Encode new pieces, which lie one after the other."""
        stop = np.cumsum(size)
        table = np.empty(len(points), dtype=np.int64)
        long = size > SIDE_BY_SIDE
        short = np.repeat(~long, size)
        if (~long).any():
            table[short] = self._last_tokens(points[short], size[~long])
        for i in np.flatnonzero(long).tolist():
            table[stop[i] - size[i] : stop[i]] = self._last_tokens_of_one(points[stop[i] - size[i] : stop[i]])
        # from the end of each piece back to its start
        at, low, ends = stop - 1, stop - size, []
        while len(at):
            ends.append(at)
            at = at - self.length[table[at]]
            at, low = at[at >= low], low[at >= low]
        ends = np.sort(np.concatenate(ends))
        token = table[ends]
        ids, many = token.copy(), np.ones(len(ends), dtype=np.int64)
        if len(odd := np.flatnonzero(token == self.size)):  # characters without a token: their bytes
            raw = [chr(p).encode("utf-8", "surrogatepass") for p in points[ends[odd]].tolist()]
            many[odd] = [len(b) for b in raw]
            ids = np.repeat(token, many)
            ids[np.repeat(token == self.size, many)] = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64) + self.first_byte
        total = np.concatenate([[0], np.cumsum(many)])
        upto = total[np.searchsorted(ends, stop - 1, side="right")]
        more = np.diff(upto, prepend=0)
        if (need := self.n_ids + len(ids)) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.n_ids], np.empty(need // 2 + len(ids), dtype=np.uint32)])
        self.flat[self.n_ids : need] = ids
        self.places.add(hashes)
        self.first, self.count = np.concatenate([self.first, self.n_ids + upto - more]), np.concatenate([self.count, more])
        self.used = np.concatenate([self.used, np.zeros(len(more), dtype=np.int64)])
        self.n_ids = need

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.places) > REMEMBERED:
            self._forget()
        parts = [self._points(t) for t in texts]
        if not parts:
            return np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)
        points = np.concatenate(parts)
        last = np.cumsum([len(p) for p in parts])
        points[last - 1] = 0x110000
        starts, ends = self._cut(points)
        if not len(starts):
            return np.empty(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64)
        hashes = self._hashes(points, starts, ends)
        every = self.places.find(hashes)
        if len(new := np.flatnonzero(every < 0)):
            fresh, where = np.unique(hashes[new], return_index=True)
            where = new[where]
            size = ends[where] - starts[where]
            at = np.repeat(starts[where] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            self._learn(fresh, points[at], size)
            every[new] = self.places.find(hashes[new])
        self.used += np.bincount(every, minlength=len(self.used))
        count = self.count[every]
        id_ends = np.cumsum(count)
        ids = self.flat[np.repeat(self.first[every] - (id_ends - count), count) + np.arange(int(id_ends[-1]))]
        total = np.concatenate([[0], id_ends])[np.searchsorted(starts, last)]
        return ids, np.diff(total, prepend=0)

    # --- decoding -------------------------------------------------------------------------------------------------

    def decoded(self, ids: list[int]) -> str:
        """The text of the ids: a leading blank belongs to the encoding, bytes that are no UTF-8 become U+FFFD each."""
        raw = b"".join(map(self.out.__getitem__, ids))
        if ids and raw[:1] == b" " and not self.first_byte <= ids[0] < self.first_byte + 256:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return raw.decode(errors="tessera.each_byte")


def _each_byte(e: UnicodeError):
    return "�", e.start + 1


def codec(path: str) -> PieceCodec:
    import codecs

    codecs.register_error("tessera.each_byte", _each_byte)
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode(text: Column, path: str) -> Column:
    """The ids (array<int>) of a column of texts; null and empty texts have none."""

    @arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        known, parts, sizes = codec(path), [], [np.zeros(1, dtype=np.int64)]
        for first, end in text_runs(texts):
            found, counts = known.ids(texts.slice(first, end - first).to_pylist())
            parts.append(found.astype(np.int32))
            sizes.append(counts)
        bounds = np.cumsum(np.concatenate(sizes)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)))

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """The text of a column of ids (array<int>); null or empty ids give an empty text."""

    @arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        known = codec(path)
        return pa.array([known.decoded(x.values.to_pylist() if x.is_valid else []) for x in lists], pa.string())

    return text(ids)


def roundtrip(docs: DataFrame, path: str) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256, from its ids and from the text that they give
    back. A null text is empty; repeated rows and rows without a doc_id are encoded like others; no rows, no result."""
    known = docs.select("doc_id", encode(F.coalesce("text", F.lit("")), path).alias("ids"))
    text = known.withColumn("text", decode(F.col("ids"), path))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return text.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
