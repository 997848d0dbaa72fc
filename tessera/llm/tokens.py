"""Whole-text encoding with the tokenizers library, one call for each distinct piece.

A byte-pair tokenizer cuts a text into pieces by a fixed pattern and merges inside a piece only, so a text's ids are its
pieces' ids in order. Pieces are cut and hashed as whole arrays; each worker keeps the ids of pieces it has met under their
64-bit hash, and new pieces go through the library in batches.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import regex

from .common import Places, give_back, mix

#: Pieces a worker remembers; beyond that it keeps the half it used most (bounded memory; results don't depend on it).
REMEMBERED = 300_000
OTHER, LETTER, NUMBER, SPACE, END = range(5)
_ENCODERS: dict[str, PieceEncoder] = {}
_KINDS: list[np.ndarray] = []
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def kinds() -> np.ndarray:
    """The kind of every code point; the number after the last one ends a text."""
    if not _KINDS:
        out = np.zeros(0x110001, dtype=np.uint8)
        every = "".join(map(chr, range(0x110000)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                out[m.start() : m.end()] = kind
        out[0x110000] = END
        _KINDS.append(out)
    return _KINDS[0]


def cut(points: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of texts given as code points, an END after each.

    Pieces are runs of letters, of numbers and of other characters, and English contractions. spaced: a blank belongs to the run
    after it and other white space is a piece, as in byte-level tokenizers; else numbers stand alone and white space is dropped.
    """
    kind = kinds()[points]
    start = np.ones(len(points), dtype=bool)
    start[1:] = kind[1:] != kind[:-1]
    if spaced:
        after = np.flatnonzero((kind[1:] != SPACE) & (kind[1:] != END) & (kind[:-1] == SPACE)) + 1
        start[after - 1] = True
        start[after[points[after - 1] == 32]] = False
    else:
        start |= kind == NUMBER
    mark = np.flatnonzero(points == 39)
    if len(mark):
        mark = mark[start[mark]]
        mark = mark[kind[mark + 1] == LETTER]
        one = points[mark + 1]
        two = points[np.minimum(mark + 2, len(points) - 1)]
        is_one = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
        is_two = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        size = np.where(is_one, 2, np.where(is_two, 3, 0))
        mark, size = mark[size > 0], size[size > 0]
        start[mark + 1] = False
        rest = mark + size
        start[rest[kind[rest] == LETTER]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(points))
    first = kind[starts]
    keep = first != END
    if not spaced:
        keep &= first != SPACE
    return starts[keep], ends[keep]


class PieceEncoder:
    """ids(texts): all ids, one after the other, and the number for each text. Strings of special tokens are ordinary text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path) as f:
            spec = json.load(f)
        self.spaced = not any(p["type"] == "Split" for p in spec["pre_tokenizer"].get("pretokenizers", []))
        self.lower = bool(spec["normalizer"])
        self.places, self.n_ids, self.flat = Places(), 0, np.empty(1 << 16, dtype=np.uint32)
        self.first, self.count, self.used = (np.empty(0, dtype=np.int64) for _ in range(3))
        self.power = np.ones(64, dtype=_U)
        self.power[1:] = _STEP
        self.power = np.multiply.accumulate(self.power)

    def _points(self, text: str | None) -> np.ndarray:
        text = text or ""
        if self.lower:  # one character at a time, as the library does: no final sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return np.frombuffer((text + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)

    def _hashes(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        if len(size) and (longest := int(size.max())) > len(self.power):
            power = np.full(2 * longest, _STEP, dtype=_U)
            power[0] = 1
            self.power = np.multiply.accumulate(power)
        off = np.cumsum(size) - size
        at = np.arange(int(size.sum())) - np.repeat(off, size)
        inside = points if len(at) == len(points) else points[at + np.repeat(starts, size)]
        value = (inside.astype(_U) + _U(1)) * _U(0xD6E8FEB86659FD93)
        value ^= value >> _U(32)
        value *= self.power[at]
        return mix(np.add.reduceat(value, off) + size.astype(_U))

    def _forget(self) -> None:
        keep = np.sort(np.argsort(-self.used, kind="stable")[: REMEMBERED // 2])
        count, first = self.count[keep], self.first[keep]
        ends = np.cumsum(count)
        self.n_ids = int(ends[-1])
        self.flat = self.flat[np.repeat(first - (ends - count), count) + np.arange(self.n_ids)]
        self.first, self.count, self.used = ends - count, count, self.used[keep] // 2
        keys = self.places.keys()[keep]
        self.places = Places()
        self.places.add(keys)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        counts, flat = [], []
        for k in range(0, len(pieces), 5_000):
            for e in self.tokenizer.encode_batch(pieces[k : k + 5_000], add_special_tokens=False):
                ids = e.ids
                counts.append(len(ids))
                flat += ids
        more = np.array(counts, dtype=np.int64)
        first = self.n_ids + np.cumsum(more) - more
        if (need := self.n_ids + len(flat)) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.n_ids], np.empty(need // 2 + len(flat), dtype=np.uint32)])
        self.flat[self.n_ids : need] = flat
        self.n_ids = need
        self.places.add(hashes)
        self.first, self.count = np.concatenate([self.first, first]), np.concatenate([self.count, more])
        self.used = np.concatenate([self.used, np.zeros(len(more), dtype=np.int64)])

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)
        if len(self.places) > REMEMBERED:
            self._forget()
        parts = [self._points(t) for t in texts]
        points = np.concatenate(parts)
        last = np.cumsum([len(p) for p in parts])
        points[last - 1] = 0x110000
        starts, ends = cut(points, self.spaced)
        if not len(starts):
            return np.empty(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64)
        hashes = self._hashes(points, starts, ends)
        every = self.places.find(hashes)
        if len(new := np.flatnonzero(every < 0)):
            fresh, where = np.unique(hashes[new], return_index=True)
            where = new[where]
            raw = points.tobytes()
            pieces = [raw[4 * a : 4 * b].decode("utf-32-le", "surrogatepass") for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
            self._learn(fresh, pieces)
            every[new] = self.places.find(hashes[new])
        self.used += np.bincount(every, minlength=len(self.used))
        count = self.count[every]
        id_ends = np.cumsum(count)
        ids = self.flat[np.repeat(self.first[every] - (id_ends - count), count) + np.arange(int(id_ends[-1]))]
        total = np.concatenate([[0], id_ends])[np.searchsorted(starts, last)]
        return ids, np.diff(total, prepend=0)


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def text_runs(texts, most_bytes: int = 2_000_000):
    """(first, last) ranges of a column of texts that hold about so many bytes each; a longer text stands alone."""
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most_bytes:
            yield first, i
            first, held = i, 0
        held += int(n)
    if first < len(sizes):
        yield first, len(sizes)
    give_back()


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with end_id after each text's, and the counts with it."""
    return np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32), counts + 1
