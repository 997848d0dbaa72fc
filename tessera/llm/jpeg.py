"""Progressive JPEG: scans accumulate into coefficient arrays, numpy inverts the transform and upsamples chroma.

decode_coefficients() follows every kind of progressive scan (DC and AC, first and refining, interleaved or not, with restart
intervals). Runs that need no look at single symbols - equal-length codes, and the correction bits of an end-of-block
run - are read as whole arrays. encode_payload() stores bytes as coefficients of such a file, without loss.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np

#: Row and column of the k-th coefficient of a block: along the anti-diagonals, in turning direction.
ZIGZAG = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
_NATURAL = np.array([8 * r + c for r, c in ZIGZAG])
_COS = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])
#: zigzag coefficients (64) -> samples (64): the two-dimensional inverse transform as one matrix
_INVERSE = np.kron(_COS, _COS).T[_NATURAL].astype(np.float32)
BIAS = 256  # payload byte b is stored as coefficient b + 256: always positive and nine bits long
MOST_RUN = 32767


class BadImage(ValueError):
    """Not a progressive JPEG that this module can read."""


@dataclass
class Component:
    h: int
    v: int
    table: int
    rows: int = 0  # blocks that a scan of this component alone covers
    cols: int = 0
    coef: np.ndarray = field(default_factory=lambda: np.empty(0))


@dataclass
class Frame:
    height: int
    width: int
    components: dict[int, Component]
    mcu_rows: int
    mcu_cols: int
    quant: dict[int, np.ndarray]
    comments: list[bytes]


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        a = self.at >> 3
        word = int.from_bytes(self.data[a : a + 4].ljust(4, b"\xff"), "big")
        return word >> (32 - n - (self.at & 7)) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        if not n:
            return 0
        out = self.peek(n)
        self.at += n
        return out

    def array(self, n: int) -> np.ndarray:
        """The next n bits as an array."""
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        if last > len(self.data):
            raise BadImage("scan data end early")
        bits = np.unpackbits(np.frombuffer(self.data, dtype=np.uint8, count=last - first, offset=first))
        skip = self.at & 7
        self.at += n
        return bits[skip : skip + n]


class _Huffman:
    def __init__(self, counts: bytes, symbols: bytes) -> None:
        self.symbols, self.table = symbols, {}
        self.codes: list[tuple[int, int, int]] = []  # symbol, code, length
        code = k = 0
        for length in range(1, 17):
            for _ in range(counts[length - 1]):
                self.codes.append((symbols[k], code, length))
                code, k = code + 1, k + 1
            code <<= 1
        self.longest = max((n for _, _, n in self.codes), default=1)
        self.look: list[tuple[int, int]] = [(-1, 0)] * (1 << self.longest)
        for s, c, n in self.codes:
            rest = self.longest - n
            self.look[c << rest : (c + 1) << rest] = [(s, n)] * (1 << rest)

    def read(self, bits: _Bits) -> int:
        s, n = self.look[bits.peek(self.longest)]
        if s < 0 or bits.at > 8 * len(bits.data):
            raise BadImage("no such code")
        bits.at += n
        return s


def _extend(v: int, n: int) -> int:
    return v if not n or v >> (n - 1) else v - (1 << n) + 1


def _dc(seg: bytes, tables: list, views: list[np.ndarray], order: list[tuple[int, np.ndarray]], high: int, low: int) -> None:
    """order: for each block in scan order, which view (component) and which block of it."""
    which, blocks = order
    if high:
        bits = _Bits(seg).array(len(which)).astype(np.int32) << low
        for c, view in enumerate(views):
            of = which == c
            view[blocks[of], 0] |= bits[of]
        return
    bits, out, last = _Bits(seg), [0] * len(which), [0] * len(views)
    data, at, whole = seg + b"\xff\xff\xff\xff", 0, 8 * len(seg)
    look, longest = [t.look for t in tables], [t.longest for t in tables]
    for k, c in enumerate(which.tolist()):
        a = at >> 3
        word = (int.from_bytes(data[a : a + 5], "big") << (at & 7)) & 0xFFFFFFFFFF
        n, used = look[c][word >> (40 - longest[c])]
        if n < 0 or at > whole:
            raise BadImage("no such code")
        v = (word >> (40 - used - n)) & ((1 << n) - 1)
        at += used + n
        if n:
            last[c] += v if v >> (n - 1) else v - (1 << n) + 1
        out[k] = last[c]
    bits = np.array(out, dtype=np.int32) << low
    for c, view in enumerate(views):
        of = which == c
        view[blocks[of], 0] = bits[of]


def _ac_first(seg: bytes, table: _Huffman, blocks: np.ndarray, first: int, last: int, low: int) -> None:
    n_blocks, width = len(blocks), last - first + 1
    s, n = table.look[_Bits(seg).peek(table.longest)] if seg else (-1, 0)
    if 0 < s < 16 and n + s == 8 and len(seg) == n_blocks * width:  # perhaps every code has eight bits
        raw = np.frombuffer(seg, dtype=np.uint8)
        code = next(c for x, c, m in table.codes if x == s and m == n)
        if ((raw >> (8 - n)) == code).all():
            v = (raw & ((1 << s) - 1)).astype(np.int32)
            v = np.where(v >> (s - 1) == 0, v - (1 << s) + 1, v)
            blocks[:, first : last + 1] = (v << low).reshape(n_blocks, width)
            return
    bits, run = _Bits(seg), 0
    for b in range(n_blocks):
        if run:
            run -= 1
            continue
        k = first
        while k <= last:
            sym = table.read(bits)
            r, s = sym >> 4, sym & 15
            if s:
                k += r
                if k > last:
                    raise BadImage("run beyond the band")
                blocks[b, k] = _extend(bits.take(s), s) * (1 << low)
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) + bits.take(r) - 1
                break


def _ac_refine(seg: bytes, table: _Huffman, blocks: np.ndarray, first: int, last: int, low: int) -> None:
    bits, one, b, n_blocks = _Bits(seg), 1 << low, 0, len(blocks)

    def correct(view: np.ndarray) -> None:
        """One correction bit for each coefficient that is not zero."""
        flat = np.flatnonzero(view)
        add = bits.array(len(flat)).astype(np.int32) * one
        old = view.flat[flat]
        view.flat[flat] = old + np.where(old > 0, add, -add)

    while b < n_blocks:
        k = first
        while k <= last:
            sym = table.read(bits)
            r, s = sym >> 4, sym & 15
            if not s and r < 15:  # the rest of this block and the next ones hold no new coefficient
                run = (1 << r) + bits.take(r)
                if b + run > n_blocks:
                    raise BadImage("run beyond the scan")
                if k > first:
                    rest = blocks[b, k : last + 1]
                    correct(rest)
                    b, run = b + 1, run - 1
                if run:
                    band = np.ascontiguousarray(blocks[b : b + run, first : last + 1])
                    correct(band)
                    blocks[b : b + run, first : last + 1] = band
                b += run - 1
                break
            value = (one if bits.take(1) else -one) if s else 0
            while k <= last:
                old = int(blocks[b, k])
                if old:
                    if bits.take(1):
                        blocks[b, k] = old + (one if old > 0 else -one)
                elif r:
                    r -= 1
                else:
                    if value:
                        blocks[b, k] = value
                    k += 1
                    break
                k += 1
        b += 1


_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")
_ORDERS: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}


def _scan_order(frame: Frame, parts: list[Component]) -> tuple[np.ndarray, np.ndarray]:
    """For each block of an interleaved scan: the component's number in the scan and the block's number in it."""
    key = (frame.mcu_rows, frame.mcu_cols, *((c.h, c.v) for c in parts))
    if key not in _ORDERS:
        which, blocks = [], []
        for i, c in enumerate(parts):
            grid = np.arange(frame.mcu_rows * c.v * frame.mcu_cols * c.h).reshape(frame.mcu_rows, c.v, frame.mcu_cols, c.h)
            blocks.append(grid.transpose(0, 2, 1, 3).reshape(frame.mcu_rows * frame.mcu_cols, -1))
            which.append(np.full(blocks[-1].shape, i))
        if len(_ORDERS) > 500:
            _ORDERS.clear()
        _ORDERS[key] = np.concatenate(which, axis=1).ravel(), np.concatenate(blocks, axis=1).ravel()
    return _ORDERS[key]


def _scan(frame: Frame, parts: list, spec: tuple[int, int, int, int], data: bytes, restart: int) -> None:
    first, last, high, low = spec
    segments = [s.replace(b"\xff\x00", b"\xff") for s in (_RESTART.split(data) if restart else [data])]
    if len(parts) == 1:
        comp, dc, ac = parts[0]
        grid = comp.coef.reshape(frame.mcu_rows * comp.v, frame.mcu_cols * comp.h, 64)
        whole = grid.shape[:2] == (comp.rows, comp.cols)
        blocks = comp.coef if whole else np.ascontiguousarray(grid[: comp.rows, : comp.cols]).reshape(-1, 64)
        step = restart or len(blocks)
        for i, seg in enumerate(segments):
            view = blocks[i * step : (i + 1) * step]
            if first == 0:
                _dc(seg, [dc], [view], (np.zeros(len(view), dtype=np.int64), np.arange(len(view))), high, low)
            else:
                (_ac_refine if high else _ac_first)(seg, ac, view, first, last, low)
        if not whole:
            grid[: comp.rows, : comp.cols] = blocks.reshape(comp.rows, comp.cols, 64)
        return
    if first:
        raise BadImage("AC scan of several components")
    which, blocks = _scan_order(frame, [c for c, _, _ in parts])
    step = (restart or frame.mcu_rows * frame.mcu_cols) * sum(c.h * c.v for c, _, _ in parts)
    for i, seg in enumerate(segments):
        cut = slice(i * step, (i + 1) * step)
        _dc(seg, [dc for _, dc, _ in parts], [c.coef for c, _, _ in parts], (which[cut], blocks[cut]), high, low)


_TABLES: dict[bytes, dict[int, _Huffman]] = {}


def _huffman(body: bytes) -> dict[int, _Huffman]:
    if body not in _TABLES:
        if len(_TABLES) > 500:
            _TABLES.clear()
        found, at = {}, 0
        while at < len(body):
            n = sum(body[at + 1 : at + 17])
            found[body[at]] = _Huffman(body[at + 1 : at + 17], body[at + 17 : at + 17 + n])
            at += 17 + n
        _TABLES[body] = found
    return _TABLES[body]


def decode_coefficients(data: bytes) -> Frame:
    """All scans of a progressive JPEG, accumulated: for each component an array blocks x 64 in zigzag order."""
    if data[:2] != b"\xff\xd8":
        raise BadImage("no JPEG")
    frame, tables, quant, comments, restart, at = None, {}, {}, [], 0, 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise BadImage("marker expected")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            break
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xC4:
            tables |= _huffman(body)
        elif kind == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quant[body[k] & 15] = np.frombuffer(body, dtype=">u2" if wide else np.uint8, count=64, offset=k + 1).astype(np.int32)
                k += 129 if wide else 65
        elif kind == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif kind == 0xFE:
            comments.append(body)
        elif kind == 0xC2:
            precision, height, width, n = struct.unpack(">BHHB", body[:6])
            if precision != 8 or not height or not width or n not in (1, 3):
                raise BadImage("unsupported frame")
            comps = {body[6 + 3 * i]: Component(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
            hm, vm = max(c.h for c in comps.values()), max(c.v for c in comps.values())
            frame = Frame(height, width, comps, -(-height // (8 * vm)), -(-width // (8 * hm)), quant, comments)
            for c in comps.values():
                c.rows, c.cols = -(-(-(-height * c.v // vm)) // 8), -(-(-(-width * c.h // hm)) // 8)
                c.coef = np.zeros((frame.mcu_rows * c.v * frame.mcu_cols * c.h, 64), dtype=np.int32)
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise BadImage("not progressive")
        elif kind == 0xDA:
            if frame is None:
                raise BadImage("scan before frame")
            n = body[0]
            parts = [(frame.components[body[1 + 2 * i]], tables.get(body[2 + 2 * i] >> 4), tables.get(16 | body[2 + 2 * i] & 15)) for i in range(n)]
            end = m.start() if (m := _MARKER.search(data, at)) else len(data)
            _scan(frame, parts, (body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15), data[at:end], restart)
            at = end
    if frame is None:
        raise BadImage("no frame")
    return frame


def to_rgb(frame: Frame) -> np.ndarray:
    """Height x width x 3 samples: inverse transform, chroma repeated to full size, colour conversion."""
    planes, comps = [], list(frame.components.values())
    hm, vm = max(c.h for c in comps), max(c.v for c in comps)
    for c in comps:
        samples = (c.coef * frame.quant[c.table]).astype(np.float32) @ _INVERSE
        rows, cols = frame.mcu_rows * c.v, frame.mcu_cols * c.h
        plane = samples.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * cols)
        plane = np.clip(np.rint(plane + 128), 0, 255)
        planes.append(plane.repeat(vm // c.v, axis=0).repeat(hm // c.h, axis=1)[: frame.height, : frame.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


# --- payload bytes as coefficients ------------------------------------------------------------------------------


def _segment(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body


def _sos(ids: list[int], ac: int, first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(ids), *(x for i in ids for x in (i, ac)), first, last, high << 4 | low]))


def _pack(bits: np.ndarray) -> bytes:
    out = np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, dtype=np.uint8)])).tobytes()
    return out.replace(b"\xff", b"\xff\x00")


def _number_bits(v: int, n: int) -> list[int]:
    return [v >> (n - 1 - k) & 1 for k in range(n)]


def encode_payload(payload: bytes) -> bytes:
    """A progressive 4:2:0 JPEG whose coefficients are the payload's bytes; its length must be a multiple of 64.

    Scans: DC without its two low bits, luma AC in two bands and chroma AC likewise, then two refinements of everything.
    """
    raw = np.frombuffer(payload, dtype=np.uint8).reshape(-1, 64)
    mcus = -(-len(raw) // 6)
    cols = int(np.ceil(np.sqrt(mcus)))
    rows = -(-mcus // cols)
    m = rows * cols
    coef = np.full((6 * m, 64), BIAS, dtype=np.int32)
    coef[: len(raw)] += raw
    comps = [coef[: 4 * m], coef[4 * m : 5 * m], coef[5 * m :]]
    luma = np.arange(4 * m).reshape(rows, 2, cols, 2).transpose(0, 2, 1, 3).reshape(m, 4)
    order = np.concatenate([luma, np.arange(4 * m, 5 * m)[:, None], np.arange(5 * m, 6 * m)[:, None]], axis=1)
    dc = coef[order, 0]
    # DC differences, each component on its own: a code for the category (0 to 6: three bits, 7: four), then its bits
    diff = [np.diff(dc[:, :4].ravel() >> 2, prepend=0).reshape(m, 4), *(np.diff(dc[:, k] >> 2, prepend=0)[:, None] for k in (4, 5))]
    d = np.concatenate(diff, axis=1).ravel()
    size = np.ceil(np.log2(np.abs(d) + 1)).astype(np.int64)
    value = np.where(d < 0, d + (1 << size) - 1, d)
    used = np.where(size < 7, 3, 4)
    word = np.where(size < 7, size, 14) << (11 - used) | value << (11 - used - size)
    bits = (word[:, None] >> np.arange(10, -1, -1)) & 1
    dc_bits = bits[np.arange(11) < (used + size)[:, None]].astype(np.uint8)
    chunks = [[min(MOST_RUN, n - k) for k in range(0, n, MOST_RUN)] for n in (4 * m, m, m)]
    runs = sorted({n.bit_length() - 1 for c in chunks for n in c})
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _segment(0xDB, bytes([0]) + bytes([1] * 64))]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * rows, 16 * cols, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    tables = bytes([0x00, 0, 0, 7, 1, *[0] * 12, *range(8)]) + bytes([0x10, 1, *[0] * 15, 0x07]) + bytes([0x11, 0, len(runs), *[0] * 14, *(r << 4 for r in runs)])
    out += [_segment(0xC4, tables), _sos([1, 2, 3], 0, 0, 0, 0, 2), _pack(dc_bits)]
    for i, c in enumerate(comps):
        high = (c >> 2).astype(np.uint8)  # 64 to 127: code 0, then seven bits
        for first, last in ((1, 5), (6, 63)):
            out += [_sos([i + 1], 0, first, last, 0, 2), high[:, first : last + 1].tobytes()]
    for low in (1, 0):
        out += [_sos([1, 2, 3], 0, 0, 0, low + 1, low), _pack(((dc >> low) & 1).astype(np.uint8).ravel())]
        for i, c in enumerate(comps):
            out.append(_sos([i + 1], 1, 1, 63, low + 1, low))
            fine, parts, k = ((c[:, 1:] >> low) & 1).astype(np.uint8), [], 0
            for n in chunks[i]:
                r = n.bit_length() - 1
                parts += [np.array(_number_bits(runs.index(r), 2) + _number_bits(n - (1 << r), r), dtype=np.uint8), fine[k : k + n].ravel()]
                k += n
            out.append(_pack(np.concatenate(parts)))
    out.append(b"\xff\xd9")
    return b"".join(out)


def payload_of(frame: Frame) -> bytes:
    """The bytes that encode_payload() stored."""
    n = next(int(c[8:]) for c in frame.comments if c.startswith(b"payload "))
    coef = np.concatenate([c.coef for c in frame.components.values()])[: n // 64]
    return (coef - BIAS).astype(np.uint8).tobytes()
