"""Pixels of DCT-coded JPEG files, sequential and progressive, Huffman-coded, of 8 bits; 1, 3 or 4 components.

Entropy decoding is one pass over the bits; coefficients of all blocks are transformed at once. The transform is exact, so a
sample may differ by a count or two from decoders with an integer one. Chroma is interpolated where it is halved, else repeated.
"""

from __future__ import annotations

import re

import numpy as np

from .codecs import MAX_PIXELS, NO_CODES, Unreadable, _codes, _need, _wide

# Frame marks by kind, and marks that stand alone.
SEQUENTIAL, PROGRESSIVE, ALONE = (0xC0, 0xC1), 0xC2, {0x01, *range(0xD0, 0xD9)}


def _zigzag() -> list[int]:
    """Place in the block of each coefficient: along diagonals, in turns."""
    cells = [(y, x) for y in range(8) for x in range(8)]
    return [8 * y + x for y, x in sorted(cells, key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))]


ORDER = _zigzag()
BASIS = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


class _Part:
    """One component: its sampling, its blocks, padded to whole units, and where its prediction stands."""

    def __init__(self, number: int, across: int, down: int, table: int):
        self.number, self.across, self.down, self.table = number, across, down, table
        self.blocks = np.zeros(0, np.int32)
        self.cells = memoryview(self.blocks)
        self.stride = self.wide = self.high = self.width = self.height = self.last = 0
        self.dc: list = NO_CODES
        self.ac: list = NO_CODES


class _Scan:
    """Bits of one scan between restart marks."""

    def __init__(self, data: bytes):
        clean = data.replace(b"\xff\0", b"\xff")
        self.data, self.at, self.end, self.run = clean + bytes(16), 0, 8 * len(clean), 0

    def symbol(self, codes: list[tuple[int, int]]) -> int:
        byte = self.at >> 3
        length, value = codes[int.from_bytes(self.data[byte : byte + 3]) >> 8 - (self.at & 7) & 0xFFFF]
        self.at += length
        return value

    def take(self, n: int) -> int:
        byte = self.at >> 3
        v = int.from_bytes(self.data[byte : byte + 3]) >> 24 - (self.at & 7) - n & (1 << n) - 1
        self.at += n
        return v

    def signed(self, n: int) -> int:
        if not n:
            return 0
        v = self.take(n)
        return v if v >> n - 1 else v - (1 << n) + 1

    def block(self, p: _Part, b: memoryview, start: int, stop: int, high: int, low: int) -> None:
        """Adds to a block what a scan of coefficients start .. stop says; high and low are its bit positions, high is 0 for a first scan."""
        if self.at > self.end:
            raise Unreadable("JPEG data end early")
        if start == 0:
            if high:
                b[0] |= self.take(1) << low
            else:
                p.last += self.signed(self.symbol(p.dc))
                b[0] = p.last << low
            start = 1
        if stop == 0:
            return
        if high:
            self._refine(p, b, start, stop, 1 << low)
            return
        if self.run:
            self.run -= 1
            return
        k = start
        while k <= stop:
            skip, size = divmod(self.symbol(p.ac), 16)
            if size:
                k += skip
                _need(k <= stop, "bad JPEG block")
                b[ORDER[k]] = self.signed(size) << low
                k += 1
            elif skip == 15:
                k += 16
            else:
                self.run = (1 << skip) + self.take(skip) - 1
                return

    def _refine(self, p: _Part, b: memoryview, k: int, stop: int, one: int) -> None:
        def more(i: int) -> None:
            if self.take(1) and not abs(b[i]) & one:
                b[i] += one if b[i] > 0 else -one

        while k <= stop and not self.run:
            skip, size = divmod(self.symbol(p.ac), 16)
            new = 0
            if size:
                new = one if self.take(1) else -one
            elif skip < 15:
                self.run = (1 << skip) + self.take(skip)
                break
            while k <= stop:
                i = ORDER[k]
                k += 1
                if b[i]:
                    more(i)
                elif skip:
                    skip -= 1
                else:
                    b[i] = new
                    break
        if self.run:
            for j in range(k, stop + 1):
                if b[ORDER[j]]:
                    more(ORDER[j])
            self.run -= 1


def _read_scan(d: bytes, at: int, parts: list[_Part], units: tuple[int, int], every: int, *band: int) -> int:
    """Reads the scan at ``at`` into the blocks of its parts; gives the place of the mark after it."""
    stop = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(d, at)
    end = stop.start() if stop else len(d)
    pieces = iter(re.split(rb"\xff[\xd0-\xd7]", d[at:end]))
    if len(parts) == 1:
        p = parts[0]
        turns = [[(p, y * p.stride + x)] for y in range(p.high) for x in range(p.wide)]
    else:
        turns = [[(p, (my * p.down + y) * p.stride + mx * p.across + x) for p in parts for y in range(p.down) for x in range(p.across)] for my in range(units[1]) for mx in range(units[0])]
    scan = None
    for i, turn in enumerate(turns):
        if scan is None or every and i % every == 0:
            piece = next(pieces, None)
            _need(piece is not None, "JPEG data end early")
            scan = _Scan(piece)
            for p in parts:
                p.last = 0
        for p, k in turn:
            scan.block(p, p.cells[64 * k : 64 * k + 64], *band)
    return end


def _samples(p: _Part, table: np.ndarray) -> np.ndarray:
    """(rows, columns) of a component, 0 .. 255."""
    x = (p.blocks.reshape(-1, 64) * table).reshape(-1, 8, 8)
    x = np.clip(np.rint(BASIS.T @ x @ BASIS) + 128, 0, 255)
    rows = len(x) // p.stride
    return x.reshape(rows, p.stride, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, p.stride * 8)[: p.height, : p.width]


def _doubled(x: np.ndarray) -> np.ndarray:
    """Twice the columns: a quarter of the neighbour, three quarters of the nearer."""
    before, after = np.concatenate((x[:, :1], x[:, :-1]), axis=1), np.concatenate((x[:, 1:], x[:, -1:]), axis=1)
    return np.stack(((3 * x + before) / 4, (3 * x + after) / 4), axis=-1).reshape(len(x), -1)


def _stretched(x: np.ndarray, across: int, down: int, w: int, h: int) -> np.ndarray:
    x = _doubled(x) if across == 2 else np.repeat(x, across, axis=1)
    x = _doubled(x.T).T if down == 2 else np.repeat(x, down, axis=0)
    return x[:h, :w]


def decode_jpeg(d: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, pixels of 16 bits). Arithmetic coding, other sample sizes and hierarchies are an error; a file that ends early too."""
    _need(d[:2] == b"\xff\xd8", "no SOI")
    at, tables, codes, every, transform, seen = 2, {}, {}, 0, None, False
    parts: list[_Part] = []
    w = h = 0
    units = (0, 0)
    progressive = False
    while at + 4 <= len(d):
        if d[at] != 0xFF or d[at + 1] in (0xFF, 0):
            at += 1
            continue
        mark = d[at + 1]
        if mark == 0xD9:
            break
        if mark in ALONE:
            at += 2
            continue
        n = int.from_bytes(d[at + 2 : at + 4])
        body = d[at + 4 : at + 2 + n]
        at += 2 + n
        if mark == 0xDB:
            k = 0
            while k < len(body):
                wide = 1 + (body[k] >> 4)
                v = np.zeros(64)
                v[ORDER] = np.frombuffer(body, ">u2" if wide == 2 else "u1", 64, k + 1)
                tables[body[k] & 15] = v
                k += 1 + 64 * wide
        elif mark == 0xC4:
            k = 0
            while k + 17 <= len(body):
                counts = body[k + 1 : k + 17]
                _need(k + 17 + sum(counts) <= len(body), "bad Huffman table")
                codes[body[k]] = _codes(counts, body[k + 17 : k + 17 + sum(counts)])
                k += 17 + sum(counts)
        elif mark == 0xDD:
            every = int.from_bytes(body[:2])
        elif mark == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            transform = body[11]
        elif mark in (*SEQUENTIAL, PROGRESSIVE):
            _need(not parts and len(body) >= 6 and len(body) >= 6 + 3 * body[5], "bad frame")
            progressive, h, w = mark == PROGRESSIVE, int.from_bytes(body[1:3]), int.from_bytes(body[3:5])
            _need(body[0] == 8 and body[5] in (1, 3, 4) and 0 < w * h <= MAX_PIXELS, "unsupported JPEG layout")
            parts = [_Part(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            _need(all(0 < p.across <= 4 and 0 < p.down <= 4 for p in parts), "bad sampling")
            if len(parts) == 1:
                parts[0].across = parts[0].down = 1
            most, tall = max(p.across for p in parts), max(p.down for p in parts)
            _need(all(most % p.across == 0 and tall % p.down == 0 for p in parts), "unsupported sampling")
            units = -(-w // (8 * most)), -(-h // (8 * tall))
            for p in parts:
                p.width, p.height, p.stride = -(-w * p.across // most), -(-h * p.down // tall), units[0] * p.across
                p.wide, p.high = -(-p.width // 8), -(-p.height // 8)
                p.blocks = np.zeros(p.stride * units[1] * p.down * 64, np.int32)
                p.cells = memoryview(p.blocks)
        elif 0xC3 <= mark <= 0xCF and mark != 0xCC and mark != 0xC8:
            raise Unreadable("unsupported kind of JPEG")
        elif mark == 0xDA:
            _need(bool(parts) and bool(body) and len(body) >= 4 + 2 * body[0], "scan without a frame")
            named, chosen = {p.number: p for p in parts}, []
            for i in range(body[0]):
                number, which = body[1 + 2 * i], body[2 + 2 * i]
                _need(number in named, "scan of an unknown component")
                p = named[number]
                p.dc, p.ac = codes.get(which >> 4, NO_CODES), codes.get(16 | which & 15, NO_CODES)
                chosen.append(p)
            start, stop, bits = body[1 + 2 * body[0] :][:3]
            band = (start, stop, bits >> 4, bits & 15) if progressive else (0, 63, 0, 0)
            _need(start <= stop <= 63, "bad scan")
            at, seen = _read_scan(d, at, chosen, units, every, *band), True
    _need(seen, "no scan")
    _need(all(p.table in tables for p in parts), "no quantisation table")
    most, tall = max(p.across for p in parts), max(p.down for p in parts)
    planes = [_stretched(_samples(p, tables[p.table]), most // p.across, tall // p.down, w, h) for p in parts]
    if len(planes) == 1:
        return w, h, _wide(np.repeat(planes[0].ravel()[:, None], 3, axis=1))
    if transform in (1, 2) or transform is None and len(planes) == 3 and [p.number for p in parts] != list(b"RGB"):
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        planes[:3] = [np.clip(np.rint(v), 0, 255) for v in (y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)]
        planes[:3] = [255 - v for v in planes[:3]] if len(planes) == 4 else planes[:3]
    rgb = np.stack([np.rint(v).astype(np.int32).ravel() for v in planes], axis=1)
    if len(planes) == 4:
        folded = rgb[:, :3] * rgb[:, 3:] + 128  # inverted inks: whole numbers, rounded
        rgb = folded + (folded >> 8) >> 8
    return w, h, _wide(rgb)
