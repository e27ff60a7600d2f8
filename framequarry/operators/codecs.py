"""Pixels from and to files, by the standard library and numpy: PNG, GIF, TIFF, PPM, JPEG, lossless JPEG, DNG.

All decode to 16-bit RGB: 8 bits times 257, gray three times, alpha dropped. A file that cannot be
read gives a row with ``error``, and the job goes on.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .ifd import Reader

Decoded = tuple[int, int, np.ndarray]
MAX_PIXELS = 1 << 28


class Unreadable(ValueError):
    pass


def _need(ok: bool, why: str) -> None:
    if not ok:
        raise Unreadable(why)


def _rgb(samples: np.ndarray, channels: int) -> np.ndarray:
    """(pixels, channels) to (pixels, 3)."""
    s = samples.reshape(-1, channels)
    return np.repeat(s[:, :1], 3, axis=1) if channels < 3 else s[:, :3]


def _wide(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int32) * 257


def _unfilter(raw: bytes, rows: int, stride: int, back: int) -> np.ndarray:
    out = np.zeros((rows + 1, stride + back), dtype=np.uint8)
    lines = np.frombuffer(raw, dtype=np.uint8)[: rows * (stride + 1)].reshape(rows, stride + 1)
    for y in range(rows):
        kind, line, above, now = int(lines[y, 0]), lines[y, 1:], out[y], out[y + 1]
        if kind == 0:
            now[back:] = line
        elif kind == 2:
            now[back:] = line + above[back:]
        elif kind == 1:
            for c in range(back):
                now[back + c :: back] = np.cumsum(line[c::back], dtype=np.uint8)
        elif kind in (3, 4):
            n, a, v = now.tolist(), above.tolist(), line.tolist()
            for i in range(stride):
                left, up, corner = n[i], a[i + back], a[i]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((left, up, corner), key=lambda q: abs(p - q))
                n[i + back] = (v[i] + guess) & 255
            now[:] = n
        else:
            raise Unreadable("unknown filter")
    return out[1:, back:]


# PNG colour types and their channels; starts and steps of the seven interlace passes.
PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


@dataclass(frozen=True)
class Limits:
    """What a PNG file may need at most; None is no limit. Metadata are the bytes of its text, EXIF and profile chunks."""

    max_width: int | None = None
    max_height: int | None = None
    max_image_bytes: int | None = None
    max_metadata_bytes: int | None = None


def _within(n: int, limit: int | None, what: str) -> None:
    _need(limit is None or n <= limit, f"{what} above the limit")


def decode_png(d: bytes, limits: Limits = Limits()) -> Decoded:
    _need(d[:8] == b"\x89PNG\r\n\x1a\n", "no PNG signature")
    at, idat, palette, head, extra = 8, [], None, None, 0
    while at + 8 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, at)
        body = d[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body[:13])
        elif kind == b"PLTE":
            palette = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            idat.append(body)
        elif kind in (b"eXIf", b"iCCP", b"iTXt", b"tEXt", b"zTXt"):
            extra += len(body)
        elif kind == b"IEND":
            break
        at += 12 + n
    _need(head is not None, "no IHDR")
    w, h, bits, kind, _, _, interlaced = head
    _need(kind in PNG_CHANNELS and bits in (1, 2, 4, 8, 16) and 0 < w * h <= MAX_PIXELS, "unsupported PNG layout")
    channels = PNG_CHANNELS[kind]
    _within(w, limits.max_width, "width")
    _within(h, limits.max_height, "height")
    _within((w * channels * bits + 7) // 8 * h, limits.max_image_bytes, "image bytes")
    _within(extra, limits.max_metadata_bytes, "metadata bytes")
    room = (w * channels * 2 + 8) * (h + 8) * 2
    raw = zlib.decompressobj().decompress(b"".join(idat), room)
    out = np.zeros((h, w, channels), dtype=np.int32)
    for x0, y0, dx, dy in PASSES if interlaced else [(0, 0, 1, 1)]:
        pw, ph = -(-(w - x0) // dx), -(-(h - y0) // dy)
        if pw <= 0 or ph <= 0:
            continue
        stride, back = (pw * channels * bits + 7) // 8, max(1, channels * bits // 8)
        _need(len(raw) >= ph * (stride + 1), "PNG data end early")
        lines, raw = _unfilter(raw, ph, stride, back), raw[ph * (stride + 1) :]
        if bits == 16:
            v = lines.reshape(ph, -1, 2).astype(np.int32)
            v = v[:, :, 0] * 256 + v[:, :, 1]
        elif bits == 8:
            v = lines.astype(np.int32)
        else:
            shifts = np.arange(8 - bits, -1, -bits)
            v = ((lines[:, :, None] >> shifts) & ((1 << bits) - 1)).reshape(ph, -1)[:, : pw * channels].astype(np.int32)
        out[y0::dy, x0::dx] = v.reshape(ph, pw, channels)
    if kind == 3:
        _need(palette is not None and int(out.max(initial=0)) < len(palette), "indexed PNG without its palette")
        return w, h, _wide(palette[out[:, :, 0].ravel()])
    if bits < 16:
        out = out * (65535 // ((1 << bits) - 1))
    return w, h, _rgb(out, channels)


#: Deflate levels of the PNG encoder by name.
LEVELS = {"store": 0, "fast": 1, "default": 6, "best": 9}
FILTERS = ("none", "sub", "up", "average", "paeth")


def _filtered(lines: np.ndarray, back: int) -> np.ndarray:
    """(5, rows, bytes): the lines under each of FILTERS."""
    x = lines.astype(np.int16)
    left, up, corner = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    left[:, back:], up[1:], corner[1:, back:] = x[:, :-back], x[:-1], x[:-1, :-back]
    guess = left + up - corner
    da, db, dc = abs(guess - left), abs(guess - up), abs(guess - corner)
    paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
    return np.stack([x, x - left, x - up, x - (left + up) // 2, x - paeth]).astype(np.uint8)


def encode_png(w: int, h: int, rgb: np.ndarray, bits: int = 16, level: int | str = 6, filter: str = "none") -> bytes:
    """``filter`` is one of FILTERS for all lines, or ``min_sum_abs`` or ``brute_force``, which choose for each line. Pixels read back are the same for all."""
    _need(bits in (8, 16), "8 or 16 bits only")
    _need(filter in (*FILTERS, "min_sum_abs", "brute_force"), "unknown filter")
    lines = (rgb.reshape(h, w * 3) >> 8).astype(np.uint8) if bits == 8 else rgb.reshape(h, w * 3).astype(">u2").view(np.uint8)
    level = LEVELS[level] if isinstance(level, str) else level
    if filter == "none":
        pick, body = np.zeros(h, np.uint8), lines
    else:
        every = _filtered(lines, 3 * bits // 8)
        if filter == "min_sum_abs":
            pick = abs(every.view(np.int8).astype(np.int64)).sum(axis=2).argmin(axis=0)
        elif filter == "brute_force":
            pick = np.array([min(range(5), key=lambda k: len(zlib.compress(every[k, y].tobytes(), level))) for y in range(h)])
        else:
            pick = np.full(h, FILTERS.index(filter))
        body = every[pick, np.arange(h)]
    raw = np.concatenate((pick.astype(np.uint8)[:, None], body), axis=1).tobytes()
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")


def decode_ppm(d: bytes) -> Decoded:
    from .formats import ppm_words

    kind = d[:2]
    if kind == b"P7":
        end = d.find(b"ENDHDR\n")
        _need(end > 0, "no ENDHDR")
        fields = dict(line.split(None, 1) for line in d[3:end].split(b"\n") if line and not line.startswith(b"#") and b" " in line)
        w, h, channels, top = (int(fields[k]) for k in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"))
        at = end + 7
    else:
        words, at = ppm_words(d)
        _need(len(words) == 3 and words[0].isdigit() and words[1].isdigit() and d[at : at + 1].isspace(), "no PPM header")
        w, h, top, at = int(words[0]), int(words[1]), float(words[2]), at + 1
        channels = 1 if kind in (b"P5", b"Pf") else 3
    _need(0 < w * h <= MAX_PIXELS and 1 <= channels <= 4, "unsupported PPM layout")
    n = w * h * channels
    if kind in (b"PF", b"Pf"):
        v = np.frombuffer(d, "<f4" if top < 0 else ">f4", n, at).reshape(h, -1)[::-1]
        return w, h, _rgb((np.clip(v, np.float32(0), np.float32(1)) * np.float32(65535)).astype(np.int32), channels)
    v = np.frombuffer(d, ">u2" if top > 255 else np.uint8, n, at)
    return w, h, _rgb(v.astype(np.int32) if top > 255 else _wide(v), channels)


def encode_ppm(w: int, h: int, rgb: np.ndarray, bits: int = 16) -> bytes:
    body = rgb.astype(">u2") if bits == 16 else (rgb >> 8).astype(np.uint8)
    return b"P6\n%d %d\n%d\n" % (w, h, 65535 if bits == 16 else 255) + body.tobytes()


def _lzw(data: bytes, start: int, little: bool, early: int, limit: int) -> bytes:
    """Codes of growing width; little-endian as in GIF, or big-endian with early change as in TIFF."""
    clear, stop = 1 << start, (1 << start) + 1
    table = [bytes([i]) for i in range(clear)] + [b"", b""]
    out, width, last, acc, have, size = [], start + 1, b"", 0, 0, 0
    for byte in data:
        acc = acc | byte << have if little else acc << 8 | byte
        have += 8
        while have >= width:
            if little:
                code, acc = acc & (1 << width) - 1, acc >> width
            else:
                code, acc = acc >> have - width, acc & (1 << have - width) - 1
            have -= width
            if code == clear:
                table, width, last = table[: clear + 2], start + 1, b""
                continue
            if code == stop or size >= limit:
                return b"".join(out)
            if code < len(table):
                word = table[code]
            elif code == len(table) and last:
                word = last + last[:1]
            else:
                raise Unreadable("bad LZW code")
            if last and len(table) < 4096:
                table.append(last + word[:1])
            out.append(word)
            size += len(word)
            last = word
            if len(table) + early >= 1 << width and width < 12:
                width += 1
    return b"".join(out)


def decode_gif(d: bytes) -> Decoded:
    """The first frame, at its place on black."""
    _need(d[:6] in (b"GIF87a", b"GIF89a") and len(d) >= 13, "no GIF header")
    w, h, flags = struct.unpack_from("<HHB", d, 6)
    at, table = 13, None
    colours = lambda at, f: np.frombuffer(d, np.uint8, 3 << (f & 7) + 1, at).reshape(-1, 3)
    if flags & 0x80:
        table = colours(at, flags)
        at += 3 << (flags & 7) + 1
    while at < len(d) and d[at] == 0x21:
        at += 2
        while d[at]:
            at += d[at] + 1
        at += 1
    _need(at + 10 < len(d) and d[at] == 0x2C, "no frames in GIF")
    left, top, fw, fh, flags = struct.unpack_from("<HHHHB", d, at + 1)
    at += 10
    if flags & 0x80:
        table = colours(at, flags)
        at += 3 << (flags & 7) + 1
    _need(table is not None, "no colours in GIF")
    start, at, blocks = d[at], at + 1, []
    while at < len(d) and d[at]:
        blocks.append(d[at + 1 : at + 1 + d[at]])
        at += d[at] + 1
    got = np.frombuffer(_lzw(b"".join(blocks), start, True, 0, fw * fh), np.uint8)
    _need(len(got) >= fw * fh, "GIF frame ends early")
    frame = got[: fw * fh].reshape(fh, fw)
    if flags & 0x40:
        order = np.concatenate([np.arange(a, fh, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
        straight = np.empty_like(frame)
        straight[order] = frame
        frame = straight
    out = np.zeros((h, w, 3), np.int32)
    hh, ww = max(0, min(fh, h - top)), max(0, min(fw, w - left))
    out[top : top + hh, left : left + ww] = _wide(table[np.minimum(frame[:hh, :ww], len(table) - 1)])
    return w, h, out.reshape(-1, 3)


def unpack_runs(d: bytes, room: int) -> bytes:
    """PackBits: a head below 128 copies that many and one, above 128 repeats the next byte 257 less head times, 128 is nothing."""
    out, at = bytearray(), 0
    while at + 1 < len(d) and len(out) < room:
        n = d[at]
        if n < 128:
            out += d[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += d[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def _unpacked(s: bytes, how: int, room: int) -> bytes:
    s = s if how == 1 else _lzw(s, 8, False, 1, room) if how == 5 else unpack_runs(s, room) if how == 32773 else zlib.decompressobj().decompress(s, room)
    _need(len(s) >= room, "TIFF data end early")
    return s[:room]


def tiff_cells(t: dict[int, list], w: int, h: int, layers: int) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """(layer, x, y, width, height, offset, bytes) of each strip or tile. Tiles are whole, the last strip is as high as what is left."""
    tiled = 324 in t
    cw, ch = (t[322][0], t[323][0]) if tiled else (w, min(t[278][0] if t.get(278) else h, h))
    _need(cw > 0 and ch > 0, "TIFF cells of no size")
    across, down = -(-w // cw), -(-h // ch)
    cells = list(zip(t[324 if tiled else 273], t[325 if tiled else 279], strict=True))
    _need(len(cells) >= across * down * layers, "TIFF cells are missing")
    for k in range(across * down * layers):
        layer, (y, x) = k // (across * down), divmod(k % (across * down), across)
        yield layer, x * cw, y * ch, cw, ch if tiled else min(ch, h - y * ch), *cells[k]


def decode_tiff(d: bytes) -> Decoded:
    """Strips or tiles, plain, LZW, Deflate or PackBits, samples together or in planes, of 8, 16 or 32 bits or FLOAT; gray, RGB, CMYK, with or without alpha."""
    try:
        r = Reader(d)
        t = dict(r.directory(r.first)[0])
    except (ValueError, struct.error) as e:
        raise Unreadable(str(e)) from None
    one = lambda tag, default=None: t[tag][0] if t.get(tag) else default
    w, h, bits, kind = one(256), one(257), one(258, 1), one(262, 1)
    channels, how, predictor, sample, planar = one(277, 1), one(259, 1), one(317, 1), one(339, 1), one(284, 1)
    _need(bool(w and h) and bits in (8, 16, 32) and how in (1, 5, 8, 32773, 32946) and planar in (1, 2) and (273 in t or 324 in t), "unsupported TIFF layout")
    _need(w * h <= MAX_PIXELS, "TIFF too large")
    letter = {(8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (32, 3): "f4"}.get((bits, sample))
    _need(letter is not None, "unsupported TIFF sample type")
    layers, each = (channels, 1) if planar == 2 else (1, channels)
    v = np.zeros((h, w, channels), letter)
    for layer, x, y, cw, ch, at, n in tiff_cells(t, w, h, layers):
        cell = np.frombuffer(_unpacked(d[at : at + n], how, cw * ch * each * bits // 8), r.order + letter).reshape(ch, cw, each)
        if predictor == 2:
            cell = np.cumsum(cell, axis=1, dtype=letter)
        to = v[y : y + ch, x : x + cw, layer : layer + each]
        to[:] = cell[: to.shape[0], : to.shape[1]]
    if letter == "f4":
        v = (np.clip(v, np.float32(0), np.float32(1)) * np.float32(65535)).astype(np.int32)
    else:
        v = _wide(v) if bits == 8 else (v >> 16 if bits == 32 else v).astype(np.int32)
    if kind == 5 and channels == 4:
        unit = 1.0 - v.reshape(-1, 4) / 65535.0
        return w, h, (unit[:, :3] * unit[:, 3:] * 65535.0).astype(np.int32)
    return w, h, _rgb(v, channels)


# --- lossless JPEG -------------------------------------------------------------------------------


def _scan_bytes(data: bytes) -> bytes:
    """Bytes of a scan up to the end mark: stuffed zeros taken out, restart marks skipped."""
    stop = re.search(rb"\xff\xd9", data)
    data = data[: stop.start()] if stop else data
    return re.sub(rb"\xff(\x00|[\xd0-\xd7])", lambda m: b"\xff" if m[1] == b"\0" else b"", data)


def _codes(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """(length, symbol) of a canonical Huffman table by the next 16 bits; bits that begin no code are 16 long and mean 0."""
    out: list[tuple[int, int]] = []
    k = 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[k : k + n]:
            out += [(length, symbol)] * (1 << 16 - length)
        k += n
    return (out + [(16, 0)] * (65536 - len(out)))[:65536]


NO_CODES = [(16, 0)] * 65536


def _differences(scan: bytes, tables: list[list[tuple[int, int]]], n: int) -> np.ndarray:
    """n differences, coded by the tables in turn; after the end of the scan its bits are zero."""
    out, at, last, turns = [0] * n, 0, len(scan) - 5, len(tables)
    for i in range(n):
        byte, bit = at >> 3, at & 7
        word = int.from_bytes(scan[byte : byte + 5] if byte <= last else scan[byte : byte + 5].ljust(5, b"\0"))
        length, size = tables[i % turns][word >> 24 - bit & 0xFFFF]
        at += length + size
        if size:
            v = word >> 40 - bit - length - size & (1 << size) - 1
            out[i] = v if v >> size - 1 else v - (1 << size) + 1
    return np.array(out, np.int64)


def _from_left(diff: np.ndarray, first: int, top: int, below: int) -> np.ndarray:
    """Samples predicted by their left neighbours, a line's first by the one above. Sums over whole lines, unless a sample leaves 0 .. top: then step by step, with ``below`` for one under 0 and top for one above."""
    starts = first + np.cumsum(diff[:, 0])
    out = np.cumsum(np.concatenate((starts[:, None], diff[:, 1:]), axis=1), axis=1)
    if out.size and (out.min() < 0 or out.max() > top):
        now = first
        for y, line in enumerate(diff.tolist()):
            for x, v in enumerate(line):
                now = below if now + v < 0 else min(now + v, top)
                out[y, x] = now
            now = int(out[y, 0])
    return out


PREDICT: dict[int, Callable[[int, int, int], int]] = {
    0: lambda a, b, c: 0,
    1: lambda a, b, c: a,
    2: lambda a, b, c: b,
    3: lambda a, b, c: c,
    4: lambda a, b, c: a + b - c,
    5: lambda a, b, c: a + (b - c >> 1),
    6: lambda a, b, c: b + (a - c >> 1),
    7: lambda a, b, c: a + b >> 1,
}


def decode_ljpeg(d: bytes, width: int | None = None, height: int | None = None) -> tuple[int, int, np.ndarray]:
    """A mosaic from a lossless JPEG of one component, or of four as 2 x 2 cells with the left predictor only.

    Restart marks are skipped and do not reset the prediction. Two and three components are an error.
    """
    _need(d[:2] == b"\xff\xd8", "no SOI")
    at, tables, frame, components, scan = 2, {}, None, {}, None
    order: list[int] = []
    while at + 4 <= len(d):
        if d[at] != 0xFF:
            at += 1
            continue
        mark = d[at + 1]
        if mark == 0xD9:
            break
        n = int.from_bytes(d[at + 2 : at + 4])
        body = d[at + 4 : at + 2 + n]
        at += 2 + n
        if mark == 0xC3:
            _need(len(body) >= 6 and len(body) >= 6 + 3 * body[5], "short SOF3")
            frame = (body[0], int.from_bytes(body[1:3]), int.from_bytes(body[3:5]))
            order = [body[6 + 3 * i] for i in range(body[5])]
            components = dict.fromkeys(order, 0)
        elif mark == 0xC4:
            k = 0
            while k + 17 <= len(body):
                counts = body[k + 1 : k + 17]
                _need(body[k] & 15 < 4 and k + 17 + sum(counts) <= len(body), "bad Huffman table")
                if body[k] >> 4 == 0:
                    tables[body[k] & 15] = _codes(counts, body[k + 17 : k + 17 + sum(counts)])
                k += 17 + sum(counts)
        elif mark == 0xDA:
            _need(len(body) >= 1 and len(body) >= 4 + 2 * body[0], "short SOS")
            for i in range(body[0]):
                components[body[1 + 2 * i]] = body[2 + 2 * i] >> 4
            predictor, shift = body[1 + 2 * body[0]], body[3 + 2 * body[0]] & 15
            end = at
            while end + 1 < len(d) and not (d[end] == 0xFF and d[end + 1] != 0 and not 0xD0 <= d[end + 1] <= 0xD7):
                end += 1
            scan = d[at : end if end + 1 < len(d) else len(d)]
            break
    _need(frame is not None and scan is not None and len(order) in (1, 4), "no scan of one or four components")
    precision, h, w = frame
    w, h = width or w, height or h
    first, top, clean = 1 << max(0, precision - shift - 1), (1 << precision) - 1, _scan_bytes(scan)

    _need(0 < w * h <= MAX_PIXELS, "unsupported size")
    use = [tables.get(components[c], NO_CODES) for c in order]
    if len(order) == 4:
        cells = _differences(clean, use, h // 2 * (w // 2) * 4).reshape(h // 2, w // 2, 4)
        out = np.zeros((h, w), np.int64)
        for c in range(4):
            out[c // 2 : h // 2 * 2 : 2, c % 2 : w // 2 * 2 : 2] = _from_left(cells[..., c], first, top, 0)
        return w, h, (out << shift & 0xFFFF).astype(np.int32)
    diff = _differences(clean, use, w * h).reshape(h, w)
    predict = PREDICT.get(predictor, PREDICT[1])
    if predict is PREDICT[1]:
        out = _from_left(diff, first, top, top)
    else:
        lines: list[list[int]] = []
        for y, given in enumerate(diff.tolist()):
            above, now = lines[-1] if y else [], []
            for x, v in enumerate(given):
                guess = (now[x - 1] if x else first) if not y else above[0] if not x else predict(now[x - 1], above[x], above[x - 1])
                now.append(top if guess + v < 0 else min(guess + v, top))
            lines.append(now)
        out = np.array(lines, np.int64)
    return w, h, (out << shift & 0xFFFF).astype(np.int32)


# --- DNG -----------------------------------------------------------------------------------------


def encode_dng(w: int, h: int, rgb: np.ndarray, make: str = "", model: str = "", orientation: int = 1) -> bytes:
    """LinearRaw, three planes of 16 bits, one strip, identity matrix under D65 and a neutral white."""
    pixels = rgb.astype("<u2").tobytes()
    texts = [(271, (make or " ").encode() + b"\0"), (272, (model or " ").encode() + b"\0"), (50708, (model or "generic").encode() + b"\0")]
    fields: list[tuple[int, int, int, bytes]] = [(tag, 2, len(b), b) for tag, b in texts]
    short = lambda tag, *v: fields.append((tag, 3, len(v), struct.pack(f"<{len(v)}H", *v)))
    long = lambda tag, *v: fields.append((tag, 4, len(v), struct.pack(f"<{len(v)}I", *v)))
    long(254, 0), long(256, w), long(257, h), short(258, 16, 16, 16), short(259, 1), short(262, 34892), long(273, 0), short(274, orientation), short(277, 3)
    long(278, h), long(279, len(pixels)), short(284, 1), short(50717, 65535, 65535, 65535), short(50778, 21)
    fields.append((50706, 1, 4, bytes([1, 4, 0, 0])))
    fields.append((50721, 10, 9, struct.pack("<18i", *[x for i in range(9) for x in (int(i % 4 == 0), 1)])))
    fields.append((50728, 5, 3, struct.pack("<6I", 1, 1, 1, 1, 1, 1)))
    fields.sort()
    place = 8 + 2 + 12 * len(fields) + 4
    entries, rest = b"", b""
    size = sum(len(b) + len(b) % 2 for *_, b in fields if len(b) > 4)
    for tag, kind, n, b in fields:
        if tag == 273:
            b = struct.pack("<I", place + size)
        if len(b) > 4:
            entries += struct.pack("<HHII", tag, kind, n, place + len(rest))
            rest += b + b"\0" * (len(b) % 2)
        else:
            entries += struct.pack("<HHI", tag, kind, n) + b.ljust(4, b"\0")
    return b"II\x2a\0" + struct.pack("<IH", 8, len(fields)) + entries + struct.pack("<I", 0) + rest + pixels


def decode_linear_dng(d: bytes) -> Decoded:
    """Three planes of an uncompressed LinearRaw DNG."""
    try:
        r = Reader(d)
        t = dict(r.directory(r.first)[0])
    except (ValueError, struct.error) as e:
        raise Unreadable(str(e)) from None
    one = lambda tag, default=None: t[tag][0] if t.get(tag) else default
    _need(50706 in t and one(262) == 34892 and one(277) == 3 and one(258) == 16 and one(259) == 1, "not an uncompressed LinearRaw DNG")
    w, h = one(256), one(257)
    raw = b"".join(d[a : a + n] for a, n in zip(t[273], t[279], strict=True))
    _need(len(raw) >= w * h * 6, "DNG data end early")
    return w, h, np.frombuffer(raw, r.order + "u2", w * h * 3).astype(np.int32).reshape(-1, 3)


def unpack_be16(b: bytes) -> np.ndarray:
    """Big-endian samples; an odd byte at the end is left."""
    return np.frombuffer(b, ">u2", len(b) // 2).astype(np.int32)


# --- opcodes -------------------------------------------------------------------------------------

GAIN_HEAD = struct.Struct(">8I6I4dI")


def opcodes(d: bytes) -> list[dict]:
    """The big-endian opcode list; a list that ends early gives what was whole. 4, 5 and 9 are known by their fields."""
    out: list[dict] = []
    if len(d) < 4:
        return out
    at = 4
    for _ in range(int.from_bytes(d[:4])):
        if at + 16 > len(d):
            break
        kind, _, flags, n = struct.unpack_from(">4I", d, at)
        body = d[at + 16 : at + 16 + n]
        at += 16 + n
        if len(body) < n:
            break
        op: dict | None = {"id": kind, "optional": bool(flags & 1), "name": "unknown"}
        if kind == 4:
            op = op | {"name": "fix_bad_pixels_constant", "value": int.from_bytes(body[4:8])} if n >= 8 else None
        elif kind == 5:
            points, rects = struct.unpack_from(">2I", body) if n >= 8 else (0, 0)
            op = op | {"name": "fix_bad_pixels_list", "points": list(struct.iter_unpack(">2I", body[8 : 8 + 8 * points])), "rects": list(struct.iter_unpack(">4I", body[8 + 8 * points : 8 + 8 * points + 16 * rects]))} if n >= 8 + 8 * points + 16 * rects and n >= 8 else None
        elif kind == 9:
            op = op | _gain(body) if n >= GAIN_HEAD.size and len(body) >= GAIN_HEAD.size + 4 * _gains(body) else None
        if op:
            out.append(op)
    return out


def _gains(body: bytes) -> int:
    f = GAIN_HEAD.unpack_from(body)
    return f[12] * f[13] * f[18]


def _gain(body: bytes) -> dict:
    f = GAIN_HEAD.unpack_from(body)
    names = ["plane", "planes", "row_pitch", "col_pitch", "rows", "cols", "spacing_v", "spacing_h", "origin_v", "origin_h", "map_planes"]
    area = {k: f[2 * i] / f[2 * i + 1] if f[2 * i + 1] else (0.0, 0.0, 1.0, 1.0)[i] for i, k in enumerate(("top", "left", "bottom", "right"))}
    return {"name": "gain_map", **area, **dict(zip(names, f[8:], strict=True)), "gain": list(struct.unpack_from(f">{_gains(body)}f", body, GAIN_HEAD.size))}


def apply_gain(rgb: np.ndarray, op: dict) -> np.ndarray:
    """A gain map of an opcode list on a frame (rows, columns, 3), over the whole frame, clamped and cut."""
    rows, cols, layers = op["rows"], op["cols"], op["map_planes"]
    if not (rows and cols and layers and op["gain"]):
        return rgb
    table = np.array(op["gain"], np.float32).astype(np.float64).reshape(rows, cols, layers)

    def grid(n: int, start: float, step: float, points: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        relative = np.arange(n) / (n - 1) if n > 1 else np.full(n, 0.5)
        with np.errstate(divide="ignore", invalid="ignore"):
            g = np.nan_to_num(np.clip((relative - start) / step, 0.0, points - 1.0))
        low = np.floor(g).astype(np.int64)
        return low, np.minimum(low + 1, points - 1), g - low

    h, w, _ = rgb.shape
    (y0, y1, fy), (x0, x1, fx) = grid(h, op["origin_v"], op["spacing_v"], rows), grid(w, op["origin_h"], op["spacing_h"], cols)
    fy = fy[:, None]
    out = rgb.copy()
    for c in range(op["plane"], min(3, op["plane"] + op["planes"])):
        t = table[..., min(c - op["plane"], layers - 1)]
        gain = t[np.ix_(y0, x0)] * (1 - fy) * (1 - fx) + t[np.ix_(y0, x1)] * (1 - fy) * fx + t[np.ix_(y1, x0)] * fy * (1 - fx) + t[np.ix_(y1, x1)] * fy * fx
        out[..., c] = np.clip(rgb[..., c] * gain, 0, 65535).astype(rgb.dtype)
    return out


def apply_opcodes(rgb: np.ndarray, listed: bytes) -> np.ndarray:
    """The gain maps of an opcode list, in order; other opcodes leave linear RGB as it is."""
    for op in opcodes(listed):
        rgb = apply_gain(rgb, op) if op["name"] == "gain_map" else rgb
    return rgb


# --- over DataFrames -----------------------------------------------------------------------------

def _jpeg(d: bytes) -> Decoded:
    from .jpeg import decode_jpeg

    return decode_jpeg(d)


DECODERS: dict[str, Callable[[bytes], Decoded]] = {"PNG": decode_png, "PPM": decode_ppm, "GIF": decode_gif, "TIFF": decode_tiff, "JPEG": _jpeg}
UNAVAILABLE = {"AVIF": "no hardware decoder", "HEIC": "no hardware decoder", "WebP": "no codec", "JXL": "no codec", "SVG": "no rasteriser", "APV": "video"}


def _decode(batches: Iterator[pa.RecordBatch], limits: Limits) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):  # a row a batch: an image may be large
            part = batch.slice(k, 1)
            kind, content = part.column(1)[0].as_py(), part.column(2)[0].as_py()
            w = h = data = error = None
            if kind in DECODERS:
                try:
                    w, h, rgb = decode_png(content, limits) if kind == "PNG" else DECODERS[kind](content)
                    data = rgb.ravel().astype(np.int32)
                except (Unreadable, ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                    error = f"{kind}: {e}"
            else:
                error = UNAVAILABLE.get(kind, "unrecognized image format")
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([w], pa.int32()), pa.array([h], pa.int32()), pa.array([data], pa.list_(pa.int32())), pa.array([error], pa.string())], ["file_id", "format", "width", "height", "data", "error"])


def decode(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(file_id, content) to file_id, format, width, height, data (r, g, b in turn), error; one row each, no shuffle. ``limits`` hold for PNG files."""
    from .formats import sniff_standard

    ship(files.sparkSession)
    kind = dict(files.dtypes)["file_id"]
    return files.select("file_id", sniff_standard(F.col("content")).alias("format"), "content").mapInArrow(partial(_decode, limits=limits), f"file_id {kind}, format string, width int, height int, data array<int>, error string")


def _with_blocks(png: bytes, blocks: dict) -> bytes:
    from .embedded import build_exif, with_png_blocks

    notes = blocks.pop("notes", None)
    if notes:
        blocks["exif"] = build_exif(notes)
    return with_png_blocks(png, **blocks) if any(blocks.values()) else png


ENCODERS: dict[str, Callable[..., bytes]] = {
    "png": lambda w, h, x, bits, blocks, **more: _with_blocks(encode_png(w, h, x, bits, **more), blocks),
    "ppm": lambda w, h, x, bits, blocks: encode_ppm(w, h, x, bits),
    "dng": lambda w, h, x, bits, blocks: encode_dng(w, h, x),
}
BLOCKS = ("exif", "icc", "xmp", "notes")


def encoder(kind: str, bits: int, blocks: list[str], given: bool, options: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What ``encode`` does with batches of img_id, width, height, data, ``blocks`` and, if ``given``, error."""
    make = ENCODERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a file a batch: it may be large
                w, h = (batch.column(i)[k].as_py() for i in (1, 2))
                content, error = None, batch.column(batch.num_columns - 1)[k].as_py() if given else None
                try:
                    _need(error is None, error or "")
                    data = batch.column(3)[k].values
                    _need(data is not None and bool(w and h) and len(data) == w * h * 3, "samples do not fill the frame")
                    content = make(w, h, data.to_numpy(zero_copy_only=False).astype(np.int32), bits, {c: batch.column(4 + i)[k].as_py() for i, c in enumerate(blocks)}, **options)
                except Unreadable as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([content], pa.binary()), pa.array([error], pa.string())], ["img_id", "content", "error"])

    return run


def encode(frames: DataFrame, kind: str = "png", bits: int = 16, **options) -> DataFrame:
    """(img_id, width, height, data) to img_id, content, error. Only 8 and 16 bits can be written.

    PNG takes ``level`` and ``filter`` (see encode_png), and the bytes of the columns exif, icc and xmp where there are any; EXIF may also come from a struct ``notes`` of typed fields.
    A frame without samples, or of other size, gives an error row; one with an ``error`` keeps it.
    """
    ship(frames.sparkSession)
    blocks, given = [c for c in BLOCKS if c in frames.columns], "error" in frames.columns
    return frames.select("img_id", "width", "height", "data", *blocks, *["error"] * given).mapInArrow(encoder(kind, bits, blocks, given, options), f"img_id {dict(frames.dtypes)['img_id']}, content binary, error string")


def _wide_images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(origin, width, height, nChannels, data) of the image source: BGR turned to RGB, times 257; an image it could not read has negative sizes."""
    for batch in batches:
        for k in range(batch.num_rows):  # a row a batch: an image may be large
            origin, w, h, channels, content = (batch.column(i)[k] for i in range(5))
            w, h, channels = w.as_py(), h.as_py(), channels.as_py()
            data = error = None
            if (w or 0) > 0 and (h or 0) > 0 and channels in (1, 3, 4):
                px = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, channels)
                data = (px[:, [0, 0, 0] if channels == 1 else [2, 1, 0]].astype(np.int32) * 257).ravel()
            else:
                w = h = None
                error = "not an image that the image source can read"
            yield pa.RecordBatch.from_arrays([pa.array([origin.as_py()]), pa.array([w], pa.int32()), pa.array([h], pa.int32()), pa.array([data], pa.list_(pa.int32())), pa.array([error], pa.string())], ["file_id", "width", "height", "data", "error"])


def read_images(spark, path: str) -> DataFrame:
    """file_id (the file's place), width, height, data, error of JPEG and other 8-bit files, by Spark's image source; a file it cannot read has a row with ``error``."""
    ship(spark)
    i = spark.read.format("image").option("dropInvalid", False).load(path).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")
    return i.mapInArrow(_wide_images, "file_id string, width int, height int, data array<int>, error string")
