"""Boxes of the ISO base media format, and what CR3, HEIC and AVIF files say in them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

# The maker's UUID of its metadata box; auxiliary types that mean depth.
CANON = bytes.fromhex("85c0b687820f11e08111f4ce462b6a48")
DEPTH_TYPES = ("urn:mpeg:hevc:2015:auxid:2", "urn:mpeg:mpegB:cicp:systems:auxiliary:depth")


def boxes(d: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, start and end of the content) of the boxes in a range. A size of 1 is followed by a long one, 0 reaches to the end."""
    end = len(d) if end is None else min(end, len(d))
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", d, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                return
            (size,), head = struct.unpack_from(">Q", d, at + 8), 16
        elif size == 0:
            size = end - at
        if size < head:
            raise ValueError("box smaller than its head")
        yield kind, at + head, min(at + size, end)
        at += size


def find(d: bytes, path: list[bytes], at: int = 0, end: int | None = None) -> tuple[int, int] | None:
    """The content of the first box of a path of types."""
    for kind, a, b in boxes(d, at, end):
        if kind == path[0]:
            return (a, b) if len(path) == 1 else find(d, path[1:], a, b)
    return None


def number(d: bytes, at: int, size: int) -> int:
    return int.from_bytes(d[at : at + size])


def track(d: bytes, at: int, end: int) -> tuple[int, int, int, int]:
    """(offset, bytes, width, height) of a track's first chunk; zeros for what is not there."""
    stbl = find(d, [b"mdia", b"minf", b"stbl"], at, end)
    if stbl is None:
        return 0, 0, 0, 0
    got = {k: (a, b) for k, a, b in reversed(list(boxes(d, *stbl)))}
    w = h = offset = size = 0
    if b"stsd" in got:
        a, b = got[b"stsd"]
        if b - a >= 44 and number(d, a + 4, 4) and number(d, a + 8, 4) >= 28:
            w, h = number(d, a + 40, 2), number(d, a + 42, 2)
            w, h = (w, h) if w and h else (0, 0)
    for kind, width in ((b"co64", 8), (b"stco", 4)):
        if kind in got:
            a, b = got[kind]
            offset = number(d, a + 8, width) if b - a >= 8 + width and number(d, a + 4, 4) else 0
            break
    else:
        return 0, 0, w, h
    if b"stsz" in got:
        a, b = got[b"stsz"]
        if b - a >= 12:
            each, n = number(d, a + 4, 4), number(d, a + 8, 4)
            size = each * n if each else sum(number(d, a + 12 + 4 * i, 4) for i in range(min(n, (b - a - 12) // 4)))
    return offset, size, w, h


def classify_aux(urn: str | None) -> str:
    """GainMap, DepthMap or Auxiliary, from the type of an auxiliary image."""
    if urn in DEPTH_TYPES:
        return "DepthMap"
    s = (urn or "").lower()
    if "gainmap" in s or "hdrgain" in s:
        return "GainMap"
    return "DepthMap" if "depth" in s or "disparity" in s else "Auxiliary"


def items(d: bytes) -> dict:
    """What the meta box says: primary item, types, places, references and properties by item."""
    meta = find(d, [b"meta"])
    out: dict = {"primary": None, "kinds": {}, "places": {}, "refs": [], "props": {}, "idat": None}
    if meta is None:
        return out
    at, end = meta[0] + 4, meta[1]
    props: list[tuple[bytes, int, int]] = []
    for kind, a, b in boxes(d, at, end):
        v = d[a]
        if kind == b"pitm":
            out["primary"] = number(d, a + 4, 4 if v else 2)
        elif kind == b"idat":
            out["idat"] = (a, b)
        elif kind == b"iinf":
            for k, x, _ in boxes(d, a + (8 if v else 6), b):
                if k == b"infe" and d[x] >= 2:
                    wide = 4 if d[x] == 3 else 2
                    out["kinds"][number(d, x + 4, wide)] = d[x + 6 + wide : x + 10 + wide]
        elif kind == b"iref":
            wide = 4 if v else 2
            for k, x, _ in boxes(d, a + 4, b):
                n = number(d, x + wide, 2)
                out["refs"].append((k, number(d, x, wide), [number(d, x + wide + 2 + i * wide, wide) for i in range(n)]))
        elif kind == b"iloc":
            offset, length, base = d[a + 4] >> 4, d[a + 4] & 15, d[a + 5] >> 4
            index = d[a + 5] & 15 if v else 0
            wide = 4 if v == 2 else 2
            x = a + 6 + wide
            for _ in range(number(d, a + 6, wide)):
                item = number(d, x, wide)
                x += wide
                method = number(d, x, 2) & 15 if v else 0
                x += 4 if v else 2
                start = number(d, x, base)
                x += base
                parts = []
                n = number(d, x, 2)
                x += 2
                for _ in range(n):
                    x += index
                    parts.append((start + number(d, x, offset), number(d, x + offset, length)))
                    x += offset + length
                out["places"][item] = (method, parts)
        elif kind == b"iprp":
            for k, x, y in boxes(d, a, b):
                if k == b"ipco":
                    props = list(boxes(d, x, y))
                elif k == b"ipma":
                    wide, big = (4 if d[x] else 2), d[x + 3] & 1
                    p = x + 8
                    for _ in range(number(d, x + 4, 4)):
                        item, n = number(d, p, wide), d[p + wide]
                        p += wide + 1
                        for _ in range(n):
                            ref = number(d, p, 2) & 0x7FFF if big else d[p] & 0x7F
                            p += 2 if big else 1
                            if 0 < ref <= len(props):
                                out["props"].setdefault(item, []).append(props[ref - 1])
    return out


def item_bytes(d: bytes, got: dict, item: int) -> bytes:
    method, parts = got["places"].get(item, (0, []))
    shift = got["idat"][0] if method == 1 and got["idat"] else 0
    return b"".join(d[shift + a : shift + a + n] for a, n in parts)


def properties(d: bytes, got: dict, item: int) -> dict:
    """width, height, bits and aux (a type) of an item, where its properties say them."""
    out: dict = {"width": 0, "height": 0, "bits": None, "aux": None, "icc": None}
    for kind, a, b in got["props"].get(item, []):
        if kind == b"ispe":
            out["width"], out["height"] = number(d, a + 4, 4), number(d, a + 8, 4)
        elif kind == b"pixi" and d[a + 4]:
            out["bits"] = d[a + 5]
        elif kind == b"auxC":
            out["aux"] = d[a + 4 : b].split(b"\0")[0].decode("utf-8", "replace") or None
        elif kind == b"colr" and d[a : a + 4] in (b"prof", b"rICC"):
            out["icc"] = d[a + 4 : b]
    return out


def aux_images(d: bytes) -> list[dict]:
    """Thumbnails of the primary item, then its auxiliaries: kind, item_id, width, height, aux_type."""
    got = items(d)
    primary, out = got["primary"], []
    for ref, thumbs in ((b"thmb", True), (b"auxl", False)):
        for kind, item, targets in got["refs"]:
            if kind == ref and primary in targets:
                p = properties(d, got, item)
                out.append({"kind": "Thumbnail" if thumbs else classify_aux(p["aux"]), "item_id": item, "width": p["width"], "height": p["height"], "aux_type": None if thumbs else p["aux"]})
    return out
