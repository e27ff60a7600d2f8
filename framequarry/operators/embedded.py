"""EXIF, ICC and XMP inside JPEG, PNG, WebP, TIFF, HEIC and AVIF files, and as one typed record a file.

A reader never fails: what cannot be read is null, and a malformed file gives an empty record.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from . import isobmff
from .codecs import Unreadable
from .formats import sniff_standard
from .ifd import Reader

# The EXIF tags of the typed record, by directory and kind of value.
FIELDS = [
    ("make", "ifd0", 0x010F, "string"), ("model", "ifd0", 0x0110, "string"), ("orientation", "ifd0", 0x0112, "int"), ("modify_date", "ifd0", 0x0132, "string"),
    ("lens_make", "exif", 0xA433, "string"), ("lens_model", "exif", 0xA434, "string"), ("serial_number", "exif", 0xA431, "string"),
    ("iso", "exif", 0x8827, "int"), ("exposure_time", "exif", 0x829A, "rational"), ("f_number", "exif", 0x829D, "rational"), ("focal_length", "exif", 0x920A, "rational"),
    ("focal_length_35mm", "exif", 0xA405, "int"), ("exposure_program", "exif", 0x8822, "int"), ("metering_mode", "exif", 0x9207, "int"), ("flash", "exif", 0x9209, "int"),
    ("exposure_compensation", "exif", 0x9204, "rational"), ("max_aperture", "exif", 0x9205, "rational"), ("brightness_value", "exif", 0x9203, "rational"),
    ("datetime_original", "exif", 0x9003, "string"), ("create_date", "exif", 0x9004, "string"), ("offset_time", "exif", 0x9010, "string"), ("offset_time_original", "exif", 0x9011, "string"),
    ("subsec_time", "exif", 0x9290, "string"), ("subsec_time_original", "exif", 0x9291, "string"),
    ("gps_latitude_ref", "gps", 0x0001, "string"), ("gps_latitude", "gps", 0x0002, "rationals"), ("gps_longitude_ref", "gps", 0x0003, "string"), ("gps_longitude", "gps", 0x0004, "rationals"),
    ("gps_altitude_ref", "gps", 0x0005, "int"), ("gps_altitude", "gps", 0x0006, "rational"), ("gps_timestamp", "gps", 0x0007, "rationals"), ("gps_speed", "gps", 0x000D, "rational"),
    ("gps_img_direction", "gps", 0x0011, "rational"), ("gps_datestamp", "gps", 0x001D, "string"),
]
RATIONAL = "struct<num:bigint,den:bigint>"
SPARK = {"string": "string", "int": "bigint", "rational": RATIONAL, "rationals": f"array<{RATIONAL}>"}
_R = pa.struct([("num", pa.int64()), ("den", pa.int64())])
ARROW = {"string": pa.string(), "int": pa.int64(), "rational": _R, "rationals": pa.list_(_R)}
EXTRA = pa.list_(pa.struct([("namespace", pa.string()), ("tag", pa.string()), ("value", pa.string())]))
SCHEMA = ", ".join(f"{n} {SPARK[k]}" for n, _, _, k in FIELDS) + ", icc binary, xmp binary, bit_depth int, extra array<struct<namespace:string,tag:string,value:string>>"


def jpeg_blocks(d: bytes) -> dict:
    out: dict = {"icc": b""}
    at = 2
    while at + 4 <= len(d) and d[at] == 0xFF and d[at + 1] != 0xDA:
        n = int.from_bytes(d[at + 2 : at + 4])
        body = d[at + 4 : at + 2 + n]
        if d[at + 1] == 0xE1 and body[:6] == b"Exif\0\0":
            out.setdefault("exif", body[6:])
        elif d[at + 1] == 0xE1 and body.startswith(b"http://ns.adobe.com/xap/1.0/\0"):
            out.setdefault("xmp", body[29:])
        elif d[at + 1] == 0xE2 and body[:12] == b"ICC_PROFILE\0":
            out["icc"] += body[14:]
        at += 2 + n
    return out


def png_blocks(d: bytes) -> dict:
    out: dict = {}
    at = 8
    while at + 8 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, at)
        body = d[at + 8 : at + 8 + n]
        if kind == b"eXIf":
            out["exif"] = body
        elif kind == b"iCCP":
            out["icc"] = zlib.decompressobj().decompress(body[body.index(b"\0") + 2 :], 16 << 20)
        elif kind == b"iTXt" and body.startswith(b"XML:com.adobe.xmp\0"):
            packed, rest = body[18], body[20:].split(b"\0", 2)[-1]
            out["xmp"] = zlib.decompressobj().decompress(rest, 16 << 20) if packed else rest
        at += 12 + n
    return out


def webp_blocks(d: bytes) -> dict:
    out: dict = {}
    at = 12
    while at + 8 <= len(d):
        kind, n = struct.unpack_from("<4sI", d, at)
        body = d[at + 8 : at + 8 + n]
        if kind in (b"EXIF", b"ICCP", b"XMP "):
            out[{b"EXIF": "exif", b"ICCP": "icc", b"XMP ": "xmp"}[kind]] = body[6:] if body[:6] == b"Exif\0\0" else body
        at += 8 + n + n % 2
    return out


def heif_blocks(d: bytes) -> dict:
    got = isobmff.items(d)
    p = isobmff.properties(d, got, got["primary"])
    out: dict = {"icc": p["icc"], "bit_depth": p["bits"] or 8}
    for item, kind in got["kinds"].items():
        if kind == b"Exif":
            b = isobmff.item_bytes(d, got, item)
            start = 4 + int.from_bytes(b[:4])
            out["exif"] = b[start:] if len(b) >= 4 and start < len(b) else None
        elif kind == b"mime":
            out.setdefault("xmp", isobmff.item_bytes(d, got, item))
    return out


BLOCKS = {"JPEG": jpeg_blocks, "PNG": png_blocks, "WebP": webp_blocks, "TIFF": lambda d: {"exif": d}, "HEIC": heif_blocks, "AVIF": heif_blocks}
_DIRS = {"ifd0": "ifd0", "exif": "ifd0/exif0", "gps": "ifd0/gps0", "interop": "ifd0/exif0/interop0", "thumb": "ifd1"}


def _typed(values: list, kind: str):
    v = values[0] if values else None
    if kind == "string":
        return v or None if isinstance(v, str) else None
    if kind == "int":
        return v if isinstance(v, int) else v[0] if isinstance(v, bytes) and v else None
    pair = lambda x: {"num": x[0], "den": x[1]}
    if kind == "rational":
        return pair(v) if isinstance(v, tuple) else None
    return [pair(x) for x in values[:3]] if len(values) >= 3 and all(isinstance(x, tuple) for x in values[:3]) else None


def _shown(values: list) -> str:
    one = lambda v: f"{v[0]}/{v[1]}" if isinstance(v, tuple) else v.hex() if isinstance(v, bytes) else str(v)
    return one(values[0]) if len(values) == 1 else "[" + ", ".join(map(one, values)) + "]"


def record(exif: bytes | None) -> dict:
    """The typed fields and the generic table of an EXIF block; of directories that share a name space the last one wins."""
    out: dict = {n: None for n, *_ in FIELDS} | {"extra": []}
    try:
        found: dict[str, dict[int, list]] = {}
        for name, _, tag, values in Reader(exif or b"").tree():
            found.setdefault(name, {})[tag] = values
    except (ValueError, struct.error):
        return out
    for name, where, tag, kind in FIELDS:
        out[name] = _typed(found.get(_DIRS[where], {}).get(tag, []), kind)
    table: dict[tuple[str, str], str] = {}
    for where in ("ifd0", "exif", "gps", "interop", "thumb"):
        for tag, values in found.get(_DIRS[where], {}).items():
            table["gps" if where == "gps" else "exif", f"0x{tag:04x}"] = _shown(values)
    out["extra"] = [{"namespace": n, "tag": t, "value": v} for (n, t), v in table.items()]
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for kind, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            try:
                b = BLOCKS[kind](d) if kind in BLOCKS else {}
            except (Unreadable, ValueError, IndexError, struct.error, zlib.error):
                b = {}
            rows.append(record(b.get("exif")) | {"icc": b.get("icc") or None, "xmp": b.get("xmp") or None, "bit_depth": b.get("bit_depth")})
        cols = [pa.array([r[n] for r in rows], ARROW[k]) for n, _, _, k in FIELDS]
        cols += [pa.array([r["icc"] for r in rows], pa.binary()), pa.array([r["xmp"] for r in rows], pa.binary()), pa.array([r["bit_depth"] for r in rows], pa.int32()), pa.array([r["extra"] for r in rows], EXTRA)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *cols], ["file_id", "format", *[n for n, *_ in FIELDS], "icc", "xmp", "bit_depth", "extra"])


def read(files: DataFrame) -> DataFrame:
    """file_id, format and the record (SCHEMA) of each file; formats without metadata give an empty record."""
    ship(files.sparkSession)
    kind = dict(files.dtypes)["file_id"]
    named = files.select("file_id", sniff_standard(F.col("content")).alias("format"), "content")
    return named.mapInArrow(_read, f"file_id {kind}, format string, {SCHEMA}")


def auxiliaries(files: DataFrame) -> DataFrame:
    """A row per thumbnail and auxiliary image of HEIC and AVIF files: file_id, kind, item_id, width, height, aux_type."""
    ship(files.sparkSession)
    names = ["kind", "item_id", "width", "height", "aux_type"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for k, d in enumerate(batch.column(1).to_pylist()):
                try:
                    got = isobmff.aux_images(d or b"")
                except (ValueError, IndexError, struct.error):
                    got = []
                keys += [k] * len(got)
                rows += got
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *[pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)]], ["file_id", *names])

    return files.select("file_id", "content").mapInArrow(run, f"file_id {dict(files.dtypes)['file_id']}, kind string, item_id bigint, width bigint, height bigint, aux_type string")


# --- writing -------------------------------------------------------------------------------------

_CODES = {"string": 2, "int": 3, "rational": 5, "rationals": 5}
_SIGNED = {0x9203, 0x9204}


def build_exif(record_: dict) -> bytes:
    """A little-endian EXIF block of the typed fields that are set; whole numbers above 65535 are LONG."""
    groups: dict[str, list[tuple[int, int, int, bytes]]] = {"ifd0": [], "exif": [], "gps": []}
    for name, where, tag, kind in FIELDS:
        v = record_.get(name)
        if v is None:
            continue
        code = _CODES[kind]
        if kind == "string":
            data, n = v.encode() + b"\0", len(v.encode()) + 1
        elif kind == "int":
            code = 4 if v > 65535 else 1 if tag == 5 and where == "gps" else 3
            data, n = struct.pack({4: "<I", 3: "<H", 1: "<B"}[code], v), 1
        else:
            parts = v if kind == "rationals" else [v]
            code = 10 if tag in _SIGNED else 5
            data, n = b"".join(struct.pack("<ii" if code == 10 else "<II", p["num"], p["den"]) for p in parts), len(parts)
        groups[where].append((tag, code, n, data))

    def size(fields: list) -> int:
        return 2 + 12 * len(fields) + 4 + sum(len(d) + len(d) % 2 for *_, d in fields if len(d) > 4)

    top = groups["ifd0"]
    for where, pointer in (("exif", 0x8769), ("gps", 0x8825)):
        if groups[where]:
            top.append((pointer, 4, 1, bytes(4)))
    at = {"ifd0": 8, "exif": 8 + size(top)}
    at["gps"] = at["exif"] + (size(groups["exif"]) if groups["exif"] else 0)
    out = b"II\x2a\0" + struct.pack("<I", 8)
    for where in ("ifd0", "exif", "gps"):
        fields = sorted(groups[where])
        if not fields and where != "ifd0":
            continue
        place, entries, rest = at[where] + 2 + 12 * len(fields) + 4, b"", b""
        for tag, code, n, data in fields:
            data = struct.pack("<I", at["exif" if tag == 0x8769 else "gps"]) if where == "ifd0" and tag in (0x8769, 0x8825) else data
            entries += struct.pack("<HHI", tag, code, n) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", place + len(rest)))
            rest += data + b"\0" * (len(data) % 2) if len(data) > 4 else b""
        out += struct.pack("<H", len(fields)) + entries + bytes(4) + rest
    return out


def srgb_profile() -> bytes:
    """A version 2.1 RGB display profile of the sRGB primaries under D50, with a gamma of 0x0238 / 256."""
    # The colorants, the white and the gamma of the profile.
    xyz = lambda *v: b"XYZ \0\0\0\0" + b"".join(struct.pack(">i", round(x * 65536)) for x in v)
    curve = b"curv\0\0\0\0" + struct.pack(">IH", 1, 0x0238) + b"\0\0"
    text = b"sRGB\0"
    desc = b"desc\0\0\0\0" + struct.pack(">I", len(text)) + text + bytes(4 + 4 + 2 + 1 + 67)
    parts = {b"desc": desc + b"\0" * (-len(desc) % 4), b"wtpt": xyz(0.9642, 1.0, 0.8249), b"rXYZ": xyz(0.4361, 0.2225, 0.0139), b"gXYZ": xyz(0.3851, 0.7169, 0.0971), b"bXYZ": xyz(0.1431, 0.0606, 0.7139), b"rTRC": curve}
    names, body, at = [], b"", 128 + 4 + 12 * (len(parts) + 2)
    for k, v in parts.items():
        names.append((k, at + len(body), len(v)))
        body += v
    curve_at = names[-1][1:]
    names += [(b"gTRC", *curve_at), (b"bTRC", *curve_at)]
    table = struct.pack(">I", len(names)) + b"".join(struct.pack(">4sII", *n) for n in names)
    head = struct.pack(">I4sI4s4s4s12s4s", 128 + len(table) + len(body), bytes(4), 0x02100000, b"mntr", b"RGB ", b"XYZ ", bytes(12), b"acsp")
    return head.ljust(68, b"\0") + struct.pack(">3i", 63190, 65536, 54061) + bytes(48) + table + body


def valid_profile(b: bytes | None) -> bool:
    return bool(b) and len(b) >= 128 and b[36:40] == b"acsp" and int.from_bytes(b[:4]) == len(b)


def with_png_blocks(png: bytes, exif: bytes | None = None, icc: bytes | None = None, xmp: bytes | None = None) -> bytes:
    """A PNG with the blocks put after its header."""
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    new = (chunk(b"iCCP", b"ICC Profile\0\0" + zlib.compress(icc)) if icc else b"") + (chunk(b"eXIf", exif) if exif else b"") + (chunk(b"iTXt", b"XML:com.adobe.xmp\0\0\0\0\0" + xmp) if xmp else b"")
    return png[:33] + new + png[33:]
