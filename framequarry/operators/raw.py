"""Camera RAW containers: their metadata, and their mosaics where the samples are plain or lossless JPEG.

A file is a row; it becomes a row of the frame schema that the mosaic operators take, or an error row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..data.calibration import BAYER
from ..ship import ship
from . import embedded, isobmff
from .codecs import Unreadable, apply_opcodes, decode_ljpeg, tiff_cells, unpack_be16
from .formats import sniff_raw
from .ifd import Reader

# Fields of the RAF header, sizes a CRW and a RAF without a better source are taken to have.
RAF_MAGIC, RAF_MODEL, RAF_JPEG, RAF_RAW, RAF_RAW_SIZE = b"FUJIFILMCCD-RAW ", (28, 32), 84, 92, 100
RAF_SIZE, CRW_SIZE = (6240, 4168), (5616, 3744)
XTRANS_MODELS = ("X-T", "X-PRO", "X-E", "X-H", "X-S", "X100", "X-A")
CFA_CODES = {(0, 1, 1, 2): "RGGB", (1, 0, 2, 1): "GRBG", (2, 1, 1, 0): "BGGR", (1, 2, 0, 1): "GBRG"}
CFA_PHOTOMETRIC, LINEAR_PHOTOMETRIC, LJPEG = 32803, 34892, 7


def white_of(bits: int) -> int:
    return 0 if bits == 0 else 65535 if bits >= 16 else (1 << bits) - 1


@dataclass
class Raw:
    """What a container says. Areas and crops are (x, y, width, height)."""

    make: str = ""
    model: str = ""
    width: int = 0
    height: int = 0
    area: list[int] = field(default_factory=list)
    bit_depth: int = 14
    cfa: str = "RGGB"
    xtrans: bool = False
    black: list[int] = field(default_factory=lambda: [0] * 4)
    white: int = 16383
    compression: int = 1
    neutral: list[float] | None = None
    exposure: float | None = None
    crop: list[int] | None = None
    orientation: int | None = None
    linear: bool = False
    matrix1: list[float] | None = None
    matrix2: list[float] | None = None


Tags = dict[int, list]


def tree(d: bytes) -> dict[str, Tags]:
    """Directory name: tag: values. A later tag of one directory replaces an earlier one."""
    out: dict[str, Tags] = {}
    for name, _, tag, values in Reader(d).tree():
        out.setdefault(name, {})[tag] = values
    return out


def first(t: Tags, tag: int, default=None):
    return t[tag][0] if t.get(tag) else default


def whole(t: Tags, tag: int, default: int = 0) -> int:
    v = first(t, tag)
    return int(v) if isinstance(v, int) else default


def words(t: Tags, tag: int) -> str:
    v = first(t, tag)
    return v if isinstance(v, str) else ""


def value(v) -> float:
    return (v[0] / v[1] if v[1] else float("nan")) if isinstance(v, tuple) else float(v)


def layout(t: Tags) -> str:
    v = t.get(0x828E) or []
    cells = tuple(v[0][:4]) if v and isinstance(v[0], bytes) else tuple(v[:4])
    return CFA_CODES.get(cells, "RGGB")


def cut_range(d: bytes, at: int, n: int) -> bytes:
    if at + n > len(d):
        raise Unreadable("offset out of bounds")
    return d[at : at + n]


def largest(dirs: dict[str, Tags], wanted) -> Tags | None:
    """The wanted directory of the most pixels; the first of equals."""
    best = None
    for t in dirs.values():
        n = whole(t, 256) * whole(t, 257)
        if wanted(t) and (best is None or n > best[0]):
            best = (n, t)
    return best[1] if best else None


def blacks(t: Tags, default: list[int]) -> list[int]:
    if 0xC61A not in t:
        return default
    v = [int(value(x)) & 0xFFFF for x in t[0xC61A]]
    return v[:4] if len(v) >= 4 else v * 4 if len(v) == 1 else [0] * 4


def sub_directories(dirs: dict[str, Tags]) -> dict[str, Tags]:
    return {n: t for n, t in dirs.items() if n.count("/") == 1 and "/sub" in n}


def _tiff(d: bytes, maker: str) -> tuple[dict[str, Tags], Raw]:
    try:
        dirs = tree(d)
    except (ValueError, struct.error) as e:
        raise Unreadable(str(e)) from None
    top = dirs.get("ifd0", {})
    if maker not in words(top, 271).upper():
        raise Unreadable(f"not a {maker} file")
    o = whole(top, 274, -1)
    return dirs, Raw(make=words(top, 271), model=words(top, 272), orientation=o if o >= 0 else None)


def _sized(r: Raw, t: Tags | None, bits: int = 14) -> Tags:
    if t is None:
        raise Unreadable("no raw directory")
    if 256 not in t or 257 not in t:
        raise Unreadable("no image size")
    r.width, r.height = whole(t, 256), whole(t, 257)
    r.bit_depth, r.compression, r.cfa = whole(t, 258, bits), whole(t, 259, 1), layout(t)
    r.area, r.white = [0, 0, r.width, r.height], white_of(r.bit_depth)
    return t


def _strip(d: bytes, t: Tags) -> bytes:
    at, n = whole(t, 273), whole(t, 279)
    if not at or not n:
        raise Unreadable("no raw data")
    return cut_range(d, at, n)


def _ljpeg(d: bytes, w: int, h: int) -> np.ndarray:
    return decode_ljpeg(d, w, h)[2].ravel()


def levels_to_neutral(v: list) -> list[float] | None:
    """G/R, 1, G/B from four levels R, G, G, B that are all positive."""
    if len(v) < 4:
        return None
    r, g, b = float(v[0]), (v[1] + v[2]) / 2, float(v[3])
    return [g / r, 1.0, g / b] if r > 0 and g > 0 and b > 0 else None


def _maker_note(d: bytes, note: bytes) -> list[float] | None:
    start = 12 if note[:9] in (b"SONY DSC ", b"SONY CAM ") else 0
    found = None
    for e in range(start + 2, start + 2 + 12 * int.from_bytes(note[start : start + 2], "little"), 12):
        if e + 12 > len(note):
            break
        if int.from_bytes(note[e : e + 2], "little") == 0x7313:
            at = int.from_bytes(note[e + 8 : e + 12], "little")
            for where in (d, note):
                v = struct.unpack_from("<4H", where, at) if at + 8 <= len(where) else (0,) * 4
                if v[0] or v[1]:
                    break
            found = levels_to_neutral(list(v)) if all(v) else found
    return found


def read_arw(d: bytes, samples: bool = True) -> tuple[Raw, np.ndarray | None]:
    dirs, r = _tiff(d, "SONY")
    t = _sized(r, largest(sub_directories(dirs), lambda t: whole(t, 262) == CFA_PHOTOMETRIC))
    if len(t.get(0xC61F, [])) >= 2 and len(t.get(0xC620, [])) >= 2:
        r.area = [int(value(x)) for x in (*t[0xC61F][:2], *t[0xC620][:2])]
    r.black, r.white = blacks(t, [512] * 4), whole(t, 0xC61D, r.white)
    r.neutral = levels_to_neutral(t.get(0x7313, []))
    note = first(dirs.get("ifd0/exif0", dirs["ifd0"]), 0x927C)
    if r.neutral is None and isinstance(note, bytes):
        r.neutral = _maker_note(d, note)
    if r.neutral is None and whole(dirs["ifd0"], 0x02BC):
        try:
            private = dict(Reader(d).directory(whole(dirs["ifd0"], 0x02BC))[0])
            r.neutral = levels_to_neutral(private.get(0x7313, []))
        except struct.error:
            pass
    if not samples:
        return r, None
    if r.compression != LJPEG:
        raise Unreadable(f"compression {r.compression} is not supported, only {LJPEG} is")
    tw, th = whole(t, 322), whole(t, 323)
    if not (t.get(324) and tw and th):
        return r, _ljpeg(_strip(d, t), r.width, r.height)
    out = np.zeros((r.height, r.width), np.int32)
    across = -(-r.width // tw)
    for k, (at, n) in enumerate(zip(t[324], t.get(325, []), strict=False)):
        x, y = k % across * tw, k // across * th
        part = cut_range(d, at, n)
        try:
            tile = _ljpeg(part, tw, th).reshape(th, tw)
        except Unreadable:
            continue  # a tile that cannot be read stays zero
        out[y : y + th, x : x + tw] = tile[: max(0, r.height - y), : max(0, r.width - x)]
    return r, out.ravel()


def read_nef(d: bytes, samples: bool = True) -> tuple[Raw, np.ndarray | None]:
    dirs, r = _tiff(d, "NIKON")
    t = _sized(r, largest(sub_directories(dirs), lambda t: whole(t, 262) == CFA_PHOTOMETRIC if 262 in t else 0x828E in t))
    r.black = [int(np.float32(0.02) * np.float32(1 << r.bit_depth))] * 4
    if not samples:
        return r, None
    if r.compression == 1:
        return r, np.frombuffer(_strip(d, t)[: len(_strip(d, t)) // 2 * 2], "<u2").astype(np.int32)
    if r.compression in (6, 34713):
        return r, _ljpeg(_strip(d, t), r.width, r.height)
    raise Unreadable(f"compression {r.compression} is not supported")


def read_cr2(d: bytes, samples: bool = True) -> tuple[Raw, np.ndarray | None]:
    """Slices are not undone."""
    dirs, r = _tiff(d, "CANON")
    tops = {n: t for n, t in dirs.items() if "/" not in n}
    fourth = tops.get("ifd3", {})
    good = whole(fourth, 259) == 6 and whole(fourth, 256) and whole(fourth, 257)
    t = _sized(r, fourth if good else largest(tops, lambda t: whole(t, 259) == 6 and whole(t, 256) * whole(t, 257) > 0))
    r.black = blacks(t, [0] * 4)
    strip = _strip(d, t)
    return r, _ljpeg(strip, r.width, r.height) if samples else None


def read_raf(d: bytes, samples: bool = True) -> tuple[Raw, np.ndarray | None]:
    if len(d) < 160 or d[:16] != RAF_MAGIC:
        raise Unreadable("not a RAF header")
    at, n = RAF_MODEL
    model = d[at : at + n].split(b"\0")[0].decode("utf-8", "replace").strip()
    jpeg, size, raw, raw_size = (int.from_bytes(d[k : k + 4]) for k in (RAF_JPEG, RAF_JPEG + 4, RAF_RAW, RAF_RAW_SIZE))
    if not raw:
        raise Unreadable("no raw data offset")
    w, h = (exif_size(d[jpeg : jpeg + min(size, 65536)]) if size else None) or RAF_SIZE
    r = Raw("FUJIFILM", model, w, h, [0, 0, w, h], 14, "RGGB", any(m in model.upper() for m in XTRANS_MODELS), [512] * 4, 16383)
    if not samples:
        return r, None
    if raw_size < 32:
        raise Unreadable("raw data too small")
    body = cut_range(d, raw, raw_size)
    return r, unpack_be16(body[32:] if len(body) > 32 else body)


def exif_size(jpeg: bytes) -> tuple[int, int] | None:
    """Of the picture by the first directory of its EXIF segment."""
    if jpeg[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 3 < len(jpeg) and jpeg[at] == 0xFF:
        n = int.from_bytes(jpeg[at + 2 : at + 4])
        if jpeg[at + 1] == 0xE1:
            if jpeg[at + 4 : at + 10] != b"Exif\0\0":
                return None
            try:
                r = Reader(jpeg[at + 10 :])
                t = dict(r.directory(r.first)[0])
            except (ValueError, struct.error):
                return None
            w, h = whole(t, 256), whole(t, 257)
            return (w, h) if w and h else None
        at += 2 + n
    return None


def read_crw(d: bytes, samples: bool = True) -> tuple[Raw, np.ndarray | None]:
    w, h = CRW_SIZE
    if samples:
        raise Unreadable("CRW samples are not supported")
    return Raw("Canon", "", w, h, [0, 0, w, h], 12, white=white_of(12)), None


def read_cr3(d: bytes, samples: bool = True) -> tuple[Raw, np.ndarray | None]:
    moov = isobmff.find(d, [b"moov"])
    if moov is None:
        raise Unreadable("no moov box")
    r, best = Raw(bit_depth=14), (0, 0, 0, 0)
    for kind, a, b in isobmff.boxes(d, *moov):
        if kind == b"uuid" and d[a : a + 16] == isobmff.CANON and not r.make:
            for k, x, y in isobmff.boxes(d, a + 16, b):
                if k == b"CMT1":
                    try:
                        inner = Reader(d[x : min(y, x + 65536)])
                        t = dict(inner.directory(inner.first)[0])
                    except (ValueError, struct.error):
                        continue
                    r.make, r.model, r.cfa = words(t, 271), words(t, 272), layout(t)
        elif kind == b"trak":
            got = isobmff.track(d, a, b)
            best = got if got[1] > best[1] else best
    r.width, r.height = best[2:]
    r.area = [0, 0, r.width, r.height]
    if samples:
        raise Unreadable("CR3 samples are not supported")
    return r, None


def read_dng(d: bytes, samples: bool = True) -> tuple[Raw, np.ndarray | None]:
    """CFA and three-plane linear data in strips or tiles, linearised by their table.

    Linear data are cut to the active area, and the gain maps of their second opcode list are applied.
    """
    dirs, r = _tiff(d, "")
    kinds = (CFA_PHOTOMETRIC, LINEAR_PHOTOMETRIC)
    t = _sized(r, largest(dirs, lambda t: whole(t, 262) in kinds and not whole(t, 254)) or largest(dirs, lambda t: whole(t, 262) in kinds), 16)
    top = dirs["ifd0"]
    r.linear = whole(t, 262) == LINEAR_PHOTOMETRIC
    cells = [min(65535, max(0, int(np.floor(value(x) + 0.5)))) for x in t.get(0xC61A, [])]
    r.black = [cells[i % len(cells)] for i in range(4)] if cells else [0] * 4
    r.white = min(65535, whole(t, 0xC61D, white_of(r.bit_depth)))
    if len(t.get(0xC68D, [])) == 4:
        y0, x0, y1, x1 = (int(v) for v in t[0xC68D])
        r.area = [x0, y0, max(0, x1 - x0), max(0, y1 - y0)]
    if len(t.get(0xC61F, [])) >= 2 and len(t.get(0xC620, [])) >= 2:
        r.crop = [int(value(x)) for x in (*t[0xC61F][:2], *t[0xC620][:2])]
    r.matrix1, r.matrix2, r.neutral = ([value(x) for x in top[k]] if k in top else None for k in (0xC621, 0xC622, 0xC628))
    r.exposure = value(top[0xC62A][0]) if top.get(0xC62A) else None
    if not samples:
        return r, None
    planes = whole(t, 277, 1)
    if r.linear and planes != 3:
        raise Unreadable(f"linear data of {planes} planes")
    data = _dng_samples(d, t, r, planes)
    table = t.get(0xC618)
    if table:
        data = np.array(table, np.int32)[np.minimum(data, len(table) - 1)]
        r.bit_depth = 16
    if not r.linear:
        return r, data.ravel()
    x, y, w, h = r.area
    rgb = np.zeros((h, w, 3), np.int32)  # what the active area has beyond the samples stays zero
    part = data[y : y + h, x : x + w]
    rgb[: part.shape[0], : part.shape[1]] = part
    r.width, r.height, r.area = w, h, [0, 0, w, h]
    listed = first(t, 0xC741)
    return r, (apply_opcodes(rgb, listed) if isinstance(listed, bytes) else rgb).ravel()


def _dng_samples(d: bytes, t: Tags, r: Raw, planes: int) -> np.ndarray:
    """(rows, columns, planes) of strips or tiles: plain samples of 8 to 16 bits, or lossless JPEG of one plane."""
    how, bits = whole(t, 259, 1), r.bit_depth
    plain = how == 1 and 8 <= bits <= 16 and whole(t, 284, 1) == 1
    if not plain and not (how == LJPEG and planes == 1) or not (t.get(273) or t.get(324)):
        raise Unreadable("unsupported DNG layout")
    out = np.zeros((r.height, r.width, planes), np.int32)
    for _, x, y, w, h, at, n in tiff_cells(t, r.width, r.height, 1):
        part = cut_range(d, at, n)
        cell = unpack_bits(part, w * planes, h, bits, Reader(d).order) if plain else _ljpeg(part, w, h)
        to = out[y : y + h, x : x + w]
        to[:] = cell.reshape(h, w, planes)[: to.shape[0], : to.shape[1]]
    return out


def unpack_bits(part: bytes, across: int, down: int, bits: int, order: str) -> np.ndarray:
    """Lines of ``across`` samples; other than 8 and 16 bits are packed from the highest bit, each line from a whole byte."""
    stride = (across * bits + 7) // 8
    if len(part) < stride * down:
        raise Unreadable("DNG data end early")
    if bits in (8, 16):
        return np.frombuffer(part, "u1" if bits == 8 else order + "u2", across * down).astype(np.int32)
    lines = np.unpackbits(np.frombuffer(part, np.uint8, stride * down).reshape(down, stride), axis=1)[:, : across * bits]
    return (lines.reshape(-1, bits) @ (1 << np.arange(bits - 1, -1, -1))).astype(np.int32)


READERS = {"ARW": read_arw, "NEF": read_nef, "CR2": read_cr2, "RAF": read_raf, "CRW": read_crw, "CR3": read_cr3, "DNG": read_dng}
FIELDS = (
    "make string, model string, width int, height int, area array<int>, bit_depth int, cfa string, xtrans boolean, black array<int>, white int, compression int, "
    "neutral array<double>, exposure double, crop array<int>, orientation int, linear boolean, matrix1 array<double>, matrix2 array<double>"
)
ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
NAMES = dict(x.split() for x in FIELDS.split(", "))


def thumbnail(d: bytes, kind: str) -> bytes | None:
    """The embedded JPEG: by its tags in TIFF kinds, by the header in RAF, none elsewhere."""
    if kind == "RAF":
        at, n = (int.from_bytes(d[k : k + 4]) for k in (RAF_JPEG, RAF_JPEG + 4))
    elif kind in ("ARW", "NEF", "CR2", "DNG"):
        top = tree(d).get("ifd0", {})
        at, n = whole(top, 0x0201), whole(top, 0x0202)
    else:
        return None
    return cut_range(d, at, n) if n else None


#: Fields of the ``exif`` column of ``metadata``.
EXIF = [(n, k) for n, _, _, k in embedded.FIELDS if n not in ("make", "model", "orientation", "offset_time_original", "subsec_time_original")]
EXIF_SCHEMA = ", ".join(f"{n}: {embedded.SPARK[k]}" for n, k in EXIF)
EXIF_ARROW = pa.struct([(n, embedded.ARROW[k]) for n, k in EXIF])


def exif(d: bytes, kind: str) -> dict | None:
    """Capture, date, lens and place of the TIFF kinds; the time of the original goes first, references are one letter."""
    if kind not in ("ARW", "NEF", "CR2", "DNG"):
        return None
    found = embedded.record(d)
    for n in ("offset_time", "subsec_time"):
        found[n] = found[n + "_original"] or found[n]
    for n in ("gps_latitude_ref", "gps_longitude_ref"):
        found[n] = found[n][:1] if found[n] else None
    return {n: found[n] for n, _ in EXIF}


def validate(kind: str, r: Raw) -> str | None:
    if r.width == 0 or r.height == 0:
        return "invalid dimensions"
    return None


def _read(samples: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a file a batch: it may be large
                part = batch.slice(k, 1)
                kind, d = part.column(1)[0].as_py(), part.column(2)[0].as_py()
                r, data, error, thumb, shot = None, None, None, None, None
                if kind is None:
                    error = "unrecognized RAW format"
                else:
                    try:
                        r, data = READERS[kind](d, samples)
                        error = validate(kind, r)
                        if data is not None and len(data) != r.width * r.height * (3 if r.linear else 1):
                            data, error = None, f"got {len(data)} samples, expected {r.width} x {r.height}"
                        if not samples:
                            thumb, shot = thumbnail(d, kind), exif(d, kind)
                    except (Unreadable, ValueError, struct.error, IndexError, KeyError) as e:
                        r, error = None, f"{kind}: {e}"
                row = asdict(r) if r else dict.fromkeys(NAMES)
                cols = [pa.array([row[n]], ARROW[t]) for n, t in NAMES.items()]
                last = [pa.array([data], pa.list_(pa.int32()))] if samples else [pa.array([thumb], pa.binary()), pa.array([shot], EXIF_ARROW)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *cols, *last, pa.array([error], pa.string())], ["img_id", "format", *NAMES, *(["data"] if samples else ["thumbnail", "exif"]), "error"])

    return run


def _rows(files: DataFrame, samples: bool, last: str) -> DataFrame:
    ship(files.sparkSession)
    kind = dict(files.dtypes)["file_id"]
    named = sniff_raw(files, "format").select(F.col("file_id").alias("img_id"), "format", "content")
    return named.mapInArrow(_read(samples), f"img_id {kind}, format string, {FIELDS}, {last}, error string")


def read(files: DataFrame) -> DataFrame:
    """(file_id, content) to frames: img_id, format, FIELDS, data, error. Linear files have r, g, b in turn in data."""
    return _rows(files, True, "data array<int>")


def metadata(files: DataFrame) -> DataFrame:
    """The same without samples, and with the embedded thumbnail and, of the TIFF kinds, ``exif``."""
    return _rows(files, False, f"thumbnail binary, exif struct<{EXIF_SCHEMA}>")


def active(frames: DataFrame) -> DataFrame:
    """Frames cut to their active area; the layout is turned so that it starts at the area's corner."""
    x, y, w, h = (F.col("area")[i] for i in range(4))
    inside = F.transform(F.sequence(F.lit(0), w * h - 1), lambda i: F.element_at("data", (y + F.floor(i / w).cast("int")) * F.col("width") + x + i % w + 1))
    dx, dy = x % 2, y % 2
    letter = lambda k: F.col("cfa").substr(((F.lit(k // 2) + dy) % 2) * 2 + (F.lit(k % 2) + dx) % 2 + F.lit(1), F.lit(1))
    cut = frames.withColumn("data", inside)  # first: a lambda would see the new width
    return cut.withColumns({"width": w, "height": h, "cfa": F.concat(*map(letter, range(4)))})


assert set(CFA_CODES.values()) == set(BAYER)
