"""TIFF directories as rows: one row per tag and file, with the directory it stands in."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..ship import ship

# Sizes and struct letters of the field types; tags that point to further directories.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I"}
POINTERS = {0x014A: "sub", 0x8769: "exif", 0x8825: "gps", 0xA005: "interop"}
DEPTH = 8
MAX_ENTRIES = 65536


class Reader:
    def __init__(self, data: bytes):
        self.data = data
        self.order = {b"II\x2a\0": "<", b"MM\0\x2a": ">"}.get(data[:4], "")
        if not self.order or len(data) < 8:
            raise ValueError("not a TIFF header")
        (self.first,) = struct.unpack_from(self.order + "I", data, 4)

    def directory(self, at: int) -> tuple[list[tuple[int, list]], int]:
        """((tag, values) of the readable entries, offset of the next directory)."""
        d, o = self.data, self.order
        (n,) = struct.unpack_from(o + "H", d, at)
        out = []
        for e in range(at + 2, at + 2 + 12 * n, 12):
            tag, kind, count = struct.unpack_from(o + "HHI", d, e)
            letters = TYPES.get(kind)
            if not letters:
                continue
            size = struct.calcsize(o + letters) * count
            place = e + 8 if size <= 4 else struct.unpack_from(o + "I", d, e + 8)[0]
            if place + size > len(d):
                continue
            if letters == "s":
                out.append((tag, [d[place : place + count]] if kind == 7 else [d[place : place + count].rstrip(b"\0").strip().decode("utf-8", "replace")]))
            else:
                flat = struct.unpack_from(f"{o}{len(letters) * count}{letters[0]}", d, place)
                out.append((tag, list(flat) if len(letters) == 1 else [tuple(flat[i : i + 2]) for i in range(0, len(flat), 2)]))
        end = at + 2 + 12 * n
        return out, struct.unpack_from(o + "I", d, end)[0] if end + 4 <= len(d) else 0

    def tree(self) -> Iterator[tuple[str, int, int, list]]:
        """(directory, depth, tag, values) of all directories. A place is visited once; a child that cannot be read is left out."""
        seen: set[int] = set()

        def walk(name: str, at: int, depth: int, must: bool) -> Iterator[tuple[str, int, int, list]]:
            if depth > DEPTH or at == 0 or at in seen:
                return
            seen.add(at)
            try:
                entries, after = self.directory(at)
            except struct.error:
                if must:
                    raise ValueError("directory out of bounds") from None
                return
            for tag, values in entries:
                if tag not in POINTERS:
                    yield name, depth, tag, values
            for tag, values in entries:
                for k, child in enumerate(values if tag in POINTERS else []):
                    yield from walk(f"{name}/{POINTERS[tag]}{k}", child, depth + 1, False)
            if depth == 0:
                yield from walk(f"ifd{int(name[3:]) + 1}", after, 0, False)

        yield from walk("ifd0", self.first, 0, True)


def first_directory(data: bytes | None) -> dict[int, object] | None:
    """tag: first value of the first directory, or None if there is none."""
    try:
        r = Reader(bytes(data or b""))
        return {t: v[0] if v else None for t, v in r.directory(r.first)[0]}
    except (ValueError, struct.error):
        return None


def _rows(values: list) -> list[dict]:
    out = []
    for i, v in enumerate(values):
        row: dict = {"i": i, "num": None, "den": None, "value": None, "text": None}
        if isinstance(v, tuple):
            row["num"], row["den"] = v
            row["value"] = v[0] / v[1] if v[1] else float("nan")
        elif isinstance(v, bytes):
            row["text"] = v.hex()
        elif isinstance(v, str):
            row["text"] = v
        else:
            row["value"], row["num"] = float(v), v if isinstance(v, int) else None
        out.append(row)
    return out


SCHEMA = "dir string, depth int, tag int, i int, num bigint, den bigint, value double, text string, error string"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES_PA = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.string()]


def _tags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, cols = [], [[] for _ in NAMES]
        for k, content in enumerate(batch.column(1).to_pylist()):
            try:
                got = [(d, depth, tag, *r.values(), None) for d, depth, tag, values in Reader(content or b"").tree() for r in _rows(values[:MAX_ENTRIES])]
            except ValueError as e:
                got = [(None, None, None, None, None, None, None, None, str(e))]
            keys += [k] * len(got)
            for row in got:
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, TYPES_PA, strict=True)]], ["file_id", *NAMES])


def tags(files: DataFrame) -> DataFrame:
    """A row per value of each tag of (file_id, content); a file without a readable header gives one row with an error."""
    ship(files.sparkSession)
    kind = dict(files.dtypes)["file_id"]
    return files.select("file_id", "content").mapInArrow(_tags, f"file_id {kind}, {SCHEMA}")
