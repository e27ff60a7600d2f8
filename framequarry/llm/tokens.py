"""Token ids of whole texts, exactly as the tokenizers library gives them, several times faster on prose.

The vocabulary is byte-level BPE: a text is cut into pieces by a public pattern, and each piece is
encoded by itself. Texts of PLAIN characters are cut here, all of a batch at once, by the classes of
their bytes; each new piece is encoded by the library's model and kept in a compact table. A piece is
found again by its bytes themselves, never by a hash alone. Any other text, and one that holds an
added token of the file, goes to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEEP = 1 << 20  # pieces in a worker's table: about 50 MB
SLOTS = 2 * KEEP
LONG = 16  # bytes of a piece that the table holds; longer ones have a dict
KEEP_LONG = 50_000
GROUP = 1 << 17  # pieces looked up at a time
ROWS, BYTES = 256, 1 << 20  # of texts encoded at a time
U = np.uint64
# The published pattern is: 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
# Classes of characters; PLAIN ones are U+0009-000D, U+0020-007E, U+00A1-024F, U+2010-2027.
SPACE, NUMBER, LETTER, OTHER, STOP, FOREIGN = range(6)
_loaded: dict[str, Encoder] = {}


def _byte_signs() -> dict[int, str]:
    """The published byte-level alphabet: a printable byte is its own sign, the others in turn are those from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


SIGNS = _byte_signs()


def _class_of(code: int) -> int:
    c = chr(code)
    if 0x9 <= code <= 0xD or code == 0x20:
        return SPACE
    if 0x21 <= code <= 0x7E or 0xA1 <= code <= 0x24F:
        return LETTER if c.isalpha() else NUMBER if c.isnumeric() else OTHER
    return FOREIGN


_ONE = np.array([_class_of(b) if b < 0x80 else LETTER for b in range(256)], dtype=np.uint8)
_ONE[0] = STOP  # stands after each text here; a text that has it is foreign
_ONE[0xCA:] = FOREIGN
_TWO = np.array([[_class_of((lead & 31) << 6 | low) for low in range(64)] for lead in range(0xC2, 0xCA)], dtype=np.uint8)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U)


def classes(b: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    c = _ONE[b]
    high = np.flatnonzero(b >= 0xC2)
    if len(high):
        two = high[b[high] < 0xCA]
        c[two] = c[two + 1] = _TWO[b[two] - 0xC2, b[two + 1] & 63]
        three = high[b[high] == 0xE2]
        c[three] = c[three + 1] = c[three + 2] = np.where((b[three + 1] == 0x80) & (b[three + 2] >= 0x90) & (b[three + 2] <= 0xA7), OTHER, FOREIGN)
    return c


def piece_starts(b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Where the pattern's pieces begin in texts that each end with a STOP byte; that is a piece of its own. Two bytes at least follow the last."""
    start = np.empty(len(b), dtype=bool)
    start[0] = True
    np.not_equal(c[1:], c[:-1], out=start[1:])
    word = (c != SPACE) & (c != STOP)
    start[1:] &= ~((b[:-1] == 0x20) & word[1:])  # a space goes with what follows it
    start[:-1] |= (c[:-1] == SPACE) & word[1:]  # and is not part of the white space before it
    start |= c == STOP
    at = np.flatnonzero(b[:-3] == 0x27)
    at = at[start[at]]
    if len(at):
        one, two = b[at + 1], b[at + 2]
        short = (one == 0x73) | (one == 0x74) | (one == 0x6D) | (one == 0x64)  # 's 't 'm 'd
        long = (((one == 0x72) | (one == 0x76)) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))  # 're 've 'll
        start[at[short | long] + 1] = False
        start[at[short] + 2] = True
        start[at[long] + 3] = True
    return start


def _hash(first: np.ndarray, last: np.ndarray, size: np.ndarray) -> np.ndarray:
    x = first * U(0x9E3779B97F4A7C15) ^ (last + size.astype(U)) * U(0xD1342543DE82EF95)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """batch in slices of at most ROWS rows, and of BYTES in the column unless one row has more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = min(max(at + 1, int(np.searchsorted(ends, before + BYTES, side="right"))), at + ROWS)
        yield batch.slice(at, to - at)
        at = to


class _Pieces:
    """Ids of the pieces seen. Keys: first and last eight bytes and the length, so all of a piece of up to LONG bytes."""

    def __init__(self):
        self.first, self.last = np.zeros(KEEP + 1, dtype=U), np.zeros(KEEP + 1, dtype=U)
        self.size, self.hit = np.zeros(KEEP + 1, dtype=np.uint8), np.zeros(KEEP + 1, dtype=bool)
        self.at, self.count = np.zeros(KEEP + 1, dtype=np.int64), np.zeros(KEEP + 1, dtype=np.int64)
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self._empty()

    def _empty(self) -> None:
        self.n, self.used = 1, 0  # entry 0 is none
        self.slots = np.zeros(SLOTS, dtype=np.int32)

    def find(self, first: np.ndarray, last: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The entry of each key; 0: not there."""
        slot = (h % U(SLOTS)).astype(np.int64)
        out = self.slots[slot]
        open_ = np.flatnonzero((out > 0) & ((self.first[out] != first) | (self.last[out] != last) | (self.size[out] != size)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % SLOTS
            e = self.slots[slot[open_]]
            out[open_] = e
            open_ = open_[(e > 0) & ((self.first[e] != first[open_]) | (self.last[e] != last[open_]) | (self.size[e] != size[open_]))]
        self.hit[out] = True
        return out

    def _place(self, entries: np.ndarray) -> None:
        slot = (_hash(self.first[entries], self.last[entries], self.size[entries]) % U(SLOTS)).astype(np.int64)
        while len(entries):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = entries[free]
            lost = self.slots[slot] != entries
            entries, slot = entries[lost], (slot[lost] + 1) % SLOTS

    def add(self, first: np.ndarray, last: np.ndarray, size: np.ndarray, ids: list[list[int]]) -> bool:
        """Adds keys, at most KEEP / 4, that are not there and differ; whether others have other numbers now.

        A full table keeps the entries found again since it was last full.
        """
        full = self.n + len(ids) > KEEP
        if full:
            self._compact()
        new = np.arange(self.n, self.n + len(ids))
        count = np.array([len(x) for x in ids], dtype=np.int64)
        total = int(count.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], np.zeros(max(total, self.used // 2), dtype=np.uint32)))
        self.ids[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), dtype=np.uint32, count=total)
        self.first[new], self.last[new], self.size[new], self.hit[new], self.count[new] = first, last, size, False, count
        self.at[new] = self.used + np.cumsum(count) - count
        self.n, self.used = self.n + len(ids), self.used + total
        self._place(new.astype(np.int32))
        return full

    def _compact(self) -> None:
        keep = np.flatnonzero(self.hit[1 : self.n]) + 1
        if len(keep) > 3 * KEEP // 4:
            keep = keep[:0]
        values, ends = self.gather(keep)
        k = len(keep)
        for a in (self.first, self.last, self.size, self.count):
            a[1 : k + 1] = a[keep]
        self._empty()
        self.at[1 : k + 1], self.n, self.used = ends[:-1], k + 1, len(values)
        self.ids = np.concatenate((values, np.zeros(1 << 16, dtype=np.uint32)))
        self.hit[:] = False
        self._place(np.arange(1, k + 1, dtype=np.int32))

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the entries one after another, and where each one's begin; the end comes last."""
        count = self.count[entries]
        ends = np.concatenate(([0], np.cumsum(count)))
        return self.ids[np.repeat(self.at[entries] - ends[:-1], count) + np.arange(ends[-1])], ends


class Encoder:
    """Ids of texts, each followed by id 0."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model.tokenize
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.pieces, self.long = _Pieces(), {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _of_piece(self, piece: bytes) -> list[int]:
        """A piece is past the library's cutting; its model does the rest."""
        signs = piece.decode("ascii").replace(" ", SIGNS[32]) if piece.isascii() and piece[-1] > 32 else piece.decode("latin-1").translate(SIGNS)
        return [t.id for t in self.model(signs)]

    def _whole(self, text: bytes) -> np.ndarray:
        ids = self.library.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array([*ids, 0], dtype=np.uint32)

    def _plain(self, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of the texts) of texts that each end with a STOP byte."""
        b = np.frombuffer(blob + bytes(16), dtype=np.uint8)
        mask = piece_starts(b, classes(b))
        mask[len(blob) :] = False
        at = np.flatnonzero(mask)
        size = np.diff(at, append=len(blob))
        eight = np.ndarray(len(b) - 7, dtype="<u8", buffer=b, strides=(1,))
        first = eight[at] & _MASK[np.minimum(size, 8)]
        last = np.where(size > 8, eight[at + np.maximum(size - 8, 0)], U(0))
        parts = [self._ids(blob, *(x[i : i + GROUP] for x in (at, size, first, last))) for i in range(0, len(at), GROUP)]
        values = np.concatenate([v for v, _ in parts]) if parts else np.empty(0, dtype=np.uint32)
        ends = np.concatenate(([0], np.cumsum(np.concatenate([n for _, n in parts])))) if parts else np.zeros(1, dtype=np.int64)
        stops = np.flatnonzero(b[at] == 0)
        return values, np.concatenate(([0], ends[stops + 1]))

    def _ids(self, blob: bytes, at: np.ndarray, size: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces, how many each has)."""
        table, short, h = self.pieces, size <= LONG, _hash(first, last, size)
        entry = table.find(first, last, size, h)
        missing = np.flatnonzero((entry == 0) & short)
        while len(missing):
            one = missing[np.unique(h[missing], return_index=True)[1]]  # of several pieces with one hash, the others come in the next round
            new = [[0] if blob[s] == 0 else self._of_piece(blob[s : s + k]) for s, k in zip(at[one].tolist(), size[one].tolist(), strict=True)]
            if table.add(first[one], last[one], size[one], new):
                missing = np.flatnonzero(short)  # numbers of entries have changed
            entry[missing] = table.find(first[missing], last[missing], size[missing], h[missing])
            table.hit[table.n - len(new) : table.n] = False
            missing = missing[entry[missing] == 0]
        entry = np.where(short, entry, 0)
        values, ends = table.gather(entry)
        count = table.count[entry]
        if not short.all():
            of = np.flatnonzero(~short)
            found = [self._of_long(blob[s : s + k]) for s, k in zip(at[of].tolist(), size[of].tolist(), strict=True)]
            count[of] = [len(x) for x in found]
            values = np.insert(values, np.repeat(ends[of], count[of]), np.concatenate(found))
        return values, count

    def _of_long(self, piece: bytes) -> np.ndarray:
        ids = self.long.get(piece)
        if ids is None:
            if len(self.long) >= KEEP_LONG:
                self.long.clear()
            ids = self.long[piece] = np.array(self._of_piece(piece), dtype=np.uint32)
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): ids[offsets[i] : offsets[i + 1]] are text i's and 0. A null text has none but that."""
        got = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts.cast(pa.binary())]
        blob = b"\0".join([*got, b""])
        foreign = np.zeros(len(got), dtype=bool)
        odd = np.flatnonzero(classes(np.frombuffer(blob + bytes(2), dtype=np.uint8))[:-2] == FOREIGN)
        ends = np.cumsum([len(t) + 1 for t in got])
        if len(odd):
            foreign[np.unique(np.searchsorted(ends, odd, side="right"))] = True
        if blob.count(b"\0") != len(got) or any(a in blob for a in self.added):
            foreign |= [b"\0" in t or any(a in t for a in self.added) for t in got]
        if not foreign.any():
            return self._plain(blob)
        values, offsets = self._plain(b"\0".join([*(b"" if f else t for t, f in zip(got, foreign, strict=True)), b""]))
        parts = [self._whole(t) if f else values[a:e] for t, f, a, e in zip(got, foreign, offsets[:-1], offsets[1:], strict=True)]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
