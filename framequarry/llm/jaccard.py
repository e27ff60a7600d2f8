"""Exact n-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large ones.

A text's set holds hashes of its distinct five-word shingles (64 bits). Two sets that reach the
threshold t share the first tokens of a common order: the first n - ceil(t n) + c of a set of n
hold c common tokens with any partner. In the order, frequent tokens come last.

* Light sets (n up to a boundary) list every c-subset of that prefix, c = 2: few of them are shared
  by chance, but their number grows with the square of the prefix.
* Heavy sets put the single tokens of the prefix with c = 1 into inverted lists, as do the light
  sets large enough to have heavy partners. Lists are scanned for pairs.

The boundary is where the cost of the subsets, summed over all sets of a size, exceeds that of the
lists. A list is a tile, and lists with equal members are one, so a set has a row for each of its
lists, however long they are. Only a list of more than GRID sets is cut into runs.

In a tile, sets are held against each other by parity bitmaps: two sets differ in at least as many
tokens as their bitmaps in bits, so a pair with too many is no link. What is left is compared
exactly, in rounds; the links found join sets to components, and each round leaves out pairs
within one. So the pairs within a group of near copies are not written out.

1. A spanning forest of each tile, the likeliest pairs first; of a long one, forests of its blocks,
   each with the tile's middle set, so that the work grows with the list and not with its square.
2. The pairs across components that are left in short tiles; in long ones a forest of components.
3. What is left across components in long tiles, and between the runs of a list. There the sets
   outside the list's largest component are held against all, and those within it only against these.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import checked, collect, fresh, scratch, tidy, written

WORDS, PERCENT = 5, 80
BLOCK = 128  # sets held against each other at a time; a tile of more than two blocks is long
LEAST_BITS = 1024  # of a bitmap
TOP = 1 << 18  # frequent tokens that the order puts last; the order may be any, so this drops nothing
DOCS = 128  # texts that are cut at a time
CHUNK = 1_500_000  # tokens of which frequent ones are counted together
GRID = 4096  # a list of more sets is cut into runs of as many
MAX_LIGHT = 64
MAX_BITS = 1 << 28  # of the filter of the sets to be compared; past that it lets more through
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Words(dict):
    """word -> hash, of the words seen last; bounded."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingle_batch(texts: list[str | None], k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, offsets, names) of many texts: tokens[offsets[i] : offsets[i + 1]] is the sorted set of text i.

    A set holds hashes of the distinct k-word shingles; of fewer words, of the sequence; of none, nothing.
    A name is a signed 64-bit hash of a set; equal sets have equal names, and names count only together with sizes.
    """
    words = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER).split() for t in texts]
    count = np.array([len(w) for w in words], dtype=np.int64)
    ends = np.concatenate(([0], np.cumsum(count)))
    h = np.fromiter(map(_words.__getitem__, chain.from_iterable(words)), dtype=U, count=int(ends[-1]))
    size = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    off = np.concatenate(([0], np.cumsum(size)))
    tokens = np.empty(int(off[-1]), dtype=U)
    n = len(h) - k + 1
    long = count >= k
    if long.any():
        every = np.full(n, k, dtype=U)
        for i in range(k):
            every = _mix(every * U(0x9E3779B97F4A7C15) + h[i : i + n])
        shift = np.repeat(np.where(long, ends[:-1] - off[:-1], 0), size)
        at = np.flatnonzero(np.repeat(long, size))
        tokens[at] = every[at + shift[at]]
    for i in np.flatnonzero((count > 0) & ~long).tolist():
        x = np.full(1, count[i], dtype=U)
        for j in range(count[i]):
            x = _mix(x * U(0x9E3779B97F4A7C15) + h[ends[i] + j])
        tokens[off[i]] = x[0]
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        tokens[a:b].sort()
    keep = np.ones(len(tokens), dtype=bool)
    keep[1:] = tokens[1:] != tokens[:-1]
    some = size > 0
    keep[off[:-1][some]] = True
    off = np.concatenate(([0], np.cumsum(keep)))[off]
    tokens = tokens[keep]
    names = np.zeros(len(texts), dtype=np.int64)
    if some.any():
        x = _mix(tokens * U(0xD1342543DE82EF95) + U(1))
        starts = off[:-1][some]
        total = np.add.reduceat(x, starts) + np.diff(off)[some].astype(U)
        names[some] = _mix(total ^ np.bitwise_xor.reduceat(_mix(x), starts)).view(np.int64)
    return tokens, off, names


def bitmap_bits(n: np.ndarray) -> np.ndarray:
    """The number of parities kept of a set: a power of two, at least LEAST_BITS and twice the size, so that it tells differences of a ninth."""
    return np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))


def bitmaps(tokens: np.ndarray, off: np.ndarray, which: np.ndarray) -> list[bytes]:
    """Of each set in ``which``, whether an odd number of tokens end in i, for each i below its bitmap_bits."""
    size = np.diff(off)
    bits = bitmap_bits(size[which])
    out: list[bytes] = [b""] * len(which)
    for m in np.unique(bits).tolist():
        some = np.flatnonzero(bits == m)
        step = max(1, (1 << 20) // m)
        for a in range(0, len(some), step):
            part = some[a : a + step]
            sets = which[part]
            t = np.concatenate([tokens[off[i] : off[i + 1]] for i in sets])
            owner = np.repeat(np.arange(len(sets)), size[sets])
            odd = np.bincount(owner * m + (t & U(m - 1)).astype(np.int64), minlength=len(sets) * m) & 1
            for k, row in zip(part.tolist(), np.packbits(odd.astype(np.uint8).reshape(len(sets), m), axis=1), strict=True):
                out[k] = row.tobytes()
    return out


def folded(bits: bytes, size: int) -> bytes:
    """The bitmap of the same set with fewer parities: halves are added."""
    x = np.frombuffer(bits, dtype=np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tobytes()


def ceil_share(n: int, percent: int = PERCENT) -> int:
    return -(-percent * n // 100)


def _prefixes(tokens: list[np.ndarray], t: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the small sets of a chunk, by size: sizes, tokens of their prefixes, and the summed counts of those within the chunk."""
    small = [x for x in tokens if 0 < len(x) <= 2 * MAX_LIGHT]
    if not small:
        return (np.empty(0, np.int64),) * 3
    n = np.array([len(x) for x in small])
    count = c[np.searchsorted(t, np.concatenate(small))]
    by = np.lexsort((count, np.repeat(np.arange(len(n)), n)))
    rank = np.arange(len(by)) - np.repeat(np.cumsum(n) - n, n)
    length = n - (-(-PERCENT * n // 100)) + 1
    front = np.where(rank < np.repeat(length, n), count[by], 0)
    total = np.add.reduceat(front, np.cumsum(n) - n)
    sizes, of = np.unique(n, return_inverse=True)
    return sizes, np.bincount(of, weights=length).astype(np.int64), np.bincount(of, weights=total).astype(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document (kind 0: doc_id, n, name, place) and, of each chunk, the tokens in two sets or more (kind 1: token, count), itself (kind 2) and what ``_prefixes`` gives (kind 3)."""
    names = ["kind", "a", "b", "c", "d"]

    def rows(kind: int, *cols: np.ndarray) -> pa.RecordBatch:
        none = np.zeros(len(cols[0]), dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(none), kind, np.int32)), *[pa.array(x.astype(np.int64)) for x in [*cols, none, none, none, none][:4]]], names)

    def frequent(tokens: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        t = np.concatenate(tokens)
        t.sort()
        edge = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1], [True])))
        t, c = t[edge[:-1]], np.diff(edge)
        yield rows(1, t[c >= 2].view(np.int64), c[c >= 2])
        yield rows(2, np.zeros(1))
        yield rows(3, *_prefixes(tokens, t, c))

    tokens, held, seen = [], 0, set()
    for batch in batches:
        for at in range(0, batch.num_rows, DOCS):
            part = batch.slice(at, DOCS)
            t, off, name = shingle_batch(part.column(1).to_pylist())
            n = np.diff(off)
            for i, key in enumerate(zip(n.tolist(), name.tolist(), strict=True)):
                if key not in seen:
                    seen.add(key)
                    tokens.append(t[off[i] : off[i + 1]])
                    held += key[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), part.column(0), pa.array(n), pa.array(name), part.column(2)], names)
            if held > CHUNK:
                yield from frequent(tokens)
                tokens, held = [], 0
    if held:
        yield from frequent(tokens)
    _words.clear()
    tidy()


class Order:
    """The frequent tokens and their rough numbers of sets, and the boundary of light sets."""

    def __init__(self, tokens: np.ndarray, sets: np.ndarray, light: int = 0):
        by = np.argsort(tokens)
        self.tokens, self.sets, self.light = tokens[by], sets[by], light
        self.maybe = np.zeros(1 << 22, dtype=bool)  # most other tokens are told apart by their first bits
        self.maybe[(tokens >> U(42)).astype(np.int64)] = True

    def weight(self, tokens: np.ndarray) -> np.ndarray:
        out = np.zeros(len(tokens), dtype=np.int64)
        if len(self.tokens):
            look = np.flatnonzero(self.maybe[(tokens >> U(42)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.tokens, tokens[look]), len(self.tokens) - 1)
            out[look] = np.where(self.tokens[at] == tokens[look], self.sets[at], 0)
        return out

    def keys(self, s: np.ndarray, w: np.ndarray, name: int, percent: int = PERCENT) -> np.ndarray:
        """The lists that one set is put into, whatever its name; w: the weights of its tokens."""
        n = len(s)
        order = np.lexsort((s, w))
        slack, out = n - ceil_share(n, percent), []
        if n <= self.light:
            p = np.sort(order[: slack + 2])  # places, so in order of the tokens
            if len(p) >= 2:  # a set of one token has no partner but its equal
                i, j = np.triu_indices(len(p), 1)
                i, j = p[i], p[j]
                out.append(_mix(s[i] * U(0x9E3779B97F4A7C15) + _mix(s[j] + U(2))))
        if 100 * n > percent * self.light:  # may have a heavy partner, or is one
            out.append(s[order[: slack + 1]])
        return np.concatenate(out) if out else np.empty(0, dtype=U)

    def batch_keys(self, tokens: np.ndarray, off: np.ndarray, names: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, index of the set of each) of the wanted sets.

        Most sets are heavy and have enough infrequent tokens for their prefix: those, in order of their hashes.
        """
        n = np.diff(off)
        w = self.weight(tokens)
        owner = np.repeat(np.arange(len(n)), n)
        plain = w == 0
        before = np.concatenate(([0], np.cumsum(plain)))
        length = n - (-(-PERCENT * n // 100)) + 1
        simple = want & (n > self.light) & (before[off[1:]] - before[off[:-1]] >= length)
        rank = before[1:] - before[off[:-1]][owner]
        chosen = plain & simple[owner] & (rank <= length[owner])
        keys, of = [tokens[chosen]], [owner[chosen]]
        for i in np.flatnonzero(want & ~simple & (n > 0)).tolist():
            k = self.keys(tokens[off[i] : off[i + 1]], w[off[i] : off[i + 1]], int(names[i]))
            keys.append(k)
            of.append(np.full(len(k), i))
        return np.concatenate(keys), np.concatenate(of)


def boundary(sizes: dict[int, tuple[int, float]], percent: int = PERCENT) -> int:
    """The size up to which sets are light, from (size: (sets, mean number of sets on a list of their prefix)).

    A light set costs its subsets; a heavy one its prefix tokens and, for each, half of what stands on
    its list, since those are pairs to compare. Sizes just below the boundary pay for both.
    """
    def light(n: int) -> float:
        p = n - ceil_share(n, percent) + 2
        return p * (p - 1) / 2

    def heavy(n: int) -> float:
        return (n - ceil_share(n, percent) + 1) * (1 + sizes[n][1] / 2)

    best, least = 0, None
    for b in range(MAX_LIGHT + 1):
        cost = sum(sizes[n][0] * ((light(n) if n <= b else 0) + (heavy(n) if 100 * n > percent * b else 0)) for n in sizes if n <= 2 * MAX_LIGHT)
        if least is None or cost < least:
            best, least = b, cost
    return best


def _postings(order: Order):
    """Per distinct set of a task: its lists (key, name, n) and once its bitmap (key null, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                t, off, names = shingle_batch(batch.slice(at, DOCS).column(0).to_pylist())
                n = np.diff(off)
                want = np.zeros(len(n), dtype=bool)
                for i, key in enumerate(zip(n.tolist(), names.tolist(), strict=True)):
                    if key[0] and key not in seen:
                        seen.add(key)
                        want[i] = True
                keys, of = order.batch_keys(t, off, names, want)
                one = np.flatnonzero(want)
                bits = bitmaps(t, off, one)
                at_ = np.concatenate((of, one))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.array(keys.view(np.int64)), pa.nulls(len(one), pa.int64())]), pa.array(names[at_]), pa.array(n[at_].astype(np.int32)),
                        pa.concat_arrays([pa.nulls(len(of), pa.binary()), pa.array(bits, pa.binary())]),
                    ],
                    ["key", "name", "n", "bits"],
                )
        _words.clear()
        tidy()

    return run


def _tiles(grid: int):
    """From (key, name, n, bits) sorted by key, n, name: (t1, t2, list, m, name, n) of lists with two sets or more.

    A list ends where the next larger set is too large for a link, as if it were two. A tile is named by its members, so lists with the same members give the same tile. One of more than
    ``grid`` sets comes in runs, each with the middle set of all; there ``list`` names the whole, else it is
    null. m is the number of sets of a tile. Rows without a key, which bring a set's bitmap, are passed on.
    """
    names = ["t1", "t2", "list", "m", "name", "n", "bits"]

    def rows(t1, t2, whole, m, name, n) -> pa.RecordBatch:
        whole = pa.nulls(len(n), pa.int64()) if whole is None else pa.array(np.full(len(n), whole).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(t1.view(np.int64)), pa.array(t2.view(np.int64)), whole, pa.array(m.astype(np.int32)), pa.array(name), pa.array(n.astype(np.int32)), pa.nulls(len(n), pa.binary())], names)

    def of_lists(key: np.ndarray, name: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1]) | (n[1:] != n[:-1])
        key, name, n = key[new], name[new], n[new]
        if not len(key):
            return
        far = n[1:].astype(np.int64) * PERCENT > n[:-1].astype(np.int64) * 100  # sizes ascend: no pair across can reach the threshold
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | far)))
        count = np.diff(np.concatenate((first, [len(key)])))
        of = np.repeat(np.arange(len(first)), count)
        h = _mix(name.view(U) + n.astype(U) * U(0x9E3779B97F4A7C15))
        h2 = _mix(h + U(3))
        t1, t2 = np.add.reduceat(h, first), np.add.reduceat(h2, first)
        whole = (count[of] >= 2) & (count[of] <= grid)
        if whole.any():
            yield rows(t1[of][whole], t2[of][whole], None, count[of][whole], name[whole], n[whole])
        for i in np.flatnonzero(count > grid):
            a, b = first[i], first[i] + count[i]
            for x in range(a, b, grid):
                run = np.union1d(np.arange(x, min(x + grid, b)), [(a + b) // 2])
                full = lambda v: np.full(len(run), v)  # noqa: B023, E731
                yield rows(full(h[run].sum() ^ t1[i]), full(h2[run].sum() ^ t2[i]), t1[i] ^ _mix(t2[i : i + 1])[0], full(len(run)), name[run], n[run])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            extra = batch.column(0).is_null()
            if batch.column(0).null_count:
                b = batch.filter(extra)
                none = pa.nulls(len(b), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(b), pa.int32()), b.column(1), b.column(2), b.column(3)], names)
                batch = batch.filter(pc.invert(extra))
            cols = tuple(batch.column(i).to_numpy() for i in range(3))
            if rest is not None:
                cols = tuple(np.concatenate((r, c)) for r, c in zip(rest, cols, strict=True))
            if not len(cols[0]):
                continue
            cut = np.searchsorted(cols[0], cols[0][-1], side="left")  # the last list may go on in the next batch
            yield from of_lists(*(c[:cut] for c in cols))
            rest = tuple(c[cut:] for c in cols)
        if rest is not None:
            yield from of_lists(*rest)
        tidy()

    return run


class Bitmaps:
    """Of the sets of a tile: least(i, j), a number of tokens in which sets i and sets j differ at least, from sizes and bitmaps."""

    def __init__(self, n: np.ndarray, bits: list[bytes]):
        self.n, self.length = n.astype(np.int64), np.array([len(b) for b in bits])
        self.folds = {}  # Bitmaps of two lengths are compared at the shorter.
        for m in np.unique(self.length).tolist():
            long = self.length >= m
            x = np.frombuffer(b"".join(folded(bits[i], m) if len(bits[i]) > m else bits[i] for i in np.flatnonzero(long)), dtype=U)
            self.folds[m] = np.cumsum(long) - 1, np.ascontiguousarray(x.reshape(int(long.sum()), -1).T)

    def least(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.abs(self.n[i][:, None] - self.n[j][None, :])
        li, lj = self.length[i], self.length[j]
        for m, (at, x) in self.folds.items():
            a, b = np.flatnonzero(li >= m), np.flatnonzero(lj >= m)
            if not len(a) or not len(b) or (li[a] > m).all() and (lj[b] > m).all():
                continue
            one, other = at[i[a]], at[j[b]]
            differ = np.zeros((len(a), len(b)), dtype=np.int32)
            for word in x:
                differ += np.bitwise_count(word[one][:, None] ^ word[other][None, :])
            cells = np.ix_(a, b)
            out[cells] = np.where(np.minimum(li[a][:, None], lj[b][None, :]) == m, np.maximum(out[cells], differ), out[cells])
        return out

    def near(self, i: np.ndarray, j: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of a set of i and one of j that are not ruled out, the likeliest first; with j the same as i, each pair once.

        Sets that reach the threshold differ in at most (100 - percent) / (100 + percent) of their summed sizes.
        """
        least, both = self.least(i, j), self.n[i][:, None] + self.n[j][None, :]
        may = least * (100 + percent) <= both * (100 - percent)
        a, b = np.nonzero(np.triu(may, 1) if j is i else may)
        by = np.argsort(least[a, b] / both[a, b], kind="stable")
        return i[a[by]], j[b[by]]


def near_pairs(n: np.ndarray, bits: list[bytes], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the pairs i < j that sizes and bitmaps don't rule out, the likeliest first."""
    every = np.arange(len(n))
    return Bitmaps(n, bits).near(every, every, percent)


def _find(parent: dict[int, int], x: int) -> int:
    while (up := parent.get(x, x)) != x:
        parent[x] = parent.get(up, up)
        x = up
    return x


def forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], label: np.ndarray) -> np.ndarray:
    """Of pairs, which come in parts, those that join two components first; label, the sets' components, is changed."""
    out = []
    for i, j in pairs:
        while True:
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            if not len(i):
                break
            a, b = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
            of = np.sort(np.unique(np.stack((a, b), axis=1), axis=0, return_index=True)[1])
            parent: dict[int, int] = {}
            for k in of.tolist():  # one for each two components
                x, y = (_find(parent, int(z)) for z in (a[k], b[k]))
                if x != y:
                    parent[y] = x
                    out.append((i[k], j[k]))
            known, at = np.unique(label, return_inverse=True)
            label[:] = np.array([_find(parent, x) for x in known.tolist()], dtype=np.int64)[at]
    return np.array(out, dtype=np.int64).reshape(-1, 2)


def across(maps: Bitmaps, root: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The near pairs of sets of different components of a tile, in parts; two blocks of one component are not held against each other."""
    _, of, sets = np.unique(root, return_inverse=True, return_counts=True)
    order = np.lexsort((maps.n, root, sets[of]))
    blocks = [order[x : x + block] for x in range(0, len(order), block)]
    ends = [(root[b].min(), root[b].max(), maps.n[b].min(), maps.n[b].max()) for b in blocks]
    for p, x in enumerate(blocks):
        for q in range(p, len(blocks)):
            (r1, r2, lo, hi), (s1, s2, low, high) = ends[p], ends[q]
            if r1 == r2 == s1 == s2 or low * PERCENT > 100 * hi or lo * PERCENT > 100 * high:
                continue
            i, j = maps.near(x, x if p == q else blocks[q])
            apart = root[i] != root[j]
            if apart.any():
                yield i[apart], j[apart]


def _candidates(turn: int, block: int):
    """From (t1, t2, sid, n, bits[, root]) sorted by tile: pairs (a, b) of sid to be compared exactly in a round, a < b. The third takes all pairs across components."""

    def of_tile(rep: np.ndarray, n: np.ndarray, bits: list[bytes], root: np.ndarray) -> Iterator[np.ndarray]:
        if len(rep) < 2 or turn > 1 and (root == root[0]).all():
            return
        if len(rep) == 2:  # most tiles
            m, total = min(map(len, bits)), int(n[0]) + int(n[1])
            one, other = (int.from_bytes(folded(x, m) if len(x) > m else x) for x in bits)
            near = max((one ^ other).bit_count(), abs(int(n[0]) - int(n[1]))) * (100 + PERCENT) <= total * (100 - PERCENT)
            if near:
                yield np.sort(rep)[None]
            return
        maps, long = Bitmaps(n, bits), len(rep) > 2 * block
        if turn == 1:
            order = np.lexsort((rep, n))
            blocks = [np.union1d(order[x : x + block], order[len(order) // 2]) for x in range(0, len(order), block)] if long else [order]
            parent, joined = {}, []
            for x in blocks:
                for i, j in zip(*(y.tolist() for y in maps.near(x, x)), strict=True):
                    a, b = _find(parent, i), _find(parent, j)
                    if a != b:
                        parent[b] = a
                        joined.append((i, j))
            yield np.sort(rep[np.array(joined, dtype=np.int64).reshape(-1, 2)], axis=1)
        elif turn == 2 and long:
            yield np.sort(rep[forest(across(maps, root, block), root.copy())], axis=1)
        else:
            for i, j in across(maps, root, block):
                yield np.sort(np.stack((rep[i], rep[j]), axis=1), axis=1)

    def batch_of(pairs: list[np.ndarray]) -> pa.RecordBatch:
        p = np.unique(np.concatenate(pairs), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p[:, i])) for i in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last tile, which may go on in the next batch
        found, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            tile = np.stack([batch.column(i).to_numpy() for i in (0, 1)], axis=1)
            rep, n, bits = batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4).to_pylist()
            root = pc.coalesce(batch.column(5), batch.column(2)).to_numpy() if turn > 1 else rep
            edges = [0, *(np.flatnonzero((tile[1:] != tile[:-1]).any(axis=1)) + 1).tolist(), len(rep)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                now = tuple(tile[a].tolist())
                if held and held[0] == now:
                    held = (now, np.concatenate((held[1], rep[a:b])), np.concatenate((held[2], n[a:b])), held[3] + bits[a:b], np.concatenate((held[4], root[a:b])))
                    continue
                if held:
                    for pairs in of_tile(*held[1:]):
                        found.append(pairs)
                        size += len(pairs)
                        if size > 200_000:
                            yield batch_of(found)
                            found, size = [], 0
                held = (now, rep[a:b], n[a:b], bits[a:b], root[a:b])
        if held:
            for pairs in of_tile(*held[1:]):
                found.append(pairs)
                size += len(pairs)
                if size > 200_000:
                    yield batch_of(found)
                    found, size = [], 0
        if found:
            yield batch_of(found)
        del held, found
        tidy()

    return run


def _tokens(places: pa.Buffer, bits: int):
    """From (place, text): (name, n, tokens) of the distinct sets of a task whose place is in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = np.frombuffer(places, dtype=U), set()
        for batch in batches:
            place = batch.column(0).to_numpy().view(U) % U(bits)
            batch = batch.filter(pa.array((wanted[(place >> U(6)).astype(np.int64)] >> (place & U(63)) & U(1)).astype(bool)))
            for at in range(0, batch.num_rows, DOCS):
                t, off, names = shingle_batch(batch.slice(at, DOCS).column(1).to_pylist())
                n = np.diff(off)
                new = []
                for i, key in enumerate(zip(n.tolist(), names.tolist(), strict=True)):
                    if key not in seen:
                        seen.add(key)
                        new.append(i)
                sets = [t[off[i] : off[i + 1]].tobytes() for i in new]
                yield pa.RecordBatch.from_arrays([pa.array(names[new]), pa.array(n[new].astype(np.int64)), pa.array(sets, pa.binary())], ["name", "n", "tokens"])
        _words.clear()
        tidy()

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (a, b, sid, tokens) sorted so, of each pair the rows of a and those of b, one at least: the links (a, b) among them."""
    held: tuple | None = None
    for batch in batches:
        out = []
        for k in range(batch.num_rows):
            a, b, sid, t = (batch.column(c)[k].as_py() for c in range(4))  # one set at a time: a batch may be large
            if not held or held[:2] != (a, b):
                held = (a, b, sid, t)
            elif held[2] not in (None, sid):
                x, y = np.frombuffer(held[3], dtype=U), np.frombuffer(t, dtype=U)
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= PERCENT * (len(both) - common):
                    out.append((a, b))
                held = (a, b, None, b"")  # done; further rows of b repeat it
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])


def place_filter(places: DataFrame, rows: int) -> tuple[np.ndarray, int]:
    """A bitmap of the values of (place): about 16 bits a row, MAX_BITS at most. It lets through all of them, and of others about a share of rows / bits."""
    bits = 1 << max(10, min(MAX_BITS, 16 * rows).bit_length() - 1)
    slot = F.col("place").bitwiseAND(F.lit(bits - 1))
    words = places.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s").bitwiseAND(F.lit(63)).cast("int"))).alias("b")).toArrow()
    out = np.zeros(bits // 64, dtype=U)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(U)
    return out, bits


def compare(base: DataFrame, groups: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) of sid that are links, exactly.

    A bitmap of the places of the sets in a pair keeps other texts from being cut into sets; it is no
    larger than MAX_BITS whatever their number, and what it lets through is decided by the join. So texts are not moved, only sets.
    """
    with scratch(base.sparkSession):
        pairs = written(pairs.distinct(), f"pairs-{name}")
        ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("sid"))
        wanted = written(ends.select("sid").distinct().join(groups, "sid").select("sid", "name", "n", "place"), f"wanted-{name}")
        if not (count := wanted.count()):
            return base.sparkSession.createDataFrame([], "a bigint, b bigint")
        bitmap, bits = place_filter(wanted, count)
        sets = base.select("place", "text").mapInArrow(_tokens(pa.py_buffer(bitmap.tobytes()), bits), "name bigint, n bigint, tokens binary")
        sets = sets.join(checked(wanted.select("sid", F.col("name").alias("_name"), F.col("n").alias("_n"))), (F.col("name") == F.col("_name")) & (F.col("n") == F.col("_n")))
        both = ends.join(sets.select(F.col("sid").alias("_sid"), "tokens"), F.col("sid") == F.col("_sid")).select("a", "b", "sid", "tokens")
        return written(both.repartition("a", "b").sortWithinPartitions("a", "b", "sid").mapInArrow(_compared, "a bigint, b bigint"), f"links-{name}", keep=True)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of edges (a, b): root is the smallest node reached.

    Alternates large-star and small-star steps: every node's neighbours are linked to the smallest
    of them. The smallest are written before they are joined, so that a node with a great many
    neighbours is either met by a broadcast of known size or split like any skewed key.
    """
    with scratch(edges.sparkSession):
        e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")

        def smallest(rows: DataFrame) -> DataFrame:
            """(_u, m): the least neighbour or itself, for each u of rows (u, v)."""
            m = written(rows.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("_u"), F.least("u", "v").alias("m")), "least")
            return checked(m)

        last = None
        while True:
            both = e.union(e.select("b", "a")).toDF("u", "v")
            large = both.where("v > u").join(smallest(both), F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            large = written(large, "large")
            least = smallest(large)
            small = large.join(least, F.col("u") == F.col("_u"))
            e = written(small.select("v", "m").union(least.select("_u", "m")).toDF("a", "b").where("a <> b").distinct(), "edges")
            state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
            if state == last or not state[0]:
                break
            last = state
        roots = e.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
        return written(e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots), "roots", keep=True)


def cluster(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id per document.

    component_id is the smallest doc_id that links reach. A text without words is linked with nothing
    and has its own doc_id. Documents with the same set are linked, whatever their number; they
    stand for one set in the search. Repeated rows get a row each; rows of one doc_id with different texts are
    documents of their own. A document without doc_id links others all the same, and has their component, or null. An
    empty table gives an empty table; other columns are not used. Whole texts are
    read twice, and those of candidate pairs again; moved are the lists, and the sets of such pairs.
    """
    return _clustered(docs).drop("place")  # one narrow row per document


def _edges(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def runs_met(rows: DataFrame, grid: int) -> DataFrame:
    """(t1, t2, sid, n, bits, root): tiles in which all sets of a list meet that have different roots, from rows (list, sid, n, bits, root), stored.

    A set of the list's largest component has a row for every ``grid`` sets outside of it, and these a row for every ``grid``
    sets of the list. A list of one component has none.
    """
    rows = rows.select("list", "sid", "n", "bits", "root").dropDuplicates(["list", "sid"])
    sizes = rows.groupBy("list", "root").agg(F.count(F.lit(1)).alias("c"))
    cells = lambda c: F.ceil(c / F.lit(grid)).cast("int")
    most = F.max(F.struct("c", "root"))
    lists = sizes.groupBy(F.col("list").alias("_list")).agg(most["root"].alias("_most"), cells(most["c"]).alias("_in"), cells(F.sum("c") - most["c"]).alias("_out")).where("_out > 0")
    rows = rows.join(checked(written(lists, "lists")), F.col("list") == F.col("_list"))
    own = F.pmod(F.xxhash64("sid"), F.when(F.col("root") == F.col("_most"), F.col("_in")).otherwise(F.col("_out"))).cast("int")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    within = F.transform(upto("_out"), lambda k: F.xxhash64(F.lit("in"), F.col("_own"), k))
    against = F.transform(upto("_in"), lambda k: F.xxhash64(F.lit("in"), k, F.col("_own")))
    apart = F.transform(upto("_out"), lambda k: F.xxhash64(F.lit("out"), F.least(F.col("_own"), k), F.greatest(F.col("_own"), k)))
    met = F.when(F.col("root") == F.col("_most"), within).otherwise(F.concat(against, apart))
    return rows.withColumn("_own", own).select(F.col("list").alias("t1"), F.explode(met).alias("t2"), "sid", "n", "bits", "root")


def _place() -> Column:
    """Tells rows apart by doc_id and text; of rows with both equal, any stands for all."""
    return F.xxhash64(F.lit(11), F.col("doc_id").cast("long"), "text")


def _clustered(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    with scratch(docs.sparkSession):
        base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _place().alias("place"))
        found = written(base.mapInArrow(_sets, "kind int, a bigint, b bigint, c bigint, d bigint"), "sets")
        of_docs = found.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n"), F.col("c").alias("name"), F.col("d").alias("place"))
        groups = of_docs.where("n > 0").groupBy("n", "name").agg(F.min("doc_id").alias("rep"), F.min("place").alias("place"))
        groups = written(groups.withColumn("sid", F.monotonically_increasing_id()), "groups")
        postings = base.select("text").mapInArrow(_postings(order_of(found)), "key bigint, name bigint, n int, bits binary")
        lists = postings.repartition(F.coalesce("key", "name")).sortWithinPartitions("key", "n", "name")
        tiles = written(lists.mapInArrow(_tiles(GRID), "t1 bigint, t2 bigint, list bigint, m int, name bigint, n int, bits binary"), "tiles")
        collect(docs.sparkSession)
        sets = tiles.where("bits is not null").groupBy("name", "n").agg(F.first("bits").alias("bits"))
        sets = sets.join(groups.select("name", F.col("n").cast("int").alias("n"), "sid"), ["name", "n"])
        members = tiles.where("bits is null").select("t1", "t2", "list", "m", "name", "n").distinct()
        tiled = written(members.join(sets, ["name", "n"]).select("t1", "t2", "list", "m", "sid", "n", "bits"), "tiled")
        collect(docs.sparkSession)

        def found_in(rows: DataFrame, turn: int) -> DataFrame:
            rows = rows.repartition("t1", "t2").sortWithinPartitions("t1", "t2")
            return compare(base, groups, rows.mapInArrow(_candidates(turn, BLOCK), "a bigint, b bigint"), f"round{turn}")

        def known(rows: DataFrame) -> DataFrame:
            return rows.join(checked(roots), F.col("sid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "sid"))

        tile = ["t1", "t2", "sid", "n", "bits"]
        roots = components(found_in(tiled.select(*tile), 1))
        second = found_in(known(tiled).select(*tile, "root"), 2)
        roots = components(_edges(roots).union(second))
        long = tiled.where(F.col("list").isNotNull() | (F.col("m") > 2 * BLOCK))
        if not long.isEmpty():
            long = written(known(long), "long")
            third = found_in(long.where("list is null").select(*tile, "root").union(runs_met(long.where("list is not null"), GRID)), 3)
            roots = components(_edges(roots).union(third))
        linked = written(groups.join(roots, F.col("sid") == F.col("node")).select("n", "name", "rep", "root"), "linked")
        least = checked(written(linked.groupBy(F.col("root").alias("_root")).agg(F.min("rep").alias("least")), "least"))
        linked = linked.join(least, F.col("root") == F.col("_root")).select("n", "name", "least")
        alone = groups.join(roots, F.col("sid") == F.col("node"), "left_anti").select("n", "name", F.col("rep").alias("least"))
        of_sets = linked.union(alone).toDF("_n", "_name", "component_id")
        out = of_docs.join(of_sets, (F.col("n") == F.col("_n")) & (F.col("name") == F.col("_name")), "left")
        out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "place")
        return written(out, "clustered", keep=True)


def order_of(found: DataFrame) -> Order:
    """The order of tokens and the boundary, from the rows of ``_sets``.

    A token's sets are counted where it is in two or more of a chunk. If s sets are counted so in k
    chunks, a token spread evenly is in about the root of k s sets, which may be more.
    """
    chunks = found.where("kind = 2").count()
    top = found.where("kind = 1").groupBy("a").agg(F.sum("b").alias("sets")).orderBy(F.desc("sets"), "a").limit(TOP).toArrow()
    sets = top.column("sets").to_numpy().astype(np.float64)
    sets = np.maximum(sets, np.sqrt(chunks * sets)).astype(np.int64)
    sizes = found.where((F.col("kind") == 0) & F.col("b").between(1, 2 * MAX_LIGHT)).groupBy("b").agg(F.countDistinct("c").alias("sets")).collect()
    lists = {r["a"]: r["s"] / r["p"] for r in found.where("kind = 3").groupBy("a").agg(F.sum("b").alias("p"), F.sum("c").alias("s")).collect()}
    light = boundary({r["b"]: (r["sets"], lists.get(r["b"], 1.0)) for r in sizes})
    return Order(top.column("a").to_numpy().astype(np.int64).view(U), sets, light)


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the documents that have a smaller one in their component; all columns stay.

    Rows that repeat a kept doc_id with the same text are one; rows of one doc_id with different texts are
    judged each. A null doc_id is kept. An empty table gives an empty table.
    """
    got = _clustered(docs)
    gone, place = fresh(docs, "_fq_gone"), fresh(docs, "_fq_place")
    out_of = written(got.where("component_id < doc_id").select(F.col("place").alias(gone)).distinct(), "gone")
    kept = docs.withColumn(place, _place()).join(checked(out_of), F.col(place) == F.col(gone), "left_anti").drop(place)
    repeated = got.where("doc_id is not null").groupBy("place").count().where("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept
