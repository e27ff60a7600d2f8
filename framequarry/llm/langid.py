"""Language identification by hyperdimensional profiles.

Every letter has a random vector of signs. An n-gram of letters is bound into one vector: each
letter's vector is rotated by its place and they are multiplied. A text is the bundle (sum) of its
n-grams' vectors, a language the bundle of its texts', and a text goes to the language of the largest
cosine. White space and whatever is not a letter is one sign, so n-grams see the ends of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import tidy

DIMS, N, SEED = 512, 3, 20240229
MAX_LANGUAGES = 4096
BATCH = 128
#: A worker keeps vectors of this many n-grams before it starts anew.
KEEP = 40_000
_spaces: dict[tuple[int, int], Space] = {}


class Space:
    """Letters, n-grams and their vectors, as far as a worker has seen them. All follow from the seed alone."""

    def __init__(self, dims: int = DIMS, seed: int = SEED):
        self.dims, self.seed = dims, seed
        self.index = np.full(0x110000, -1, dtype=np.int32)  # code point -> number of its letter
        self.letters = [self._letter(0x20)]
        self.grams: dict[int, int] = {}
        self.vectors = np.empty((KEEP, dims), dtype=np.int8)

    @classmethod
    def of(cls, dims: int, seed: int) -> Space:
        return _spaces.setdefault((dims, seed), cls(dims, seed))

    def _letter(self, code: int) -> np.ndarray:
        return np.random.default_rng([self.seed, code]).integers(0, 2, self.dims, dtype=np.int8) * 2 - 1

    def numbers(self, text: str) -> np.ndarray:
        """A letter's number per place, 0 for anything else; runs of 0 are one, and both ends have one."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        x = self.index[codes]
        if (x < 0).any():
            for c in np.unique(codes[x < 0]).tolist():
                if chr(c).isalpha():
                    self.index[c] = len(self.letters)
                    self.letters.append(self._letter(c))
                else:
                    self.index[c] = 0
            x = self.index[codes]
        keep = np.ones(len(x) + 2, dtype=bool)
        x = np.concatenate(([0], x, [0]))
        keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
        return x[keep]

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """n-gram codes of the texts, and for each place of all texts the text and the n-gram's index."""
        owners, codes = [], []
        for i, t in enumerate(texts):
            x = self.numbers(t or "").astype(np.int64)
            if len(x) >= N:
                code = np.zeros(len(x) - N + 1, dtype=np.int64)
                for k in range(N):
                    code = (code << 21) | x[k : len(x) - N + 1 + k]
                owners.append(np.full(len(code), i, dtype=np.int64))
                codes.append(code)
        if not codes:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        code = np.concatenate(codes)
        small = len(self.letters)
        if small <= 160:  # a table of all n-grams is shorter than sorting them
            at = np.zeros(len(code), dtype=np.int64)
            for k in range(N):
                at = at * small + ((code >> (21 * (N - 1 - k))) & 0x1FFFFF)
            seen = np.zeros(small**N, dtype=bool)
            seen[at] = True
            found = np.flatnonzero(seen)
            rank = np.cumsum(seen, dtype=np.int32)
            inverse = rank[at] - 1
            unique, rest = np.zeros(len(found), dtype=np.int64), found.copy()
            for k in range(N):
                unique |= (rest % small) << (21 * k)
                rest //= small
        else:
            unique, inverse = np.unique(code, return_inverse=True)
        return unique, np.concatenate(owners), inverse

    def bound(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of n-grams, one a row."""
        if len(codes) > KEEP:
            return np.concatenate([self.bound(codes[i : i + KEEP]) for i in range(0, len(codes), KEEP)])
        rows = [self.grams.get(c, -1) for c in codes.tolist()]
        new = [i for i, r in enumerate(rows) if r < 0]
        if new:
            if len(self.grams) + len(new) > KEEP:
                self.grams.clear()
                rows, new = [-1] * len(codes), list(range(len(codes)))
            table, made = np.array(self.letters), None
            for k in range(N):
                letter = (codes[new] >> (21 * (N - 1 - k))) & 0x1FFFFF
                turned = np.roll(table, N - 1 - k, axis=1)[letter]
                made = turned if made is None else made * turned
            first = len(self.grams)
            self.vectors[first : first + len(new)] = made
            for j, i in enumerate(new):
                self.grams[int(codes[i])] = rows[i] = first + j
        return self.vectors[rows]

    def bundles(self, texts: list[str | None]) -> np.ndarray:
        """A row per text: the sum of its n-grams' vectors."""
        unique, owner, gram = self.counts(texts)
        out = np.zeros((len(texts), self.dims), dtype=np.float32)
        for a in range(0, len(unique), 8192):
            b = min(a + 8192, len(unique))
            here = slice(None) if len(unique) <= 8192 else (gram >= a) & (gram < b)
            table = np.bincount(owner[here] * (b - a) + gram[here] - a, minlength=len(texts) * (b - a)).reshape(len(texts), b - a)
            out += table.astype(np.float32) @ self.bound(unique[a:b]).astype(np.float32)
        return out


def _chunks(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


def _partial(dims: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space.of(dims, seed), {}
        for batch in batches:
            for part in _chunks(batch, BATCH):
                texts, langs = part.column(0).to_pylist(), part.column(1).to_pylist()
                of = {x: i for i, x in enumerate(dict.fromkeys(langs))}
                unique, owner, gram = space.counts(texts)
                if not len(unique):
                    continue
                where = np.array([of[x] for x in langs])[owner]
                table = np.bincount(where * len(unique) + gram, minlength=len(of) * len(unique)).reshape(len(of), -1)
                made = table.astype(np.float64) @ space.bound(unique).astype(np.float64)
                for x, i in of.items():
                    sums[x] = sums.get(x, 0) + made[i]
        if sums:
            langs = sorted(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(langs, dims).tolist()), pa.array(np.tile(np.arange(dims), len(langs)), pa.int32()), pa.array(np.concatenate([sums[x] for x in langs]).round().astype(np.int64))],
                ["lang", "dim", "v"],
            )
        tidy()

    return run


def learn(labelled: DataFrame, dims: int = DIMS, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes from all rows of (text, lang); rows without text or lang teach nothing.

    Each task sends one vector a language; they are summed in the JVM. The driver gets dims numbers
    a language, of at most MAX_LANGUAGES. The sums are whole numbers, so the order of tasks doesn't matter.
    """
    ship(labelled.sparkSession)
    rows = labelled.where("text is not null and lang is not null").select("text", "lang").mapInArrow(_partial(dims, seed), "lang string, dim int, v bigint")
    got = rows.groupBy("lang", "dim").agg(F.sum("v").alias("v")).limit(MAX_LANGUAGES * dims + 1).collect()
    if len(got) > MAX_LANGUAGES * dims:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted({r["lang"] for r in got})
    at, protos = {x: i for i, x in enumerate(langs)}, np.zeros((len(langs), dims))
    for r in got:
        protos[at[r["lang"]], r["dim"]] = r["v"]
    return langs, protos


def _judge(langs: list[str], protos: np.ndarray, dims: int, seed: int):
    norm = np.linalg.norm(protos, axis=1, keepdims=True)
    unit = (protos / np.where(norm == 0, 1, norm)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space.of(dims, seed)
        for batch in batches:
            pred, score, second = [], [], []
            for part in _chunks(batch, BATCH):
                texts = part.column(batch.num_columns - 1).to_pylist()
                b = space.bundles(texts)
                size = np.linalg.norm(b, axis=1)
                cos = np.clip(b @ unit.T / np.where(size == 0, 1, size)[:, None], 0, 1) if langs else np.zeros((len(texts), 1))
                best = cos.argmax(axis=1)
                top = np.sort(cos, axis=1)
                for i in range(len(texts)):
                    ok = bool(langs) and size[i] > 0
                    pred.append(langs[best[i]] if ok else "und")
                    score.append(float(cos[i, best[i]]) if ok else 0.0)
                    second.append(float(top[i, -2]) if ok and len(langs) > 1 else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(second, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score", "second"])

    return run


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of the id as text leaves 1 modulo 3. A null id is not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def identify(docs: DataFrame, langs: list[str], protos: np.ndarray, dims: int = DIMS, seed: int = SEED) -> DataFrame:
    """doc_id, held_out, lang_pred, score (cosine, 0 to 1), second (that of the next language) per row.

    The whole text alone decides. A text that is null, or has no letter, is ``und`` with score 0.
    Repeated rows get a row each; no shuffle. Other columns are not used.
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_judge(langs, protos, dims, seed), "doc_id bigint, held_out boolean, lang_pred string, score double, second double")


def learn_from(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    return learn(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))


def predict(docs: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out, and identifies all."""
    return identify(docs, *learn_from(docs))


def _keep(langs: list[str], protos: np.ndarray, dims: int, seed: int, at: int, least: float, letters: int):
    judge = _judge(langs, protos, dims, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, BATCH):
                text = part.column(at)
                (got,) = judge(iter([pa.RecordBatch.from_arrays([text], ["text"])]))
                pred, score = got.column(0).to_pylist(), got.column(1).to_pylist()
                far = [s < least and sum(map(str.isalpha, t or "")) >= letters for t, s in zip(text.to_pylist(), score, strict=True)]
                yield part.filter(pa.array([p != "und" and not f for p, f in zip(pred, far, strict=True)], pa.bool_()))
        tidy()

    return run


def keep_known(docs: DataFrame, least: float = 0.1, letters: int = 200) -> DataFrame:
    """docs, all columns, without the documents whose language is not known.

    Rejected are texts that are null or have no letter, and texts of at least ``letters`` letters whose
    largest cosine is below ``least``: they are like none of the languages learned here. A short text
    can be far from all, so its score rejects nothing. Where no language was learned, nothing with a
    letter can be judged and only texts without a letter go. No shuffle.
    """
    langs, protos = learn_from(docs)
    if not langs:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return docs.mapInArrow(_keep(langs, protos, DIMS, SEED, docs.columns.index("text"), least, letters), docs.schema)
