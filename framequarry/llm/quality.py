"""Quality rules: robust multivariate outliers by minimum covariance determinant, per language and source.

Statistics of each text are turned into a vector. Of every (language, source), the estimate sought is
mean and covariance of the share of its rows whose covariance has the least determinant. From four
starts, C-steps (the rows of the smallest distances give the next mean and covariance) lower the
determinant; the start that came lowest goes on until no group gains, and the least determinant met
decides. A text is rejected if its Mahalanobis distance to that estimate is beyond a quantile that
follows from the distances of its group's bulk. All steps are aggregations over all rows; nothing is
sampled, and the driver sees no group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..ship import ship
from .common import checked, scratch, written

SYMBOLS = b"#*$%&|<>"
STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint, n_upper bigint, n_punct bigint, n_adjacent bigint"
NAMES = [x.split()[0] for x in STATS.split(", ")]
WINDOW = 8
P = 7
UPPER = bytes(range(0x41, 0x5B))
PUNCT = b"!?.,;:"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit value for each (the finalizer of splitmix64)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeat_words(ids: np.ndarray, doc: np.ndarray, docs: int, window: int = WINDOW) -> np.ndarray:
    """Per text, the words that lie in a window found twice or more in it. ids: number of each word; doc: its text, ascending."""
    if len(ids) < window:
        return np.zeros(docs, dtype=np.int64)
    with np.errstate(over="ignore"):
        v, n = _mixed(ids), len(ids) - window + 1
        key = _mixed(doc[:n])
        for k in range(window):
            key = key * np.uint64(0xD1342543DE82EF95) + v[k : k + n]
        key = _mixed(key)
    inside = doc[:n] == doc[window - 1 :]
    s = np.sort(key[inside])
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    starts = np.zeros(len(ids) + 1, dtype=np.int32)
    if len(twice):
        at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
        starts[1 : n + 1] = inside & (twice[at] == key)
    c = np.cumsum(starts)
    covered = c[1:] - np.concatenate((np.zeros(window, dtype=c.dtype), c[1:]))[: len(ids)] > 0
    return np.bincount(doc[covered], minlength=docs)


def text_stats(texts: list[str | None]) -> list[np.ndarray]:
    """The columns of STATS; null counts as a text without words."""
    rows, ids, lens, known = [], [], [], {}
    for t in texts:
        b = (t or "").encode("utf-8", "surrogatepass")
        words = b.split()  # bytes.split cuts at exactly space and \x09 to \x0d
        lines = [x for x in b.split(b"\n") if x.strip()]
        drop = lambda chars: len(b) - len(b.translate(None, chars))  # noqa: E731, B023
        rows.append((len(words), len(t or "") - drop(b" \t\n\r\x0b\x0c"), drop(SYMBOLS), len(lines), len(lines) - len(set(lines)), 0, drop(UPPER), drop(PUNCT), sum(map(eq, words, words[1:]))))
        ids.extend([known.setdefault(w, len(known)) for w in words])
        lens.append(len(words))
    cols = [np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * len(NAMES)
    if rows:
        cols[5] = repeat_words(np.array(ids, dtype=np.int64), np.repeat(np.arange(len(texts)), lens), len(texts)).astype(np.int64)
    return cols


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            cols = text_stats(part.column(part.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, cols)], [*part.schema.names[:-1], *NAMES])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and STATS of every whole text."""
    ship(docs.sparkSession)
    types = dict(docs.dtypes)
    keys = ["doc_id", "lang", "source"]
    return docs.select(*keys, "text").mapInArrow(_stats, ", ".join(f"{k} {types[k]}" for k in keys) + ", " + STATS)


def vector() -> list[Column]:
    """The transformed statistics: mean word length, and shares of symbols, repeated lines, repeated words, capitals, punctuation and words equal to the one before.

    A square root steadies shares near 0. Added counts draw short texts to the middle, since their
    shares vary most. Length itself is no sign of quality and is left out.
    """
    chars = F.col("word_chars") + F.lit(100.0)
    share = lambda c, n: F.sqrt(F.col(c) / n)
    return [
        F.log((F.col("word_chars") + F.lit(50.0)) / (F.col("n_words") + F.lit(10.0))),
        share("n_symbols", chars),
        share("n_dup_lines", F.col("n_lines") + F.lit(5.0)),
        share("n_repeat_words", F.col("n_words") + F.lit(50.0)),
        F.sqrt((F.col("n_upper") + F.lit(4.0)) / (F.col("word_chars") + F.lit(160.0))),
        F.sqrt((F.col("n_punct") + F.lit(4.0)) / (F.col("word_chars") + F.lit(160.0))),
        share("n_adjacent", F.col("n_words") + F.lit(50.0)),
    ]


def noise() -> list[Column]:
    """Of each coordinate, the variance that chance alone gives it in a text of this size.

    The root of a share c / n has variance k / 4n if counts come k at a time: symbols, repeated lines and equal neighbours one
    by one, repeated words by two windows or more. The other coordinates are 0 in no text and have a spread of their own;
    a hundredth stands for them, against groups of equal texts.
    """
    of = lambda c, more, k: F.lit(k / 4) / (F.col(c) + F.lit(float(more)))
    return [of("word_chars", 50, 0.01), of("word_chars", 100, 1), of("n_lines", 5, 1), of("n_words", 50, 2 * WINDOW), of("word_chars", 160, 0.01), of("word_chars", 160, 0.01), of("n_words", 50, 1)]


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


X = [f"_x{i}" for i in range(P)]
E = [f"_e{i}" for i in range(P)]
C, D = [f"_c{i}" for i in range(P)], [f"_d{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
G = ["_l", "_s"]
REST = "~"  # both keys of the rows whose own group is too small
FINE = 4096  # a coordinate's medians are read from counts of intervals of this part of 1
STEPS_PER_E = 256  # distances are counted in intervals of this part of their logarithm
MODEL = "_l string, _s string, _t int, _n double, _det double, " + ", ".join(f"_m{i} double" for i in range(P)) + ", " + ", ".join(f"_i{i}{j} double" for i, j in PAIRS)


def _sums(weight: Column) -> list[Column]:
    squares = [F.sum(weight * F.col(X[i]) * F.col(X[j])).alias(f"_q{i}{j}") for i, j in PAIRS]
    return [F.sum(weight).alias("_n"), *[F.sum(weight * F.col(X[i])).alias(f"_s{i}") for i in range(P)], *squares, *[F.sum(weight * F.col(e)).alias(e) for e in E]]


def chi2_quantile(p: float, df: int) -> float:
    """Wilson and Hilferty's approximation."""
    from statistics import NormalDist

    return df * (1 - 2 / (9 * df) + NormalDist().inv_cdf(p) * math.sqrt(2 / (9 * df))) ** 3


def _moments(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, covariance and mean noise of a row of ``_sums``."""
    n = r["_n"]
    m = np.array([r[f"_s{i}"] for i in range(P)]) / n
    c = np.zeros((P, P))
    for i, j in PAIRS:
        c[i, j] = c[j, i] = r[f"_q{i}{j}"] / n - m[i] * m[j]
    return m, c, np.array([r[e] for e in E]) / n


def _estimate(r: dict, t: int, m: np.ndarray, c: np.ndarray, noise: np.ndarray, scale: float) -> list:
    """A row of MODEL.

    A coordinate whose variance is below its noise (it is 0 in nearly all texts) has the noise
    for its variance and no covariance; all others have what was fitted. A thousandth off the
    correlations keeps a matrix of equal coordinates invertible. _det is the determinant's logarithm.
    """
    least = np.maximum(noise, 1e-9)
    c = c * scale
    few = np.diag(c) < least
    c[few, :] = c[:, few] = 0.0
    c = 0.999 * c + 0.001 * np.diag(np.diag(c))
    c[few, few] = least[few]
    inv = np.linalg.inv(c)
    return [r["_l"], r["_s"], t, float(r["_n"]), float(np.linalg.slogdet(c)[1]), *m.tolist(), *[float(inv[i, j]) for i, j in PAIRS]]


def _models(make) -> Column:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([x for r in f.to_dict("records") for x in make(r)], columns=[x.split()[0] for x in MODEL.split(", ")])

    return run


def _start_models(r: dict) -> list[list]:
    """The starts from one row of sums: of kind 0 the plain moments and, of medians alone, a diagonal; of kinds 2 and 3 the correlations of bounded coordinates."""
    m, c, noise = _moments(r)
    centre = np.array([r[x] for x in C])
    spread = np.array([r[x] for x in D])
    if r["_t"] == 0:
        return [_estimate(r, 0, m, c, noise, 1.0), _estimate(r, 1, centre, np.diag(spread**2), noise, 1.0)]
    sd = np.sqrt(np.maximum(np.diag(c), 1e-12))
    return [_estimate(r, r["_t"], centre, c / np.outer(sd, sd) * np.outer(spread, spread), noise, 1.0)]


def _step_models(scale: float):
    return lambda r: [_estimate(r, r["_t"], *_moments(r), scale)]


def _distance() -> Column:
    d = [F.col(X[i]) - F.col(f"_m{i}") for i in range(P)]
    return reduce(lambda a, b: a + b, [F.lit(1.0 if i == j else 2.0) * F.col(f"_i{i}{j}") * d[i] * d[j] for i, j in PAIRS])


def _quantile(counts: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """keys and, for each share, _q0, _q1 ...: the first interval _k by which that share of the counts _c is reached.

    A group has as many rows as intervals, whatever the number of texts.
    """
    upto = Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({"_u": F.sum("_c").over(upto), "_a": F.sum("_c").over(Window.partitionBy(*keys))})
    return counts.groupBy(*keys).agg(*[F.min(F.when(F.col("_u") >= F.ceil(F.lit(p) * F.col("_a")), F.col("_k"))).alias(f"_q{i}") for i, p in enumerate(shares)])


def _medians(rows: DataFrame, values: list[Column], names: list[str]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), F.floor(v * FINE).alias("_k")) for i, v in enumerate(values)]))
    counts = rows.select(*G, each.alias("_v")).select(*G, "_v.*").groupBy(*G, "_i", "_k").agg(F.count(F.lit(1)).alias("_c"))
    at = (F.col("_q0") + 0.5) / FINE
    return written(_quantile(counts, [*G, "_i"], [0.5]).groupBy(*G).agg(*[F.max(F.when(F.col("_i") == i, at)).alias(n) for i, n in enumerate(names)]), "medians")


def starts(rows: DataFrame) -> DataFrame:
    """Four estimates of each group, as MODEL: 0 plain moments; 1 medians and their deviations; 2 and 3 the same with the correlations of tanh and of the signs in space."""
    centre = checked(_medians(rows, [F.col(x) for x in X], C))
    near = rows.join(centre, G)
    off = checked(_medians(near, [F.abs(F.col(x) - F.col(c)) for x, c in zip(X, C, strict=True)], D))
    near = near.join(off.select(*G, *[(F.col(d) * 1.4826).alias(d) for d in D]), G)
    z = [(F.col(x) - F.col(c)) / F.greatest(F.col(d), F.sqrt(F.col(e)), F.lit(1e-6)) for x, c, d, e in zip(X, C, D, E, strict=True)]
    length = F.sqrt(reduce(lambda a, b: a + b, [v * v for v in z]) + 1e-12)
    kinds = [(0, [F.col(x) for x in X]), (2, [F.tanh(v) for v in z]), (3, [v / length for v in z])]
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("_t"), *[v.alias(x) for x, v in zip(X, vs, strict=True)]) for t, vs in kinds]))
    sums = near.select(*G, *C, *D, *E, each.alias("_v")).select(*G, *C, *D, *E, "_v.*").groupBy(*G, "_t").agg(*_sums(F.lit(1.0)), *[F.max(c).alias(c) for c in C + D])
    return written(sums.mapInPandas(_models(_start_models), MODEL), "starts")


def c_step(rows: DataFrame, model: DataFrame, share: float) -> DataFrame:
    """Of each model, that of the ``share`` of its group's rows with the smallest distances; the rows of the last interval count in part, all alike."""
    # what the covariance of the nearest share lacks against that of all, for a normal distribution of P coordinates
    scale = share / _chi2_cdf(chi2_quantile(share, P), P + 2)
    k = F.floor(F.log(F.least(F.greatest(_distance(), F.lit(1e-9)), F.lit(1e12))) * STEPS_PER_E).cast("int")
    d = rows.join(checked(model.drop("_n", "_det")), G).select(*G, "_t", *X, *E, k.alias("_k"))
    upto, need = Window.partitionBy(*G, "_t").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0), F.ceil(F.lit(share) * F.col("_a"))
    counts = d.groupBy(*G, "_t", "_k").agg(F.count(F.lit(1)).alias("_c")).withColumns({"_u": F.sum("_c").over(upto), "_a": F.sum("_c").over(Window.partitionBy(*G, "_t"))})
    last = counts.where((F.col("_u") >= need) & (F.col("_u") - F.col("_c") < need))
    edge = written(last.select(*G, "_t", F.col("_k").alias("_q0"), ((need - F.col("_u") + F.col("_c")) / F.col("_c")).alias("_w")), "edge")
    weight = F.when(F.col("_k") == F.col("_q0"), F.col("_w")).otherwise(F.lit(1.0))
    sums = d.join(checked(edge), [*G, "_t"]).where("_k <= _q0").groupBy(*G, "_t").agg(*_sums(weight))
    return written(sums.mapInPandas(_models(_step_models(scale)), MODEL), "model")


def least(models: DataFrame) -> DataFrame:
    """Of each group, the model of the least determinant."""
    best = models.groupBy(*G).agg(F.min_by(F.struct(*models.columns), F.struct("_det", "_t")).alias("_b"))
    return written(best.select("_b.*"), "least")


def fit(rows: DataFrame, share: float = 0.75, steps: int = 6) -> DataFrame:
    """The model of each group of rows (_l, _s, _x0 ..., _e0 ...): minimum covariance determinant of ``share`` of its rows.

    Two C-steps from each start, then up to ``steps`` from the least of them, as long as a group's
    determinant falls. _e0 ... are the coordinates' noise, 0 if not given.
    """
    ship(rows.sparkSession)
    with scratch(rows.sparkSession):
        rows = rows.withColumns({e: F.lit(0.0) for e in E if e not in rows.columns})
        first = c_step(rows, starts(rows), share)
        second = c_step(rows, first, share)
        best, now = least(first.union(second)), least(second)
        for _ in range(steps):
            now = c_step(rows, now, share)
            was, best = best, least(best.union(now))
            if not best.alias("b").join(was.select(*G, F.col("_det").alias("_was")), G).where("_det < _was - 1e-6").limit(1).count():
                break
        return written(best, "model", keep=True)


def limits(rows: DataFrame, model: DataFrame, tail: float) -> DataFrame:
    """model with _far, the largest squared distance that is no outlier, from the distances of the group's own rows.

    The cube root of a squared distance is near normal whatever the number of coordinates that count (Wilson and
    Hilferty). Its median and upper quartile, which a quarter of outliers does not move beyond those of the rest, give
    mean and deviation, and so the quantile that leaves ``tail``; the chi-squared one is the least.
    """
    from statistics import NormalDist

    k = F.floor(F.log(F.greatest(F.cbrt(F.greatest(_distance(), F.lit(0.0))), F.lit(1e-4))) * 2048)
    counts = rows.join(checked(model), G).select(*G, k.alias("_k")).groupBy(*G, "_k").agg(F.count(F.lit(1)).alias("_c"))
    mid, upper = (F.exp((F.col(q) + 0.5) / 2048) for q in ("_q0", "_q1"))
    z = NormalDist().inv_cdf(1 - tail) / NormalDist().inv_cdf(0.75)
    far = F.greatest(F.pow(mid + F.lit(z) * (upper - mid), F.lit(3.0)), F.lit(chi2_quantile(1 - tail, P)))
    return written(model.join(_quantile(counts, G, [0.5, 0.75]), G).select(*model.columns, far.alias("_far")), "limits")


def _chi2_cdf(x: float, df: int) -> float:
    """By the series of the lower incomplete gamma function."""
    a, h = df / 2, x / 2
    term = total = math.exp(a * math.log(h) - h - math.lgamma(a + 1)) if h > 0 else 0.0
    k = 1
    while term > 1e-16 * total:
        term *= h / (a + k)
        total += term
        k += 1
    return total


def judge(docs: DataFrame, tail: float = 5e-4, share: float = 0.75, steps: int = 6, min_rows: int = 100) -> DataFrame:
    """doc_id, STATS, base_failed, distance, kept for every document.

    base_failed: fewer than 20 words, or more than 30% of the words in repeated windows. Such texts
    are not fitted and not kept. Others are kept unless their distance is beyond the limit that leaves ``tail`` of
    their group's distances, as their bulk has them (``limits``); a distance at the limit is kept. ``tail`` is the share
    of regular texts that may be lost, a choice of policy. Null text has no words; null language and source are values
    of their own. Groups of fewer than ``min_rows`` fitted rows are one group; if even that has fewer than two rows a
    coordinate, they are not judged and kept, with a null distance. Repeated rows count each. Texts are read
    once and not shuffled; later steps use the statistics. Other columns are not used.
    """
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    stats = statistics(docs)
    rows = stats.select("doc_id", key("lang").alias("_a"), key("source").alias("_b"), *NAMES, base_failed().alias("base_failed"), *[v.alias(x) for x, v in zip(X + E, vector() + noise(), strict=True)])
    rows = written(rows, "stats")
    large = written(rows.where(~F.col("base_failed")).groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows).drop("_n").withColumn("_own", F.lit(True)), "large")
    own = lambda c: F.when(F.col("_own"), F.col(c)).otherwise(F.lit(REST))
    rows = rows.join(checked(large), ["_a", "_b"], "left").withColumns({"_l": own("_a"), "_s": own("_b")})
    fitted = rows.where(~F.col("base_failed")).select(*G, *X, *E)
    few = fitted.where(F.col("_l") == REST).limit(2 * P).count() < 2 * P
    if few:
        fitted = fitted.where(F.col("_l") != REST)
    model = limits(fitted, fit(fitted, share, steps), tail)
    out = rows.join(checked(model.drop("_n", "_t", "_det")), G, "left").withColumn("_d", _distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("_d") <= F.col("_far"), F.lit(True))
    return out.select("doc_id", *NAMES, "base_failed", F.when(F.col("_d").isNotNull(), F.sqrt(F.greatest("_d", F.lit(0.0)))).alias("distance"), kept.alias("kept"))
