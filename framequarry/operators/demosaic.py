"""Demosaicing by numpy over stacks of frames of one size: many small frames, or few large ones, a step.

Frames are rows (img_id, width, height, cfa, white, data, and for X-Trans optionally ``tile``); results
have r, g, b arrays or pixels. FLOAT throughout, sums in a fixed order. A frame under 6 x 6 gets
an ``error`` and no samples instead of stopping the job. Row bands of a large frame can be
rows, if they overlap by the reach of the method.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship

Stack = np.ndarray
LEAST = 6
ONE, HALF, QUARTER, TWO, EPS = (np.float32(v) for v in (1.0, 0.5, 0.25, 2.0, 1e-5))

# The standard 6 x 6 tile, row by row; 0 red, 1 green, 2 blue.
XTRANS = [
    [1, 2, 1, 1, 0, 1],
    [0, 1, 0, 2, 1, 2],
    [1, 2, 1, 1, 0, 1],
    [1, 0, 1, 2, 1, 2],
    [1, 2, 1, 1, 0, 1],
    [0, 1, 0, 2, 1, 2],
]


def colours(pattern: str | list[list[int]], height: int, width: int) -> np.ndarray:
    """0 red, 1 green, 2 blue, for each place; a 2 x 2 layout by name or any tile."""
    tile = np.array([["RGB".index(c) for c in pattern[:2]], ["RGB".index(c) for c in pattern[2:]]] if isinstance(pattern, str) else pattern)
    return tile[np.ix_(np.arange(height) % tile.shape[0], np.arange(width) % tile.shape[1])]


class Plane:
    """Shifted views of a stack whose edge is repeated (or 0 beyond it)."""

    def __init__(self, stack: Stack, reach: int, mode: str = "edge"):
        self.reach, (_, self.h, self.w) = reach, stack.shape
        self.padded = np.pad(stack, ((0, 0), (reach, reach), (reach, reach)), mode=mode)

    def __call__(self, dx: int, dy: int) -> Stack:
        r = self.reach
        return self.padded[:, r + dy : r + dy + self.h, r + dx : r + dx + self.w]


def directional(raw: Stack) -> tuple[Stack, Stack, Stack, Stack]:
    """Green estimates along rows and columns with the second derivative added, and both gradients."""
    p = Plane(raw, 2)
    out = []
    for step in (lambda k: p(k, 0), lambda k: p(0, k)):
        curve = TWO * raw - step(-2) - step(2)
        out.append(((step(-1) + step(1)) * HALF + curve * QUARTER, np.abs(step(-1) - step(1)) + np.abs(curve)))
    (gh, dh), (gv, dv) = out
    return gh, gv, dh, dv


def gradient_green(raw: Stack, is_green: np.ndarray) -> Stack:
    gh, gv, dh, dv = directional(raw)
    wh, wv = ONE / (dh + EPS), ONE / (dv + EPS)
    mixed = (wh * gh + wv * gv) / (wh + wv)
    chosen = np.where(dh < dv * HALF, gh, np.where(dv < dh * HALF, gv, mixed))
    return np.where(is_green, raw, np.maximum(chosen, np.float32(0)))


def spread(values: Stack, colour: np.ndarray, want: int, empty: float) -> Stack:
    """At every place the mean of ``values`` over the nearest places of a colour in the 2 x 2 layout; its own is kept.

    Opposite places take the four diagonals, greens the two beside or the two above and below. Places
    outside the frame do not count; with none left it is ``empty``.
    """
    here = (colour == want)[None]
    v, m = Plane(np.where(here, values, np.float32(0)), 1, "constant"), Plane(here.astype(np.float32), 1, "constant")

    def mean(*at: tuple[int, int]) -> Stack:
        total, count = v(*at[0]), m(*at[0])
        for a in at[1:]:
            total, count = total + v(*a), count + m(*a)
        return np.where(count > 0, total / np.maximum(count, ONE), np.float32(empty))

    same_row = (colour == want).any(axis=1)[:, None]
    beside, above, across = mean((-1, 0), (1, 0)), mean((0, -1), (0, 1)), mean((-1, -1), (1, -1), (-1, 1), (1, 1))
    green = (colour == 1)[None]
    return np.where(here, values, np.where(green, np.where(same_row, beside, above), across))


def _whole(x: Stack, white: Stack) -> np.ndarray:
    """Rounded half away from zero and clamped to 0..white."""
    return np.clip(np.floor(x.astype(np.float64) + 0.5), 0, white).astype(np.int32)


def amaze(raw: Stack, colour: np.ndarray, white: Stack) -> tuple[np.ndarray, ...]:
    green_here = (colour == 1)[None]
    green = gradient_green(raw, green_here)
    gh, gv, _, _ = directional(raw)
    gh, gv = np.where(green_here, raw, gh), np.where(green_here, raw, gv)
    n, h, w = raw.shape
    if h > 6 and w > 6:  # away from a border of three, homogeneity decides
        ph, pv, pr = Plane(gh, 1), Plane(gv, 1), Plane(raw, 1)
        hh, vh = np.zeros(raw.shape, np.int32), np.zeros(raw.shape, np.int32)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                eh = np.abs(ph(dx, dy) - pr(dx, dy)) + np.abs(ph(dx, dy) - gh)
                ev = np.abs(pv(dx, dy) - pr(dx, dy)) + np.abs(pv(dx, dy) - gv)
                hh += eh < ev
                vh += ev < eh
        wh, wv = (hh + 1).astype(np.float32), (vh + 1).astype(np.float32)
        refined = np.maximum(np.where(hh > vh + 1, gh, np.where(vh > hh + 1, gv, (wh * gh + wv * gv) / (wh + wv))), np.float32(0))
        inner = np.zeros((1, h, w), bool)
        inner[:, 3 : h - 3, 3 : w - 3] = True
        green = np.where(inner & ~green_here, refined, green)
    out = []
    for want in (0, 2):
        plane = np.where((colour == want)[None], raw, green + spread(raw - green, colour, want, 0.0))
        difference = plane - green
        d = Plane(difference, 1)
        around = [d(-1, 0), d(1, 0), d(0, -1), d(0, 1)]
        mean = (around[0] + around[1] + around[2] + around[3]) * QUARTER
        wild = np.abs(around[0] - mean) + np.abs(around[1] - mean) + np.abs(around[2] - mean) + np.abs(around[3] - mean)
        odd = np.abs(difference - mean) > wild * np.float32(1.5) + ONE
        inner = np.zeros((1, h, w), bool)
        inner[:, 2 : h - 2, 2 : w - 2] = True
        out.append(_whole(np.where(odd & inner, green + mean, plane), white))
    return out[0], _whole(green, white), out[1]


def lmmse(raw: Stack, colour: np.ndarray, white: Stack) -> tuple[np.ndarray, ...]:
    green_here = (colour == 1)[None]
    gh, gv, _, _ = directional(raw)
    gh, gv = (np.where(green_here, raw, np.clip(g, 0, white)) for g in (gh, gv))
    weights = []
    for g in (gh, gv):
        d = Plane(raw - g, 2)
        s = q = np.zeros(raw.shape, np.float32)
        for dy in range(-2, 3):
            for dx in range(-2, 3):
                s, q = s + d(dx, dy), q + d(dx, dy) * d(dx, dy)
        variance = (q - s * s / np.float32(25)) / np.float32(25)
        weights.append(ONE / (variance + EPS))
    green = np.where(green_here, raw, np.clip((weights[0] * gh + weights[1] * gv) / (weights[0] + weights[1]), 0, white))
    red, blue = (np.where((colour == c)[None], raw, np.clip(green + spread(raw - green, colour, c, 0.0), 0, white)) for c in (0, 2))
    return _whole(red, white), _whole(green, white), _whole(blue, white)


def rcd(raw: Stack, colour: np.ndarray, white: Stack) -> tuple[np.ndarray, ...]:
    green = gradient_green(raw, (colour == 1)[None])
    ratio = raw / np.maximum(green, ONE)
    red, blue = (np.where((colour == c)[None], raw, np.clip(green * spread(ratio, colour, c, 1.0), 0, white)) for c in (0, 2))
    return _whole(red, white), _whole(green, white), _whole(blue, white)


def weighted(values: Stack, colour: np.ndarray, want: int, reach: int, empty: Stack) -> Stack:
    """At places of other colours the mean over a colour in a square, by inverse squared distance; its own is kept."""
    here = (colour == want)[None]
    v, m = Plane(np.where(here, values, np.float32(0)), reach, "constant"), Plane(here.astype(np.float32), reach, "constant")
    total, weight = np.zeros(values.shape, np.float32), np.zeros((1, *values.shape[1:]), np.float32)
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            w = ONE / (np.float32(dx * dx + dy * dy) + np.float32(0.1))
            total, weight = total + v(dx, dy) * w, weight + m(dx, dy) * w
    return np.where(here, values, np.where(weight > 0, total / np.where(weight > 0, weight, ONE), empty))


def _cut(x: Stack, white: Stack) -> np.ndarray:
    return np.clip(x, 0, white).astype(np.int32)


def markesteijn(raw: Stack, colour: np.ndarray, white: Stack, passes: int = 1) -> tuple[np.ndarray, ...]:
    """With three passes, red and blue sites take the mean of their green and what the differences say, and all is done again."""
    green = weighted(raw, colour, 1, 2, raw)
    zero = np.zeros(1, np.float32)
    for last in (True,) if passes == 1 else (False, True):
        dr, db = (weighted(raw - green, colour, c, 3, zero) for c in (0, 2))
        if not last:
            for c, d in ((0, dr), (2, db)):
                green = np.where((colour == c)[None], (green + (raw - d)) * HALF, green)
    return _cut(green + dr, white), _cut(green, white), _cut(green + db, white)


def markesteijn3(raw: Stack, colour: np.ndarray, white: Stack) -> tuple[np.ndarray, ...]:
    return markesteijn(raw, colour, white, 3)


def xtrans_fast(raw: Stack, colour: np.ndarray, white: Stack) -> tuple[np.ndarray, ...]:
    """The plain mean of a colour in the smallest of three squares that has it."""
    out = []
    for want in (0, 1, 2):
        here = (colour == want)[None]
        v, m = Plane(np.where(here, raw, np.float32(0)), 3, "constant"), Plane(here.astype(np.float32), 3, "constant")
        result = raw
        for reach in (3, 2, 1):
            total, count = np.zeros(raw.shape, np.float32), np.zeros((1, *raw.shape[1:]), np.float32)
            for dy in range(-reach, reach + 1):
                for dx in range(-reach, reach + 1):
                    total, count = total + v(dx, dy), count + m(dx, dy)
            result = np.where(count > 0, total / np.maximum(count, ONE), result)
        out.append(_cut(np.where(here, raw, result), white))
    return tuple(out)


METHODS: dict[str, Callable] = {"amaze": amaze, "lmmse": lmmse, "rcd": rcd, "markesteijn": markesteijn, "markesteijn3": markesteijn3, "xtrans_fast": xtrans_fast}
TILED = {"markesteijn", "markesteijn3", "xtrans_fast"}
AUTO = "amaze"  # whatever the sensor


def resolve(method: str) -> str:
    method = AUTO if method == "auto" else method
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; known: {', '.join(METHODS)}, auto")
    return method


def _demosaic(method: str, tile: list[list[int]] | None):
    run_one = METHODS[method]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, widths, heights, cfas, whites = (batch.column(i).to_pylist() for i in range(5))
            lists = batch.column(5)
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            groups: dict[tuple, list[int]] = {}
            out: list[tuple | None] = [None] * len(ids)
            errors: list[str | None] = [None] * len(ids)
            for i, (w, h, c) in enumerate(zip(widths, heights, cfas, strict=True)):
                if lists[i].as_py() is None if lists.null_count else False:
                    errors[i] = "no samples"
                elif ends[i + 1] - ends[i] != w * h:
                    errors[i] = "samples do not fill the frame"
                elif w < LEAST or h < LEAST:
                    errors[i] = "frame under 6 x 6"
                else:
                    groups.setdefault((h, w, c), []).append(i)
            for (h, w, c), rows in groups.items():
                colour = colours((tile or XTRANS) if method in TILED else c, h, w)
                step = max(1, 4_000_000 // (h * w))  # bounds the memory of a stack
                for a in range(0, len(rows), step):
                    part = rows[a : a + step]
                    raw = np.stack([values[ends[i] : ends[i + 1]] for i in part]).reshape(len(part), h, w).astype(np.float32)
                    white = np.array([whites[i] for i in part], np.float32)[:, None, None]
                    rgb = run_one(raw, colour, white)
                    for k, i in enumerate(part):
                        out[i] = tuple(x[k].ravel() for x in rgb)
            planes = [pa.array([None if o is None else o[c] for o in out], pa.list_(pa.int32())) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *planes, pa.array(errors, pa.string())], ["img_id", "width", "height", "r", "g", "b", "error"])

    return run


def demosaic(frames: DataFrame, method: str = "auto", tile: list[list[int]] | None = None) -> DataFrame:
    """img_id, width, height, r, g, b (arrays), error per frame. No shuffle."""
    ship(frames.sparkSession)
    method = resolve(method)
    kind = dict(frames.dtypes)["img_id"]
    return frames.select("img_id", "width", "height", "cfa", "white", "data").mapInArrow(
        _demosaic(method, tile), f"img_id {kind}, width int, height int, r array<int>, g array<int>, b array<int>, error string"
    )


def to_pixels(rgb: DataFrame) -> DataFrame:
    """Pixel form of r, g, b arrays; frames with an error have no rows."""
    rest = [c for c in rgb.columns if c not in ("r", "g", "b", "error")]
    p = rgb.where("error is null").select(*rest, F.posexplode(F.arrays_zip("r", "g", "b")).alias("_i", "_p"))
    return p.select(*rest, (F.col("_i") % F.col("width")).alias("x"), F.floor(F.col("_i") / F.col("width")).cast("int").alias("y"), "_p.r", "_p.g", "_p.b")
