"""The mosaic and RGB operators by numpy over stacks of frames of one size, for frames too large to explode.

Mosaics are (frames, height, width), RGB stacks (frames, height, width, 3), both INT32 with values of 16 bits.
Arithmetic types, clamps and cuts are those of the column operators.
"""

from __future__ import annotations

import functools

import numpy as np

from .demosaic import Plane

F32, TOP = np.float32, np.float32(65535)


def _cut(x: np.ndarray) -> np.ndarray:
    """Clamped and cut; NaN goes to 0, as in ``functions.numeric.clamp``."""
    return np.fmin(np.fmax(x, F32(0)), TOP).astype(np.int32)


def black(m: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """levels: (frames, 4), by phase."""
    out = m.copy()
    for k in range(4):
        y, x = divmod(k, 2)
        out[:, y::2, x::2] -= levels[:, k, None, None]
    return np.maximum(out, 0, out=out)


def mosaic_gains(m: np.ndarray, cfa: str, gains: np.ndarray) -> np.ndarray:
    """gains: (frames, 3) FLOAT for red, green, blue."""
    out = np.empty(m.shape, np.int32)
    for k, c in enumerate(cfa):
        y, x = divmod(k, 2)
        out[:, y::2, x::2] = _cut(m[:, y::2, x::2].astype(F32) * gains[:, {"R": 0, "B": 2}.get(c, 1), None, None].astype(F32))
    return out


def normalize(m: np.ndarray, white: np.ndarray, first_black: np.ndarray) -> np.ndarray:
    span = np.maximum(white - first_black, 0)
    scale = TOP / np.maximum(span, 1).astype(F32)
    scaled = np.minimum(m.astype(F32) * scale[:, None, None], TOP).astype(np.int32)
    return np.where(((span > 0) & (span < 65535))[:, None, None], scaled, m)


def bad_pixels(m: np.ndarray, threshold: float = 0.5, mode: str = "median") -> np.ndarray:
    """Samples far from the median of their same-colour neighbours get that median, or the neighbours' average."""
    wide = np.pad(m, ((0, 0), (2, 2), (2, 2)), constant_values=-1)
    h, w = m.shape[1:]
    around = np.stack([wide[:, 2 + dy : 2 + dy + h, 2 + dx : 2 + dx + w] for dy in (-2, 0, 2) for dx in (-2, 0, 2) if dx or dy])
    n = (around >= 0).sum(axis=0)
    total = np.where(around >= 0, around, 0).sum(axis=0)
    ranked = np.sort(np.where(around >= 0, around, 1 << 20), axis=0)
    pick = lambda k: np.take_along_axis(ranked, np.clip(k, 0, 7)[None], 0)[0]
    median = np.where(n == 0, 0, np.where(n % 2 == 1, pick(n // 2), (pick(n // 2 - 1) + pick(n // 2)) // 2))
    med = median.astype(F32)
    bad = (n > 0) & (med > 0) & (np.abs(m.astype(F32) - med) > F32(threshold) * med)
    return np.where(bad, median if mode == "median" else total // np.maximum(n, 1), m)


def bilinear(m: np.ndarray, cfa: str) -> np.ndarray:
    """Integer means; the edge is read left and above, 0 right and below."""
    wide = np.pad(np.pad(m, ((0, 0), (1, 0), (1, 0)), mode="edge"), ((0, 0), (0, 1), (0, 1)))
    h, w = m.shape[1:]
    at = lambda dx, dy: wide[:, 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    side, post = (at(-1, 0) + at(1, 0)) // 2, (at(0, -1) + at(0, 1)) // 2
    cross = (at(0, -1) + at(0, 1) + at(-1, 0) + at(1, 0)) // 4
    diagonal = (at(-1, -1) + at(1, -1) + at(-1, 1) + at(1, 1)) // 4
    out = np.empty((*m.shape, 3), np.int32)
    for k, c in enumerate(cfa):
        y, x = divmod(k, 2)
        s = (slice(None), slice(y, None, 2), slice(x, None, 2))
        red_row = "R" in cfa[2 * y : 2 * y + 2]
        out[(*s, 0)] = m[s] if c == "R" else diagonal[s] if c == "B" else (side if red_row else post)[s]
        out[(*s, 1)] = m[s] if c == "G" else cross[s]
        out[(*s, 2)] = m[s] if c == "B" else diagonal[s] if c == "R" else (post if red_row else side)[s]
    return out


def gains(rgb: np.ndarray, g: np.ndarray) -> np.ndarray:
    return _cut(rgb.astype(F32) * g[:, None, None, :].astype(F32))


def matrix(rgb: np.ndarray, m: np.ndarray) -> np.ndarray:
    """m: nine FLOAT, row by row, or (frames, 9); terms summed from the left."""
    r, g, b = (rgb[..., c].astype(F32) for c in range(3))
    t = m.T[..., None, None] if m.ndim > 1 else m
    return np.stack([_cut(r * t[3 * i] + g * t[3 * i + 1] + b * t[3 * i + 2]) for i in range(3)], axis=-1)


def _srgb(x: np.ndarray) -> np.ndarray:
    return np.where(x <= 0.0031308, x * 12.92, 1.055 * np.power(x, 1.0 / 2.4) - 0.055)


def _filmic(x: np.ndarray) -> np.ndarray:
    return (x * (0.15 * x + 0.05) + 0.004) / (x * (0.15 * x + 0.5) + 0.06) - 0.02 / 0.3


@functools.lru_cache(maxsize=64)
def tone_table(exposure: float | None) -> np.ndarray:
    gain = 1.0 if exposure is None else 2.0**exposure
    x = np.arange(65536) / 65535.0
    y = np.clip(_filmic(x * gain) / _filmic(np.array(max(gain, 1e-6))), 0.0, 1.0)
    return np.floor(_srgb(y) * 65535.0 + 0.5).astype(np.int32)


@functools.lru_cache(maxsize=64)
def gamma_table(g: float) -> np.ndarray:
    if abs(g - 1) < 0.001:
        return np.arange(65536, dtype=np.int32)
    return np.clip(np.power(np.arange(65536) / 65535.0, 1.0 / g) * 65535.0, 0, 65535).astype(np.int32)


def bilateral(rgb: np.ndarray, spatial: float, tonal: float, radius: int) -> np.ndarray:
    out = np.empty(rgb.shape, np.int32)
    two = 2 * tonal * tonal
    for c in range(3):
        v = rgb[..., c].astype(np.float64)
        p, inside = Plane(v, radius, "constant"), Plane(np.ones((1, *v.shape[1:])), radius, "constant")
        num, den = np.zeros(v.shape), np.zeros(v.shape)
        for dy in range(-radius, radius + 1):
            for dx in range(-radius, radius + 1):
                d = v - p(dx, dy)
                w = np.exp(-(dx * dx + dy * dy) / (2 * spatial * spatial)) * np.exp(-(d * d) / two) * inside(dx, dy)
                num, den = num + p(dx, dy) * w, den + w
        out[..., c] = np.floor(num / den + 0.5)
    return out


def resample(channel: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> np.ndarray:
    """(frames, h, w) at FLOAT places (h, w), clamped to the frame; four samples, rounded."""
    h, w = channel.shape[1:]
    sx, sy = np.clip(sx, F32(0), F32(w - 1)), np.clip(sy, F32(0), F32(h - 1))
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = sx - x0.astype(F32), sy - y0.astype(F32)
    p = lambda y, x: channel[:, y, x].astype(F32)
    top, low = p(y0, x0) * (F32(1) - fx) + p(y0, x1) * fx, p(y1, x0) * (F32(1) - fx) + p(y1, x1) * fx
    v = top * (F32(1) - fy) + low * fy
    return np.clip(np.floor(v.astype(np.float64) + 0.5), 0, 65535).astype(np.int32)


def aberration(rgb: np.ndarray, red: float, blue: float) -> np.ndarray:
    out = rgb.copy()
    h, w = rgb.shape[1:3]
    for c, scale in ((0, red), (2, blue)):
        if abs(scale - 1) < 1e-6:
            continue
        inv = F32(1) / F32(scale)
        along = lambda n: (F32(n) - F32(1)) * F32(0.5) + (np.arange(n, dtype=F32) - (F32(n) - F32(1)) * F32(0.5)) * inv  # noqa: B023, E731
        sx, sy = np.meshgrid(along(w), along(h))
        out[..., c] = resample(rgb[..., c], sx, sy)
    return out


def crop(rgb: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    return rgb[:, y : y + h, x : x + w] if x + w <= rgb.shape[2] and y + h <= rgb.shape[1] else rgb


def orient(rgb: np.ndarray, orientation: int) -> np.ndarray:
    """One frame (h, w, 3)."""
    swap, flip_x, flip_y = {2: (0, 1, 0), 3: (0, 1, 1), 4: (0, 0, 1), 5: (1, 0, 0), 6: (1, 1, 0), 7: (1, 1, 1), 8: (1, 0, 1)}.get(orientation, (0, 0, 0))
    out = rgb.transpose(1, 0, 2) if swap else rgb
    out = out[:, ::-1] if flip_x else out
    return out[::-1] if flip_y else out
