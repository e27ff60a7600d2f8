"""Planes of decoded video frames: rows with a stride to samples, and CMYK to RGB."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: (planes, bytes a sample) of the layouts.
LAYOUTS = {"NV12": (2, 1), "P010": (2, 2), "I420": (3, 1), "I010": (3, 2)}


def read_plane(data: bytes, stride: int, width: int, rows: int, sample: int = 1, shift: int = 0, bits: int = 8, channels: int = 1) -> list[np.ndarray]:
    """The channels of a plane: of each row the first width * channels samples, shifted and masked to their bits."""
    kind = np.dtype("<u2") if sample == 2 else np.dtype(np.uint8)
    n = width * channels * kind.itemsize
    if rows and len(data) < (rows - 1) * stride + n:
        raise ValueError("plane ends early")
    lines = np.stack([np.frombuffer(data, kind, width * channels, y * stride) for y in range(rows)]) if rows else np.zeros((0, width * channels), kind)
    v = lines.astype(np.int32)
    if sample == 2:
        v = (v >> shift) & (65535 if bits >= 16 else (1 << bits) - 1)
    return [v[:, c::channels].ravel() for c in range(channels)]


def frame_error(width: int, height: int, bits: int, layout: str, planes: list[tuple[int, int]]) -> str | None:
    """Why a frame of (stride, bytes) planes cannot be right, or None."""
    if width <= 0 or height <= 0:
        return "no size"
    if layout not in LAYOUTS:
        return "unknown layout"
    count, sample = LAYOUTS[layout]
    if (sample == 1) != (bits == 8) or bits not in (8, 10, 12):
        return "layout and bit depth do not fit"
    if len(planes) != count:
        return f"expected {count} planes"
    half = (width + 1) // 2
    for k, (stride, size) in enumerate(planes):
        row = sample * (width if k == 0 else 2 * half if count == 2 else half)
        rows = height if k == 0 else (height + 1) // 2
        if stride < row:
            return f"stride of plane {k} is too short"
        if size < (rows - 1) * stride + row:
            return f"plane {k} ends early"
    return None


def cmyk_to_rgb8(value: Column, key: Column) -> Column:
    """An inverted CMYK channel folded with its key, in whole numbers: value * key / 255, rounded."""
    p = value * key + F.lit(128)
    return F.shiftright(p + F.shiftright(p, 8), 8)
