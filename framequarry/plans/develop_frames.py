"""RAW development of whole frames: one narrow pass over Arrow batches, no pixel rows and no shuffle.

The same chain as ``develop``, for frames that are large. Results are arrays; tone curves come from tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import arrays, lookup
from ..operators import demosaic as dm
from ..ship import ship
from .develop import Options

IN = ["img_id", "width", "height", "cfa", "white", "black", "exposure", "orientation", "neutral", "matrix", "data"]
STACK = 8_000_000  # samples of a stack
SMALL = 250_000  # pixels of one for the neighbourhoods in DOUBLE


def chain(m: np.ndarray, cfa: str, white: np.ndarray, black: np.ndarray, gain: np.ndarray, options: Options) -> np.ndarray:
    """RGB of a stack of mosaics, up to the demosaicing."""
    m = arrays.black(m, black)
    if options.bad_pixels:
        m = arrays.bad_pixels(m, 0.5, options.bad_pixels)
    m = arrays.normalize(arrays.mosaic_gains(m, cfa, gain), white, black[:, 0])
    if options.demosaic == "none":
        return np.repeat(m[..., None], 3, axis=-1)
    if options.demosaic == "bilinear":
        return arrays.bilinear(m, cfa)
    method = dm.resolve(options.demosaic)
    colour = dm.colours(dm.XTRANS if method in dm.TILED else cfa, *m.shape[1:])
    top = np.full(len(m), 65535) if options.rescale_white else white
    return np.stack(dm.METHODS[method](m.astype(np.float32), colour, top.astype(np.float32)[:, None, None]), axis=-1)


def coloured(rgb: np.ndarray, matrices: list, options: Options) -> np.ndarray:
    """The matrix of the options, or of each frame; a frame without one stays as it is."""
    if options.color_matrix:
        return arrays.matrix(rgb, np.array(options.color_matrix, np.float32))
    has = [i for i, m in enumerate(matrices) if m]
    if not has:
        return rgb
    out = rgb.copy()
    out[has] = arrays.matrix(rgb[has], np.array([matrices[i] for i in has], np.float32))
    return out


def finish(rgb: np.ndarray, options: Options) -> np.ndarray:
    step = max(1, SMALL // max(1, rgb.shape[1] * rgb.shape[2]))
    if (options.denoise_sigma or options.ca) and len(rgb) > step:
        return np.concatenate([finish(rgb[a : a + step], options) for a in range(0, len(rgb), step)])
    if options.denoise_sigma:
        s = options.denoise_sigma
        rgb = arrays.bilateral(rgb, s, s * 10000.0, -int(-2 * s // 1))
    return arrays.aberration(rgb, *options.ca) if options.ca else rgb


def _unfit(rows: dict, i: int, samples: int, options: Options) -> str | None:
    """Why a frame cannot be developed, or None."""
    w, h, black = (rows[k][i] for k in ("width", "height", "black"))
    if not (w and h) or samples != w * h:
        return "samples do not fill the frame"
    if options.demosaic not in ("none", "bilinear") and min(w, h) < dm.LEAST:
        return "frame under 6 x 6"
    return "no white or black levels" if rows["white"][i] is None or len(black or ()) != 4 or None in black else None


def _develop(options: Options, keep: tuple[str, ...], toned: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = dict(zip((*IN, *[k for k in keep if k not in IN]), batch.columns, strict=True))
            lists = c["data"]
            values, ends = pc.fill_null(lists.values, 0).to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            rows = {k: c[k].to_pylist() for k in IN if k not in ("data", "img_id")}
            n = batch.num_rows
            out: list = [None] * n
            errors = [_unfit(rows, i, ends[i + 1] - ends[i], options) for i in range(n)]
            groups: dict[tuple, list[int]] = {}
            for i in range(n):
                if errors[i] is None:
                    groups.setdefault((rows["width"][i], rows["height"][i], (rows["cfa"][i] or "")[:4].ljust(4, "?")), []).append(i)
            for (w, h, cfa), members in groups.items():
                step = max(1, STACK // (w * h))
                for a in range(0, len(members), step):
                    part = members[a : a + step]
                    m = np.stack([values[ends[i] : ends[i + 1]] for i in part]).reshape(len(part), h, w).astype(np.int32)
                    gain = np.array([_gains(rows["neutral"][i], options) for i in part], np.float32)
                    rgb = chain(m, cfa, np.array([rows["white"][i] for i in part]), np.array([rows["black"][i] for i in part], np.int32), gain, options)
                    if options.crop:
                        rgb = arrays.crop(rgb, *options.crop)
                    rgb = finish(coloured(rgb, [rows["matrix"][i] for i in part], options), options)
                    for one, i in zip(rgb, part, strict=True):
                        if toned:
                            table = arrays.tone_table(rows["exposure"][i]) if options.gamma is None else arrays.gamma_table(options.gamma)
                            one = arrays.orient(table[one], rows["orientation"][i])
                        out[i] = one
            sizes = [(None, None) if o is None else (o.shape[1], o.shape[0]) for o in out]
            yield pa.RecordBatch.from_arrays(
                [c["img_id"], *[pa.array([s[k] for s in sizes], pa.int32()) for k in (0, 1)], pa.array([None if o is None else np.ascontiguousarray(o).ravel() for o in out], pa.list_(pa.int32())), pa.array(errors, pa.string()), *[c[k] for k in keep]],
                ["img_id", "width", "height", "data", "error", *keep],
            )

    return run


def _gains(neutral: list[float] | None, options: Options) -> list[float]:
    if options.white_balance:
        return list(options.white_balance)
    if not neutral or not all(v is not None and v > 0 for v in neutral):
        return [1.0] * 3
    return [float(np.float32(1) / np.float32(v)) for v in neutral]


def develop_frames(frames: DataFrame, options: Options = Options(), keep: tuple[str, ...] = (), toned: bool = True, then: tuple[Callable, str] | None = None) -> DataFrame:
    """img_id, width, height, data (r, g, b in turn), error of frames as ``develop`` takes them, and the columns of ``keep``.

    Without ``toned`` they are as before the tone curve, not turned. ``then`` is what the same Python process does
    with the batches, and the columns that it makes after img_id; a step of its own would hold a process a task more.
    """
    ship(frames.sparkSession)
    c = lookup.cameras(frames.sparkSession).select("ordinal", lookup.camera_to_srgb(F.coalesce("cm2", "cm1")).cast("array<double>").alias("matrix"))
    f = frames.join(F.broadcast(c), F.col("camera") == F.col("ordinal"), "left").select(*IN, *[frames[k] for k in keep if k not in IN])
    more = "".join(f", {k} {dict(frames.dtypes)[k]}" for k in keep)
    run, made = _develop(options, keep, toned), f"width int, height int, data array<int>, error string{more}"
    if then:
        first, (last, made) = run, then
        run = lambda batches: last(first(batches))
    return f.mapInArrow(run, f"img_id {dict(frames.dtypes)['img_id']}, {made}")


def to_pixels(rgb: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pixel form: img_id, the columns of ``keep``, width, height, x, y, r, g, b."""
    p = rgb.where("error is null").select("img_id", *keep, "width", "height", "data", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i"))
    return p.select("img_id", *keep, "width", "height", (F.col("i") % F.col("width")).alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), *[F.element_at("data", F.col("i") * 3 + (k + 1)).alias(n) for k, n in enumerate("rgb")])
