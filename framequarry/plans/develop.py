"""RAW development: the fixed chain from mosaic to sRGB, and its option for frames that need no demosaicing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import demosaic as dm
from ..operators import geometry, lookup, pointwise, stencil


@dataclass(frozen=True)
class Options:
    """What a development may choose; None leaves a step to the metadata, or out.

    rescale_white lets demosaicing clamp to the scaled white level; by default it clamps to the unscaled one.
    """

    demosaic: str = "auto"
    white_balance: tuple[float, float, float] | None = None
    color_matrix: tuple[float, ...] | None = None
    gamma: float | None = None
    bad_pixels: str | None = None
    denoise_sigma: float | None = None
    ca: tuple[float, float] | None = None
    crop: tuple[int, int, int, int] | None = None
    rescale_white: bool = False


def to_array(p: DataFrame, values: list[str], keep: list[str]) -> DataFrame:
    """Array form of pixels: data holds the values in turn. One shuffle by frame; only stencils after pixel steps need it."""
    rows = F.array_sort(F.collect_list(F.struct((F.col("y") * F.col("width") + F.col("x")).alias("i"), F.array(*values).alias("v"))))
    first = [F.first(c, ignorenulls=False).alias(c) for c in keep]
    g = p.groupBy("img_id", "width", "height").agg(*first, rows.alias("_d"))
    return g.withColumn("data", F.flatten(F.transform("_d", lambda s: s["v"]))).drop("_d")


def _array_black(frames: DataFrame) -> DataFrame:
    """Black level over the array: no pixel leaves its frame, so nothing is shuffled."""
    def one(v, i):
        x, y = i % F.col("width"), F.floor(i / F.col("width")).cast("int")
        return F.greatest(v - F.element_at("black", (y % 2) * 2 + x % 2 + 1), F.lit(0))

    return frames.withColumn("data", F.transform("data", one))


def _array_scaled(frames: DataFrame, gains) -> DataFrame:
    """Mosaic white balance and normalisation over the array, with the clamps and cuts of each."""
    from ..functions.numeric import U16, f32, trunc_u16

    span = F.greatest(F.col("white") - F.element_at("black", 1), F.lit(0))
    letter = lambda i: F.col("cfa").substr((F.floor(i / F.col("width")).cast("int") % 2) * 2 + (i % F.col("width")) % 2 + F.lit(1), F.lit(1))

    def one(v, i):
        if gains is not None:
            c = letter(i)
            v = trunc_u16(f32(v) * F.when(c == "R", f32(gains[0])).when(c == "B", f32(gains[2])).otherwise(f32(gains[1])))
        scaled = F.least(f32(v) * f32(f32(float(U16)) / f32(F.greatest(span, F.lit(1)))), f32(float(U16))).cast("int")
        return F.when((span > 0) & (span < U16), scaled).otherwise(v)

    return frames.withColumn("data", F.transform("data", one))


def neutral_gains(options: Options):
    if options.white_balance:
        return [F.lit(float(g)) for g in options.white_balance]
    ok = (F.col("neutral")[0] > 0) & (F.col("neutral")[1] > 0) & (F.col("neutral")[2] > 0)
    return [F.coalesce(F.when(ok, (F.lit(1.0) / F.col("neutral")[i].cast("float")).cast("float")), F.lit(1.0).cast("float")) for i in range(3)]


def develop(frames: DataFrame, options: Options = Options()) -> DataFrame:
    """Pixel form r, g, b of frames with cfa, black, white, neutral, camera, exposure and orientation.

    Black level, bad pixels, mosaic white balance, normalisation, demosaicing, crop, matrix, denoising,
    aberration, tone, orientation. The chain up to the demosaicing stays in arrays; after it pixels
    are plain columns. With a neighbourhood beside the demosaicing, all up to the tone curve is one pass over
    whole frames, so nothing is shuffled. A frame whose camera is unknown, or has a singular matrix, skips the matrix.
    """
    keep = ["img_id", "exposure", "orientation", "camera"]
    if options.bad_pixels or options.denoise_sigma or options.ca:
        from .develop_frames import develop_frames, to_pixels

        rest = tuple(keep[1:])
        return toned(to_pixels(develop_frames(frames, options, rest, toned=False), rest), options)
    f = _array_scaled(_array_black(frames), neutral_gains(options))
    if options.demosaic == "bilinear":
        p = stencil.bilinear_demosaic(f).select(*keep, "width", "height", "x", "y", "r", "g", "b")
    elif options.demosaic == "none":
        from ..sources.derived import pixels

        p = pointwise.no_demosaic(pixels(f)).select(*keep, "width", "height", "x", "y", "r", "g", "b")
    else:
        white = F.lit(65535) if options.rescale_white else F.col("white")
        rgb = dm.demosaic(f.withColumns({"white": white, "img_id": F.struct(*keep)}), options.demosaic)
        p = dm.to_pixels(rgb).select("img_id.*", "width", "height", "x", "y", "r", "g", "b")
    return finish(p, options)


def finish(p: DataFrame, options: Options) -> DataFrame:
    """From the crop on, for pixels that carry exposure, orientation and camera (an ordinal of the table)."""
    if options.crop:
        p = geometry.crop(p, *options.crop)
    if options.color_matrix:
        p = pointwise.color_matrix(p, list(options.color_matrix))
    else:
        c = lookup.cameras(p.sparkSession).select("ordinal", lookup.camera_to_srgb(F.coalesce("cm2", "cm1")).alias("_m"))
        p = p.join(F.broadcast(c), F.col("camera") == F.col("ordinal"), "left").drop("ordinal")
        matrixed = pointwise.color_matrix(p.withColumns({f"_{c}": F.col(c) for c in "rgb"}), [F.col("_m")[i] for i in range(9)])
        p = matrixed.withColumns({c: F.when(F.col("_m").isNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in "rgb"}).drop("_m", "_r", "_g", "_b")
    if options.denoise_sigma or options.ca:
        rest = ["exposure", "orientation", "camera"]
        if options.denoise_sigma:
            s = options.denoise_sigma
            p = stencil.bilateral(to_array(p, ["r", "g", "b"], rest), s, s * 10000.0, -int(-2 * s // 1))
        if options.ca:
            p = stencil.chromatic_aberration(to_array(p, ["r", "g", "b"], rest), *options.ca)
    return toned(p, options)


def toned(p: DataFrame, options: Options) -> DataFrame:
    p = pointwise.tone_reproduction(p, F.col("exposure"), options.gamma)
    return geometry.orient(p, F.col("orientation"))


def develop_linear(p: DataFrame, options: Options = Options(), scaled_by_table: bool = False) -> DataFrame:
    """For pixels that are RGB already: shift to 16 bits, then white balance on RGB, and on as usual."""
    p = pointwise.linear_shift(p, scaled_by_table, ("r", "g", "b"))
    p = pointwise.white_balance(p, tuple(neutral_gains(options)))
    return finish(p, options)
