"""Pointwise operators on the mosaic (x, y, v, cfa, black, white) and on RGB (r, g, b), pixel form.

Each takes and returns a DataFrame; nothing is shuffled, and all run inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import U16, f32, trunc_u16

RGB = ("r", "g", "b")


def phase() -> Column:
    return (F.col("y") % 2) * 2 + F.col("x") % 2


def channel() -> Column:
    """The colour letter of a place; layouts are named by their cells, row by row."""
    return F.col("cfa").substr(phase() + F.lit(1), F.lit(1))


def cfa_code() -> Column:
    """0 red, 1 green on a red row, 2 blue, 3 green on a blue row."""
    c = channel()
    row = F.col("cfa").substr((F.col("y") % 2) * 2 + F.lit(1), F.lit(2))
    return F.when(c == "R", 0).when(c == "B", 2).when(F.instr(row, "R") > 0, 1).otherwise(3)


def black_level(p: DataFrame) -> DataFrame:
    return p.withColumn("v", F.greatest(F.col("v") - F.element_at("black", phase() + F.lit(1)), F.lit(0)))


def uniform_black(p: DataFrame, level: int) -> DataFrame:
    return p.withColumn("v", F.greatest(F.col("v") - F.lit(level), F.lit(0)))


def mosaic_white_balance(p: DataFrame, r: Column, g: Column, b: Column) -> DataFrame:
    c = channel()
    gain = F.when(c == "R", f32(r)).when(c == "B", f32(b)).otherwise(f32(g))
    return p.withColumn("v", trunc_u16(f32(F.col("v")) * gain))


def normalize(p: DataFrame) -> DataFrame:
    """Scales white less the first black level to 65535; only that black level counts."""
    span = F.greatest(F.col("white") - F.element_at("black", 1), F.lit(0))
    scaled = F.least(f32(F.col("v")) * f32(f32(float(U16)) / f32(F.greatest(span, F.lit(1)))), f32(float(U16))).cast("int")
    return p.withColumn("v", F.when((span > 0) & (span < U16), scaled).otherwise(F.col("v")))


def linear_shift(p: DataFrame, scaled_by_table: bool = False, columns: tuple[str, ...] = ("v",)) -> DataFrame:
    """To 16 bits by shifting, unless a linearization table has done so (its largest value is above 4095)."""
    if scaled_by_table:
        return p
    by = F.greatest(F.lit(16) - F.col("bit_depth"), F.lit(0))
    return p.withColumns({c: F.least(F.col(c) * F.pow(F.lit(2.0), by).cast("int"), F.lit(U16)).cast("int") for c in columns})


def linearize(p: DataFrame, table: list[int]) -> DataFrame:
    """table[min(v, last)]; an empty table changes nothing."""
    if not table:
        return p
    t = F.array(*map(F.lit, table))
    return p.withColumn("v", F.element_at(t, F.least(F.col("v"), F.lit(len(table) - 1)) + F.lit(1)))


def no_demosaic(p: DataFrame) -> DataFrame:
    return p.withColumns({c: F.col("v") for c in RGB}).drop("v")


def white_balance(p: DataFrame, gains: tuple[Column | float, ...], high: int = U16) -> DataFrame:
    return p.withColumns({c: trunc_u16(f32(F.col(c)) * f32(g), high) for c, g in zip(RGB, gains, strict=True)})


def color_matrix(p: DataFrame, m: list[Column | float]) -> DataFrame:
    """FLOAT, terms summed from the left, then clamped and cut."""
    r, g, b = (f32(F.col(c)) for c in RGB)
    return p.withColumns({c: trunc_u16(r * f32(m[3 * i]) + g * f32(m[3 * i + 1]) + b * f32(m[3 * i + 2])) for i, c in enumerate(RGB)})


def matrix_f64(p: DataFrame, m: list[float], high: int = U16) -> DataFrame:
    r, g, b = (F.col(c).cast("double") for c in RGB)
    return p.withColumns({c: trunc_u16(F.lit(m[3 * i]) * r + F.lit(m[3 * i + 1]) * g + F.lit(m[3 * i + 2]) * b, high, "double") for i, c in enumerate(RGB)})


def color_space_transform(p: DataFrame, gains: tuple[float, ...], m: list[float]) -> DataFrame:
    """White balance, clamped, and then the matrix."""
    return color_matrix(white_balance(p, gains), m)


def gamma(p: DataFrame, g: float) -> DataFrame:
    """A gamma of about 1 changes nothing."""
    if abs(g - 1) < 0.001:
        return p
    return p.withColumns({c: trunc_u16(F.pow(F.col(c) / F.lit(65535.0), F.lit(1.0 / g)) * F.lit(65535.0), U16, "double") for c in RGB})


def srgb_encode(x: Column) -> Column:
    return F.when(x <= 0.0031308, x * 12.92).otherwise(F.lit(1.055) * F.pow(x, F.lit(1.0 / 2.4)) - F.lit(0.055))


def filmic(x: Column) -> Column:
    """Hable's curve with its published constants."""
    return (x * (F.lit(0.15) * x + F.lit(0.05)) + F.lit(0.004)) / (x * (F.lit(0.15) * x + F.lit(0.5)) + F.lit(0.06)) - F.lit(0.02) / F.lit(0.3)


def tonemap(p: DataFrame, exposure: Column) -> DataFrame:
    """Exposure gain, filmic curve relative to white, sRGB; a null exposure is a gain of 1."""
    gain = F.coalesce(F.pow(F.lit(2.0), exposure), F.lit(1.0))
    top = filmic(F.greatest(gain, F.lit(1e-6)))

    def one(c: str) -> Column:
        y = F.greatest(F.lit(0.0), F.least(F.lit(1.0), filmic(F.col(c) / F.lit(65535.0) * gain) / top))
        return F.floor(srgb_encode(y) * F.lit(65535.0) + F.lit(0.5)).cast("int")

    return p.withColumns({c: one(c) for c in RGB})


def tone_reproduction(p: DataFrame, exposure: Column, custom_gamma: float | None = None) -> DataFrame:
    return tonemap(p, exposure) if custom_gamma is None else gamma(p, custom_gamma)


def convert_to_srgb(p: DataFrame) -> DataFrame:
    """By the column ``color``: linear is encoded, sRGB and unspecified are kept, others get an ``error``."""
    linear = F.col("color") == "Linear sRGB"
    ok = F.col("color").isin("sRGB", "Linear sRGB", "Unspecified")
    enc = lambda c: F.floor(srgb_encode(F.col(c) / F.lit(65535.0)) * F.lit(65535.0) + F.lit(0.5)).cast("int")
    out = p.withColumns({c: F.when(linear, enc(c)).otherwise(F.col(c)) for c in RGB})
    return out.withColumns({"error": F.when(~ok, F.concat(F.lit("no conversion from "), F.col("color"))), "color": F.when(ok, F.lit("sRGB")).otherwise(F.col("color"))})


def pack8(p: DataFrame) -> DataFrame:
    return p.withColumns({c: F.shiftright(c, 8) for c in RGB})


def expand16(p: DataFrame) -> DataFrame:
    """8 to 16 bits by 257; gray is repeated by the caller, alpha dropped."""
    return p.withColumns({c: F.col(c) * F.lit(257) for c in RGB})
