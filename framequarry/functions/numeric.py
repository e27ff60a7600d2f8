"""Unsigned 16-bit arithmetic on INT columns, with the intermediate type of each operator kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U16 = 65535


def f32(x: Column | float) -> Column:
    """As FLOAT. A quotient of FLOATs is DOUBLE in Spark; cast, it is the FLOAT quotient."""
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("float")


def clamp(x: Column, low: Column | float, high: Column | float, kind: str) -> Column:
    """NaN goes to 0, as in the saturating casts that it stands for."""
    one = lambda v: (v if isinstance(v, Column) else F.lit(float(v))).cast(kind)
    return F.greatest(one(low), F.least(one(high), F.when(F.isnan(x), one(0.0)).otherwise(x)))


def trunc_u16(x: Column, high: Column | float = U16, kind: str = "float") -> Column:
    """Clamped to 0..high, then cut to a whole number."""
    return clamp(x, 0, high, kind).cast("int")


def round_u16(x: Column, kind: str = "float") -> Column:
    """Rounded half away from zero, then clamped."""
    return clamp(F.floor(x.cast("double") + F.lit(0.5)).cast(kind), 0, U16, kind).cast("int")


def rational(num: Column, den: Column) -> Column:
    """num / den as DOUBLE; NaN where den is 0."""
    return F.when(den == 0, F.lit(float("nan"))).otherwise(num.cast("double") / F.nullif(den, F.lit(0)).cast("double"))


def white_level(bits: Column) -> Column:
    return F.when(bits == 0, 0).when(bits >= 16, U16).otherwise(F.pow(F.lit(2.0), bits) - 1).cast("int")
