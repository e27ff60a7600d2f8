"""Coordinate remaps, pixel form: x, y, width, height change, samples stay. No shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: EXIF orientation: (swap axes, then flip x, flip y).
_STEPS = {
    1: (False, False, False),
    2: (False, True, False),
    3: (False, True, True),
    4: (False, False, True),
    5: (True, False, False),
    6: (True, True, False),
    7: (True, True, True),
    8: (True, False, True),
}


def _placed(p: DataFrame, swap: Column, flip_x: Column, flip_y: Column) -> DataFrame:
    w, h = F.when(swap, F.col("height")).otherwise(F.col("width")), F.when(swap, F.col("width")).otherwise(F.col("height"))
    x, y = F.when(swap, F.col("y")).otherwise(F.col("x")), F.when(swap, F.col("x")).otherwise(F.col("y"))
    return p.withColumns({"x": F.when(flip_x, w - 1 - x).otherwise(x), "y": F.when(flip_y, h - 1 - y).otherwise(y), "width": w, "height": h})


def orient(p: DataFrame, orientation: Column | int) -> DataFrame:
    """EXIF orientations; 5 mirrors and then turns left, 7 mirrors and then turns right; others change nothing."""
    o = orientation if isinstance(orientation, Column) else F.lit(orientation)
    which = lambda i: F.coalesce(o.isin(*[k for k, s in _STEPS.items() if s[i]]), F.lit(False))
    return _placed(p, which(0), which(1), which(2))


def flip_horizontal(p: DataFrame) -> DataFrame:
    return orient(p, 2)


def flip_vertical(p: DataFrame) -> DataFrame:
    return orient(p, 4)


def rotate_180(p: DataFrame) -> DataFrame:
    return orient(p, 3)


def rotate_90_cw(p: DataFrame) -> DataFrame:
    return orient(p, 6)


def rotate_90_ccw(p: DataFrame) -> DataFrame:
    return orient(p, 8)


def crop(p: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """A region that is not inside a frame leaves that frame as it is."""
    fits = (F.lit(x + width) <= F.col("width")) & (F.lit(y + height) <= F.col("height"))
    inside = (F.col("x") >= x) & (F.col("x") < x + width) & (F.col("y") >= y) & (F.col("y") < y + height)
    return p.where(~fits | inside).withColumns({
        "x": F.when(fits, F.col("x") - x).otherwise(F.col("x")), "y": F.when(fits, F.col("y") - y).otherwise(F.col("y")),
        "width": F.when(fits, width).otherwise(F.col("width")), "height": F.when(fits, height).otherwise(F.col("height")),
    })
