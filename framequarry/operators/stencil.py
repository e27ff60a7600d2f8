"""Neighbourhood operators in array form: a frame's samples stay one array, neighbours are guarded lookups.

No shuffle: an exploded pixel is computed from the array it came from, in the same generated stage.
Frames: width, height, data. Raw frames have cfa; RGB data holds r, g, b of each pixel in turn.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import f32, round_u16, trunc_u16
from .pointwise import channel


def _explode(frames: DataFrame) -> DataFrame:
    """One row per pixel that still sees ``data``."""
    p = frames.select("*", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("_i"))
    return p.withColumns({"x": F.col("_i") % F.col("width"), "y": F.floor(F.col("_i") / F.col("width")).cast("int")}).drop("_i")


def _at(x: Column, y: Column) -> Column:
    return F.element_at("data", y * F.col("width") + x + 1)


def _inside(x: Column, y: Column) -> Column:
    return (x >= 0) & (y >= 0) & (x < F.col("width")) & (y < F.col("height"))


def bilinear_demosaic(frames: DataFrame) -> DataFrame:
    """r, g, b: integer means of the nearest samples of a colour.

    Left of and above the frame its edge is read; right of and below it, 0.
    """
    p = _explode(frames)
    x, y = F.col("x"), F.col("y")

    def near(dx: int, dy: int) -> Column:
        nx = F.greatest(x + dx, F.lit(0)) if dx < 0 else x + dx
        ny = F.greatest(y + dy, F.lit(0)) if dy < 0 else y + dy
        return F.when((nx < F.col("width")) & (ny < F.col("height")), _at(nx, ny)).otherwise(0) if dx > 0 or dy > 0 else _at(nx, ny)

    def mean(*at: tuple[int, int]) -> Column:
        total = near(*at[0])
        for a in at[1:]:
            total = total + near(*a)
        return F.floor(total / len(at)).cast("int")

    v, c = near(0, 0), channel()
    side, post = mean((-1, 0), (1, 0)), mean((0, -1), (0, 1))
    cross, diagonal = mean((0, -1), (0, 1), (-1, 0), (1, 0)), mean((-1, -1), (1, -1), (-1, 1), (1, 1))
    row = F.col("cfa").substr((y % 2) * 2 + F.lit(1), F.lit(2))
    on_red_row = F.instr(row, "R") > 0
    q = p.withColumns({"_c": c, "_red_row": on_red_row})
    out = q.withColumns({
        "r": F.when(F.col("_c") == "R", v).when(F.col("_c") == "B", diagonal).when(F.col("_red_row"), side).otherwise(post),
        "g": F.when(F.col("_c") == "G", v).otherwise(cross),
        "b": F.when(F.col("_c") == "B", v).when(F.col("_c") == "R", diagonal).when(F.col("_red_row"), post).otherwise(side),
    })
    return out.drop("data", "_c", "_red_row")


def same_colour(frames: DataFrame) -> DataFrame:
    """Pixel form with v, ``median`` and ``average`` of the same-colour neighbours in 5 x 5, and their number ``n``.

    Clipped at borders, the two greens apart, the centre left out. An even count takes the integer mean of the middle two.
    """
    p = _explode(frames)
    x, y = F.col("x"), F.col("y")
    around = F.filter(F.array(*[F.when(_inside(x + dx, y + dy), _at(x + dx, y + dy)) for dy in (-2, 0, 2) for dx in (-2, 0, 2) if dx or dy]), lambda a: a.isNotNull())
    q = p.withColumns({"v": _at(x, y), "_s": F.array_sort(around)}).drop("data")
    n = F.size("_s")
    mid = F.floor(n / 2).cast("int")
    median = F.when(n == 0, 0).when(n % 2 == 1, F.try_element_at("_s", mid + 1)).otherwise(F.floor((F.try_element_at("_s", mid) + F.try_element_at("_s", mid + 1)) / 2).cast("int"))
    total = F.aggregate("_s", F.lit(0).cast("long"), lambda a, b: a + b)
    return q.withColumns({"median": median, "average": F.when(n == 0, 0).otherwise(F.floor(total / F.greatest(n, F.lit(1)))).cast("int"), "n": n}).drop("_s")


def bad_pixels(frames: DataFrame, threshold: float) -> DataFrame:
    """same_colour with ``bad``: the sample is further from a positive median than threshold times it."""
    p = same_colour(frames)
    med = f32(F.col("median"))
    return p.withColumn("bad", (F.col("n") > 0) & (med > f32(0.0)) & (F.abs(f32(F.col("v")) - med) > f32(threshold) * med))


def correct_bad_pixels(frames: DataFrame, threshold: float, mode: str = "median") -> DataFrame:
    """Bad samples get the neighbours' median or average, all of them computed from the frame as it was."""
    return bad_pixels(frames, threshold).withColumn("v", F.when(F.col("bad"), F.col(mode)).otherwise(F.col("v"))).drop("median", "average", "n", "bad")


def correct_listed(frames: DataFrame, bad: DataFrame) -> DataFrame:
    """The samples listed as (img_id, x, y) get the median of their neighbours."""
    b = bad.select("img_id", "x", "y", F.lit(True).alias("_bad")).distinct()
    p = same_colour(frames).join(b, ["img_id", "x", "y"], "left")
    return p.withColumn("v", F.when(F.col("_bad"), F.col("median")).otherwise(F.col("v"))).drop("median", "average", "n", "_bad")


def _rgb_at(x: Column, y: Column, c: int) -> Column:
    return F.element_at("data", (y * F.col("width") + x) * 3 + (c + 1))


def sample(sx: Column, sy: Column, c: int) -> Column:
    """A channel at a FLOAT place, clamped to the frame, from four samples; FLOAT throughout, rounded."""
    one, zero = f32(1.0), f32(0.0)
    sx = F.greatest(zero, F.least(sx, f32(F.col("width")) - one))
    sy = F.greatest(zero, F.least(sy, f32(F.col("height")) - one))
    x0, y0 = F.floor(sx).cast("int"), F.floor(sy).cast("int")
    x1, y1 = F.least(x0 + 1, F.col("width") - 1), F.least(y0 + 1, F.col("height") - 1)
    fx, fy = sx - f32(x0), sy - f32(y0)
    p = lambda a, b: f32(_rgb_at(a, b, c))
    top, low = p(x0, y0) * (one - fx) + p(x1, y0) * fx, p(x0, y1) * (one - fx) + p(x1, y1) * fx
    return round_u16(top * (one - fy) + low * fy)


def _resampled(frames: DataFrame, places: Callable[[int], tuple[Column, Column] | None]) -> DataFrame:
    p = _explode(frames)
    for c in range(3):
        at = places(c)
        if at is None:
            p = p.withColumn("rgb"[c], _rgb_at(F.col("x"), F.col("y"), c))
        else:
            p = p.withColumns({f"_sx{c}": at[0], f"_sy{c}": at[1]}).withColumn("rgb"[c], sample(F.col(f"_sx{c}"), F.col(f"_sy{c}"), c)).drop(f"_sx{c}", f"_sy{c}")
    return p.drop("data")


def chromatic_aberration(frames: DataFrame, red: float, blue: float) -> DataFrame:
    """Red and blue are scaled about the centre, green stays; a scale of about 1 leaves its channel."""

    def places(c: int) -> tuple[Column, Column] | None:
        scale = {0: red, 2: blue}.get(c, 1.0)
        if abs(scale - 1) < 1e-6:
            return None
        inv = f32(f32(1.0) / f32(scale))

        def along(size: str, at: str) -> Column:
            mid = (f32(F.col(size)) - f32(1.0)) * f32(0.5)
            return mid + (f32(F.col(at)) - mid) * inv

        return along("width", "x"), along("height", "y")

    return _resampled(frames, places)


def warp(frames: DataFrame, k: tuple[float, float, float, float], p: tuple[float, float] = (0.0, 0.0), cx: float = 0.5, cy: float = 0.5) -> DataFrame:
    """Radial and tangential warp: DOUBLE coordinates relative to half the shorter side, FLOAT samples."""
    norm = F.lit(0.5) * F.least("width", "height").cast("double")
    mx, my = F.lit(cx) * F.col("width").cast("double"), F.lit(cy) * F.col("height").cast("double")
    xn, yn = (F.col("x").cast("double") - mx) / norm, (F.col("y").cast("double") - my) / norm
    r2 = xn * xn + yn * yn
    r4 = r2 * r2
    factor = F.lit(1.0) + F.lit(k[0]) * r2 + F.lit(k[1]) * r4 + F.lit(k[2]) * (r4 * r2) + F.lit(k[3]) * (r4 * r4)
    xs = xn * factor + F.lit(2.0 * p[0]) * xn * yn + F.lit(p[1]) * (r2 + F.lit(2.0) * xn * xn)
    ys = yn * factor + F.lit(p[0]) * (r2 + F.lit(2.0) * yn * yn) + F.lit(2.0 * p[1]) * xn * yn
    at = (f32(xs * norm + mx), f32(ys * norm + my))
    return _resampled(frames, lambda _: at)


def gaussian_kernel(sigma: float, radius: int) -> list[float]:
    import math

    w = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def gaussian_blur(frames: DataFrame, sigma: float, radius: int) -> DataFrame:
    """Two passes, along rows and then columns, each rounded; weights are renewed at borders. DOUBLE sums in order."""
    kernel = gaussian_kernel(sigma, radius)

    def one_pass(size: str, place: Callable[[Column], Column], stride: Callable[[], Column]) -> Column:
        def value(i: Column) -> Column:
            at = place(i)
            acc, total = F.lit(0.0), F.lit(0.0)
            for d, w in zip(range(-radius, radius + 1), kernel, strict=True):
                ok = (at + d >= 0) & (at + d < F.col(size))
                acc = acc + F.when(ok, F.element_at("data", i + 1 + stride() * d) * F.lit(w)).otherwise(0.0)
                total = total + F.when(ok, F.lit(w)).otherwise(0.0)
            return F.floor(acc / total + F.lit(0.5)).cast("int")

        return F.transform(F.sequence(F.lit(0), F.size("data") - 1), value)

    w = F.col("width")
    across = frames.withColumn("data", one_pass("width", lambda i: F.floor(i / 3).cast("int") % w, lambda: F.lit(3)))
    down = across.withColumn("data", one_pass("height", lambda i: F.floor(F.floor(i / 3) / w).cast("int"), lambda: w * 3))
    p = _explode(down)
    return p.withColumns({c: _rgb_at(F.col("x"), F.col("y"), i) for i, c in enumerate("rgb")}).drop("data")


def bilateral(frames: DataFrame, spatial: float, tonal: float, radius: int) -> DataFrame:
    """Weights fall with distance and with difference of value; a clipped window, DOUBLE sums in order, rounded."""
    import math

    p = _explode(frames)
    x, y, two = F.col("x"), F.col("y"), 2 * tonal * tonal

    def one(c: int) -> Column:
        mid, num, den = _rgb_at(x, y, c), F.lit(0.0), F.lit(0.0)
        for dy in range(-radius, radius + 1):
            for dx in range(-radius, radius + 1):
                ok = _inside(x + dx, y + dy)
                v = F.when(ok, _rgb_at(x + dx, y + dy, c)).otherwise(0).cast("double")
                d = mid.cast("double") - v
                w = F.when(ok, F.lit(math.exp(-(dx * dx + dy * dy) / (2 * spatial * spatial))) * F.exp(-(d * d) / F.lit(two))).otherwise(0.0)
                num, den = num + v * w, den + w
        return F.floor(num / den + F.lit(0.5)).cast("int")

    return p.withColumns({c: one(i) for i, c in enumerate("rgb")}).drop("data")


def gain_map(frames: DataFrame, rows: int, cols: int, origin: tuple[float, float], spacing: tuple[float, float], gains: list[float], map_planes: int = 1, plane: int = 0, planes: int = 3) -> DataFrame:
    """Multiplies channels plane .. plane + planes - 1 by a gain interpolated from a grid over the whole frame.

    origin and spacing are (vertical, horizontal), relative to the frame; gains are FLOAT values, all
    else DOUBLE, clamped and cut. One map plane serves all channels, else the last serves those beyond.
    """
    p = _explode(frames)
    pick = lambda c, i: F.element_at("data", i * 3 + (c + 1))
    flat = F.col("y") * F.col("width") + F.col("x")
    if not (rows and cols and map_planes and gains):
        return p.withColumns({n: pick(c, flat) for c, n in enumerate("rgb")}).drop("data")
    table = F.array(*map(F.lit, gains)).cast("array<float>").cast("array<double>")

    def grid(at: str, size: str, start: float, step: float, n: int) -> tuple[Column, Column, Column]:
        relative = F.when(F.col(size) > 1, F.col(at).cast("double") / F.greatest(F.col(size) - 1, F.lit(1)).cast("double")).otherwise(0.5)
        g = F.greatest(F.lit(0.0), F.least((relative - F.lit(start)) / F.lit(step), F.lit(float(n - 1))))
        low = F.floor(g).cast("int")
        return low, F.least(low + 1, F.lit(n - 1)), g - low.cast("double")

    (y0, y1, fy), (x0, x1, fx) = grid("y", "height", origin[0], spacing[0], rows), grid("x", "width", origin[1], spacing[1], cols)
    one = F.lit(1.0)

    def channel_of(c: int) -> Column:
        v = pick(c, flat)
        if not plane <= c < plane + planes:
            return v
        k = min(c - plane, map_planes - 1)
        g = lambda yy, xx: F.element_at(table, (yy * cols + xx) * map_planes + (k + 1))
        gain = g(y0, x0) * (one - fy) * (one - fx) + g(y0, x1) * (one - fy) * fx + g(y1, x0) * fy * (one - fx) + g(y1, x1) * fy * fx
        return trunc_u16(v.cast("double") * gain, kind="double")

    return p.withColumns({n: channel_of(c) for c, n in enumerate("rgb")}).drop("data")
