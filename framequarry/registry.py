"""The queries of the image operators, each over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .data.calibration import XYZ_TO_SRGB
from .functions.matrix import determinant, inverse, lit9, product
from .functions.numeric import white_level as white_of
from .operators import codecs, embedded, formats, geometry, lookup, metadata, planes, pointwise, stencil
from .operators import raw as raw_files
from .operators import demosaic as dm
from .plans.develop import Options, develop, develop_linear
from .plans.develop_frames import develop_frames, to_pixels
from .plans.export import export
from .registry_sql import SQL
from .ship import ship
from .sources import derived as d
from .streaming.ingest import probe_stream

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "develop_bilinear"
QUERIES: dict[str, Query] = {}

# Parameters of the queries, the same in their SQL.
GAINS = (2.35, 1.0, 1.65)
MATRIX = [1.5, -0.375, -0.125, -0.25, 1.375, -0.125, 0.0625, -0.5, 1.4375]
TABLE = [i * 3 for i in range(2048)]
TABLE_SHORT = [min(65535, i * 5) for i in range(6000)]
WARP = (0.05, -0.02, 0.01, -0.005)
TANGENT = (0.01, -0.015)
CROP = (1, 2, 5, 4)
MAP = {"rows": 3, "cols": 3, "origin": (0.0, 0.0), "spacing": (0.5, 0.5), "gains": [1.0, 1.25, 1.5, 0.75, 1.0, 1.125, 0.5, 0.875, 2.0]}
KEYS = ("img_id", "x", "y")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def raw(s: SparkSession, at: str) -> DataFrame:
    return d.pixels(d.raw_frames(s, at))


def v(p: DataFrame) -> DataFrame:
    return p.select(*KEYS, "v")


def rgb(p: DataFrame) -> DataFrame:
    return p.select(*KEYS, "r", "g", "b")


def planted(s: SparkSession, at: str) -> DataFrame:
    """Raw frames with a hot sample at (3, 3) and, on odd frames, a dead one at (5, 2)."""
    f = d.raw_frames(s, at)
    return f.withColumn("data", F.transform("data", lambda x, i: F.when(i == 27, F.col("white")).when((i == 21) & (F.col("img_id") % 2 == 1), 0).otherwise(x)))


# --- the mosaic, point by point ------------------------------------------------------------------


@query
def black_level(s, at):
    return v(pointwise.black_level(raw(s, at)))


@query
def uniform_black(s, at):
    return v(pointwise.uniform_black(raw(s, at), 8000))


@query
def wb_raw(s, at):
    return v(pointwise.mosaic_white_balance(raw(s, at), *map(F.lit, GAINS)))


@query
def normalize_16(s, at):
    return v(pointwise.normalize(raw(s, at)))


@query
def linear_shift(s, at):
    return v(pointwise.linear_shift(raw(s, at)))


@query
def linearize(s, at):
    return v(pointwise.linearize(raw(s, at), TABLE_SHORT))


@query
def cfa_color(s, at):
    return raw(s, at).select(*KEYS, pointwise.cfa_code().alias("code"))


@query
def demosaic_none(s, at):
    return rgb(pointwise.no_demosaic(raw(s, at)))


# --- RGB, point by point -------------------------------------------------------------------------


@query
def wb_rgb(s, at):
    return rgb(pointwise.white_balance(d.rgb_pixels(s, at), GAINS))


@query
def gains_rgb(s, at):
    return rgb(pointwise.white_balance(d.rgb_pixels(s, at), GAINS, 40000))


@query
def color_matrix(s, at):
    return rgb(pointwise.color_matrix(d.rgb_pixels(s, at), MATRIX))


@query
def matrix_rgb(s, at):
    return rgb(pointwise.matrix_f64(d.rgb_pixels(s, at), XYZ_TO_SRGB, 50000))


@query
def color_space_transform(s, at):
    return rgb(pointwise.color_space_transform(d.rgb_pixels(s, at), GAINS, MATRIX))


@query
def gamma(s, at):
    return rgb(pointwise.gamma(d.rgb_pixels(s, at), 2.2))


@query
def tonemap(s, at):
    p = d.rgb_pixels(s, at)
    k = F.col("img_id") % 4
    return rgb(pointwise.tonemap(p, F.when(k == 1, -0.83).when(k == 2, 0.0).when(k == 3, 1.0)))


@query
def tone_reproduction(s, at):
    return rgb(pointwise.tone_reproduction(d.rgb_pixels(s, at), F.lit(0.5), 1.8))


@query
def convert_to_srgb(s, at):
    k = F.col("img_id") % 4
    p = d.rgb_pixels(s, at).withColumn("color", F.when(k == 0, "sRGB").when(k == 1, "Linear sRGB").when(k == 2, "Unspecified").otherwise("Display P3"))
    return pointwise.convert_to_srgb(p).select(*KEYS, "r", "g", "b", "color", "error")


@query
def pack_rgb8(s, at):
    return rgb(pointwise.pack8(d.rgb_pixels(s, at)))


@query
def expand_8_to_16(s, at):
    return rgb(pointwise.expand16(pointwise.pack8(d.rgb_pixels(s, at))))


# --- places --------------------------------------------------------------------------------------


def _placed(f):
    return lambda s, at: f(d.rgb_pixels(s, at)).select("img_id", "width", "height", "x", "y", "r", "g", "b")


QUERIES["flip_h"] = _placed(geometry.flip_horizontal)
QUERIES["flip_v"] = _placed(geometry.flip_vertical)
QUERIES["rotate_180"] = _placed(geometry.rotate_180)
QUERIES["rotate_90_cw"] = _placed(geometry.rotate_90_cw)
QUERIES["rotate_90_ccw"] = _placed(geometry.rotate_90_ccw)
QUERIES["crop"] = _placed(lambda p: geometry.crop(p, *CROP))
QUERIES["orientation"] = _placed(lambda p: geometry.orient(geometry.crop(p, *CROP), (F.col("img_id") % 10).cast("int")))

# --- calibration ---------------------------------------------------------------------------------


@query
def cameras(s, at):
    c = lookup.cameras(s)
    cells = lambda m: [F.col(m)[i].alias(f"{m}_{i}") for i in (0, 4, 8)]
    return c.select("ordinal", "model", "ill1", "ill2", *cells("cm1"), *cells("cm2"))


@query
def illuminants(s, at):
    return lookup.illuminants(s)


@query
def color_constants(s, at):
    return lookup.constants(s)


def models(s, at):
    """A camera string per customer: a table model, a longer one, a part of one, or none."""
    c = d.read(s, at, "customer").select(F.col("c_custkey").alias("id"))
    k = F.col("id") % 5
    return c.select("id", F.when(k == 0, "ILCE-7RM5").when(k == 1, F.concat(F.lit("SONY ILCE-1"), F.col("id").cast("string"))).when(k == 2, "EOS").when(k == 3, "iphone 16 pro").otherwise("iPhone 16 Pro Max").alias("model"))


@query
def camera_lookup(s, at):
    return lookup.camera_fuzzy(models(s, at), "model", ["id"]).select("id", "model", "ordinal", "camera")


@query
def camera_lookup_exact(s, at):
    return lookup.camera_exact(models(s, at), "model").select("id", "model", "ordinal", "camera")


@query
def illuminant_by_code(s, at):
    p = d.read(s, at, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 26).cast("int").alias("code"))
    return lookup.illuminant_by_code(p, "code").select("id", "code", "name", "cct")


@query
def illuminant_by_name(s, at):
    p = d.read(s, at, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 == 0, "d65").when(F.col("p_size") % 3 == 1, "COOL white fluorescent").otherwise("none").alias("asked"))
    return lookup.illuminant_by_name(p, "asked").select("id", "asked", "illuminant", "exif_code")


@query
def illuminant_nearest(s, at):
    p = d.read(s, at, "part").select(F.col("p_partkey").alias("id"), (F.lit(2000) + (F.col("p_partkey") * 37) % 6500).cast("int").alias("cct"))
    return lookup.illuminant_nearest(p, "cct").select("id", "cct", "illuminant")


@query
def illuminant_xyz(s, at):
    x, y, z = lookup.xyz(F.col("x"), F.col("y"))
    return lookup.illuminants(s).select("name", x.alias("X"), y.alias("Y"), z.alias("Z")).withColumnsRenamed({"X": "big_x", "Y": "big_y", "Z": "big_z"})


@query
def matrix_det(s, at):
    return lookup.cameras(s).select("model", determinant(F.col("cm2")).alias("det"))


@query
def matrix_inverse(s, at):
    m = lookup.cameras(s).select("model", inverse(F.col("cm2")).alias("m")).union(s.createDataFrame([("singular", [1.0] * 9)], "model string, m array<double>").select("model", inverse(F.col("m"))))
    return m.select("model", *[F.col("m")[i].alias(f"m{i}") for i in range(9)])


@query
def matrix_product(s, at):
    return lookup.cameras(s).select("model", product(lit9(XYZ_TO_SRGB), F.col("cm2")).alias("m")).select("model", *[F.col("m")[i].alias(f"m{i}") for i in range(9)])


@query
def camera_to_srgb(s, at):
    return lookup.cameras(s).select("model", lookup.camera_to_srgb(F.coalesce("cm2", "cm1")).alias("m")).select("model", *[F.col("m")[i].alias(f"m{i}") for i in range(9)])


@query
def interpolate_matrix(s, at):
    scenes = d.read(s, at, "part").select(F.col("p_partkey").alias("id"), (F.lit(2000) + (F.col("p_partkey") * 37) % 6500).cast("double").alias("scene"))
    c = lookup.cameras(s).where("model = 'iPhone 15 Pro Max'")
    m = lookup.interpolate(F.col("cm1"), F.lit(2856.0), F.col("cm2"), F.lit(6504.0), F.col("scene"))
    return scenes.join(F.broadcast(c), F.lit(True)).select("id", m.alias("m")).select("id", *[F.col("m")[i].alias(f"m{i}") for i in range(9)])


@query
def estimate_cct(s, at):
    return d.raw_frames(s, at).select("img_id", lookup.estimate_cct(F.col("neutral")).alias("cct"))


# --- neighbours ----------------------------------------------------------------------------------


@query
def demosaic_bilinear(s, at):
    return rgb(stencil.bilinear_demosaic(d.raw_frames(s, at)))


@query
def same_colour(s, at):
    return stencil.same_colour(planted(s, at)).select(*KEYS, "v", "median", "average", F.col("n").cast("int").alias("n"))


@query
def bad_pixel_detect(s, at):
    return stencil.bad_pixels(planted(s, at), 0.5).where("bad").select(*KEYS, "v", "median")


@query
def bad_pixel_correct_median(s, at):
    return v(stencil.correct_bad_pixels(planted(s, at), 0.5))


@query
def bad_pixel_correct_average(s, at):
    return v(stencil.correct_bad_pixels(planted(s, at), 0.5, "average"))


@query
def bad_pixel_correct_list(s, at):
    f = planted(s, at)
    bad = f.select("img_id", F.explode(F.array(F.struct(F.lit(3).alias("x"), F.lit(3).alias("y")), F.struct(F.lit(5).alias("x"), F.lit(2).alias("y")))).alias("p")).select("img_id", "p.x", "p.y")
    return v(stencil.correct_listed(f, bad))


@query
def gaussian_blur(s, at):
    return rgb(stencil.gaussian_blur(d.rgb_frames(s, at), 1.2, 2))


@query
def bilateral(s, at):
    return rgb(stencil.bilateral(d.rgb_frames(s, at), 1.0, 10000.0, 2))


@query
def ca_correction(s, at):
    return rgb(stencil.chromatic_aberration(d.rgb_frames(s, at), 1.02, 0.97))


@query
def lens_warp(s, at):
    return rgb(stencil.warp(d.rgb_frames(s, at), WARP))


@query
def lens_warp_tangential(s, at):
    return rgb(stencil.warp(d.rgb_frames(s, at), WARP, TANGENT, 0.45, 0.55))


@query
def gain_map(s, at):
    return rgb(stencil.gain_map(d.rgb_frames(s, at), **MAP))


def _demosaic(method):
    return lambda s, at: rgb(dm.to_pixels(dm.demosaic(d.raw_frames(s, at), method)))


for _m in dm.METHODS:
    QUERIES[f"demosaic_{_m}"] = _demosaic(_m)

# --- developments --------------------------------------------------------------------------------


def _develop(options):
    return lambda s, at: develop(d.raw_frames(s, at), options).select("img_id", "width", "height", "x", "y", "r", "g", "b")


QUERIES["develop_bilinear"] = _develop(Options(demosaic="bilinear"))
QUERIES["develop_auto"] = _develop(Options())
QUERIES["develop_options"] = _develop(Options(demosaic="rcd", white_balance=GAINS, bad_pixels="median", denoise_sigma=0.6, ca=(1.01, 0.99), gamma=2.2, crop=(0, 0, 8, 6), rescale_white=True))


def _develop_frames(options):
    return lambda s, at: to_pixels(develop_frames(d.raw_frames(s, at), options))


QUERIES["develop_frames_bilinear"] = _develop_frames(Options(demosaic="bilinear"))
QUERIES["develop_frames_auto"] = _develop_frames(Options())


@query
def export_png(s, at):
    """Developed, written as PNG files with filters chosen by line, and read back."""
    made = export(d.raw_frames(s, at), Options(demosaic="bilinear"), level="fast", filter="min_sum_abs")
    return to_pixels(codecs.decode(made.withColumnRenamed("img_id", "file_id")).withColumnRenamed("file_id", "img_id"))


@query
def develop_linear_raw(s, at):
    p = d.rgb_pixels(s, at)
    k = F.col("img_id")
    p = p.withColumns({"bit_depth": F.lit(14), "r": F.shiftright("r", 2), "g": F.shiftright("g", 2), "b": F.shiftright("b", 2), "exposure": F.lit(0.0), "orientation": (k % 8 + 1).cast("int"), "camera": (k % 25).cast("int"), "neutral": F.array(F.lit(0.5), F.lit(1.0), F.lit(0.625))})
    return develop_linear(p).select("img_id", "width", "height", "x", "y", "r", "g", "b")


# --- files ---------------------------------------------------------------------------------------


@query
def sniff_standard(s, at):
    return d.headers(s, at).select("file_id", formats.sniff_standard(F.col("content")).alias("format"))


@query
def sniff_leaves(s, at):
    return d.headers(s, at).select("file_id", *[F.coalesce(formats.matches(F.col("content"), n), F.lit(False)).alias(n.lower()) for n in ("GIF", "JPEG", "PNG", "WebP", "JXL", "TIFF", "PPM", "SVG")])


@query
def sniff_pages(s, at):
    return d.read(s, at, "pages").select("page_id", formats.sniff_standard(F.col("html").cast("binary")).alias("format"))


@query
def sniff_raw(s, at):
    return formats.sniff_raw(d.headers(s, at)).select("file_id", "raw_format")


@query
def probe(s, at):
    return formats.probe(d.headers(s, at)).select("file_id", "format", "width", "height", "bit_depth", "error")


@query
def format_catalog(s, at):
    return formats.formats(s)


@query
def codec_registry(s, at):
    return formats.codecs(s).where("direction = 'decode'")


@query
def format_by_extension(s, at):
    p = d.read(s, at, "part")
    k = F.col("p_partkey") % 8
    e = F.when(k == 0, "JPG").when(k == 1, "jfif").when(k == 2, "Tif").when(k == 3, "heif").when(k == 4, "svgz").when(k == 5, "pfm").when(k == 6, "webp").otherwise("txt")
    return formats.by_extension(p.select(F.col("p_partkey").alias("file_id"), e.alias("ext")), "ext").select("file_id", "ext", "format")


@query
def png_round_trip(s, at):
    """Encoded as 16-bit PNG and decoded again."""
    return _again(s, at, "png", 16)


@query
def png8_round_trip(s, at):
    return _again(s, at, "png", 8)


@query
def ppm_round_trip(s, at):
    return _again(s, at, "ppm", 16)


def _again(s, at, kind, bits):
    files = codecs.encode(d.rgb_frames(s, at), kind, bits).select(F.col("img_id").alias("file_id"), "content")
    p = codecs.decode(files).select(F.col("file_id").alias("img_id"), "width", F.posexplode("data").alias("i", "s"))
    i = F.floor(F.col("i") / 3).cast("int")
    return p.select("img_id", (i % F.col("width")).alias("x"), F.floor(i / F.col("width")).cast("int").alias("y"), (F.col("i") % 3).alias("c"), F.col("s").alias("v"))


@query
def dng_tags(s, at):
    """Sizes and photometric interpretation from the tags of written DNG files."""
    from .operators.ifd import tags

    files = codecs.encode(d.rgb_frames(s, at), "dng").select(F.col("img_id").alias("file_id"), "content")
    return tags(files).where("tag in (256, 257, 262, 277) and i = 0").select("file_id", "dir", "tag", F.col("num").alias("value"))


@query
def dng_linear_round_trip(s, at):
    """RGB frames written as DNG and read by the RAW reader."""
    files = codecs.encode(d.rgb_frames(s, at), "dng").select(F.col("img_id").alias("file_id"), "content")
    p = raw_files.read(files).where("error is null").select("img_id", "width", F.posexplode("data").alias("i", "v"))
    i = F.floor(F.col("i") / 3).cast("int")
    return p.select("img_id", (i % F.col("width")).alias("x"), F.floor(i / F.col("width")).cast("int").alias("y"), (F.col("i") % 3).alias("c"), "v")


@query
def raf_decode(s, at):
    """Mosaics put into a RAF container, with their size in the EXIF of its preview, and read by the RAW reader."""
    f = d.raw_frames(s, at)
    be = lambda n, size: F.lpad(F.hex(n.cast("long")), 2 * size, "0")
    size = F.concat(F.lit("4D4D002A00000008" "0002" "0100000400000001"), be(F.col("width"), 4), F.lit("0101000400000001"), be(F.col("height"), 4), F.lit("00000000"))
    jpeg = F.concat(F.lit("FFD8FFE1"), be(F.length(size) / 2 + 8, 2), F.hex(F.lit(b"Exif\0\0")), size)
    body = F.concat(F.lit("00" * 32), F.array_join(F.transform("data", lambda x: F.lpad(F.hex(x.cast("long")), 4, "0")), ""))
    n = F.lit(160).cast("long")
    head = F.concat(F.hex(F.lit(b"FUJIFILMCCD-RAW ".ljust(28, b"0"))), F.hex(F.lit(b"X-T5".ljust(56, b"\0"))), be(n, 4), be(F.length(jpeg) / 2, 4), be(n + F.length(jpeg) / 2, 4), F.lit("00000000"), be(F.length(body) / 2, 4), F.lit("00" * 56))
    files = f.select(F.col("img_id").alias("file_id"), F.unhex(F.concat(head, jpeg, body)).alias("content"))
    p = raw_files.read(files).where("error is null").select("img_id", "model", "xtrans", "width", F.posexplode("data").alias("i", "v"))
    return p.select("img_id", "model", "xtrans", (F.col("i") % F.col("width")).alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), "v")


@query
def cmyk_fold(s, at):
    p = d.read(s, at, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 5 % 256).cast("int").alias("value"), (F.col("p_partkey") % 256).cast("int").alias("key"))
    return p.select("id", "value", "key", planes.cmyk_to_rgb8(F.col("value"), F.col("key")).alias("folded"))


@query
def white_level(s, at):
    return d.read(s, at, "part").select(F.col("p_partkey").alias("id"), white_of((F.col("p_size") % 20).cast("int")).alias("white"))


@query
def encode_defaults(s, at):
    return formats.encode_defaults(s)


@query
def color_description(s, at):
    p = d.read(s, at, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 13).cast("int").alias("primaries"), (F.col("p_partkey") % 14).cast("int").alias("transfer"))
    return formats.color_name(p, "primaries", "transfer").select("id", "primaries", "transfer", "color")


# --- metadata ------------------------------------------------------------------------------------


@query
def exif_pivot(s, at):
    return metadata.pivot(d.exif_tags(s, at))


@query
def exif_extra_last_wins(s, at):
    return metadata.last_wins(d.exif_tags(s, at)).select("img_id", F.format_string("0x%04x", "tag").alias("tag"), "dir", "seq", "num", "den")


@query
def rational_to_double(s, at):
    return metadata.rationals(d.exif_tags(s, at)).select("img_id", "seq", "value")


@query
def ascii_clean(s, at):
    c = d.read(s, at, "customer")
    return c.select(F.col("c_custkey").alias("id"), metadata.clean_ascii(F.concat(F.lit("  "), F.col("c_name"), F.lit(" \0\0"))).alias("clean"))


@query
def gps_decimal(s, at):
    c = d.read(s, at, "customer").select(F.col("c_custkey").alias("id"))
    k = F.col("id")
    g = metadata.gps_decimal((k % 90).cast("double"), (k % 60).cast("double"), ((k * 7) % 60).cast("double"), F.when(k % 3 == 0, "S").when(k % 3 == 1, "N").otherwise("W"))
    return c.select("id", g.alias("degrees"))


@query
def extra_upsert(s, at):
    """The generic table after one entry was replaced in its place and one added; looked up again."""
    c = d.read(s, at, "customer").select(F.col("c_custkey").alias("id"), "c_name", F.col("c_nationkey").cast("string").alias("nation"))
    entry = lambda n, t, x: F.struct(F.lit(n).alias("namespace"), F.lit(t).alias("tag"), x.alias("value"))
    e = c.select("id", "nation", F.array(entry("exif", "0x010f", F.col("c_name")), entry("exif", "0x0110", F.col("nation"))).alias("extra"))
    e = e.withColumn("extra", metadata.extra_insert(metadata.extra_insert(F.col("extra"), "exif", "0x010f", F.concat(F.lit("n"), F.col("nation"))), "xmp", "rating", F.lit("5")))
    return e.select("id", metadata.extra_get(F.col("extra"), "exif", "0x010f").alias("make"), metadata.extra_get(F.col("extra"), "xmp", "rating").alias("rating"), metadata.extra_get(F.col("extra"), "xmp", "none").alias("missing"), F.size("extra").alias("entries"), F.col("extra")[0]["value"].alias("first"))


@query
def metadata_merge(s, at):
    a = d.read(s, at, "customer").select(F.col("c_custkey").alias("id"), F.lit("ARW").alias("format"), F.col("c_name").alias("lens"))
    b = d.read(s, at, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("RAF").alias("format"), F.col("s_nationkey").cast("int").alias("bits"))
    return metadata.merge([a, b]).select("id", "format", "lens", "bits")


@query
def embedded_exif(s, at):
    """EXIF built from customers, put into PNG files and read from them."""
    ship(s)

    @F.pandas_udf("binary")
    def png(name: pd.Series, key: pd.Series) -> pd.Series:
        blank = codecs.encode_png(1, 1, np.zeros((1, 3), dtype=np.int32))
        return pd.Series([embedded.with_png_blocks(blank, embedded.build_exif({"make": n, "model": f"m{k}", "iso": int(k), "exposure_time": {"num": int(k), "den": 125}, "orientation": int(k) % 8 + 1})) for n, k in zip(name, key, strict=True)])

    c = d.read(s, at, "customer").select(F.col("c_custkey").alias("file_id"), png("c_name", "c_custkey").alias("content"))
    return embedded.read(c).select(F.col("file_id").alias("id"), "make", "model", "iso", "orientation", F.col("exposure_time.num").alias("num"), F.col("exposure_time.den").alias("den"), F.size("extra").alias("entries"))


@query
def stream_probe(s, at):
    return probe_stream(s, at)
