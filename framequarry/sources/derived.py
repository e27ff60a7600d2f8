"""Frames and headers derived from the driver's tables (FIXTURES.md, part B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLACK, WHITE, BITS, SIDE = [512, 520, 528, 536], 16383, 14, 8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """an 8 x 8 sensor mosaic per vector, array form."""
    e = read(spark, sf_dir, "embeddings")
    value = lambda x: F.floor((x.cast("double") + F.lit(1.0)) * F.lit(8191.0)).cast("int")
    k = F.col("label") % 4
    return e.select(
        F.col("vec_id").alias("img_id"),
        F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), F.lit(BITS).alias("bit_depth"), F.lit(WHITE).alias("white"),
        F.when(k == 0, "RGGB").when(k == 1, "GRBG").when(k == 2, "BGGR").otherwise("GBRG").alias("cfa"),
        F.array(*map(F.lit, BLACK)).alias("black"),
        (F.col("vec_id") % 8 + 1).cast("int").alias("orientation"),
        F.when(F.col("vec_id") % 4 == 1, -0.83).when(F.col("vec_id") % 4 == 2, 0.0).when(F.col("vec_id") % 4 == 3, 1.0).alias("exposure"),
        (F.col("vec_id") % 24).cast("int").alias("camera"),
        F.array(F.lit(0.45) + F.lit(0.05) * F.col("label"), F.lit(1.0), F.lit(0.6)).alias("neutral"),
        F.transform("embedding", value).alias("data"),
    )


def pixels(frames: DataFrame) -> DataFrame:
    """Pixel form of raw frames: data becomes x, y, v."""
    rest = [c for c in frames.columns if c != "data"]
    p = frames.select(*rest, F.posexplode("data").alias("_i", "v"))
    return p.select(*rest, (F.col("_i") % F.col("width")).alias("x"), F.floor(F.col("_i") / F.col("width")).cast("int").alias("y"), "v")


def rgb_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 RGB from three vectors in a row, pixel form: img_id, width, height, x, y, r, g, b."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    v = F.floor((F.col("e").cast("double") + F.lit(1.0)) * F.lit(32767.0)).cast("int")
    k = F.col("vec_id") % 3
    each = [F.max(F.when(k == n, v)).alias(c) for n, c in enumerate("rgb")]
    p = e.groupBy(F.floor(F.col("vec_id") / 3).alias("img_id"), "i").agg(F.count(F.lit(1)).alias("n"), *each).where("n = 3")
    return p.select("img_id", F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), (F.col("i") % SIDE).alias("x"), F.floor(F.col("i") / SIDE).cast("int").alias("y"), "r", "g", "b")


def rgb_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2, array form: data holds r, g, b of each pixel in turn."""
    e = read(spark, sf_dir, "embeddings")
    k = F.col("vec_id") % 3
    g = e.groupBy(F.floor(F.col("vec_id") / 3).alias("img_id")).agg(F.count(F.lit(1)).alias("n"), *[F.max(F.when(k == n, F.col("embedding"))).alias(c) for n, c in enumerate("abc")])
    value = lambda x: F.floor((x.cast("double") + F.lit(1.0)) * F.lit(32767.0)).cast("int")
    data = F.flatten(F.transform(F.arrays_zip("a", "b", "c"), lambda t: F.array(value(t["a"]), value(t["b"]), value(t["c"]))))
    return g.where("n = 3").select("img_id", F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), data.alias("data"))


def be32(n):
    return F.lpad(F.hex(n.cast("long")), 8, "0")


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 and more: a synthetic file head per part, of kind p_partkey % 16: file_id, kind, content."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), (F.col("p_size") * 16).cast("long").alias("w"), (F.col("p_partkey") % 4096 + 1).cast("long").alias("h"), (F.col("p_partkey") % 16).cast("int").alias("kind"))
    w, h = F.col("w"), F.col("h")
    be = be32

    def le(n, size):
        return F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(size)])

    def text(s):
        return F.hex(s.cast("binary"))

    pad = F.lit("00" * 16)
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), be(w), be(h), F.when(F.col("file_id") % 2 == 0, "08").otherwise("10"), F.lit("02"))
    ifd = lambda num, short: F.concat(num(F.lit(8), 4), num(F.lit(2), 2), num(F.lit(256), 2), num(F.lit(3), 2), num(F.lit(1), 4), short(w), num(F.lit(257), 2), num(F.lit(4), 2), num(F.lit(1), 4), num(h, 4), num(F.lit(0), 4))
    be_n = lambda n, size: F.lpad(F.hex(n.cast("long")), 2 * size, "0")
    kinds = [
        png,
        F.concat(text(F.lit("GIF89a")), le(w, 2), le(h, 2), pad),
        F.concat(text(F.lit("RIFF")), le(F.lit(0), 4), text(F.lit("WEBPVP8X")), le(F.lit(10), 4), F.lit("00000000"), le(w - 1, 3), le(h - 1, 3)),
        F.concat(text(F.lit("RIFF")), le(F.lit(0), 4), text(F.lit("WEBPVP8 ")), le(F.lit(10), 4), F.lit("0000009D012A"), le(w, 2), le(h, 2), pad),
        F.concat(text(F.lit("RIFF")), le(F.lit(0), 4), text(F.lit("WEBPVP8L")), le(F.lit(10), 4), F.lit("2F"), le((w - 1).bitwiseOR(F.shiftleft(h - 1, 14)), 4), pad),
        F.concat(text(F.lit("P6\n# made\n")), text(F.concat(w.cast("string"), F.lit(" "), h.cast("string"), F.lit("\n"), F.when(F.col("file_id") % 3 == 0, "255").otherwise("65535"), F.lit("\n"))), pad),
        F.concat(F.lit("49492A00"), ifd(le, lambda v: F.concat(le(v, 2), F.lit("0000")))),
        F.concat(F.lit("4D4D002A"), ifd(be_n, lambda v: F.concat(be_n(v, 2), F.lit("0000")))),
        F.concat(F.lit("00000018"), text(F.lit("ftypavif")), pad, F.lit("00000014"), text(F.lit("ispe")), F.lit("00000000"), be(w), be(h), F.lit("00000014"), text(F.lit("ispe")), F.lit("00000000"), be(h), be(F.lit(64))),
        F.concat(F.lit("00000018"), text(F.lit("ftypheic")), pad, F.lit("00000014"), text(F.lit("ispe")), F.lit("00000000"), be(w), be(h)),
        F.concat(F.lit("FFD8FFE00004"), F.lit("0000"), F.lit("FFC4000400A1"), F.lit("FFC0001108"), be_n(h, 2), be_n(w, 2), F.lit("03"), pad),
        F.concat(text(F.lit("FUJIFILMCCD-RAW ")), pad),
        F.concat(F.lit("00000018"), text(F.lit("ftypcrx ")), pad),
        F.concat(F.lit("49492A00"), F.lit("10000000"), text(F.lit("CR")), F.lit("0200"), pad),
        F.concat(F.lit("494901000000"), text(F.lit("HEAPCCDR")), pad),
        F.concat(text(F.concat(F.lit("<?xml?>"), F.when(F.col("file_id") % 32 == 15, "<svg/>").otherwise("<html/>"))), pad),
    ]
    content = F.when(F.col("file_id") % 97 == 0, F.lit("89504E470D0A1A"))
    for i, k in enumerate(kinds):
        content = content.when(F.col("kind") == i, k)
    return p.select("file_id", "kind", F.unhex(content).alias("content"))


def exif_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tags as rows: img_id, dir, seq, tag, num, den."""
    e = read(spark, sf_dir, "events")
    t = F.col("event_type")
    tag = F.when(t == "view", 0x829A).when(t == "click", 0x829D).when(t == "purchase", 0x8827).when(t == "signup", 0x920A).otherwise(0x0112)
    return e.select(F.col("user_id").alias("img_id"), (F.col("event_id") % 5).cast("int").alias("dir"), F.col("event_id").alias("seq"), tag.alias("tag"), F.floor(F.col("value") * 100.0).cast("long").alias("num"), F.when(F.col("event_id") % 50 == 7, 0).otherwise(100).cast("long").alias("den"))
