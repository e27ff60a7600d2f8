"""Metadata from tag rows: (img_id, dir, seq, tag, num, den), and its typed form, one row per image."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..data.formats import TAGS
from ..functions.numeric import rational


def last_wins(tags: DataFrame) -> DataFrame:
    """One row per image and tag: that of the last directory, and in it of the last entry. One shuffle, pre-aggregated."""
    rest = [c for c in tags.columns if c not in ("img_id", "tag")]
    best = F.max_by(F.struct(*rest), F.struct("dir", "seq")).alias("_b")
    return tags.groupBy("img_id", "tag").agg(best).select("img_id", "tag", *[F.col(f"_b.{c}").alias(c) for c in rest])


def pivot(tags: DataFrame) -> DataFrame:
    """exposure_time, f_number, focal_length (numbers), iso and orientation (whole) per image, by the last directory."""
    row = lambda name: F.max_by(F.when(F.col("tag") == TAGS[name], F.struct("num", "den")), F.when(F.col("tag") == TAGS[name], F.struct("dir", "seq")))
    p = tags.groupBy("img_id").agg(*[row(n).alias(n) for n in ("exposure_time", "f_number", "iso", "focal_length", "orientation")])
    number = lambda n: F.when(F.col(n).isNotNull(), rational(F.col(n)["num"], F.col(n)["den"])).alias(n)
    return p.select("img_id", number("exposure_time"), number("f_number"), (F.col("iso.num") % 65536).alias("iso"), number("focal_length"), (F.col("orientation.num") % 8 + 1).alias("orientation"))


def rationals(tags: DataFrame) -> DataFrame:
    return tags.withColumn("value", rational(F.col("num"), F.col("den")))


def clean_ascii(s: Column) -> Column:
    """Without NULs at the end, then without white space at either."""
    return F.trim(F.regexp_replace(s, "\\x00+$", ""))


def gps_decimal(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Decimal degrees, negative south and west."""
    d = degrees + minutes / 60.0 + seconds / 3600.0
    return F.when(ref.isin("S", "W"), -d).otherwise(d)


def extra_get(extra: Column, namespace: str, tag: str) -> Column:
    """The value of the first entry of (namespace, tag) in ARRAY<STRUCT<namespace, tag, value>>, or null."""
    return F.try_element_at(F.filter(extra, lambda e: (e["namespace"] == namespace) & (e["tag"] == tag)), F.lit(1))["value"]


def extra_insert(extra: Column, namespace: str, tag: str, value: Column) -> Column:
    """Puts a value in the place of the entry of (namespace, tag), or at the end if there is none."""
    is_it = lambda e: (e["namespace"] == namespace) & (e["tag"] == tag)
    new = F.struct(F.lit(namespace).alias("namespace"), F.lit(tag).alias("tag"), value.alias("value"))
    return F.when(F.exists(extra, is_it), F.transform(extra, lambda e: F.when(is_it(e), new).otherwise(e))).otherwise(F.concat(extra, F.array(new)))


def merge(parts: list[DataFrame]) -> DataFrame:
    """Records of several formats under one schema; what a format lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
