"""Calibration tables and their lookups: small dimension tables, broadcast (their size is fixed here)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..data.calibration import CAMERAS, CONSTANTS, ILLUMINANTS, XYZ_TO_SRGB
from ..functions.matrix import inverse, lit9, product


def cameras(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(CAMERAS)], "ordinal int, model string, cm1 array<double>, ill1 int, cm2 array<double>, ill2 int")


def illuminants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *x) for i, x in enumerate(ILLUMINANTS)], "ordinal int, name string, exif_code int, cct int, x double, y double")


def constants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, i, v) for k, vs in CONSTANTS.items() for i, v in enumerate(vs)], "name string, i int, value double")


def camera_exact(df: DataFrame, model: str) -> DataFrame:
    c = cameras(df.sparkSession).withColumnRenamed("model", "camera")
    return df.join(F.broadcast(c), df[model] == F.col("camera"), "left")


def camera_fuzzy(df: DataFrame, model: str, key: list[str]) -> DataFrame:
    """The first row of the table that contains the model or is contained in it, by case; misses stay, with nulls.

    Distinct models are matched first, so the theta join is as large as the set of models.
    """
    c = cameras(df.sparkSession).withColumnRenamed("model", "camera")
    models = df.select(F.col(model).alias("_m")).distinct()
    hit = models.join(F.broadcast(c), F.contains("_m", "camera") | F.contains("camera", "_m"))
    first = hit.groupBy("_m").agg(F.min_by(F.struct("ordinal", "camera", "cm1", "ill1", "cm2", "ill2"), "ordinal").alias("_c")).select("_m", "_c.*")
    return df.join(first, df[model].eqNullSafe(first["_m"]), "left").drop("_m")


def illuminant_by_code(df: DataFrame, code: str) -> DataFrame:
    i = illuminants(df.sparkSession).drop("ordinal")
    return df.join(F.broadcast(i), df[code] == F.col("exif_code"), "left")


def illuminant_by_name(df: DataFrame, name: str) -> DataFrame:
    i = illuminants(df.sparkSession).drop("ordinal").withColumnRenamed("name", "illuminant")
    return df.join(F.broadcast(i), F.lower(df[name]) == F.lower("illuminant"), "left")


def illuminant_nearest(df: DataFrame, cct: str, out: str = "illuminant") -> DataFrame:
    """The name of the nearest temperature; the first in the table wins ties. A fold over the six rows, no join."""
    near = lambda t: F.abs(F.col(cct).cast("long") - F.lit(t))
    best = F.least(*[near(t) for _, _, t, _, _ in ILLUMINANTS])
    pick: Column | None = None
    for name, _, t, _, _ in ILLUMINANTS:
        pick = F.when(near(t) == best, name) if pick is None else pick.when(near(t) == best, name)
    return df.withColumn(out, pick)


def xyz(x: Column, y: Column) -> tuple[Column, Column, Column]:
    return x / y, F.lit(1.0), (F.lit(1.0) - x - y) / y


def camera_to_srgb(matrix: Column) -> Column:
    """ARRAY<FLOAT> of nine from XYZ-to-camera; null if it is singular."""
    return product(lit9(XYZ_TO_SRGB), inverse(matrix)).cast("array<float>")


def interpolate(m1: Column, t1: Column, m2: Column, t2: Column, scene: Column) -> Column:
    """Weight by reciprocal temperature, clamped to 0..1; equal temperatures give the first matrix."""
    one = F.lit(1.0)
    span = one / t2.cast("double") - one / t1.cast("double")
    t = F.when(F.abs(span) < 1e-12, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(one, (one / scene.cast("double") - one / t1.cast("double")) / F.nullif(span, F.lit(0.0)))))
    return F.array(*[(one - t) * m1[i] + t * m2[i] for i in range(9)])


def estimate_cct(neutral: Column) -> Column:
    floor = F.lit(1e-6)
    return F.greatest(F.lit(2000.0), F.least(F.lit(10000.0), F.lit(3000.0) + F.lit(9000.0) * (F.greatest(neutral[2], floor) / F.greatest(neutral[0], floor)))).cast("float")
