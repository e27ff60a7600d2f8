"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then three times into Spark's noop sink; its figure is the median.
Besides the seconds, megapixels a second of the operators are measured on larger frames (derived from the same table).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from framequarry.operators import demosaic, pointwise
from framequarry.plans.develop import Options
from framequarry.plans.develop_frames import develop_frames
from framequarry.registry import QUERIES
from framequarry.sources import derived

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "black_level", "wb_raw", "color_matrix", "tonemap", "orientation", "demosaic_bilinear", "demosaic_amaze", "bad_pixel_correct_median",
    "develop_bilinear", "develop_auto", "gaussian_blur", "lens_warp", "camera_lookup", "probe", "exif_extra_last_wins", "png_round_trip",
]
SIDE, TILES = 1000, 8


def session() -> SparkSession:
    s = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def seconds(df, runs: int = 3) -> float:
    out = []
    for _ in range(runs + 1):
        began = time.perf_counter()
        df().write.format("noop").mode("overwrite").save()
        out.append(time.perf_counter() - began)
    return statistics.median(out[1:])


def large_frames(spark: SparkSession):
    """TILES frames of 1000 x 1000 samples from a rule, in as many partitions."""
    data = F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), lambda i: ((i.cast("long") * 7919 + F.col("id") * 31) % 16384).cast("int"))
    f = spark.range(0, TILES, 1, TILES).select(
        F.col("id").alias("img_id"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), F.lit("RGGB").alias("cfa"), F.lit(16383).alias("white"),
        F.array(*map(F.lit, derived.BLACK)).alias("black"), F.lit(0.0).alias("exposure"), F.lit(6).alias("orientation"), F.lit(5).alias("camera"),
        F.array(F.lit(0.5), F.lit(1.0), F.lit(0.6)).alias("neutral"), data.alias("data"),
    )
    path = "/tmp/fq-bench-frames"
    f.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def main() -> None:
    spark = session()
    got = {n: round(seconds(lambda n=n: QUERIES[n](spark, SF_DIR)), 4) for n in HEADLINE}
    rates = {}
    if "--no-large" not in sys.argv:
        f = large_frames(spark)
        megapixels = SIDE * SIDE * TILES / 1e6
        jobs = {
            "black_level": lambda: pointwise.black_level(derived.pixels(f)),
            "white_balance": lambda: pointwise.mosaic_white_balance(derived.pixels(f), F.lit(2.35), F.lit(1.0), F.lit(1.65)),
            "demosaic_amaze": lambda: demosaic.demosaic(f, "amaze"),
            "develop_frames_bilinear": lambda: develop_frames(f, Options(demosaic="bilinear")),
            "develop_frames_auto": lambda: develop_frames(f),
        }
        rates = {n: round(megapixels / seconds(j, 2), 1) for n, j in jobs.items()}
    print(json.dumps({"metric": "image queries, sum of medians", "value": round(sum(got.values()), 3), "unit": "sec", "queries": got, "sf": SF_DIR.rsplit("sf", 1)[-1], "megapixels_per_sec": rates, "cpus": int(CPUS)}))
    spark.stop()


if __name__ == "__main__":
    main()
