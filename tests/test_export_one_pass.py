"""Export in one Python process a task, against development and encoding as steps of their own."""

import pytest
from pyspark.sql import functions as F

from framequarry.operators import codecs, embedded
from framequarry.plans.develop import Options
from framequarry.plans.develop_frames import develop_frames
from framequarry.plans.export import export
from framequarry.sources import derived

SF = "/root/testdata/sf0.001"
BILINEAR = Options(demosaic="bilinear")


def frames(spark):
    """Some do not fill their size, and are rows with an error."""
    f = derived.raw_frames(spark, SF).limit(20)
    return f.withColumns({"model": F.concat(F.lit("m"), F.col("img_id").cast("string")), "data": F.when(F.col("img_id") % 5 != 2, F.col("data"))})


def in_steps(f, kind, **encoding):
    fields = [F.col("model"), F.when(F.col("orientation").isNotNull(), F.lit(1)).alias("orientation")]
    if kind != "png":
        return codecs.encode(develop_frames(f, BILINEAR), kind, 16, **encoding)
    rgb = develop_frames(f.withColumn("notes", F.struct(*fields)), BILINEAR, keep=("notes",))
    return codecs.encode(rgb.withColumn("icc", F.lit(bytearray(embedded.srgb_profile()))), kind, 16, **encoding)


@pytest.mark.parametrize("kind,encoding", [("png", {"level": "fast", "filter": "min_sum_abs"}), ("ppm", {})])
def test_one_process_makes_the_same_files(spark, kind, encoding):
    f = frames(spark)
    made = export(f, BILINEAR, kind, **encoding)
    assert made.dtypes == [("img_id", "bigint"), ("content", "binary"), ("error", "string")]
    got, want = ({r.img_id: (r.content, r.error) for r in x.collect()} for x in (made, in_steps(f, kind, **encoding)))
    assert got == want and len(got) == 20 and sum(e is not None for _, e in got.values()) == 4


def test_export_is_one_python_step(spark):
    plan = export(frames(spark), BILINEAR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
