"""Developments with neighbourhoods in one pass over whole frames, against the column operators step by step."""

import pytest
from pyspark.sql import functions as F

from framequarry.operators import demosaic as dm
from framequarry.operators import stencil
from framequarry.plans.develop import Options, _array_black, _array_scaled, develop, finish, neutral_gains, to_array
from framequarry.plans.develop_frames import SMALL, develop_frames
from framequarry.registry import QUERIES
from framequarry.sources import derived

SF = "/root/testdata/sf0.001"
FULL = Options(demosaic="rcd", white_balance=(2.35, 1.0, 1.65), bad_pixels="median", denoise_sigma=0.6, ca=(1.01, 0.99), gamma=2.2, crop=(0, 0, 8, 6), rescale_white=True)
COLUMNS = ("img_id", "exposure", "orientation", "camera", "width", "height", "x", "y", "r", "g", "b")


def by_columns(frames, o):
    """The same chain by pixel rows, with a shuffle wherever an array is built again."""
    keep = ["img_id", "exposure", "orientation", "camera"]
    f = _array_black(frames)
    if o.bad_pixels:
        f = to_array(stencil.correct_bad_pixels(f, 0.5, o.bad_pixels), ["v"], [c for c in frames.columns if c not in ("img_id", "width", "height", "data")])
    f = _array_scaled(f, neutral_gains(o))
    if o.demosaic == "bilinear":
        return finish(stencil.bilinear_demosaic(f).select(*keep, "width", "height", "x", "y", "r", "g", "b"), o)
    white = F.lit(65535) if o.rescale_white else F.col("white")
    rgb = dm.demosaic(f.withColumns({"white": white, "img_id": F.struct(*keep)}), o.demosaic)
    return finish(dm.to_pixels(rgb).select("img_id.*", "width", "height", "x", "y", "r", "g", "b"), o)


def odd_frames(spark):
    """Frames of three sizes, with a sample at white, one missing, unknown cameras, no exposure, odd orientations and neutrals."""
    rows = [r.asDict() for r in derived.raw_frames(spark, SF).limit(24).collect()]
    for i, r in enumerate(rows):
        r["data"][27] = 16383
        r["camera"] = [None, 99, r["camera"]][i % 3]
        r["orientation"] = [None, 0, r["orientation"], 9][i % 4]
        if i % 5 == 1:
            r["data"][30] = None
        if i % 5 == 2:
            r["width"], r["height"] = 6, 11
            r["data"] = (r["data"] * 2)[:66]
        if i % 7 == 3:
            r["width"], r["height"], r["data"] = 13, 9, (r["data"] * 2)[:117]
        if i % 6 == 4:
            r["neutral"] = [0.0, 1.0, 0.5]
    return spark.createDataFrame(rows, derived.raw_frames(spark, SF).schema)


def rows(p):
    return sorted(map(repr, map(tuple, p.select(*COLUMNS).collect())))


@pytest.mark.parametrize("o", [FULL, Options(demosaic="bilinear", bad_pixels="average", denoise_sigma=0.7, ca=(1.05, 0.97)), Options(bad_pixels="median", crop=(1, 1, 5, 4))])
def test_one_pass_gives_what_the_columns_give(spark, o):
    f = odd_frames(spark)
    got = rows(develop(f, o))
    assert got and got == rows(by_columns(f, o))


@pytest.mark.parametrize("o", [FULL, Options(demosaic="bilinear", bad_pixels="average"), Options(denoise_sigma=0.7), Options(demosaic="none", ca=(1.05, 0.97))])
def test_no_shuffle_with_neighbourhoods(spark, o):
    assert "Exchange hashpartitioning" not in develop(derived.raw_frames(spark, SF), o)._jdf.queryExecution().executedPlan().toString()


def test_the_query_shuffles_nothing(spark):
    assert "Exchange hashpartitioning" not in QUERIES["develop_options"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_frames_of_one_id_stay_apart(spark):
    f = derived.raw_frames(spark, SF).limit(3).withColumn("img_id", F.lit(7).cast("long"))
    p = develop(f, FULL).groupBy("x", "y", "width").count().collect()
    assert sum(r["count"] for r in p) == 3 * 48


def test_frames_that_cannot_be_developed_have_an_error(spark):
    f = [r.asDict() for r in derived.raw_frames(spark, SF).limit(6).collect()]
    f[0]["data"], f[1]["data"], f[2]["width"], f[3]["white"], f[4]["black"] = None, [1, 2, 3], None, None, [512, None, 512, 512]
    f = spark.createDataFrame(f, ", ".join(f"{c} {k}" for c, k in derived.raw_frames(spark, SF).dtypes))
    got = {r.img_id: r.error for r in develop_frames(f, FULL).collect()}
    assert len(got) == 6 and sum(e is None for e in got.values()) == 1
    assert develop(f, FULL).count() == 48


def test_stacks_are_split_without_a_change():
    import numpy as np

    from framequarry.plans import develop_frames as w

    rgb = np.random.default_rng(3).integers(0, 65536, (3, SMALL // 600, 301, 3)).astype(np.int32)
    whole = w.finish(rgb, FULL)
    assert all((whole[k] == w.finish(rgb[k : k + 1], FULL)[0]).all() for k in range(3))
