"""Queries against their SQL, and image operators by property, on small inputs."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from framequarry.functions.numeric import round_u16, trunc_u16, white_level
from framequarry.operators import formats, geometry, metadata, pointwise, stencil
from framequarry.plans.develop import Options, develop
from framequarry.plans.develop_frames import develop_frames, to_pixels
from framequarry.registry import QUERIES, SQL
from framequarry.sources import derived

SF = "/root/testdata/sf0.001"
TABLES = "customer supplier part embeddings pages events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def same(v):
    return repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows, cols = df.collect(), sorted(df.columns)
    if name not in SQL:
        assert rows
        return
    r = duck.sql(SQL[name])
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    assert sorted(tuple(same(x[c]) for c in cols) for x in rows) == sorted(tuple(same(x[i]) for i in at) for x in r.fetchall())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_fixture_sums(spark):
    p = derived.pixels(derived.raw_frames(spark, "/root/testdata/sf0.01"))
    r = p.agg(F.count("*"), F.sum("v"), F.min("v"), F.max("v"), F.sum(F.col("v") * (F.col("y") * 8 + F.col("x") + 1))).first()
    assert tuple(r) == (32000, 262101865, 3889, 11945, 8512672994)
    r = derived.rgb_pixels(spark, "/root/testdata/sf0.01").agg(F.count("*"), F.sum("r"), F.sum("g"), F.sum("b")).first()
    assert tuple(r) == (10624, 348378428, 347911999, 348017940)


def test_numbers(spark):
    t = spark.createDataFrame([(-1.5,), (2.5,), (2.999,), (70000.0,), (float("nan"),)], "x double").select(trunc_u16(F.col("x").cast("float")).alias("t"), round_u16(F.col("x").cast("float")).alias("r"))
    assert [r.t for r in t.collect()] == [0, 2, 2, 65535, 0]
    assert [r.r for r in t.collect()] == [0, 3, 3, 65535, 0]
    w = spark.createDataFrame([(b,) for b in (0, 1, 8, 14, 16, 20)], "b int").select(white_level(F.col("b")).alias("w"))
    assert [r.w for r in w.collect()] == [0, 1, 255, 16383, 65535, 65535]


def pixel_frame(spark, w=5, h=3):
    return spark.createDataFrame([(1, w, h, x, y, x, y, x * y) for y in range(h) for x in range(w)], "img_id long, width int, height int, x int, y int, r int, g int, b int")


def rows(p):
    return sorted(map(tuple, p.select("width", "height", "x", "y", "r", "g", "b").collect()))


def test_orientations(spark):
    p = pixel_frame(spark)
    flip, left, right = geometry.flip_horizontal, geometry.rotate_90_ccw, geometry.rotate_90_cw
    assert rows(left(right(p))) == rows(flip(flip(p))) == rows(geometry.rotate_180(geometry.rotate_180(p))) == rows(p)
    assert rows(geometry.orient(p, 5)) == rows(left(flip(p)))
    assert rows(geometry.orient(p, 7)) == rows(right(flip(p)))
    assert rows(geometry.orient(p, 3)) == rows(geometry.flip_vertical(flip(p)))
    assert rows(geometry.orient(p, 0)) == rows(geometry.orient(p, 9)) == rows(p)
    assert rows(geometry.crop(p, 3, 0, 3, 1)) == rows(p)
    assert rows(geometry.crop(p, 1, 1, 2, 2)) == sorted((2, 2, x - 1, y - 1, x, y, x * y) for x in (1, 2) for y in (1, 2))


def test_identities(spark):
    p = pixel_frame(spark)
    eye = [1.0, 0, 0, 0, 1, 0, 0, 0, 1]
    for q in (pointwise.color_matrix(p, eye), pointwise.matrix_f64(p, eye), pointwise.white_balance(p, (1.0, 1.0, 1.0)), pointwise.gamma(p, 1.0005)):
        assert rows(q) == rows(p)


def test_tone_rises_with_exposure(spark):
    p = spark.createDataFrame([(v, v, v) for v in range(0, 65536, 4369)], "r int, g int, b int")
    curves = [[r.r for r in pointwise.tonemap(p, F.lit(ev)).collect()] for ev in (-1.0, 0.0, 1.0)]
    assert all(c == sorted(c) and c[0] == 0 and c[-1] == 65535 for c in curves)
    assert all(a <= b <= c for a, b, c in zip(*curves, strict=True))


def test_stencils_of_a_uniform_frame(spark):
    f = spark.createDataFrame([(1, 7, 5, [1234] * 105)], "img_id long, width int, height int, data array<int>")
    for q in (stencil.gaussian_blur(f, 2.0, 3), stencil.bilateral(f, 1.0, 100.0, 1), stencil.warp(f, (0.1, 0, 0, 0)), stencil.chromatic_aberration(f, 1.1, 0.9)):
        assert {tuple(r) for r in q.select("r", "g", "b").collect()} == {(1234,) * 3} and q.count() == 35


def test_development_options(spark):
    f = derived.raw_frames(spark, SF).limit(6)
    for o in (Options(), Options(demosaic="none", gamma=1.8), Options(demosaic="bilinear", denoise_sigma=0.5, ca=(1.1, 1.0)), Options(bad_pixels="average", white_balance=(2.0, 1.0, 1.5), color_matrix=(1.0, 0, 0, 0, 1, 0, 0, 0, 1))):
        p = develop(f, o).select("img_id", "r", "g", "b").collect()
        assert len(p) == 6 * 64 and all(0 <= v <= 65535 for r in p for v in (r.r, r.g, r.b))


@pytest.mark.parametrize("o", [Options(demosaic="none"), Options(demosaic="lmmse", gamma=2.2, crop=(1, 1, 6, 6)), Options(demosaic="bilinear", bad_pixels="average", denoise_sigma=0.7, ca=(1.05, 0.97)), Options(demosaic="rcd", white_balance=(2.0, 1.0, 1.5), rescale_white=True, bad_pixels="median", color_matrix=(0.9, 0.1, 0, 0, 1, 0, 0.2, 0, 0.8))], ids=lambda o: o.demosaic)
def test_whole_frames_develop_alike(spark, o):
    f = derived.raw_frames(spark, SF).limit(40).withColumn("data", F.transform("data", lambda x, i: F.when(i == 27, F.lit(16383)).otherwise(x)))
    f = spark.createDataFrame(f.collect(), f.schema)
    want = {(r.img_id, r.x, r.y): (r.width, r.height, r.r, r.g, r.b) for r in develop(f, o).collect()}
    got = {(r.img_id, r.x, r.y): (r.width, r.height, r.r, r.g, r.b) for r in to_pixels(develop_frames(f, o)).collect()}
    assert got.keys() == want.keys()
    assert max(abs(a - b) for k in got for a, b in zip(got[k], want[k], strict=True)) <= 1  # tables by numpy's pow and exp


def test_unscaled_white_caps_the_demosaic(spark):
    f = derived.raw_frames(spark, SF).limit(4)
    flat = Options(color_matrix=(1.0, 0, 0, 0, 1, 0, 0, 0, 1), gamma=1.0)
    low = develop(f, flat).agg(F.max("g")).first()[0]
    high = develop(f, Options(**{**flat.__dict__, "rescale_white": True})).agg(F.max("g")).first()[0]
    assert low <= 16383 < high


def test_plan_needs_no_shuffle_before_tone(spark):
    f = derived.raw_frames(spark, SF)
    for q in (stencil.bilinear_demosaic(f), pointwise.black_level(derived.pixels(f)), develop(f, Options(demosaic="bilinear"))):
        assert "Exchange hashpartitioning" not in q._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_what_it_needs(spark):
    plan = pointwise.black_level(derived.pixels(derived.raw_frames(spark, SF))).select("img_id", "v").where("img_id < 10")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(vec_id,10)" in plan


# --- files


def test_sniff_order_and_short_files(spark):
    cases = {b"GIF89a..": "GIF", b"\xff\xd8\xff\xe0....": "JPEG", b"\xff\x0a......": "JXL", b"\0\0\0\x0cJXL \r\n\x87\n": "JXL", b"\0\0\0\x18ftypmif1": "AVIF", b"\0\0\0\x18ftypapv1": "APV", b"P6 3 3 255": "PPM", b"P4 3 3 255": None, b"Pf\n1 1\n-1": "PPM", b"<svg xmlns": "SVG", b"<!-- a --><svg/>": "SVG", b"<?xml version": None, b"\x89PNG\r\n": None, b"": None}
    t = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)] + [(99, None)], "file_id long, content binary")
    got = [r.f for r in t.select("file_id", formats.sniff_standard(F.col("content")).alias("f")).orderBy("file_id").collect()]
    assert got == [*cases.values(), None]


def test_probes_of_odd_files(spark):
    be = lambda n: n.to_bytes(4, "big")
    box = lambda w, h: b"\0\0\0\x14ispe\0\0\0\0" + be(w) + be(h)
    cases = [
        (b"\0\0\0\x18ftypavif" + box(2, 3) + box(3, 2) + box(1, 1), (2, 3, None)),
        (b"P5\n#x\n 7 # y\n9\n70000 ", (7, 9, 16)),
        (b"P6 7 x 255  ", None),
        (b"II\x2a\0\xff\xff\xff\xff", None),
        (b"\xff\xd8\xff\xff\xc2\0\x11\x08\0\x05\0\x06\x03", (6, 5, 8)),
        (b"\xff\xd8\xff\xe0\0\x02\xff\xd9\0", None),
        (b"\x89PNG\r\n\x1a\n....IDAT" + bytes(20), None),
        (None, None),
    ]
    t = spark.createDataFrame([(i, c if c is None else bytearray(c)) for i, (c, _) in enumerate(cases)], "file_id long, content binary")
    for r in formats.probe(t).collect():
        want = cases[r.file_id][1]
        assert (r.width, r.height, r.bit_depth) == (want or (None,) * 3) and (r.error is None) == (want is not None)


def test_metadata_rules(spark):
    tags = spark.createDataFrame([(1, 0, 9, 0x829A, 1, 125), (1, 2, 1, 0x829A, 1, 60), (1, 2, 3, 0x829A, 7, 0), (2, 0, 0, 0x8827, 70000, 1)], "img_id long, dir int, seq long, tag int, num long, den long")
    got = {(r.img_id, r.tag): (r.dir, r.seq) for r in metadata.last_wins(tags).collect()}
    assert got == {(1, 0x829A): (2, 3), (2, 0x8827): (0, 0)}
    p = {r.img_id: r for r in metadata.pivot(tags).collect()}
    assert np.isnan(p[1].exposure_time) and p[1].iso is None and p[2].iso == 70000 % 65536 and p[2].exposure_time is None
