"""Demosaicing against per-pixel versions in plain Python, and by properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequarry.operators import demosaic as dm

f32 = np.float32


def neighbours(raw, colour, y, x, want, places):
    h, w = raw.shape
    return [(yy, xx) for dx, dy in places if 0 <= (yy := y + dy) < h and 0 <= (xx := x + dx) < w and colour[yy, xx] == want]


DIAGONAL, SIDE, POST = [(-1, -1), (1, -1), (-1, 1), (1, 1)], [(-1, 0), (1, 0)], [(0, -1), (0, 1)]


def fill(values, colour, want, empty):
    """Mean of the places of a colour next to each place, per pixel."""
    out = np.zeros(values.shape, f32)
    for y in range(values.shape[0]):
        for x in range(values.shape[1]):
            if colour[y, x] == want:
                out[y, x] = values[y, x]
                continue
            places = DIAGONAL if colour[y, x] != 1 else SIDE if want in colour[y] else POST
            got, total = neighbours(values, colour, y, x, want, places), f32(0)
            for p in got:
                total = f32(total + values[p])
            out[y, x] = f32(total / f32(len(got))) if got else f32(empty)
    return out


def estimates(raw, y, x):
    h, w = raw.shape
    at = lambda dx, dy: raw[min(max(y + dy, 0), h - 1), min(max(x + dx, 0), w - 1)]
    out = []
    for go in (lambda k: at(k, 0), lambda k: at(0, k)):
        bend = f32(f32(2) * raw[y, x] - go(-2) - go(2))
        out += [f32((go(-1) + go(1)) * f32(0.5) + bend * f32(0.25)), f32(abs(go(-1) - go(1)) + abs(bend))]
    return out


def plain_green(raw, colour):
    out = raw.copy()
    for y, x in zip(*np.nonzero(colour != 1), strict=True):
        gh, dh, gv, dv = estimates(raw, y, x)
        if dh < dv * f32(0.5):
            g = gh
        elif dv < dh * f32(0.5):
            g = gv
        else:
            wh, wv = f32(1) / (dh + f32(1e-5)), f32(1) / (dv + f32(1e-5))
            g = (wh * gh + wv * gv) / (wh + wv)
        out[y, x] = max(f32(g), f32(0))
    return out


def whole(x, white):
    return np.clip(np.floor(x.astype(float) + 0.5), 0, white).astype(int)


def plain_rcd(raw, colour, white):
    g = plain_green(raw, colour)
    ratio = raw / np.maximum(g, f32(1))
    r, b = (np.where(colour == c, raw, np.clip(g * fill(ratio, colour, c, 1), 0, white)) for c in (0, 2))
    return whole(r, white), whole(g, white), whole(b, white)


def plain_amaze(raw, colour, white):
    h, w = raw.shape
    g, plane = plain_green(raw, colour), np.zeros((2, h, w), f32)
    for y in range(h):
        for x in range(w):
            gh, _, gv, _ = estimates(raw, y, x)
            plane[:, y, x] = (raw[y, x], raw[y, x]) if colour[y, x] == 1 else (gh, gv)
    for y in range(3, h - 3):
        for x in range(3, w - 3):
            if colour[y, x] == 1:
                continue
            votes = [0, 0]
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    e = [abs(p[y + dy, x + dx] - raw[y + dy, x + dx]) + abs(p[y + dy, x + dx] - p[y, x]) for p in plane]
                    votes[0] += e[0] < e[1]
                    votes[1] += e[1] < e[0]
            a, b = plane[:, y, x]
            wh, wv = f32(votes[0] + 1), f32(votes[1] + 1)
            g[y, x] = max(f32(0), a if votes[0] > votes[1] + 1 else b if votes[1] > votes[0] + 1 else f32((wh * a + wv * b) / (wh + wv)))
    out = []
    for c in (0, 2):
        full = np.where(colour == c, raw, g + fill(raw - g, colour, c, 0))
        diff, done = full - g, full.copy()
        for y in range(2, h - 2):
            for x in range(2, w - 2):
                near = [diff[y, x - 1], diff[y, x + 1], diff[y - 1, x], diff[y + 1, x]]
                mean = f32((near[0] + near[1] + near[2] + near[3]) * f32(0.25))
                wild = f32(abs(near[0] - mean) + abs(near[1] - mean) + abs(near[2] - mean) + abs(near[3] - mean))
                if abs(diff[y, x] - mean) > f32(wild * f32(1.5) + f32(1)):
                    done[y, x] = g[y, x] + mean
        out.append(whole(done, white))
    return out[0], whole(g, white), out[1]


def plain_lmmse(raw, colour, white):
    h, w = raw.shape
    plane = np.zeros((2, h, w), f32)
    for y in range(h):
        for x in range(w):
            gh, _, gv, _ = estimates(raw, y, x)
            plane[:, y, x] = raw[y, x] if colour[y, x] == 1 else np.clip([gh, gv], 0, white)
    g = raw.copy()
    for y, x in zip(*np.nonzero(colour != 1), strict=True):
        weight = []
        for p in plane:
            s = q = f32(0)
            for dy in range(-2, 3):
                for dx in range(-2, 3):
                    at = min(max(y + dy, 0), h - 1), min(max(x + dx, 0), w - 1)
                    e = f32(raw[at] - p[at])
                    s, q = f32(s + e), f32(q + f32(e * e))
            weight.append(f32(1) / f32((q - s * s / f32(25)) / f32(25) + f32(1e-5)))
        g[y, x] = np.clip(f32((weight[0] * plane[0, y, x] + weight[1] * plane[1, y, x]) / (weight[0] + weight[1])), 0, white)
    r, b = (np.where(colour == c, raw, np.clip(g + fill(raw - g, colour, c, 0), 0, white)) for c in (0, 2))
    return whole(r, white), whole(g, white), whole(b, white)


def inverse_distance(values, colour, want, reach, empty):
    h, w = values.shape
    out = values.copy()
    for y, x in zip(*np.nonzero(colour != want), strict=True):
        total = weight = f32(0)
        for dy in range(-reach, reach + 1):
            for dx in range(-reach, reach + 1):
                if 0 <= y + dy < h and 0 <= x + dx < w and colour[y + dy, x + dx] == want:
                    k = f32(1) / f32(f32(dx * dx + dy * dy) + f32(0.1))
                    total, weight = f32(total + f32(values[y + dy, x + dx] * k)), f32(weight + k)
        out[y, x] = f32(total / weight) if weight > 0 else empty(y, x)
    return out


def plain_markesteijn(raw, colour, white, passes=1):
    g = inverse_distance(raw, colour, 1, 2, lambda y, x: raw[y, x])
    for last in [True] if passes == 1 else [False, True]:
        d = {c: inverse_distance(raw - g, colour, c, 3, lambda y, x: f32(0)) for c in (0, 2)}
        if not last:
            for c in (0, 2):
                g = np.where(colour == c, (g + (raw - d[c])) * f32(0.5), g)
    return tuple(np.clip(p, 0, white).astype(int) for p in (g + d[0], g, g + d[2]))


def plain_fast(raw, colour, white):
    h, w = raw.shape
    out = np.zeros((3, h, w), int)
    for y in range(h):
        for x in range(w):
            for c in range(3):
                v = raw[y, x]
                for reach in (1, 2, 3) if colour[y, x] != c else ():
                    near = [raw[yy, xx] for yy in range(max(0, y - reach), min(h, y + reach + 1)) for xx in range(max(0, x - reach), min(w, x + reach + 1)) if colour[yy, xx] == c]
                    if near:
                        v = f32(sum(near, f32(0)) / f32(len(near)))
                        break
                out[c, y, x] = min(max(v, 0), white)
    return tuple(out)


PLAIN = {"amaze": plain_amaze, "lmmse": plain_lmmse, "rcd": plain_rcd, "markesteijn": plain_markesteijn, "markesteijn3": lambda *a: plain_markesteijn(*a, passes=3), "xtrans_fast": plain_fast}


def frame(seed, h, w, top=16383):
    return np.random.default_rng(seed).integers(0, top + 1, (h, w)).astype(f32)


@pytest.mark.parametrize("method", PLAIN)
@pytest.mark.parametrize("cfa", ["RGGB", "GRBG", "BGGR", "GBRG"])
@pytest.mark.parametrize("shape", [(6, 6), (8, 8), (9, 13)])
def test_against_plain(method, cfa, shape):
    colour = dm.colours(dm.XTRANS if method in dm.TILED else cfa, *shape)
    raw, white = frame(sum(shape), *shape), 12000
    got = dm.METHODS[method](raw[None], colour, np.array([white], f32)[:, None, None])
    for g, want in zip(got, PLAIN[method](raw, colour, white), strict=True):
        assert np.array_equal(g[0], want)


def frames(spark, images, cfa="RGGB", white=16383):
    rows = [(i, x.shape[1], x.shape[0], cfa, white, [int(v) for v in x.ravel()]) for i, x in enumerate(images)]
    return spark.createDataFrame(rows, "img_id long, width int, height int, cfa string, white int, data array<int>")


@pytest.mark.parametrize("method", [*PLAIN, "auto"])
def test_uniform_stays_uniform(spark, method):
    got = dm.demosaic(frames(spark, [np.full((12, 10), 777), np.full((6, 6), 5)]), method).collect()
    lowest = 1 if method in dm.TILED else 0  # weights of FLOAT need not sum to one, and the result is cut
    assert all(v - lowest <= x <= v for r, v in zip(got, (777, 5), strict=True) for x in r.r + r.g + r.b)


def test_white_clamps_and_small_frames_are_rows(spark):
    f = frames(spark, [np.full((8, 8), 9000), np.full((5, 8), 1)], white=100)
    f = f.union(f.select(F.lit(7).cast("long"), "width", "height", "cfa", "white", F.array(F.lit(1)))).union(f.limit(1).select(F.lit(8).cast("long"), "width", "height", "cfa", "white", F.lit(None).cast("array<int>")))
    got = {r.img_id: r for r in dm.demosaic(f, "amaze").collect() if r.img_id != 7}
    assert set(got[0].r) == {100} and got[1].error == "frame under 6 x 6" and got[1].r is None and got[8].error
    assert dm.to_pixels(dm.demosaic(f, "amaze")).count() == 64


def test_unknown_method():
    with pytest.raises(ValueError):
        dm.resolve("best")


def test_smooth_gradient_is_kept(spark):
    y, x = np.mgrid[0:24, 0:24]
    g = (x / 24 + y / 24) * 0.5 * 8000
    for m in ("amaze", "lmmse", "rcd"):
        r = dm.demosaic(frames(spark, [np.trunc(g)]), m).first()
        inner = np.abs(np.array(r.g).reshape(24, 24) - g)[4:-4, 4:-4]
        assert inner.max() < 60
