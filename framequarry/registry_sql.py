"""DuckDB SQL for the image queries: written from the definitions, independently of the DataFrame code."""

from __future__ import annotations

import math

from . import demosaic_sql
from .data.calibration import CAMERAS, CONSTANTS, ILLUMINANTS, XYZ_TO_SRGB
from .data.formats import CODECS, COLOR_DESCRIPTIONS, ENCODE_DEFAULTS, EXTENSIONS, FORMATS

GAINS = (2.35, 1.0, 1.65)
MATRIX = [1.5, -0.375, -0.125, -0.25, 1.375, -0.125, 0.0625, -0.5, 1.4375]
SQL: dict[str, str] = {}


def dbl(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def flt(x: float) -> str:
    return f"CAST('{x!r}' AS FLOAT)"


def i32(x: str) -> str:
    return f"CAST(trunc({x}) AS INTEGER)"


FRAMES = """f AS (SELECT vec_id AS img_id, label, list_transform(embedding, lambda e: CAST(floor((CAST(e AS DOUBLE) + 1.0::DOUBLE) * 8191.0::DOUBLE) AS INTEGER)) AS d,
 CASE label % 4 WHEN 0 THEN 'RGGB' WHEN 1 THEN 'GRBG' WHEN 2 THEN 'BGGR' ELSE 'GBRG' END AS cfa FROM embeddings)"""
GRID = "g AS (SELECT CAST(i AS INTEGER) AS i, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y FROM range(64) t(i))"
PX = f"""WITH {FRAMES}, {GRID},
px AS (SELECT img_id, label, cfa, d, x, y, d[i + 1] AS v, substr(cfa, (y % 2) * 2 + x % 2 + 1, 1) AS ch, substr(cfa, (y % 2) * 2 + 1, 2) AS rowc FROM f CROSS JOIN g)"""
RGBF = """e3 AS (SELECT vec_id // 3 AS img_id, vec_id % 3 AS c, list_transform(embedding, lambda e: CAST(floor((CAST(e AS DOUBLE) + 1.0::DOUBLE) * 32767.0::DOUBLE) AS INTEGER)) AS d FROM embeddings),
rf AS (SELECT a.img_id, a.d AS dr, b.d AS dg, c.d AS db FROM e3 a JOIN e3 b ON a.img_id = b.img_id AND b.c = 1 JOIN e3 c ON a.img_id = c.img_id AND c.c = 2 WHERE a.c = 0)"""
RGB = f"WITH {RGBF}, {GRID}, p AS (SELECT img_id, x, y, dr[i + 1] AS r, dg[i + 1] AS g, db[i + 1] AS b, dr, dg, db FROM rf CROSS JOIN g)"


def raw(expr: str, name: str = "v", where: str = "") -> str:
    return f"{PX} SELECT img_id, x, y, {expr} AS {name} FROM px {where}"


def rgb(r: str, g: str, b: str, extra: str = "") -> str:
    return f"{RGB} SELECT img_id, x, y, {r} AS r, {g} AS g, {b} AS b{extra} FROM p"


def each(fn) -> str:
    return rgb(fn("r"), fn("g"), fn("b"))


BLACK = "greatest(v - [512, 520, 528, 536][(y % 2) * 2 + x % 2 + 1], 0)"
SQL["black_level"] = raw(BLACK)
SQL["uniform_black"] = raw("greatest(v - 8000, 0)")
GAIN = f"CASE ch WHEN 'R' THEN {flt(GAINS[0])} WHEN 'B' THEN {flt(GAINS[2])} ELSE {flt(GAINS[1])} END"


def cut(x: str, high: str = "CAST(65535 AS FLOAT)", kind: str = "FLOAT") -> str:
    return i32(f"greatest(CAST(0 AS {kind}), least({high}, {x}))")


SQL["wb_raw"] = raw(cut(f"CAST(v AS FLOAT) * ({GAIN})"))
NORM = "CAST(trunc(least(CAST({v} AS FLOAT) * (CAST(65535 AS FLOAT) / CAST(15871 AS FLOAT)), CAST(65535 AS FLOAT))) AS INTEGER)"
SQL["normalize_16"] = raw(NORM.format(v="v"))
SQL["linear_shift"] = raw("least(v * 4, 65535)")
SQL["linearize"] = raw("least(least(v, 5999) * 5, 65535)")
SQL["cfa_color"] = raw("CASE WHEN ch = 'R' THEN 0 WHEN ch = 'B' THEN 2 WHEN contains(rowc, 'R') THEN 1 ELSE 3 END", "code")
SQL["demosaic_none"] = f"{PX} SELECT img_id, x, y, v AS r, v AS g, v AS b FROM px"

wb = lambda c, n, high="CAST(65535 AS FLOAT)": cut(f"CAST({c} AS FLOAT) * {flt(GAINS[n])}", high)
SQL["wb_rgb"] = rgb(*(wb(c, n) for n, c in enumerate("rgb")))
SQL["gains_rgb"] = rgb(*(wb(c, n, "CAST(40000 AS FLOAT)") for n, c in enumerate("rgb")))


def mat(m: list[float], r: str, g: str, b: str, kind: str = "FLOAT", high: str = "CAST(65535 AS FLOAT)") -> list[str]:
    k = flt if kind == "FLOAT" else dbl
    return [cut(f"CAST({r} AS {kind}) * {k(m[3 * i])} + CAST({g} AS {kind}) * {k(m[3 * i + 1])} + CAST({b} AS {kind}) * {k(m[3 * i + 2])}", high, kind) for i in range(3)]


SQL["color_matrix"] = rgb(*mat(MATRIX, "r", "g", "b"))
SQL["matrix_rgb"] = rgb(*mat(XYZ_TO_SRGB, "r", "g", "b", "DOUBLE", "CAST(50000 AS DOUBLE)"))
SQL["color_space_transform"] = f"{RGB}, q AS (SELECT img_id, x, y, {wb('r', 0)} AS r, {wb('g', 1)} AS g, {wb('b', 2)} AS b FROM p) SELECT img_id, x, y, " + ", ".join(f"{m} AS {c}" for m, c in zip(mat(MATRIX, "r", "g", "b"), "rgb", strict=True)) + " FROM q"
gam = lambda g: lambda c: cut(f"pow({c} / 65535.0::DOUBLE, {dbl(1 / g)}) * 65535.0::DOUBLE", "CAST(65535 AS DOUBLE)", "DOUBLE")
SQL["gamma"] = each(gam(2.2))
SQL["tone_reproduction"] = each(gam(1.8))


def oetf(x: str) -> str:
    return f"CASE WHEN {x} <= {dbl(0.0031308)} THEN {x} * {dbl(12.92)} ELSE {dbl(1.055)} * pow({x}, {dbl(1 / 2.4)}) - {dbl(0.055)} END"


def hable(x: str) -> str:
    return f"(({x}) * ({dbl(0.15)} * ({x}) + {dbl(0.05)}) + {dbl(0.004)}) / (({x}) * ({dbl(0.15)} * ({x}) + {dbl(0.5)}) + {dbl(0.06)}) - {dbl(0.02)} / {dbl(0.3)}"


def tone(c: str, gain: str) -> str:
    y = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({hable(f'{c} / 65535.0::DOUBLE * {gain}')}) / ({hable(f'greatest({gain}, {dbl(1e-6)})')})))"
    return f"CAST(floor(({oetf(y)}) * 65535.0::DOUBLE + 0.5::DOUBLE) AS INTEGER)"


EV = f"CASE img_id % 4 WHEN 1 THEN pow(2.0::DOUBLE, {dbl(-0.83)}) WHEN 2 THEN 1.0::DOUBLE WHEN 3 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END"
SQL["tonemap"] = f"{RGB}, q AS (SELECT *, {EV} AS gain FROM p) SELECT img_id, x, y, " + ", ".join(f"{tone(c, 'gain')} AS {c}" for c in "rgb") + " FROM q"
enc = lambda c: f"CASE WHEN img_id % 4 = 1 THEN CAST(floor(({oetf(f'({c} / 65535.0::DOUBLE)')}) * 65535.0::DOUBLE + 0.5::DOUBLE) AS INTEGER) ELSE {c} END"
SQL["convert_to_srgb"] = rgb(enc("r"), enc("g"), enc("b"), ", CASE WHEN img_id % 4 = 3 THEN 'Display P3' ELSE 'sRGB' END AS color, CASE WHEN img_id % 4 = 3 THEN 'no conversion from Display P3' END AS error")
SQL["pack_rgb8"] = each(lambda c: f"CAST({c} // 256 AS INTEGER)")
SQL["expand_8_to_16"] = each(lambda c: f"CAST({c} // 256 * 257 AS INTEGER)")

# --- places


def placed(x: str, y: str, w: str = "8", h: str = "8", source: str = "p") -> str:
    return f"{RGB} SELECT img_id, CAST({w} AS INTEGER) AS width, CAST({h} AS INTEGER) AS height, CAST({x} AS INTEGER) AS x, CAST({y} AS INTEGER) AS y, r, g, b FROM {source}"


SQL["flip_h"] = placed("7 - x", "y")
SQL["flip_v"] = placed("x", "7 - y")
SQL["rotate_180"] = placed("7 - x", "7 - y")
SQL["rotate_90_cw"] = placed("7 - y", "x")
SQL["rotate_90_ccw"] = placed("y", "7 - x")
CROPPED = "(SELECT img_id, x - 1 AS x, y - 2 AS y, r, g, b, img_id % 10 AS o FROM p WHERE x >= 1 AND x < 6 AND y >= 2 AND y < 6) q"
SQL["crop"] = placed("x", "y", "5", "4", CROPPED)
SQL["orientation"] = placed(
    "CASE o WHEN 2 THEN 4 - x WHEN 3 THEN 4 - x WHEN 5 THEN y WHEN 6 THEN 3 - y WHEN 7 THEN 3 - y WHEN 8 THEN y ELSE x END",
    "CASE o WHEN 3 THEN 3 - y WHEN 4 THEN 3 - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN 4 - x WHEN 8 THEN 4 - x ELSE y END",
    "CASE WHEN o IN (5, 6, 7, 8) THEN 4 ELSE 5 END", "CASE WHEN o IN (5, 6, 7, 8) THEN 5 ELSE 4 END", CROPPED,
)

# --- calibration


def arr(v: list[float] | None) -> str:
    return "NULL::DOUBLE[]" if v is None else "[" + ", ".join(dbl(x) for x in v) + "]"


num = lambda v: "NULL::INTEGER" if v is None else str(v)
CAM = "cam(ordinal, model, cm1, ill1, cm2, ill2) AS (VALUES " + ", ".join(f"({i}, '{m}', {arr(a)}, {num(p)}, {arr(b)}, {num(q)})" for i, (m, a, p, b, q) in enumerate(CAMERAS)) + ")"
ILL = "ill(ordinal, name, exif_code, cct, x, y) AS (VALUES " + ", ".join(f"({i}, '{n}', {c}, {t}, {dbl(x)}, {dbl(y)})" for i, (n, c, t, x, y) in enumerate(ILLUMINANTS)) + ")"
SQL["cameras"] = f"WITH {CAM} SELECT ordinal, model, ill1, ill2, " + ", ".join(f"{m}[{i + 1}] AS {m}_{i}" for m in ("cm1", "cm2") for i in (0, 4, 8)) + " FROM cam"
SQL["illuminants"] = f"WITH {ILL} SELECT * FROM ill"
SQL["color_constants"] = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {i}, {dbl(v)})" for k, vs in CONSTANTS.items() for i, v in enumerate(vs)) + ") t(name, i, value)"
MODELS = "m AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'ILCE-7RM5' WHEN 1 THEN 'SONY ILCE-1' || CAST(c_custkey AS VARCHAR) WHEN 2 THEN 'EOS' WHEN 3 THEN 'iphone 16 pro' ELSE 'iPhone 16 Pro Max' END AS model FROM customer)"
SQL["camera_lookup"] = f"WITH {CAM}, {MODELS}, h AS (SELECT DISTINCT m.model, c.ordinal, c.model AS camera FROM (SELECT DISTINCT model FROM m) m JOIN cam c ON contains(m.model, c.model) OR contains(c.model, m.model) QUALIFY row_number() OVER (PARTITION BY m.model ORDER BY c.ordinal) = 1) SELECT m.id, m.model, h.ordinal, h.camera FROM m LEFT JOIN h ON m.model = h.model"
SQL["camera_lookup_exact"] = f"WITH {CAM}, {MODELS} SELECT m.id, m.model, c.ordinal, c.model AS camera FROM m LEFT JOIN cam c ON m.model = c.model"
SQL["illuminant_by_code"] = f"WITH {ILL}, p AS (SELECT p_partkey AS id, CAST(p_size % 26 AS INTEGER) AS code FROM part) SELECT id, code, name, cct FROM p LEFT JOIN ill ON code = exif_code"
SQL["illuminant_by_name"] = f"WITH {ILL}, p AS (SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'd65' WHEN 1 THEN 'COOL white fluorescent' ELSE 'none' END AS asked FROM part) SELECT id, asked, name AS illuminant, exif_code FROM p LEFT JOIN ill ON lower(asked) = lower(name)"
SCENE = "CAST(2000 + (p_partkey * 37) % 6500 AS INTEGER)"
SQL["illuminant_nearest"] = f"WITH {ILL}, p AS (SELECT p_partkey AS id, {SCENE} AS cct FROM part) SELECT id, p.cct, name AS illuminant FROM p CROSS JOIN ill QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(ill.cct - p.cct), ordinal) = 1"
SQL["illuminant_xyz"] = f"WITH {ILL} SELECT name, x / y AS big_x, 1.0::DOUBLE AS big_y, (1.0::DOUBLE - x - y) / y AS big_z FROM ill"


def det(m: str) -> str:
    c = lambda i: f"{m}[{i + 1}]"
    return f"({c(0)} * ({c(4)} * {c(8)} - {c(5)} * {c(7)}) - {c(1)} * ({c(3)} * {c(8)} - {c(5)} * {c(6)}) + {c(2)} * ({c(3)} * {c(7)} - {c(4)} * {c(6)}))"


def inv(m: str, d: str) -> list[str]:
    c = lambda i: f"{m}[{i + 1}]"
    s = f"(1.0::DOUBLE / {d})"
    return [f"({c(a)} * {c(b)} - {c(e)} * {c(f)}) * {s}" for a, b, e, f in ((4, 8, 5, 7), (2, 7, 1, 8), (1, 5, 2, 4), (5, 6, 3, 8), (0, 8, 2, 6), (2, 3, 0, 5), (3, 7, 4, 6), (1, 6, 0, 7), (0, 4, 1, 3))]


def prod(a: list[str], b: list[str]) -> list[str]:
    return [f"{a[3 * r]} * {b[c]} + {a[3 * r + 1]} * {b[3 + c]} + {a[3 * r + 2]} * {b[6 + c]}" for r in range(3) for c in range(3)]


cells = lambda m: [f"{m}[{i + 1}]" for i in range(9)]
named = lambda es, kind="": ", ".join(f"{f'CAST({e} AS {kind})' if kind else e} AS m{i}" for i, e in enumerate(es))
SQL["matrix_det"] = f"WITH {CAM} SELECT model, {det('cm2')} AS det FROM cam"
SING = f"{CAM}, s AS (SELECT model, cm2 AS m FROM cam UNION ALL SELECT 'singular', [1.0::DOUBLE, 1, 1, 1, 1, 1, 1, 1, 1]), s2 AS (SELECT *, CASE WHEN abs({det('m')}) >= {dbl(1e-12)} THEN {det('m')} END AS dt FROM s)"
SQL["matrix_inverse"] = f"WITH {SING} SELECT model, {named(inv('m', 'dt'))} FROM s2"
XS = [dbl(x) for x in XYZ_TO_SRGB]
SQL["matrix_product"] = f"WITH {CAM} SELECT model, {named(prod(XS, cells('cm2')))} FROM cam"
C2S = f"ci AS (SELECT ordinal, model, [{', '.join(inv('cm2', det('cm2')))}] AS mi FROM cam), cs AS (SELECT ordinal, model, [{', '.join(f'CAST({e} AS FLOAT)' for e in prod(XS, cells('mi')))}] AS ms FROM ci)"
SQL["camera_to_srgb"] = f"WITH {CAM}, {C2S} SELECT model, {named(cells('ms'))} FROM cs"
ONE = "1.0::DOUBLE"
T = f"greatest(0.0::DOUBLE, least({ONE}, ({ONE} / scene - {ONE} / {dbl(2856.0)}) / ({ONE} / {dbl(6504.0)} - {ONE} / {dbl(2856.0)})))"
SQL["interpolate_matrix"] = f"WITH {CAM}, p AS (SELECT p_partkey AS id, CAST({SCENE} AS DOUBLE) AS scene FROM part), t AS (SELECT id, {T} AS t, cm1, cm2 FROM p, cam WHERE model = 'iPhone 15 Pro Max') SELECT id, {named([f'({ONE} - t) * cm1[{i + 1}] + t * cm2[{i + 1}]' for i in range(9)])} FROM t"
SQL["estimate_cct"] = f"SELECT vec_id AS img_id, CAST(greatest({dbl(2000.0)}, least({dbl(10000.0)}, {dbl(3000.0)} + {dbl(9000.0)} * ({dbl(0.6)} / ({dbl(0.45)} + {dbl(0.05)} * label)))) AS FLOAT) AS cct FROM embeddings"

# --- neighbours


def bil(data: str) -> tuple[str, str, str]:
    def at(dx: int, dy: int) -> str:
        x, y = (f"greatest(x - 1, 0)" if dx < 0 else f"(x + {dx})"), (f"greatest(y - 1, 0)" if dy < 0 else f"(y + {dy})")
        e = f"{data}[{y} * 8 + {x} + 1]"
        out = [f"{a} > 7" for a, k in ((x, dx), (y, dy)) if k > 0]
        return f"(CASE WHEN {' OR '.join(out)} THEN 0 ELSE {e} END)" if out else e

    mean = lambda *ps: f"CAST(({' + '.join(at(*p) for p in ps)}) // {len(ps)} AS INTEGER)"
    h, ve = mean((-1, 0), (1, 0)), mean((0, -1), (0, 1))
    cross, diag = mean((-1, 0), (1, 0), (0, -1), (0, 1)), mean((-1, -1), (1, -1), (-1, 1), (1, 1))
    own = at(0, 0)
    red = f"CASE WHEN ch = 'R' THEN {own} WHEN ch = 'B' THEN {diag} WHEN contains(rowc, 'R') THEN {h} ELSE {ve} END"
    blue = f"CASE WHEN ch = 'B' THEN {own} WHEN ch = 'R' THEN {diag} WHEN contains(rowc, 'R') THEN {ve} ELSE {h} END"
    return red, f"CASE WHEN ch = 'G' THEN {own} ELSE {cross} END", blue


SQL["demosaic_bilinear"] = f"{PX} SELECT img_id, x, y, {bil('d')[0]} AS r, {bil('d')[1]} AS g, {bil('d')[2]} AS b FROM px"

PLANT = "CASE WHEN x = 3 AND y = 3 THEN 16383 WHEN x = 5 AND y = 2 AND img_id % 2 = 1 THEN 0 ELSE v END"
NEAR = f"""{PX}, pp AS (SELECT img_id, x, y, {PLANT} AS v FROM px),
nb AS (SELECT a.img_id, a.x, a.y, any_value(a.v) AS v, list(b.v ORDER BY b.v) AS s FROM pp a JOIN pp b ON a.img_id = b.img_id AND abs(a.x - b.x) IN (0, 2) AND abs(a.y - b.y) IN (0, 2) AND NOT (a.x = b.x AND a.y = b.y) GROUP BY a.img_id, a.x, a.y),
st AS (SELECT img_id, x, y, v, CAST(CASE WHEN len(s) % 2 = 1 THEN s[len(s) // 2 + 1] ELSE (s[len(s) // 2] + s[len(s) // 2 + 1]) // 2 END AS INTEGER) AS median, CAST(list_sum(s) // len(s) AS INTEGER) AS average, CAST(len(s) AS INTEGER) AS n FROM nb),
bd AS (SELECT *, median > 0 AND abs(CAST(v AS FLOAT) - CAST(median AS FLOAT)) > {flt(0.5)} * CAST(median AS FLOAT) AS bad FROM st)"""
SQL["same_colour"] = f"{NEAR} SELECT img_id, x, y, v, median, average, n FROM st"
SQL["bad_pixel_detect"] = f"{NEAR} SELECT img_id, x, y, v, median FROM bd WHERE bad"
SQL["bad_pixel_correct_median"] = f"{NEAR} SELECT img_id, x, y, CASE WHEN bad THEN median ELSE v END AS v FROM bd"
SQL["bad_pixel_correct_average"] = f"{NEAR} SELECT img_id, x, y, CASE WHEN bad THEN average ELSE v END AS v FROM bd"
SQL["bad_pixel_correct_list"] = f"{NEAR} SELECT img_id, x, y, CASE WHEN (x = 3 AND y = 3) OR (x = 5 AND y = 2) THEN median ELSE v END AS v FROM bd"

KERNEL = [math.exp(-(k * k) / (2 * 1.2 * 1.2)) for k in range(-2, 3)]
KERNEL = [k / sum(KERNEL) for k in KERNEL]


def blur(axis: str, source: str, out: str) -> str:
    def one(c: str) -> str:
        acc, tot = "0.0::DOUBLE", "0.0::DOUBLE"
        for k, w in zip(range(-2, 3), KERNEL, strict=True):
            n = f"({axis} + ({k}))"
            place = f"y * 8 + {n} + 1" if axis == "x" else f"{n} * 8 + x + 1"
            ok = f"{n} >= 0 AND {n} < 8"
            acc = f"({acc} + CASE WHEN {ok} THEN d{c}[{place}] * {dbl(w)} ELSE 0.0::DOUBLE END)"
            tot = f"({tot} + CASE WHEN {ok} THEN {dbl(w)} ELSE 0.0::DOUBLE END)"
        return f"CAST(floor({acc} / {tot} + 0.5::DOUBLE) AS INTEGER)"

    return f"{out} AS (SELECT img_id, x, y, {one('r')} AS r, {one('g')} AS g, {one('b')} AS b FROM {source})"


SQL["gaussian_blur"] = f"{RGB}, {blur('x', 'p', 'h')}, hl AS (SELECT img_id, list(r ORDER BY y, x) AS dr, list(g ORDER BY y, x) AS dg, list(b ORDER BY y, x) AS db FROM h GROUP BY img_id), hp AS (SELECT img_id, dr, dg, db, x, y FROM hl CROSS JOIN g), {blur('y', 'hp', 'vv')} SELECT * FROM vv"


def bilat(c: str) -> str:
    n, dn = "0.0::DOUBLE", "0.0::DOUBLE"
    for dy in range(-2, 3):
        for dx in range(-2, 3):
            ok = f"x + ({dx}) BETWEEN 0 AND 7 AND y + ({dy}) BETWEEN 0 AND 7"
            val = f"CAST(d{c}[(y + ({dy})) * 8 + x + ({dx}) + 1] AS DOUBLE)"
            diff = f"({c}::DOUBLE - {val})"
            w = f"{dbl(math.exp(-(dx * dx + dy * dy) / 2.0))} * exp(-({diff} * {diff}) / {dbl(2 * 10000.0 * 10000.0)})"
            n = f"({n} + CASE WHEN {ok} THEN {val} * ({w}) ELSE 0.0::DOUBLE END)"
            dn = f"({dn} + CASE WHEN {ok} THEN {w} ELSE 0.0::DOUBLE END)"
    return f"CAST(floor({n} / {dn} + 0.5::DOUBLE) AS INTEGER)"


SQL["bilateral"] = each(bilat)

F1, F7 = "CAST(1 AS FLOAT)", "CAST(7 AS FLOAT)"


def sampled(c: str, sx: str, sy: str) -> tuple[list[str], str]:
    """Columns of the clamped place and its cell, and the sample from them."""
    cols = [f"greatest(CAST(0 AS FLOAT), least({F7}, {sx})) AS u{c}", f"greatest(CAST(0 AS FLOAT), least({F7}, {sy})) AS w{c}"]
    x0, y0 = f"CAST(floor(u{c}) AS INTEGER)", f"CAST(floor(w{c}) AS INTEGER)"
    x1, y1 = f"least({x0} + 1, 7)", f"least({y0} + 1, 7)"
    fx, fy = f"(u{c} - CAST({x0} AS FLOAT))", f"(w{c} - CAST({y0} AS FLOAT))"
    at = lambda a, b: f"CAST(d{c}[{b} * 8 + {a} + 1] AS FLOAT)"
    top, low = f"({at(x0, y0)} * ({F1} - {fx}) + {at(x1, y0)} * {fx})", f"({at(x0, y1)} * ({F1} - {fx}) + {at(x1, y1)} * {fx})"
    return cols, f"CAST(floor(CAST({top} * ({F1} - {fy}) + {low} * {fy} AS DOUBLE) + 0.5::DOUBLE) AS INTEGER)"


def resampled(places: dict[str, tuple[str, str]], before: str = "p") -> str:
    cols, vals = [], {}
    for c, (sx, sy) in places.items():
        a, e = sampled(c, sx, sy)
        cols += a
        vals[c] = e
    return f"q2 AS (SELECT *, {', '.join(cols)} FROM {before}) SELECT img_id, x, y, " + ", ".join(f"{vals.get(c, c)} AS {c}" for c in "rgb") + " FROM q2"


def about(a: str, scale: float) -> str:
    mid = f"((CAST(8 AS FLOAT) - {F1}) * {flt(0.5)})"
    return f"{mid} + (CAST({a} AS FLOAT) - {mid}) * ({F1} / {flt(scale)})"


SQL["ca_correction"] = f"{RGB}, " + resampled({"r": (about("x", 1.02), about("y", 1.02)), "b": (about("x", 0.97), about("y", 0.97))})


def warped(k: tuple, p: tuple, cx: float, cy: float) -> str:
    mx, my = f"({dbl(cx)} * 8.0::DOUBLE)", f"({dbl(cy)} * 8.0::DOUBLE)"
    steps = (
        f"w1 AS (SELECT *, (CAST(x AS DOUBLE) - {mx}) / 4.0::DOUBLE AS xn, (CAST(y AS DOUBLE) - {my}) / 4.0::DOUBLE AS yn FROM p), "
        "w2 AS (SELECT *, xn * xn + yn * yn AS r2 FROM w1), w3 AS (SELECT *, r2 * r2 AS r4 FROM w2), "
        f"w4 AS (SELECT *, 1.0::DOUBLE + {dbl(k[0])} * r2 + {dbl(k[1])} * r4 + {dbl(k[2])} * (r4 * r2) + {dbl(k[3])} * (r4 * r4) AS fa FROM w3), "
        f"w5 AS (SELECT *, CAST((xn * fa + {dbl(2.0 * p[0])} * xn * yn + {dbl(p[1])} * (r2 + 2.0::DOUBLE * xn * xn)) * 4.0::DOUBLE + {mx} AS FLOAT) AS sx, "
        f"CAST((yn * fa + {dbl(p[0])} * (r2 + 2.0::DOUBLE * yn * yn) + {dbl(2.0 * p[1])} * xn * yn) * 4.0::DOUBLE + {my} AS FLOAT) AS sy FROM w4), "
    )
    return f"{RGB}, {steps}" + resampled(dict.fromkeys("rgb", ("sx", "sy")), "w5")


K = (0.05, -0.02, 0.01, -0.005)
SQL["lens_warp"] = warped(K, (0.0, 0.0), 0.5, 0.5)
SQL["lens_warp_tangential"] = warped(K, (0.01, -0.015), 0.45, 0.55)

GM = "[" + ", ".join(dbl(x) for x in [1.0, 1.25, 1.5, 0.75, 1.0, 1.125, 0.5, 0.875, 2.0]) + "]"
GMAP = f"""{RGB}, g1 AS (SELECT *, greatest(0.0::DOUBLE, least(2.0::DOUBLE, (CAST(y AS DOUBLE) / 7.0::DOUBLE - 0.0::DOUBLE) / 0.5::DOUBLE)) AS gy, greatest(0.0::DOUBLE, least(2.0::DOUBLE, (CAST(x AS DOUBLE) / 7.0::DOUBLE - 0.0::DOUBLE) / 0.5::DOUBLE)) AS gx, {GM} AS t FROM p),
g2 AS (SELECT *, CAST(floor(gy) AS INTEGER) AS y0, CAST(floor(gx) AS INTEGER) AS x0 FROM g1),
g3 AS (SELECT *, least(y0 + 1, 2) AS y1, least(x0 + 1, 2) AS x1, gy - CAST(y0 AS DOUBLE) AS fy, gx - CAST(x0 AS DOUBLE) AS fx FROM g2),
g4 AS (SELECT *, t[y0 * 3 + x0 + 1] * (1.0::DOUBLE - fy) * (1.0::DOUBLE - fx) + t[y0 * 3 + x1 + 1] * (1.0::DOUBLE - fy) * fx + t[y1 * 3 + x0 + 1] * fy * (1.0::DOUBLE - fx) + t[y1 * 3 + x1 + 1] * fy * fx AS gain FROM g3)"""
SQL["gain_map"] = f"{GMAP} SELECT img_id, x, y, " + ", ".join(f"{cut(f'CAST({c} AS DOUBLE) * gain', 'CAST(65535 AS DOUBLE)', 'DOUBLE')} AS {c}" for c in "rgb") + " FROM g4"

# --- development: black, balance, scale, demosaic, matrix, tone, orientation

NEUTRAL = f"CASE ch WHEN 'R' THEN CAST(1 AS FLOAT) / CAST({dbl(0.45)} + {dbl(0.05)} * label AS FLOAT) WHEN 'B' THEN CAST(1 AS FLOAT) / {flt(0.6)} ELSE CAST(1 AS FLOAT) / CAST(1 AS FLOAT) END"
DEV = f"""{PX}, s1 AS (SELECT img_id, label, cfa, ch, rowc, x, y, {BLACK} AS v FROM px),
s2 AS (SELECT * REPLACE ({cut(f'CAST(v AS FLOAT) * ({NEUTRAL})')} AS v) FROM s1),
s3 AS (SELECT * REPLACE ({NORM.format(v='v')} AS v) FROM s2),
sl AS (SELECT img_id, list(v ORDER BY y, x) AS d FROM s3 GROUP BY img_id),
s4 AS (SELECT s3.*, sl.d FROM s3 JOIN sl USING (img_id)),
s5 AS (SELECT img_id, x, y, {bil('d')[0]} AS r, {bil('d')[1]} AS g, {bil('d')[2]} AS b FROM s4)"""


def mat9(m: str, r: str, g: str, b: str) -> list[str]:
    return [cut(f"CAST({r} AS FLOAT) * {m}[{3 * i + 1}] + CAST({g} AS FLOAT) * {m}[{3 * i + 2}] + CAST({b} AS FLOAT) * {m}[{3 * i + 3}]") for i in range(3)]


ORX = "CASE o WHEN 2 THEN 7 - x WHEN 3 THEN 7 - x WHEN 5 THEN y WHEN 6 THEN 7 - y WHEN 7 THEN 7 - y WHEN 8 THEN y ELSE x END"
ORY = "CASE o WHEN 3 THEN 7 - y WHEN 4 THEN 7 - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN 7 - x WHEN 8 THEN 7 - x ELSE y END"


GAIN_NAME = "gain"


def finished(source: str, camera: str, gain: str) -> str:
    m = mat9("ms", "r", "g", "b")
    cols = ", ".join(f"CASE WHEN ms IS NULL THEN {c} ELSE {m[i]} END AS {c}" for i, c in enumerate("rgb"))
    return (
        f", {CAM}, {C2S}, t1 AS (SELECT img_id, x, y, {cols}, {gain} AS gain, img_id % 8 + 1 AS o FROM {source} LEFT JOIN cs ON {camera} = cs.ordinal), "
        f"t2 AS (SELECT img_id, x, y, o, {', '.join(f'{tone(c, GAIN_NAME)} AS {c}' for c in 'rgb')} FROM t1) "
        f"SELECT img_id, CAST(8 AS INTEGER) AS width, CAST(8 AS INTEGER) AS height, CAST({ORX} AS INTEGER) AS x, CAST({ORY} AS INTEGER) AS y, r, g, b FROM t2"
    )


for _name, _method in demosaic_sql.METHODS.items():
    SQL[f"demosaic_{_name}"] = f"{PX}, {demosaic_sql.source(_name)}, {_method('src')} SELECT img_id, x, y, r, g, b FROM rgb"
SQL["develop_auto"] = DEV + f", {demosaic_sql.source('amaze', 's4')}, {demosaic_sql.amaze('src')}" + finished("rgb", "img_id % 24", EV)
SQL["develop_frames_auto"] = SQL["develop_auto"]
SQL["develop_bilinear"] = SQL["develop_frames_bilinear"] = SQL["export_png"] = DEV + finished("s5", "img_id % 24", EV)
shifted = lambda c: f"least(({c} // 4) * 4, 65535)"
bal = lambda c, n: cut(f"CAST({shifted(c)} AS FLOAT) * (CAST(1 AS FLOAT) / {flt(n)})")
SQL["develop_linear_raw"] = f"{RGB}, s5 AS (SELECT img_id, x, y, {bal('r', 0.5)} AS r, {bal('g', 1.0)} AS g, {bal('b', 0.625)} AS b FROM p)" + finished("s5", "img_id % 25", "1.0::DOUBLE")

# --- files: what each synthetic header was made from

PART = "h AS (SELECT p_partkey AS file_id, CAST(p_size * 16 AS BIGINT) AS w, CAST(p_partkey % 4096 + 1 AS BIGINT) AS hh, CASE WHEN p_partkey % 97 = 0 THEN -1 ELSE p_partkey % 16 END AS k FROM part)"
FMT = "CASE WHEN k = 0 THEN 'PNG' WHEN k = 1 THEN 'GIF' WHEN k IN (2, 3, 4) THEN 'WebP' WHEN k = 5 THEN 'PPM' WHEN k IN (6, 7, 13) THEN 'TIFF' WHEN k = 8 THEN 'AVIF' WHEN k = 9 THEN 'HEIC' WHEN k = 10 THEN 'JPEG' WHEN k = 15 AND file_id % 32 = 15 THEN 'SVG' END"
SQL["sniff_standard"] = f"WITH {PART} SELECT file_id, {FMT} AS format FROM h"
SQL["sniff_leaves"] = f"WITH {PART} SELECT file_id, k = 1 AS gif, k = 10 AS jpeg, k = 0 AS png, k IN (2, 3, 4) AS webp, false AS jxl, k IN (6, 7, 13) AS tiff, k = 5 AS ppm, k = 15 AND file_id % 32 = 15 AS svg FROM h"
SQL["sniff_pages"] = "SELECT page_id, CASE WHEN regexp_matches(html, '^(<\\?xm|<svg|<!--)') AND contains(html, '<svg') THEN 'SVG' END AS format FROM pages"
SQL["sniff_raw"] = f"WITH {PART} SELECT file_id, CASE k WHEN 11 THEN 'RAF' WHEN 12 THEN 'CR3' WHEN 14 THEN 'CRW' WHEN 13 THEN 'CR2' END AS raw_format FROM h"
PROBED = f"""WITH {PART}, q AS (SELECT *, {FMT} AS format, k BETWEEN 0 AND 10 AS sized FROM h)
SELECT file_id, format,
 CASE WHEN NOT sized THEN NULL WHEN k IN (3) THEN w & 16383 WHEN k = 8 AND hh * 64 > w * hh THEN hh ELSE w END AS width,
 CASE WHEN NOT sized THEN NULL WHEN k = 8 AND hh * 64 > w * hh THEN 64 WHEN k = 3 THEN hh & 16383 ELSE hh END AS height,
 CAST(CASE WHEN k = 0 THEN CASE WHEN file_id % 2 = 0 THEN 8 ELSE 16 END WHEN k IN (1, 2, 3, 4, 10) THEN 8 WHEN k = 5 THEN CASE WHEN file_id % 3 = 0 THEN 8 ELSE 16 END END AS INTEGER) AS bit_depth,
 CASE WHEN format IS NULL THEN 'unrecognized image format' WHEN NOT sized THEN 'no size found in ' || format END AS error FROM q"""
SQL["probe"] = SQL["stream_probe"] = PROBED
rows = lambda vs: ", ".join("(" + ", ".join(("true" if x else "false") if isinstance(x, bool) else f"'{x}'" for x in v) + ")" for v in vs)
SQL["format_catalog"] = f"SELECT * FROM (VALUES {rows(FORMATS)}) t(name, extension, mime, decode, encode)"
SQL["codec_registry"] = f"SELECT * FROM (VALUES {rows(CODECS)}) t(id, direction) WHERE direction = 'decode'"
SQL["format_by_extension"] = f"""WITH e(ext0, format) AS (VALUES {rows(EXTENSIONS.items())}), p AS (SELECT p_partkey AS file_id, CASE p_partkey % 8 WHEN 0 THEN 'JPG' WHEN 1 THEN 'jfif' WHEN 2 THEN 'Tif' WHEN 3 THEN 'heif' WHEN 4 THEN 'svgz' WHEN 5 THEN 'pfm' WHEN 6 THEN 'webp' ELSE 'txt' END AS ext FROM part)
SELECT file_id, ext, format FROM p LEFT JOIN e ON lower(ext) = ext0"""
LONG = f"{RGB} SELECT img_id, x, y, CAST(c AS INTEGER) AS c, CAST({{e}} AS INTEGER) AS v FROM p CROSS JOIN (VALUES (0), (1), (2)) k(c)"
PICK = "CASE c WHEN 0 THEN r WHEN 1 THEN g ELSE b END"
SQL["png_round_trip"] = SQL["ppm_round_trip"] = SQL["dng_linear_round_trip"] = LONG.format(e=PICK)
SQL["png8_round_trip"] = LONG.format(e=f"({PICK}) // 256 * 257")
SQL["dng_tags"] = f"WITH {RGBF} SELECT img_id AS file_id, 'ifd0' AS dir, CAST(tag AS INTEGER) AS tag, CAST(value AS BIGINT) AS value FROM rf CROSS JOIN (VALUES (256, 8), (257, 8), (262, 34892), (277, 3)) t(tag, value)"

SQL["raf_decode"] = f"{PX} SELECT img_id, 'X-T5' AS model, true AS xtrans, x, y, v FROM px"
SQL["cmyk_fold"] = "WITH q AS (SELECT p_partkey AS id, CAST(p_size * 5 % 256 AS INTEGER) AS value, CAST(p_partkey % 256 AS INTEGER) AS key FROM part) SELECT *, CAST(round(value * key / 255.0::DOUBLE) AS INTEGER) AS folded FROM q"
SQL["white_level"] = "SELECT p_partkey AS id, CAST(CASE WHEN p_size % 20 = 0 THEN 0 WHEN p_size % 20 >= 16 THEN 65535 ELSE (1 << CAST(p_size % 20 AS INTEGER)) - 1 END AS INTEGER) AS white FROM part"
SQL["encode_defaults"] = f"SELECT * FROM (VALUES {rows(ENCODE_DEFAULTS)}) t(format, option, value)"
NAMED = "n(color, p, t) AS (VALUES " + ", ".join(f"('{n}', {p}, {t})" for n, p, t in COLOR_DESCRIPTIONS) + ")"
SQL["color_description"] = f"WITH {NAMED}, q AS (SELECT p_partkey AS id, CAST(p_size % 13 AS INTEGER) AS primaries, CAST(p_partkey % 14 AS INTEGER) AS transfer FROM part) SELECT id, primaries, transfer, coalesce(color, 'CICP') AS color FROM q LEFT JOIN n ON primaries = p AND transfer = t"

# --- metadata

SQL["embedded_exif"] = "SELECT c_custkey AS id, c_name AS make, 'm' || CAST(c_custkey AS VARCHAR) AS model, CAST(c_custkey AS BIGINT) AS iso, CAST(c_custkey % 8 + 1 AS BIGINT) AS orientation, CAST(c_custkey AS BIGINT) AS num, CAST(125 AS BIGINT) AS den, CAST(5 AS INTEGER) AS entries FROM customer"

EAV = "t AS (SELECT user_id AS img_id, CAST(event_id % 5 AS INTEGER) AS dir, event_id AS seq, CASE event_type WHEN 'view' THEN 33434 WHEN 'click' THEN 33437 WHEN 'purchase' THEN 34855 WHEN 'signup' THEN 37386 ELSE 274 END AS tag, CAST(floor(value * 100.0::DOUBLE) AS BIGINT) AS num, CAST(CASE WHEN event_id % 50 = 7 THEN 0 ELSE 100 END AS BIGINT) AS den FROM events)"
LAST = f"{EAV}, w AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY img_id, tag ORDER BY dir DESC, seq DESC) = 1)"
RAT = "CASE WHEN den = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(num AS DOUBLE) / CAST(den AS DOUBLE) END"
pick = lambda tag, e: f"max(CASE WHEN tag = {tag} THEN {e} END)"
SQL["exif_extra_last_wins"] = f"WITH {LAST} SELECT img_id, '0x' || lpad(lower(to_hex(tag)), 4, '0') AS tag, dir, seq, num, den FROM w"
SQL["exif_pivot"] = f"WITH {LAST} SELECT img_id, {pick(33434, RAT)} AS exposure_time, {pick(33437, RAT)} AS f_number, CAST({pick(34855, 'num % 65536')} AS BIGINT) AS iso, {pick(37386, RAT)} AS focal_length, CAST({pick(274, 'num % 8 + 1')} AS BIGINT) AS orientation FROM w GROUP BY img_id"
SQL["rational_to_double"] = f"WITH {EAV} SELECT img_id, seq, {RAT} AS value FROM t"
SQL["ascii_clean"] = "SELECT c_custkey AS id, trim(c_name) AS clean FROM customer"
SQL["gps_decimal"] = f"WITH q AS (SELECT c_custkey AS id, CAST(c_custkey % 90 AS DOUBLE) + CAST(c_custkey % 60 AS DOUBLE) / {dbl(60.0)} + CAST((c_custkey * 7) % 60 AS DOUBLE) / {dbl(3600.0)} AS d FROM customer) SELECT id, CASE WHEN id % 3 = 1 THEN d ELSE -d END AS degrees FROM q"
SQL["extra_upsert"] = "SELECT c_custkey AS id, 'n' || CAST(c_nationkey AS VARCHAR) AS make, '5' AS rating, CAST(NULL AS VARCHAR) AS missing, CAST(3 AS INTEGER) AS entries, 'n' || CAST(c_nationkey AS VARCHAR) AS first FROM customer"
SQL["metadata_merge"] = "SELECT c_custkey AS id, 'ARW' AS format, c_name AS lens, CAST(NULL AS INTEGER) AS bits FROM customer UNION ALL SELECT s_suppkey, 'RAF', NULL, CAST(s_nationkey AS INTEGER) FROM supplier"
