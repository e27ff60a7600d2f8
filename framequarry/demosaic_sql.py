"""DuckDB SQL for the demosaicing methods on 8 x 8 frames: FLOAT sums in the methods' order, over lists of samples."""

from __future__ import annotations

import numpy as np

XTRANS = [1, 2, 1, 1, 0, 1, 0, 1, 0, 2, 1, 2, 1, 2, 1, 1, 0, 1, 1, 0, 1, 2, 1, 2, 1, 2, 1, 1, 0, 1, 0, 1, 0, 2, 1, 2]
ZERO, ONE = "CAST(0 AS FLOAT)", "CAST(1 AS FLOAT)"


def flt(x: float) -> str:
    return f"CAST('{x!r}' AS FLOAT)"


def edge(values: str, dx: int, dy: int) -> str:
    """A FLOAT list's element at a place, the edge repeated."""
    x = f"least(greatest(x + ({dx}), 0), 7)" if dx else "x"
    y = f"least(greatest(y + ({dy}), 0), 7)" if dy else "y"
    return f"{values}[{y} * 8 + {x} + 1]"


def inside(dx: int, dy: int) -> str:
    return f"(x + ({dx}) BETWEEN 0 AND 7 AND y + ({dy}) BETWEEN 0 AND 7)"


def near(dx: int, dy: int) -> str:
    return f"[(y + ({dy})) * 8 + x + ({dx}) + 1]"


class Steps:
    """Common table expressions, each a row per pixel with lists of what came before."""

    def __init__(self, source: str):
        """source: img_id, x, y, d (samples), col (colours as a list of 64), white."""
        self.ctes = [f"m0 AS (SELECT img_id, x, y, white, col, col[y * 8 + x + 1] AS c, list_transform(d, lambda q: CAST(q AS FLOAT)) AS raw FROM {source})", "m1 AS (SELECT *, raw[y * 8 + x + 1] AS v FROM m0)"]
        self.n = 1

    def add(self, **columns: str) -> None:
        self.n += 1
        self.ctes.append(f"m{self.n} AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in columns.items())} FROM m{self.n - 1})")

    def gather(self, *names: str) -> None:
        """Each named column as a list of its frame, l_name."""
        self.n += 1
        lists = ", ".join(f"list({c} ORDER BY y, x) AS l_{c}" for c in names)
        old = ", ".join(f"l_{c}" for c in names)
        base = f"m{self.n - 1}"
        self.ctes.append(f"m{self.n} AS (SELECT {base}.*, {old} FROM {base} JOIN (SELECT img_id, {lists} FROM {base} GROUP BY img_id) USING (img_id))")

    def end(self, r: str, g: str, b: str) -> str:
        return ", ".join(self.ctes) + f", rgb AS (SELECT img_id, x, y, {r} AS r, {g} AS g, {b} AS b FROM m{self.n})"


def directional() -> dict[str, str]:
    out = {}
    for k, at in (("h", lambda s: edge("raw", s, 0)), ("v", lambda s: edge("raw", 0, s))):
        out[f"curve{k}"] = f"{flt(2.0)} * v - {at(-2)} - {at(2)}"
        out[f"side{k}"], out[f"gap{k}"] = f"{at(-1)} + {at(1)}", f"abs({at(-1)} - {at(1)})"
    return out


def estimates(s: Steps) -> None:
    s.add(**directional())
    s.add(**{f"e{k}": f"side{k} * {flt(0.5)} + curve{k} * {flt(0.25)}" for k in "hv"}, **{f"d{k}": f"gap{k} + abs(curve{k})" for k in "hv"})


def gradient_green(s: Steps) -> None:
    estimates(s)
    s.add(wh=f"{ONE} / (dh + {flt(1e-5)})", wv=f"{ONE} / (dv + {flt(1e-5)})")
    s.add(g=f"CASE WHEN c = 1 THEN v ELSE greatest({ZERO}, CASE WHEN dh < dv * {flt(0.5)} THEN eh WHEN dv < dh * {flt(0.5)} THEN ev ELSE (wh * eh + wv * ev) / (wh + wv) END) END")


def spread(values: str, want: int, empty: float) -> str:
    def mean(*at: tuple[int, int]) -> str:
        ok = [f"{inside(*a)} AND col{near(*a)} = {want}" for a in at]
        total = " + ".join(f"(CASE WHEN {o} THEN {values}{near(*a)} ELSE {ZERO} END)" for o, a in zip(ok, at, strict=True))
        count = " + ".join(f"(CASE WHEN {o} THEN 1 ELSE 0 END)" for o in ok)
        return f"CASE WHEN {count} > 0 THEN ({total}) / CAST({count} AS FLOAT) ELSE {flt(empty)} END"

    row = f"(col[y * 8 + 1] = {want} OR col[y * 8 + 2] = {want})"
    return f"CASE WHEN c = {want} THEN {values}[y * 8 + x + 1] WHEN c <> 1 THEN {mean((-1, -1), (1, -1), (-1, 1), (1, 1))} WHEN {row} THEN {mean((-1, 0), (1, 0))} ELSE {mean((0, -1), (0, 1))} END"


def whole(e: str) -> str:
    return f"CAST(least(CAST(white AS DOUBLE), greatest(0.0::DOUBLE, floor(CAST({e} AS DOUBLE) + 0.5::DOUBLE))) AS INTEGER)"


def limited(e: str) -> str:
    return f"least(CAST(white AS FLOAT), greatest({ZERO}, {e}))"


def amaze(source: str) -> str:
    s = Steps(source)
    gradient_green(s)
    s.add(ph="CASE WHEN c = 1 THEN v ELSE eh END", pv="CASE WHEN c = 1 THEN v ELSE ev END")
    s.gather("ph", "pv")
    votes = {"hh": [], "vh": []}
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            eh, ev = (f"(abs({edge(f'l_p{k}', dx, dy)} - {edge('raw', dx, dy)}) + abs({edge(f'l_p{k}', dx, dy)} - p{k}))" for k in "hv")
            votes["hh"].append(f"(CASE WHEN {eh} < {ev} THEN 1 ELSE 0 END)")
            votes["vh"].append(f"(CASE WHEN {ev} < {eh} THEN 1 ELSE 0 END)")
    s.add(**{k: " + ".join(v) for k, v in votes.items()})
    a, b = "CAST(hh + 1 AS FLOAT)", "CAST(vh + 1 AS FLOAT)"
    better = f"greatest({ZERO}, CASE WHEN hh > vh + 1 THEN ph WHEN vh > hh + 1 THEN pv ELSE ({a} * ph + {b} * pv) / ({a} + {b}) END)"
    s.add(green=f"CASE WHEN c <> 1 AND x BETWEEN 3 AND 4 AND y BETWEEN 3 AND 4 THEN {better} ELSE g END")
    s.add(diff="v - green")
    s.gather("diff")
    for n, want in (("red", 0), ("blue", 2)):
        s.add(**{n: f"CASE WHEN c = {want} THEN v ELSE green + ({spread('l_diff', want, 0.0)}) END"})
    s.add(cr="red - green", cb="blue - green")
    s.gather("cr", "cb")
    four = lambda n: [edge(f"l_{n}", *p) for p in ((-1, 0), (1, 0), (0, -1), (0, 1))]
    s.add(**{f"m{n}": f"({' + '.join(four(n))}) * {flt(0.25)}" for n in ("cr", "cb")})
    s.add(**{f"w{n}": " + ".join(f"abs({e} - m{n})" for e in four(n)) for n in ("cr", "cb")})
    done = lambda full, n: f"CASE WHEN x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5 AND abs({n} - m{n}) > w{n} * {flt(1.5)} + {ONE} THEN green + m{n} ELSE {full} END"
    return s.end(whole(done("red", "cr")), whole("green"), whole(done("blue", "cb")))


def lmmse(source: str) -> str:
    s = Steps(source)
    estimates(s)
    s.add(**{f"p{k}": f"CASE WHEN c = 1 THEN v ELSE {limited(f'e{k}')} END" for k in "hv"})
    s.add(rh="v - ph", rv="v - pv")
    s.gather("rh", "rv")
    around = [(dx, dy) for dy in range(-2, 3) for dx in range(-2, 3)]
    s.add(**{f"s{k}": " + ".join([ZERO, *(edge(f"l_r{k}", *p) for p in around)]) for k in "hv"}, **{f"q{k}": " + ".join([ZERO, *(f"{edge(f'l_r{k}', *p)} * {edge(f'l_r{k}', *p)}" for p in around)]) for k in "hv"})
    n = flt(25.0)
    s.add(**{f"w{k}": f"{ONE} / ((q{k} - s{k} * s{k} / {n}) / {n} + {flt(1e-5)})" for k in "hv"})
    s.add(green=f"CASE WHEN c = 1 THEN v ELSE {limited('(wh * ph + wv * pv) / (wh + wv)')} END")
    s.add(diff="v - green")
    s.gather("diff")
    diff = "l_diff"
    red, blue = (f"CASE WHEN c = {w} THEN v ELSE {limited(f'green + ({spread(diff, w, 0.0)})')} END" for w in (0, 2))
    return s.end(whole(red), whole("green"), whole(blue))


def rcd(source: str) -> str:
    s = Steps(source)
    gradient_green(s)
    s.add(ratio=f"v / greatest(g, {ONE})")
    s.gather("ratio")
    ratio = "l_ratio"
    red, blue = (f"CASE WHEN c = {w} THEN v ELSE {limited(f'g * ({spread(ratio, w, 1.0)})')} END" for w in (0, 2))
    return s.end(whole(red), whole("g"), whole(blue))


def weighted(values: str, want: int, reach: int, empty: str) -> str:
    total, weight = [ZERO], [ZERO]
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            w = flt(float(np.float32(1) / (np.float32(dx * dx + dy * dy) + np.float32(0.1))))
            ok = f"{inside(dx, dy)} AND col{near(dx, dy)} = {want}"
            total.append(f"(CASE WHEN {ok} THEN {values}{near(dx, dy)} * {w} ELSE {ZERO} END)")
            weight.append(f"(CASE WHEN {ok} THEN {w} ELSE {ZERO} END)")
    t, w = " + ".join(total), " + ".join(weight)
    return f"CASE WHEN c = {want} THEN {values}[y * 8 + x + 1] WHEN {w} > 0 THEN ({t}) / ({w}) ELSE {empty} END"


def cut(e: str) -> str:
    return f"CAST(trunc({limited(e)}) AS INTEGER)"


def markesteijn(source: str, passes: int = 1) -> str:
    s = Steps(source)
    s.add(g0=weighted("raw", 1, 2, "v"))
    for k in range(1 if passes == 1 else 2):
        s.add(**{f"x{k}": f"v - g{k}"})
        s.gather(f"x{k}")
        s.add(**{f"dr{k}": weighted(f"l_x{k}", 0, 3, ZERO), f"db{k}": weighted(f"l_x{k}", 2, 3, ZERO)})
        if passes > 1 and k == 0:
            s.add(g1=f"CASE c WHEN 0 THEN (g0 + (v - dr0)) * {flt(0.5)} WHEN 2 THEN (g0 + (v - db0)) * {flt(0.5)} ELSE g0 END")
    return s.end(cut(f"g{k} + dr{k}"), cut(f"g{k}"), cut(f"g{k} + db{k}"))


def xtrans_fast(source: str) -> str:
    s = Steps(source)

    def one(want: int) -> str:
        out = "v"
        for reach in (3, 2, 1):
            ok = [f"{inside(dx, dy)} AND col{near(dx, dy)} = {want}" for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)]
            at = [near(dx, dy) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)]
            total = " + ".join([ZERO, *(f"(CASE WHEN {o} THEN raw{a} ELSE {ZERO} END)" for o, a in zip(ok, at, strict=True))])
            count = " + ".join(f"(CASE WHEN {o} THEN 1 ELSE 0 END)" for o in ok)
            out = f"CASE WHEN {count} > 0 THEN ({total}) / CAST({count} AS FLOAT) ELSE {out} END"
        return f"CASE WHEN c = {want} THEN v ELSE {out} END"

    return s.end(*(cut(one(w)) for w in (0, 1, 2)))


METHODS = {"amaze": amaze, "lmmse": lmmse, "rcd": rcd, "markesteijn": markesteijn, "markesteijn3": lambda s: markesteijn(s, 3), "xtrans_fast": xtrans_fast}
BAYER_COLOURS = "list_transform(range(64), lambda i: CASE substr(cfa, CAST((i // 8 % 2) * 2 + i % 8 % 2 + 1 AS BIGINT), 1) WHEN 'R' THEN 0 WHEN 'G' THEN 1 ELSE 2 END)"
TILE_COLOURS = "[" + ", ".join(str(XTRANS[(i // 8 % 6) * 6 + i % 8 % 6]) for i in range(64)) + "]"


def source(method: str, rows: str = "px", name: str = "src") -> str:
    """rows: img_id, x, y, d, cfa."""
    return f"{name} AS (SELECT img_id, x, y, d, 16383 AS white, {TILE_COLOURS if method in ('markesteijn', 'markesteijn3', 'xtrans_fast') else BAYER_COLOURS} AS col FROM {rows})"
