"""The ten text operators on small tables: against plain versions, and on rows that are odd."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framequarry.llm import fingerprint, jaccard, langid, linededup, mixing, packing, quality, sharding, tokenbin, tokens, urltrie
from framequarry.llm.common import written
from framequarry.llm.registry import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(60_000)) + "\nlast line"


def docs(spark, rows):
    """rows: (doc_id, text, lang, source); with an extra column whose name an operator could use itself."""
    full = [(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows]
    return spark.createDataFrame(full, SCHEMA).withColumn("_fq_bucket", F.lit("kept")).withColumn("size", F.lit(-1))


ODD = [
    (5, None, None, None),
    (4, "", "en", "a"),
    (4, "", "en", "a"),
    (3, "one\ntwo\n\none two three. Four!", None, "a"),
    (2, LONG, "en", None),
    (None, "no id here", "en", "b"),
    (-7, "🙂é́ ß\t\x0b日本 \x1c x", "de", "b"),
    (1 << 60, "one\ntwo\n\none two three. Four!", "fr", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


def corpus(seed=3, n=160):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [f"w{rng.randint(0, 300)}" for _ in range(rng.choice([0, 1, 4, 8, 20, 60, 150]))]
        text = "\n".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12))
        out.append((i * 3, text, rng.choice(["en", "fr"]), rng.choice(["a", "b", "c", None])))
    return out


# --- 1 fingerprints


def test_fingerprints_of_edits(spark):
    rows = corpus(1, 700) + [(9000, None, None, None), (9000, None, None, None), (-1, "x", None, None)]
    got = defaultdict(list)
    for r in fingerprint.fingerprints(docs(spark, rows)).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    order = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    of_text = {}
    for i, (k, t, *_) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        want = hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
        hits = [r for r in got[k] if r.edited_sha256 == want]
        assert hits and hits[0].n_chars == len(t)
        assert 0 <= hits[0].near_edited <= 1 and 0 <= hits[0].near_next <= 1
        assert of_text.setdefault(t, hits[0].fingerprint) == hits[0].fingerprint
    assert len(set(of_text.values())) == len(of_text)


def test_fingerprints_are_homomorphic(spark):
    t = spark.createDataFrame([("a b.\nc d.\ne f.", "e f.\na b.\nc d.", "a b.\nc d.", "e f.")], "abc string, cab string, ab string, c string")
    v = {c: fingerprint.vector(F.col(c)) for c in t.columns}
    r = t.select(
        (fingerprint.hex_of(v["abc"]) == fingerprint.hex_of(v["cab"])).alias("order"),
        (fingerprint.hex_of(fingerprint.combine(v["ab"], v["c"])) == fingerprint.hex_of(v["abc"])).alias("added"),
        (fingerprint.hex_of(fingerprint.combine(v["abc"], v["c"], -1)) == fingerprint.hex_of(v["ab"])).alias("removed"),
        fingerprint.likeness(v["abc"], v["ab"]).alias("near"),
        fingerprint.likeness(v["ab"], v["c"]).alias("far"),
    ).first()
    assert r.order and r.added and r.removed and r.near > 0.5 > r.far


def plain_fingerprint(spark, text):
    """(printed fingerprint, the multiset's lanes as signed sums) from its definition, with Spark's hash of single strings."""
    paragraphs = [p for p in text.split("\n") if p]
    mark = lambda w: w + "\x01" if of[w] % fingerprint.CUT == 0 else w
    words = sorted({w for p in paragraphs for w in p.split(" ")})
    of = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    pieces = [x for p in paragraphs for x in " ".join(map(mark, p.split(" "))).split("\x01") if x]
    hashes = spark.createDataFrame([(x,) for x in sorted({*paragraphs, *pieces})], "w string").select("w", *[F.xxhash64(F.lit(i), "w").alias(f"h{i}") for i in range(6)]).collect()
    h = {r.w: [r[f"h{i}"] % (1 << 64) for i in range(6)] for r in hashes}
    check = [sum(h[p][i] % (1 << 48) for p in paragraphs) % (1 << 48) for i in range(4)]
    near = [sum(h[x][k] >> j + s & 1 for x in pieces) for k in (4, 5) for j in range(32) for s in (0, 32)]
    return f"{len(pieces):08x}" + "".join(f"{c:012x}" for c in check) + "".join(f"{c:08x}" for c in near)


def plain_likeness(a, b):
    """From two printed fingerprints alone."""
    lanes = lambda f: np.array([2 * int(f[k : k + 8], 16) - int(f[:8], 16) for k in range(56, len(f), 8)], dtype=float)
    x, y = lanes(a), lanes(b)
    size = (x * x).sum() + (y * y).sum()
    return 1.0 if a == b else max(0.0, min(1.0, 2 * (x * y).sum() / size)) if size else 0.0


def test_fingerprints_against_plain(spark):
    rows = [*corpus(7, 12), (900, "ж о у. Ü\n\nж\tx\x01y\nÜ 日本", None, None), (901, "", None, None)]
    got = sorted(fingerprint.fingerprints(docs(spark, rows)).collect(), key=lambda r: -r.doc_id)
    text = {r[0]: r[1] for r in rows}
    for r, nxt in zip(got, [*got[1:], got[0]], strict=True):
        assert r.fingerprint == plain_fingerprint(spark, text[r.doc_id])
        assert math.isclose(r.near_edited, plain_likeness(r.fingerprint, r.edited_fingerprint), abs_tol=1e-9)
        assert math.isclose(r.near_next, plain_likeness(r.fingerprint, nxt.fingerprint), abs_tol=1e-9)


def test_an_id_of_many_buckets_is_split(spark):
    rows = [(None if i % 3 else 7 if i % 2 else i, f"text {i}", None, None) for i in range(900)]
    got = fingerprint.with_next(docs(spark, rows), per_task=40).select("doc_id", "text", "next_text").collect()
    after = {r.text: r.next_text for r in got}
    assert len(after) == 900 and set(after.values()) == set(after)
    ids, t, seen = {r.text: r.doc_id for r in got}, "text 894", []
    for _ in range(900):
        seen.append(ids[t])
        t = after[t]
    assert seen == sorted(seen, key=lambda i: (i is None, -(i or 0)))


def test_fingerprints_odd(odd, none):
    got = fingerprint.fingerprints(odd).collect()
    assert len(got) == len(ODD)
    assert {r.n_chars for r in got if r.doc_id == 4} == {0}
    assert fingerprint.fingerprints(none).count() == 0


# --- 2 quality


def plain_stats(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_statistics_against_plain():
    rng = random.Random(2)
    texts = [None, "", "a # b\na # b\n \n", "é日 🙂|x", LONG] + [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    c = quality.text_stats(texts)
    got = list(zip(*(c[i].tolist() for i in (0, 1, 2, 4, 5)), strict=True))
    assert got == [plain_stats(t) for t in texts]


def test_quality_rejects_outliers_only(spark):
    rng = random.Random(4)
    clean = lambda: " ".join(rng.choice(["the", "lake", "house", "window", "under", "some", "river,", "walks."]) for _ in range(rng.randint(40, 200)))
    junk = lambda: " ".join(rng.choice(["#%$ab", "&&c|", "<>d*"]) for _ in range(80))
    rows = [(i, junk() if i % 20 == 0 else clean(), "en" if i % 3 else None, "a" if i % 2 else None) for i in range(600)]
    got = {r.doc_id: r for r in quality.judge(docs(spark, rows), min_rows=50).collect()}
    assert all(got[i].kept == bool(i % 20) for i in got if not got[i].base_failed)
    assert sum(r.base_failed for r in got.values()) == 0


def vectors(spark, x, noise=0.0):
    names = ", ".join(f"{c} double" for c in quality.X + quality.E)
    return spark.createDataFrame([("", "", *map(float, v), *[noise] * quality.P) for v in x], "_l string, _s string, " + names)


def plain_mcd(x, share, rng, starts=60):
    """The least log determinant over C-steps from random subsets, exact at every step."""
    h, best = math.ceil(share * len(x)), (math.inf, None)
    for _ in range(starts):
        some, last = x[rng.choice(len(x), quality.P + 2, replace=False)], math.inf
        while True:
            m, c = some.mean(axis=0), np.cov(some.T, bias=True) + 1e-12 * np.eye(quality.P)
            det = np.linalg.slogdet(c)[1]
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            some = x[np.argsort(d)[:h]]
            if len(some) == h and det >= last - 1e-9:
                break
            last = det
        best = min(best, (det, tuple(m)))
    return best


def test_minimum_determinant_against_plain(spark):
    rng = np.random.default_rng(0)
    turn = rng.normal(0, 1, (quality.P, quality.P)) * 0.02
    x = np.concatenate((0.3 + rng.normal(0, 1, (700, quality.P)) @ turn, 0.36 + rng.normal(0, 1, (160, quality.P)) @ turn * 0.1))
    rows = vectors(spark, x)
    best = quality.fit(rows, share=0.75).collect()
    assert len(best) == 1
    det, centre = plain_mcd(x, 0.75, rng)
    scale = 0.75 / quality._chi2_cdf(quality.chi2_quantile(0.75, quality.P), quality.P + 2)
    assert abs(best[0]._det - det - quality.P * math.log(scale)) < 0.05  # a thousandth is taken off the correlations
    assert np.allclose([best[0][f"_m{i}"] for i in range(quality.P)], centre, atol=0.01)


def test_steps_never_raise_the_determinant(spark):
    rng = np.random.default_rng(3)
    rows = vectors(spark, np.concatenate((rng.normal(0.3, 0.02, (500, quality.P)), rng.normal(0.5, 0.2, (150, quality.P)))))
    now, last = quality.starts(rows), {}
    assert {r._t for r in now.collect()} == {0, 1, 2, 3}
    for _ in range(4):
        now = quality.c_step(rows, now, 0.75)
        dets = {r._t: r._det for r in now.collect()}
        assert all(dets[t] <= d + 1e-3 for t, d in last.items())  # rows of one interval of distances count alike
        last = dets
    assert quality.fit(rows).first()._det <= min(last.values()) + 1e-3


def test_fitted_spread_decides_unless_degenerate(spark):
    rng = np.random.default_rng(1)
    x, zero = rng.normal(0.3, 0.02, (1000, quality.P)), 2
    x[:, zero] = 0.0
    model = quality.fit(vectors(spark, x, 0.01**2)).first()
    sd = [model[f"_i{i}{i}"] ** -0.5 for i in range(quality.P)]
    assert np.allclose(sd, [0.01 if i == zero else 0.02 for i in range(quality.P)], rtol=0.2)


def test_words_repeated_at_once_are_rejected(spark):
    rng = random.Random(6)
    pool = [a + b for a in ("la", "ri", "mo", "te", "su") for b in ("ke", "ver", "n", "sto", "del", "p")]
    clean = lambda: " ".join(rng.choice(pool) for _ in range(rng.randint(40, 200)))
    runs = lambda: " ".join(w for _ in range(30) for w in [rng.choice(pool)] * rng.randint(3, 6))
    rows = [(i, runs() if i % 20 == 0 else clean(), "en", "a") for i in range(400)]
    got = quality.judge(docs(spark, rows)).collect()
    assert sum(not r.base_failed for r in got if r.doc_id % 20 == 0) >= 10
    assert all(not r.kept for r in got if r.doc_id % 20 == 0)
    assert sum(not r.kept for r in got if r.doc_id % 20) <= 4
    assert abs(quality._chi2_cdf(6.3458, 7) - 0.5) < 1e-4


def test_verdicts_follow_from_distances(spark):
    """Distance and limit of each group, recomputed from the returned rows alone."""
    from statistics import NormalDist

    rng = random.Random(9)
    text = lambda: " ".join(rng.choice(["the", "lake,", "House", "window", "under", "some.", "#river", "walks"]) for _ in range(rng.randint(30, 300)))
    rows = [(i, "#$% " * 60 + text() if i % 40 == 0 else text(), "en", rng.choice("ab")) for i in range(800)] + [(5000 + i, text(), "fr", None) for i in range(9)]
    got = quality.judge(docs(spark, rows)).collect()
    source, z = {r[0]: r[3] for r in rows}, NormalDist().inv_cdf(1 - 5e-4) / NormalDist().inv_cdf(0.75)
    for s in "ab":
        d = sorted(r.distance for r in got if source[r.doc_id] == s and not r.base_failed)
        mid, upper = (d[math.ceil(len(d) * p) - 1] ** (2 / 3) for p in (0.5, 0.75))
        far = max((mid + z * (upper - mid)) ** 3, quality.chi2_quantile(1 - 5e-4, quality.P)) ** 0.5
        assert all(r.kept == (r.distance <= far) for r in got if source[r.doc_id] == s and not r.base_failed and abs(r.distance / far - 1) > 0.01)
    few = [r for r in got if r.doc_id >= 5000]
    assert len(few) == 9 and all(r.distance is None and r.kept != r.base_failed for r in few)


def test_quality_odd(odd, none):
    got = quality.judge(odd).collect()
    assert len(got) == len(ODD)
    assert all(r.base_failed and not r.kept for r in got if r.doc_id != 2)
    assert quality.judge(none).count() == 0


# --- 3 language


def test_language_profiles(spark):
    rng = random.Random(6)
    parts = {"aa": ["tha", "ing", "er", "on"], "bb": ["sch", "ich", "ü", "keit"], "cc": ["eau", "oi", "ç", "ment"]}
    rows = [(i, " ".join("".join(rng.choice(parts[la]) for _ in range(3)) for _ in range(40)), la, "s") for i, la in enumerate(sorted(parts) * 60)]
    rows += [(1000, "12 34 !", "aa", "s"), (1001, None, "bb", "s"), (1002, "", None, None)]
    got = {r.doc_id: r for r in langid.predict(docs(spark, rows)).collect()}
    for i, _, la, _ in rows[:180]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i].lang_pred == la and 0 < got[i].score <= 1
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert {r.doc_id for r in langid.keep_known(docs(spark, rows)).collect()} == set(range(180))


def test_bundles_are_sums_of_bound_letters():
    s = langid.Space(64, 1)
    text = "Añ, b"
    x = [0, *[{" ": 0}.get(c, c) for c in "añ"], 0, "b", 0]
    vec = lambda c: s._letter(0x20 if c == 0 else ord(c)).astype(int)
    want = sum(np.roll(vec(a), 2) * np.roll(vec(b), 1) * vec(c) for a, b, c in zip(x, x[1:], x[2:], strict=False))
    assert (s.bundles([text])[0] == want).all()
    big = "".join(chr(0x4E00 + i) for i in range(400))  # more letters than a table of n-grams allows
    assert np.allclose(s.bundles([big, text, ""])[1], want) and not s.bundles([""]).any()


def test_language_odd(odd, none, spark):
    assert langid.predict(odd).count() == len(ODD)
    assert langid.predict(none).count() == 0
    assert langid.keep_known(none).columns == none.columns
    unlearned = docs(spark, [(1, "abc", None, None), (2, "12", None, None)])
    assert [r.lang_pred for r in langid.predict(unlearned).collect()] == ["und", "und"]
    assert [r.doc_id for r in langid.keep_known(unlearned).collect()] == [1]


# --- 4 lines


def plain_lines(rows, ratio, least):
    strip = lambda x: x.strip(" \t\n\v\f\r")
    pages, found = Counter(s for *_, s in rows), Counter()
    for _, t, _, s in rows:
        found.update({(s, strip(x)) for x in (t or "").split("\n") if strip(x)})
    out = []
    for i, t, _, s in rows:
        if t is not None:
            kept = [x for x in t.split("\n") if not (strip(x) and found[s, strip(x)] >= least and found[s, strip(x)] > ratio * pages[s])]
            t = "\n".join(kept)
        out.append((i, t))
    return sorted(out)


def test_lines_against_plain(spark):
    rng = random.Random(8)
    pool = [f"line {i}" for i in range(40)]
    rows = [(i, "\n".join([rng.choice(["menu", " menu ", "footer", ""]), *rng.sample(pool, 4)]), "en", rng.choice(["a", "b", None])) for i in range(300)] + [(900 + i, "menu", None, "a") for i in range(3)] + [(999, None, None, "a")]
    for ratio, least in ((0.2, 5), (0.02, 5), (0.5, 2)):
        got = linededup.drop_boilerplate(docs(spark, rows), ratio=ratio, min_pages=least)
        assert sorted((r.doc_id, r.text) for r in got.collect()) == plain_lines(rows, ratio, least)


def test_a_page_of_boilerplate_is_emptied(spark):
    rows = [(i, "menu\nfooter" if i < 8 else f"menu\nown {i}", "en", "a") for i in range(10)]
    got = {r.doc_id: (r.text, r.size) for r in linededup.drop_boilerplate(docs(spark, rows), dropped="size").collect()}
    assert got == {i: ("", 2) if i < 8 else (f"own {i}", 1) for i in range(10)}


def test_lines_odd(odd, none):
    got = linededup.drop_boilerplate(odd, min_pages=1, dropped="gone")
    assert got.columns == [*odd.columns, "gone"] and got.count() == len(ODD)
    assert linededup.drop_boilerplate(none).columns == none.columns


# --- 5 mixing


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, left, free = {}, float(sum(sizes.values())), [s for s in names if sizes[s]]
    while True:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total >= 3 * sizes[s]]
        if not over:
            return {s: target.get(s, left * w[s] / total if s in free else 0.0) for s in names}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.remove(s)
        if not free:
            return {s: target.get(s, 0.0) for s in names}


@pytest.mark.parametrize("scale", [1, 400])
def test_mix_fills_to_targets(spark, scale):
    rng = random.Random(5)
    source = lambda: rng.choices(["a", "b", "c", "d", "é", "z", None], [30, 1, 1, 3, 3, 1, 2])[0]
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), "en", source()) for i in range(scale)] + [(10_000 + k, "", None, "empty") for k in range(2)]
    d = docs(spark, rows)
    got = mixing.mix(d).collect()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    want, taken = plain_targets(sizes), Counter()
    for r in got:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix(d.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_mix_sample_and_odd(odd, none):
    out = mixing.sample(odd)
    assert out.columns == odd.columns
    assert {r.doc_id for r in out.where("doc_id = 4").collect()} == {4}
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(none).count() == 0 and mixing.sample(none).count() == 0


# --- 6 URLs


def plain_rule(host, path, rules):
    fits = [(h.count("."), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, "allow")


def test_urls_against_plain(spark):
    rng = random.Random(9)
    rules = urltrie.PRODUCTION_RULES + [("a.com", "", "block"), ("b.a.com", "/x/y", "allow"), ("a.com", "/x/", "allow"), ("net", "/", "block")]
    hosts = ["a.com", "B.a.com", "c.b.a.com", "ba.com", "example.com", "www.Example.NET", "org", "", "x.org:80", "a..com"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/x/y', '/x/yy?q=/en/', '/en/7', '/en/70', '/de/8', '/es/', '#f', '/x//y'])}" for _ in range(300)]
    urls += [None, "", "a.com/en/", "://a.com/x/", "http://a.com://b"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("mine"))
    for r in urltrie.judge(pages, rules).collect():
        m = re.match(r"(?s)[^:]*?://([^/?#]*)([^?#]*)", urls[r.page_id][urls[r.page_id].find("://") :]) if urls[r.page_id] and "://" in urls[r.page_id] else None
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == plain_rule(host, path, rules)


def test_url_rules_are_bounded():
    with pytest.raises(ValueError):
        urltrie.UrlTrie([("a", "/", "maybe")])
    both = urltrie.UrlTrie([("a", "/", "allow"), ("a", "/", "block")])
    assert both.match("a", "/") == ("a/", "block")


# --- 7 packing


@pytest.mark.parametrize("lengths", [[], [1], [1023], [1024], [5000, 3, 3], [random.Random(1).randint(1, 3000) for _ in range(500)], [random.Random(2).randint(1, 90) for _ in range(3000)]])
def test_blocks_are_full(lengths):
    seen, padding = defaultdict(list), 0
    for tier, pieces in packing.pack_block(lengths):
        n = sum(p[2] for p in pieces)
        assert 0 < n <= tier <= 1024
        padding += 0 if n & (n - 1) == 0 else 1024 - n
        for d, start, length in pieces:
            seen[d].append((start, length))
    for d, n in enumerate(lengths):
        at = 0
        for start, length in sorted(seen[d]):
            assert start == at and length > 0
            at += length
        assert at == n
    assert padding < 1024


def test_step_groups_are_even():
    windows = packing.pack_block([random.Random(3).randint(1, 2500) for _ in range(400)])
    groups = packing.step_groups(windows)
    tokens = Counter()
    for (tier, _), g in zip(windows, groups, strict=True):
        tokens[g] += tier
    assert all(abs(tokens[g] - 16 * 1024) <= 1024 for g in list(tokens)[:-1])


def check_pieces(rows, pieces):
    library = Tokenizer.from_file(tokenizer())
    sequences, texts = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        texts[p.doc_id].append(p)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    for i, t, *_ in rows:
        b = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        got = sorted(texts[i], key=lambda p: p.start)
        assert sum(p.length for p in got) == len(b) // 4 * sum(r[0] == i for r in rows)
        assert all(p.ids_crc32 == zlib.crc32(b[4 * p.start : 4 * (p.start + p.length)]) and p.doc_tokens == len(b) // 4 for p in got)


def test_packing_documents(spark, odd, none):
    rows = corpus(7, 120)
    check_pieces(rows, packing.pack(docs(spark, rows), tokenizer(), block_tokens=2000).collect())
    check_pieces(ODD, packing.pack(odd, tokenizer()).collect())
    assert packing.pack(none, tokenizer()).count() == 0


# --- 8 Jaccard


def plain_components(rows):
    sets = {}
    for i, t, *_ in rows:
        w = [re.sub("[A-Z]", lambda c: c[0].lower(), x) for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    keys = sorted(sets)
    for x, a in enumerate(keys):
        for b in keys[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in keys}


def near_copies(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(30):
        base = [f"w{rng.randint(0, rng.choice([30, 4000]))}" for _ in range(rng.choice([1, 4, 5, 8, 9, 10, 14, 24, 40, 90, 700]))]
        for _ in range(rng.choice([1, 2, 4, 12])):
            b = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                k = rng.randrange(len(b))
                b[k : k + rng.choice([0, 1])] = [f"x{rng.randint(0, 9)}"]
            rows.append((len(rows) * 7, " ".join(b).upper() if rng.random() < 0.3 else " \n".join(b), "en", "s"))
    return rows + [(90_000, None, None, None), (90_001, "", None, None), (90_002, "a", None, None), (90_003, "A", None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_plain(spark, seed):
    rows = near_copies(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.cluster(docs(spark, rows)).collect()}
    want = plain_components(rows)
    assert got == want
    kept = {r.doc_id for r in jaccard.one_of_each(docs(spark, rows)).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_one_large_group(spark, monkeypatch):
    """More near copies than two blocks hold, dealt over a grid."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base, f"tail{i}"]), "en", "s") for i in range(40)]
    assert {r.component_id for r in jaccard.cluster(docs(spark, rows)).collect()} == {0}


def drifting(seed):
    """Texts of which neighbours link and far ones do not, all with lists in common, beside near copies of one text."""
    rng = random.Random(seed)
    words = [f"d{i}" for i in range(90)]
    texts = [" ".join([*words[: 60 - k], *(f"e{i}" for i in range(k)), "the end of it all"]) for k in range(0, 50, 2)]
    texts += [" ".join([*(f"c{i}" for i in range(50)), f"tail{k}"]) for k in range(40)]
    rng.shuffle(texts)
    return [(i * 3, t, "en", "s") for i, t in enumerate(texts)]


@pytest.mark.parametrize("rows", [drifting(1), near_copies(3)], ids=["drifting", "near copies"])
def test_long_lists_against_plain(spark, monkeypatch, rows):
    """Blocks of two sets and runs of six: all rounds, and sets that meet only across the runs of a list."""
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    monkeypatch.setattr(jaccard, "GRID", 6)
    met = []
    monkeypatch.setattr(jaccard, "runs_met", lambda rows, grid, f=jaccard.runs_met: met.append(f(rows, grid)) or met[-1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.cluster(docs(spark, rows)).collect()}
    assert met and got == plain_components(rows)


@pytest.mark.parametrize("m", [1000, 4000])
def test_rows_of_a_list_grow_with_its_sets(m):
    """One list: no more rows than sets and runs, no more pairs than sets, whatever the number of blocks."""
    rng = np.random.default_rng(2)
    names = np.sort(rng.integers(0, 1 << 62, m))
    of_list = pa.RecordBatch.from_arrays([pa.array(np.full(m, 7)), pa.array(names), pa.array(np.full(m, 60, np.int32)), pa.nulls(m, pa.binary())], ["key", "name", "n", "bits"])
    assert sum(b.num_rows for b in jaccard._tiles(jaccard.GRID)(iter([of_list]))) == m
    assert sum(b.num_rows for b in jaccard._tiles(500)(iter([of_list]))) <= m + m // 500
    base = rng.integers(0, 1 << 63, 57, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base, rng.integers(0, 1 << 63, 3, dtype=np.uint64)))) for _ in range(m)]
    bits = jaccard.bitmaps(np.concatenate(sets), np.arange(m + 1) * 60, np.arange(m))
    cols = [np.full(m, 1), np.full(m, 2), np.arange(m), np.full(m, 60, np.int32)]
    tile = pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(bits, pa.binary())], ["t1", "t2", "sid", "n", "bits"])
    pairs = np.concatenate([np.stack([b.column(i).to_numpy() for i in (0, 1)], axis=1) for b in jaccard._candidates(1, jaccard.BLOCK)(iter([tile]))])
    assert len(pairs) == m - 1 and set(pairs.ravel().tolist()) == set(range(m))  # a spanning tree
    one = tile.append_column("root", pa.array(np.zeros(m, np.int64)))
    assert sum(b.num_rows for turn in (2, 3) for b in jaccard._candidates(turn, jaccard.BLOCK)(iter([one]))) == 0


def test_lists_end_where_sizes_are_too_far():
    """80 of 100 may link, 79 of 100 may not: of five sets on a list, two and two are held against each other."""
    n = np.array([79, 100, 125, 157, 190], np.int32)
    of_list = pa.RecordBatch.from_arrays([pa.array(np.full(5, 7)), pa.array(np.arange(5)), pa.array(n), pa.nulls(5, pa.binary())], ["key", "name", "n", "bits"])
    rows = [r for b in jaccard._tiles(jaccard.GRID)(iter([of_list])) for r in b.to_pylist()]
    tiles = {t: sorted(r["n"] for r in rows if r["t1"] == t) for t in {r["t1"] for r in rows}}
    assert sorted(tiles.values()) == [[100, 125], [157, 190]]


def test_runs_meet_where_components_differ(spark):
    """A list of 40 sets, of which 37 are one component; another of one component."""
    rows = [(1, i, 50, b"", 0 if i < 37 else i) for i in range(40)] + [(2, i, 50, b"", 0) for i in range(30)]
    table = written(spark.createDataFrame(rows, "list long, sid long, n int, bits binary, root long"), "met")
    got = jaccard.runs_met(table, 10).collect()
    tiles = {}
    for r in got:
        tiles.setdefault((r.t1, r.t2), set()).add(r.sid)
    meet = {(a, b) for t in tiles.values() for a in t for b in t if a < b}
    assert all((a, b) in meet for b in range(37, 40) for a in range(b))
    assert {r.t1 for r in got} == {1} and len(got) == 37 + 3 * (4 + 1)


def test_signatures_miss_no_pair():
    """For linked sets around the boundary the lists meet, whatever the boundary and the frequent tokens."""
    rng = np.random.default_rng(3)
    for light in (0, 6, 12, 30):
        for _ in range(150):
            n = int(rng.integers(1, 40))
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            b = np.unique(np.concatenate((a[: n - int(rng.integers(0, max(1, n // 9 + 1)))], rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n // 9 + 1))), dtype=np.uint64))))
            a = np.unique(a)
            common = len(np.intersect1d(a, b))
            if len(a) > 1 and len(b) and not np.array_equal(a, b) and 100 * common >= 80 * (len(a) + len(b) - common):
                hot = np.concatenate((a[::3], b[::4]))
                o = jaccard.Order(np.unique(hot), rng.integers(2, 9000, len(np.unique(hot))), light)
                keys = [set(o.keys(s, o.weight(s), k).tolist()) for s, k in ((a, 5), (b, 77))]
                assert keys[0] & keys[1]
                both = np.concatenate((a, b))
                off = np.array([0, len(a), len(both)])
                k, of = o.batch_keys(both, off, np.array([5, 77]), np.array([True, True]))
                assert [set(k[of == i].tolist()) for i in (0, 1)] == keys


def test_bitmaps_never_overstate():
    rng = np.random.default_rng(4)
    for n in (3, 200, 900, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[: -max(1, n // 15)], rng.integers(0, 1 << 63, n // 20, dtype=np.uint64))))
        maps = jaccard.bitmaps(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), np.array([0, 1]))
        m = min(map(len, maps))
        x, y = (np.frombuffer(jaccard.folded(z, m), np.uint8) for z in maps)
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
        linked = 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
        assert not linked or len(jaccard.near_pairs(np.array([len(a), len(b)]), maps)[0]) == 1


def test_boundary_follows_cost():
    assert jaccard.boundary({}) == 0
    assert jaccard.boundary({5: (1000, 900.0), 6: (1000, 900.0)}) >= 6  # crowded lists: subsets pay
    assert jaccard.boundary({60: (1000, 1.0)}) < 60


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    roots = {r.node: r.root for r in jaccard.components(edges).collect()}
    assert all(roots[i] == 0 for i in range(41)) and roots[102] == 100


def test_rows_of_one_id_keep_their_links(spark):
    rng = random.Random(4)
    a, b, c = (" ".join(f"x{rng.randint(0, 999)}" for _ in range(60)) for _ in range(3))
    rows = [(1, a), (1, b), (5, b + " more"), (7, c), (None, c + " one"), (6, c + " one two"), (3, c + " one two"), (1, a)]
    table = docs(spark, [(i, t, None, None) for i, t in rows])
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.cluster(table).collect()}
    assert got == {(1, 56): 1, (5, 57): 1, (7, 56): 3, (None, 57): 3, (6, 58): 3, (3, 58): 3}
    assert sorted((r.doc_id or 0, r.text) for r in jaccard.one_of_each(table).collect()) == sorted([(1, a), (1, b), (0, c + " one"), (3, c + " one two")])


def test_place_filter_lets_all_wanted_through(spark):
    places = [r.p for r in spark.range(3000).select(F.xxhash64("id").alias("p")).collect()]
    wanted = spark.createDataFrame([(p,) for p in places[:1000]], "place long")
    bitmap, bits = jaccard.place_filter(wanted, 1000)
    hit = [bool(int(bitmap[p % 2**64 % bits >> 6]) >> (p % 2**64 % bits & 63) & 1) for p in places]
    assert all(hit[:1000]) and sum(hit[1000:]) < 400


def test_counts_of_prefixes():
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3, 4, 5], [1, 2, 3, 4, 6], [1], list(range(200)))]
    t, c = np.unique(np.concatenate(sets), return_counts=True)
    sizes, length, total = jaccard._prefixes(sets, t, c)
    # a set of 5 lists its 2 rarest tokens: 5 is in two sets, one of 1 to 4 in three or four
    assert (sizes.tolist(), length.tolist()) == ([1, 5], [1, 4]) and total.tolist()[1] == 2 * (int(c[t == 5][0]) + 3)


def test_jaccard_odd(odd, none):
    got = jaccard.cluster(odd).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.doc_id == 1 << 60} == {3}
    assert jaccard.cluster(none).count() == 0
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [-7, 0, 2, 3, 4, 5]


# --- 9 shards


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 40, 200])
def test_jump_hash_against_plain(spark, shards):
    d = spark.range(-300, 300).withColumn("shard", F.lit("x"))
    for r in sharding.assign(d, "id", shards).withColumn("k", F.xxhash64("id")).collect():
        assert r.shard == jump(r.k % (1 << 64), shards) and r.grown_shard == jump(r.k % (1 << 64), shards + 1)
        assert r.grown_shard in (r.shard, shards)


def test_jump_hash_beyond_the_first_steps(spark):
    d = spark.range(200)
    few = d.select(F.xxhash64("id").alias("k")).select("k", sharding.jump_state(F.col("k"), 90, steps=2)["b"].alias("b"))
    assert all(r.b == jump(r.k % (1 << 64), 90) for r in few.collect())


def test_shards_and_slots(spark, odd, none):
    rows = corpus(5, 400) + [(3, "again", None, None)] * 5
    for table, want in ((docs(spark, rows), rows), (odd, ODD)):
        slots = defaultdict(list)
        got = sharding.shard_documents(table).collect()
        texts = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in want)
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == texts
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(none).count() == 0


# --- 10 token files


def check_encoder(encoder, library, texts):
    got, ends = encoder.encode(pa.array(texts, pa.string()))
    for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True):
        assert got[a:b].tolist() == [*(library.encode(t, add_special_tokens=False).ids if t else []), 0], t


def test_encoder_is_exact():
    e, library, rng = tokens.Encoder(tokenizer()), Tokenizer.from_file(tokenizer()), random.Random(0)
    signs = [*"ab  \t\n\r\x0b\x0cÀß½²×'.,_-\xa0\x1c\x85\xadǅ»’…–1٣日🙂é́sdmtlvre\0", "a long word of very many letters", "thandingeshenationable", "'ll", "<|endoftext|>"]
    for some in (signs, signs[:20]):
        for _ in range(12):
            check_encoder(e, library, ["".join(rng.choice(some) for _ in range(rng.randint(0, 25))) for _ in range(300)] + [None, "", "<|endoftext|>"])
    check_encoder(e, library, ["a <|endoftext|> b", "I'll we've 'd 's x's's ''s", " ".join(f"v{i}" for i in range(30_000)), "x" * 5000])
    check_encoder(e, library, [])


def test_encoder_tables_are_bounded(monkeypatch):
    for name, value in (("KEEP", 400), ("SLOTS", 800), ("GROUP", 50), ("KEEP_LONG", 5)):
        monkeypatch.setattr(tokens, name, value)
    e, library = tokens.Encoder(tokenizer()), Tokenizer.from_file(tokenizer())
    for i in range(120):
        check_encoder(e, library, [" ".join(f"w{i * 7 + k} the{'x' * k} same" for k in range(30))] * 2)
        assert e.pieces.n <= 401 and len(e.long) <= 5


def test_slices_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "BYTES", 10)
    monkeypatch.setattr(tokens, "ROWS", 3)
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 4, None, "", "b", "c" * 11, "d" * 30, "e", "f"], pa.string())], ["t"])
    got = [x.column(0).to_pylist() for x in tokens.slices(batch, 0)]
    assert got == [["a" * 4, None, ""], ["b"], ["c" * 11], ["d" * 30], ["e", "f"]]


@pytest.mark.parametrize("rows", [ODD, corpus(11, 150), []])
def test_token_files_round_trip(spark, rows):
    library, at = Tokenizer.from_file(tokenizer()), 0
    got = sorted(tokenbin.round_trip(docs(spark, rows), tokenizer()).collect(), key=lambda r: r.start)
    keyed = lambda i: (i is not None, i or 0)
    assert [keyed(r.doc_id) for r in got] == sorted(keyed(r[0]) for r in rows)
    want = Counter((i, zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_token_files_can_be_searched(spark, tmp_path):
    path = str(tmp_path / "t.orc")
    tokenbin.write_tokens(docs(spark, corpus(12, 50)), path, tokenizer())
    hit = tokenbin.read_tokens(spark, path).where("doc_id = 30")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,30)]" in hit._jdf.queryExecution().toString()
    assert hit.count() == 1
