"""Document fingerprints by a homomorphic multiset hash, as DataFrame expressions only.

A paragraph (a line that is not empty) is hashed to a wide vector; a document's fingerprint is the
sum of its paragraphs' vectors, lane by lane, modulo powers of two. So order does not matter, and
adding or removing a paragraph adds or subtracts its vector. The vector has three parts:

* CHECK lanes, uniform modulo 2**48, which decide equality;
* NEAR lanes, modulo 2**32: the sum over the paragraph's pieces of a vector of 0 and 1;
* the number of pieces.

Twice a near lane less the number of pieces is a sum of signs, whose mean square estimates the squared
size of the multiset of pieces; that of a difference estimates what two documents do not share. All
that likeness needs is in the printed fingerprint. A paragraph is cut into pieces after every word
whose hash is 0 modulo CUT, so that cuts follow the content alone, in any language, and an edit
within a paragraph leaves most of its pieces.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHECK, CHECK_BITS = 4, 48
NEAR_WORDS = 64  # longs that hold two lanes each
CUT = 8  # words of a piece, on average
MAX_BUCKETS = 200_000
_MARK = "\x01"
_PAIR = (1 << 32) | 1
_LOW = (1 << 32) - 1


def _pieces(paragraphs: Column) -> Column:
    marked = lambda w: F.when(F.pmod(F.xxhash64(w), F.lit(CUT)) == 0, F.concat(w, F.lit(_MARK))).otherwise(w)
    cut = F.transform(paragraphs, lambda p: F.array_join(F.transform(F.split(p, " "), marked), " "))
    return F.filter(F.split(F.array_join(cut, _MARK), _MARK), lambda x: x != "")


def vector(text: Column) -> Column:
    """struct(check array<long>, near array<long>, n long) of a text that is not null."""
    mask = F.lit((1 << CHECK_BITS) - 1)
    paragraphs = F.filter(F.split(text, "\n"), lambda p: p != "")
    hashed = F.transform(paragraphs, lambda p: F.array(*[F.xxhash64(F.lit(i), p).bitwiseAND(mask) for i in range(CHECK)]))
    check = F.aggregate(hashed, F.array_repeat(F.lit(0).cast("long"), CHECK), lambda acc, h: F.zip_with(acc, h, lambda a, b: (a + b).bitwiseAND(mask)))
    pieces = _pieces(paragraphs)
    bits = F.transform(pieces, lambda p: F.struct(F.xxhash64(F.lit(CHECK), p).alias("a"), F.xxhash64(F.lit(CHECK + 1), p).alias("b")))

    def lanes(acc: Column, h: Column) -> Column:
        half = NEAR_WORDS // 2
        return F.transform(acc, lambda a, j: a + F.call_function("shiftrightunsigned", F.when(j < half, h["a"]).otherwise(h["b"]), F.pmod(j, F.lit(half))).bitwiseAND(F.lit(_PAIR)))

    near = F.aggregate(bits, F.array_repeat(F.lit(0).cast("long"), NEAR_WORDS), lanes)
    return F.struct(check.alias("check"), near.alias("near"), F.size(pieces).cast("long").alias("n"))


def hex_of(v: Column) -> Column:
    """The printed fingerprint, in hexadecimal: the number of pieces (8 digits), check lanes (12 each), near lanes (8 each, the low half of a long first)."""
    digits = lambda x, n: F.lpad(F.hex(x), n, "0")
    check = F.array_join(F.transform(v["check"], lambda x: digits(x, CHECK_BITS // 4)), "")
    near = F.array_join(F.transform(v["near"], lambda x: F.concat(digits(x.bitwiseAND(F.lit(_LOW)), 8), digits(F.shiftrightunsigned(x, 32), 8))), "")
    return F.lower(F.concat(digits(v["n"].bitwiseAND(F.lit(_LOW)), 8), check, near))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector of two documents together (sign 1), or of a without the paragraphs of b (sign -1)."""
    mask = F.lit((1 << CHECK_BITS) - 1)
    check = F.zip_with(a["check"], b["check"], lambda x, y: (x + F.lit(sign) * y).bitwiseAND(mask))

    def lane(x: Column, y: Column) -> Column:
        low = (x.bitwiseAND(F.lit(_LOW)) + F.lit(sign) * y.bitwiseAND(F.lit(_LOW))).bitwiseAND(F.lit(_LOW))
        high = (F.shiftrightunsigned(x, 32) + F.lit(sign) * F.shiftrightunsigned(y, 32)).bitwiseAND(F.lit(_LOW))
        return F.shiftleft(high, 32).bitwiseOR(low)

    return F.struct(check.alias("check"), F.zip_with(a["near"], b["near"], lane).alias("near"), (a["n"] + F.lit(sign) * b["n"]).alias("n"))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from two vectors: 1 - |a - b|^2 / (|a|^2 + |b|^2), each size estimated by the near lanes; 1 if equal."""

    def sign(x: Column, n: Column, high: bool) -> Column:
        return (F.lit(2) * (F.shiftrightunsigned(x, 32) if high else x.bitwiseAND(F.lit(_LOW))) - n).cast("double")

    def parts(x: Column, y: Column) -> Column:
        al, ah, bl, bh = sign(x, a["n"], False), sign(x, a["n"], True), sign(y, b["n"], False), sign(y, b["n"], True)
        return F.struct((al * bl + ah * bh).alias("p"), (al * al + ah * ah + bl * bl + bh * bh).alias("q"))

    sums = F.aggregate(
        F.zip_with(a["near"], b["near"], parts), F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("q")),
        lambda s, x: F.struct((s["p"] + x["p"]).alias("p"), (s["q"] + x["q"]).alias("q")),
        lambda s: F.when(s["q"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * s["p"] / s["q"]))).otherwise(F.lit(0.0)),
    )
    return F.when((a["n"] == b["n"]) & (a["check"] == b["check"]) & (a["near"] == b["near"]), F.lit(1.0)).otherwise(sums)


def _longs(xs: list[int]) -> Column:
    """A literal array: folded before the query runs, whatever its length."""
    return F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>") if xs else F.array().cast("array<bigint>")


def _rank(x: Column, bounds: list[int], strict: bool) -> Column:
    """How many of the descending bounds are above x (or, if not strict, not below it). Two levels: a row costs about twice the root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    above = (lambda y: y > x) if strict else (lambda y: y >= x)
    k = F.size(F.filter(_longs(bounds[::step]), above))
    inner = F.size(F.filter(F.slice(_longs(bounds), F.greatest(k - 1, F.lit(0)) * step + 2, F.lit(step - 1)), above)) if step > 1 else F.lit(0)
    return F.when(k == 0, 0).otherwise((k - 1) * F.lit(step) + 1 + inner)


def with_next(docs: DataFrame, per_task: int = 512) -> DataFrame:
    """doc_id, text (null: empty), v (its vector), next_text, next_v: those of the next document by descending doc_id.

    After the last comes the first. Null ids are last; rows of one id stand in a fixed order that
    their texts decide. Quantiles of doc_id cut the order into buckets of about ``per_task`` rows, more
    if there would be over MAX_BUCKETS; an id of many buckets is cut by a hash of the text. Each bucket
    is ordered in one task; its first row is lent to the one before it. So each text is moved
    once, and no task holds more than a bucket. The driver gets two numbers a bucket.
    """
    x = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    rows = docs.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    parts = min(MAX_BUCKETS, rows // per_task)
    bounds: list[int] = []
    if parts > 1:
        got = docs.select(F.percentile_approx(x, F.split(F.lit(",".join(str(i / parts) for i in range(1, parts))), ",").cast("array<double>"), F.lit(min(20 * parts, 2_000_000)))).first()[0]
        bounds = sorted((int(y) for y in got), reverse=True)
    many = len(set(bounds)) < len(bounds)
    h = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), 1) if many else F.lit(0).cast("long")
    above = _rank(F.col("_x"), bounds, True)
    equal = _rank(F.col("_x"), bounds, False) - above
    bucket = above + F.floor(F.col("_h") / F.lit(float(1 << 63)) * (equal + 1)).cast("int") if many else above
    keyed = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), x.alias("_x"), h.alias("_h")).withColumn("_b", bucket)
    first = F.max(F.struct("_x", F.bitwise_not("_h").alias("i"))).alias("first")
    tops = sorted((r["_b"], r["first"]["_x"], ~r["first"]["i"]) for r in keyed.groupBy("_b").agg(first).collect())
    order = [b for b, *_ in tops]
    at = [bisect_left(order, b) for b in range(len(bounds) + 1)]  # among the buckets that have rows
    look = lambda xs, i: F.element_at(_longs(xs), i + 1)
    own = F.array(F.struct(F.col("_b").alias("b"), F.lit(False).alias("lent")))
    if tops:
        i = look(at, F.col("_b")).cast("int")
        to = look([order[k - 1] for k in range(len(order))], i).cast("int")
        is_first = (F.col("_x") == look([t[1] for t in tops], i)) & (F.col("_h") == look([t[2] for t in tops], i))
        own = F.when(is_first, F.array(F.struct(F.col("_b").alias("b"), F.lit(False).alias("lent")), F.struct(to.alias("b"), F.lit(True).alias("lent")))).otherwise(own)
    dealt = keyed.withColumn("v", vector(F.col("text"))).withColumn("_t", F.explode(own))
    w = Window.partitionBy("_t.b").orderBy("_t.lent", F.col("_x").desc(), "_h", "text")
    out = dealt.withColumns({"next_text": F.lead("text").over(w), "next_v": F.lead("v").over(w)})
    return out.where(~F.col("_t.lent")).select("doc_id", "text", "v", "next_text", "next_v")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per document.

    Null text counts as empty; an empty text has the zero vector, and two empty texts likeness 1.
    Texts with the same paragraphs in any order have equal fingerprints. Repeated rows are kept. Other columns are not used.
    """
    d = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    d = d.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "v", "next_v")
    d = d.select("*", vector(F.col("edited")).alias("ev"))
    v, ev, nv = F.col("v"), F.col("ev"), F.col("next_v")
    return d.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), hex_of(v).alias("fingerprint"),
        hex_of(ev).alias("edited_fingerprint"), likeness(v, ev).alias("near_edited"), likeness(v, nv).alias("near_next"),
    )
