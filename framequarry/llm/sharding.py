"""Sharding by jump consistent hashing (Lamping and Veach), as DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, slots, written

# The multiplier of the published 64-bit linear congruential generator, as two halves.
MULTIPLIER = 2862933555777941757
_MH, _ML = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
_MASK = (1 << 32) - 1


def _low_product(x: Column, c: int) -> Column:
    """x * c modulo 2^32, and at most 2^49: x and c are below 2^32, and no product may overflow."""
    high = F.shiftright(x, 16) * F.lit(c)
    return x.bitwiseAND(F.lit(0xFFFF)) * F.lit(c) + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)


def _advance(s: Column, shards: int) -> Column:
    hi, lo = s["hi"], s["lo"]
    p = F.shiftright(lo, 16) * F.lit(_ML)
    t = lo.bitwiseAND(F.lit(0xFFFF)) * F.lit(_ML) + F.shiftleft(p.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    new_lo = t.bitwiseAND(F.lit(_MASK))
    carry = F.shiftright(t, 32) + F.shiftright(p, 16)
    new_hi = (carry + _low_product(lo, _MH) + _low_product(hi, _ML)).bitwiseAND(F.lit(_MASK))
    scale = F.lit(float(1 << 31)) / (F.shiftright(new_hi, 1) + F.lit(1)).cast("double")
    jump = F.floor((s["j"] + F.lit(1)).cast("double") * scale).cast("long")
    on = F.struct(new_hi.alias("hi"), new_lo.alias("lo"), s["j"].alias("b"), jump.alias("j"))
    return F.when(s["j"] >= F.lit(shards), s).otherwise(on)


def jump_state(key: Column, shards: int, steps: int = 64) -> Column:
    """struct(hi, lo, b, j): b is the shard of the 64-bit key among ``shards``, j the next bucket it would jump to.

    A key needs about ln(shards) jumps and ``shards`` at most. The first ``steps`` are tried for all
    rows; a row that needs more gets as many as there can be. So the result is always exact.
    """
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(_MASK)).alias("lo"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j")
    )

    def run(s: Column, n: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(n)), s, lambda acc, _: _advance(acc, shards))

    first = run(start, min(shards, steps))
    return first if shards <= steps else F.when(first["j"] < F.lit(shards), run(first, shards)).otherwise(first)


def assign(df: DataFrame, key: str, shards: int, shard: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """Adds ``shard`` (0 to shards - 1) and ``grown``, the shard if there were one more.

    The value of ``key`` and the number of shards alone decide; a row moves only into the added shard.
    Null keys count as one key. No shuffle; an empty table gives an empty table; other columns stay.
    A column of df that has either name is replaced.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    s = fresh(df, "_fq_jump")
    out = df.withColumn(s, jump_state(F.xxhash64(F.col(key)), shards))
    return out.withColumns({
        shard: F.col(s)["b"].cast("int"),
        grown: F.when(F.col(s)["j"] == F.lit(shards), F.lit(shards)).otherwise(F.col(s)["b"]).cast("int"),
    }).drop(s)


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row per document with its shard and its slot there.

    size is the UTF-8 length of text (null: 0) plus 16. Slots run from 0 without gaps in each shard;
    repeated rows get slots of their own. Texts are read once and never shuffled: only the sizes,
    checksums and keys are, dealt by shard and hash bucket, so a hot shard or key is spread.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    small = docs.select(
        "doc_id",
        (F.octet_length(raw) + F.lit(16)).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("_u"),
    )
    stored = written(assign(small, "doc_id", shards), "shards")
    rows = stored.count()
    out = slots(stored, "shard", ["doc_id", "_u"], "slot", -(-rows // shards))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
