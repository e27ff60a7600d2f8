"""Mixing sources to target weights by capped water-filling, as DataFrame expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, checked, fresh, n_words, written

BUCKETS = 4096  # at least; their number grows with the root of that of the rows, and so do a bucket's rows


def cyclic_weights(sources: DataFrame, period: int = 3) -> DataFrame:
    """Adds ``weight`` 1 to period, repeating, to the sources in code point order, null last.

    The order is global: sources are dealt by range, and counts of the ranges give each its offset.
    """
    spark, key = sources.sparkSession, F.col("source").asc_nulls_last()
    ranged = written(sources.repartitionByRange(key).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_p").count()
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per range, not per source
    offsets = counts.select("_p", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_at"))
    place = F.col("_at") + F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    return ranged.join(F.broadcast(offsets), "_p").withColumn("weight", (F.pmod(place, F.lit(period)) + 1).cast("long")).drop("_p", "_at")


def water_fill(sources: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight): shares of the whole size by weight, none above its cap.

    The level L solves sum(min(cap, L * weight)) = whole size. Each round clamps the sources above
    their caps and reshares the rest by weight; a clamped source never comes back, so rounds end.
    A round is one aggregation to two numbers, however many sources there are.
    """
    cap, w = F.col("source_size") * F.lit(float(max_epochs)), F.col("weight")
    whole, weights = sources.select(F.sum("source_size"), F.sum(F.when(F.col("source_size") > 0, w))).first()
    if not weights:
        return sources.withColumn("target", F.lit(0.0))
    goal = min(float(whole), float(whole) * max_epochs)
    level = goal / weights
    while True:
        over = cap <= F.lit(level) * w
        clamped, free = sources.select(F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, w)), F.lit(0))).first()
        if not free:
            break
        higher = (goal - clamped) / free
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return sources.withColumn("target", F.least(cap, F.lit(level) * w))


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "crc")


def plan_of(sizes: DataFrame, targets: DataFrame, seed: int, buckets: int) -> DataFrame:
    """A row per source: _s, source_size, target, ``epochs`` (whole repetitions), and where the partial one ends: in bucket _edge, after _left words of it.

    A source's documents stand in a seeded hash order; the fractional epoch takes them from the
    front until its words are reached, the last of them in part. Sums of the hash buckets find the one
    where that happens (-1: none).
    """
    t = targets.select(
        F.col("source").alias("_s"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(F.lit(0)).cast("long").alias("epochs"),
    ).withColumn("_part", F.greatest(F.lit(0), F.round(F.col("target") - F.col("epochs") * F.col("source_size"))).cast("long"))
    sums = sizes.groupBy(F.col("source").alias("_bs"), F.pmod(_hash(seed), F.lit(buckets)).alias("_bb")).agg(F.sum("size").alias("_sz"))
    upto = Window.partitionBy("_bs").orderBy("_bb").rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        sums.withColumn("_upto", F.sum("_sz").over(upto))
        .join(t, F.col("_bs").eqNullSafe(F.col("_s")))
        .where((F.col("_upto") >= F.col("_part")) & (F.col("_upto") - F.col("_sz") < F.col("_part")))
        .select("_s", F.col("_bb").alias("_edge"), (F.col("_part") - F.col("_upto") + F.col("_sz")).alias("_left"))
    )
    # at most one edge bucket a source: the first whose running sum reaches the part
    return written(t.alias("t").join(edge.alias("e"), F.col("t._s").eqNullSafe(F.col("e._s")), "left").select("t.*", F.coalesce("_edge", F.lit(-1)).alias("_edge"), "_left"), "plan")


def take(sizes: DataFrame, plan: DataFrame, seed: int, buckets: int, only_edge: bool = False) -> DataFrame:
    """Adds ``target``, ``source_size``, ``epochs`` and ``extra`` (words of one more, partial) to each row, or to those of edge buckets only.

    Only the edge bucket's rows of each source are ordered. The order depends on seed, doc_id and
    text, so reruns agree. Rows that are equal are interchangeable.
    """
    rows = sizes.withColumn("_h", _hash(seed)).withColumn("_b", F.pmod("_h", F.lit(buckets))).join(checked(plan), F.col("source").eqNullSafe(F.col("_s")))
    inner = Window.partitionBy("source").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = rows.where("_b = _edge").withColumn("_before", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    out = at_edge.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left") - F.col("_before"))).cast("long")).drop("_before")
    if not only_edge:
        others = rows.where("_b <> _edge").withColumn("extra", F.when(F.col("_b") < F.col("_edge"), F.col("size")).otherwise(F.lit(0)).cast("long"))
        out = others.unionByName(out)
    return out.drop("_h", "_b", "_s", "_part", "_edge", "_left")


def _crc() -> Column:
    return F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def planned(docs: DataFrame, max_epochs: float, seed: int, weights: DataFrame | None) -> tuple[DataFrame, DataFrame, int]:
    """(sizes, plan, number of buckets) of docs; texts are read once, sizes and plan are stored."""
    sizes = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _crc().alias("crc")), "sizes")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        sources = cyclic_weights(sources)
    else:
        w = weights.select(F.col("source").alias("_w"), F.col("weight").cast("long").alias("weight"))
        sources = sources.join(w, F.col("source").eqNullSafe(F.col("_w")), "left").select("source", "source_size", F.coalesce("weight", F.lit(0)).alias("weight"))
    buckets = max(BUCKETS, math.isqrt(sizes.count()))
    return sizes, plan_of(sizes, water_fill(written(sources, "sources"), max_epochs), seed, buckets), buckets


def mix(docs: DataFrame, max_epochs: float = 3.0, seed: int = 42, weights: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, epochs, extra, taken.

    Sizes are words (null or empty text: 0). ``weights`` (source, weight) defaults to 1, 2, 3
    repeating. A source without words gets target 0. An empty table gives an empty table. Null is
    a source of its own. Repeated rows are documents of their own; of equal ones, any may be the one
    taken in part. Other columns of docs are not used. Texts are read once, never shuffled.
    """
    sizes, plan, buckets = planned(docs, max_epochs, seed, weights)
    return take(sizes, plan, seed, buckets).withColumn("taken", F.col("epochs") * F.col("size") + F.col("extra"))


def sample(docs: DataFrame, max_epochs: float = 3.0, seed: int = 42) -> DataFrame:
    """The documents of the mix: each row repeated as often as it is taken, a part of half or more counting as whole.

    The columns are those of docs. Rows without words are not repeated and stay once, as do rows
    of a source whose target they do not change. Rows with one doc_id and text are repeated alike.
    Texts are read twice and never shuffled while the sources' plan and the rows of their edge
    buckets, of which there are about as many as the root of a source's rows, can be broadcast.
    """
    sizes, plan, buckets = planned(docs, max_epochs, seed, None)
    half = (2 * F.col("extra") >= F.col("size")).cast("int")
    at_edge = take(sizes, plan, seed, buckets, only_edge=True)
    at_edge = written(at_edge.groupBy(F.col("doc_id").alias("_i"), F.col("crc").alias("_c"), F.col("source").alias("_q")).agg(F.max(half).alias("_m")), "edge")
    whole, row = fresh(docs, "_fq_row"), fresh(docs, "_fq_plan")
    n = F.col(f"{row}.doc_id")
    wide = docs.select(F.struct("doc_id", "source", F.col("text").rlike(WORD).alias("words"), _crc().alias("crc")).alias(row), F.struct(*docs.columns).alias(whole))
    wide = wide.withColumn("_b", F.pmod(F.xxhash64(F.lit(seed), n, F.col(f"{row}.crc")), F.lit(buckets)))
    wide = wide.join(checked(plan), F.col(f"{row}.source").eqNullSafe(F.col("_s")))
    same = n.eqNullSafe(F.col("_i")) & (F.col(f"{row}.crc") == F.col("_c")) & F.col(f"{row}.source").eqNullSafe(F.col("_q")) & (F.col("_b") == F.col("_edge"))
    wide = wide.join(checked(at_edge), same, "left")
    more = F.when(F.col("_b") < F.col("_edge"), 1).when(F.col("_b") > F.col("_edge"), 0).otherwise(F.coalesce("_m", F.lit(0)))
    copies = F.when(F.coalesce(F.col(f"{row}.words"), F.lit(False)), F.col("epochs").cast("int") + more).otherwise(F.lit(1))
    return wide.select(whole, F.explode(F.array_repeat(F.lit(0), copies)).alias("_again")).select(f"{whole}.*")
