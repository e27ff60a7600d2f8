"""Site-relative line dedup: lines on more than a given share of their host's pages are boilerplate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked, fresh, scratch, written


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


PARTS = 64  # a host's lines are kept in so many arrays, by hash: a look-up scans one of them


def _held(lines: Column) -> Column:
    """array<array<bigint>>: the hashes by their remainder."""
    return F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.filter(lines, lambda x: F.pmod(x, F.lit(PARTS)) == i))


def _holds(held: Column, h: Column) -> Column:
    return F.array_contains(F.element_at(held, (F.pmod(h, F.lit(PARTS)) + 1).cast("int")), h)


def _lines() -> Column:
    """Hashes of the distinct lines of a text."""
    return F.array_distinct(F.transform(F.filter(F.transform(F.split(F.col("text"), "\n"), _trimmed), lambda x: x != ""), lambda x: F.xxhash64(x)))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = 0.02, min_pages: int = 5) -> DataFrame:
    """(host, lines: array<bigint>): hashes of the boilerplate lines of each host that has any.

    A line counts once a page, without white space at its ends; blank lines never count. It is
    boilerplate if more than ``ratio`` of the host's pages have it and at least ``min_pages`` do: on a
    host of fewer than min_pages / ratio pages the number of pages decides, not the share, since a
    line on two pages of fifty says nothing of a site. A with m lines a page has at most m / ratio such lines, so the array is bounded by page
    length, not by the number of pages. Counts are pre-aggregated before the shuffle.
    """
    per_page = docs.select(F.col(host).alias("h"), _lines().alias("ls"))
    pages = docs.groupBy(F.col(host).alias("hp")).agg(F.count(F.lit(1)).alias("pages"))
    counts = per_page.select("h", F.explode("ls").alias("line")).groupBy("h", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    over = counts.join(pages, F.col("h").eqNullSafe(F.col("hp"))).where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return over.groupBy("h").agg(F.collect_list("line").alias("lines"))


def spared(docs: DataFrame, bad: DataFrame, one_of_each: Callable[[DataFrame], DataFrame], host: str = "source", ratio: float = 0.02, min_pages: int = 5) -> DataFrame:
    """bad without the lines that are over the bounds only because near copies of a page repeat them.

    Pages that have a line of bad are cut down to one of each group of near copies, and the bounds are
    asked again: of those pages, and of all the host's pages less the copies found. Only pages with such
    lines are compared, and nothing is added to bad.
    """
    with scratch(docs.sparkSession):
        side = checked(bad).select(F.col("h").alias("_fq_h"), F.col("lines").alias("_fq_lines"))
        have = written(docs.join(side, docs[host].eqNullSafe(side["_fq_h"])).where(F.arrays_overlap(_lines(), F.col("_fq_lines"))).select(*[docs[c] for c in docs.columns]), "have")
        ones = written(one_of_each(have), "ones")
        count = lambda df, n: df.groupBy(F.col(host).alias(f"_{n}")).agg(F.count(F.lit(1)).alias(n))
        n_all, n_have, n_ones = count(docs, "n_all"), count(have, "n_have"), count(ones, "n_ones")
        pages = n_all.join(n_have, F.col("_n_all").eqNullSafe(F.col("_n_have"))).join(n_ones, F.col("_n_all").eqNullSafe(F.col("_n_ones")))
        pages = pages.select(F.col("_n_all").alias("hp"), (F.col("n_all") - F.col("n_have") + F.col("n_ones")).alias("pages"))
        again = ones.select(F.col(host).alias("h"), F.explode(_lines()).alias("line")).groupBy("h", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
        over = again.join(pages, F.col("h").eqNullSafe(F.col("hp"))).where(F.col("n") > F.lit(ratio) * F.col("pages")).select("h", "line")
        was = bad.select(F.col("h").alias("_fq_h"), F.explode("lines").alias("_fq_line"))
        still = over.join(was, F.col("h").eqNullSafe(F.col("_fq_h")) & (F.col("line") == F.col("_fq_line")), "left_semi")
        return written(still.groupBy("h").agg(F.collect_list("line").alias("lines")), "spared", keep=True)


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = 0.02, min_pages: int = 5, dropped: str | None = None, one_of_each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """docs with boilerplate lines taken out of text; all rows and columns stay.

    A page whose every line is boilerplate is left with an empty text. White space lines stay. Null
    text stays null, empty text empty; a null host is a host of its own. Repeated rows count and are
    cleaned each. ``dropped`` names a column, which replaces one of docs with that name, for the
    number of lines taken out. With ``one_of_each``, which leaves one page of each group of near copies, a
    line counts once for such a group (``spared``). Texts are not shuffled while the hosts' lists can be broadcast.
    """
    bad = written(boilerplate(docs, host, ratio, min_pages), "boilerplate")
    if one_of_each is not None:
        bad = spared(docs, bad, one_of_each, host, ratio, min_pages)
    b, k = fresh(docs, "_fq_bad"), fresh(docs, "_fq_host")
    side = checked(bad).select(F.col("h").alias(k), _held(F.col("lines")).alias(b))
    out = docs.join(side, docs[host].eqNullSafe(side[k]), "left")
    parts = F.split(F.col("text"), "\n")
    s = fresh(docs, "_fq_kept")
    out = out.withColumn(s, F.when(F.col(b).isNotNull() & F.col("text").isNotNull(), F.filter(parts, lambda x: ~_holds(F.col(b), F.xxhash64(_trimmed(x))))))
    text = F.when(F.col(s).isNull(), docs["text"]).otherwise(F.array_join(F.col(s), "\n"))
    cols = [docs[c] if c != "text" else text.alias("text") for c in docs.columns if not dropped or c.lower() != dropped.lower()]
    if dropped:
        cols.append(F.when(F.col(s).isNull(), F.lit(0)).otherwise(F.size(parts) - F.size(F.col(s))).cast("long").alias(dropped))
    return out.select(*cols)
