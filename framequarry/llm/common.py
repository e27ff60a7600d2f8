"""Shared pieces of the text operators: shared storage, fresh names, checked broadcasts."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words are maximal runs of anything but these: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A side of a join is broadcast only if its rows, as counted before, need no more; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20


def tidy() -> None:
    """Gives Arrow's and the C library's free memory back to the system at the end of a task."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session may run without the setting; it then gets a temporary folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="fq-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/fq-{uuid.uuid4().hex}/{name}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p.getParent(), True)
    except Exception:  # the session may be gone when the interpreter ends
        pass


_open: list[list[str]] = []  # the folders written in each scratch block that is open


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df written to the shared folder as Parquet and read back: lineage ends here.

    In a scratch block the table goes with the block; with ``keep`` it stays as long as the block around it.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    for block in _open[-2:-1] if keep else _open[-1:]:
        block.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written within are deleted at its end. What goes out must be written with ``keep``."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            _remove(spark, path)
        collect(spark)


def collect(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of queries that are done: it does when their plans are collected as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def collect_executors(spark: SparkSession) -> None:
    """Has the executors collect their garbage, so that the heap which only garbage holds goes back to the system.

    A heap grows with what a step allocates and stays as large in the steps that follow, where the largest
    of all steps would count. One task a core, about a second for all; an executor whose cores are all busy may get none.
    A local session has no executors but the driver's own process.
    """
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return
    cores = spark.sparkContext.defaultParallelism
    try:
        spark.range(0, cores, 1, cores).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()
    except PySparkException:  # a platform may forbid reflection; garbage is then collected when the heap is full
        pass


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have, whatever the case."""
    have, name, n = {c.lower() for c in df.columns}, base, 0
    while name.lower() in have:
        n += 1
        name = f"{base}_{n}"
    return name


def size_of(df: DataFrame) -> int:
    """About the bytes of df's rows in memory: 8 a number, strings and arrays of numbers by their lengths."""
    row: Column = F.lit(16)
    for name, kind in df.dtypes:
        more = F.octet_length(name) + 16 if kind in ("string", "binary") else F.greatest(F.size(name), F.lit(0)) * 8 + 24 if kind.startswith("array") else F.lit(8)
        row = row + F.coalesce(more, F.lit(8))
    return df.agg(F.sum(row.cast("long"))).first()[0] or 0


def checked(small: DataFrame) -> DataFrame:
    """small, which must be stored, with a broadcast hint if its measured size is within the limit."""
    return F.broadcast(small) if size_of(small) <= BROADCAST_BYTES else small


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def n_words(col: Column) -> Column:
    """Words in a text; null counts none."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def slots(df: DataFrame, group: str, order: list[str], name: str, rows: int, per_task: int = 4096) -> DataFrame:
    """Adds ``name``, a number from 0 without gaps in every value of ``group``.

    Each group is dealt into hash buckets of about ``per_task`` rows. Counts of the buckets give
    the offset of each, so that no task sees more than a bucket, however large the group is.
    ``df`` must be stored: it is read twice. ``order`` must tell its rows apart.
    """
    b = fresh(df, "_fq_bucket")
    buckets = max(16, -(-rows // per_task))
    dealt = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(group, b).agg(F.count(F.lit(1)).alias("_fq_n"))
    before = Window.partitionBy(group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(group).alias("_fq_g"), F.col(b).alias("_fq_b"), F.coalesce(F.sum("_fq_n").over(before), F.lit(0)).alias("_fq_at")
    )
    place = F.row_number().over(Window.partitionBy(group, b).orderBy(*order))
    joined = dealt.join(offsets, F.col(group).eqNullSafe(F.col("_fq_g")) & (F.col(b) == F.col("_fq_b")))
    return joined.withColumn(name, (F.col("_fq_at") + place - 1).cast("long")).drop(b, "_fq_g", "_fq_b", "_fq_at")
