"""Token ids in ORC files: stripes, integer run-length encoding, row indexes and Bloom filters on doc_id."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..ship import ship
from .common import fresh_path
from .tokens import Encoder, slices

ORC = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "2000",
    "orc.stripe.size": str(32 << 20),
    "compression": "snappy",
}


def _encode(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            for part in slices(batch, 1):
                ids, ends = encoder.encode(part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends)), lists], ["doc_id", "n_tokens", "ids"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Writes (doc_id, n_tokens, ids array<int>) in ascending doc_id order over the files of ``path``.

    Null text counts as empty; each document ends with id 0. Texts are dealt by ranges of doc_id and
    sorted in each, null ids first, so the files' names give the order and the stripes' indexes bound
    the ids they hold. Equal ids stay together, in any order. One shuffle, of the texts.
    """
    ship(docs.sparkSession)
    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    writer = ranged.mapInArrow(_encode(tokenizer), "doc_id bigint, n_tokens bigint, ids array<int>").write
    for k, v in ORC.items():
        writer = writer.option(k, v)
    writer.orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids) as written; filters on doc_id skip stripes by index and Bloom filter."""
    return spark.read.schema("doc_id bigint, n_tokens bigint, ids array<int>").orc(path)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crc, pa.int64()), batch.column(3), batch.column(4)], ["doc_id", "n_tokens", "ids_crc32", "file", "row"])


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 from the files of ``path``.

    Files hold ranges of doc_id. Sums a file, one row each, give a file's offset; within a file rows
    are numbered in reading order.
    """
    ship(spark)
    rows = read_tokens(spark, path).select("doc_id", "n_tokens", "ids", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row"))
    rows = rows.mapInArrow(_sums, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, file string, row bigint")
    return place(rows.withColumn("file", F.regexp_extract("file", r"part-(\d+)", 1).cast("int")), spark, path)


def place(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    sizes = read_tokens(spark, path).select("n_tokens", F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).cast("int").alias("f")).groupBy("f").agg(F.sum("n_tokens").alias("t"))
    before = sizes.select(F.col("f").alias("file"), F.coalesce(F.sum("t").over(Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at"))
    inner = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "row").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(F.broadcast(before), "file")  # a row per file
    return out.select("doc_id", (F.col("at") + F.col("_in")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the documents' ids to the shared folder and digests the files. An empty table gives no row."""
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens.orc")
    write_tokens(docs, path, tokenizer)
    return digest(spark, path)
