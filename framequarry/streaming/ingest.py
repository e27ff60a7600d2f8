"""Folders of image files as a stream: the same sniffers and probes on files as they arrive, without state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.formats import probe

FILES = "path string, modificationTime timestamp, length long, content binary"


def images(spark: SparkSession, path: str, files_a_batch: int = 1000, max_bytes: int = 1 << 30) -> DataFrame:
    """A stream of (path, modificationTime, length, content). Larger files have a null content, which is never read."""

    def files(chosen: Column) -> DataFrame:
        return spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_a_batch).load(path).where(chosen)

    large = files(F.col("length") > max_bytes).withColumn("content", F.lit(None).cast("binary"))
    return files(F.col("length") <= max_bytes).union(large)


def probe_images(stream: DataFrame) -> DataFrame:
    """path, length, format, width, height, bit_depth, color, error of each file: a narrow map, so no watermark or state."""
    got = probe(stream.select("path", "length", "content"))
    return got.withColumn("error", F.when(F.col("content").isNull(), F.lit("too large to be read")).otherwise(F.col("error"))).drop("content")


def shared_folder(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="fq-stream-")
    return f"{at.rstrip('/')}/fq-stream-{uuid.uuid4().hex}"


def probe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headers of the driver's parts, written as a table, read as a stream of rows, probed and written once.

    The stream runs until its input is used up; its sink and checkpoints are in the shared folder.
    """
    from ..sources.derived import headers

    at = shared_folder(spark)
    source = headers(spark, sf_dir).select("file_id", "content")
    source.write.parquet(f"{at}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 64).parquet(f"{at}/in")
    q = probe(stream).drop("content").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out").select("file_id", "format", "width", "height", "bit_depth", "error")
