"""Makes this package importable on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent
#: Arrow batches between the JVM and Python, unless the session sets its own: rows may be texts or images, and a
#: batch stands in the memory of both sides, twice while it grows.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the session's Python files, once an application, and bounds its Arrow batches.

    Spark serves the files to executors that join later, too.
    """
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    sc = spark.sparkContext
    if getattr(sc, "_framequarry_shipped", False):
        return spark
    path = os.path.join(tempfile.mkdtemp(prefix="fq-ship-"), "framequarry.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(HERE.rglob("*.py")):
            z.write(f, f"framequarry/{f.relative_to(HERE)}")
    sc.addPyFile(path)
    sc._framequarry_shipped = True
    return spark
