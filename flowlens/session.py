"""A Spark session with the settings the operators rely on at scale."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

SETTINGS = {
    # Runtime re-planning: partition sizes, broadcast of sides that turn out small, skewed joins.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Sessions of a flooded key are merged inside each map task before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # Arrow batches stay small even if single payloads are large.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app: str, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for name, value in {**SETTINGS, **extra}.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, for the Python parts of a plan."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="flowlens-"), "flowlens.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, files in sorted(os.walk(root)):
            for name in sorted(f for f in files if f.endswith(".py")):
                full = os.path.join(folder, name)
                archive.write(full, os.path.join("flowlens", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
