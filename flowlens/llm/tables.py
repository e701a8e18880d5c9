"""Helpers that the operators share: written intermediate tables and connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.scale import checkpoint_dir


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the folder that all executors share and reads it again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that a piece holds at most ``rows`` rows and about ``size`` bytes (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        step = max(1, min(rows, int(n * size / max(1, batch.nbytes))))
        for at in range(0, n, step):
            yield batch.slice(at, min(step, n - at))


Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Hands what this process has freed back to the system: Arrow's buffers, and those of numpy where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(task: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A task for ``mapInArrow`` after which its process is small again.

    Spark keeps a Python process for a minute after its last task; what that holds on to is
    missing beside the stages that follow.
    """

    def run(batches: Batches) -> Batches:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, name: str) -> DataFrame:
    """Smallest id reachable over undirected ``edges`` (a, b): one row (id, component_id) per id that has an edge.

    Each round points every vertex at its smallest neighbour, follows that pointer once more and
    contracts; edges only shrink. A star of any size is one partial aggregation, so hubs are not
    collected. Rounds are written to the shared folder. Self loops and repeated edges are allowed.
    """
    links = saved(edges.select(F.col("a").alias("a"), F.col("b").alias("b")).where("a <> b").distinct(), f"{name}-edges")
    labels = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")).select(F.col("a").alias("id"), "p")
        second = first.select(F.col("id").alias("p"), F.col("p").alias("pp"))
        step = saved(first.join(second, "p").select("id", F.col("pp").alias("p")), f"{name}-step")
        left = step.select(F.col("id").alias("a"), F.col("p").alias("pa"))
        right = step.select(F.col("id").alias("b"), F.col("p").alias("pb"))
        links = saved(
            links.join(left, "a").join(right, "b").where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(),
            f"{name}-edges",
        )
        if labels is None:
            labels = step.select("id", F.col("p").alias("component_id"))
        else:
            moved = step.select(F.col("id").alias("component_id"), F.col("p").alias("q"))
            labels = labels.join(moved, "component_id", "left").select(
                "id", F.coalesce("q", "component_id").alias("component_id")
            )
    if labels is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return saved(labels, f"{name}-labels")
