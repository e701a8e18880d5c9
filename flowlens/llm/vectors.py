"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside cells.

Equal vectors are one class from the start. Each class goes to its nearest cell and to every cell nearly
as near, so that close vectors on either side of a border meet. A cell of any size is cut into blocks of
bounded size; a task multiplies two blocks, and gives back counts and one edge per vector, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.tables import components, saved

SAMPLE = 20_000  # bound on the vectors that the centres are fitted on
CELL = 1_000  # classes per cell aimed at
CENTRES = 2_000  # bound on the centres, which go to all tasks
BLOCK = 256  # vectors in a block
MARGIN = 0.12  # a cell is also visited if its centre's cosine is at most this much below the best


def fit_centres(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Spherical k-means: unit centres of unit vectors. Empty cells keep their centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds if len(centres) > 1 else 1):
        near = np.concatenate([np.argmax(x[i : i + 2048] @ centres.T, axis=1) for i in range(0, len(x), 2048)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1)
        centres[size > 1e-12] = sums[size > 1e-12] / size[size > 1e-12, None]
    return centres


def usable(vec: Column, label: Column) -> Column:
    """Vectors that can link: with a label, no null or non-finite part, and not zero."""
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(label.isNotNull() & vec.isNotNull() & finite & F.exists(vec, lambda v: v != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    """Scaled to length 1 in double precision, safe from overflow and underflow."""
    x = rows.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def links_in(group: pa.Table, least: float) -> pa.Table:
    """Links between two blocks of a cell (or inside one): per vector its count and a root of what it is linked with.

    A pair that meets in several cells counts in the first cell that both visit.
    """
    width, cell = group.column("width")[0].as_py(), group.column("cell")[0].as_py()
    ids, copies = (group.column(c).to_numpy() for c in ("id", "copies"))
    block = group.column("block").to_numpy()
    low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
    x = unit(matrix(group.column("vec").combine_chunks(), width))
    close = x @ x.T >= least
    np.fill_diagonal(close, False)
    if low != high:
        close &= block[:, None] != block[None, :]
    hit = np.flatnonzero(close.any(axis=1))
    close, ids, copies = close[np.ix_(hit, hit)], ids[hit], copies[hit]
    # The first cell that two vectors share, once for each pair of different visiting lists.
    kinds: dict[tuple[int, ...], int] = {}
    code = np.array([kinds.setdefault(tuple(v), len(kinds)) for v in group.column("cells").take(pa.array(hit)).to_pylist()], np.int64)
    sets = [frozenset(v) for v in kinds]
    first = np.zeros((len(sets),) * 2, bool)
    for a in range(len(sets)):
        for b in range(a + 1):
            first[a, b] = first[b, a] = min(sets[a] & sets[b]) == cell
    close &= first[code[:, None], code[None, :]]
    hit = np.flatnonzero(close.any(axis=1))
    close, ids, copies = close[np.ix_(hit, hit)], ids[hit], copies[hit]
    root = ids.copy()
    while len(hit):
        lower = np.minimum(root, np.where(close, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (lower == root).all():
            break
        root = lower
    return pa.table({"id": pa.array(ids, pa.int64()), "links": pa.array(close @ copies, pa.int64()), "root": pa.array(root, pa.int64())})


def near_duplicates(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.93
) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Vectors link if their labels are equal and their cosine is at least ``least``. Vectors that are null,
    empty, zero, without label, or hold null or non-finite parts link with nothing; so do vectors of
    different length. Rows that repeat an id count as vectors of their own. Ids must be whole numbers;
    other columns are ignored. The group's smallest id is its representative.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    ok = usable(F.col("vec"), F.col("label")) & F.col("id").isNotNull()
    classes = saved(
        rows.where(ok).groupBy("label", "vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
        .withColumn("width", F.size("vec")),
        "vector-classes",
    )
    n = classes.count()
    common = classes.groupBy("width").count().orderBy(F.desc("count"), "width").limit(1).collect()
    width = common[0]["width"] if common else 0
    sample = classes.where(F.col("width") == width).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").toArrow()
    k = max(1, min(CENTRES, -(-n // CELL), sample.num_rows // 8 or 1))
    centres = fit_centres(unit(matrix(sample.column("vec").combine_chunks(), width)), k) if n else np.zeros((1, 1))
    shared = spark.sparkContext.broadcast(centres)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            widths = batch.column("width").to_numpy()
            cells: list[list[int]] = [[-1]] * len(widths)  # vectors of an uncommon length share one cell
            at = np.flatnonzero(widths == width)
            x = unit(matrix(batch.column("vec").take(pa.array(at)), width)) if len(at) else np.zeros((0, near.shape[1]))
            for start in range(0, len(at), 1024):
                cosines = x[start : start + 1024] @ near.T
                here = cosines >= cosines.max(axis=1, keepdims=True) - MARGIN
                for i, row in zip(at[start : start + 1024], here):
                    cells[i] = np.flatnonzero(row).tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"]
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields)
    placed = saved(classes.mapInArrow(visit, f"{kinds}, cells array<int>"), "vector-cells")
    members = placed.withColumn("cell", F.explode("cells"))
    key = ["label", "width", "cell"]
    sizes = saved(members.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "vector-blocks")
    dealt = (
        members.join(sizes, key)
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
        .drop("other", "blocks")
    )
    found = saved(
        dealt.groupBy(*key, "low", "high").applyInArrow(lambda g: links_in(g, least), "id long, links long, root long"),
        "vector-links",
    )
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), "vectors")
    told = saved(
        classes.join(counts, "id", "left").join(groups, "id", "left").select(
            "label", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component_id", "id").alias("component_id"),
        ),
        "vector-classes-told",
    )
    keyed = rows.withColumn("vec", F.when(ok, F.col("vec")))
    out = keyed.join(told, ["label", "vec"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
