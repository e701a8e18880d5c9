"""Exact top-k search by inner product with a pivot-distance index.

With one more coordinate, a vector x becomes (x, sqrt(M - x·x)), M the largest x·x, and a query (q, 0). Then
|q' - x'|² = q·q + M - 2 q·x, so the largest products are the least distances and the triangle inequality
holds: a vector at distance d from a pivot that is D away from the query is at least |D - d| away from it.

1. Every vector is keyed by its nearest pivot and its distance to it; the distances of a pivot are cut into
   rings (annuli), and a ring of any size into blocks of bounded size, which are written once.
2. A query sorts the annuli by their least possible distance and expands in rounds: the nearest few first,
   then more, then the rest. After each round its k-th best product is known, and it stops where the bound
   of what comes next stays below it. A block is multiplied with just those queries that still want it.

Queries go out in waves of bounded size, and blocks stay where they are; tasks return their k best per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.tables import saved

SCALE = 1024
SAMPLE = 8_192  # bound on the vectors that pivots and the borders of rings are taken from
PIVOTS, RINGS = 64, 64  # bounds on the pivots, and on the rings of each
BLOCK = 1_024  # vectors in a block aimed at
WAVE = 32_768  # queries that go to all tasks at a time
RANKS = (4, 64)  # annuli of the first and second round; the third takes all that are left
NO_ID = (1 << 63) - 1  # stands for null, which comes last among equals
NEVER = -(1 << 63)  # the score of a query with itself
EPS = float(np.finfo(np.float64).eps)


@dataclass(frozen=True)
class Index:
    """Pivots with their extra coordinate, the borders of their rings, and the largest square; of bounded size."""

    width: int
    pivots: np.ndarray
    borders: list[np.ndarray]
    largest: float

    @property
    def slack(self) -> float:
        """What rounding may take from a distance."""
        return (64 * EPS * (self.width + 1) * max(self.largest, 1.0)) ** 0.5

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(0.0, self.largest - (x * x).sum(axis=1))
        return np.concatenate([x, np.sqrt(rest)[:, None]], axis=1)

    def asked(self, q: np.ndarray) -> np.ndarray:
        """Distances of queries to the pivots."""
        return distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), self.pivots)

    def reachable(self, squares: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Largest product that a vector at distance ``least`` or more may have with queries of these squares."""
        away = np.maximum(0.0, least - self.slack)
        return (squares + self.largest - away * away) / 2 + 1e-9 * self.largest + 1


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T))


def fit_index(sample: np.ndarray, n: int, largest: float, block: int, seed: int = 11) -> Index:
    """Pivots are means of the sample's clusters; rings hold about ``block`` of the ``n`` vectors each."""
    width = sample.shape[1]
    empty = Index(width, np.zeros((0, width + 1)), [], largest)
    x = empty.lifted(sample)
    k = max(1, min(PIVOTS, n // (2 * block), len(x) // 8 or 1))
    pivots = x[np.random.default_rng(seed).choice(len(x), size=k, replace=False)].copy()
    for _ in range(6):
        near = distances(x, pivots).argmin(axis=1)
        for i in np.unique(near):
            pivots[i] = x[near == i].mean(axis=0)
    d = distances(x, pivots)
    near = d.argmin(axis=1)
    borders = []
    for i in range(k):
        own = d[near == i, i]
        rings = max(1, min(RINGS, round(len(own) / len(x) * n / block)))
        borders.append(np.quantile(own, np.arange(1, rings) / rings) if len(own) else np.zeros(0))
    return Index(width, pivots, borders, largest)


def usable(vec: Column) -> Column:
    """No null, no null or non-finite entry, and a square that fits 64 bits with all its products."""
    finite = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    square = F.aggregate(vec, F.lit(0.0), lambda s, c: s + F.pow(c.cast("double") * SCALE, 2))
    return F.coalesce(vec.isNotNull() & finite & (square < float(1 << 62)), F.lit(False))


def whole(vec: Column) -> Column:
    return F.transform(vec, lambda c: F.floor(c.cast("double") * SCALE))


def numbers(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


PLACED = "row long, id long, width int, pivot int, ring int, distance double, x array<long>"


def placed_by(index: Index):
    """Puts vectors into annuli; those of an uncommon length share one, which all queries of their length read."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy()
            pivot, ring, away = np.full(len(widths), -1, np.int32), np.zeros(len(widths), np.int32), np.zeros(len(widths))
            at = np.flatnonzero(widths == index.width)
            for start in range(0, len(at), 4096):
                here = at[start : start + 4096]
                d = distances(index.lifted(numbers(batch.column("x").take(pa.array(here)), index.width).astype(np.float64)), index.pivots)
                pivot[here] = d.argmin(axis=1)
                away[here] = d.min(axis=1)
            for i, cuts in enumerate(index.borders):
                own = pivot == i
                ring[own] = np.searchsorted(cuts, away[own], "right")
            columns = [batch.column("row"), batch.column("id"), batch.column("width"), pa.array(pivot), pa.array(ring), pa.array(away), batch.column("x")]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "width", "pivot", "ring", "distance", "x"])

    return place


BLOCKS = "width int, pivot int, ring int, low double, high double, rows binary, ids binary, x binary"


def pack(group: pa.Table) -> pa.Table:
    """One row for a block: its vectors in the order of their ids, so that ties fall to the smaller one."""
    rows = group.column("row").to_numpy()
    ids = group.column("id").combine_chunks().fill_null(NO_ID).to_numpy()
    order = np.lexsort((rows, ids))
    width = group.column("width")[0].as_py()
    x = numbers(group.column("x").combine_chunks(), width)[order]
    d = group.column("distance").to_numpy()
    keep = [group.column(c).slice(0, 1) for c in ("width", "pivot", "ring")]
    return pa.table([*keep, *[pa.array([v]) for v in (d.min(), d.max(), rows[order].tobytes(), ids[order].tobytes(), x.tobytes())]], names=[c.split()[0] for c in BLOCKS.split(", ")])


@dataclass
class Wave:
    """Queries sent out together: their rows, vectors by length, radii of the rounds and k-th best products so far."""

    rows: np.ndarray
    widths: np.ndarray
    x: list[np.ndarray]
    radii: np.ndarray
    cut: np.ndarray


def radii_by(index: Index, rings: np.ndarray):
    """Adds to each query how far the annuli of each round reach; ``rings`` has pivot, low and high of every annulus."""
    pivot, low, high = rings[:, 0].astype(int), rings[:, 1], rings[:, 2]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy()
            out = np.full((len(widths), len(RANKS)), np.inf)
            at = np.flatnonzero(widths == index.width) if len(rings) else np.zeros(0, int)
            for start in range(0, len(at), 256):
                here = at[start : start + 256]
                away = index.asked(numbers(batch.column("x").take(pa.array(here)), index.width).astype(np.float64))[:, pivot]
                least = np.sort(np.maximum(0.0, np.maximum(away - high, low - away)), axis=1)
                for j, rank in enumerate(RANKS):
                    if rank < len(rings):
                        out[here, j] = least[:, rank - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(out), pa.list_(pa.float64()))], names=[*batch.schema.names, "radii"])

    return add


FOUND = "query long, score long, id long, row long"


def best(scores: np.ndarray, cut: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, vector) of the k largest of each row that reach its cut; of equal ones the first."""
    hit = scores >= cut[:, None]
    many = np.flatnonzero(hit.sum(axis=1) > k)
    if len(many):
        some = scores[many]
        hit[many] &= some >= np.partition(some, some.shape[1] - k, axis=1)[:, [some.shape[1] - k]]
    q, c = np.nonzero(hit)
    order = np.lexsort((c, -scores[q, c], q))
    q, c = q[order], c[order]
    return q[(keep := first_of(q, k))], c[keep]


def first_of(sorted_keys: np.ndarray, k: int) -> np.ndarray:
    """Mask of the first k of each run of equal keys."""
    new = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])[: len(sorted_keys)]
    starts = np.flatnonzero(new)
    return np.arange(len(sorted_keys)) - np.repeat(starts, np.diff(np.append(starts, len(sorted_keys)))) < k


def scored_by(index: Index, wave: Wave, stage: int, k: int):
    """Multiplies each block with the queries that reach it in this round; gives a task's k best per query."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lots = {}
        for width in np.unique(wave.widths):
            at = np.flatnonzero(wave.widths == width)
            x = np.stack([wave.x[i] for i in at])
            real = x.astype(np.float64)
            lots[int(width)] = (at, x, real, (real * real).sum(axis=1), index.asked(real) if width == index.width else None)
        cut = wave.cut.copy()
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def trimmed() -> tuple[np.ndarray, ...]:
            q, s, i, r = (np.concatenate(v) for v in zip(*held))
            order = np.lexsort((r, i, -s, q))
            order = order[first_of(q[order], k)]
            q, s, i, r = q[order], s[order], i[order], r[order]
            full = np.flatnonzero(np.bincount(q, minlength=len(cut)) >= k)
            kth = np.full(len(cut), np.iinfo(np.int64).max)
            np.minimum.at(kth, q, s)
            cut[full] = np.maximum(cut[full], kth[full])
            return q, s, i, r

        for batch in batches:
            for block in batch.to_pylist():
                at, x, real, squares, away = lots.get(block["width"], (None,) * 5)
                if at is None:
                    continue
                wanted = np.ones(len(at), bool) if stage == 0 else np.zeros(len(at), bool)
                if block["pivot"] >= 0:
                    d = away[:, block["pivot"]]
                    least = np.maximum(0.0, np.maximum(d - block["high"], block["low"] - d))
                    wanted = index.reachable(squares, least) >= cut[at]
                    if stage < len(RANKS):
                        wanted &= least <= wave.radii[at, stage]
                    if stage:
                        wanted &= least > wave.radii[at, stage - 1]
                rows, ids = np.frombuffer(block["rows"], np.int64), np.frombuffer(block["ids"], np.int64)
                y = np.frombuffer(block["x"], np.int64).reshape(len(rows), -1)
                real_y, by_row = y.astype(np.float64), np.argsort(rows)
                # Products of doubles are exact while squares stay below 2^53.
                exact = max(float(squares.max(initial=0)), float((real_y * real_y).sum(axis=1).max(initial=0))) < 2**52
                who = np.flatnonzero(wanted)
                for start in range(0, len(who), 512):
                    some = who[start : start + 512]
                    scores = (real[some] @ real_y.T).astype(np.int64) if exact else x[some] @ y.T
                    own = by_row[np.minimum(np.searchsorted(rows[by_row], wave.rows[at[some]]), len(rows) - 1)]
                    self_at = np.flatnonzero(rows[own] == wave.rows[at[some]])
                    scores[self_at, own[self_at]] = NEVER
                    q, c = best(scores, np.maximum(cut[at[some]], NEVER + 1), min(k, len(rows)))
                    held.append((at[some][q], scores[q, c], ids[c], rows[c]))
                    size += len(q)
                if size > 4 * k * len(cut) + 100_000:
                    held[:] = [trimmed()]
                    size = len(held[0][0])
        if held:
            q, s, i, r = trimmed()
            for start in range(0, len(q), 50_000):
                part = slice(start, start + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(v[part], pa.int64()) for v in (wave.rows[q], s, i, r)], names=["query", "score", "id", "row"])

    return score


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; tasks keep k of each before anything moves."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_wave(blocks: DataFrame, index: Index, wave: Wave, k: int) -> DataFrame:
    """The k best of each query of a wave: rounds of farther annuli until no bound reaches what is known."""
    spark = blocks.sparkSession
    squares = np.array([float((x.astype(np.float64) ** 2).sum()) for x in wave.x])
    top = None
    for stage in range(len(RANKS) + 1):
        if stage and not (index.reachable(squares, wave.radii[:, stage - 1]) >= wave.cut).any():
            break  # what lies beyond the last radius cannot be among the best of any query
        sent = spark.sparkContext.broadcast((index, wave))
        found = blocks.mapInArrow(lambda b, sent=sent, stage=stage: scored_by(*sent.value, stage, k)(b), FOUND)
        top = saved(ranked(found if top is None else found.unionByName(top.drop("rank")), k), "nearest-top")
        # One number per query of a wave.
        kth = top.where(F.col("rank") == k).select("query", "score").toArrow()
        at = np.searchsorted(wave.rows, kth.column("query").to_numpy())
        cut = wave.cut.copy()
        cut[at] = np.maximum(cut[at], kth.column("score").to_numpy())
        wave = Wave(wave.rows, wave.widths, wave.x, wave.radii, cut)
    return top


def top_products(
    df: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, block: int = BLOCK, wave: int = WAVE
) -> DataFrame:
    """For each row for which ``queries`` holds: query_id, rank from 1, vec_id and score of its k best partners.

    Entries become floor(1024 * x) and the score is the product of these whole numbers. Partners are all
    other rows, repeated ones too, of the same length; equal scores rank by id (null last). Rows whose vector is null or
    empty, holds null or non-finite entries, or is so long that a product might not fit 64 bits take no
    part. With fewer partners than k, all are returned; an empty table gives no rows. Null ids are partners
    but should not be queries. Other columns are ignored. 2^63 - 1 is taken for null.
    """
    spark = df.sparkSession
    taken = df.where(usable(F.col(vec_col)) & (F.size(vec_col) > 0)).select(
        F.col(id_col).cast("long").alias("id"), whole(F.col(vec_col)).alias("x"), F.coalesce(queries, F.lit(False)).alias("asks")
    )
    square = F.aggregate("x", F.lit(0.0), lambda s, c: s + F.pow(c.cast("double"), 2))
    rows = saved(taken.withColumns({"row": F.monotonically_increasing_id(), "width": F.size("x"), "square": square}), "nearest-rows")
    told = rows.groupBy("width").agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("largest")).orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    if not told:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, n, largest = told[0]["width"], told[0]["n"], told[0]["largest"]
    sample = rows.where(F.col("width") == width).orderBy(F.xxhash64("row")).limit(SAMPLE).select("x").toArrow()
    index = fit_index(numbers(sample.column("x").combine_chunks(), width).astype(np.float64), n, largest, block)
    known = spark.sparkContext.broadcast(index)
    placed = saved(rows.select("row", "id", "width", "x").mapInArrow(lambda b: placed_by(known.value)(b), PLACED), "nearest-placed")
    annulus = ["width", "pivot", "ring"]
    # An annulus of the common length is one of PIVOTS * RINGS.
    sizes = saved(placed.groupBy(*annulus).agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"), F.min("distance").alias("low"), F.max("distance").alias("high")), "nearest-rings")
    dealt = placed.join(sizes.select(*annulus, "blocks"), annulus).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))
    blocks = saved(dealt.groupBy(*annulus, "block").applyInArrow(lambda g: pack(g.drop_columns(["blocks", "block"])), BLOCKS), "nearest-blocks")
    rings = np.array([tuple(r) for r in sizes.where("pivot >= 0").select("pivot", "low", "high").collect()], np.float64).reshape(-1, 3)
    seen = spark.sparkContext.broadcast(rings)
    asking = rows.where("asks").select("row", "id", "width", "x")
    kinds = "row long, id long, width int, x array<long>, radii array<double>"
    asking = saved(asking.mapInArrow(lambda b: radii_by(known.value, seen.value)(b), kinds), "nearest-queries")
    out = []
    waves = -(-asking.count() * 5 // (wave * 4))  # a hash fills them evenly; a fifth is room for what it does not
    for i in range(waves):
        table = asking.where(F.pmod(F.xxhash64("row"), F.lit(waves)) == i).orderBy("row").toArrow()
        if not table.num_rows:
            continue
        vectors = table.column("x").combine_chunks()
        some = Wave(
            table.column("row").to_numpy(), table.column("width").to_numpy(), np.split(vectors.flatten().to_numpy(), np.cumsum(table.column("width").to_numpy())[:-1]),
            numbers(table.column("radii").combine_chunks(), len(RANKS)), np.full(table.num_rows, NEVER),
        )
        out.append(search_wave(blocks, index, some, k))
    if not out:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    names = asking.select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    return reduce(DataFrame.unionByName, out).join(names, "query").select("query_id", "rank", F.nullif("id", F.lit(NO_ID)).alias("vec_id"), "score")
