"""Whitening of vectors: spectrum slicing of the covariance matrix.

The matrix V is found in two passes over the data as sums over partitions. Its leading eigenpairs are cut
out of the spectrum one by one:

1. *Counts*: the factors L D Lᵀ of V - s I have as many positive numbers in D as V has eigenvalues over s
   (Sylvester's law of inertia). Bisection on s ends with an interval that holds the k-th eigenvalue alone.
2. *Iteration*: inverse iteration at the middle of the interval, then Rayleigh quotient iteration, whose
   error is cubed in each step. A quotient that leaves the interval is thrown away and the interval halved.
3. *Certificate*: counts a little below and above the quotient must be k and k - 1.

Eigenvalues closer together than rounding lets counts tell apart are one cluster, whose vectors are found
together, orthogonal to each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.tables import saved

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
LARGEST = float(1 << 40)  # of |SCALE * entry|: beyond that sums might not fit whole numbers
EPS = float(np.finfo(np.float64).eps)
BUNCH = (1 + 17**0.5) / 8  # the pivot bound that keeps growth least
ROWS = 4096  # vectors multiplied at a time
SALTS = 64  # partial sums of a row of the matrix that are added up apart first


def inertia(a: np.ndarray) -> int:
    """Number of positive eigenvalues of a symmetric matrix, by L D Lᵀ with Bunch and Kaufman's pivots of one or two rows."""
    a = np.array(a, np.float64)
    n, at, positive = len(a), 0, 0

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while at < n:
        size = 1
        below = np.abs(a[at + 1 :, at])
        if len(below) and below.max() > 0:
            r = at + 1 + int(np.argmax(below))
            most, own = below.max(), abs(a[at, at])
            if own < BUNCH * most:
                row = np.abs(a[at:, r])
                row[r - at] = 0
                if own * row.max() < BUNCH * most * most:
                    if abs(a[r, r]) >= BUNCH * row.max():
                        swap(at, r)
                    else:
                        swap(at + 1, r)
                        size = 2
        if size == 1:
            pivot = a[at, at]
            positive += pivot > 0
            if pivot != 0:
                column = a[at + 1 :, at].copy()
                a[at + 1 :, at + 1 :] -= np.outer(column / pivot, column)
        else:  # such a pair has one positive and one negative eigenvalue
            positive += 1
            columns = a[at + 2 :, at : at + 2].copy()
            a[at + 2 :, at + 2 :] -= columns @ np.linalg.solve(a[at : at + 2, at : at + 2], columns.T)
        at += size
    return int(positive)


@dataclass(frozen=True)
class Spectrum:
    """Leading eigenvalues, falling, and their unit vectors as rows."""

    values: np.ndarray
    vectors: np.ndarray


def against(x: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """``x`` without what it shares with vectors found before, at length 1; twice, as once leaves rounding behind."""
    for _ in range(2):
        for v in found:
            x = x - (v @ x) * v
        size = np.linalg.norm(x)
        x = x / size if size > 0 else x
    return x


def solved(v: np.ndarray, shift: float, x: np.ndarray, tiny: float) -> np.ndarray:
    """Direction of (V - shift I)^-1 x."""
    try:
        y = np.linalg.solve(v - shift * np.eye(len(v)), x)
    except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
        y = np.linalg.solve(v - (shift + tiny) * np.eye(len(v)), x)
    return y / np.abs(y).max()


def refine(v: np.ndarray, x: np.ndarray, low: float, high: float, near: list[np.ndarray], tiny: float) -> tuple[float, np.ndarray] | None:
    """Inverse iteration at the middle, then Rayleigh quotient iteration; None if it leaves the interval."""
    for _ in range(3):
        x = against(solved(v, (low + high) / 2, x, tiny), near)
    best = None
    for _ in range(12):
        rho = float(x @ (v @ x))
        if not low <= rho <= high:
            return None
        left = np.linalg.norm(v @ x - rho * x)
        if best is not None and left >= best[0] / 2:
            break
        best = (left, rho, x) if best is None or left < best[0] else best
        x = against(solved(v, rho, x, tiny), near)
    left, rho, x = best
    return (rho, x) if left <= 64 * tiny else None


def leading(v: np.ndarray, most: int = COMPONENTS) -> Spectrum:
    """Up to ``most`` leading eigenpairs of a covariance matrix; eigenvalues that rounding cannot tell from zero are left out."""
    d = len(v)
    scale = float(np.abs(v).sum(axis=1).max()) if d else 0.0  # no eigenvalue is larger
    if not scale > 0:
        return Spectrum(np.zeros(0), np.zeros((0, d)))
    tiny = 4 * EPS * scale
    seen: dict[float, int] = {}

    def above(s: float) -> int:
        if s not in seen:
            seen[s] = inertia(v - s * np.eye(d))
        return seen[s]

    floor = d * 8 * EPS * scale
    k, total = 0, min(most, above(floor))
    values: list[float] = []
    vectors: list[np.ndarray] = []
    rng = np.random.default_rng(0)
    while k < total:
        low = max((s for s, c in seen.items() if c > k), default=floor)
        high = min((s for s, c in seen.items() if c <= k and s > low), default=scale * (1 + 4 * EPS) + tiny)
        # Eigenvalues k + 1 to above(low), counted from the largest, lie in (low, high].
        while True:
            if above(low) == k + 1:
                pair = refine(v, against(rng.standard_normal(d), vectors), low, high, close(values, vectors, low, scale), tiny)
                if pair and above(pair[0] - 256 * tiny) >= k + 1 and above(pair[0] + 256 * tiny) <= k:
                    values.append(pair[0])
                    vectors.append(against(pair[1], close(values, vectors, low, scale)))
                    k += 1
                    break
            if high - low <= 64 * tiny:
                # A cluster: as many orthogonal vectors as were counted.
                for _ in range(min(above(low), total) - k):
                    x = against(rng.standard_normal(d), vectors)
                    for _ in range(6):
                        x = against(solved(v, (low + high) / 2, x, tiny), vectors)
                    values.append(float(x @ (v @ x)))
                    vectors.append(x)
                    k += 1
                break
            middle = (low + high) / 2
            if above(middle) > k:
                low = middle
            else:
                high = middle
    order = np.argsort(-np.array(values), kind="stable")
    return Spectrum(np.array(values)[order], np.array(vectors).reshape(-1, d)[order])


def close(values: list[float], vectors: list[np.ndarray], low: float, scale: float) -> list[np.ndarray]:
    """Vectors of eigenvalues so near that an iteration might fall back to them."""
    return [x for e, x in zip(values, vectors) if e - low <= 1e-3 * scale]


def usable(vec: Column) -> Column:
    """Vectors without null or non-finite entries, and without entries too large for whole sums."""
    return F.coalesce(vec.isNotNull() & F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * SCALE) < LARGEST)), F.lit(False))


def whole(vec: Column) -> Column:
    """Entries as whole numbers; null for those that are no use, as Spark may look at this before rows are left out."""
    scaled = lambda c: c.cast("double") * SCALE
    return F.transform(vec, lambda c: F.when(F.abs(scaled(c)) < LARGEST, F.floor(scaled(c)) + OFFSET))


def numbers(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, numbers(part.column("x"), width)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n without the loss of subtracting large numbers: the difference is taken among whole numbers."""
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.float64) / n
    return (x - base) - rest


def totals(df: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and the sum of each entry, exactly: tasks add whole numbers, Spark adds the tasks' sums."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * width
        for _, x in blocks(batches, width):
            n += len(x)
            sums = [s + int(v) for s, v in zip(sums, x.sum(axis=0))]  # of ROWS numbers below 2^41
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array([Decimal(v) for v in (n, *sums)], pa.decimal128(28, 0))], names=["i", "s"])

    told = {r["i"]: int(r["s"]) for r in df.select("x").mapInArrow(partial, "i int, s decimal(28,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    return told.get(-1, 0), [told.get(i, 0) for i in range(width)]


def squares(df: DataFrame, n: int, sums: list[int], project: np.ndarray | None = None) -> np.ndarray:
    """Sum over the rows of the products of all pairs of centred entries, or of those of their projections; /n is the covariance.

    Each task adds up its own; rows of these sums are added in two steps, so no task meets those of all others whole.
    """
    width = len(sums)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seed = None, 0
        for _, x in blocks(batches, width):
            y = centred(x, n, sums)
            y = y if project is None else y @ project.T
            total = y.T @ y if total is None else total + y.T @ y
            seed = seed * 31 + int(x[0].sum()) & 0xFFFFFF
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array([seed % SALTS] * len(total), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
                names=["i", "salt", "v"],
            )

    def added(group: pa.Table) -> pa.Table:
        # Sorted, so that the same partial sums give the same total in whatever order they come.
        v = np.sort(np.stack([np.asarray(r.as_py()) for r in group.column("v")]), axis=0).sum(axis=0)
        return pa.table({"i": group.column("i").slice(0, 1), "salt": group.column("salt").slice(0, 1), "v": pa.array([v], pa.list_(pa.float64()))})

    kind = "i int, salt int, v array<double>"
    rows = df.select("x").mapInArrow(partial, kind).groupBy("i", "salt").applyInArrow(added, kind).groupBy("i").applyInArrow(added, kind).collect()
    out = np.zeros((len(rows), len(rows)))
    for r in rows:
        out[r["i"]] = r["v"]
    return (out + out.T) / 2


@dataclass(frozen=True)
class Whitening:
    """What the fit found: everything that is needed to whiten a row. Its size depends on the vectors' length alone."""

    n: int
    sums: list[int]
    spectrum: Spectrum
    trace: float
    identity_error: float

    @property
    def projection(self) -> np.ndarray:
        return self.spectrum.vectors / np.sqrt(self.spectrum.values)[:, None]


def fit(rows: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """Fits on the distinct vectors ``x`` of ``rows``, all of length ``width``."""
    distinct = saved(rows.select("x").distinct(), "whitening-fit")
    n, sums = totals(distinct, width)
    v = squares(distinct, n, sums) / n if n else np.zeros((width, width))
    spectrum = leading(v, components)
    found = Whitening(n, sums, spectrum, float(np.trace(v)), 0.0)
    if not len(spectrum.values):
        return found
    around = squares(distinct, n, sums, found.projection) / n
    return Whitening(n, sums, spectrum, found.trace, float(np.abs(around - np.eye(len(around))).max()))


OUT = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over entries of (n * x - S)^2, exactly; null where it does not fit 64 bits."""
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    away = x - base  # n * x - S = n * away - rest
    if len(sums) * (float(np.abs(away).max(initial=0)) + 1) ** 2 * float(n) ** 2 < 2**63:
        return (((away * n - rest) ** 2).sum(axis=1)).tolist()
    exact = ((away.astype(object) * n - rest.astype(object)) ** 2).sum(axis=1)
    return [int(v) if v < 2**63 else None for v in exact]


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per remaining row and component: id, component, n, deviation, whitened, explained, identity_error.

    Entries become whole numbers floor(64 * c) + 1000000; the fit counts each distinct vector once. Rows whose
    vector is null or empty, or holds null or non-finite entries (or some of 2^34 and more), take no part; nor do those
    whose length is not the most common one (the longest of several). Components with an eigenvalue of zero are left out, so one distinct
    vector alone, like an empty table, gives no rows. ``deviation`` is null where it does not fit 64 bits. Rows that repeat, and null ids, stay. Other columns are
    ignored.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(usable(F.col("vec")))
    rows = rows.select("id", whole(F.col("vec")).alias("x")).where(F.size("x") > 0)
    lengths = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    width = lengths[0]["width"] if lengths else 1
    rows = rows.where(F.size("x") == width)
    found = fit(rows, width, components)
    model = df.sparkSession.sparkContext.broadcast(found)  # some times the vectors' length

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        k = len(m.spectrum.values)
        share = m.spectrum.values / m.trace if k else np.zeros(0)
        for part, x in blocks(batches, width):
            size = part.num_rows
            white = centred(x, m.n, m.sums) @ m.projection.T
            who = np.repeat(np.arange(size), k)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id").take(pa.array(who)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)), pa.array(np.full(size * k, m.n, np.int64)),
                    pa.array(deviations(x, m.n, m.sums), pa.int64()).take(pa.array(who)), pa.array(white.ravel()), pa.array(np.tile(share, size)),
                    pa.array(np.full(size * k, m.identity_error)),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(apply, OUT).withColumnRenamed("id", id_col)
