"""Multilayer perceptrons by one job an evaluation: MLlib's network, loss and optimizer, over cached blocks of rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_ROWS = 65_536
STEP_ROWS = 1_024  # rows whose activations are held at once
MEMORY = 10  # corrections that L-BFGS keeps, as MLlib has it
PRECISIONS = (np.float32, np.float64)  # of single rows; what is added up has 64 bits, and so has all once a search fails


@dataclass
class Block:
    """Some rows: values by row, classes, and what a row counts for: MLlib takes the mean of means of ``blockSize`` rows."""

    values: np.ndarray
    label: np.ndarray
    share: np.ndarray
    groups: int


def perceptron(rows: DataFrame, settings: MultilayerPerceptronClassifier) -> MultilayerPerceptronClassificationModel:
    """What ``settings.fit(rows)`` finds, up to rounding, in fewer steps per row.

    Start, loss, gradient, search and tests of convergence are MLlib's (which takes the optimizer from Breeze), and so is the
    model. Rows become blocks of numbers that stay cached; in each evaluation a task adds up the gradient
    over the blocks of its partitions and returns one, whose size follows the network. Activations of a row have 32 bits as long as
    the search finds its way, 64 afterwards. Labels must be whole numbers below the last layer's size.
    """
    get = lambda name: settings.getOrDefault(name)
    if get("solver") != "l-bfgs" or settings.isSet("initialWeights"):
        return settings.fit(rows)
    spark, layers = rows.sparkSession, [int(x) for x in get("layers")]
    columns = rows.select(vector_to_array(get("featuresCol")).alias("features"), F.col(get("labelCol")).cast("double").alias("label"))
    blocks = blocks_of(columns, layers, get("blockSize")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        objective = Objective(blocks, layers)
        weights = minimum(objective, start(spark, layers, get("seed")), get("maxIter"), get("tol"))
    finally:
        blocks.unpersist()
    model = MultilayerPerceptronClassificationModel(
        spark._jvm.org.apache.spark.ml.classification.MultilayerPerceptronClassificationModel(settings.uid, vector(spark, weights))
    )
    model = settings._copyValues(model)
    model._transfer_params_to_java()  # the network's size is read from them
    return model


def vector(spark: SparkSession, values: np.ndarray):
    jvm = spark._jvm
    out = spark.sparkContext._gateway.new_array(jvm.double, len(values))
    jvm.java.nio.ByteBuffer.wrap(np.array(values, ">f8").tobytes()).asDoubleBuffer().get(out)
    return jvm.org.apache.spark.ml.linalg.DenseVector(out)


def start(spark: SparkSession, layers: list[int], seed: int) -> np.ndarray:
    """The weights that MLlib draws first."""
    sizes = spark.sparkContext._gateway.new_array(spark._jvm.int, len(layers))
    for i, n in enumerate(layers):
        sizes[i] = n
    network = spark._jvm.org.apache.spark.ml.ann.FeedForwardTopology.multiLayerPerceptron(sizes, True)
    return np.array(list(network.model(int(seed)).weights().toArray()))


def blocks_of(rows: DataFrame, layers: list[int], group: int) -> RDD:
    def plain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [batch.column(0).flatten().to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["values", "label"])

    def block(values: np.ndarray, label: np.ndarray) -> Block:
        if not np.isin(label, np.arange(layers[-1])).all():
            raise ValueError(f"labels must be whole numbers from 0 to {layers[-1] - 1}")
        share, rest = np.ones(len(label)), len(label) % group
        if rest:
            share[-rest:] = group / rest
        return Block(values, label.astype(np.intp), share / group, -(-len(label) // group))

    def blocks(parts: Iterable) -> Iterator[Block]:
        size = max(1, BLOCK_ROWS // group) * group
        values, label = np.empty((0, layers[0])), np.empty(0)
        for row in parts:
            values = np.concatenate([values, np.frombuffer(row.values).reshape(-1, layers[0])])
            label = np.concatenate([label, np.frombuffer(row.label)])
            while len(label) >= size:
                yield block(values[:size].copy(), label[:size])
                values, label = values[size:], label[size:]
        if len(label):
            yield block(values.copy(), label)

    return rows.mapInArrow(plain, "values binary, label binary").rdd.mapPartitions(blocks)


class Objective:
    """Mean loss and its gradient at some weights, as MLlib has them: the mean of each group of rows counts alike."""

    def __init__(self, blocks: RDD, layers: list[int]):
        # One gradient per core: what reaches the driver does not follow the number of partitions.
        self.blocks, self.layers, self.kind = blocks.coalesce(blocks.context.defaultParallelism), layers, 0
        self.last: tuple | None = None

    def __call__(self, weights: np.ndarray) -> tuple[float, np.ndarray]:
        if self.last is None or not np.array_equal(self.last[0], weights):
            found = [x for x in self.blocks.mapPartitions(summed(weights, self.layers, PRECISIONS[self.kind])).collect() if x[2]]
            groups = sum(x[2] for x in found)
            if not groups:
                raise ValueError("a perceptron needs labelled rows")
            self.last = weights.copy(), sum(x[0] for x in found) / groups, sum(x[1] for x in found) / groups
        return self.last[1:]

    def refine(self) -> bool:
        """Goes on with more bits; whether there are any."""
        if self.kind + 1 == len(PRECISIONS):
            return False
        self.last, self.kind = None, self.kind + 1
        return True


def matrices(weights: np.ndarray, layers: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each layer's matrix, inputs by outputs, and its offsets; views of ``weights``."""
    at = 0
    for n, m in zip(layers, layers[1:]):
        yield weights[at : at + n * m].reshape(n, m), weights[at + n * m : at + n * m + m]
        at += n * m + m


def summed(weights: np.ndarray, layers: list[int], kind: type) -> Callable[[Iterable[Block]], Iterator[tuple[float, np.ndarray, int]]]:
    def step(known: list, sums: list, values: np.ndarray, label: np.ndarray, share: np.ndarray) -> float:
        held = [values.astype(kind)]
        for matrix, offset in known[:-1]:
            x = held[-1] @ matrix
            x += offset
            np.negative(x, out=x)
            np.exp(x, out=x)
            x += 1
            held.append(np.reciprocal(x, out=x))
        x = held[-1] @ known[-1][0] + known[-1][1]
        x -= x.max(axis=1, keepdims=True)
        delta = np.exp(x)
        total = delta.sum(axis=1, keepdims=True)
        at = np.arange(len(label)), label
        loss = share @ (np.log(total[:, 0]) - x[at]).astype(np.float64)
        delta /= total
        delta[at] -= 1
        delta *= share.astype(kind)[:, None]
        for k in reversed(range(len(known))):
            sums[k][0][...] += held[k].T @ delta
            sums[k][1][...] += delta.sum(axis=0)
            if k:
                delta = delta @ known[k][0].T
                delta *= held[k]
                np.subtract(1, held[k], out=held[k])
                delta *= held[k]
        return float(loss)

    def add(blocks: Iterable[Block]) -> Iterator[tuple[float, np.ndarray, int]]:
        known = [(m.astype(kind), b.astype(kind)) for m, b in matrices(weights, layers)]
        gradient = np.zeros(len(weights))
        sums, loss, groups = list(matrices(gradient, layers)), 0.0, 0
        with np.errstate(over="ignore"):  # the exponential of a far input: its activation is 0
            for block in blocks:
                for i in range(0, len(block.label), STEP_ROWS):
                    part = slice(i, i + STEP_ROWS)
                    loss += step(known, sums, block.values[part], block.label[part], block.share[part])
                groups += block.groups
        yield loss, gradient, groups

    return add


class SearchFailed(Exception):
    pass


def minimum(objective: Objective, x: np.ndarray, max_iter: int, tolerance: float) -> np.ndarray:
    """L-BFGS as MLlib runs it: a failed search is tried once more without memory, then ends the descent."""
    value, gradient = objective(x)
    first, values, memory, iteration, failed = value, [math.inf], [], 0, False
    while iteration < max_iter:
        if len(values) >= 2 and abs(value - max(values)) <= tolerance * first or np.linalg.norm(gradient) <= max(tolerance * abs(value), 1e-8):
            break
        try:
            direction = descent(gradient, memory)
            length = step_length(objective, x, direction, 1 / np.linalg.norm(direction) if iteration == 0 else 1.0)
            if length * np.linalg.norm(gradient) < 1e-10:
                raise SearchFailed
            new = x + direction * length
            new_value, new_gradient = objective(new)
        except SearchFailed:
            if objective.refine():
                value, gradient = objective(x)
                continue
            if failed:
                break
            failed, memory = True, []
            continue
        memory = [(new - x, new_gradient - gradient), *memory][:MEMORY]
        x, value, gradient = new, new_value, new_gradient
        values, iteration, failed = [*values, value][-20:], iteration + 1, False
    return x


def descent(gradient: np.ndarray, memory: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The gradient through the inverse of the curvature that the last steps met, the newest first."""
    out, told, scale = gradient.copy(), [], 1.0
    if memory:
        step, change = memory[0]
        scale = (step @ change) / (change @ change)
        if not scale >= 0:
            raise SearchFailed
    for step, change in memory:
        told.append((step @ out) / (step @ change))
        out -= told[-1] * change
    if not np.isfinite(out).all():
        raise SearchFailed
    out *= scale
    for (step, change), a in zip(reversed(memory), reversed(told)):
        out += step * (a - (change @ out) / (step @ change))
    return -out


def step_length(objective: Objective, x: np.ndarray, direction: np.ndarray, t: float, tries: int = 10) -> float:
    """A step along the direction that meets the strong Wolfe conditions."""
    def at(t: float) -> tuple[float, float, float]:
        value, gradient = objective(x + direction * t)
        return t, float(gradient @ direction), value

    def between(left: tuple, right: tuple) -> float:
        """Where a cubic through both ends is least, not too near to either."""
        (a, da, fa), (b, db, fb) = left, right
        d1 = da + db - 3 * (fa - fb) / (a - b)
        square = d1 * d1 - da * db
        d2 = math.sqrt(square) if square >= 0 else math.nan
        bottom = db - da + 2 * d2
        s = b - (b - a) * (db + d2 - d1) / bottom if bottom else math.nan
        return a + 0.1 * (b - a) if s < a + 0.1 * (b - a) else a + 0.9 * (b - a) if s > a + 0.9 * (b - a) else s

    low = begin = at(0.0)
    slope, value = begin[1], begin[2]
    if slope > 0:
        raise SearchFailed

    def zoom(low: tuple, high: tuple) -> float:
        for _ in range(tries):
            c = at(between(high, low) if low[0] > high[0] else between(low, high))
            if c[2] > value + 1e-4 * c[0] * slope or c[2] >= low[2]:
                high = c
                continue
            if abs(c[1]) <= 0.9 * abs(slope):
                return c[0]
            if c[1] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        raise SearchFailed

    for i in range(tries):
        c = at(t)
        if not math.isfinite(c[2]):
            t /= 2
            continue
        if c[2] > value + 1e-4 * t * slope or (c[2] >= low[2] and i):
            return zoom(low, c)
        if abs(c[1]) <= 0.9 * abs(slope):
            return c[0]
        if c[1] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise SearchFailed
