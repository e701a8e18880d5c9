"""Boosted trees by one job a level: MLlib's algorithm and model, with sums taken over blocks of rows."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_ROWS = 65_536
SAMPLE_ROWS = 10_000  # rows from which split candidates are taken, as in MLlib
JOINT_BITS = 10  # features whose bins fit together into so many bits are counted together
LINEAGE = 20  # margins are derived anew from the blocks after so many trees, so that no lineage grows with the trees


@dataclass
class Block:
    """Some rows: bins as ``Layout`` packs them, labels -1 or 1, weights, and the margins of the trees so far."""

    key: tuple[int, int]
    codes: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    margin: np.ndarray


class Layout:
    """Where a feature's bin lies: several features with few bins share one code."""

    def __init__(self, thresholds: list[np.ndarray]):
        self.sizes = [len(t) + 1 for t in thresholds]
        self.bits = [len(t).bit_length() for t in thresholds]
        self.code, self.shift = [0] * len(thresholds), [0] * len(thresholds)
        self.widths = [0]
        for f in sorted(range(len(thresholds)), key=self.bits.__getitem__):
            if self.widths[-1] and self.widths[-1] + self.bits[f] > JOINT_BITS:
                self.widths.append(0)
            self.code[f], self.shift[f] = len(self.widths) - 1, self.widths[-1]
            self.widths[-1] += self.bits[f]

    def pack(self, bins: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(self.widths), len(bins[0])), np.min_scalar_type((1 << max(self.widths)) - 1))
        for f, x in enumerate(bins):
            out[self.code[f]] |= (x << self.shift[f]).astype(out.dtype)
        return out

    def unpack(self, tables: list[np.ndarray]) -> np.ndarray:
        """Sums (measure, slot, code) of each code as sums by feature, measure, slot and bin."""
        out = np.zeros((len(self.sizes), *tables[0].shape[:2], max(self.sizes)))
        for f, size in enumerate(self.sizes):
            table = tables[self.code[f]]
            parts = table.reshape(*table.shape[:2], -1, 1 << self.bits[f], 1 << self.shift[f])
            out[f, :, :, :size] = parts.sum(axis=(2, 4))[:, :, :size]
        return out


@dataclass
class Tree:
    """Nodes by number, the root being 0; a leaf is its own child. ``sums`` are weight, sum, sum of squares and rows."""

    feature: list[int] = field(default_factory=lambda: [0])
    split: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    sums: list = field(default_factory=lambda: [None])

    def cut(self, node: int, feature: int, split: int, gain: float, left: np.ndarray, right: np.ndarray) -> tuple[int, int]:
        self.feature[node], self.split[node], self.gain[node] = feature, split, gain
        self.left[node], self.right[node] = new = len(self.left), len(self.left) + 1
        for child, sums in zip(new, (left, right)):
            for column, value in zip((self.feature, self.split, self.left, self.right, self.gain, self.sums), (0, 0, child, child, 0.0, sums)):
                column.append(value)
        return new

    def values(self) -> np.ndarray:
        return np.array([s[1] / s[0] if s[0] else 0.0 for s in self.sums])

    def steps(self, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
        """For each node the code to look at, and the node to go on to for each value of that code."""
        width = max(layout.widths)
        values = np.arange(1 << width)
        to = np.empty((len(self.left), len(values)), np.int32)
        for i, f in enumerate(self.feature):
            right = (values >> layout.shift[f]) & ((1 << layout.bits[f]) - 1) > self.split[i]
            to[i] = np.where(right, self.right[i], self.left[i])
        return np.array([layout.code[f] for f in self.feature], np.intp), to


def nodes(steps: tuple[np.ndarray, np.ndarray], codes: np.ndarray, levels: int) -> np.ndarray:
    """The node of each row after ``levels`` steps from the root."""
    code, to = steps
    rows = codes.shape[1]
    at = np.zeros(rows, np.int32)
    if len(code) == 1:
        return at
    width, start = to.shape[1].bit_length() - 1, code * rows
    flat, to, place = codes.ravel(), to.ravel(), np.arange(rows)
    for level in range(levels):
        seen = flat.take(start.take(at) + place) if level else codes[code[0]]
        at = to.take((at << width) + seen)
    return at


def boosted_trees(rows: DataFrame, settings: GBTClassifier) -> GBTClassificationModel:
    """What ``settings.fit(rows)`` finds, up to the draw of rows and features, in fewer steps per row.

    MLlib visits each row as an object in each of the ``maxIter * maxDepth`` levels. Here rows become blocks of bin
    numbers that stay cached; in each level a task adds up the blocks of its partitions by node, feature and bin, and returns one
    table of sums, whose size follows nodes, features and bins. Split candidates, impurity, gains, leaf
    values, loss and weights are MLlib's, and so is the model. Labels must be 0 or 1.
    """
    get = lambda name: settings.getOrDefault(name)
    spark, cores = rows.sparkSession, rows.sparkSession.sparkContext.defaultParallelism
    columns = rows.select(
        vector_to_array(get("featuresCol")).alias("features"), F.col(get("labelCol")).cast("double").alias("label"), F.col(get("weightCol")).cast("double").alias("weight"),
    )
    n, total = columns.agg(F.count(F.lit(1)), F.sum("weight")).first()
    if not n:
        raise ValueError("boosted trees need labelled rows")
    thresholds = split_candidates(columns, n, get("maxBins"), get("seed"))
    chosen = features_per_node(get("featureSubsetStrategy"), len(thresholds)) if get("maxDepth") else 0  # no depth: roots alone
    draws = np.random.default_rng(get("seed") % 2**63)
    layout = Layout(thresholds)
    base = blocks_of(columns, thresholds, layout).persist(StorageLevel.MEMORY_AND_DISK)
    state, trees, factors, kept = base, [], [], []
    try:
        for m in range(get("maxIter")):
            tree, active = Tree(), [0]
            for depth in range(max(1, get("maxDepth"))):
                # One table per core: what reaches the driver does not follow the number of partitions.
                summed = level_sums(tree, active, depth, layout, get("subsamplingRate"), (get("seed") % 2**63, m))
                sums = sum(state.coalesce(cores).mapPartitions(summed).collect())
                active = grow(tree, active, sums, thresholds, chosen, draws, get("minInstancesPerNode"), get("minWeightFractionPerNode") * total, get("minInfoGain"))
                for old in kept[:-1]:
                    old.unpersist()
                kept = kept[-1:]
                if not active:
                    break
            trees.append(tree)
            factors.append(get("stepSize") if m else 1.0)
            if m + 1 < get("maxIter"):
                fresh = (m + 1) % LINEAGE == 0
                state = (base if fresh else state).mapPartitions(advanced(trees if fresh else trees[-1:], factors if fresh else factors[-1:], layout, get("maxDepth")))
                kept.append(state.persist(StorageLevel.MEMORY_AND_DISK))
    finally:
        for old in (base, *kept):
            old.unpersist()
    return as_model(spark, settings, trees, factors, thresholds)


def split_candidates(rows: DataFrame, n: int, max_bins: int, seed: int) -> list[np.ndarray]:
    """Thresholds per feature: between all values met if they are few, else at even steps of weight."""
    most = max(max_bins * max_bins, SAMPLE_ROWS)
    met = (rows if n <= most else rows.sample(most / n, seed)).select("features", "weight").toArrow()
    if not met.num_rows:
        met = rows.select("features", "weight").limit(most).toArrow()
    values = met["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(met.num_rows, -1)
    weight = met["weight"].to_numpy()
    return [thresholds_of(values[:, f], weight, min(max_bins, n) - 1) for f in range(values.shape[1])]


def thresholds_of(values: np.ndarray, weight: np.ndarray, at_most: int) -> np.ndarray:
    distinct, place = np.unique(values + 0.0, return_inverse=True)
    between = (distinct[:-1] + distinct[1:]) / 2
    if len(between) <= at_most:
        return between
    upto = np.cumsum(np.bincount(place, weight))
    stride = upto[-1] / (at_most + 1)
    out, target = [], stride
    for i, (before, here) in enumerate(zip(upto[:-1], upto[1:])):
        if abs(before - target) < abs(here - target):
            out.append(between[i])
            target += stride
    return np.array(out)


def features_per_node(strategy: str, n: int) -> int:
    if strategy in ("auto", "all"):
        return n
    if strategy in ("sqrt", "log2", "onethird"):
        return {"sqrt": math.ceil(math.sqrt(n)), "log2": max(1, math.ceil(math.log2(n))), "onethird": math.ceil(n / 3)}[strategy]
    return min(n, int(strategy)) if "." not in strategy and int(strategy) > 0 else math.ceil(float(strategy) * n)


def blocks_of(rows: DataFrame, thresholds: list[np.ndarray], layout: Layout) -> RDD:
    kind = layout.pack([np.zeros(0, np.int64)] * len(thresholds)).dtype

    def binned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            codes = layout.pack([np.searchsorted(t, np.ascontiguousarray(values[:, f])) for f, t in enumerate(thresholds)])
            parts = [codes, batch.column(1).to_numpy(), batch.column(2).to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["codes", "label", "weight"])

    def blocks(part: int, parts: Iterable) -> Iterator[Block]:
        held, size, number = [], 0, 0
        for last, row in ends(parts):
            if row is not None:
                held.append((np.frombuffer(row.codes, kind).reshape(len(layout.widths), -1), np.frombuffer(row.label), np.frombuffer(row.weight)))
                size += held[-1][0].shape[1]
            if held and (last or size >= BLOCK_ROWS):
                codes, label, weight = (np.concatenate(x, axis=-1) for x in zip(*held))
                if not np.isin(label, (0, 1)).all():
                    raise ValueError("labels must be 0 or 1")
                yield Block((part, number), codes, (2 * label - 1).astype(np.int8), weight, np.zeros(size))
                held, size, number = [], 0, number + 1

    return rows.mapInArrow(binned, "codes binary, label binary, weight binary").rdd.mapPartitionsWithIndex(blocks)


def ends(items: Iterable) -> Iterator[tuple[bool, object]]:
    """The items, then a mark of the end."""
    for item in items:
        yield False, item
    yield True, None


def advanced(trees: list[Tree], factors: list[float], layout: Layout, levels: int):
    """Adds the trees to the margins of blocks."""
    def add(blocks: Iterable[Block]) -> Iterator[Block]:
        told = [(tree.steps(layout), factor * tree.values()) for tree, factor in zip(trees, factors)]
        for block in blocks:
            margin = block.margin.copy()
            for steps, values in told:
                margin += values.take(nodes(steps, block.codes, levels))
            yield replace(block, margin=margin)

    return add


def level_sums(tree: Tree, active: list[int], depth: int, layout: Layout, rate: float, seed: tuple[int, int]):
    """Sums by feature, measure, active node and bin over the drawn rows of all blocks of a task: weight, target, its square, rows."""
    slots = len(active) + 1  # the last one takes rows that lie in a leaf
    slot = np.full(len(tree.left), len(active), np.intp)
    slot[active] = np.arange(len(active))

    def add(tables: list[np.ndarray], steps: tuple[np.ndarray, np.ndarray], block: Block) -> None:
        codes, label, weight, margin = block.codes, block.label, block.weight, block.margin
        if rate < 1:
            drawn = np.flatnonzero(np.random.default_rng([*seed, *block.key]).random(len(label)) < rate)
            codes, label, weight, margin = codes.take(drawn, axis=1), label.take(drawn), weight.take(drawn), margin.take(drawn)
        # The first tree is fitted to the labels, the others to the falling gradient of the loss.
        target = 4 * label / (1 + np.exp(2 * label * margin)) if seed[1] else label.astype(float)
        at = slot.take(nodes(steps, codes, depth))
        weighted = weight * target
        for table, code, width in zip(tables, codes, layout.widths):
            cell = (at << width) + code
            for sums, x in zip(table, (weight, weighted, weighted * target, None)):
                sums += np.bincount(cell, x, len(sums))

    def sums(blocks: Iterable[Block]) -> Iterator[np.ndarray]:
        tables = [np.zeros((4, slots << width)) for width in layout.widths]
        steps = tree.steps(layout)
        for block in blocks:
            add(tables, steps, block)
        yield layout.unpack([t.reshape(4, slots, -1) for t in tables])[:, :, :-1]

    return sums


def variance(sums: np.ndarray) -> np.ndarray:
    """Weighted variance; the measures are the second axis from the left of ``sums``, or its only one."""
    weight, total, squares = sums[0], sums[1], sums[2]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(weight > 0, (squares - total * total / weight) / weight, 0.0)


def grow(
    tree: Tree, active: list[int], sums: np.ndarray, thresholds: list[np.ndarray], chosen: int, draws: np.random.Generator,
    min_rows: int, min_weight: float, min_gain: float,
) -> list[int]:
    """Cuts the active nodes at their best splits; returns the children that may be cut further."""
    new = []
    for a, node in enumerate(active):
        here = sums[:, :, a]
        whole = here[0].sum(axis=1)
        tree.sums[node] = whole if tree.sums[node] is None else tree.sums[node]
        if whole[0] <= 0:
            continue
        best = None
        features = range(len(thresholds)) if chosen == len(thresholds) else sorted(draws.choice(len(thresholds), chosen, replace=False))
        for f in features:
            if not len(thresholds[f]):
                continue
            left = np.cumsum(here[f], axis=1)[:, : len(thresholds[f])]
            right = whole[:, None] - left
            gain = variance(whole) - left[0] / whole[0] * variance(left) - right[0] / whole[0] * variance(right)
            sound = (left[3] >= max(1, min_rows)) & (right[3] >= max(1, min_rows)) & (left[0] >= min_weight) & (right[0] >= min_weight) & (gain >= min_gain)
            gain = np.where(sound, gain, -np.inf)
            s = int(gain.argmax())
            if gain[s] > 0 and (best is None or gain[s] > best[0]):
                best = (float(gain[s]), int(f), s, left[:, s], right[:, s])
        if best:
            gain, f, s, left, right = best
            children = tree.cut(node, f, s, gain, left, right)
            new += [c for c in children if abs(float(variance(tree.sums[c]))) >= np.finfo(float).eps]
    return new


def as_model(spark: SparkSession, settings: GBTClassifier, trees: list[Tree], factors: list[float], thresholds: list[np.ndarray]) -> GBTClassificationModel:
    """The trees as MLlib's own model, which scores, tells importances and is saved like any other."""
    gateway, jvm = spark.sparkContext._gateway, spark._jvm
    kinds = jvm.org.apache.spark.ml
    told, leaf, inner = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator, kinds.tree.LeafNode, kinds.tree.InternalNode
    cut, grown, part = kinds.tree.ContinuousSplit, kinds.regression.DecisionTreeRegressionModel, jvm.java.util.Arrays.copyOfRange

    def doubles(values):
        out = gateway.new_array(jvm.double, len(values))
        jvm.java.nio.ByteBuffer.wrap(np.array(values, ">f8").tobytes()).asDoubleBuffer().get(out)
        return out

    def node(tree: Tree, values: np.ndarray, sums, i: int):
        value, impurity, stats = float(values[i]), float(variance(tree.sums[i])), told(part(sums, 3 * i, 3 * i + 3), int(tree.sums[i][3]))
        if tree.left[i] == i:
            return leaf(value, impurity, stats)
        split = cut(tree.feature[i], float(thresholds[tree.feature[i]][tree.split[i]]))
        return inner(value, impurity, tree.gain[i], *(node(tree, values, sums, c) for c in (tree.left[i], tree.right[i])), split, stats)

    made = gateway.new_array(grown, len(trees))
    for i, tree in enumerate(trees):
        root = node(tree, tree.values(), doubles(np.array([s[:3] for s in tree.sums]).ravel()), 0)
        made[i] = grown(f"{settings.uid}_{i}", root, len(thresholds))
    model = GBTClassificationModel(kinds.classification.GBTClassificationModel(settings.uid, made, doubles(factors), len(thresholds), 2))
    return settings._copyValues(model)
