"""Boosted trees over blocks beside MLlib's own."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from flowlens.operators import boost as B
from flowlens.operators import models as J


@pytest.fixture(scope="module")
def rows(spark):
    part = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("double")
    plain = spark.range(900).select((part(1, 700) / 7).alias("a"), part(2, 9).alias("b"), (part(3, 2) - 1).alias("c"), F.lit(3.0).alias("d"))
    label = (F.col("a") * F.col("b") + F.col("c") * 90 > 150).cast("int")
    named = plain.withColumn("label", label).withColumn("weight", F.when(F.col("label") == 1, 10.0).otherwise(1.0))
    return named.withColumn("features", array_to_vector(F.array("a", "b", "c", "d"))).repartition(3).cache()


def probabilities(model, df):
    return {tuple(r.features): r.probability[1] for r in model.transform(df).collect()}


@pytest.mark.parametrize("params", [
    {"maxIter": 5, "maxDepth": 4, "stepSize": 0.1}, {"maxIter": 2, "maxDepth": 3, "maxBins": 400}, {"maxIter": 2, "minInstancesPerNode": 40, "minInfoGain": 0.01},
    {"maxIter": 2, "maxDepth": 0},
])
def test_trees_are_those_of_mllib(rows, params, tmp_path, monkeypatch):
    """Without draws of rows or features nothing is left to chance; five trees go past points where margins are derived anew."""
    monkeypatch.setattr(B, "LINEAGE", 2)
    settings = GBTClassifier(weightCol="weight", seed=42, **params)
    want, got = settings.fit(rows), B.boosted_trees(rows, settings)
    assert probabilities(got, rows) == pytest.approx(probabilities(want, rows), abs=1e-9)
    assert got.trees[0].numNodes == want.trees[0].numNodes  # later ones may hold splits whose gain is a rounding error
    assert got.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray(), abs=1e-9)
    assert (got.treeWeights, got.numFeatures, got.getStepSize()) == (want.treeWeights, want.numFeatures, want.getStepSize())
    got.write().save(str(tmp_path / "m"))
    assert probabilities(GBTClassificationModel.load(str(tmp_path / "m")), rows) == probabilities(got, rows)


def test_training_sends_one_table_per_core_and_level(spark, rows, monkeypatch):
    """MLlib's passes, one object a row, were nearly all of the time of the type named xgboost."""
    seen = []

    def collect(self, _collect=B.RDD.collect):
        out = _collect(self)
        seen.append([x.shape for x in out if isinstance(x, np.ndarray)])
        return out

    monkeypatch.setattr(B.RDD, "collect", collect)
    monkeypatch.setattr(GBTClassifier, "fit", None)
    cores = spark.sparkContext.defaultParallelism
    many = rows.select("a", "b", "label").repartition(5 * cores).cache()
    model = J.fit_spread(many, "xgboost", ["a", "b"], maxIter=2, maxDepth=2)
    many.unpersist()
    tables = [shapes for shapes in seen if shapes and len(shapes[0]) == 4]
    assert [len(shapes) for shapes in tables] == [cores] * 4
    assert all(shape[:3] == (2, 4, nodes) for shapes, nodes in zip(tables, (1, 2, 1, 2)) for shape in shapes)
    assert J.evaluate(J.score(model, rows.drop("features", "weight"))).first()["auc"] > 0.8


def test_drawn_rows_and_features_still_rank_well(rows):
    plain = rows.drop("features", "weight")
    model = J.fit(plain, "xgboost", ["a", "b", "c", "d"], maxIter=10)
    assert J.evaluate(J.score(model, plain)).first()["auc"] > 0.95
    assert len({t.toDebugString.partition("\n")[2] for t in model.stages[-1].trees}) == 10
    assert sum(model.stages[-1].featureImportances) == pytest.approx(1)


def test_labels_must_be_0_or_1(rows):
    with pytest.raises(Exception, match="labels must be 0 or 1"):
        B.boosted_trees(rows.withColumn("label", F.lit(2)), GBTClassifier(weightCol="weight", maxIter=1))
    with pytest.raises(ValueError, match="labelled rows"):
        B.boosted_trees(rows.limit(0), GBTClassifier(weightCol="weight", maxIter=1))


def test_packed_bins_add_up_by_feature():
    sizes = [1, 32, 2, 3, 32, 700, 2]
    draw = np.random.default_rng(1)
    bins = [draw.integers(0, n, 500) for n in sizes]
    layout = B.Layout([np.arange(n - 1.0) for n in sizes])
    codes = layout.pack(bins)
    tables = [np.bincount(c, minlength=1 << w).reshape(1, 1, -1) for c, w in zip(codes, layout.widths)]
    assert max(layout.widths) == 10 and len(codes) < 6
    for sums, x in zip(layout.unpack(tables), bins):
        assert sums[0, 0].tolist() == np.bincount(x, minlength=700).tolist()


def test_candidates_lie_between_values_or_at_even_steps():
    assert B.thresholds_of(np.array([3.0, 1.0, -0.0, 0.0, 3.0]), np.ones(5), 31).tolist() == [0.5, 2.0]
    assert B.thresholds_of(np.arange(8.0), np.ones(8), 3).tolist() == [1.5, 3.5, 5.5]
    assert B.thresholds_of(np.ones(4), np.ones(4), 3).tolist() == []


def test_rows_are_made_once_for_the_split(spark):
    made = spark.sparkContext.accumulator(0)

    def count(n):
        made.add(1)
        return n

    seen = F.udf(count, "long").asNondeterministic()
    df = spark.range(400).select(seen("id").alias("id")).select("id", (F.col("id") % 24).cast("double").alias("a"), (F.col("id") % 24 >= 18).cast("int").alias("label"))
    J.train(df, "id", "logistic_regression", ["a"], maxIter=3)
    assert made.value == 400
