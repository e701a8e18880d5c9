"""Perceptrons over blocks beside MLlib's own."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from flowlens.operators import models as J
from flowlens.operators import perceptron as P


@pytest.fixture(scope="module")
def rows(spark):
    part = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("double")
    plain = spark.range(1100).select((part(1, 700) / 350 - 1).alias("a"), (part(2, 9) / 4 - 1).alias("b"), (part(3, 2) - 1).alias("c"))
    label = (F.col("a") * F.col("b") + F.col("c") / 3 > 0).cast("int")
    return plain.withColumn("label", label).withColumn("features", array_to_vector(F.array("a", "b", "c"))).repartition(3).cache()


def probabilities(model, df):
    return {tuple(r.features): r.probability[1] for r in model.transform(df).collect()}


@pytest.mark.parametrize("params", [{"maxIter": 0}, {"maxIter": 8}, {"maxIter": 8, "blockSize": 50, "layers": [3, 7, 2]}, {"maxIter": 60, "tol": 0.05}])
def test_networks_are_those_of_mllib(rows, params, tmp_path, monkeypatch):
    """The same start, descent and end; the last group of a partition is smaller than the others and counts alike."""
    settings = MultilayerPerceptronClassifier(**{"layers": [3, 6, 5, 2], "seed": 42, **params})
    want = settings.fit(rows)
    monkeypatch.setattr(P, "BLOCK_ROWS", 256)
    monkeypatch.setattr(P, "STEP_ROWS", 100)
    loose = P.perceptron(rows, settings)
    assert probabilities(loose, rows) == pytest.approx(probabilities(want, rows), abs=1e-3)
    monkeypatch.setattr(P, "PRECISIONS", (np.float64,))
    got = P.perceptron(rows, settings)
    assert got.weights.toArray() == pytest.approx(want.weights.toArray(), rel=1e-6, abs=1e-6)
    assert (got.numFeatures, got.numClasses, got.getLayers(), got.getBlockSize()) == (want.numFeatures, 2, want.getLayers(), want.getBlockSize())
    got.write().save(str(tmp_path / "m"))
    assert probabilities(MultilayerPerceptronClassificationModel.load(str(tmp_path / "m")), rows) == probabilities(got, rows)


def test_a_failed_search_goes_on_with_more_bits(rows, monkeypatch):
    seen = []
    plain = P.summed
    monkeypatch.setattr(P, "summed", lambda weights, layers, kind: seen.append(kind) or plain(weights, layers, kind))
    monkeypatch.setattr(P, "step_length", lambda *x: (_ for _ in ()).throw(P.SearchFailed))
    P.perceptron(rows, MultilayerPerceptronClassifier(layers=[3, 4, 2], seed=1))
    assert seen == [np.float32, np.float64]


def test_mlp_makes_one_pass_of_blocks_per_evaluation(rows, monkeypatch):
    """``fit`` hands its rows to the blocks, not to a learner that visits them as objects; bad labels and no rows are faults."""
    monkeypatch.setattr(J.MultilayerPerceptronClassifier, "fit", lambda *_: pytest.fail("MLlib's learner ran"))
    named = rows.drop("features")
    model = J.fit(named, "mlp", ["a", "b", "c"], hidden=[6], maxIter=40)
    scored = J.score(model, named)
    assert scored.where("pred = label").count() > 0.9 * rows.count()
    settings = MultilayerPerceptronClassifier(layers=[3, 2], seed=1)
    with pytest.raises(ValueError):
        P.perceptron(rows.limit(0), settings)
    with pytest.raises(Exception, match="labels must be whole numbers"):
        P.perceptron(rows.withColumn("label", F.lit(2)), settings)
