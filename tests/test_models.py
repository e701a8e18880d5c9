"""Model flow: fit, score, save, reload, per-protocol routing."""

import pytest
from pyspark.sql import functions as F

from flowlens.operators import decisions as K
from flowlens.operators import models as J
from flowlens.operators.detect import model_score, route
from flowlens.sources import storage as A


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(240).select(
        "id", (F.col("id") % 24).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"),
        ((F.col("id") % 24) >= 18).cast("int").alias("label"), F.when(F.col("id") % 2 == 0, 6).otherwise(17).alias("protocol"),
    )


def test_train_scores_well_and_reloads(spark, rows, tmp_path):
    model, tested, _ = J.train(rows, "id", "logistic_regression", ["a", "b"], maxIter=30)
    row = tested.first()
    assert row.support == 48 and row.f1 > 0.8 and row.auc > 0.95
    A.save_model(model, str(tmp_path / "m"), str(tmp_path / "reg"), "logistic_regression", 1, row.f1, 10)
    again = A.load_latest_model(spark, str(tmp_path / "reg"), "logistic_regression")
    assert J.score(again, rows).exceptAll(J.score(model, rows)).count() == 0
    with pytest.raises(LookupError):
        A.load_latest_model(spark, str(tmp_path / "reg"), "mlp")


def test_learners_get_their_rows_evenly_spread(spark, monkeypatch):
    """A file of one row group is one partition; learners pass over it hundreds of times, so its rows are dealt out first."""
    seen = []

    class Watched(J.Pipeline):
        def fit(self, df):
            seen.append([r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()])
            return super().fit(df)

    monkeypatch.setattr(J, "Pipeline", Watched)
    one = spark.range(40_000).coalesce(1).select("id", (F.col("id") % 24).cast("double").alias("a"), (F.col("id") % 24 >= 18).cast("int").alias("label"))
    J.train(one, "id", "logistic_regression", ["a"], folds=2, maxIter=3)
    J.fit(one, "logistic_regression", ["a"], maxIter=3)
    assert [sum(sizes) for sizes in seen] == [15_999, 16_000, 31_999, 40_000]
    assert all(len(sizes) == 4 and max(sizes) < 1.1 * min(sizes) for sizes in seen)


def test_number_of_partitions_follows_cores_and_rows(spark):
    cores, most = spark.sparkContext.defaultParallelism, J.TASK_ROWS[1]
    parts = lambda n: J.spread(spark.range(1), n).rdd.getNumPartitions()
    assert [parts(n) for n in (0, 1, cores * most, cores * most + 1, 5 * cores * most)] == [1, 1, cores, 2 * cores, 5 * cores]


def test_routing_keeps_every_row(rows):
    models = {6: J.fit(rows.where("protocol = 6"), "logistic_regression", ["a", "b"], maxIter=5)}
    out = route(rows, models)
    assert out.count() == 240
    assert out.where("model_score IS NULL").select("protocol").distinct().first()[0] == 17


def test_routing_scans_once_whatever_the_number_of_models(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    models = {p: J.fit(rows.where(f"protocol = {p}"), "logistic_regression", ["a", "b"], maxIter=5) for p in (6, 17)}
    general = J.fit(rows, "logistic_regression", ["a", "b"], maxIter=5)
    rest = stored.withColumn("protocol", F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 7 == 1, 1).otherwise(F.col("protocol")))
    out = route(rest, models, general)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "Union" not in text and "Exchange" not in text
    expected = F.when(F.col("protocol") == 6, J.logistic_column(models[6], ["a", "b"])).when(
        F.col("protocol") == 17, J.logistic_column(models[17], ["a", "b"])
    ).otherwise(J.logistic_column(general, ["a", "b"]))
    assert out.where(F.abs(F.col("model_score") - expected) < 1e-9).count() == 240


def test_scores_without_probability(spark):
    """A margin goes through the sigmoid; a bare prediction is the score."""
    from pyspark.ml.functions import array_to_vector

    df = spark.createDataFrame([(0.0, [2.0, -2.0]), (1.0, [-1.0, 1.0])], "prediction double, m array<double>")
    margins = df.withColumn("rawPrediction", array_to_vector("m"))
    got = [r.s for r in margins.select(model_score(margins).alias("s")).collect()]
    assert got == pytest.approx([0.11920292202211755, 0.7310585786300049])
    assert [r.s for r in df.select(model_score(df).alias("s")).collect()] == [0.0, 1.0]


def test_selection_needs_samples(spark):
    protocols = spark.createDataFrame([(6,), (17,), (1,), (99,)], "protocol int")
    history = [("tcp", "xgboost", 0.85), ("tcp", "lstm", 0.89), ("udp", "xgboost", 0.78), ("udp", "random_forest", 0.82)]
    schema = "protocol string, model_type string, f1 double, sample_count long"
    for n, want in ((1000, {6: "lstm", 17: "random_forest"}), (0, {6: "lstm", 17: "xgboost"})):
        table = spark.createDataFrame([(*h, n) for h in history], schema)
        got = {r.number: r.model_type for r in K.select_models(protocols, table).collect()}
        assert got == {**want, 1: "random_forest", 99: "xgboost"}


def test_importance_summary(spark):
    df = spark.createDataFrame([("m", f"f{i}", v) for i, v in enumerate([0.5, 0.2, 0.001, 0.05, 0.002, 0.003, 0.0])], "m string, feature string, importance double")
    r = K.importance_summary(df, ["m"]).first()
    assert (r.low_features, r.high_features) == (["f5", "f4", "f2", "f6"], ["f0", "f1"])
    assert r.top_features == ["f0", "f1", "f3", "f5", "f4"]


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_shuffles_are_bijections_that_differ(spark, n):
    rows = spark.range(n).select(J.shuffled_place(F.col("id"), F.lit(n).cast("bigint"), 3, 3).alias("to")).collect()
    places = list(zip(*[r["to"] for r in rows]))
    assert all(sorted(p) == list(range(n)) for p in places)
    if n == 1000:
        assert len(set(places)) == 3
        for p in places:  # few stay where they are or beside their neighbour, and halves mix
            assert sum(i == x for i, x in enumerate(p)) < 15
            assert sum(abs(a - b) == 1 for a, b in zip(p, p[1:])) < 30
            assert 200 < sum(x < 500 for x in p[:500]) < 300


def test_permutation_importance_scans_alike_for_any_number_of_shuffles(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    predict = lambda df: df.withColumn("pred", (F.col("a") >= 18).cast("int"))
    few = J.permutation_importance(stored, "id", ["a"], predict)
    many = J.permutation_importance(stored, "id", ["a", "b"], predict, repeats=5)
    scans = [df._jdf.queryExecution().executedPlan().toString().count("FileScan") for df in (few, many)]
    assert scans[0] == scans[1]
    got = {r.feature: (r["drop"], r.importance) for r in many.collect()}
    assert got["b"] == (0.0, 0.0) and got["a"][1] == 1.0 and 0.2 < got["a"][0] < 0.6
    assert J.permutation_importance(stored.limit(0), "id", ["a"], predict).count() == 0


def test_features_in_one_step_are_those_of_the_stages(spark):
    rows = spark.range(501).select(
        (F.col("id") % 24 / 7.0).alias("a"), F.when(F.col("id") % 9 > 0, F.col("id") % 5).cast("int").alias("b"), F.lit(3.0).alias("c"),
        F.when(F.col("id") % 4 == 0, float("nan")).otherwise(F.col("id") / 3.0).alias("d"), (F.col("id") % 24 >= 18).cast("int").alias("label"),
    )
    names = ["a", "b", "c", "d"]
    model = J.fit(rows, "logistic_regression", names, maxIter=5)
    got = J.with_features(model, rows).select(F.col("features").alias("x"), *names)
    want = model.transform(rows).select(F.col("features").alias("x"), *names)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert len(model.stages) == 5 and model.stages[2].std[2] == 0


@pytest.mark.parametrize("rows_of", [1, 8])
def test_medians_take_one_sketch_per_core(spark, monkeypatch, rows_of):
    """Sketches are merged by a few tasks: their number may not follow the number of partitions."""
    seen = []

    class Watched(J.Pipeline):
        def fit(self, df):
            seen.append(df.rdd.getNumPartitions())
            return super().fit(df)

    monkeypatch.setattr(J, "Pipeline", Watched)
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(2_000).repartition(rows_of * cores).select((F.col("id") % 24).cast("double").alias("a"), (F.col("id") % 24 >= 18).cast("int").alias("label"))
    J.fit_spread(df.cache(), "logistic_regression", ["a"], maxIter=3)
    df.unpersist()
    assert seen == [cores]


def test_test_rows_are_scored_once(spark, rows, monkeypatch):
    model = J.fit(rows, "logistic_regression", ["a", "b"], maxIter=5)
    scored = spark.sparkContext.accumulator(0)

    def count(n):
        scored.add(1)
        return n

    seen = F.udf(count, "long").asNondeterministic()
    plain = J.evaluate(J.score(model, rows)).collect()
    assert J.judged(model, rows.withColumn("label", seen("id") * 0 + F.col("label"))).collect() == plain
    assert scored.value == 240
