"""MLlib models, ensembles, importances and the training flow."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.feature import ElementwiseProduct, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.operators import metrics as M
from flowlens.operators import prep as H
from flowlens.operators.boost import boosted_trees
from flowlens.operators.perceptron import perceptron
from flowlens.operators.scale import hashed_row_number, salted_join
from flowlens.schemas import MODEL_FEATURES

# Default training parameters per model type.
DEFAULTS = {
    "xgboost": {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "positive_weight": 10.0},
    "random_forest": {"numTrees": 100, "maxDepth": 8},
    "logistic_regression": {"maxIter": 100, "regParam": 0.01},
    "mlp": {"hidden": [128, 64, 32, 16], "maxIter": 100},
}
SEED = 42


def classifier(model_type: str, n_features: int, **params):
    p = {**DEFAULTS[model_type], **params}
    p.pop("positive_weight", None)
    common = {"featuresCol": "features", "labelCol": "label"}
    if model_type == "xgboost":
        return GBTClassifier(**common, weightCol="weight", seed=SEED, **p)
    if model_type == "random_forest":
        return RandomForestClassifier(**common, weightCol="weight", seed=SEED, **p)
    if model_type == "logistic_regression":
        return LogisticRegression(**common, weightCol="weight", elasticNetParam=0.0, **p)
    if model_type == "mlp":
        hidden = p.pop("hidden")
        # This learner takes no weights: balance its rows first.
        return MultilayerPerceptronClassifier(**common, layers=[n_features, *hidden, 2], seed=SEED, **p)
    raise ValueError(f"unknown model type {model_type!r}")


def weighted(df: DataFrame, model_type: str, positive_weight: float | None = None) -> DataFrame:
    """Row weights: a fixed factor for anomalies in boosted trees, balanced weights elsewhere."""
    if model_type == "xgboost":
        w = DEFAULTS["xgboost"]["positive_weight"] if positive_weight is None else positive_weight
        return df.withColumn("weight", F.when(F.col("label") == 1, w).otherwise(1.0))
    return H.class_weights(df)


TASK_ROWS = (10_000, 250_000)  # rows that are worth a task, and the most that one task of a learner's pass holds


def spread(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows dealt out evenly, in as many partitions as there are cores or a multiple of that.

    A learner passes hundreds of times over its rows and keeps their layout: as scanned, a file of one row group
    is one task however many cores there are, and beside it a shuffle's nearly empty partitions each cost a task.
    """
    least, most = TASK_ROWS
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(cores, -(-n // least)) * -(-n // (cores * most))))


def fit(df: DataFrame, model_type: str, features: Sequence[str] = MODEL_FEATURES, **params) -> PipelineModel:
    """Median imputation, scaling by the population deviation, then the learner; unlabelled rows are left out.

    The type named ``xgboost`` is MLlib's boosted trees with the same settings. The rows are cached, evenly
    spread, for the passes of the learner and released before returning.
    """
    known = df.where(F.col("label").isNotNull()).select(*features, "label")
    rows = spread(known, known.count()).cache()
    try:
        return fit_spread(rows, model_type, features, **params)
    finally:
        rows.unpersist()


def fit_spread(df: DataFrame, model_type: str, features: Sequence[str] = MODEL_FEATURES, **params) -> PipelineModel:
    """``fit`` for rows that are cached and evenly spread already.

    Medians are merged from one sketch per task, by a few tasks: with as many tasks as cores that merge does not grow with the rows.
    """
    known = df.where(F.col("label").isNotNull())
    filled = [f"filled_{f}" for f in features]
    n = known.count()
    # The scaler divides by the sample deviation, which is larger by sqrt(n / (n - 1)).
    factor = (n / (n - 1)) ** 0.5 if n > 1 else 1.0
    stages = [
        Imputer(strategy="median", relativeError=0.0001, inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="scaled_features", withMean=True),
        ElementwiseProduct(inputCol="scaled_features", outputCol="features", scalingVec=Vectors.dense([factor] * len(features))),
    ]
    prepared = Pipeline(stages=stages).fit(known.coalesce(df.sparkSession.sparkContext.defaultParallelism))
    rows = with_features(prepared, weighted(known, model_type, params.get("positive_weight"))).select("features", "label", "weight")
    settings = classifier(model_type, len(features), **params)
    own = {GBTClassifier: boosted_trees, MultilayerPerceptronClassifier: perceptron}.get(type(settings))
    learner = own(rows, settings) if own else settings.fit(rows)
    return PipelineModel([*prepared.stages, learner])


def with_features(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``features`` as the first four stages make it, bit by bit, in one step.

    A learner makes its rows anew in each pass that comes before its own cache, and a chain of stages unpacks and packs a vector each.
    """
    imputer, _, scaler, product = model.stages[:4]
    fits = zip(imputer.getOutputCols(), scaler.mean.toArray(), scaler.std.toArray(), product.getScalingVec().toArray())
    values = [
        (F.col(f).cast("double") - float(mean)) * (1 / float(std) if std != 0 else 0.0) * float(factor) for f, mean, std, factor in fits
    ]
    return imputer.transform(df).withColumn("features", array_to_vector(F.array(*values)))


def score(model: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds the anomaly probability ``score`` and its cut ``pred``."""
    out = model.transform(df).withColumn("score", vector_to_array("probability")[1])
    return out.select(*df.columns, "score").withColumn("pred", decide("score", threshold))


def logistic_column(model: PipelineModel, features: Sequence[str] = MODEL_FEATURES) -> Column:
    """The probability of a fitted logistic regression written out as a column over its input columns."""
    imputer, _, scaler, product, learner = model.stages
    fill = imputer.surrogateDF.first()
    parts = zip(features, scaler.mean.toArray(), scaler.std.toArray(), product.getScalingVec().toArray(), learner.coefficients.toArray())
    terms = []
    for name, mean, std, factor, weight in parts:
        value = F.col(name).cast("double")
        known = F.when(value.isNull() | F.isnan(value), float(fill[name])).otherwise(value)
        terms.append((known - float(mean)) * (float(factor * weight / std) if std > 0 else 0.0))
    return 1 / (1 + F.exp(-(sum(terms, F.lit(float(learner.intercept))))))


def decide(score_col: str | Column, threshold: float = 0.5) -> Column:
    s = F.col(score_col) if isinstance(score_col, str) else score_col
    return (s >= threshold).cast("int")


def partial_refit(df: DataFrame, now_us: int, days: int = 30, **params) -> PipelineModel:
    """Logistic regression over the current training window; replaces step-wise updates."""
    from flowlens.operators.decisions import training_window

    return fit(training_window(df, now_us, days), "logistic_regression", **params)


def train(
    df: DataFrame, id_col: str, model_type: str, features: Sequence[str] = MODEL_FEATURES,
    folds: int = 0, test_percent: int = 20, **params,
) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Split, optional cross-validation, fit, and test metrics.

    Returns the model, one metric row for the test part, and one metric row per fold. The
    input is cached, evenly spread, for the passes of the learner and released before returning.
    """
    spark = df.sparkSession
    # The split reads its rows four times: they are made once.
    made = df.select("*").cache()
    n = made.count()
    parts = spread(H.stratified_split(made, id_col, test_percent=test_percent), n).cache()
    parts.count()
    made.unpersist()
    training = parts.where("is_train").drop("is_train")
    fold_rows = []
    if folds:
        assigned = spread(H.stratified_folds(training, id_col, folds=folds), n).cache()
        for k in range(folds):
            model = fit_spread(assigned.where(F.col("fold") != k), model_type, features, **params)
            row = judged(model, assigned.where(F.col("fold") == k)).withColumn("fold", F.lit(k))
            fold_rows += row.collect()  # one row
        assigned.unpersist()
    model = fit_spread(training, model_type, features, **params)
    metrics = judged(model, parts.where("NOT is_train"))
    parts.unpersist()
    return model, metrics, spark.createDataFrame(fold_rows, row.schema) if folds else None


def train_and_register(
    df: DataFrame, id_col: str, model_type: str, path: str, registry_path: str, version: int, ts_us: int, **options,
) -> tuple[PipelineModel, DataFrame]:
    """Trains, saves the fitted pipeline and adds it to the registry with its test F1."""
    from flowlens.sources.storage import save_model

    model, metrics, _ = train(df, id_col, model_type, **options)
    save_model(model, path, registry_path, model_type, version, metrics.first()["f1"], ts_us)
    return model, metrics


def evaluate(scored: DataFrame) -> DataFrame:
    """Counts, rates and AUC in one row."""
    return M.binary_metrics(scored).withColumn("auc", M.auc(scored).scalar())


def judged(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``evaluate`` of the model on the rows, done: they are scored once for the counts and the AUC."""
    scored = score(model, df).select("label", "score", "pred").cache()
    try:
        row = evaluate(scored)
        return df.sparkSession.createDataFrame(row.collect(), row.schema)  # one row
    finally:
        scored.unpersist()


def cross_validation_summary(fold_rows: DataFrame) -> DataFrame:
    """Means over the folds and the deviation of F1."""
    return fold_rows.agg(
        *[F.avg(c).alias(f"cv_{c}_mean") for c in ("precision", "recall", "f1", "auc")],
        F.stddev_pop("f1").alias("cv_f1_std"),
    )


def train_per_protocol(
    df: DataFrame, default_type: str, types: Mapping[int, str] | None = None,
    features: Sequence[str] = MODEL_FEATURES, minimum: int = 100, **params,
) -> dict[int | None, PipelineModel]:
    """One model per protocol with enough rows of both classes, and a general one under None."""
    groups = df.groupBy("protocol").agg(
        F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")
    )
    # A protocol number is one byte, so this list has at most 256 entries.
    fit_for = [r["protocol"] for r in groups.where((F.col("n") >= minimum) & (F.col("lo") < F.col("hi"))).collect()]
    models: dict[int | None, PipelineModel] = {None: fit(df, default_type, features, **params)}
    for p in sorted(fit_for):
        kind = (types or {}).get(p, default_type)
        own = params if kind == default_type else {}
        models[p] = fit(df.where(F.col("protocol") == p), kind, features, **own)
    return models


def native_importance(spark, model: PipelineModel, features: Sequence[str] = MODEL_FEATURES) -> DataFrame:
    """Feature importances of trees, or absolute coefficients, as rows (one per model feature)."""
    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    rows = [(f, abs(float(v))) for f, v in zip(features, values.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double")


def soft_vote(scores: DataFrame, id_col: str, weights: Mapping[str, float] | None = None, threshold: float = 0.5) -> DataFrame:
    """Σ wᵢpᵢ clipped to [0, 1] per id, from rows (id, model, score)."""
    w = _weights(weights)
    total = F.sum(F.col("score") * w) if weights else F.avg("score")
    voted = scores.groupBy(id_col).agg(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)).alias("score"))
    return voted.withColumn("pred", decide("score", threshold))


def hard_vote(scores: DataFrame, id_col: str, weights: Mapping[str, float] | None = None, threshold: float = 0.5) -> DataFrame:
    """Weighted majority of the single votes."""
    w = _weights(weights)
    share = F.sum(F.col("pred") * w) if weights else F.avg(F.col("pred").cast("double"))
    return scores.groupBy(id_col).agg(share.alias("share")).withColumn("pred", decide("share", threshold))


def _weights(weights: Mapping[str, float] | None) -> Column:
    if not weights:
        return F.lit(1.0)
    pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("model")), F.lit(0.0))


def combined_importance(importances: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Weighted mean importance per feature over the models that report it."""
    w = _weights(weights)
    return importances.groupBy("feature").agg((F.sum(F.col("importance") * w) / F.sum(w)).alias("importance"))


ROUNDS = 12


def round_keys(seed: int, repeat: int) -> list[int]:
    """Key of each round of a shuffle: 52 bits of an md5."""
    return [int(hashlib.md5(f"{seed}:{repeat}:{r}".encode()).hexdigest()[:13], 16) for r in range(ROUNDS)]


def shuffled_place(place: Column, n: Column, seed: int, repeats: int) -> Column:
    """Where each repeat's shuffle of 0 … n - 1 puts a place: an array with one bijection per repeat.

    In each round a place and its mirror image about the round's key either swap or stay, as one bit of an md5 of
    the greater of both tells; this undoes itself, so no two places ever meet, whatever n is.
    """
    def swap(at: Column, key: Column) -> Column:
        other = F.pmod(key["key"] + n - at, n)
        return F.when(F.md5(F.concat_ws(":", key["name"], F.greatest(at, other))) < "8", other).otherwise(at)

    def keys(repeat: int) -> Column:
        named = enumerate(round_keys(seed, repeat))
        return F.array(*[F.struct(F.lit(k).cast("bigint").alias("key"), F.lit(f"{seed}:{repeat}:{r}").alias("name")) for r, k in named])

    return F.array(*[F.aggregate(keys(r), place, swap) for r in range(repeats)])


def permutation_importance(
    df: DataFrame, id_col: str, features: Sequence[str], predict: Callable[[DataFrame], DataFrame], seed: int = SEED,
    repeats: int = 1,
) -> DataFrame:
    """Accuracy lost when a feature's values are shuffled among the rows; shares sum to 1.

    Rows are numbered once, in md5 order of the ids. Each repeat has one keyed bijection of the numbers, which all
    features share, so one join hands every row its donors. Each row is then scored once as it is and once
    per feature and repeat, in one pass. ``predict`` must keep the columns it does not know.
    """
    numbered = hashed_row_number(df, [], id_col, seed, "__rn").withColumn("__at", F.col("__rn") - 1)
    donors = numbered.withColumn("__n", df.agg(F.count(F.lit(1))).scalar()).select(
        F.struct(*features).alias("__donor"), F.posexplode(shuffled_place(F.col("__at"), F.col("__n"), seed, repeats)).alias("__repeat", "__at"),
    )
    which = F.explode(F.sequence(F.when(F.col("__repeat") == 0, -1).otherwise(0), F.lit(len(features) - 1)))
    variants = numbered.join(donors, "__at").withColumn("__feature", which)
    changed = {
        f: F.when(F.col("__feature") == i, F.col(f"__donor.{f}")).otherwise(F.col(f)) for i, f in enumerate(features)
    }
    scored = predict(variants.withColumns(changed).select(*df.columns, "__feature", "__repeat"))
    accuracy = scored.groupBy("__feature", "__repeat").agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("__accuracy"))
    base = F.max(F.when(F.col("__feature") < 0, F.col("__accuracy"))).over(_all_rows())
    drops = (
        accuracy.withColumn("__drop", F.abs(base - F.col("__accuracy"))).where("__feature >= 0")
        .groupBy(F.element_at(F.array(*[F.lit(f) for f in features]), F.col("__feature") + 1).alias("feature")).agg(F.avg("__drop").alias("drop"))
    )
    total = F.sum("drop").over(_all_rows())
    return drops.select("feature", "drop", F.when(total > 0, F.col("drop") / total).otherwise(0.0).alias("importance"))


def _all_rows():
    from pyspark.sql import Window

    return Window.partitionBy()  # one row per feature and repeat


def join_labels(predictions: DataFrame, labels: DataFrame, id_col: str, salt_by: str) -> DataFrame:
    """Predictions with their true label; a label shared by many rows is salted."""
    return salted_join(predictions, labels, [id_col], salt_by)
