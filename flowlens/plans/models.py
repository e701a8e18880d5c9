"""Model training, voting and importances on rows of the feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.config import DetectionConfig
from flowlens.functions.scalars import raw_to_features
from flowlens.operators import detect as D
from flowlens.operators import models as J
from flowlens.plans.registry import DAY, query, rd, rounded, scratch
from flowlens.sources.adapters import PACKETS_SQL, PREDICTIONS_SQL, RAW_SQL, packets, predictions, raw_samples
from flowlens.schemas import MODEL_FEATURES

TYPES = ("xgboost", "random_forest", "logistic_regression", "mlp")

# What a learner finds differs from build to build; what is checked is what it must find: the rows of
# the test part and of each fold, which the md5 order of the ids decides, and a bound on the ranking.
_RANKED = f"""{RAW_SQL}, n AS (SELECT id, protocol, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id), id) AS rn,
  count(*) OVER (PARTITION BY label) AS c FROM raw)"""
AUC_BOUND = 0.9


def training_rows(spark, d):
    return raw_to_features(raw_samples(spark, d), ["id", "protocol"]).select("id", "protocol", *MODEL_FEATURES, "label")


def found(metrics, *keys):
    return metrics.select(
        *keys, (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).cast("bigint").alias("rows"),
        (F.col("tp") + F.col("fn")).cast("bigint").alias("positives"), (F.col("auc") >= AUC_BOUND).alias("ranks_well"),
    )


def _trained(model_type):
    def build(spark, d):
        _, metrics, _ = J.train(training_rows(spark, d), "id", model_type)
        return found(metrics).withColumn("model_type", F.lit(model_type))
    return build


for _t in TYPES:
    query(f"train_{_t}", f"""WITH {_RANKED} SELECT count(*) AS rows, count(*) FILTER (WHERE label = 1) AS positives, true AS ranks_well,
  '{_t}' AS model_type FROM n WHERE rn > c * 80 // 100""")(_trained(_t))


@query("cross_validation", f"""WITH {_RANKED} SELECT CAST((rn - 1) % 5 AS INT) AS fold, count(*) AS rows,
  count(*) FILTER (WHERE label = 1) AS positives, true AS ranks_well FROM n WHERE rn <= c * 80 // 100 GROUP BY 1""")
def _cv(spark, d):
    _, _, folds = J.train(training_rows(spark, d), "id", "logistic_regression", folds=5)
    return found(folds, F.col("fold").cast("int").alias("fold"))


@query("models_per_protocol", f"""WITH {RAW_SQL} SELECT protocol, count(*) AS rows, true AS accurate FROM raw GROUP BY 1""")
def _per_protocol(spark, d):
    from flowlens.operators.detect import route

    rows = training_rows(spark, d)
    models = J.train_per_protocol(rows, "logistic_regression")
    general = models.pop(None)
    right = ((F.col("model_score") >= 0.5).cast("int") == F.col("label")).cast("double")
    return route(rows, models, general).groupBy("protocol").agg(
        F.count(F.lit(1)).alias("rows"), (F.avg(right) >= 0.8).alias("accurate")
    )


@query("batch_model_detection", f"""WITH {RAW_SQL}, m AS (SELECT protocol AS p FROM packets GROUP BY protocol ORDER BY count(*) DESC, protocol LIMIT 1)
SELECT id, protocol, p AS threshold_protocol, CASE p WHEN 6 THEN 0.6 WHEN 17 THEN 0.8 WHEN 1 THEN 0.9 ELSE 0.7 END::DOUBLE AS threshold_used,
  true AS scored_by_formula, true AS decided_by_score FROM raw, m""")
def _batch_model(spark, d):
    """A file through the models of its protocols; every score is computed again from coefficients, as plain columns."""
    path = scratch(spark, "batch")
    training_rows(spark, d).write.parquet(f"{path}/in")
    stored = spark.read.parquet(f"{path}/in")
    models = J.train_per_protocol(stored, "logistic_regression")
    general = models.pop(None)
    rows = D.detect_file(spark, f"{path}/in", f"{path}/out", DetectionConfig(mode="model_only"), models=models, fallback=general)
    expected = F.coalesce(*[F.when(F.col("protocol") == p, J.logistic_column(m)) for p, m in models.items()], J.logistic_column(general))
    return rows.select(
        "id", "protocol", "threshold_protocol", "threshold_used",
        (F.abs(F.col("model_score") - expected) < 1e-9).alias("scored_by_formula"),
        (F.col("is_anomaly") == (expected >= F.col("threshold_used"))).alias("decided_by_score"),
    )


@query("native_importance", f"""WITH {RAW_SQL} SELECT {len(MODEL_FEATURES)}::BIGINT AS features, 1.0::DOUBLE AS total, 0::BIGINT AS negative,
  count(*) > 0 AS trained FROM raw""")
def _native(spark, d):
    model = J.fit(training_rows(spark, d), "random_forest")
    return rounded(J.native_importance(spark, model).agg(
        F.count(F.lit(1)).alias("features"), F.sum("importance").alias("total"), F.count_if(F.col("importance") < 0).alias("negative"),
        F.lit(True).alias("trained"),
    ))


_REFIT_END = 1_706_600_000_000_000


@query("windowed_refit", f"""WITH {RAW_SQL} SELECT count(*) AS rows, count(*) FILTER (WHERE label = 1) AS positives, true AS ranks_well FROM raw
WHERE "timestamp" * 1e6 NOT BETWEEN {_REFIT_END - 10 * DAY} AND {_REFIT_END}""")
def _refit(spark, d):
    """Fitted on the window, judged on the rows outside it."""
    rows = training_rows(spark, d).join(packets(spark, d).select(F.col("packet_id").alias("id"), "ts_us"), "id")
    model = J.partial_refit(rows, _REFIT_END, 10)
    others = rows.where(~F.col("ts_us").between(_REFIT_END - 10 * DAY, _REFIT_END))
    return found(J.evaluate(J.score(model, others)))


@query("saved_model", f"WITH {RAW_SQL} SELECT label, count(*) AS rows, 0::BIGINT AS differences, 2 AS version FROM raw GROUP BY 1")
def _saved(spark, d):
    from flowlens.plans.registry import scratch
    from flowlens.sources import storage as A

    base = scratch(spark, "models")
    rows = training_rows(spark, d)
    for version in (1, 2):
        model, _ = J.train_and_register(
            rows, "id", "logistic_regression", f"{base}/lr-{version}", f"{base}/registry", version, version, maxIter=50 * version
        )
    newest = A.load_latest_model(spark, f"{base}/registry", "logistic_regression")
    kept = J.score(model, rows).select("id", F.col("score").alias("kept"))
    version = A.latest_models(spark.read.parquet(f"{base}/registry")).select("version").scalar()
    return J.score(newest, rows).join(kept, "id").groupBy("label").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("score") != F.col("kept")).alias("differences")
    ).withColumn("version", version.cast("int"))


@query("decision_threshold", f"WITH {PREDICTIONS_SQL} SELECT id, CASE WHEN score >= 0.35 THEN 1 ELSE 0 END AS pred FROM predictions")
def _threshold(spark, d):
    return predictions(spark, d).select("id", J.decide("score", 0.35).alias("pred"))


_FACTORS = {"xgboost": 37, "random_forest": 53, "mlp": 71}
_WEIGHTS = {"xgboost": 0.5, "random_forest": 0.4, "mlp": 0.3}
_SCORES = f"""{PACKETS_SQL}, s AS ({' UNION ALL '.join(
    f"SELECT packet_id AS id, '{m}' AS model, CAST(k * {f} % 101 AS DOUBLE) / 100 AS score, {w} AS w FROM packets"
    for (m, f), w in zip(_FACTORS.items(), _WEIGHTS.values()))})"""


def model_scores(spark, d):
    rows = F.array(*[F.struct(F.lit(m).alias("model"), (F.col("k") * f % 101 / F.lit(100.0)).alias("score")) for m, f in _FACTORS.items()])
    out = packets(spark, d).select(F.col("packet_id").alias("id"), F.explode(rows).alias("s")).select("id", "s.*")
    return out.withColumn("pred", J.decide("score"))


@query("soft_vote", f"""WITH {_SCORES}, v AS (SELECT id, least(greatest(sum(score * w), 0), 1) AS score FROM s GROUP BY id)
SELECT id, {rd('score', 'score')}, CASE WHEN v.score >= 0.52 THEN 1 ELSE 0 END AS pred FROM v""")
def _soft(spark, d):
    # The weighted sums have steps of 0.001, so a threshold between steps is not at a rounding edge.
    return rounded(J.soft_vote(model_scores(spark, d), "id", _WEIGHTS, 0.52))


@query("soft_vote_equal", f"WITH {_SCORES} SELECT id, {rd('avg(score)', 'score')}, CASE WHEN avg(s.score) >= 0.505 THEN 1 ELSE 0 END AS pred FROM s GROUP BY id")
def _soft_equal(spark, d):
    return rounded(J.soft_vote(model_scores(spark, d), "id", threshold=0.505))


@query("hard_vote", f"""WITH {_SCORES} SELECT id, {rd('avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0 END)', 'share')},
  CASE WHEN count(*) FILTER (WHERE score >= 0.5) >= 2 THEN 1 ELSE 0 END AS pred FROM s GROUP BY id""")
def _hard(spark, d):
    return rounded(J.hard_vote(model_scores(spark, d), "id"))


@query("combined_importance", f"""WITH {PACKETS_SQL},
i AS (SELECT 'f' || (k % 9) AS feature, CASE user_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.4 ELSE 0.3 END AS w, avg(length) AS importance
  FROM packets GROUP BY 1, 2)
SELECT feature, {rd('sum(importance * w) / sum(w)', 'importance')} FROM i GROUP BY feature""")
def _combined(spark, d):
    model = F.when(F.col("user_id") % 3 == 0, "xgboost").when(F.col("user_id") % 3 == 1, "random_forest").otherwise("mlp")
    rows = packets(spark, d).groupBy(F.concat(F.lit("f"), (F.col("k") % 9).cast("string")).alias("feature"), model.alias("model"))
    return rounded(J.combined_importance(rows.agg(F.avg("length").alias("importance")), _WEIGHTS))


REPEATS = 2


def _places_sql(repeat: int) -> str:
    """Rows with the place to which the shuffle of a repeat takes them, a round at a time."""
    out = "SELECT id, spot AS x, n FROM numbered"
    for r, key in enumerate(J.round_keys(J.SEED, repeat)):
        out = f"""SELECT id, n, CASE WHEN md5('{J.SEED}:{repeat}:{r}:' || greatest(x, y)) < '8' THEN y ELSE x END AS x
          FROM (SELECT *, ({key} + n - x) % n AS y FROM ({out}))"""
    return f"SELECT {repeat} AS rep, id, x FROM ({out})"


def _accuracy_sql(k: str, length: str) -> str:
    return f"avg(CASE WHEN a.label = CASE WHEN {k} * 2 + {length} > 150 THEN 1 ELSE 0 END THEN 1.0 ELSE 0 END)"


@query("permutation_importance", f"""WITH {PACKETS_SQL},
p AS (SELECT packet_id AS id, k, length, CASE WHEN k + length > 130 THEN 1 ELSE 0 END AS label FROM packets),
numbered AS (SELECT *, row_number() OVER (ORDER BY md5('{J.SEED}:' || id), id) - 1 AS spot, count(*) OVER () AS n FROM p),
places AS ({" UNION ALL ".join(_places_sql(r) for r in range(REPEATS))}),
base AS (SELECT {_accuracy_sql("a.k", "a.length")} AS acc FROM p a),
pairs AS (SELECT rep, a.label, a.k, a.length, d.k AS k2, d.length AS length2 FROM places JOIN p d USING (id) JOIN numbered a ON a.spot = places.x),
s AS (SELECT rep, 'k' AS feature, {_accuracy_sql("a.k2", "a.length")} AS acc FROM pairs a GROUP BY rep
  UNION ALL SELECT rep, 'length', {_accuracy_sql("a.k", "a.length2")} FROM pairs a GROUP BY rep),
x AS (SELECT feature, avg(abs((SELECT acc FROM base) - acc)) AS drop FROM s GROUP BY feature)
SELECT feature, {rd('drop', 'drop')}, {rd('drop / sum(drop) OVER ()', 'importance')} FROM x""")
def _permutation(spark, d):
    rows = packets(spark, d).select(
        F.col("packet_id").alias("id"), "k", "length", (F.col("k") + F.col("length") > 130).cast("int").alias("label")
    )
    predict = lambda df: df.withColumn("pred", (F.col("k") * 2 + F.col("length") > 150).cast("int"))
    return rounded(J.permutation_importance(rows, "id", ["k", "length"], predict, repeats=REPEATS))


@query("predictions_with_labels", f"""WITH {PREDICTIONS_SQL}, l AS (SELECT user_id, max(label) AS truth FROM predictions GROUP BY 1)
SELECT id, user_id, pred, truth FROM predictions JOIN l USING (user_id)""")
def _labels(spark, d):
    p = predictions(spark, d).select("id", "user_id", "pred", "label")
    labels = p.groupBy("user_id").agg(F.max("label").alias("truth"))
    return J.join_labels(p.drop("label"), labels, "user_id", "id")
