"""Metrics and curves over scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import metrics as M
from flowlens.plans.registry import query, rd, rounded
from flowlens.sources.adapters import PACKETS_SQL, PREDICTIONS_SQL, packets, predictions

_COUNTS = """count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
  count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn"""
_RATES = ", ".join([
    rd("coalesce(tp / nullif(tp + fp, 0), 0)", "precision"), rd("coalesce(tp / nullif(tp + fn, 0), 0)", "recall"),
    rd("coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)", "f1"), rd("(tp + tn) / (tp + fp + tn + fn)", "accuracy"),
])


@query("binary_metrics", f"WITH {PREDICTIONS_SQL}, c AS (SELECT {_COUNTS} FROM predictions) SELECT tp, fp, tn, fn, {_RATES}, tp + fp + tn + fn AS support FROM c")
def _binary(spark, d):
    return rounded(M.binary_metrics(predictions(spark, d)))


@query("metrics_by_protocol", f"""WITH {PREDICTIONS_SQL}, c AS (SELECT protocol, {_COUNTS} FROM predictions GROUP BY 1)
SELECT protocol, tp, fp, tn, fn, {_RATES}, tp + fp + tn + fn AS support FROM c""")
def _by_protocol(spark, d):
    return rounded(M.binary_metrics(predictions(spark, d), ["protocol"]))


_CLASSES = "SELECT CASE WHEN k < 60 THEN 0 WHEN k < 85 THEN 1 ELSE 2 END AS label, (k * 37 % 101) // 34 AS pred FROM packets"


def _multi(spark, d):
    k = F.col("k")
    return packets(spark, d).select(
        F.when(k < 60, 0).when(k < 85, 1).otherwise(2).alias("label"), F.expr("(k * 37 % 101) DIV 34").cast("int").alias("pred")
    )


@query("confusion_matrix", f"""WITH {PACKETS_SQL}, x AS ({_CLASSES}), c AS (SELECT label, pred, count(*) AS n FROM x GROUP BY 1, 2),
g AS (SELECT l AS label, p AS pred FROM (SELECT unnest([0, 1, 2, 3]) AS l), (SELECT unnest([0, 1, 2, 3]) AS p))
SELECT label, pred, coalesce(n, 0) AS n, {rd('coalesce(n / nullif(sum(n) OVER (PARTITION BY label), 0), 0)', 'share')}
FROM g LEFT JOIN c USING (label, pred)""")
def _confusion(spark, d):
    return rounded(M.confusion_matrix(_multi(spark, d), [0, 1, 2, 3]))


@query("classification_report", f"""WITH {PACKETS_SQL}, x AS ({_CLASSES}),
c AS (SELECT unnest([0, 1, 2]) AS class), s AS (SELECT class,
  (SELECT count(*) FROM x WHERE label = class) AS support, (SELECT count(*) FROM x WHERE pred = class) AS preds,
  (SELECT count(*) FROM x WHERE pred = class AND label = class) AS tp FROM c),
r AS (SELECT CAST(class AS VARCHAR) AS class, coalesce(tp / nullif(preds, 0), 0) AS precision,
  coalesce(tp / nullif(support, 0), 0) AS recall, 2 * tp / (preds + support) AS f1, support FROM s),
a AS (SELECT * FROM r UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM r
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support) FROM r)
SELECT class, {rd('precision', 'precision')}, {rd('recall', 'recall')}, {rd('f1', 'f1')}, CAST(support AS BIGINT) AS support FROM a""")
def _report(spark, d):
    return rounded(M.classification_report(_multi(spark, d)))


_AUC = """a AS (SELECT {keys} sum(CASE WHEN label = 1 THEN r END) AS s, count(*) FILTER (WHERE label = 1) AS p,
  count(*) FILTER (WHERE label = 0) AS n FROM (SELECT *, rank() OVER ({part} ORDER BY score)
    + (count(*) OVER ({part2} score) - 1) / 2.0 AS r FROM predictions) {group})"""


@query("roc_auc", f"""WITH {PREDICTIONS_SQL}, {_AUC.format(keys='', part='', part2='PARTITION BY', group='')}
SELECT {rd('CASE WHEN p * n > 0 THEN (s - p * (p + 1) / 2) / (p * n) ELSE 0 END', 'auc')} FROM a""")
def _auc(spark, d):
    return rounded(M.auc(predictions(spark, d)))


@query("roc_auc_by_user", f"""WITH {PREDICTIONS_SQL}, {_AUC.format(
    keys='user_id,', part='PARTITION BY user_id', part2='PARTITION BY user_id,', group='GROUP BY user_id')}
SELECT user_id, {rd('CASE WHEN p * n > 0 THEN (s - p * (p + 1) / 2) / (p * n) ELSE 0 END', 'auc')} FROM a""")
def _auc_user(spark, d):
    return rounded(M.auc(predictions(spark, d), ["user_id"]))


_CURVE = """g AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
  FROM predictions GROUP BY score),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g
  WINDOW w AS (ORDER BY score DESC))"""


@query("roc_curve", f"WITH {PREDICTIONS_SQL}, {_CURVE} SELECT {rd('score', 'threshold')}, {rd('fp / n', 'fpr')}, {rd('tp / p', 'tpr')} FROM c")
def _roc(spark, d):
    return rounded(M.roc_curve(predictions(spark, d)))


@query("pr_curve", f"""WITH {PREDICTIONS_SQL}, {_CURVE} SELECT {rd('score', 'threshold')}, {rd('tp / (tp + fp)', 'precision')},
  {rd('tp / p', 'recall')}, {rd('pos / p', 'gained')} FROM c""")
def _pr(spark, d):
    return rounded(M.pr_curve(predictions(spark, d)))


@query("average_precision", f"WITH {PREDICTIONS_SQL}, {_CURVE} SELECT {rd('sum(pos / p * (tp / (tp + fp)))', 'average_precision')} FROM c")
def _ap(spark, d):
    return rounded(M.average_precision(predictions(spark, d)))


_SWEEP = f"""t AS (SELECT i, [{', '.join(map(str, M.THRESHOLDS))}][i]::DOUBLE AS threshold FROM (SELECT unnest(range(1, 17))::INT AS i)),
s AS (SELECT i, threshold, count(*) FILTER (WHERE label = 1 AND score >= threshold) AS tp,
  count(*) FILTER (WHERE label = 0 AND score >= threshold) AS fp, count(*) FILTER (WHERE label = 0 AND score < threshold) AS tn,
  count(*) FILTER (WHERE label = 1 AND score < threshold) AS fn FROM t, predictions GROUP BY 1, 2),
f AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM s)"""


@query("threshold_sweep", f"WITH {PREDICTIONS_SQL}, {_SWEEP} SELECT i, {rd('threshold', 'threshold')}, tp, fp, tn, fn, {rd('f1', 'f1')} FROM f")
def _sweep(spark, d):
    return rounded(M.threshold_sweep(predictions(spark, d)))


@query("best_threshold", f"""WITH {PREDICTIONS_SQL}, {_SWEEP}
SELECT {rd('CASE WHEN f1 > 0 THEN threshold ELSE 0.5 END', 'threshold')}, {rd('f1', 'f1')} FROM f ORDER BY f.f1 DESC, i LIMIT 1""")
def _best(spark, d):
    return rounded(M.best_threshold(predictions(spark, d)))


# Metric tables: one "model" per user, scored on that user's rows.
_MODELS = f"""{PREDICTIONS_SQL}, c AS (SELECT 'm' || user_id AS model_type, {_COUNTS}, max(ts_us) AS ts_us FROM predictions GROUP BY 1),
m AS (SELECT model_type, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c)"""


def model_metrics(spark, d):
    p = predictions(spark, d).withColumn("model_type", F.concat(F.lit("m"), F.col("user_id").cast("string")))
    return M.binary_metrics(p, ["model_type"])


@query("model_ranking", f"WITH {_MODELS} SELECT model_type, {rd('f1', 'f1')}, row_number() OVER (ORDER BY m.f1 DESC, model_type) AS rank FROM m")
def _ranking(spark, d):
    ranked = M.rank_models(model_metrics(spark, d)).select("model_type", "f1", F.col("rank").cast("bigint").alias("rank"))
    return rounded(ranked)


_IMPORTANCE = f"{PACKETS_SQL}, i AS (SELECT 'f' || (k % 15) AS feature, avg(length / 1000.0) AS importance FROM packets GROUP BY 1)"


def importances(spark, d):
    return packets(spark, d).select(
        F.concat(F.lit("f"), (F.col("k") % 15).cast("string")).alias("feature"), (F.col("length") / 1000.0).alias("importance")
    )


@query("importance_ranking", f"WITH {_IMPORTANCE} SELECT feature, {rd('importance', 'importance')} FROM i ORDER BY i.importance DESC, feature LIMIT 5")
def _top_importance(spark, d):
    return rounded(M.importance_ranking(importances(spark, d), 5))


@query("metrics_long", f"""WITH {_MODELS} SELECT model_type, metric, {rd('value', 'value')} FROM (
  UNPIVOT (SELECT * FROM m) ON precision, recall, f1 INTO NAME metric VALUE value)""")
def _long(spark, d):
    return rounded(M.metrics_long(model_metrics(spark, d).select("model_type", "precision", "recall", "f1"),
                                  ["model_type"], ["precision", "recall", "f1"]))


@query("metrics_wide", f"WITH {_MODELS} SELECT model_type, {rd('precision', 'precision')}, {rd('recall', 'recall')}, {rd('f1', 'f1')} FROM m")
def _wide(spark, d):
    names = ["precision", "recall", "f1"]
    long = M.metrics_long(model_metrics(spark, d).select("model_type", *names), ["model_type"], names)
    return rounded(M.metrics_wide(long, "model_type", "metric", "value", names))


_REPORTS = f"""{PREDICTIONS_SQL}, c AS (SELECT 'p' || protocol AS model_type, ts_us // 86400000000 AS ts_us, {_COUNTS}
  FROM predictions GROUP BY 1, 2),
r AS (SELECT model_type, ts_us, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c)"""


def daily_reports(spark, d):
    p = predictions(spark, d).withColumns({
        "model_type": F.concat(F.lit("p"), F.col("protocol").cast("string")), "ts_us": F.expr("ts_us DIV 86400000000"),
    })
    return M.binary_metrics(p, ["model_type", "ts_us"])


@query("report_improvement", f"""WITH {_REPORTS} SELECT model_type, ts_us, {rd('f1', 'f1')},
  {rd('f1 - lag(f1) OVER (PARTITION BY model_type ORDER BY ts_us)', 'gain')} FROM r""")
def _improvement(spark, d):
    return rounded(M.improvements(daily_reports(spark, d)).select("model_type", "ts_us", "f1", "gain"))
