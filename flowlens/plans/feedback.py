"""Feedback joined to detections and the metrics drawn from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import feedback as G
from flowlens.plans.registry import query, rd, rounded
from flowlens.sources import adapters as A
from flowlens.sources.adapters import FEEDBACK_SQL


def judged(spark, d):
    return G.attach(A.feedback(spark, d), A.detections(spark, d))[0]


@query("feedback_attached", f"""WITH {FEEDBACK_SQL}
SELECT feedback_id, anomaly_id, protocol, {rd('anomaly_score', 'anomaly_score')}, is_anomaly, is_correct, outcome FROM judged""")
def _attached(spark, d):
    rows = judged(spark, d).withColumn("outcome", G.outcome())
    return rounded(rows.select("feedback_id", "anomaly_id", "protocol", "anomaly_score", "is_anomaly", "is_correct", "outcome"))


@query("feedback_rejected", f"""WITH {FEEDBACK_SQL}
SELECT feedback_id, anomaly_id FROM feedback ANTI JOIN detections USING (anomaly_id)""")
def _rejected(spark, d):
    return G.attach(A.feedback(spark, d), A.detections(spark, d))[1].select("feedback_id", "anomaly_id")


_CELLS = ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in ("tp", "fp", "tn", "fn"))
_RATES = {
    "precision": "coalesce(tp / nullif(tp + fp, 0), 0)", "recall": "coalesce(tp / nullif(tp + fn, 0), 0)",
    "f1": "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)", "fpr": "coalesce(fp / nullif(fp + tn, 0), 0)",
    "accuracy": "(tp + tn) / (tp + fp + tn + fn)",
}
_FEATURES = f"""{FEEDBACK_SQL},
named AS (SELECT outcome, unnest(list_filter(['packet_count', CASE WHEN fk % 2 = 0 THEN 'byte_count' END,
  CASE WHEN fk < 30 THEN 'payload_entropy' END], lambda x: x IS NOT NULL)) AS feature FROM judged),
fc AS (SELECT feature, {_CELLS} FROM named GROUP BY feature),
fm AS (SELECT *, {', '.join(f'{_RATES[m]} AS {m}' for m in ('precision', 'recall', 'f1', 'fpr'))}, tp + fp + tn + fn AS total FROM fc)"""
_PROTOCOLS = f"""{FEEDBACK_SQL},
pc AS (SELECT CAST(protocol AS VARCHAR) AS protocol, {_CELLS} FROM judged GROUP BY protocol)"""


def _rates(*names):
    return ", ".join(rd(_RATES[n], n) for n in names)


@query("feedback_protocol_counts", f"WITH {_PROTOCOLS} SELECT * FROM pc")
def _protocol_counts(spark, d):
    return G.protocol_counts(judged(spark, d))


@query("feedback_feature_counts", f"WITH {_FEATURES} SELECT * FROM fc")
def _feature_counts(spark, d):
    return G.feature_counts(judged(spark, d))


@query("feedback_feature_metrics", f"WITH {_FEATURES} SELECT feature, tp, fp, tn, fn, {_rates('precision', 'recall', 'f1', 'fpr')}, total FROM fm")
def _feature_metrics(spark, d):
    return rounded(G.feature_metrics(judged(spark, d)))


@query("feedback_low_features", f"WITH {_FEATURES} SELECT feature, {_rates('f1')}, total FROM fm WHERE f1 < 0.9 AND total > 10")
def _low(spark, d):
    return rounded(G.low_features(G.feature_metrics(judged(spark, d)), 0.9).select("feature", "f1", "total"))


@query("feedback_protocol_metrics", f"""WITH {_PROTOCOLS} SELECT protocol, tp, fp, tn, fn,
  {_rates('precision', 'recall', 'f1', 'accuracy')}, tp + fp + tn + fn AS total FROM pc""")
def _protocol_metrics(spark, d):
    return rounded(G.protocol_metrics(judged(spark, d)))


@query("feedback_overall_metrics", f"""WITH {_PROTOCOLS},
r AS (SELECT CASE WHEN grouping(protocol) = 1 THEN 'all' ELSE protocol END AS protocol, CAST(sum(tp) AS BIGINT) AS tp,
  CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fn) AS BIGINT) AS fn FROM pc GROUP BY ROLLUP (protocol))
SELECT protocol, tp, fp, tn, fn, {_rates('precision', 'recall', 'f1', 'accuracy')} FROM r""")
def _overall(spark, d):
    return rounded(G.overall_metrics(judged(spark, d)))


@query("feature_switches", f"""WITH {_FEATURES} SELECT feature, CASE WHEN fpr > 0.8 AND total > 50 THEN 'disable'
  WHEN fpr < 0.2 AND f1 > 0.7 AND feature = 'byte_count' THEN 'enable' ELSE 'keep' END AS decision FROM fm""")
def _switches(spark, d):
    return G.switch_by_performance(G.feature_metrics(judged(spark, d)), ["byte_count"]).select("feature", "decision")


@query("importance_switches", f"""WITH {A.PACKETS_SQL},
i AS (SELECT 'f' || (user_id % 40) AS feature, (avg(k) - 45) / 100 AS importance FROM packets GROUP BY 1)
SELECT feature, CASE WHEN importance < 0.001 AND feature NOT IN ('f1', 'f2', 'f3') THEN 'disable'
  WHEN importance > 0.05 AND feature IN ('f1', 'f2', 'f3') THEN 'enable' ELSE 'keep' END AS decision FROM i""")
def _importance(spark, d):
    p = A.packets(spark, d).groupBy(F.concat(F.lit("f"), (F.col("user_id") % 40).cast("string")).alias("feature"))
    table = p.agg(((F.avg("k") - 45) / 100).alias("importance"))
    return G.switch_by_importance(table, ["f1", "f2", "f3"]).select("feature", "decision")


@query("latest_feedback", f"""WITH {FEEDBACK_SQL},
x AS (SELECT feedback_id, feedback_us // 86400000000 AS dt, feedback_us FROM feedback),
y AS (SELECT *, dense_rank() OVER (ORDER BY dt DESC) AS dr,
  row_number() OVER (PARTITION BY dt ORDER BY feedback_us DESC, feedback_id DESC) AS rn FROM x)
SELECT feedback_id, dt, rn FROM y WHERE dr <= 10 AND rn <= 5""")
def _latest(spark, d):
    f = A.feedback(spark, d).select("feedback_id", F.expr("feedback_us DIV 86400000000").alias("dt"),
                                    F.col("feedback_us").alias("ts_us"))
    return G.latest_feedback(f).select("feedback_id", "dt", F.col("rn").cast("bigint").alias("rn"))
