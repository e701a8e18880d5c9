"""Model selection and retraining decisions over metric tables drawn from the feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import decisions as K
from flowlens.operators import metrics as M
from flowlens.plans.registry import DAY, query, rd, rounded
from flowlens.sources.adapters import PACKETS_SQL, PREDICTIONS_SQL, packets, predictions

SINCE = 1_704_700_000_000_000
NOW = 1_706_600_000_000_000
_COUNTS = """count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
  count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) AS sample_count"""
_MODEL = "CASE user_id % 4 WHEN 0 THEN 'xgboost' WHEN 1 THEN 'random_forest' WHEN 2 THEN 'mlp' ELSE 'lstm' END"
_RUNS = f"""{PREDICTIONS_SQL},
c AS (SELECT CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'udp' ELSE 'icmp' END AS protocol, {_MODEL} AS model_type,
  ts_us // {DAY} AS ts_us, {_COUNTS} FROM predictions GROUP BY 1, 2, 3),
runs AS (SELECT protocol, model_type, ts_us, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
  coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, sample_count FROM c)"""


def runs(spark, d):
    """One metric row per protocol, model and day."""
    p = predictions(spark, d).withColumns({
        "model_type": F.when(F.col("user_id") % 4 == 0, "xgboost").when(F.col("user_id") % 4 == 1, "random_forest")
        .when(F.col("user_id") % 4 == 2, "mlp").otherwise("lstm"),
        "protocol": F.when(F.col("protocol") == 6, "TCP").when(F.col("protocol") == 17, "udp").otherwise("icmp"),
        "ts_us": F.expr(f"ts_us DIV {DAY}"),
    })
    return M.binary_metrics(p, ["protocol", "model_type", "ts_us"]).withColumnRenamed("support", "sample_count")


@query("new_data_trigger", f"""WITH {PACKETS_SQL} SELECT coalesce(CAST(protocol AS VARCHAR), 'general') AS scope, count(*) AS n,
  count(*) >= 2000 AS train FROM packets WHERE ts_us > {SINCE} GROUP BY ROLLUP (protocol)""")
def _trigger(spark, d):
    return K.new_data_trigger(packets(spark, d), SINCE, 2000)


@query("training_window", f"WITH {PACKETS_SQL} SELECT packet_id FROM packets WHERE ts_us BETWEEN {NOW - 7 * DAY} AND {NOW}")
def _window(spark, d):
    return K.training_window(packets(spark, d), NOW, 7).select("packet_id")


_LATEST = f"""{_RUNS}, latest AS (SELECT lower(protocol) AS protocol, model_type, f1, precision, recall, sample_count, ts_us FROM runs
  QUALIFY row_number() OVER (PARTITION BY lower(protocol), model_type ORDER BY ts_us DESC) = 1)"""


@query("latest_performance", f"WITH {_LATEST} SELECT protocol, model_type, ts_us, {rd('f1', 'f1')}, sample_count FROM latest")
def _latest(spark, d):
    return rounded(K.latest_performance(runs(spark, d)).select("protocol", "model_type", "ts_us", "f1", "sample_count"))


_SELECT = f"""{_LATEST},
pref AS (SELECT * FROM (VALUES (6, 'tcp', 0, 'lstm'), (6, 'tcp', 1, 'xgboost'), (6, 'tcp', 2, 'random_forest'),
  (17, 'udp', 0, 'xgboost'), (17, 'udp', 1, 'random_forest'), (17, 'udp', 2, 'logistic_regression'),
  (1, 'icmp', 0, 'random_forest'), (1, 'icmp', 1, 'xgboost'), (1, 'icmp', 2, 'logistic_regression')) t(number, protocol, pos, model_type)),
scored AS (SELECT number, protocol, pos, model_type, f1 * least(sample_count / 30.0, 1.0) AS score FROM pref LEFT JOIN latest USING (protocol, model_type)),
best AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY score DESC NULLS LAST, pos) AS rn FROM scored)"""


@query("model_selection", f"""WITH {_SELECT}
SELECT number, protocol, CASE WHEN score >= 0.1 THEN model_type ELSE (SELECT p.model_type FROM pref p WHERE p.number = best.number AND pos = 0) END AS model_type,
  {rd('coalesce(score, 0)', 'score')} FROM best WHERE rn = 1""")
def _select(spark, d):
    history = K.latest_performance(runs(spark, d))
    # A day of one model's rows stands for a training set; thirty rows count as full confidence.
    history = history.withColumn("sample_count", F.col("sample_count") * F.lit(1000.0) / 30)
    protocols = packets(spark, d).groupBy("protocol").agg(F.lit(1).alias("one"))
    return rounded(K.select_models(protocols, history))


_INCREMENTS = f"""{_RUNS}, inc AS (SELECT protocol, model_type, ts_us, coalesce(lag(f1) OVER w, f1) AS initial_f1, f1 AS final_f1 FROM runs
  WINDOW w AS (PARTITION BY protocol, model_type ORDER BY ts_us)),
drops AS (SELECT *, initial_f1 - final_f1 AS performance_drop FROM inc)"""


def increments(spark, d):
    gains = M.improvements(runs(spark, d), ["protocol", "model_type"])
    return gains.select(
        "protocol", "model_type", "ts_us", (F.col("f1") - F.coalesce("gain", F.lit(0.0))).alias("initial_f1"), F.col("f1").alias("final_f1")
    )


@query("performance_drops", f"WITH {_INCREMENTS} SELECT protocol, model_type, ts_us, {rd('performance_drop', 'performance_drop')}, performance_drop > 0.1 AS dropped FROM drops")
def _drops(spark, d):
    return rounded(K.performance_drops(increments(spark, d)).select("protocol", "model_type", "ts_us", "performance_drop", "dropped"))


@query("full_retrain", f"""WITH {_INCREMENTS}, r AS (SELECT * FROM drops QUALIFY row_number() OVER (PARTITION BY protocol, model_type ORDER BY ts_us DESC) <= 3)
SELECT protocol, model_type, count(*) FILTER (WHERE performance_drop > 0.1) AS large_drops,
  count(*) FILTER (WHERE performance_drop > 0.1) >= 2 OR model_type = 'lstm' AS retrain FROM r GROUP BY 1, 2""")
def _retrain(spark, d):
    rows = K.performance_drops(increments(spark, d)).withColumn(
        "last_full_us", F.when(F.col("model_type") == "lstm", NOW - 8 * DAY).otherwise(NOW - 2 * DAY)
    )
    return K.full_retrain(rows, NOW).select("protocol", "model_type", "large_drops", "retrain")


_IMPORTANCE = f"""{PACKETS_SQL}, i AS (SELECT protocol, 'f' || (k % 12) AS feature, (avg(length) - 70) / 100 AS importance FROM packets GROUP BY 1, 2)"""


def importances(spark, d):
    return packets(spark, d).groupBy("protocol", F.concat(F.lit("f"), (F.col("k") % 12).cast("string")).alias("feature")).agg(
        ((F.avg("length") - 70) / 100).alias("importance")
    )


@query("importance_lists", f"""WITH {_IMPORTANCE} SELECT protocol,
  coalesce(string_agg(feature, ',' ORDER BY importance DESC, feature) FILTER (WHERE importance < 0.01), '') AS low_features,
  coalesce(string_agg(feature, ',' ORDER BY importance DESC, feature) FILTER (WHERE importance > 0.1), '') AS high_features,
  count(*) AS features FROM i GROUP BY 1""")
def _lists(spark, d):
    s = K.importance_summary(importances(spark, d), ["protocol"])
    return s.select("protocol", F.array_join("low_features", ",").alias("low_features"),
                    F.array_join("high_features", ",").alias("high_features"), "features")


@query("recommendations", f"""WITH {_RUNS},
x AS (SELECT *, 'random_forest' AS better_model, 0.5 AS threshold FROM runs)
SELECT protocol, model_type, ts_us,
  CASE WHEN f1 < 0.3 AND model_type <> 'random_forest' THEN 'random_forest' WHEN f1 < 0.4 THEN 'ensemble' END AS change_model_to,
  {rd('CASE WHEN precision - recall > 0.1 THEN 0.45 WHEN recall - precision > 0.1 THEN 0.55 END', 'new_threshold')},
  CASE WHEN precision - recall > 0.1 THEN 'conservative' WHEN recall - precision > 0.1 THEN 'aggressive' END AS balance,
  CASE WHEN f1 < 0.3 AND model_type IN ('mlp', 'lstm') THEN 'double_units' WHEN f1 > 0.7 AND model_type = 'mlp' THEN 'drop_last_layer' END AS complexity
FROM x""")
def _recommend(spark, d):
    m = runs(spark, d).withColumns({"better_model": F.lit("random_forest"), "threshold": F.lit(0.5)})
    return rounded(K.recommendations(m).select(
        "protocol", "model_type", "ts_us", "change_model_to", "new_threshold", "balance", "complexity"))


@query("feature_advice", f"""WITH {PACKETS_SQL}, i AS (SELECT protocol, 'f' || (k % 12) AS feature, max(k % 12) * protocol / 1300.0::DOUBLE AS importance FROM packets GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY protocol ORDER BY importance DESC, feature) AS rn FROM i),
g AS (SELECT protocol, count(*) FILTER (WHERE importance < 0.01) > count(*) * 0.5 AS many,
  string_agg(feature, ',' ORDER BY rn) FILTER (WHERE rn <= 5) AS top, string_agg(feature, ',' ORDER BY rn) FILTER (WHERE importance < 0.01) AS low FROM r GROUP BY 1)
SELECT protocol, CASE WHEN many THEN top END AS keep_features, CASE WHEN many THEN low END AS remove_features FROM g""")
def _feature_advice(spark, d):
    weights = packets(spark, d).groupBy("protocol", F.concat(F.lit("f"), (F.col("k") % 12).cast("string")).alias("feature")).agg(
        (F.max(F.col("k") % 12) * F.col("protocol") / F.lit(1300.0)).alias("importance")
    )
    judged = K.importance_summary(weights, ["protocol"]).withColumns({
        "model_type": F.lit("random_forest"), "better_model": F.lit("random_forest"), "threshold": F.lit(0.5),
        "f1": F.lit(0.5), "precision": F.lit(0.5), "recall": F.lit(0.5),
    })
    return K.recommendations(judged).select(
        "protocol", F.array_join("keep_features", ",").alias("keep_features"), F.array_join("remove_features", ",").alias("remove_features"))


@query("low_metrics", f"""WITH {_RUNS} SELECT protocol, model_type, ts_us, metric, {rd('value', 'value')}, value < 0.7 * 0.7 AS very_low FROM (
  UNPIVOT (SELECT protocol, model_type, ts_us, f1, precision, recall FROM runs) ON f1, precision, recall INTO NAME metric VALUE value) u
WHERE u.value < 0.7""")
def _low(spark, d):
    return rounded(K.low_metrics(runs(spark, d), ["protocol", "model_type", "ts_us"]))


@query("training_progress", f"""WITH {_RUNS},
g AS (SELECT protocol, model_type, ts_us AS iteration, f1, f1 - lag(f1) OVER w AS gain FROM runs WINDOW w AS (PARTITION BY protocol, model_type ORDER BY ts_us)),
s AS (SELECT *, f1 >= 0.9 OR coalesce(gain < 0.01, false) AS stop, f1 < 0.75 AS retrain FROM g)
SELECT protocol, model_type, iteration, {rd('f1', 'f1')}, stop, retrain, stop AND NOT coalesce(bool_or(stop) OVER (
  PARTITION BY protocol, model_type ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS first_stop FROM s""")
def _progress(spark, d):
    it = runs(spark, d).withColumnRenamed("ts_us", "iteration")
    out = K.training_progress(it, ["protocol", "model_type"])
    return rounded(out.select("protocol", "model_type", "iteration", "f1", "stop", "retrain", "first_stop"))


@query("champion_challenger", f"""WITH {PREDICTIONS_SQL},
p AS (SELECT protocol, label, pred AS champion, CASE WHEN score >= 0.8 THEN 1 ELSE 0 END AS challenger FROM predictions),
c AS (SELECT protocol, count(*) FILTER (WHERE champion = label AND challenger <> label) AS champion_only,
  count(*) FILTER (WHERE champion <> label AND challenger = label) AS challenger_only FROM p GROUP BY 1)
SELECT protocol, champion_only, challenger_only,
  {rd('coalesce(power(abs(champion_only - challenger_only) - 1, 2) / nullif(champion_only + challenger_only, 0), 0)', 'statistic')},
  coalesce(power(abs(champion_only - challenger_only) - 1, 2) / nullif(champion_only + challenger_only, 0), 0) > 3.841
    AND challenger_only > champion_only AS promote FROM c""")
def _champion(spark, d):
    p = predictions(spark, d).select("protocol", "label", F.col("pred").alias("champion"),
                                     (F.col("score") >= 0.8).cast("int").alias("challenger"))
    return rounded(K.champion_challenger(p, ["protocol"]))
