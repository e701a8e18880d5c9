"""Alerts, throttling and report datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import alerts as L
from flowlens.operators import host, reports
from flowlens.operators.detect import detect
from flowlens.plans.registry import DAY, HOUR, query, rd, rounded
from flowlens.sources.adapters import PACKETS_SQL, PREDICTIONS_SQL, SCORED_SQL, detections, packets, scored_flows


@query("alert_candidates", f"""WITH {SCORED_SQL} SELECT anomaly_id, anomaly_type, {rd('anomaly_score', 'anomaly_score')}
FROM detections WHERE detections.anomaly_score >= 0.7""")
def _candidates(spark, d):
    return rounded(L.alert_candidates(detect(scored_flows(spark, d))).select("anomaly_id", "anomaly_type", "anomaly_score"))


def _greedy_sql(interval: int) -> str:
    """One jump per recursion step: the first alert at least one interval after the last one sent."""
    return f"""WITH RECURSIVE {SCORED_SQL},
a AS (SELECT anomaly_type, ts_us, min(anomaly_id) AS anomaly_id FROM detections WHERE anomaly_score >= 0.7 GROUP BY 1, 2),
n AS (SELECT x.anomaly_type, x.ts_us, min(y.ts_us) AS nxt FROM a x LEFT JOIN a y
  ON x.anomaly_type = y.anomaly_type AND y.ts_us >= x.ts_us + {interval} GROUP BY 1, 2),
sent AS (SELECT anomaly_type, min(ts_us) AS ts_us FROM a GROUP BY 1
  UNION ALL SELECT s.anomaly_type, n.nxt FROM sent s JOIN n ON n.anomaly_type = s.anomaly_type AND n.ts_us = s.ts_us
    WHERE n.nxt IS NOT NULL)
SELECT anomaly_type, ts_us, anomaly_id FROM sent JOIN a USING (anomaly_type, ts_us)"""


def _throttled(interval):
    def build(spark, d):
        found = L.alert_candidates(detect(scored_flows(spark, d)))
        return L.sent_alerts(found, interval_us=interval).select("anomaly_type", "ts_us", "anomaly_id")
    return build


query("alert_throttle", _greedy_sql(6 * HOUR))(_throttled(6 * HOUR))
query("alert_throttle_short", _greedy_sql(HOUR // 2))(_throttled(HOUR // 2))


@query("detection_summary", f"""WITH {SCORED_SQL}
SELECT CAST(sum(packet_count) AS BIGINT) AS total_packets, count(*) AS total_sessions,
  count(*) FILTER (WHERE is_anomaly) AS anomalies_detected,
  {rd('100.0 * count(*) FILTER (WHERE is_anomaly) / count(*)', 'anomaly_rate')} FROM detections""")
def _summary(spark, d):
    return rounded(reports.summary(detections(spark, d)))


@query("anomalies_over_time", f"""WITH {SCORED_SQL},
c AS (SELECT ts_us // {HOUR} AS h, count(*) FILTER (WHERE is_anomaly) AS a, count(*) FILTER (WHERE NOT is_anomaly) AS n
  FROM detections GROUP BY 1),
g AS (SELECT unnest(range((SELECT min(h) FROM c), (SELECT max(h) FROM c) + 1)) AS h)
SELECT h * {HOUR} AS interval_start_us, coalesce(a, 0) AS anomalies, coalesce(n, 0) AS normals FROM g LEFT JOIN c USING (h)""")
def _over_time(spark, d):
    return reports.counts_over_time(detections(spark, d))


@query("protocol_distribution", f"""WITH {PACKETS_SQL} SELECT protocol, count(*) AS n,
  {rd('100.0 * count(*) / sum(count(*)) OVER ()', 'percent')} FROM packets GROUP BY protocol""")
def _distribution(spark, d):
    return rounded(reports.protocol_distribution(packets(spark, d)))


@query("score_histogram", f"""WITH {SCORED_SQL},
b AS (SELECT is_anomaly, min(anomaly_score) AS lo, max(anomaly_score) AS hi FROM detections GROUP BY 1),
x AS (SELECT is_anomaly, CAST(least(floor((anomaly_score - lo) / ((hi - lo) / 50)), 49) AS INT) AS bin, lo, hi
  FROM detections JOIN b USING (is_anomaly))
SELECT is_anomaly, bin, {rd('lo + bin * (hi - lo) / 50', 'bin_start')}, count(*) AS n FROM x GROUP BY is_anomaly, bin, lo, hi""")
def _histogram(spark, d):
    return rounded(reports.score_histogram(detections(spark, d)))


@query("top_anomalies", f"""WITH {SCORED_SQL} SELECT session_id, ts_us, {rd('anomaly_score', 'anomaly_score')}, anomaly_type
FROM detections WHERE is_anomaly ORDER BY detections.anomaly_score DESC, ts_us, session_id LIMIT 10""")
def _top(spark, d):
    return rounded(reports.top_anomalies(detections(spark, d)).select("session_id", "ts_us", "anomaly_score", "anomaly_type"))


@query("report_last_day", f"""WITH {SCORED_SQL} SELECT anomaly_id, ts_us FROM detections
WHERE ts_us >= (SELECT max(ts_us) FROM detections) - {DAY}""")
def _last_day(spark, d):
    return reports.last_hours(detections(spark, d), 24).select("anomaly_id", "ts_us")


_START, _END = 1_704_700_000_000_000, 1_705_900_000_000_000


@query("report_time_range", f"WITH {SCORED_SQL} SELECT anomaly_id, ts_us FROM detections WHERE ts_us BETWEEN {_START} AND {_END}")
def _range(spark, d):
    return reports.in_range(detections(spark, d), _START, _END).select("anomaly_id", "ts_us")


@query("top_addresses", f"""WITH {SCORED_SQL},
s AS (SELECT 'src' AS side, src_ip AS ip FROM detections WHERE is_anomaly UNION ALL SELECT 'dst', dst_ip FROM detections WHERE is_anomaly),
c AS (SELECT side, ip, count(*) AS n FROM s GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY n DESC, ip) AS rank FROM c)
SELECT side, ip, n, rank FROM r WHERE rank <= 10""")
def _addresses(spark, d):
    return reports.top_addresses(detections(spark, d)).withColumn("rank", F.col("rank").cast("bigint"))


@query("alert_severity", f"""WITH {SCORED_SQL} SELECT CASE WHEN anomaly_score >= 0.9 THEN 'critical' WHEN anomaly_score >= 0.7 THEN 'high'
  WHEN anomaly_score >= 0.4 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n FROM detections GROUP BY 1""")
def _severity(spark, d):
    grade = reports.severity("anomaly_score", [(0.4, "medium"), (0.7, "high"), (0.9, "critical")], "low")
    return detections(spark, d).groupBy(grade.alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("evaluation_report", f"""WITH {PREDICTIONS_SQL},
c AS (SELECT 'p' || protocol AS model_type, ts_us // {DAY} AS ts_us, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp,
  count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn,
  count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn FROM predictions GROUP BY 1, 2)
SELECT model_type, ts_us, {rd('(tp + tn) / (tp + fp + tn + fn)', 'accuracy')}, {rd('coalesce(tp / nullif(tp + fp, 0), 0)', 'precision')},
  {rd('coalesce(tp / nullif(tp + fn, 0), 0)', 'recall')}, {rd('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)', 'f1_score')},
  tn AS true_negative, fp AS false_positive, fn AS false_negative, tp AS true_positive
FROM c WHERE ts_us BETWEEN 19725 AND 19740 ORDER BY ts_us DESC, model_type LIMIT 1""")
def _evaluation(spark, d):
    from flowlens.plans.metrics import daily_reports

    cells = F.array(F.array("tn", "fp"), F.array("fn", "tp"))
    return rounded(reports.evaluation_report(daily_reports(spark, d).withColumn("confusion", cells), 19725, 19740))


@query("counter_rates", f"""WITH {PACKETS_SQL},
s AS (SELECT user_id, ts_us, packet_id AS sample_id, sum(length) OVER w AS bytes_total, count(*) OVER w AS packets_total
  FROM packets WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, packet_id ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, lag(ts_us) OVER w AS t0, lag(bytes_total) OVER w AS b0, lag(packets_total) OVER w AS p0 FROM s
  WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, sample_id))
SELECT user_id, sample_id, {rd('(bytes_total - b0) / CASE WHEN ts_us > t0 THEN (ts_us - t0) / 1e6 ELSE 0.1 END', 'bytes_total_rate')},
  {rd('(packets_total - p0) / CASE WHEN ts_us > t0 THEN (ts_us - t0) / 1e6 ELSE 0.1 END', 'packets_total_rate')} FROM l""")
def _rates(spark, d):
    from flowlens.operators.scale import running_totals

    p = packets(spark, d).withColumn("slice", F.expr(f"ts_us DIV {DAY}"))
    totals = running_totals(p, ["user_id"], "slice", ["ts_us", "packet_id"],
                            {"bytes_total": F.col("length").cast("bigint"), "packets_total": F.lit(1)})
    samples = totals.select("user_id", "ts_us", F.col("packet_id").alias("sample_id"), "bytes_total", "packets_total")
    out = host.counter_rates(samples, "user_id", ["bytes_total", "packets_total"], chunk_us=DAY)
    return rounded(out.select("user_id", "sample_id", "bytes_total_rate", "packets_total_rate"))


@query("threshold_alarms", f"""WITH {PACKETS_SQL} SELECT packet_id, alarm FROM (
  SELECT packet_id, 'cpu' AS alarm FROM packets WHERE k > 80 UNION ALL SELECT packet_id, 'memory' FROM packets WHERE length > 85)""")
def _alarms(spark, d):
    s = packets(spark, d).select("packet_id", F.col("k").cast("double").alias("cpu"), F.col("length").cast("double").alias("memory"))
    return host.alarms(s).select("packet_id", "alarm")


