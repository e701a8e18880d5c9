"""Detection over scored flows and session features."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.config import DetectionConfig, RuleConfig
from flowlens.operators import detect as D
from flowlens.operators import sessions as S
from flowlens.operators import temporal as E
from flowlens.operators.stat import stat_features
from flowlens.plans.flows import CFG, ENTROPY_SQL, SESSION_SQL, STAT_SQL, flow_sql
from flowlens.plans.registry import DAY, HOUR, query, rd, rounded, scratch
from flowlens.sources.adapters import PACKETS_SQL, SCORED_SQL, packets, scored_flows

# The feed's sessions are small; these limits make each rule fire on some of them.
RULES = RuleConfig(large_packet=150, high_entropy=3.1, syn_ratio=0.4, syn_min_packets=2)
RULE_CFG = DetectionConfig(mode="rule_only", threshold=0.3, rules=RULES)

_RULE_SQL = f"""{flow_sql()}, {STAT_SQL}, {ENTROPY_SQL},
marked AS (SELECT *, avg_packet_size > 150 AS r1, payload_entropy > 3.1 AS r2,
  packet_count >= 2 AND tcp_syn_count / greatest(packet_count, 1) > 0.4 AS r3 FROM full_stat),
verdict AS (SELECT session_key || '#' || session_seq AS session_id, protocol, packet_count,
  CASE WHEN NOT (r1 OR r2 OR r3) THEN 0.1 ELSE greatest(CASE WHEN r1 THEN 0.8 ELSE 0 END,
    CASE WHEN r2 THEN least(payload_entropy / 10.0, 1.0) ELSE 0 END, CASE WHEN r3 THEN 0.9 ELSE 0 END) END AS anomaly_score,
  CASE WHEN r1 THEN 'large_packet' WHEN r2 THEN 'high_entropy' WHEN r3 THEN 'syn_flood' ELSE 'normal' END AS anomaly_type,
  concat_ws('|', CASE WHEN r1 THEN '大数据包' END, CASE WHEN r2 THEN '高熵' END, CASE WHEN r3 THEN 'SYN Flood' END) AS reasons
  FROM marked)"""


def session_verdicts(spark, d):
    wanted = ["packet_count", "avg_packet_size", "payload_entropy", "tcp_syn_count"]
    return D.detect(stat_features(packets(spark, d), CFG, enabled=wanted), RULE_CFG)


@query("rule_detection", f"""WITH {_RULE_SQL} SELECT session_id, {rd('anomaly_score', 'anomaly_score')},
  anomaly_score >= 0.3 AS is_anomaly, anomaly_type, 'rule_based' AS detection_method, reasons FROM verdict""")
def _rules(spark, d):
    v = session_verdicts(spark, d)
    return rounded(v.select("session_id", "anomaly_score", "is_anomaly", "anomaly_type", "detection_method",
                            F.array_join("reasons", "|").alias("reasons")))


@query("summary_by_protocol", f"""WITH {_RULE_SQL}
SELECT protocol, count(*) AS sessions, CAST(sum(packet_count) AS BIGINT) AS packets,
  count(*) FILTER (WHERE anomaly_score >= 0.3) AS anomalies,
  {rd('100.0 * count(*) FILTER (WHERE anomaly_score >= 0.3) / count(*)', 'anomaly_rate')} FROM verdict GROUP BY protocol""")
def _summary(spark, d):
    v = session_verdicts(spark, d)
    return rounded(v.groupBy("protocol").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("packet_count").cast("bigint").alias("packets"),
        F.count_if("is_anomaly").alias("anomalies"),
        (100.0 * F.count_if("is_anomaly") / F.count(F.lit(1))).alias("anomaly_rate"),
    ))


@query("protocol_thresholds", f"""WITH {SCORED_SQL}
SELECT session_id, limit_used::DOUBLE AS threshold_used, hit AS over FROM rules""")
def _thresholds(spark, d):
    t = scored_flows(spark, d).withColumn("threshold_used", D.protocol_threshold())
    return t.select("session_id", "threshold_used",
                    F.coalesce(F.col("model_score") >= F.col("threshold_used"), F.lit(False)).alias("over"))


@query("anomaly_typing", f"WITH {SCORED_SQL} SELECT session_id, model_type AS anomaly_type FROM rules")
def _typing(spark, d):
    return scored_flows(spark, d).select("session_id", D.anomaly_type().alias("anomaly_type"))


@query("model_only_detection", f"""WITH {SCORED_SQL} SELECT session_id, {rd('coalesce(model_score, 0)', 'anomaly_score')},
  hit AS is_anomaly, CASE WHEN hit THEN model_type ELSE 'normal' END AS anomaly_type FROM rules""")
def _model_only(spark, d):
    v = D.detect(scored_flows(spark, d), DetectionConfig(mode="model_only"))
    return rounded(v.select("session_id", "anomaly_score", "is_anomaly", "anomaly_type"))


@query("hybrid_detection", f"""WITH {SCORED_SQL} SELECT session_id, {rd('anomaly_score', 'anomaly_score')}, is_anomaly,
  anomaly_type, detection_method, threshold_used::DOUBLE AS threshold_used, reasons FROM detections""")
def _hybrid(spark, d):
    v = D.detect(scored_flows(spark, d))
    return rounded(v.select("session_id", "anomaly_score", "is_anomaly", "anomaly_type", "detection_method",
                            "threshold_used", F.array_join("reasons", "|").alias("reasons")))


@query("sigmoid_scores", f"""WITH {SCORED_SQL} SELECT session_id, {rd('1 / (1 + exp(-(k - 50) / 10.0))', 'anomaly_score')} FROM scored""")
def _sigmoid(spark, d):
    return rounded(scored_flows(spark, d).select("session_id", D.sigmoid((F.col("k") - 50) / 10.0).alias("anomaly_score")))


@query("protocol_mode", f"""WITH {PACKETS_SQL} SELECT protocol FROM packets GROUP BY protocol ORDER BY count(*) DESC, protocol LIMIT 1""")
def _mode(spark, d):
    return D.column_mode(packets(spark, d), "protocol")


@query("batch_detection", f"""WITH {SCORED_SQL},
m AS (SELECT protocol AS p FROM packets GROUP BY protocol ORDER BY count(*) DESC, protocol LIMIT 1),
b AS (SELECT *, p AS threshold_protocol, coalesce(model_score >= CASE p WHEN 6 THEN 0.6 WHEN 17 THEN 0.8 WHEN 1 THEN 0.9 ELSE 0.7 END, false) AS over
  FROM rules, m)
SELECT session_id, protocol, threshold_protocol, {rd('greatest(coalesce(model_score, 0), rule_score)', 'anomaly_score')},
  over OR rule_score >= 0.7 AS is_anomaly, CASE WHEN over THEN model_type ELSE rule_type END AS anomaly_type FROM b""")
def _batch(spark, d):
    path = scratch(spark, "flows")
    scored_flows(spark, d).write.parquet(f"{path}/in")
    rows = D.detect_file(spark, f"{path}/in", f"{path}/out")
    return rounded(rows.select("session_id", "protocol", "threshold_protocol", "anomaly_score", "is_anomaly", "anomaly_type"))


_PATTERNS = {"syn_packets": 2, "syn_ratio": 0.3, "scan_ports": 3, "icmp_rate": 1e-5, "packet_rate": 2e-4, "payload_bytes": 300, "ping_requests": 1}


@query("attack_patterns", f"""WITH {PACKETS_SQL},
c AS (SELECT *, unnest(range(ts_us // {4 * HOUR} - 5, ts_us // {4 * HOUR} + 1)) AS w FROM packets),
g AS (SELECT src_ip, w, count(*) AS n, max(length) AS mx, count(*) FILTER (WHERE protocol = 6 AND flags & 2 <> 0) AS syn,
  count(*) FILTER (WHERE protocol = 1) AS icmp, count(*) FILTER (WHERE icmp_type = 8) AS req,
  count(*) FILTER (WHERE icmp_type = 0) AS rep, count(DISTINCT dst_port) AS ports,
  CASE WHEN count(*) < 2 THEN {DAY / 1e6} ELSE greatest((max(ts_us) - min(ts_us)) / 1e6, 0.001) END AS dur FROM c GROUP BY ALL),
p AS (SELECT src_ip, w * {4 * HOUR} AS window_start_us, unnest(list_filter([
  CASE WHEN n > 2 AND syn / n > 0.3 THEN 'syn_flood' END, CASE WHEN ports > 3 THEN 'port_scan' END,
  CASE WHEN icmp / n * (n / dur) > 1e-5 THEN 'icmp_flood' END, CASE WHEN n / dur > 2e-4 THEN 'high_packet_rate' END,
  CASE WHEN mx > 300 THEN 'large_payload' END, CASE WHEN rep > 0 AND req / rep > 2 THEN 'high_request_response_ratio' END,
  CASE WHEN req > 1 THEN 'ping_flood' END
  ], lambda x: x IS NOT NULL)) AS pattern FROM g)
SELECT pattern, count(*) AS windows, count(DISTINCT src_ip) AS hosts FROM p GROUP BY 1""")
def _patterns(spark, d):
    w = E.sliding_features(packets(spark, d), DAY, 4 * HOUR)
    found = D.attack_patterns(w, ["src_ip", "window_start_us"], _PATTERNS)
    per_host = found.groupBy("pattern", "src_ip").agg(F.count(F.lit(1)).alias("n"))
    return per_host.groupBy("pattern").agg(F.sum("n").alias("windows"), F.count(F.lit(1)).alias("hosts"))


@query("protocol_floods", f"""WITH {PACKETS_SQL},
c AS (SELECT *, unnest(range(ts_us // {4 * HOUR} - 5, ts_us // {4 * HOUR} + 1)) AS w FROM packets WHERE protocol = 17)
SELECT src_ip, w * {4 * HOUR} AS window_start_us, 'port_flood' AS pattern FROM c GROUP BY src_ip, w HAVING count(DISTINCT dst_port) > 1""")
def _floods(spark, d):
    return D.protocol_floods(packets(spark, d), DAY, 4 * HOUR, limits={"flood_ports": 1})


@query("session_patterns", f"""WITH {flow_sql()}, {SESSION_SQL},
m AS (SELECT session_key || '#' || session_seq AS session_id, coalesce(avg(winsize) FILTER (WHERE protocol = 6), 0) AS win,
  (count(*) FILTER (WHERE protocol = 6)) - (count(DISTINCT (src_ip, seq)) FILTER (WHERE protocol = 6)) AS again FROM flow GROUP BY session_key, session_seq)
SELECT session_id, unnest(list_filter([CASE WHEN again > 0 THEN 'excessive_retransmissions' END, CASE WHEN win < 30000 THEN 'unusual_window_size' END,
  CASE WHEN duration > 3600 THEN 'long_duration' END], lambda x: x IS NOT NULL)) AS pattern FROM session JOIN m USING (session_id) WHERE protocol = 6""")
def _session_patterns(spark, d):
    p = packets(spark, d)
    rows = S.sessions(p, CFG).join(E.spec_features(p, CFG), "session_id")
    return D.session_patterns(rows, ["session_id"], {"retransmissions": 0, "least_window": 30000})


@query("packet_patterns", f"""WITH {PACKETS_SQL}
SELECT packet_id, CASE WHEN protocol = 17 THEN 'amplification_attack' ELSE 'unusual_flag_combination' END AS pattern FROM packets
WHERE (protocol = 17 AND length > 100) OR (protocol = 6 AND (flags = 0 OR (flags & 2 <> 0 AND flags & 5 <> 0) OR (flags & 1 <> 0 AND flags & 16 = 0)))""")
def _packet_patterns(spark, d):
    return D.packet_patterns(packets(spark, d), {"amplification_bytes": 100})


