"""Streaming operators, run to the end of the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import alerts as L
from flowlens.operators.detect import detect
from flowlens.operators.sessions import sessions, stable_id
from flowlens.plans.alerts import _greedy_sql
from flowlens.plans.flows import CFG, ENTROPY_SQL, SESSION_SQL, STAT_SQL, TIMEOUT, flow_sql
from flowlens.plans.registry import DAY, HOUR, query, rd, rounded, scratch
from flowlens.sources.adapters import FEEDBACK_SQL, PACKETS_SQL, detections, feedback_of, packets, packets_of, scored_of, table
from flowlens.streaming import streams as M


def event_stream(spark, d):
    schema = table(spark, d, "events").schema
    return M.packet_stream(spark, d, schema, glob="events.parquet")


def finished(spark, stream, name):
    base = scratch(spark, name)
    M.run_to_end(stream, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


# A session is closed once the watermark (newest event minus the delay) passes its end plus the timeout.
_CLOSED = f"end_us + {TIMEOUT} <= (SELECT max(ts_us) FROM packets) - {HOUR}"


@query("streamed_sessions", f"""WITH {flow_sql()}, {SESSION_SQL} SELECT session_key, protocol_name, total_packets, total_bytes, start_us, end_us,
  {rd('duration', 'duration')}, tcp_syn_count, tcp_ack_count, tcp_fin_count, tcp_rst_count FROM session WHERE {_CLOSED}""")
def _sessions(spark, d):
    stream = M.stream_sessions(packets_of(event_stream(spark, d)), "12 hours", "1 hour")
    rows = finished(spark, stream, "sessions")
    return rounded(rows.select("session_key", "protocol_name", "total_packets", "total_bytes", "start_us", "end_us", "duration",
                               "tcp_syn_count", "tcp_ack_count", "tcp_fin_count", "tcp_rst_count"))


@query("streamed_windows", f"""WITH {PACKETS_SQL},
c AS (SELECT *, unnest(range(ts_us // {4 * HOUR} - 5, ts_us // {4 * HOUR} + 1)) AS w FROM packets)
SELECT src_ip, w * {4 * HOUR} AS window_start_us, count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS byte_count,
  count(DISTINCT dst_port) AS unique_dest_ports, count(*) FILTER (WHERE protocol = 6 AND flags & 2 <> 0) AS syn_count FROM c GROUP BY src_ip, w
HAVING w * {4 * HOUR} + {DAY} <= (SELECT max(ts_us) FROM packets) - {HOUR}""")
def _windows(spark, d):
    stream = M.stream_windows(packets_of(event_stream(spark, d)), "24 hours", "4 hours", "1 hour")
    return finished(spark, stream, "windows").select(
        "src_ip", "window_start_us", "packet_count", "byte_count", "unique_dest_ports", "syn_count"
    )


@query("streamed_tumbling_windows", f"""WITH {PACKETS_SQL}
SELECT src_ip, ts_us // {DAY} * {DAY} AS window_start_us, count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS byte_count,
  count(DISTINCT dst_port) AS unique_dest_ports FROM packets
GROUP BY 1, 2 HAVING window_start_us + {DAY} <= (SELECT max(ts_us) FROM packets) - {HOUR}""")
def _tumbling(spark, d):
    stream = M.stream_windows(packets_of(event_stream(spark, d)), "24 hours", None, "1 hour")
    return finished(spark, stream, "tumbling").select("src_ip", "window_start_us", "packet_count", "byte_count", "unique_dest_ports")


def flows(spark, d, name, after=lambda sessions: sessions):
    """All sessions of the feed, streamed: those still open at its end are closed by a control row."""
    base = scratch(spark, name)
    control = f"{base}/control"
    stream = after(M.stream_flows(packets_of(event_stream(spark, d)), TIMEOUT, "1 hour", control=M.control_stream(spark, control)))
    M.run_to_end(stream, f"{base}/out", f"{base}/checkpoint")
    M.close_open(spark, control, END)
    M.run_to_end(stream, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


END = 4_102_444_800_000_000  # the year 2100, long after the feed

_FLOWS = f"{flow_sql()}, {SESSION_SQL}, {STAT_SQL}, {ENTROPY_SQL}"


@query("streamed_flows", f"""WITH {_FLOWS} SELECT x.session_key || '@' || x.start_us AS session_id, x.session_id AS batch_id, total_packets, total_bytes, end_us,
  {rd('std_packet_size', 'std_packet_size')}, {rd('payload_entropy', 'payload_entropy')}, x.tcp_syn_count, x.tcp_ack_count, x.tcp_fin_count, x.tcp_rst_count
FROM session x JOIN full_stat USING (session_key, session_seq)""")
def _flows(spark, d):
    """Streamed sessions beside the batch session of the same id."""
    streamed = flows(spark, d, "flows")
    batch = sessions(packets(spark, d), CFG).select(stable_id().alias("session_id"), F.col("session_id").alias("batch_id"))
    return rounded(streamed.join(batch, "session_id", "full").select(
        "session_id", "batch_id", "total_packets", "total_bytes", "end_us", "std_packet_size", "payload_entropy",
        "tcp_syn_count", "tcp_ack_count", "tcp_fin_count", "tcp_rst_count",
    ))


@query("streamed_detections", f"""WITH {_FLOWS},
x AS (SELECT x.session_key, x.start_us, total_bytes / total_packets > 100 AS r1, payload_entropy > 3.3 AS r2, payload_entropy,
  total_packets >= 2 AND x.tcp_syn_count / total_packets > 0.4 AS r3 FROM session x JOIN full_stat USING (session_key, session_seq))
SELECT session_key, start_us, {rd('CASE WHEN r3 THEN 0.9 WHEN r1 THEN 0.8 WHEN r2 THEN payload_entropy / 10 ELSE 0.1 END', 'anomaly_score')},
  r1 OR r3 AS is_anomaly, CASE WHEN r1 THEN 'large_packet' WHEN r2 THEN 'high_entropy' WHEN r3 THEN 'syn_flood' ELSE 'normal' END AS anomaly_type FROM x""")
def _detections(spark, d):
    from flowlens.config import DetectionConfig, RuleConfig

    cfg = DetectionConfig(mode="rule_only", rules=RuleConfig(large_packet=100, high_entropy=3.3, syn_ratio=0.4, syn_min_packets=2))
    rows = flows(spark, d, "verdicts", lambda sessions: M.stream_detections(sessions, cfg).drop("reasons"))
    return rounded(rows.select("session_key", "start_us", "anomaly_score", "is_anomaly", "anomaly_type"))


@query("streamed_throttle", _greedy_sql(6 * HOUR))
def _throttle(spark, d):
    found = L.alert_candidates(detect(scored_of(packets_of(event_stream(spark, d)))))
    return finished(spark, M.stream_throttle(found, 6 * HOUR), "throttle")


@query("streamed_counter_rates", f"""WITH {PACKETS_SQL},
l AS (SELECT user_id, packet_id, ts_us, length, winsize, lag(ts_us) OVER w AS t0, lag(length) OVER w AS l0, lag(winsize) OVER w AS w0 FROM packets
  WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, packet_id))
SELECT user_id, packet_id, ts_us, {rd('(length - l0) / CASE WHEN ts_us > t0 THEN (ts_us - t0) / 1e6 ELSE 0.1 END', 'length_rate')},
  {rd('(winsize - w0) / CASE WHEN ts_us > t0 THEN (ts_us - t0) / 1e6 ELSE 0.1 END', 'winsize_rate')} FROM l""")
def _rates(spark, d):
    return rounded(finished(spark, M.stream_rates(packets_of(event_stream(spark, d)), "user_id", ["length", "winsize"], "packet_id"), "rates"))


@query("streamed_feedback_counts", f"""WITH {FEEDBACK_SQL} SELECT CAST(protocol AS VARCHAR) AS protocol,
  count(*) FILTER (WHERE outcome = 'tp') AS tp, count(*) FILTER (WHERE outcome = 'fp') AS fp,
  count(*) FILTER (WHERE outcome = 'tn') AS tn, count(*) FILTER (WHERE outcome = 'fn') AS fn FROM judged GROUP BY 1""")
def _counts(spark, d):
    # Every verdict arrives twice, as through a queue and a direct call, and counts once. Orphans meet no detection.
    judged = feedback_of(packets_of(event_stream(spark, d))).join(
        detections(spark, d).select("anomaly_id", F.col("protocol").cast("string").alias("protocol"), "is_anomaly"), "anomaly_id"
    )
    twice = judged.select(
        "anomaly_id", "protocol", "is_anomaly", "is_correct", F.timestamp_micros("feedback_us").alias("event_time"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("way"),
    )
    base = scratch(spark, "counters")
    M.run_counters(M.stream_feedback_counts(twice), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select("protocol", "tp", "fp", "tn", "fn")


_PATIENCE = 5 * DAY


@query("streamed_late_rows", f"""WITH {PACKETS_SQL},
cut AS (SELECT (min(ts_us) + max(ts_us)) // 2 AS middle, (max(ts_us) // 1000 - {_PATIENCE // 1000}) * 1000 AS mark FROM packets),
told AS (SELECT ts_us < middle AND ts_us <= mark AS late FROM packets, cut)
SELECT count(*) FILTER (WHERE NOT late) AS kept, count(*) FILTER (WHERE late) AS late FROM told""")
def _late(spark, d):
    """The newer half of the feed arrives first; of the older half, what lies behind the watermark is dropped and counted."""
    rows, base = packets(spark, d).select("packet_id", "ts_us"), scratch(spark, "late")
    middle = rows.agg(F.expr("(min(ts_us) + max(ts_us)) DIV 2")).first()[0]
    counter = M.LateRows()
    spark.streams.addListener(counter)
    try:
        for half in (rows.where(F.col("ts_us") >= middle), rows.where(F.col("ts_us") < middle)):
            half.write.mode("append").parquet(f"{base}/in")
            stream = M.with_event_time(M.packet_stream(spark, f"{base}/in", rows.schema, max_files=1_000_000))
            seen = stream.withWatermark("event_time", f"{_PATIENCE // HOUR} hours").dropDuplicates(["packet_id", "event_time"])
            run = (
                seen.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
                .trigger(availableNow=True).start()
            )
            run.awaitTermination()
            late = counter.count(run)
    finally:
        spark.streams.removeListener(counter)
    return spark.read.schema(seen.schema).parquet(f"{base}/out").agg(F.count(F.lit(1)).alias("kept")).withColumn("late", F.lit(late).cast("bigint"))
