"""Projections, lookups and scalar functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.config import FilterRuleConfig
from flowlens.functions import scalars as X
from flowlens.functions.entropy import byte_entropy
from flowlens.operators import detect
from flowlens.plans.registry import query, rd, rounded
from flowlens.schemas import ALL_FEATURES, MODEL_FEATURES
from flowlens.sources.adapters import PACKETS_SQL, RAW_SQL, packets, raw_samples, table


@query("packet_projection", f"WITH {PACKETS_SQL} SELECT packet_id, ts_us, src_ip, dst_ip, src_port, dst_port, "
       "protocol, length, flags, k, winsize, icmp_type, icmp_code FROM packets WHERE protocol IS NOT NULL")
def _packets(spark, d):
    return packets(spark, d).where(X.is_ip()).select(
        "packet_id", "ts_us", "src_ip", "dst_ip", "src_port", "dst_port",
        "protocol", "length", "flags", "k", "winsize", "icmp_type", "icmp_code",
    )


@query("capture_filter", f"""WITH {PACKETS_SQL}
SELECT packet_id, protocol, src_port, dst_port FROM packets
WHERE protocol = 6 AND (src_port = 80 OR dst_port = 80) AND (src_ip IN ('10.0.1.0') OR dst_ip IN ('10.0.1.0'))""")
def _filter(spark, d):
    return packets(spark, d).where(
        X.capture_filter(protocols=[6], hosts=["10.0.1.0"], ports=[80])
    ).select("packet_id", "protocol", "src_port", "dst_port")


@query("protocol_names", """
SELECT number, name, back, count(*) AS n FROM (
  SELECT p AS number,
    CASE p WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 1 THEN 'icmp' ELSE 'unknown(' || p || ')' END AS name,
    CASE p WHEN 6 THEN 6 WHEN 17 THEN 17 WHEN 1 THEN 1 ELSE -1 END AS back
  FROM (SELECT CAST(regexp_extract(props, '[0-9]+') AS INT) % 20 AS p FROM events)) GROUP BY ALL""")
def _names(spark, d):
    p = packets(spark, d).select((F.col("k") % 20).alias("number"))
    named = p.withColumn("name", X.protocol_name("number"))
    return named.withColumn("back", X.protocol_number("name")).groupBy("number", "name", "back").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("protocol_spec_lookup", f"""WITH {PACKETS_SQL}
SELECT p AS protocol, count(*) AS n,
  CASE p WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 1 THEN 'icmp' WHEN 58 THEN 'icmp6' ELSE 'unknown' END AS spec_name,
  CASE p WHEN 6 THEN 'lstm' WHEN 17 THEN 'xgboost' WHEN 1 THEN 'random_forest' WHEN 58 THEN 'random_forest'
    ELSE 'xgboost' END AS first_model,
  CASE p WHEN 6 THEN 17 WHEN 17 THEN 11 WHEN 1 THEN 10 WHEN 58 THEN 7 ELSE 5 END AS key_features
FROM (SELECT CASE WHEN k < 10 THEN 58 WHEN k < 20 THEN 47 ELSE protocol END AS p FROM packets) GROUP BY p""")
def _spec(spark, d):
    p = packets(spark, d).select(
        F.when(F.col("k") < 10, 58).when(F.col("k") < 20, 47).otherwise(F.col("protocol")).alias("protocol")
    )
    return p.groupBy("protocol").agg(F.count(F.lit(1)).alias("n")).select(
        "protocol", "n",
        X.spec_row("protocol", "name").alias("spec_name"),
        X.spec_row("protocol", "model_preference")[0].alias("first_model"),
        F.size(X.spec_row("protocol", "key_features")).alias("key_features"),
    )


@query("model_projection", """
SELECT event_id,
  coalesce(TRY_CAST(value AS DOUBLE), 0) AS packet_count, coalesce(TRY_CAST(txt AS DOUBLE), 0) AS byte_count,
  0.0::DOUBLE AS flow_duration, 0.0::DOUBLE AS avg_packet_size, 0.0::DOUBLE AS std_packet_size,
  0.0::DOUBLE AS min_packet_size, 0.0::DOUBLE AS max_packet_size, 0.0::DOUBLE AS bytes_per_second,
  0.0::DOUBLE AS packets_per_second, 0.0::DOUBLE AS tcp_syn_count, 0.0::DOUBLE AS tcp_ack_count,
  0.0::DOUBLE AS tcp_fin_count, 0.0::DOUBLE AS tcp_rst_count, 0.0::DOUBLE AS tcp_flag_ratio,
  0.0::DOUBLE AS payload_entropy
FROM (SELECT event_id, value, CASE WHEN event_id % 3 = 0 THEN 'abc' ELSE CAST(user_id AS VARCHAR) END AS txt FROM events)""")
def _model_projection(spark, d):
    e = table(spark, d, "events").select(
        "event_id", F.col("value").alias("packet_count"),
        F.when(F.col("event_id") % 3 == 0, "abc").otherwise(F.col("user_id").cast("string")).alias("byte_count"),
    )
    return X.project_model_features(e, ["event_id"])


_FLAG_SQL = {
    "tcp_syn_count": "CAST(contains(tcp_flags, 'SYN') AS INT)", "tcp_ack_count": "CAST(contains(tcp_flags, 'ACK') AS INT)",
    "tcp_fin_count": "CAST(contains(tcp_flags, 'FIN') AS INT)", "tcp_rst_count": "CAST(contains(tcp_flags, 'RST') AS INT)",
    "tcp_flag_ratio": "CAST(tcp_flags <> '0' AS INT)",
    "flow_duration": "session_duration", "payload_entropy": "payload_entropy",
}


@query("raw_to_model_columns", f"WITH {RAW_SQL} SELECT "
       + ", ".join(f"CAST({_FLAG_SQL.get(f, 'packet_size')} AS DOUBLE) AS {f}" for f in MODEL_FEATURES)
       + ", label FROM raw")
def _raw_model(spark, d):
    return X.raw_to_model(raw_samples(spark, d))


def _raw_feature_sql() -> str:
    out = {f: "0.0" for f in ALL_FEATURES}
    rate, brate = ("CASE WHEN session_duration > 0 THEN 1 / session_duration ELSE 0 END",
                   "CASE WHEN session_duration > 0 THEN packet_size / session_duration ELSE 0 END")
    size = "packet_size"
    out |= {"packet_count": "1", "byte_count": size, "flow_duration": "session_duration", "avg_packet_size": size,
            "min_packet_size": size, "max_packet_size": size, "bytes_per_second": brate, "packets_per_second": rate,
            "avg_payload_size": size, "payload_entropy": "payload_entropy", "outbound_packet_ratio": "0.5",
            "inbound_packet_ratio": "0.5", "tcp_packet_ratio": "CAST(protocol = 6 AS INT)",
            "udp_packet_ratio": "CAST(protocol = 17 AS INT)", "icmp_packet_ratio": "CAST(protocol = 1 AS INT)"}
    for flag in ("SYN", "ACK", "FIN", "RST"):
        out[f"tcp_{flag.lower()}_count"] = f"CAST(contains(tcp_flags, '{flag}') AS INT)"
    out["tcp_flag_ratio"] = "(" + " + ".join(
        f"CAST(contains(tcp_flags, '{x}') AS INT)" for x in ("SYN", "ACK", "FIN", "RST")) + ") / 4.0"
    for w in ("short", "medium", "long"):
        out |= {f"{w}_window_packet_rate": rate, f"{w}_window_byte_rate": brate,
                f"{w}_window_packet_size_mean": size, f"{w}_window_inter_arrival_mean": "inter_arrival_time"}
    return ", ".join(rd(v, k) for k, v in out.items())


@query("raw_to_features", f"WITH {RAW_SQL} SELECT id, {_raw_feature_sql()}, label FROM raw")
def _raw_features(spark, d):
    return rounded(X.raw_to_features(raw_samples(spark, d), ["id"]))


@query("packet_features", f"""WITH {PACKETS_SQL},
bytes AS (SELECT packet_id, substr(payload, i, 1) AS b, count(*) AS c
  FROM (SELECT packet_id, payload, unnest(range(1, length(payload) + 1)) AS i FROM packets) GROUP BY ALL),
ent AS (SELECT packet_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM bytes GROUP BY packet_id)
SELECT packet_id, length AS packet_size, length(payload)::INT AS payload_size, {rd('h', 'payload_entropy')},
  1 AS has_payload,
  CASE WHEN protocol = 6 THEN flags END AS tcp_flags,
  CASE WHEN protocol = 6 THEN CAST(flags & 2 <> 0 AS INT) END AS tcp_flag_syn,
  CASE WHEN protocol = 6 THEN CAST(flags & 16 <> 0 AS INT) END AS tcp_flag_ack,
  CASE WHEN protocol = 6 THEN CAST(flags & 1 <> 0 AS INT) END AS tcp_flag_fin,
  CASE WHEN protocol = 6 THEN CAST(flags & 4 <> 0 AS INT) END AS tcp_flag_rst,
  CASE WHEN protocol = 6 THEN winsize END AS window_size, icmp_type, icmp_code
FROM packets JOIN ent USING (packet_id)""")
def _packet_features(spark, d):
    return rounded(X.packet_features(packets(spark, d)))


@query("ip_validity", """
SELECT event_id, user_id % 300 <= 255 AND CAST(regexp_extract(props, '[0-9]+') AS INT) < 90 AS valid
FROM events""")
def _ip(spark, d):
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    text = F.concat(F.lit("10.0."), (F.col("user_id") % 300).cast("string"),
                    F.when(k < 90, ".7").otherwise(".7.x"))
    return e.select("event_id", X.is_valid_ip(text).alias("valid"))


@query("timestamp_parsing", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(date_trunc('second', ts))
    WHEN 2 THEN event_id * 1000000 + 250000 END AS parsed_us,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS formatted
FROM events""")
def _timestamps(spark, d):
    from flowlens.sources.adapters import micros

    e = table(spark, d, "events")
    kind = F.col("event_id") % 4
    text = (
        F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(kind == 1, F.date_format("ts", "MM/dd/yyyy HH:mm:ss"))
        .when(kind == 2, F.concat(F.col("event_id").cast("string"), F.lit(".25")))
        .otherwise("soon")
    )
    return e.select(
        "event_id", X.parse_timestamp_us(text).alias("parsed_us"),
        X.timestamp_text(micros(e, "ts")).alias("formatted"),
    )


@query("epoch_normalization", f"""WITH {PACKETS_SQL}
SELECT packet_id, {rd("CASE WHEN v > 1e10 THEN v / 1000 ELSE v END", "seconds")}
FROM (SELECT packet_id, CASE WHEN packet_id % 2 = 0 THEN ts_us / 1e3 ELSE ts_us / 1e6 END AS v FROM packets)""")
def _epoch(spark, d):
    p = packets(spark, d)
    v = F.when(F.col("packet_id") % 2 == 0, F.col("ts_us") / 1e3).otherwise(F.col("ts_us") / 1e6)
    return rounded(p.select("packet_id", X.epoch_seconds(v).alias("seconds")))


@query("field_aliases", f"""WITH {PACKETS_SQL}
SELECT packet_id, CASE WHEN k < 50 THEN src_ip ELSE dst_ip END AS src_ip,
  CASE WHEN k < 90 THEN dst_ip ELSE 'N/A' END AS dst_ip, CAST(protocol AS VARCHAR) AS protocol,
  'N/A' AS anomaly_type, CAST(k AS VARCHAR) AS anomaly_score FROM packets""")
def _aliases(spark, d):
    p = packets(spark, d).select(
        "packet_id",
        F.when(F.col("k") < 50, F.col("src_ip")).alias("source_ip"),
        F.col("dst_ip").alias("src_addr"),
        F.when(F.col("k") < 90, F.col("dst_ip")).otherwise("").alias("destination_ip"),
        F.col("protocol").alias("proto"), F.col("k").alias("score"),
    )
    return X.resolve_aliases(p).select(
        "packet_id", "src_ip", "dst_ip", "protocol", "anomaly_type", "anomaly_score"
    )


@query("required_fields", f"""WITH {PACKETS_SQL}
SELECT src_port IS NOT NULL AND flags IS NOT NULL AS accepted, count(*) AS n FROM packets GROUP BY 1""")
def _required(spark, d):
    good, bad = X.split_valid(packets(spark, d), ["src_port", "flags"])
    return good.select(F.lit(True).alias("accepted")).unionByName(
        bad.select(F.lit(False).alias("accepted"))
    ).groupBy("accepted").agg(F.count(F.lit(1)).alias("n"))


@query("text_entropy", """
SELECT doc_id, """ + rd("coalesce(h, 0)", "entropy") + """ FROM documents LEFT JOIN (
SELECT doc_id, CASE WHEN count(*) <= 1 THEN 0 ELSE log2(sum(c)) - sum(c * log2(c)) / sum(c) END AS h
FROM (SELECT doc_id, b, count(*) AS c FROM (
  SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents) GROUP BY ALL) GROUP BY doc_id) USING (doc_id)""")
def _entropy(spark, d):
    docs = table(spark, d, "documents")
    return rounded(docs.select("doc_id", byte_entropy(F.encode("text", "UTF-8")).alias("entropy")))


@query("normal_range_violations", f"""WITH {PACKETS_SQL},
agg AS (SELECT src_ip, protocol, avg(length) AS packet_size_mean, avg(winsize) AS window_size_mean,
  count(DISTINCT dst_port) AS unique_dest_ports, count(*) / 100.0 AS packets_per_second,
  sum(CASE WHEN icmp_type = 8 THEN 1 ELSE 0 END) AS echo_request_count FROM packets GROUP BY 1, 2),
long AS (
  SELECT src_ip, protocol, 'packets_per_second' AS feature, packets_per_second AS value, 0 AS lo,
    CASE protocol WHEN 6 THEN 100 WHEN 17 THEN 200 ELSE 10 END AS hi FROM agg
  UNION ALL SELECT src_ip, protocol, 'window_size_mean', window_size_mean, 0, 65535 FROM agg WHERE protocol = 6
  UNION ALL SELECT src_ip, protocol, 'packet_size_mean', packet_size_mean, 0, 1500 FROM agg WHERE protocol = 17
  UNION ALL SELECT src_ip, protocol, 'unique_dest_ports', unique_dest_ports, 1, 5 FROM agg WHERE protocol = 17
  UNION ALL SELECT src_ip, protocol, 'echo_request_count', echo_request_count, 0, 10 FROM agg WHERE protocol = 1)
SELECT src_ip, protocol, feature, {rd('value', 'value')} FROM long WHERE NOT value BETWEEN lo AND hi""")
def _ranges(spark, d):
    p = packets(spark, d)
    ports = p.where("dst_port IS NOT NULL").groupBy("src_ip", "protocol", "dst_port").agg(F.lit(1).alias("one"))
    ports = ports.groupBy("src_ip", "protocol").agg(F.count(F.lit(1)).alias("unique_dest_ports"))
    agg = p.groupBy("src_ip", "protocol").agg(
        F.avg("length").alias("packet_size_mean"), F.avg("winsize").alias("window_size_mean"),
        (F.count(F.lit(1)) / 100.0).alias("packets_per_second"),
        F.sum(F.when(F.col("icmp_type") == 8, 1).otherwise(0)).alias("echo_request_count"),
    ).join(ports, ["src_ip", "protocol"], "left").fillna(0, ["unique_dest_ports"])
    return rounded(detect.range_violations(agg, ["src_ip", "protocol"]))


@query("configured_rules", f"""WITH {PACKETS_SQL}
SELECT packet_id,
  concat_ws('|', CASE WHEN length > 150 THEN 'size' END, CASE WHEN protocol IN (1) THEN 'protocol' END,
    CASE WHEN k * 2.0 > 100 THEN 'rate' END, CASE WHEN flags IN (1, 17) THEN 'flags' END) AS reasons
FROM packets WHERE length > 150 OR protocol = 1 OR k * 2.0 > 100 OR coalesce(flags IN (1, 17), false)""")
def _rules(spark, d):
    p = packets(spark, d).withColumn("packets_per_second", F.col("k") * 2.0)
    cfg = FilterRuleConfig(max_normal_size=150, suspicious_flags=(1, 17))
    hits = detect.configured_rules(p, cfg)
    return hits.where(F.size("reasons") > 0).select("packet_id", F.array_join("reasons", "|").alias("reasons"))



@query("json_rows", f"WITH {PACKETS_SQL} SELECT packet_id, src_ip, dst_port, k FROM packets")
def _json(spark, d):
    p = packets(spark, d).select("packet_id", "src_ip", "dst_port", F.struct("k").alias("extra"))
    rows = X.to_json_rows(p, ["packet_id"])
    back = F.from_json("json", "src_ip STRING, dst_port INT, extra STRUCT<k: INT>").alias("r")
    return rows.select("packet_id", back).select("packet_id", "r.src_ip", "r.dst_port", "r.extra.k")
