"""Sources and sinks: every query writes rows of the driver tables and reads them back."""

from __future__ import annotations

from functools import reduce
from operator import mul

from pyspark.sql import functions as F

from flowlens.functions import frames as X
from flowlens.plans.flows import CFG
from flowlens.plans.registry import DAY, HOUR, query, rd, rounded, scratch
from flowlens.schemas import ALL_FEATURES, FEEDBACK
from flowlens.sources import adapters, pcap
from flowlens.sources import storage as A
from flowlens.sources.adapters import FEEDBACK_SQL, PACKETS_SQL, SCORED_SQL, detections, micros, packets, table


def _lineitem(spark, d):
    li = table(spark, d, "lineitem")
    return li.withColumn("ts_us", micros(li, "l_shipdate")).drop("l_shipdate")


_START, _END = 820_454_400_000_000, 851_000_000_000_000


@query("time_range_load", f"""SELECT strftime(l_shipdate, '%Y%m') AS ym, count(*) AS n, {rd('sum(l_quantity)', 'quantity')}
FROM lineitem WHERE epoch_us(l_shipdate) BETWEEN {_START} AND {_END} GROUP BY 1""")
def _range(spark, d):
    path = scratch(spark, "raw")
    A.write_partitioned(_lineitem(spark, d), path)
    rows = A.load_range(spark, path, _START, _END)
    return rounded(rows.groupBy("ym").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")))


@query("csv_directory", f"""WITH {PACKETS_SQL} SELECT protocol, count(*) AS n, CAST(sum(length) AS BIGINT) AS bytes FROM packets GROUP BY 1""")
def _csv(spark, d):
    path = scratch(spark, "csv")
    rows = packets(spark, d).select("packet_id", "protocol", "length")
    for protocol in (1, 6, 17):
        rows.where(F.col("protocol") == protocol).write.option("header", "true").csv(f"{path}/p{protocol}")
    back = A.read_csv_directory(spark, path, "packet_id BIGINT, protocol INT, length INT")
    return back.groupBy("protocol").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))


@query("training_directory", f"""WITH {PACKETS_SQL} SELECT packet_id::DOUBLE AS id, protocol::DOUBLE AS protocol_num, greatest(length - 100, 0)::DOUBLE AS byte_count,
  CASE WHEN k < 8 THEN 1 ELSE 0 END AS label, protocol AS protocol_label FROM packets""")
def _training_directory(spark, d):
    path = scratch(spark, "training")
    rows = packets(spark, d).select(
        F.col("packet_id").alias("id"), "src_ip", F.col("protocol").alias("protocol_num"), (F.col("length") - 100).alias("byte_count"),
        F.lit("seen").alias("note"), (F.col("k") < 8).cast("int").alias("label"),
    )
    for label in (0, 1):
        rows.where(F.col("label") == label).write.option("header", "true").csv(f"{path}/label{label}")
    texts = "id STRING, src_ip STRING, protocol_num STRING, byte_count STRING, note STRING, label STRING"
    return A.training_directory(spark, path, texts)[0]


@query("new_rows_since", f"WITH {PACKETS_SQL} SELECT count(*) AS n FROM packets WHERE ts_us > 1705000000000000 AND protocol = 17")
def _since(spark, d):
    return A.count_since(packets(spark, d), 1_705_000_000_000_000, 17)


@query("test_table", f"WITH {PACKETS_SQL} SELECT packet_id, protocol, length FROM packets")
def _test_table(spark, d):
    base = scratch(spark, "test")
    A.save_test_data(packets(spark, d).select("packet_id", "protocol", "length"), base, "csv")
    return A.load_test_data(spark, [f"{base}/missing", base], "packet_id BIGINT, protocol INT, length INT")


@query("month_retention", "SELECT strftime(l_shipdate, '%Y%m') AS ym, count(*) AS n FROM lineitem WHERE strftime(l_shipdate, '%Y%m') >= '199606' GROUP BY 1")
def _retention(spark, d):
    rows = _lineitem(spark, d).withColumn("ym", A.month_of("ts_us"))
    now = 836_000_000_000_000  # 1996-06-28
    return A.retained(rows, now, 20).groupBy("ym").agg(F.count(F.lit(1)).alias("n"))


@query("expired_months", "SELECT DISTINCT strftime(l_shipdate, '%Y%m') AS ym FROM lineitem WHERE strftime(l_shipdate, '%Y%m') < '199606'")
def _expired(spark, d):
    rows = _lineitem(spark, d).withColumn("ym", A.month_of("ts_us"))
    return A.expired_months(rows, 836_000_000_000_000, 20)


# One file per event type: the text of props and a line end for each event.
@query("storage_stats", """WITH f AS (SELECT event_type, CAST(sum(length(props) + 1) AS BIGINT) AS b FROM events GROUP BY 1),
s AS (SELECT coalesce(event_type, 'total') AS area, count(*) AS file_count, CAST(sum(b) AS BIGINT) AS size_bytes FROM f GROUP BY ROLLUP (event_type))
SELECT area, file_count, size_bytes, CASE WHEN size_bytes < 1024 THEN printf('%.2f B', size_bytes::DOUBLE)
  WHEN size_bytes < 1048576 THEN printf('%.2f KB', size_bytes / 1024) WHEN size_bytes < 1073741824 THEN printf('%.2f MB', size_bytes / 1048576)
  ELSE printf('%.2f GB', size_bytes / 1073741824) END AS size_human FROM s""")
def _stats(spark, d):
    path = scratch(spark, "areas")
    rows = table(spark, d, "events").select("event_type", "props").repartition("event_type")
    rows.write.partitionBy("event_type").text(path)
    kinds = [r[0] for r in spark.read.text(path).select("event_type").distinct().collect()]
    return A.storage_stats(spark, {k: f"{path}/event_type={k}" for k in kinds})


@query("readable_sizes", """SELECT event_id, CASE WHEN s < 1024 THEN printf('%.2f B', s) WHEN s < 1048576 THEN printf('%.2f KB', s / 1024)
  WHEN s < 1073741824 THEN printf('%.2f MB', s / 1048576) ELSE printf('%.2f GB', s / 1073741824) END AS size
FROM (SELECT event_id, CAST(user_id * user_id * event_id * 8 AS DOUBLE) AS s FROM events)""")
def _sizes(spark, d):
    factors = [F.col("user_id"), F.col("user_id"), F.col("event_id"), F.lit(8)]
    # As doubles where the product takes more than 64 bits.
    size = F.coalesce(reduce(F.try_multiply, factors).cast("double"), reduce(mul, [f.cast("double") for f in factors]))
    return table(spark, d, "events").select("event_id", A.format_size(size).alias("size"))


@query("latest_detections", f"""WITH {SCORED_SQL} SELECT session_id, ts_us, {rd('anomaly_score', 'anomaly_score')}, is_anomaly
FROM detections ORDER BY ts_us DESC, session_id DESC LIMIT 1000""")
def _latest(spark, d):
    path = scratch(spark, "detections")
    A.append_detections(detections(spark, d).drop("reasons"), path)
    rows = A.latest_rows(spark.read.parquet(path), 1000)
    return rounded(rows.select("session_id", "ts_us", "anomaly_score", "is_anomaly"))


_NOW = 1_706_600_000_000_000


@query("recent_reports", f"""WITH {SCORED_SQL} SELECT anomaly_id, anomaly_type, {rd('payload_entropy', 'payload_entropy')} FROM detections
WHERE is_anomaly AND ts_us BETWEEN {_NOW - 48 * HOUR} AND {_NOW} ORDER BY ts_us DESC, anomaly_id DESC LIMIT 100""")
def _reports(spark, d):
    path = scratch(spark, "reports")
    A.write_reports(detections(spark, d), ["packet_count", "payload_entropy", "avg_packet_size"], path)
    rows = A.recent_reports(spark.read.json(path), _NOW, 48, 100)
    return rounded(rows.select("anomaly_info.anomaly_id", "anomaly_info.anomaly_type", F.col("features.payload_entropy")))


@query("feedback_files", f"""WITH {FEEDBACK_SQL} SELECT CASE WHEN fk < 5 THEN 'corrupt' WHEN fk < 10 THEN 'incomplete' ELSE 'good' END AS kind,
  count(*) AS n FROM feedback GROUP BY 1""")
def _feedback(spark, d):
    path = scratch(spark, "feedback")
    rows = adapters.feedback(spark, d)
    k = F.col("features")["packet_count"]
    whole = F.to_json(F.struct(
        F.when((k >= 10) | (k < 5), F.col("anomaly_id")).alias("anomaly_id"), "is_correct", "features",
        (F.col("feedback_us") / 1e6).alias("timestamp"),
    ))
    rows.select(F.when(k < 5, F.substring(whole, 1, 20)).otherwise(whole).alias("value")).write.text(path)
    good, bad = A.read_feedback(spark, path, FEEDBACK)
    kind = F.when(F.col("record").endswith("}"), "incomplete").otherwise("corrupt")
    return good.select(F.lit("good").alias("kind")).unionByName(bad.select(kind.alias("kind"))).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("feedback_retention", f"""WITH {FEEDBACK_SQL} SELECT feedback_id FROM feedback WHERE feedback_us // {DAY} >= {(_NOW - 7 * DAY) // DAY}""")
def _feedback_retention(spark, d):
    from flowlens.functions.scalars import timestamp_text

    rows = adapters.feedback(spark, d).withColumn("dt", timestamp_text("feedback_us", "yyyyMMdd"))
    return A.retained_days(rows, _NOW, 7).select("feedback_id")


_REGISTRY = f"""{PACKETS_SQL}, registry AS (SELECT 'm' || (user_id % 7) AS model_type, user_id AS version, max(ts_us) AS ts_us FROM packets GROUP BY 1, 2)"""


def _registry(spark, d):
    rows = packets(spark, d).groupBy(F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string")).alias("model_type"), F.col("user_id").alias("version"))
    return rows.agg(F.max("ts_us").alias("ts_us")).withColumn("path", F.concat_ws("/", "model_type", F.col("version").cast("string")))


@query("latest_models", f"""WITH {_REGISTRY} SELECT model_type, version, model_type || '/' || version AS path FROM registry
QUALIFY row_number() OVER (PARTITION BY model_type ORDER BY ts_us DESC, version DESC) = 1""")
def _latest_models(spark, d):
    return A.latest_models(_registry(spark, d))


@query("model_versions", f"""WITH {_REGISTRY} SELECT model_type, version, ts_us FROM registry WHERE model_type = 'm3' AND version <> 3""")
def _versions(spark, d):
    return A.list_models(A.delete_version(_registry(spark, d), "m3", 3), "m3").select("model_type", "version", "ts_us")


@query("newest_report", f"""WITH {_REGISTRY} SELECT model_type, version, ts_us FROM registry
WHERE ts_us BETWEEN {_NOW - 20 * DAY} AND {_NOW} ORDER BY ts_us DESC, model_type LIMIT 1""")
def _newest(spark, d):
    return A.newest_report(_registry(spark, d), _NOW - 20 * DAY, _NOW).select("model_type", "version", "ts_us")


# Later fragments have no transport fields; their payload starts with bytes of a cut header and is left out.
_DECODED = """SELECT {id} AS packet_id, ts_us, src_ip, dst_ip, CASE WHEN {odd} <> 9 THEN src_port END AS src_port,
  CASE WHEN {odd} <> 9 THEN dst_port END AS dst_port, protocol, CASE WHEN {odd} <> 9 THEN flags END AS flags,
  CASE WHEN protocol = 6 AND {odd} <> 9 THEN seq::BIGINT END AS seq, CASE WHEN protocol = 6 AND {odd} <> 9 THEN winsize END AS winsize,
  CASE WHEN {odd} <> 9 THEN icmp_type END AS icmp_type, CASE WHEN {odd} <> 9 THEN icmp_code END AS icmp_code,
  CAST(34 + CASE {odd} WHEN 3 THEN 4 WHEN 5 THEN 8 ELSE 0 END + CASE protocol WHEN 6 THEN 20 WHEN 17 THEN 8 ELSE 4 END
    + length(payload) AS INT) AS length, CASE WHEN {odd} <> 9 THEN payload END AS payload FROM packets"""


def _decoded(rows):
    """A later fragment shows by its missing type or ports."""
    whole = F.coalesce("src_port", "icmp_type").isNotNull()
    return rows.select(
        "packet_id", "ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "flags", "seq", "winsize",
        "icmp_type", "icmp_code", "length", F.when(whole, F.decode("payload", "UTF-8")).alias("payload"),
    )


@query("frame_decoding", f"WITH {PACKETS_SQL} {_DECODED.format(id='packet_id', odd='packet_id % 16')}")
def _frames(spark, d):
    return _decoded(X.decode(adapters.frames_of(packets(spark, d), odd=True)))


@query("layered_packets", f"""WITH {PACKETS_SQL} SELECT packet_id, ts_us, src_ip, dst_ip, protocol, src_port FROM packets""")
def _layers(spark, d):
    layers = X.nested(X.decode(adapters.frames_of(packets(spark, d))))
    return X.flat(layers).select("packet_id", "ts_us", "src_ip", "dst_ip", "protocol", "src_port")


def write_pcap(frames, path: str) -> None:
    """One pcap file per partition, as a capture host would leave them."""
    import struct

    def write(rows):
        import os
        import uuid

        from pyarrow import fs

        inner = path.removeprefix("file:")
        system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), inner)
        system.create_dir(os.path.dirname(inner + "/x"), recursive=True)
        rows = iter(rows)
        first = next(rows, None)
        if first is None:
            return
        with system.open_output_stream(f"{inner}/{uuid.uuid5(uuid.NAMESPACE_OID, str(first.packet_id)).hex}.pcap") as out:
            out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
            while first is not None:
                out.write(struct.pack("<IIII", first.ts_us // 10**6, first.ts_us % 10**6, len(first.frame), len(first.frame)))
                out.write(bytes(first.frame))
                first = next(rows, None)

    frames.foreachPartition(write)


@query("pcap_packets", f"WITH {PACKETS_SQL} {_DECODED.format(id='0::BIGINT', odd='packet_id % 16')}")
def _pcap(spark, d):
    path = scratch(spark, "pcap")
    write_pcap(adapters.frames_of(packets(spark, d), odd=True).repartition(4, "packet_id"), path)
    return _decoded(pcap.pcap_packets(spark, path, split_bytes=64 << 10)).withColumn("packet_id", F.lit(0).cast("bigint"))


@query("pcap_rejects", "SELECT DISTINCT n_regionkey, 'unknown format' AS reason FROM nation")
def _rejects(spark, d):
    path = scratch(spark, "pcap")
    write_pcap(adapters.frames_of(packets(spark, d)).repartition(2, "packet_id"), f"{path}/frames")
    nations = table(spark, d, "nation").select(F.col("n_regionkey").cast("int").alias("n_regionkey"), "n_name")
    nations.repartition(1).write.partitionBy("n_regionkey").text(f"{path}/notes")
    key = F.regexp_extract("path", "n_regionkey=([0-9]+)", 1).cast("int")
    return pcap.pcap_rejects(spark, path).where("path LIKE '%/part-%'").select(key.alias("n_regionkey"), "reason").distinct()


_FRAME_LENGTH = """34 + CASE WHEN event_type = 'error' THEN 4 WHEN event_type = 'signup' THEN 8 ELSE 20 END + length(props) AS length"""


def _pcap_features_sql() -> str:
    """The feature SQL over captured frame lengths."""
    from flowlens.plans.flows import ENTROPY_SQL, STAT_SQL, flow_sql
    from flowlens.plans.temporal import _temporal_sql

    flows = flow_sql().replace("CAST(floor(value) AS INT) + 40 AS length", _FRAME_LENGTH)
    return f"""WITH {flows}, {STAT_SQL}, {ENTROPY_SQL}, {_temporal_sql()} SELECT {', '.join(rd(f, f) for f in ALL_FEATURES)}, 0 AS label
FROM full_stat JOIN temporal USING (session_key, session_seq)"""


@query("pcap_to_features", _pcap_features_sql())
def _pcap_features(spark, d):
    from flowlens.plans.temporal import WINDOWS

    path = scratch(spark, "pcap")
    write_pcap(adapters.frames_of(packets(spark, d)).repartition(4, "packet_id"), path)
    A.pcap_to_tables(spark, path, f"{path}-tables", CFG, WINDOWS)
    return rounded(spark.read.parquet(f"{path}-tables/features"))
