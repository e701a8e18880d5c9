"""Streams give what batches give; late rows are dropped and counted."""

import random

from flows import T0, US, frame, packet
from pyspark.sql import functions as F

from flowlens.config import DetectionConfig, RuleConfig, SessionConfig
from flowlens.operators import host, stat
from flowlens.operators import sessions as S
from flowlens.operators.detect import detect
from flowlens.schemas import PACKET
from flowlens.streaming import streams as M


def write(spark, rows, path):
    frame(spark, rows).coalesce(1).write.mode("append").parquet(path)


def feed():
    rows = [packet(i, T0 + i * 40 * US + (i // 7) * 400 * US, dport=80 + i % 2) for i in range(40)]
    # A closing packet moves the watermark past every other session.
    return rows + [packet(99, T0 + 10**11, "9.9.9.9", "8.8.8.8")]


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = feed()
    for part in (rows[:15], rows[15:30], rows[30:]):
        write(spark, part, src)
    stream = M.stream_sessions(M.packet_stream(spark, src, PACKET, max_files=1))
    M.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    columns = ["session_key", "total_packets", "total_bytes", "start_us", "end_us", "tcp_syn_count"]
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*columns).collect()}
    want = {tuple(r) for r in S.sessions(frame(spark, rows)).select(*columns).collect()}
    assert got == {w for w in want if "9.9.9.9" not in w[0]}
    # A second run finds nothing new and writes nothing twice.
    M.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(got)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    src = str(tmp_path / "in")
    write(spark, [packet(0, T0 + 10_000 * US)], src)
    write(spark, [packet(1, T0 + 20_000 * US)], src)
    write(spark, [packet(2, T0), packet(3, T0 + 20_001 * US)], src)
    stream = M.stream_windows(M.packet_stream(spark, src, PACKET, max_files=1), "60 seconds", None, "10 seconds")
    late = M.LateRows()
    spark.streams.addListener(late)
    query = (
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert late.count(query) == 1
    spark.streams.removeListener(late)


def test_late_rows_of_more_batches_than_a_query_remembers(spark, tmp_path):
    src = str(tmp_path / "in")
    old = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    late = M.LateRows()
    spark.streams.addListener(late)
    try:
        write(spark, [packet(0, T0 + 10_000 * US)], src)
        for i in range(8):
            write(spark, [packet(1 + 2 * i, T0), packet(2 + 2 * i, T0 + (10_100 + i) * US)], src)
        stream = M.stream_windows(M.packet_stream(spark, src, PACKET, max_files=1), "60 seconds", None, "10 seconds")
        query = (
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        assert late.count(query) >= 7 > sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    finally:
        spark.streams.removeListener(late)
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", old)


def mixed_feed(seed, n=400):
    """Sessions that end by gaps of the timeout or one microsecond more, ties, payloads, three protocols, and some that stay open."""
    r = random.Random(seed)
    rows, t = [], T0
    for i in range(n):
        t += r.choice([0, 1, US, 30 * US, 60 * US, 60 * US + 1])
        payload = bytes(r.choices(range(256 if i % 3 else 4), k=r.randrange(0, 60)))
        rows.append(packet(i, t, dport=80 + i % 3, proto=r.choice([6, 17, 1]), length=r.randrange(40, 1500), flags=r.choice([2, 16, 17, 4]), payload=payload))
    return rows


def streamed_flows(spark, parts, tmp_path, cfg, delay="10 minutes"):
    src, control = str(tmp_path / "in"), str(tmp_path / "control")
    for part in parts:
        write(spark, part, src)
    stream = M.stream_flows(M.packet_stream(spark, src, PACKET, max_files=1), cfg.timeout_us, delay, control=M.control_stream(spark, control))
    M.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    before = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).count()
    M.close_open(spark, control, T0 + 10**13)
    M.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    return before, spark.read.parquet(str(tmp_path / "out"))


def test_streamed_flows_are_the_batch_sessions(spark, tmp_path):
    """All sessions, those open at the end too, with entropy; packets arrive out of order within the delay, sessions span batches."""
    cfg = SessionConfig.of(60 * US)
    rows = mixed_feed(1)
    parts = [rows[i : i + 80] for i in range(0, 400, 80)]
    for a, b in zip(parts, parts[1:]):  # the last of a batch come after the first of the next
        a[-3:], b[:3] = b[:3], a[-3:]
    before, got = streamed_flows(spark, parts, tmp_path, cfg, "2 hours")
    df = frame(spark, rows)
    columns = ["session_id", "session_key", "protocol", "total_packets", "total_bytes", "start_us", "end_us", "tcp_syn_count", "tcp_ack_count", "tcp_fin_count", "tcp_rst_count"]
    want = S.sessions(df, cfg).withColumn("batch_id", F.col("session_id")).withColumn("session_id", S.stable_id())
    told = {tuple(r) for r in got.select(*columns).collect()}
    assert told == {tuple(r) for r in want.select(*columns).collect()}
    assert before < len(told) == got.count()
    measures = ["payload_entropy", "std_packet_size", "avg_packet_size"]
    batch = {r["session_id"]: r for r in stat.stat_features(df, cfg).collect()}
    ids = {r["session_id"]: r["batch_id"] for r in want.collect()}
    for r in got.collect():
        assert all(abs(r[m] - batch[ids[r["session_id"]]][m]) < 1e-9 for m in measures)


def test_streamed_detections_use_all_rules(spark, tmp_path):
    cfg, rules = SessionConfig.of(60 * US), DetectionConfig(mode="rule_only", rules=RuleConfig(900, 4.5, 0.4, 2))
    rows = mixed_feed(2, 200)
    _, got = streamed_flows(spark, [rows[:90], rows[90:]], tmp_path, cfg)
    df = frame(spark, rows)
    streamed = {(r["start_us"], r["session_key"]): (r["anomaly_type"], r["reasons"]) for r in M.stream_detections(got, rules).collect()}
    batch = {(r["first_ts"], r["session_key"]): (r["anomaly_type"], r["reasons"]) for r in detect(stat.stat_features(df, cfg), rules).collect()}
    assert streamed == batch and {t for t, _ in batch.values()} >= {"large_packet", "high_entropy", "syn_flood", "normal"}


def test_an_empty_feed_is_closed(spark, tmp_path):
    before, got = streamed_flows(spark, [[]], tmp_path, SessionConfig.of(60 * US))
    assert before == 0 == got.count()


SAMPLES = "h string, sample_id long, ts_us long, a long, b double, other string"


def test_streamed_rates(spark, tmp_path):
    """The stream's rates are those of the batch; a sample behind the last one gets none and changes nothing."""
    r = random.Random(5)
    rows, t = [], 0
    for i in range(120):
        t += r.choice([0, 500_000, 2 * US])
        rows.append((f"h{i % 4}", i, t, i * i, None if i % 17 == 5 else i / 7, "x"))
    src = str(tmp_path / "in")
    for part in (rows[:50], rows[50:90], [("h1", 999, 1, 5, 5.0, "late"), (None, 1, 1, 1, 1.0, "")], rows[90:]):
        spark.createDataFrame(part, SAMPLES).coalesce(1).write.mode("append").parquet(src)
    stream = M.stream_rates(M.packet_stream(spark, src, SAMPLES, max_files=1), "h", ["a", "b"])
    M.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(x["h"], x["sample_id"]): (x["a_rate"], x["b_rate"]) for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got.pop(("h1", 999)) == (None, None)
    batch = host.counter_rates(spark.createDataFrame(rows, SAMPLES), "h", ["a", "b"])
    want = {(x["h"], x["sample_id"]): (x["a_rate"], x["b_rate"]) for x in batch.collect()}
    assert got.keys() == want.keys()
    for k, (a, b) in want.items():
        assert (a is None) == (got[k][0] is None) and (b is None) == (got[k][1] is None)
        assert abs((a or 0) - (got[k][0] or 0)) < 1e-9 and abs((b or 0) - (got[k][1] or 0)) < 1e-9


def test_counters_are_counted_on_over_runs(spark, tmp_path):
    """Verdicts that come twice count once; the counters stand in one place after any number of runs."""
    src, schema = str(tmp_path / "in"), "anomaly_id string, protocol string, is_anomaly boolean, is_correct boolean, event_time timestamp"
    for run in range(3):
        rows = [(f"a{run * 10 + i}", "6" if i % 3 else "17", i % 2 == 0, i % 4 < 2) for i in range(10)]
        df = spark.createDataFrame([(*x, None) for x in rows + rows], schema).withColumn("event_time", F.timestamp_micros(F.lit(T0 + run * US)))
        df.coalesce(1).write.mode("append").parquet(src)
        M.run_counters(M.stream_feedback_counts(M.packet_stream(spark, src, schema)), str(tmp_path / "out"), str(tmp_path / "cp"))
        got = {x["protocol"]: (x["tp"], x["fp"], x["tn"], x["fn"]) for x in spark.read.parquet(str(tmp_path / "out")).collect()}
        assert sum(map(sum, got.values())) == 10 * (run + 1)
    assert got == {"6": (6, 3, 6, 3), "17": (3, 3, 3, 3)}
