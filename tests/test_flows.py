"""Sessions and features against hand values and against plain Python on skewed feeds."""

import random

import pytest
from flows import T0, US, frame, packet, split, stat, window
from pyspark.sql import functions as F

from flowlens.config import SessionConfig, WindowConfig
from flowlens.operators import sessions as S
from flowlens.operators import stat as D
from flowlens.operators import temporal as E
from flowlens.schemas import ALL_FEATURES, STAT_FEATURES, TEMPORAL_FEATURES, WINDOW_MEASURES

HTTP = [
    packet(0, T0, sport=54321, flags=2, length=60), packet(1, T0 + 100_000, "10.0.0.1", "192.168.1.100", 80, 54321, flags=18),
]


def skewed(seed, n=900):
    """A third of the packets are one flow, many at the same instant; the rest is spread."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            t = T0 + rnd.choice([0, 0, 0, 50_000, 90_000, 5 * US, 9 * US, 400 * US, 401 * US, 1000 * US])
            rows.append(packet(i, t, length=rnd.choice([60, 1500]), flags=rnd.choice([2, 16, 0, 17]), payload=b"ab" * (i % 4)))
        else:
            h = rnd.randrange(6)
            a, b = f"10.0.0.{h}", f"10.0.1.{h % 2}"
            if rnd.random() < 0.5:
                a, b = b, a
            proto = rnd.choice([6, 17, 1, 47])
            rows.append(packet(i, T0 + rnd.randrange(2000) * US // 2, a, b, rnd.choice([80, 5000]), rnd.choice([80, 5000]),
                               proto, rnd.randrange(40, 1500), rnd.choice([2, 16, 4, 1, 18]), bytes([rnd.randrange(256)]) * (i % 5)))
    return rows


def test_key_modes(spark):
    rows = [packet(0, T0, "A", "B", 80, 5000), packet(1, T0, "A", "B", 5000, 80), packet(2, T0, "B", "A", 5000, 80)]
    df = frame(spark, rows)
    compat = {r[0] for r in df.select(S.session_key()).collect()}
    endpoint = [r[0] for r in df.orderBy("packet_id").select(S.session_key("endpoint")).collect()]
    assert compat == {"A:80-B:5000-tcp"}
    assert endpoint == ["A:80-B:5000-tcp", "A:5000-B:80-tcp", "A:80-B:5000-tcp"]
    with pytest.raises(ValueError):
        S.session_key("other")


def test_timeout_boundary(spark):
    together = frame(spark, [packet(0, T0), packet(1, T0 + 300 * US)])
    apart = frame(spark, [packet(0, T0), packet(1, T0 + 300 * US + 1)])
    assert S.sessions(together).count() == 1
    assert S.sessions(apart).count() == 2


def test_single_and_simultaneous_packets(spark):
    one = D.stat_features(frame(spark, [packet(0, T0)])).first()
    assert (one.flow_duration, one.packets_per_second, one.std_packet_size) == (0.0, 0.0, 0.0)
    two = D.stat_features(frame(spark, [packet(0, T0), packet(1, T0)])).first()
    assert two.flow_duration == 0.001 and two.packets_per_second == 2000.0


def test_empty_feed_keeps_schema(spark):
    empty = frame(spark, [])
    out = E.flow_features(empty)
    assert out.count() == 0
    assert out.columns[-len(ALL_FEATURES):] == ALL_FEATURES


def test_ten_packet_session(spark):
    sizes = [100, 150, 200, 180, 120, 90, 210, 170, 160, 120]
    flags = [2] + [16] * 8 + [1]
    rows = [packet(i, T0 + i * US, length=s, flags=f) for i, (s, f) in enumerate(zip(sizes, flags))]
    r = D.stat_features(frame(spark, rows)).first()
    assert (r.packet_count, r.byte_count, r.avg_packet_size) == (10, 1500, 150)
    assert r.std_packet_size == pytest.approx(39.24, abs=0.005)
    assert (r.tcp_syn_count, r.tcp_ack_count, r.tcp_fin_count, r.tcp_packet_ratio) == (1, 8, 1, 1.0)
    t = E.temporal_features(frame(spark, rows)).first()
    assert t.short_window_packet_rate == pytest.approx(10 / 9)
    assert t.short_window_inter_arrival_std == pytest.approx(0, abs=1e-9)
    assert t.short_window_burst_count == 0 and t.packet_rate_trend == pytest.approx(0)


def test_first_packet_orients_the_session(spark):
    rows = [packet(5, T0, "10.0.0.9", "10.0.0.1", 5000, 80), packet(4, T0, "10.0.0.1", "10.0.0.9", 5000, 80)]
    r = S.sessions(frame(spark, rows)).first()
    # The lower id comes first at equal time; its source already is the lower address.
    assert (r.src_ip, r.dst_ip, r.src_port, r.dst_port) == ("10.0.0.1", "10.0.0.9", 5000, 80)


def test_burst_gap_is_inclusive(spark):
    rows = [packet(0, T0), packet(1, T0 + 100_000), packet(2, T0 + 200_001)]
    r = E.temporal_features(frame(spark, rows)).first()
    assert r.short_window_burst_count == 1
    assert r.short_window_burst_duration_mean == pytest.approx(0.1)


def test_window_cut_is_inclusive(spark):
    rows = [packet(0, T0), packet(1, T0 + 10 * US)]
    r = E.temporal_features(frame(spark, rows)).first()
    assert r.short_window_packet_rate == pytest.approx(0.2)


@pytest.mark.parametrize("seed", [1, 2])
def test_skewed_feed_matches_plain_reading(spark, seed):
    rows = skewed(seed)
    cfg, windows = SessionConfig(), WindowConfig()
    want = split(rows, cfg.timeout_us)
    got = {(r.session_key, r.session_seq): r for r in E.flow_features(frame(spark, rows), cfg, windows).collect()}
    assert got.keys() == want.keys()
    for k, ps in want.items():
        row = got[k].asDict()
        expected = stat(ps)
        for f in STAT_FEATURES:
            assert row[f] == pytest.approx(expected[f], abs=1e-7), (k, f)
        for name, size in windows.sizes().items():
            for m, v in zip(WINDOW_MEASURES, window(ps, size, windows.burst_gap_us)):
                assert row[f"{name}_window_{m}"] == pytest.approx(v, rel=1e-7, abs=1e-7), (k, name, m)
    assert sum(r.packet_count for r in got.values()) == len(rows)


def test_parts_of_a_chunk_from_many_batches_are_merged(spark):
    rows = skewed(5)
    whole = {(r.session_key, r.session_seq): r.asDict() for r in E.flow_features(frame(spark, rows)).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        parts = E.flow_features(frame(spark, rows).repartition(5)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(parts) == len(whole)
    for r in parts:
        for f in ALL_FEATURES:
            assert r[f] == pytest.approx(whole[(r.session_key, r.session_seq)][f], abs=1e-9), f


def test_flow_features_are_those_of_the_single_operators(spark):
    df = frame(spark, skewed(6))
    stat = {(r.session_key, r.session_seq): r.asDict() for r in D.stat_features(df).collect()}
    times = {(r.session_key, r.session_seq): r.asDict() for r in E.temporal_features(df).collect()}
    flows = E.flow_features(df).collect()
    assert len(flows) == len(stat) == len(times)
    for r in flows:
        key = (r.session_key, r.session_seq)
        for f, v in (stat[key] | times[key]).items():
            assert r[f] == (pytest.approx(v, abs=1e-9) if isinstance(v, float) else v), f


def test_features_stay_in_bounds(spark):
    out = E.flow_features(frame(spark, skewed(3)))
    for c in [f for f in ALL_FEATURES if f.endswith("_ratio")]:
        assert out.where(~F.col(c).between(0, 1)).count() == 0
    assert out.where(~F.col("payload_entropy").between(0, 8)).count() == 0


def test_trailing_windows_match_plain_reading(spark):
    rows, size = skewed(4), 60 * US
    got = {(r.session_key, r.session_seq, r.ts_us): r for r in E.trailing_windows(frame(spark, rows), size).collect()}
    seen = 0
    for (k, seq), ps in split(rows, 300 * US).items():
        for t in {p[1] for p in ps}:
            cut = [p for p in ps if t - size <= p[1] <= t]
            r, seen = got[(k, seq, t)], seen + 1
            assert (r.window_packets, r.window_bytes) == (len(cut), sum(p[7] for p in cut))
            span = (t - min(p[1] for p in cut)) / US
            assert r.packet_rate == pytest.approx(len(cut) / (max(span, 0.001) if len(cut) > 1 else 60))
    assert seen == len(got)


def test_packet_cap(spark):
    rows = skewed(5)
    capped = S.cap_packets(frame(spark, rows), limit=7).collect()
    want = {(k, p[0]) for (k, _), ps in split(rows, 300 * US).items() for p in ps[:7]}
    assert {(r.session_key, r.packet_id) for r in capped} == want


@pytest.mark.parametrize("pad", [False, True])
def test_sequences_of_a_hot_key(spark, pad):
    rows = [(i % 3 and i % 7, i, float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, t long, x double").withColumn("c", F.expr("t DIV 50"))
    out = E.sequences(df, ["k"], "c", ["t"], ["x"], "t", length=5, pad=pad, block=8).collect()
    by_key = {}
    for k, t, x in rows:
        by_key.setdefault(k, []).append((t, x))
    want = {}
    for k, items in by_key.items():
        for i, (t, _) in enumerate(items):
            xs = [x for _, x in items[max(0, i - 4): i + 1]]
            if pad or len(xs) == 5:
                want[(k, t)] = [0.0] * (5 - len(xs)) + xs
    assert {(r.k, r.t): [s.x for s in r.sequence] for r in out} == want


def test_feature_switches(spark):
    df = frame(spark, skewed(6, 60))
    assert D.stat_features(df, disabled=["payload_entropy"]).columns[-1] != "payload_entropy"
    few = E.temporal_features(df, enabled=["packet_rate_trend"])
    assert few.columns[3:] == ["packet_rate_trend"]
    assert len(TEMPORAL_FEATURES) == 28 and len(STAT_FEATURES) == 24
