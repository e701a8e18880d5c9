"""The throttle against the greedy rule, on sparse, dense and skewed alerts."""

import random

import pytest
from flows import greedy

from flowlens.operators import alerts as L
from flowlens.operators import reports
from flowlens.streaming import streams as M

SCHEMA = "anomaly_type string, ts_us long, anomaly_id string"


def alerts(spark, by_type):
    rows = [(k, t, f"{k}{i}") for k, ts in by_type.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, SCHEMA)


def sent(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.anomaly_type, []).append(r.ts_us)
    return {k: sorted(v) for k, v in out.items()}


def test_named_case(spark):
    df = alerts(spark, {"a": [0, 30, 59, 60, 100, 119, 120, 125, 190]})
    assert sent(L.throttle(df, interval_us=60)) == {"a": [0, 60, 120, 190]}


@pytest.mark.parametrize("seed", range(2))
def test_matches_greedy(spark, seed):
    rnd = random.Random(seed)
    feeds = {
        "hot": [rnd.randrange(0, 40_000) for _ in range(3000)],
        "dense": list(range(-500, 700)),
        "sparse": [rnd.randrange(0, 10_000_000) for _ in range(300)],
        "regular": list(range(0, 60_000, 7)),
        "same": [77] * 500,
        "late": [16 * 10 * 17 + d for d in (0, 3, 9, 10, 170, 171)],
    }
    interval = rnd.choice([5, 10, 13])
    want = {k: greedy(v, interval) for k, v in feeds.items()}
    assert sent(L.throttle(alerts(spark, feeds), interval_us=interval)) == want


def test_sent_alerts_keep_one_row_per_time(spark):
    df = alerts(spark, {"a": [0, 0, 0, 100]})
    assert sorted(r.anomaly_id for r in L.sent_alerts(df, interval_us=60).collect()) == ["a0", "a3"]


def test_stream_throttle_carries_state(spark, tmp_path):
    times = sorted(random.Random(9).sample(range(5000), 900))
    src = str(tmp_path / "in")
    for part in (times[:300], times[300:650], times[650:]):
        alerts(spark, {"x": part, "y": part[::3]}).coalesce(1).write.mode("append").parquet(src)
    stream = M.stream_throttle(M.packet_stream(spark, src, SCHEMA, max_files=1), 40)
    M.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sent(spark.read.parquet(str(tmp_path / "out")))
    assert got["x"] == greedy(times, 40)


def test_stream_throttle_over_many_batches_and_restarts(spark, tmp_path):
    """One small file per batch, the query stopped and started again: state is one number per type."""
    src, times = str(tmp_path / "in"), sorted(random.Random(3).sample(range(20_000), 600))
    for run in range(3):
        for i in range(8):
            part = times[(run * 8 + i) * 25 : (run * 8 + i + 1) * 25]
            alerts(spark, {"x": part, "quiet": part[:1]}).coalesce(1).write.mode("append").parquet(src)
        stream = M.stream_throttle(M.packet_stream(spark, src, SCHEMA, max_files=1), 70)
        M.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sent(spark.read.parquet(str(tmp_path / "out")))
    assert got == {"x": greedy(times, 70), "quiet": greedy(times[::25], 70)}
    state = spark.read.format("statestore").load(str(tmp_path / "cp"))
    assert state.count() == 2  # one row per type after 24 batches


def test_histogram_closes_last_bin(spark):
    df = spark.createDataFrame([(True, x / 10) for x in range(11)] + [(False, 0.5)] * 3, "is_anomaly boolean, anomaly_score double")
    rows = {(r.is_anomaly, r.bin): r.n for r in reports.score_histogram(df, 10).collect()}
    assert rows[(True, 9)] == 2 and sum(n for (a, _), n in rows.items() if a) == 11
    assert [n for (a, _), n in rows.items() if not a] == [3]


def test_calendar_fills_gaps(spark):
    h = reports.HOUR_US
    df = spark.createDataFrame([(0, True), (3 * h + 5, False)], "ts_us long, is_anomaly boolean")
    rows = [(r.interval_start_us // h, r.anomalies, r.normals) for r in reports.counts_over_time(df).orderBy("interval_start_us").collect()]
    assert rows == [(0, 1, 0), (1, 0, 0), (2, 0, 0), (3, 0, 1)]


def test_summary_of_nothing(spark):
    df = spark.createDataFrame([], "packet_count double, is_anomaly boolean")
    assert tuple(reports.summary(df).first()) == (0, 0, 0, 0.0)
