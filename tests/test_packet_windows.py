"""Windows as they stand after each packet, against a plain reading that keeps the packets of every window."""

import random
from collections import defaultdict

import numpy as np
import pytest
from flows import T0, US, frame, packet

from flowlens.config import SessionConfig, WindowConfig
from flowlens.operators import temporal
from flowlens.schemas import TEMPORAL_FEATURES, WINDOW_MEASURES


def plain_measures(times, lengths, size_us, burst_us):
    gaps = [b - a for a, b in zip(times, times[1:])]
    span = (times[-1] - times[0]) / 1e6
    dur = size_us / 1e6 if len(times) < 2 else max(span, 0.001)
    runs, run = [], [times[0]]
    for gap, t in zip(gaps, times[1:]):
        if gap <= burst_us:
            run.append(t)
        else:
            runs.append(run)
            run = [t]
    runs = [r for r in [*runs, run] if len(r) > 1]
    return [
        len(times) / dur, sum(lengths) / dur, np.mean(lengths), np.std(lengths), np.mean(gaps) / 1e6 if gaps else 0.0,
        np.std(gaps) / 1e6 if len(gaps) > 1 else 0.0, len(runs), np.mean([r[-1] - r[0] for r in runs]) / 1e6 if runs else 0.0,
    ]


def plain_windows(rows, cfg, windows):
    """(packet id: features) of (id, key, ts, length) rows."""
    flows = defaultdict(list)
    for i, key, ts, length in sorted(rows, key=lambda r: (r[2], r[0])):
        if flows[key] and ts - flows[key][-1][-1][1] <= cfg.timeout_us:
            flows[key][-1].append((i, ts, length))
        else:
            flows[key].append([(i, ts, length)])
    out = {}
    for sessions in flows.values():
        for session in sessions:
            for j, (i, ts, _) in enumerate(session):
                f = {}
                for name, size in windows.sizes().items():
                    held = [p for p in session[: j + 1] if p[1] >= ts - size]
                    f |= {f"{name}_window_{m}": v for m, v in zip(WINDOW_MEASURES, plain_measures([p[1] for p in held], [p[2] for p in held], size, windows.burst_gap_us))}
                s, m = (lambda x: f[f"short_window_{x}"]), (lambda x: f[f"medium_window_{x}"])
                change = lambda x: abs(m(x) - s(x)) / s(x) if s(x) > 0 else 0.0
                f |= {
                    "packet_rate_trend": m("packet_rate") - s("packet_rate"), "byte_rate_trend": m("byte_rate") - s("byte_rate"),
                    "packet_size_variation": change("packet_size_mean"), "inter_arrival_variation": change("inter_arrival_mean"),
                }
                out[i] = [f[x] for x in TEMPORAL_FEATURES]
    return out


def feed(seed, n, steps):
    """A flooded flow and some small ones; steps of zero make ties."""
    r = random.Random(seed)
    rows, t = [], T0
    for i in range(n):
        t += r.choice(steps)
        rows.append((r.randrange(10**6) * 1000 + i, 80 if r.random() < 0.7 else 81 + r.randrange(4), t, r.randrange(40, 1500)))
    return rows


CASES = {
    "bursts cut by windows": (WindowConfig((2 * US, US), (7 * US, US), (40 * US, US), 300_000), [0, 1, 100_000, 300_000, 300_001, 900_000]),
    "windows shorter than a burst gap": (WindowConfig((100_000, 1), (250_000, 1), (3 * US, 1), 400_000), [0, 100_000, 150_000, 400_000, 500_000]),
    "mostly ties": (WindowConfig((US, 1), (2 * US, 1), (5 * US, 1), 1), [0, 0, 0, 0, 1, US]),
    "sessions that end": (WindowConfig((10 * US, 1), (30 * US, 1), (100 * US, 1), 2 * US), [US, 2 * US, 3 * US, 70 * US]),
}


@pytest.mark.parametrize("name", CASES)
def test_windows_after_each_packet(spark, name):
    windows, steps = CASES[name]
    cfg = SessionConfig(timeout_us=60 * US, chunk_us=3 * US)
    rows = feed(7, 500, steps)
    df = frame(spark, [packet(i, ts, dport=port, length=length) for i, port, ts, length in rows]).repartition(5)
    want = plain_windows(rows, cfg, windows)
    got = temporal.packet_windows(df, cfg, windows)
    assert got.columns == ["session_id", "session_key", "session_seq", "ts_us", "packet_id", *TEMPORAL_FEATURES]
    found = {r["packet_id"]: [r[f] for f in TEMPORAL_FEATURES] for r in got.collect()}
    assert found.keys() == want.keys()
    for i, values in want.items():
        assert np.allclose(found[i], values, rtol=1e-9, atol=1e-9), (i, [(f, a, b) for f, a, b in zip(TEMPORAL_FEATURES, found[i], values) if abs(a - b) > 1e-9])


def test_last_packet_has_the_session_features(spark):
    """After its last packet a session's windows are those anchored at its end."""
    windows, steps = CASES["bursts cut by windows"]
    cfg = SessionConfig(timeout_us=60 * US, chunk_us=3 * US)
    df = frame(spark, [packet(i, ts, dport=port, length=length) for i, port, ts, length in feed(8, 300, steps)])
    last = {}
    for r in sorted(temporal.packet_windows(df, cfg, windows).collect(), key=lambda r: (r["ts_us"], r["packet_id"])):
        last[r["session_id"]] = [r[f] for f in TEMPORAL_FEATURES]
    whole = {r["session_id"]: [r[f] for f in TEMPORAL_FEATURES] for r in temporal.temporal_features(df, cfg, windows).collect()}
    assert last.keys() == whole.keys()
    for k in last:
        assert np.allclose(last[k], whole[k], rtol=1e-9, atol=1e-9)


def test_no_packets(spark):
    assert temporal.packet_windows(frame(spark, [])).count() == 0
