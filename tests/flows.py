"""Packet fixtures and plain Python readings of the flow operators."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

from flowlens.schemas import PACKET

US = 1_000_000
T0 = 1_620_000_000 * US


def packet(i, t, src="192.168.1.100", dst="10.0.0.1", sport=54321, dport=80, proto=6, length=60, flags=2, payload=b""):
    ported = proto in (6, 17)
    return (i, t, src, dst, sport if ported else None, dport if ported else None, proto, length,
            flags if proto == 6 else None, payload)


def frame(spark, rows):
    return spark.createDataFrame(rows, PACKET)


def key(p):
    name = {6: "tcp", 17: "udp", 1: "icmp"}.get(p[6], f"unknown({p[6]})")
    a, b = sorted([p[2], p[3]])
    if p[6] in (6, 17) and p[4] is not None and p[5] is not None:
        x, y = sorted([p[4], p[5]])
        return f"{a}:{x}-{b}:{y}-{name}"
    return f"{a}-{b}-{name}"


def split(rows, timeout):
    """Sessions as {(key, seq): packets in order}."""
    by_key = defaultdict(list)
    for p in sorted(rows, key=lambda p: (p[1], p[0])):
        by_key[key(p)].append(p)
    out = {}
    for k, ps in by_key.items():
        seq, last = 1, None
        for p in ps:
            if last is not None and p[1] - last > timeout:
                seq += 1
            last = p[1]
            out.setdefault((k, seq), []).append(p)
    return out


def std(xs):
    if len(xs) < 2:
        return 0.0
    m = sum(xs) / len(xs)
    return math.sqrt(sum((x - m) ** 2 for x in xs) / len(xs))


def entropy(symbols):
    n = len(symbols)
    return -sum(c / n * math.log2(c / n) for c in Counter(symbols).values()) if n else 0.0


def stat(ps):
    sizes, pay, times = [p[7] for p in ps], [len(p[9] or b"") for p in ps], [p[1] for p in ps]
    tcp = [p for p in ps if p[6] == 6]
    dur = 0.0 if len(ps) < 2 else max((max(times) - min(times)) / US, 0.001)
    flag = lambda m: float(sum(1 for p in tcp if (p[8] or 0) & m))
    out = sum(1 for p in ps if p[2] <= p[3]) / len(ps)
    return {
        "packet_count": len(ps), "byte_count": sum(sizes), "flow_duration": dur,
        "avg_packet_size": sum(sizes) / len(sizes), "std_packet_size": std(sizes),
        "min_packet_size": min(sizes), "max_packet_size": max(sizes),
        "bytes_per_second": sum(sizes) / dur if dur else 0, "packets_per_second": len(ps) / dur if dur else 0,
        "tcp_syn_count": flag(2), "tcp_ack_count": flag(16), "tcp_fin_count": flag(1), "tcp_rst_count": flag(4),
        "tcp_flag_ratio": sum(1 for p in tcp if p[8]) / len(tcp) if tcp else 0,
        "tcp_packet_ratio": len(tcp) / len(ps), "udp_packet_ratio": sum(p[6] == 17 for p in ps) / len(ps),
        "icmp_packet_ratio": sum(p[6] in (1, 58) for p in ps) / len(ps),
        "avg_payload_size": sum(pay) / len(pay), "payload_size_std": std(pay),
        "payload_entropy": entropy([b for p in ps for b in (p[9] or b"")]),
        "src_port_entropy": entropy([p[4] for p in ps if p[4] is not None]),
        "dst_port_entropy": entropy([p[5] for p in ps if p[5] is not None]),
        "outbound_packet_ratio": out, "inbound_packet_ratio": 1 - out,
    }


def window(ps, size, burst):
    """The eight measures of the trailing window of ordered packets."""
    cut = [p for p in ps if p[1] >= ps[-1][1] - size]
    t, sizes = [p[1] for p in cut], [p[7] for p in cut]
    dur = max((t[-1] - t[0]) / US, 0.001) if len(t) > 1 else size / US
    gaps = [(b - a) / US for a, b in zip(t, t[1:])]
    runs, cur = [], [t[0]]
    for a, b in zip(t, t[1:]):
        if b - a <= burst:
            cur.append(b)
        else:
            runs.append(cur)
            cur = [b]
    runs = [r for r in runs + [cur] if len(r) > 1]
    return [
        len(t) / dur, sum(sizes) / dur, sum(sizes) / len(sizes), std(sizes), sum(gaps) / len(gaps) if gaps else 0.0,
        std(gaps), float(len(runs)), sum((r[-1] - r[0]) / US for r in runs) / len(runs) if runs else 0.0,
    ]


def greedy(times, interval):
    sent, last = [], None
    for t in sorted(times):
        if last is None or t - last >= interval:
            sent.append(t)
            last = t
    return sent
