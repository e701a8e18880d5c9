"""Captures entered at any byte, with damaged records, captures inside captures, and files that cannot be opened."""

import io
import os
import random
import struct

import pytest
from test_sources import block, ipv4, pcap_bytes, pcapng_bytes, tcp

from flowlens.sources import pcap

T = 1_620_000_000_000_000


def some_frames(n, seed, most=300):
    r = random.Random(seed)
    return [(T + i * 1000, ipv4(6, tcp(bytes(r.choices(range(256), k=r.randrange(most)))))) for i in range(n)]


def read_split(raw, low, high, damaged):
    """The frames of one split, and its damaged stretches, as the tasks read them."""
    faces = []
    if raw[:4] == b"\x0a\x0d\x0d\x0a":
        data = pcap._Bytes(io.BytesIO(raw), len(raw))
        layout, first = pcap._layout(data)
        for r in pcap._walk(data, first, len(raw), layout, []):
            if raw[r.at : r.at + 4] == raw[:4]:
                faces.append([str(r.at), layout["order"], None])
            elif struct.unpack(layout["order"] + "I", raw[r.at : r.at + 4])[0] == pcap.INTERFACE:
                face = pcap._interface(data, r.at, r.end - r.at, layout["order"])
                faces.append([str(r.at), layout["order"], pcap.json.dumps(face)])
    known = pcap._opened({"size": len(raw), "low": low, "faces": faces}, io.BytesIO(raw))
    if known is None:
        return []
    data, layout, at = known
    found: list = []
    out = [(r.ts_us, data.get(r.place, r.size)) for r in pcap._walk(data, at, high, layout, found) if r.at >= low and r.place >= 0]
    damaged += [d for d in found if low <= d[0] < high]
    return out


def read_all(raw, split):
    damaged: list = []
    out = [f for low in range(0, len(raw), split) for f in read_split(raw, low, min(low + split, len(raw)), damaged)]
    return out, damaged


@pytest.fixture(autouse=True)
def short_frames(monkeypatch):
    monkeypatch.setattr(pcap, "LONGEST", 600)


@pytest.mark.parametrize("split", [97, 1000, 4099, 30_000])
@pytest.mark.parametrize("kind", ["pcap", "pcap big", "pcapng"])
def test_any_split_gives_each_record_once(split, kind):
    frames = some_frames(300, 1)
    raw = pcapng_bytes(frames) if kind == "pcapng" else pcap_bytes(frames, ">" if "big" in kind else "<")
    raw = raw[:16] + struct.pack("<I", 600) + raw[20:] if kind == "pcap" else raw
    assert read_all(raw, split) == (frames, [])


def record_starts(raw):
    data = pcap._Bytes(io.BytesIO(raw), len(raw))
    layout, first = pcap._layout(data)
    return [(r.at, r.end) for r in pcap._walk(data, first, len(raw), layout, []) if r.place >= 0]


@pytest.mark.parametrize("split", [777, 5000, 10**6])
@pytest.mark.parametrize("field, value", [(8, 0xFFFFFFF0), (8, 61), (8, 0), (4, 5_000_000)])
def test_a_damaged_record_costs_itself_alone(split, field, value):
    """A size far too large, one that leads into the middle of the next records, zero, and a fraction over a second."""
    frames = some_frames(200, 2)
    raw = bytearray(pcap_bytes(frames))
    starts = record_starts(bytes(raw))
    hit = [5, 6, 40, 41, 120, 198]
    for i in hit:
        struct.pack_into("<I", raw, starts[i][0] + field, value)
    out, damaged = read_all(bytes(raw), split)
    if (field, value) == (8, 0):  # an empty record is a sound one: what follows is looked for inside it
        out = [f for f in out if f[1]]
    assert out == [f for i, f in enumerate(frames) if i not in hit]
    assert all(any(a <= starts[i][0] < b for a, b in damaged) for i in hit) or value == 0
    assert sum(b - a for a, b in damaged) <= sum(starts[i][1] - starts[i][0] for i in hit)


@pytest.mark.parametrize("split", [777, 10**6])
def test_a_lost_stretch(split):
    """Bytes overwritten by zeros, and a hole: the records on either side stay."""
    frames = some_frames(200, 3)
    raw = bytearray(pcap_bytes(frames))
    starts = record_starts(bytes(raw))
    a, b = starts[50][0] + 7, starts[60][0] + 9
    zeros = bytes(raw[:a]) + bytes(b - a) + bytes(raw[b:])
    hole = bytes(raw[:a]) + bytes(raw[b:])
    for damaged_raw in (zeros, hole):
        out, damaged = read_all(damaged_raw, split)
        assert out == frames[:50] + frames[61:] and len(damaged) == 1


@pytest.mark.parametrize("split", [500, 2000])
def test_a_capture_inside_a_capture(split):
    """Frames that carry whole capture files: chains inside them end with the frame."""
    frames = some_frames(60, 4, 200)
    inner = pcap_bytes([(T, b"x" * 20)] * 12)
    frames = [(t, ipv4(6, tcp(inner)) if i % 3 == 0 else f) for i, (t, f) in enumerate(frames)]
    assert max(len(f) for _, f in frames) < 600 + 200
    raw = bytearray(pcap_bytes(frames))
    struct.pack_into("<I", raw, 16, 800)
    assert read_all(bytes(raw), split) == (frames, [])


def test_damaged_blocks():
    frames = some_frames(120, 5)
    raw = bytearray(pcapng_bytes(frames))
    starts = record_starts(bytes(raw))
    for i in (3, 70, 71):
        struct.pack_into("<I", raw, starts[i][0] + 4, 0x7FFFFFF0)
    for split in (900, 10**6):
        out, damaged = read_all(bytes(raw), split)
        assert out == [f for i, f in enumerate(frames) if i not in (3, 70, 71)]
        assert [d[0] for d in damaged] == [starts[3][0], starts[70][0]]


def test_large_files_in_many_tasks(spark, tmp_path):
    """Real bounds: files of some megabytes in many splits, one of them damaged, one not to be opened."""
    frames = [(T + i, ipv4(6, tcp(bytes([i % 251]) * 1300))) for i in range(4000)]
    raw = bytearray(pcap_bytes(frames))
    size = 16 + len(frames[0][1])
    hit = [500, 501, 2600]
    for i in hit:
        struct.pack_into("<I", raw, 24 + i * size + 8, 0xFFFFFF00)
    (tmp_path / "a.pcap").write_bytes(raw)
    (tmp_path / "b.pcapng").write_bytes(pcapng_bytes(frames[:2000]) + block("<", 0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)))
    (tmp_path / "none.txt").write_bytes(b"no capture" * 10)
    df = pcap.read_pcap(spark, str(tmp_path), split_bytes=400_000)
    rows = df.orderBy("packet_id").collect()
    assert [(r.ts_us, bytes(r.frame)) for r in rows] == [f for i, f in enumerate(frames) if i not in hit] + frames[:2000]
    assert len({r.packet_id for r in rows}) == len(rows)
    tasks = spark.sparkContext.defaultParallelism
    from pyspark.sql import functions as F

    assert df.select(F.spark_partition_id().alias("p")).distinct().count() >= min(tasks, 10)
    rejects = sorted((os.path.basename(r.path), r.start, r.length, r.reason) for r in pcap.pcap_rejects(spark, str(tmp_path), 400_000).collect())
    assert rejects == [("a.pcap", 24 + 500 * size, 2 * size, "damaged"), ("a.pcap", 24 + 2600 * size, size, "damaged"), ("none.txt", 0, 100, "unknown format")]
