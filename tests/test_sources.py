"""pcap files, frames, storage, feedback files and text functions."""

import struct

import pytest
from pyspark.sql import functions as F

from flowlens.functions import frames as X
from flowlens.functions import scalars as C
from flowlens.functions.entropy import byte_entropy
from flowlens.plans import REGISTRY
from flowlens.schemas import FEEDBACK
from flowlens.sources import pcap
from flowlens.sources import storage as A

ETH = bytes.fromhex("020000000001020000000002")


def ipv4(proto, body, total=None, ihl=5, ethertype=b"\x08\x00"):
    head = bytes([0x40 | ihl, 0]) + struct.pack(">H", ihl * 4 + len(body) if total is None else total) + bytes(4) + bytes([64, proto, 0, 0])
    return ETH + ethertype + head + bytes([10, 0, 0, 1, 10, 0, 0, 2]) + bytes(ihl * 4 - 20) + body


def tcp(payload=b"", offset=5):
    return struct.pack(">HHIIBBHHH", 1234, 80, 7, 9, offset << 4, 0x12, 512, 0, 0) + bytes(offset * 4 - 20) + payload


def pcap_bytes(frames, order="<", nano=False, cut=0):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for ts_us, f in frames:
        out += struct.pack(order + "IIII", ts_us // 10**6, ts_us % 10**6 * (1000 if nano else 1), len(f), len(f)) + f
    return out[: len(out) - cut]


def block(order, kind, body):
    body += bytes(-len(body) % 4)
    size = struct.pack(order + "I", len(body) + 12)
    return struct.pack(order + "I", kind) + size + body + size


def pcapng_bytes(frames, order="<", units=6, cut=0):
    """Two sections; the second interface has its own units and an offset of 100 s."""
    start = block(order, 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
    plain = block(order, 1, struct.pack(order + "HHI", 1, 0, 0))
    fine = block(order, 1, struct.pack(order + "HHI", 1, 0, 0) + struct.pack(order + "HHB3x", 9, 1, units)
                 + struct.pack(order + "HHq", 14, 8, 100) + bytes(4))
    out = start + plain + fine
    for n, (ts_us, f) in enumerate(frames):
        if n == len(frames) // 2:
            out += start + plain + fine + block(order, 4, b"names")
        t = ts_us if n % 2 == 0 else (ts_us - 100_000_000) * 10**units // 10**6
        out += block(order, 6, struct.pack(order + "IIIII", n % 2, t >> 32, t & 0xFFFFFFFF, len(f), len(f)) + f)
    return out[: len(out) - cut]


@pytest.mark.parametrize("order, units", [("<", 6), (">", 9)])
def test_read_pcapng_beside_pcap(spark, tmp_path, order, units):
    frames = [(1_620_000_000_000_000 + i, ipv4(6, tcp(bytes([i % 256]) * (i % 90)))) for i in range(400)]
    (tmp_path / "a.pcapng").write_bytes(pcapng_bytes(frames[:300], order, units))
    (tmp_path / "b.pcap").write_bytes(pcap_bytes(frames[300:350]))
    (tmp_path / "c.pcapng").write_bytes(pcapng_bytes(frames[350:], order, units, cut=9))
    (tmp_path / "d.txt").write_bytes(b"not a capture file at all, but long enough")
    rows = pcap.read_pcap(spark, str(tmp_path), split_bytes=2000).orderBy("packet_id").collect()
    assert [(r.ts_us, bytes(r.frame)) for r in rows] == frames[:-1]
    assert len({r.packet_id for r in rows}) == len(rows)
    rejects = {r.path.rsplit("/", 1)[1]: r.reason for r in pcap.pcap_rejects(spark, str(tmp_path)).collect()}
    assert rejects == {"d.txt": "unknown format", "c.pcapng": "cut off"}


def test_decode_tags_lengths_and_fragments(spark):
    plain = ipv4(6, tcp(b"hello"))
    tag = lambda f, *tags: f[:12] + b"".join(tags) + f[12:]
    later = bytearray(plain)
    later[20:22] = b"\x20\x03"
    frames = [tag(plain, b"\x81\x00\x00\x05"), tag(plain, b"\x88\xa8\x00\x01", b"\x81\x00\x00\x02"), ipv4(6, tcp(b"hello"), total=0), bytes(later)]
    df = spark.createDataFrame([(i, 0, f) for i, f in enumerate(frames)], "packet_id long, ts_us long, frame binary")
    r = {x.packet_id: x for x in X.decode(df).collect()}
    assert set(r) == {0, 1, 2, 3}
    assert all((r[i].src_port, r[i].dst_port, bytes(r[i].payload), r[i].src_ip) == (1234, 80, b"hello", "10.0.0.1") for i in range(3))
    assert (r[3].src_port, r[3].flags, bytes(r[3].payload)) == (None, None, tcp(b"hello"))


@pytest.mark.parametrize("order, nano", [("<", False), (">", False), ("<", True)])
def test_read_pcap_in_ranges(spark, tmp_path, order, nano):
    frames = [(1_620_000_000_000_000 + i, ipv4(6, tcp(bytes([i % 256]) * (i % 90)))) for i in range(500)]
    (tmp_path / "a.pcap").write_bytes(pcap_bytes(frames[:300], order, nano))
    (tmp_path / "b.pcap").write_bytes(pcap_bytes(frames[300:], order, nano, cut=5))
    (tmp_path / "c.pcap").write_bytes(b"not a capture file at all, but long enough")
    rows = pcap.read_pcap(spark, str(tmp_path), split_bytes=2000).orderBy("packet_id").collect()
    assert [(r.ts_us, bytes(r.frame)) for r in rows] == frames[:-1]


def test_decode_layers(spark):
    frames = [
        ipv4(6, tcp(b"hello")), ipv4(6, tcp(b"opt", offset=8)), ipv4(17, struct.pack(">HHHH", 53, 5353, 11, 0) + b"abc"),
        ipv4(1, bytes([8, 0, 0, 0]) + b"ping"), ipv4(47, b"xyz"), ipv4(6, tcp()[:12]), ipv4(6, tcp(b"pad"), total=43) + bytes(9),
        ipv4(6, tcp(b"six"), ihl=6), ipv4(6, tcp(), ethertype=b"\x86\xdd"), ETH + b"\x08\x00\x45",
    ]
    df = spark.createDataFrame([(i, 0, f) for i, f in enumerate(frames)], "packet_id long, ts_us long, frame binary")
    r = {x.packet_id: x for x in X.decode(df).collect()}
    assert set(r) == {0, 1, 2, 3, 4, 5, 6, 7}
    assert (r[0].src_ip, r[0].dst_ip, r[0].src_port, r[0].flags, r[0].seq, r[0].winsize) == ("10.0.0.1", "10.0.0.2", 1234, 18, 7, 512)
    assert [bytes(r[i].payload) for i in (0, 1, 2, 3, 6, 7)] == [b"hello", b"opt", b"abc", b"ping", b"pad", b"six"]
    assert (r[2].src_port, r[2].udp_length, r[3].icmp_type, r[4].payload) == (53, 11, 8, None)
    assert r[5].src_port is None and r[0].eth_src == "02:00:00:00:00:02"


def test_pcap_to_tables(spark, tmp_path):
    frames = [(1_620_000_000_000_000 + i * 1000, ipv4(6, tcp(b"hello"))) for i in range(20)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pcap").write_bytes(pcap_bytes(frames))
    A.pcap_to_tables(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    row = spark.read.parquet(str(tmp_path / "out/features")).first()
    assert (row.packet_count, row.label) == (20, 0)
    assert len(spark.read.option("header", True).csv(str(tmp_path / "out/model.csv")).columns) == 16


def test_range_load_prunes_months(spark, tmp_path):
    path = str(tmp_path / "raw")
    day = 86_400_000_000
    A.write_partitioned(spark.range(400).select((F.col("id") * day).alias("ts_us")), path)
    rows = A.load_range(spark, path, 40 * day, 70 * day)
    assert rows.count() == 31
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "ym" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "GreaterThanOrEqual(ts_us" in plan
    assert sorted(r.ym for r in A.expired_months(spark.read.parquet(path), 70 * day, 10)
                  .select(F.col("ym").cast("string").alias("ym")).collect()) == ["197001", "197002"]


def test_feedback_quarantine(spark, tmp_path):
    good = '{"anomaly_id":"a_1","is_correct":true,"features":{"x":1.0},"timestamp":1.0}'
    (tmp_path / "f.json").write_text("\n".join([good, '{"anomaly_id": "b', '{"anomaly_id":"c_1"}']))
    ok, bad = A.read_feedback(spark, str(tmp_path), FEEDBACK)
    assert [r.anomaly_id for r in ok.collect()] == ["a_1"]
    A.write_feedback(ok, str(tmp_path / "again"))
    assert [r.dt for r in spark.read.json(str(tmp_path / "again")).collect()] == [19700101]
    assert bad.count() == 2


@pytest.mark.parametrize("text, valid", [
    ("1.2.3.4", True), ("255.255.255.255", True), ("256.1.1.1", False), ("1.2.3", False), ("01.2.3.4", False),
    ("::", True), ("::1", True), ("2001:db8::ff00:42:8329", True), ("1:2:3:4:5:6:7:8", True), ("1:2:3:4:5:6:7", False),
    ("1::2::3", False), ("12345::", False), (":1", False), ("::ffff:10.0.0.1", True), ("::ffff:300.0.0.1", False), ("", False),
    (None, False),
])
def test_ip_validity(spark, text, valid):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(C.is_valid_ip("t")).first()[0] is valid


def test_entropy_values(spark):
    df = spark.createDataFrame([(b"aabbccdd",), (b"",), (None,), (bytes(range(256)),), (b"zz",)], "p binary")
    assert [r[0] for r in df.select(byte_entropy("p")).collect()] == [2.0, 0.0, 0.0, 8.0, 0.0]


def test_flag_map_and_sizes(spark):
    df = spark.createDataFrame([({"SYN": True, "ACK": False},), (None,)], "m map<string,boolean>")
    assert [r[0] for r in df.select(X.flags_from_map("m")).collect()] == [2, None]
    sizes = spark.createDataFrame([(512,), (3200,), (1 << 41,)], "s long")
    assert [r[0] for r in sizes.select(A.format_size("s")).collect()] == ["512.00 B", "3.12 KB", "2.00 TB"]


def test_readable_sizes_beyond_64_bits(spark, tmp_path):
    """Products that 64 bits hold are exact whole numbers; larger ones have a size too."""
    rows = [(3, 5), (90_000, 6_000_000), (540_000, 36_000_000), (4_000_000_000, 0), (4_000_000_000, 7), (3_037_000_499, 1)]
    spark.createDataFrame(rows, "user_id long, event_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(REGISTRY["readable_sizes"].build(spark, str(tmp_path)).collect(), key=str)

    def text(u, e):
        s, units = u * u * e * 8, ["B", "KB", "MB", "GB", "TB"]
        k = next((k for k in range(4) if s < 1024 ** (k + 1)), 4)
        return f"{s / 1024**k:.2f} {units[k]}"

    assert got == sorted(((e, text(u, e)) for u, e in rows), key=str)
