"""Decoding of Ethernet/IPv4 frames with Column expressions over BINARY."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the wire formats.
ETHERNET_LEN = 14
ETHERTYPE_IPV4 = 0x0800
TAG_TYPES = (0x8100, 0x88A8, 0x9100)
MAX_TAGS = 2
MIN_HEADER = {6: 20, 17: 8, 1: 4}


def _number(data: Column, at: Column | int, size: int) -> Column:
    """Unsigned big-endian number of ``size`` bytes at a 0-based offset."""
    start = (F.lit(at) if isinstance(at, int) else at) + 1
    return F.conv(F.hex(F.substring(data, start, F.lit(size))), 16, 10).cast("bigint")


def _mac(data: Column, at: int) -> Column:
    return F.lower(F.concat_ws(":", *[F.hex(F.substring(data, at + i + 1, 1)) for i in range(6)]))


def _ipv4(data: Column, at: Column | int) -> Column:
    return F.concat_ws(".", *[_number(data, at + i, 1).cast("string") for i in range(4)])


def _network_offset(raw: Column) -> tuple[Column, Column]:
    """Where the network header starts behind up to MAX_TAGS tags, and its type."""
    kind, at = _number(raw, 12, 2), F.lit(ETHERNET_LEN)
    for _ in range(MAX_TAGS):
        tagged = F.coalesce(kind.isin(list(TAG_TYPES)), F.lit(False))
        kind, at = F.when(tagged, _number(raw, at + 2, 2)).otherwise(kind), F.when(tagged, at + 4).otherwise(at)
    return at, kind


def decode(frames: DataFrame, keep: tuple[str, ...] = ("packet_id", "ts_us")) -> DataFrame:
    """Flat packets from ``frame`` bytes.

    Frames that are not whole IPv4 frames are dropped; up to two VLAN tags are skipped. An IP length of
    0 (left to the network card) means all captured bytes. A transport header that is cut off leaves
    its fields null; so does a fragment that is not the first, whose payload is all of its data.
    """
    raw = F.col("frame")
    net, kind = _network_offset(raw)
    placed = frames.select(*keep, "frame", net.alias("net"), kind.alias("kind"), F.octet_length(raw).alias("length")).where(
        (F.col("kind") == ETHERTYPE_IPV4) & (F.col("length") >= F.col("net") + 20)
    )
    net = F.col("net")
    head = placed.select(
        *keep, "frame", "net", "length",
        _number(raw, net, 1).alias("vhl"),
        _number(raw, net + 2, 2).cast("int").alias("told_len"),
        (_number(raw, net + 6, 2).bitwiseAND(0x1FFF) > 0).alias("rest"),
        _number(raw, net + 8, 1).cast("int").alias("ttl"),
        _number(raw, net + 9, 1).cast("int").alias("protocol"),
        _mac(raw, 6).alias("eth_src"), _mac(raw, 0).alias("eth_dst"),
        _ipv4(raw, net + 12).alias("src_ip"), _ipv4(raw, net + 16).alias("dst_ip"),
    ).withColumn("ip_len", F.when(F.col("told_len") == 0, F.col("length") - net).otherwise(F.col("told_len")))
    header = F.col("vhl").bitwiseAND(15).cast("int") * 4
    valid = (F.shiftright("vhl", 4) == 4) & (header >= 20) & (F.col("ip_len") >= header)
    # Bytes after the IP length are Ethernet padding.
    end = F.least(F.col("length"), F.col("ip_len") + net)
    placed = head.where(valid).withColumns({"at": header + net, "end": end})
    at, size = F.col("at"), F.col("end") - F.col("at")
    whole = ~F.col("rest")
    tcp = whole & (F.col("protocol") == 6) & (size >= MIN_HEADER[6])
    udp = whole & (F.col("protocol") == 17) & (size >= MIN_HEADER[17])
    icmp = whole & (F.col("protocol") == 1) & (size >= MIN_HEADER[1])
    field = lambda when, off, n: F.when(when, _number(raw, at + off, n))
    tcp_header = F.shiftright(_number(raw, at + 12, 1), 4).cast("int") * 4
    skip = F.when(tcp, F.greatest(tcp_header, F.lit(20))).when(udp, F.lit(8)).when(icmp, F.lit(4)).when(F.col("rest"), F.lit(0))
    return placed.select(
        *keep, "eth_src", "eth_dst", "src_ip", "dst_ip",
        field(tcp | udp, 0, 2).cast("int").alias("src_port"),
        field(tcp | udp, 2, 2).cast("int").alias("dst_port"),
        "protocol", "length", "ip_len", "ttl",
        field(tcp, 13, 1).cast("int").alias("flags"),
        field(tcp, 4, 4).alias("seq"), field(tcp, 8, 4).alias("ack"),
        field(tcp, 14, 2).cast("int").alias("winsize"),
        field(udp, 4, 2).cast("int").alias("udp_length"),
        field(icmp, 0, 1).cast("int").alias("icmp_type"), field(icmp, 1, 1).cast("int").alias("icmp_code"),
        F.when(
            skip.isNotNull() & (F.col("end") > at + skip),
            F.substring(raw, at + skip + 1, F.col("end") - at - skip),
        ).alias("payload"),
    )


def nested(packets: DataFrame) -> DataFrame:
    """The layered packet shape: ethernet, ip and transport structs."""
    return packets.select(
        "packet_id", (F.col("ts_us") / 1e6).alias("timestamp"), "length",
        F.struct(F.col("eth_src").alias("src"), F.col("eth_dst").alias("dst"), F.lit(ETHERTYPE_IPV4).alias("type")).alias("ethernet"),
        F.struct(F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"), "protocol", F.col("ip_len").alias("len"), "ttl").alias("ip"),
        F.struct("src_port", "dst_port", "flags", "seq", "ack", "winsize", F.col("udp_length").alias("length"),
                 F.col("icmp_type").alias("type"), F.col("icmp_code").alias("code")).alias("transport"),
        "payload",
    )


def flat(layers: DataFrame) -> DataFrame:
    """The flat shape of layered packets; packets without an IP layer are dropped."""
    return layers.where(F.col("ip.protocol").isNotNull()).select(
        "packet_id", F.round(F.col("timestamp") * 1e6).cast("bigint").alias("ts_us"),
        F.col("ip.src").alias("src_ip"), F.col("ip.dst").alias("dst_ip"),
        "transport.src_port", "transport.dst_port", "ip.protocol", "length", "transport.flags",
        "transport.seq", "transport.winsize", F.col("transport.type").alias("icmp_type"),
        F.col("transport.code").alias("icmp_code"), "payload",
    )


# Bit of each named TCP flag.
FLAG_BITS = {"FIN": 1, "SYN": 2, "RST": 4, "PSH": 8, "ACK": 16, "URG": 32}


def flags_from_map(flags: str | Column) -> Column:
    """Bitmask of a map of named flags; NULL without a map."""
    m = F.col(flags) if isinstance(flags, str) else flags
    bits = sum(F.when(F.coalesce(F.try_element_at(m, F.lit(n)), F.lit(False)), b).otherwise(0) for n, b in FLAG_BITS.items())
    return F.when(m.isNotNull(), bits)
