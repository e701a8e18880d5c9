"""Bidirectional sessions: key, gap sessionization, session rows and lookups.

Packets are first combined per ``(session_key, chunk)``, where a chunk is a time slice no
longer than the timeout. All packets of a chunk belong to one session, so sessions are
found on the chunk rows: a key has at most one chunk row per time slice, however many
packets it carries. The combine is map-side, so a flooded key shrinks before any shuffle.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.config import SessionConfig
from flowlens.functions.scalars import has_flag, protocol_name
from flowlens.functions.specs import ACK, FIN, RST, SYN

DEC = "decimal(38,0)"
ID_SPAN = Decimal(10) ** 19  # above every packet id


def _endpoint(ip: Column, port: Column) -> Column:
    return F.concat(ip, F.lit(":"), port.cast("string"))


def session_key(mode: str = "compat") -> Column:
    """Direction-free flow key of a packet.

    ``compat`` sorts addresses and ports independently; ``endpoint`` sorts (address, port) pairs.
    """
    src_ip, dst_ip = F.col("src_ip"), F.col("dst_ip")
    src_port, dst_port = F.col("src_port"), F.col("dst_port")
    lo_ip, hi_ip = F.least(src_ip, dst_ip), F.greatest(src_ip, dst_ip)
    name = protocol_name("protocol")
    if mode == "compat":
        a = _endpoint(lo_ip, F.least(src_port, dst_port))
        b = _endpoint(hi_ip, F.greatest(src_port, dst_port))
    elif mode == "endpoint":
        keep = (src_ip < dst_ip) | ((src_ip == dst_ip) & (src_port <= dst_port))
        first, second = _endpoint(src_ip, src_port), _endpoint(dst_ip, dst_port)
        a, b = F.when(keep, first).otherwise(second), F.when(keep, second).otherwise(first)
    else:
        raise ValueError(f"unknown key mode {mode!r}")
    ported = F.col("protocol").isin(6, 17) & src_port.isNotNull() & dst_port.isNotNull()
    return F.when(ported, F.concat_ws("-", a, b, name)).otherwise(F.concat_ws("-", lo_ip, hi_ip, name))


def keyed(packets: DataFrame, cfg: SessionConfig = SessionConfig()) -> DataFrame:
    """IP packets with ``session_key`` and ``chunk``."""
    return packets.where(F.col("protocol").isNotNull()).withColumns(
        {
            "session_key": session_key(cfg.mode),
            "chunk": F.expr(f"(ts_us - pmod(ts_us, {cfg.chunk_us})) DIV {cfg.chunk_us}"),
        }
    )


def _oriented(port: str, other: str) -> Column:
    """Port on the side of the lower address."""
    return F.when(F.col("src_ip") <= F.col("dst_ip"), F.col(port)).otherwise(F.col(other))


def _count(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def packet_measures() -> dict[str, Column]:
    """Mergeable per-chunk aggregates. All buffers are fixed-width, so hash aggregation applies."""
    flags = F.col("flags")
    tcp = F.col("protocol") == 6
    length = F.col("length").cast("bigint")
    payload = F.coalesce(F.octet_length("payload"), F.lit(0)).cast("bigint")
    # Order of arrival as one fixed-width number: time, then packet id.
    arrival = (F.col("ts_us").cast("decimal(17,0)") * F.lit(ID_SPAN) + F.col("packet_id")).cast(DEC)
    return {
        "n": F.count(F.lit(1)),
        "bytes": F.sum(length),
        "sumsq": F.sum(length * length),
        "min_len": F.min(length),
        "max_len": F.max(length),
        "first_ts": F.min("ts_us"),
        "last_ts": F.max("ts_us"),
        "syn": _count(tcp & has_flag(flags, SYN)),
        "ack": _count(tcp & has_flag(flags, ACK)),
        "fin": _count(tcp & has_flag(flags, FIN)),
        "rst": _count(tcp & has_flag(flags, RST)),
        "flagged": _count(tcp & (F.coalesce(flags, F.lit(0)) != 0)),
        "tcp_n": _count(tcp),
        "udp_n": _count(F.col("protocol") == 17),
        "icmp_n": _count(F.col("protocol").isin(1, 58)),
        "pl_bytes": F.sum(payload),
        "pl_sumsq": F.sum(payload * payload),
        "out_n": _count(F.col("src_ip") <= F.col("dst_ip")),
        "protocol": F.min("protocol"),
        "src_port": F.min_by(_oriented("src_port", "dst_port"), arrival),
        "dst_port": F.min_by(_oriented("dst_port", "src_port"), arrival),
    }


# How each chunk aggregate merges into its session aggregate.
MIN_MERGE = {"min_len", "first_ts", "protocol"}
MAX_MERGE = {"max_len", "last_ts"}
FIRST_MERGE = {"src_port", "dst_port"}
WIDE_SUM = {"sumsq", "pl_sumsq"}


def merge(name: str) -> Column:
    """A session's measure from those of its chunks."""
    if name in MIN_MERGE:
        return F.min(name)
    if name in MAX_MERGE:
        return F.max(name)
    if name in FIRST_MERGE:
        return F.min_by(name, "first_ts")
    if name in WIDE_SUM:
        return F.sum(F.col(name).cast("decimal(20,0)"))
    return F.sum(name)


def number_chunks(chunks: DataFrame, timeout_us: int) -> DataFrame:
    """Adds ``session_seq`` (1, 2, … per key): a gap above the timeout opens a session."""
    w = Window.partitionBy("session_key").orderBy("chunk")
    opens = F.col("first_ts") - F.lag("last_ts").over(w) > timeout_us
    return chunks.withColumn("__opens", F.when(opens, 1).otherwise(0)).withColumn(
        "session_seq", F.sum("__opens").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1
    ).drop("__opens")


def session_chunks(packets: DataFrame, cfg: SessionConfig, measures: dict[str, Column]) -> DataFrame:
    """Chunk rows with the given aggregates and their session number."""
    per_chunk = keyed(packets, cfg).groupBy("session_key", "chunk").agg(
        *[c.alias(n) for n, c in measures.items()]
    )
    return number_chunks(per_chunk, cfg.timeout_us)


def session_aggregates(packets: DataFrame, cfg: SessionConfig = SessionConfig()) -> DataFrame:
    """One row per session with the merged measures; the third grouping reuses the key shuffle."""
    measures = packet_measures()
    return session_chunks(packets, cfg, measures).groupBy("session_key", "session_seq").agg(
        *[merge(n).alias(n) for n in measures]
    )


def session_id() -> Column:
    return F.concat(F.col("session_key"), F.lit("#"), F.col("session_seq").cast("string"))


def stable_id() -> Column:
    """Id of a session from its key and start: the same in batches and streams, and whatever else was read with it."""
    return F.concat(F.col("session_key"), F.lit("@"), F.col("start_us").cast("string"))


def _key_ips() -> tuple[Column, Column]:
    """Addresses from the key; the port, if any, is what follows the last colon."""
    def ip(side: Column) -> Column:
        return F.when(F.col("src_port").isNull(), side).otherwise(
            F.regexp_replace(side, r":[0-9]+$", "")
        )

    first = F.substring_index("session_key", "-", 1)
    second = F.substring_index(F.substring_index("session_key", "-", 2), "-", -1)
    a, b = ip(first), ip(second)
    return F.least(a, b), F.greatest(a, b)


def sessions(packets: DataFrame, cfg: SessionConfig = SessionConfig()) -> DataFrame:
    """Session rows, oriented so that src_ip <= dst_ip, ports taken from the first packet."""
    agg = session_aggregates(packets, cfg)
    src_ip, dst_ip = _key_ips()
    tcp_only = lambda c: F.when(F.col("protocol") == 6, F.col(c)).otherwise(0)
    return agg.select(
        session_id().alias("session_id"),
        "session_key",
        "session_seq",
        src_ip.alias("src_ip"),
        dst_ip.alias("dst_ip"),
        "src_port",
        "dst_port",
        protocol_name("protocol").alias("protocol_name"),
        "protocol",
        F.col("n").alias("total_packets"),
        F.col("bytes").alias("total_bytes"),
        F.col("first_ts").alias("start_us"),
        F.col("last_ts").alias("end_us"),
        ((F.col("last_ts") - F.col("first_ts")) / 1e6).alias("duration"),
        tcp_only("syn").alias("tcp_syn_count"),
        tcp_only("ack").alias("tcp_ack_count"),
        tcp_only("fin").alias("tcp_fin_count"),
        tcp_only("rst").alias("tcp_rst_count"),
    )


def find_session(session_rows: DataFrame, session_id_value: str) -> DataFrame:
    return session_rows.where(F.col("session_id") == session_id_value)


def recent_sessions(session_rows: DataFrame, limit: int = 100) -> DataFrame:
    """Most recently active sessions; ties by id."""
    return session_rows.orderBy(F.desc("end_us"), "session_id").limit(limit)


def assign_sessions(packets: DataFrame, cfg: SessionConfig = SessionConfig()) -> DataFrame:
    """Packets with ``session_seq``, by joining the chunk numbering back on (key, chunk)."""
    numbered = session_chunks(
        packets, cfg, {"first_ts": F.min("ts_us"), "last_ts": F.max("ts_us")}
    ).select("session_key", "chunk", "session_seq")
    return keyed(packets, cfg).join(numbered, ["session_key", "chunk"])


def cap_packets(packets: DataFrame, cfg: SessionConfig = SessionConfig(), limit: int = 1000) -> DataFrame:
    """First ``limit`` packets of each session.

    A chunk can contribute at most ``limit`` packets, so each chunk keeps its own first ones
    and only chunks starting below the limit are joined. Spark prunes the rank per map task.
    """
    numbered = session_chunks(
        packets, cfg, {"first_ts": F.min("ts_us"), "last_ts": F.max("ts_us"), "n": F.count(F.lit(1))}
    )
    before = (
        Window.partitionBy("session_key", "session_seq")
        .orderBy("chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = numbered.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(
        F.col("before") < limit
    ).select("session_key", "chunk", "session_seq", "before")
    order = Window.partitionBy("session_key", "chunk").orderBy("ts_us", "packet_id")
    ranked = keyed(packets, cfg).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit)
    return (
        ranked.join(starts, ["session_key", "chunk"])
        .withColumn("packet_no", F.col("rn") + F.col("before"))
        .where(F.col("packet_no") <= limit)
        .drop("rn", "before")
    )


def basic_features(session_rows: DataFrame, floor_s: float | None = None) -> DataFrame:
    """Rates and mean size of a session row; ``floor_s`` replaces shorter durations."""
    raw = F.col("duration")
    duration = F.greatest(raw, F.lit(floor_s)) if floor_s is not None else raw
    return session_rows.select(
        "session_id", "src_ip", "dst_ip", "src_port", "dst_port",
        F.col("protocol_name").alias("protocol"),
        (F.col("end_us") / 1e6).alias("timestamp"),
        duration.alias("flow_duration"),
        F.col("total_packets").alias("packet_count"),
        F.col("total_bytes").alias("byte_count"),
        F.when(duration > 0, F.col("total_bytes") / duration).otherwise(0.0).alias("bytes_per_second"),
        F.when(duration > 0, F.col("total_packets") / duration).otherwise(0.0).alias("packets_per_second"),
        F.when(F.col("total_packets") > 0, F.col("total_bytes") / F.col("total_packets"))
        .otherwise(0.0)
        .alias("avg_packet_size"),
    )
