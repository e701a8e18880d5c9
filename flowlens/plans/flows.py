"""Sessions and statistical features of the packet feed."""

from __future__ import annotations

from flowlens.config import SessionConfig
from flowlens.operators import sessions as S
from flowlens.operators import stat
from flowlens.plans.registry import HOUR, query, rd, rounded
from flowlens.schemas import STAT_FEATURES
from flowlens.sources.adapters import PACKETS_SQL, packets

# The feed is sparse, so its timeout is half a day; its slices are then 24 minutes.
TIMEOUT = 12 * HOUR
CFG = SessionConfig.of(TIMEOUT)

_PNAME = "CASE protocol WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 1 THEN 'icmp' ELSE 'unknown(' || protocol || ')' END"
_PORTED = "protocol IN (6, 17) AND src_port IS NOT NULL AND dst_port IS NOT NULL"
KEY_SQL = f"""CASE WHEN {_PORTED} THEN least(src_ip, dst_ip) || ':' || least(src_port, dst_port) || '-' ||
    greatest(src_ip, dst_ip) || ':' || greatest(src_port, dst_port) || '-' || {_PNAME}
  ELSE least(src_ip, dst_ip) || '-' || greatest(src_ip, dst_ip) || '-' || {_PNAME} END"""
ENDPOINT_SQL = f"""CASE WHEN {_PORTED} THEN
    CASE WHEN src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port)
      THEN src_ip || ':' || src_port || '-' || dst_ip || ':' || dst_port
      ELSE dst_ip || ':' || dst_port || '-' || src_ip || ':' || src_port END || '-' || {_PNAME}
  ELSE least(src_ip, dst_ip) || '-' || greatest(src_ip, dst_ip) || '-' || {_PNAME} END"""


def flow_sql(timeout: int = TIMEOUT, key: str = KEY_SQL) -> str:
    return f"""{PACKETS_SQL},
keyed AS (SELECT *, {key} AS session_key FROM packets WHERE protocol IS NOT NULL),
gapped AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY session_key ORDER BY ts_us, packet_id) > {timeout}
  THEN 1 ELSE 0 END AS opens FROM keyed),
flow AS (SELECT *, CAST(1 + sum(opens) OVER (PARTITION BY session_key ORDER BY ts_us, packet_id
  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_seq FROM gapped)"""


_SIDE = "CASE WHEN src_ip <= dst_ip THEN {a} ELSE {b} END"
SESSION_SQL = f"""session AS (
  SELECT session_key || '#' || session_seq AS session_id, session_key, session_seq,
    min(least(src_ip, dst_ip)) AS src_ip, min(greatest(src_ip, dst_ip)) AS dst_ip,
    arg_min({_SIDE.format(a='src_port', b='dst_port')}, (ts_us, packet_id)) AS src_port,
    arg_min({_SIDE.format(a='dst_port', b='src_port')}, (ts_us, packet_id)) AS dst_port,
    min({_PNAME}) AS protocol_name, min(protocol) AS protocol, count(*) AS total_packets,
    CAST(sum(length) AS BIGINT) AS total_bytes, min(ts_us) AS start_us, max(ts_us) AS end_us,
    (max(ts_us) - min(ts_us)) / 1e6 AS duration,
    count(*) FILTER (WHERE protocol = 6 AND flags & 2 <> 0) AS tcp_syn_count,
    count(*) FILTER (WHERE protocol = 6 AND flags & 16 <> 0) AS tcp_ack_count,
    count(*) FILTER (WHERE protocol = 6 AND flags & 1 <> 0) AS tcp_fin_count,
    count(*) FILTER (WHERE protocol = 6 AND flags & 4 <> 0) AS tcp_rst_count
  FROM flow GROUP BY session_key, session_seq)"""

STAT_SQL = """stat AS (
  SELECT session_key, session_seq, min(protocol) AS protocol, min(ts_us) AS first_ts, max(ts_us) AS last_ts,
    count(*)::DOUBLE AS packet_count, sum(length)::DOUBLE AS byte_count,
    CASE WHEN count(*) < 2 THEN 0 WHEN max(ts_us) > min(ts_us) THEN (max(ts_us) - min(ts_us)) / 1e6 ELSE 0.001 END AS flow_duration,
    avg(length) AS avg_packet_size, stddev_pop(length) AS std_packet_size,
    min(length)::DOUBLE AS min_packet_size, max(length)::DOUBLE AS max_packet_size,
    coalesce(byte_count / nullif(flow_duration, 0), 0) AS bytes_per_second,
    coalesce(packet_count / nullif(flow_duration, 0), 0) AS packets_per_second,
    (count(*) FILTER (WHERE protocol = 6 AND flags & 2 <> 0))::DOUBLE AS tcp_syn_count,
    (count(*) FILTER (WHERE protocol = 6 AND flags & 16 <> 0))::DOUBLE AS tcp_ack_count,
    (count(*) FILTER (WHERE protocol = 6 AND flags & 1 <> 0))::DOUBLE AS tcp_fin_count,
    (count(*) FILTER (WHERE protocol = 6 AND flags & 4 <> 0))::DOUBLE AS tcp_rst_count,
    coalesce((count(*) FILTER (WHERE protocol = 6 AND flags <> 0)) / nullif(count(*) FILTER (WHERE protocol = 6), 0), 0) AS tcp_flag_ratio,
    avg(CAST(protocol = 6 AS INT)) AS tcp_packet_ratio, avg(CAST(protocol = 17 AS INT)) AS udp_packet_ratio,
    avg(CAST(protocol IN (1, 58) AS INT)) AS icmp_packet_ratio,
    avg(length(payload)) AS avg_payload_size, stddev_pop(length(payload)) AS payload_size_std,
    avg(CAST(src_ip <= dst_ip AS INT)) AS outbound_packet_ratio,
    avg(CAST(src_ip > dst_ip AS INT)) AS inbound_packet_ratio
  FROM flow GROUP BY session_key, session_seq)"""


def _hist_sql(name: str, symbol: str, source: str = "flow") -> str:
    return f"""{name} AS (SELECT session_key, session_seq,
    CASE WHEN count(*) <= 1 THEN 0 ELSE log2(sum(c)) - sum(c * log2(c)) / sum(c) END AS h
  FROM (SELECT session_key, session_seq, {symbol} AS s, count(*) AS c FROM {source}
    WHERE {symbol} IS NOT NULL GROUP BY ALL) GROUP BY ALL)"""


ENTROPY_SQL = ",\n".join([
    """bytes AS (SELECT session_key, session_seq, substr(payload, i, 1) AS b FROM (
  SELECT session_key, session_seq, payload, unnest(range(1, length(payload) + 1)) AS i FROM flow))""",
    _hist_sql("payload_h", "b", "bytes"), _hist_sql("src_h", "src_port"), _hist_sql("dst_h", "dst_port"),
    """full_stat AS (SELECT stat.*, coalesce(p.h, 0) AS payload_entropy, coalesce(s.h, 0) AS src_port_entropy,
    coalesce(t.h, 0) AS dst_port_entropy FROM stat
  LEFT JOIN payload_h p USING (session_key, session_seq) LEFT JOIN src_h s USING (session_key, session_seq)
  LEFT JOIN dst_h t USING (session_key, session_seq))""",
])


@query("session_keys", f"WITH {flow_sql()} SELECT packet_id, session_key FROM flow")
def _keys(spark, d):
    return S.keyed(packets(spark, d), CFG).select("packet_id", "session_key")


@query("session_keys_endpoint", f"WITH {flow_sql(key=ENDPOINT_SQL)} SELECT packet_id, session_key FROM flow")
def _keys_endpoint(spark, d):
    return S.keyed(packets(spark, d), SessionConfig.of(TIMEOUT, "endpoint")).select("packet_id", "session_key")


@query("gap_sessions", f"WITH {flow_sql()} SELECT packet_id, session_key, session_seq FROM flow")
def _assign(spark, d):
    return S.assign_sessions(packets(spark, d), CFG).select("packet_id", "session_key", "session_seq")


@query("gap_sessions_default_timeout",
       f"WITH {flow_sql(300_000_000)} SELECT packet_id, session_key, session_seq FROM flow")
def _assign_default(spark, d):
    return S.assign_sessions(packets(spark, d)).select("packet_id", "session_key", "session_seq")


_ROW = ("session_id, src_ip, dst_ip, src_port, dst_port, protocol_name, total_packets, total_bytes, start_us, end_us, "
        f"{rd('duration', 'duration')}, tcp_syn_count, tcp_ack_count, tcp_fin_count, tcp_rst_count")


def _session_columns(df):
    return rounded(df.drop("session_key", "session_seq", "protocol"))


@query("session_rows", f"WITH {flow_sql()}, {SESSION_SQL} SELECT {_ROW} FROM session")
def _sessions(spark, d):
    return _session_columns(S.sessions(packets(spark, d), CFG))


@query("recent_sessions", f"WITH {flow_sql()}, {SESSION_SQL} SELECT {_ROW} FROM session ORDER BY end_us DESC, session_id LIMIT 100")
def _recent(spark, d):
    return _session_columns(S.recent_sessions(S.sessions(packets(spark, d), CFG), 100))


@query("session_lookup", f"WITH {flow_sql()}, {SESSION_SQL} SELECT {_ROW} FROM session WHERE session_id = '10.0.0.7-10.0.1.1-icmp#1'")
def _lookup(spark, d):
    return _session_columns(S.find_session(S.sessions(packets(spark, d), CFG), "10.0.0.7-10.0.1.1-icmp#1"))


@query("session_packet_cap", f"""WITH {flow_sql()}
SELECT packet_id, session_key, session_seq, packet_no FROM (SELECT *, row_number() OVER (
  PARTITION BY session_key, session_seq ORDER BY ts_us, packet_id) AS packet_no FROM flow) WHERE packet_no <= 3""")
def _cap(spark, d):
    return S.cap_packets(packets(spark, d), CFG, 3).select("packet_id", "session_key", "session_seq", "packet_no")


_BASIC = ("SELECT session_id, protocol_name AS protocol, " + ", ".join([
    rd("end_us / 1e6", '"timestamp"'), rd("{dur}", "flow_duration"),
    "total_packets AS packet_count, total_bytes AS byte_count",
    rd("CASE WHEN {dur} > 0 THEN total_bytes / {dur} ELSE 0 END", "bytes_per_second"),
    rd("CASE WHEN {dur} > 0 THEN total_packets / {dur} ELSE 0 END", "packets_per_second"),
    rd("total_bytes / total_packets", "avg_packet_size"),
]) + " FROM session")


@query("session_basic_features", f"WITH {flow_sql()}, {SESSION_SQL} {_BASIC.format(dur='duration')}")
def _basic(spark, d):
    return rounded(S.basic_features(S.sessions(packets(spark, d), CFG)).drop("src_ip", "dst_ip", "src_port", "dst_port"))


@query("session_floored_features", f"WITH {flow_sql()}, {SESSION_SQL} {_BASIC.format(dur='greatest(duration, 0.001)')}")
def _floored(spark, d):
    rows = S.basic_features(S.sessions(packets(spark, d), CFG), 0.001)
    return rounded(rows.drop("src_ip", "dst_ip", "src_port", "dst_port"))


@query("stat_features", f"WITH {flow_sql()}, {STAT_SQL}, {ENTROPY_SQL} "
       "SELECT session_key, session_seq, " + ", ".join(rd(f, f) for f in STAT_FEATURES) + " FROM full_stat")
def _stat(spark, d):
    return rounded(stat.stat_features(packets(spark, d), CFG).select("session_key", "session_seq", *STAT_FEATURES))


_FEW = ["packet_count", "byte_count", "avg_packet_size"]


@query("stat_features_enabled", f"WITH {flow_sql()}, {STAT_SQL} "
       "SELECT session_key, session_seq, " + ", ".join(rd(f, f) for f in _FEW) + " FROM stat")
def _enabled(spark, d):
    return rounded(stat.stat_features(packets(spark, d), CFG, enabled=_FEW).select("session_key", "session_seq", *_FEW))


@query("session_payload_entropy", f"WITH {flow_sql()}, {STAT_SQL}, {ENTROPY_SQL} SELECT session_key, session_seq, {rd('h', 'payload_entropy')} FROM payload_h")
def _payload_entropy(spark, d):
    rows = stat.session_entropies(packets(spark, d), CFG, ["payload_entropy"])
    return rounded(rows)


@query("session_port_entropy", f"WITH {flow_sql()}, {STAT_SQL}, {ENTROPY_SQL} SELECT session_key, session_seq, {rd('h', 'src_port_entropy')} FROM src_h")
def _port_entropy(spark, d):
    return rounded(stat.session_entropies(packets(spark, d), CFG, ["src_port_entropy"]))

