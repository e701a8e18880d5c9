"""Temporal features of the packet feed, at the feed's own time scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.config import WindowConfig
from flowlens.operators import temporal as E
from flowlens.operators.stat import KEY
from flowlens.plans.flows import CFG, ENTROPY_SQL, STAT_SQL, flow_sql
from flowlens.plans.registry import DAY, HOUR, query, rd, rounded
from flowlens.schemas import ALL_FEATURES, TEMPORAL_FEATURES, WINDOW_MEASURES
from flowlens.sources.adapters import PACKETS_SQL, packets

WINDOWS = WindowConfig((6 * HOUR, HOUR), (DAY, 4 * HOUR), (5 * DAY, DAY), 2 * HOUR)


def _window_sql(name: str, size: int, burst: int) -> str:
    """Plain reading of one trailing window: cut, gaps inside the cut, islands of short gaps."""
    part = "PARTITION BY session_key, session_seq"
    return f"""
{name}_cut AS (SELECT * FROM (SELECT *, max(ts_us) OVER ({part}) AS last_us FROM flow) WHERE ts_us >= last_us - {size}),
{name}_gap AS (SELECT *, ts_us - lag(ts_us) OVER ({part} ORDER BY ts_us, packet_id) AS gap FROM {name}_cut),
{name}_isl AS (SELECT *, sum(CASE WHEN gap <= {burst} THEN 0 ELSE 1 END) OVER (
  {part} ORDER BY ts_us, packet_id ROWS UNBOUNDED PRECEDING) AS island FROM {name}_gap),
{name}_burst AS (SELECT session_key, session_seq, count(*) AS bursts, avg(dur) AS dur FROM (
  SELECT session_key, session_seq, island, (max(ts_us) - min(ts_us)) / 1e6 AS dur FROM {name}_isl
  GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL),
{name}_w AS (SELECT session_key, session_seq,
  CASE WHEN count(*) < 2 THEN {size / 1e6} ELSE greatest((max(ts_us) - min(ts_us)) / 1e6, 0.001) END AS dur,
  count(*) / dur AS {name}_window_packet_rate, sum(length) / dur AS {name}_window_byte_rate,
  avg(length) AS {name}_window_packet_size_mean, stddev_pop(length) AS {name}_window_packet_size_std,
  coalesce(avg(gap / 1e6), 0) AS {name}_window_inter_arrival_mean,
  coalesce(stddev_pop(gap / 1e6), 0) AS {name}_window_inter_arrival_std
  FROM {name}_gap GROUP BY ALL)"""


def _temporal_sql() -> str:
    parts = [_window_sql(n, s, WINDOWS.burst_gap_us) for n, s in WINDOWS.sizes().items()]
    joins = "short_w" + "".join(f" JOIN {n}_w USING (session_key, session_seq)" for n in ("medium", "long"))
    joins += "".join(f" LEFT JOIN {n}_burst USING (session_key, session_seq)" for n in WINDOWS.sizes())
    cols = ", ".join(f"{n}_window_{m}" for n in WINDOWS.sizes() for m in WINDOW_MEASURES[:6])
    cols += "".join(
        f", coalesce({n}_burst.bursts, 0) AS {n}_window_burst_count, coalesce({n}_burst.dur, 0) AS {n}_window_burst_duration_mean"
        for n in WINDOWS.sizes()
    )
    change = "CASE WHEN short_window_{x} > 0 THEN abs(medium_window_{x} - short_window_{x}) / short_window_{x} ELSE 0 END"
    return ",".join(parts) + f""",
temporal AS (SELECT session_key, session_seq, {cols},
  medium_window_packet_rate - short_window_packet_rate AS packet_rate_trend,
  medium_window_byte_rate - short_window_byte_rate AS byte_rate_trend,
  {change.format(x='packet_size_mean')} AS packet_size_variation,
  {change.format(x='inter_arrival_mean')} AS inter_arrival_variation FROM {joins})"""


@query("temporal_features", f"WITH {flow_sql()}, {_temporal_sql()} SELECT session_key, session_seq, "
       + ", ".join(rd(f, f) for f in TEMPORAL_FEATURES) + " FROM temporal")
def _temporal(spark, d):
    return rounded(E.temporal_features(packets(spark, d), CFG, WINDOWS).drop("session_id"))


@query("flow_features", f"WITH {flow_sql()}, {STAT_SQL}, {ENTROPY_SQL}, {_temporal_sql()} SELECT session_key, session_seq, "
       + ", ".join(rd(f, f) for f in ALL_FEATURES)
       + " FROM full_stat JOIN temporal USING (session_key, session_seq)")
def _flow(spark, d):
    return rounded(E.flow_features(packets(spark, d), CFG, WINDOWS).select(*KEY, *ALL_FEATURES))


@query("trailing_window_per_packet", f"""WITH {flow_sql()},
w AS (SELECT DISTINCT session_key, session_seq, ts_us, count(*) OVER f AS n, sum(length) OVER f AS b, min(ts_us) OVER f AS lo,
  avg(length) OVER f AS m, stddev_pop(length) OVER f AS s FROM flow
  WINDOW f AS (PARTITION BY session_key, session_seq ORDER BY ts_us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW)),
x AS (SELECT *, CASE WHEN n < 2 THEN {DAY / 1e6} ELSE greatest((ts_us - lo) / 1e6, 0.001) END AS dur FROM w)
SELECT session_key, session_seq, ts_us, n AS window_packets, CAST(b AS BIGINT) AS window_bytes,
  {rd('n / dur', 'packet_rate')}, {rd('b / dur', 'byte_rate')}, {rd('m', 'packet_size_mean')}, {rd('s', 'packet_size_std')},
  {rd('CASE WHEN n > 1 THEN (ts_us - lo) / 1e6 / (n - 1) ELSE 0 END', 'inter_arrival_mean')} FROM x""")
def _trailing(spark, d):
    return rounded(E.trailing_windows(packets(spark, d), DAY, CFG).drop("session_id"))


def _packet_window_sql(name: str, size: int, burst: int) -> str:
    """Plain reading of the window of each packet: its packets, their gaps, islands of short gaps."""
    return f"""
{name}_in AS (SELECT a.packet_id AS own, b.ts_us, b.packet_id, b.length FROM flow a JOIN flow b
  ON a.session_key = b.session_key AND a.session_seq = b.session_seq AND b.ts_us >= a.ts_us - {size}
  AND (b.ts_us < a.ts_us OR b.ts_us = a.ts_us AND b.packet_id <= a.packet_id)),
{name}_gap AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY own ORDER BY ts_us, packet_id) AS gap FROM {name}_in),
{name}_isl AS (SELECT *, sum(CASE WHEN gap <= {burst} THEN 0 ELSE 1 END) OVER (
  PARTITION BY own ORDER BY ts_us, packet_id ROWS UNBOUNDED PRECEDING) AS island FROM {name}_gap),
{name}_burst AS (SELECT own, count(*) AS bursts, avg(dur) AS dur FROM (
  SELECT own, island, (max(ts_us) - min(ts_us)) / 1e6 AS dur FROM {name}_isl GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL),
{name}_w AS (SELECT own,
  CASE WHEN count(*) < 2 THEN {size / 1e6} ELSE greatest((max(ts_us) - min(ts_us)) / 1e6, 0.001) END AS dur,
  count(*) / dur AS {name}_window_packet_rate, sum(length) / dur AS {name}_window_byte_rate,
  avg(length) AS {name}_window_packet_size_mean, stddev_pop(length) AS {name}_window_packet_size_std,
  coalesce(avg(gap / 1e6), 0) AS {name}_window_inter_arrival_mean,
  coalesce(stddev_pop(gap / 1e6), 0) AS {name}_window_inter_arrival_std FROM {name}_gap GROUP BY ALL)"""


def _packet_windows_sql() -> str:
    names = list(WINDOWS.sizes())
    parts = ",".join(_packet_window_sql(n, s, WINDOWS.burst_gap_us) for n, s in WINDOWS.sizes().items())
    joins = "flow JOIN short_w ON packet_id = own" + "".join(f" JOIN {n}_w USING (own)" for n in names[1:])
    joins += "".join(f" LEFT JOIN {n}_burst USING (own)" for n in names)
    cols = ", ".join(f"{n}_window_{m}" for n in names for m in WINDOW_MEASURES[:6])
    cols += "".join(
        f", coalesce({n}_burst.bursts, 0) AS {n}_window_burst_count, coalesce({n}_burst.dur, 0) AS {n}_window_burst_duration_mean" for n in names
    )
    change = "CASE WHEN short_window_{x} > 0 THEN abs(medium_window_{x} - short_window_{x}) / short_window_{x} ELSE 0 END"
    return f"""WITH {flow_sql()},{parts},
x AS (SELECT session_key, session_seq, ts_us, packet_id, {cols} FROM {joins})
SELECT session_key, session_seq, ts_us, packet_id, {', '.join(rd(f, f) for f in TEMPORAL_FEATURES)} FROM (SELECT *,
  medium_window_packet_rate - short_window_packet_rate AS packet_rate_trend, medium_window_byte_rate - short_window_byte_rate AS byte_rate_trend,
  {change.format(x='packet_size_mean')} AS packet_size_variation, {change.format(x='inter_arrival_mean')} AS inter_arrival_variation FROM x)"""


@query("packet_temporal_features", _packet_windows_sql())
def _packet_windows(spark, d):
    return rounded(E.packet_windows(packets(spark, d), CFG, WINDOWS).drop("session_id"))


@query("sliding_host_windows", f"""WITH {PACKETS_SQL},
c AS (SELECT *, unnest(range(ts_us // {4 * HOUR} - 5, ts_us // {4 * HOUR} + 1)) AS w FROM packets),
g AS (SELECT src_ip, w, count(*) AS n, sum(length) AS b, max(length) AS mx,
  count(*) FILTER (WHERE protocol = 6 AND flags & 2 <> 0) AS syn, count(*) FILTER (WHERE protocol = 1) AS icmp,
  count(*) FILTER (WHERE icmp_type = 8) AS req, count(*) FILTER (WHERE icmp_type = 0) AS rep,
  count(DISTINCT dst_port) AS ports, count(DISTINCT dst_ip) AS hosts,
  CASE WHEN count(*) < 2 THEN {DAY / 1e6} ELSE greatest((max(ts_us) - min(ts_us)) / 1e6, 0.001) END AS dur FROM c GROUP BY ALL)
SELECT src_ip, w * {4 * HOUR} AS window_start_us, n AS packet_count, CAST(b AS BIGINT) AS byte_count, syn AS syn_count,
  icmp AS icmp_count, req AS echo_request_count, rep AS echo_reply_count, mx::BIGINT AS max_packet_size,
  ports AS unique_dest_ports, hosts AS unique_dest_hosts, {rd('n / dur', 'packets_per_second')},
  {rd('CASE WHEN rep > 0 THEN req / rep ELSE 0 END', 'request_response_ratio')} FROM g""")
def _sliding(spark, d):
    return rounded(E.sliding_features(packets(spark, d), DAY, 4 * HOUR))


@query("host_fan_out", f"""WITH {PACKETS_SQL} SELECT src_ip, count(*) AS packet_count,
  count(DISTINCT dst_ip) AS unique_dst_ip, count(DISTINCT dst_port) AS unique_dst_port FROM packets GROUP BY 1""")
def _fan_out(spark, d):
    return E.fan_out(packets(spark, d))


@query("host_fan_in", f"""WITH {PACKETS_SQL} SELECT dst_ip, count(*) AS packet_count, count(DISTINCT src_ip) AS unique_src_ip,
  count(DISTINCT src_port) AS unique_src_port FROM packets GROUP BY 1""")
def _fan_in(spark, d):
    return E.fan_out(packets(spark, d), "dst_ip", targets=("src_ip", "src_port"))


# A sketch has no exact value; what is checked is that it stays close to the exact count.
@query("host_fan_out_approx", f"WITH {PACKETS_SQL} SELECT src_ip, count(*) AS packet_count, true AS close FROM packets GROUP BY 1")
def _fan_out_approx(spark, d):
    p = packets(spark, d)
    exact = E.fan_out(p).drop("packet_count")
    near = lambda t: F.abs(F.col(f"a.unique_{t}") - F.col(f"e.unique_{t}")) <= F.greatest(F.lit(2.0), 0.2 * F.col(f"e.unique_{t}"))
    return E.fan_out(p, exact=False).alias("a").join(exact.alias("e"), "src_ip").select(
        "src_ip", "packet_count", (near("dst_ip") & near("dst_port")).alias("close")
    )


@query("protocol_spec_features", f"""WITH {flow_sql()},
spec_bytes AS (SELECT packet_id, substr(payload, i, 1) AS b, count(*) AS c
  FROM (SELECT packet_id, payload, unnest(range(1, length(payload) + 1)) AS i FROM packets) GROUP BY ALL),
packet_h AS (SELECT packet_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM spec_bytes GROUP BY packet_id)
SELECT session_key || '#' || session_seq AS session_id, max(length)::BIGINT AS packet_size_max,
  {rd('coalesce(avg(winsize) FILTER (WHERE protocol = 6), 0)', 'window_size_mean')},
  {rd('coalesce(stddev_pop(winsize) FILTER (WHERE protocol = 6), 0)', 'window_size_std')},
  (count(*) FILTER (WHERE protocol = 6)) - (count(DISTINCT (src_ip, seq)) FILTER (WHERE protocol = 6)) AS retransmission_count,
  {rd('coalesce(avg(length(payload)) FILTER (WHERE protocol = 6), 0)', 'segment_size_mean')},
  coalesce(max(dst_port) - min(dst_port), 0) AS port_range,
  count(*) FILTER (WHERE icmp_type = 8) AS echo_request_count, count(*) FILTER (WHERE icmp_type = 0) AS echo_reply_count,
  {rd('coalesce(count(*) FILTER (WHERE icmp_type = 8) / nullif(count(*) FILTER (WHERE icmp_type = 0), 0), 0)', 'request_response_ratio')},
  {rd('avg(coalesce(h, 0))', 'payload_entropy_mean')}
FROM flow LEFT JOIN packet_h USING (packet_id) GROUP BY session_key, session_seq""")
def _spec_features(spark, d):
    return rounded(E.spec_features(packets(spark, d), CFG))


def _sequence_query(pad: bool):
    def build(spark, d):
        rows = packets(spark, d).withColumn("slice", F.expr(f"ts_us DIV {DAY}")).withColumn(
            "y", (F.col("k") < 20).cast("int")
        )
        out = E.sequences(rows, ["user_id"], "slice", ["ts_us", "packet_id"], ["length", "k"], "y", 30, pad, 64)
        total = F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x["length"] * 1000 + x["k"])
        return rounded(out.select(
            "user_id", "packet_id", "row_no", F.size("sequence").alias("steps"), total.alias("checksum"),
            F.element_at("sequence", 1)["length"].alias("oldest"), "label",
        ))
    return build


_SEQ = f"""WITH {PACKETS_SQL}, s AS (SELECT user_id, packet_id, row_number() OVER p AS row_no, count(*) OVER f AS steps,
  sum(length * 1000.0 + k) OVER f AS checksum, first_value(length) OVER f AS oldest, CAST(k < 20 AS INT) AS label FROM packets
  WINDOW p AS (PARTITION BY user_id ORDER BY ts_us, packet_id),
    f AS (PARTITION BY user_id ORDER BY ts_us, packet_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT user_id, packet_id, row_no, {{steps}} AS steps, {rd('checksum', 'checksum')}, {{oldest}} AS oldest, label FROM s"""
query("sequences", _SEQ.format(steps="steps::INT", oldest="oldest::DOUBLE") + " WHERE steps = 30")(_sequence_query(False))
query("sequences_padded", _SEQ.format(steps="30", oldest="CASE WHEN steps = 30 THEN oldest ELSE 0 END::DOUBLE"))(_sequence_query(True))
