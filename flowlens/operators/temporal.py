"""Temporal features: trailing windows, bursts, trends, sliding windows and sequences.

Packets of one instant are combined first, so a slice holds one row per distinct
microsecond. Neighbours are found inside ``(key, chunk)``; the chunk borders travel on
the chunk rows. Bursts need no islands: a burst starts where the gap before is long (or
absent) and is real if its instant has two packets or the gap after it is short; the
burst time is the sum of the short gaps. All of it is a conditional sum per window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.config import SessionConfig, WindowConfig
from flowlens.functions.entropy import byte_entropy
from flowlens.functions.scalars import enabled_features
from flowlens.operators import sessions as S
from flowlens.operators.folds import BYTE, CHUNK, DST_PORT, INSTANT, SRC_PORT, fold_packets
from flowlens.operators.scale import running_totals
from flowlens.operators.stat import ENTROPIES, KEY, aggregate_features, pop_std
from flowlens.schemas import ALL_FEATURES, TEMPORAL_FEATURES, WINDOW_MEASURES

FLOOR_S = 0.001


def instants(packets: DataFrame, cfg: SessionConfig) -> DataFrame:
    """One row per distinct time of a key: packets, bytes and squared sizes."""
    length = F.col("length").cast("bigint")
    return (
        S.keyed(packets, cfg)
        .groupBy("session_key", "chunk", "ts_us")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(length).alias("bytes"),
            F.sum(length * length).alias("sumsq"),
        )
    )


def session_borders(packets: DataFrame, cfg: SessionConfig) -> DataFrame:
    """Chunks with their session, its first and last time, and the nearest times in the chunks before and after."""
    chunks = S.session_chunks(packets, cfg, {"first_ts": F.min("ts_us"), "last_ts": F.max("ts_us")})
    seq = Window.partitionBy(*KEY).orderBy("chunk")
    whole = Window.partitionBy(*KEY)
    return chunks.select(
        "session_key", "chunk", "session_seq",
        F.min("first_ts").over(whole).alias("session_first"),
        F.max("last_ts").over(whole).alias("session_last"),
        F.lag("last_ts").over(seq).alias("__prev_chunk"),
        F.lead("first_ts").over(seq).alias("__next_chunk"),
    )


def session_instants(packets: DataFrame, cfg: SessionConfig) -> DataFrame:
    """Instants with their session, its borders and the neighbouring times inside the session."""
    rows = instants(packets, cfg)
    inside = Window.partitionBy("session_key", "chunk").orderBy("ts_us")
    local = rows.withColumns(
        {"__prev": F.lag("ts_us").over(inside), "__next": F.lead("ts_us").over(inside)}
    )
    return local.join(session_borders(packets, cfg), ["session_key", "chunk"]).select(
        *KEY, "chunk", "ts_us", "n", "bytes", "sumsq", "session_first", "session_last",
        F.coalesce("__prev", "__prev_chunk").alias("prev_ts"),
        F.coalesce("__next", "__next_chunk").alias("next_ts"),
    )


def _window_aggregates(name: str, size_us: int, burst_gap_us: int) -> list[Column]:
    """Exact sums and extremes, so that parts of a session can be merged."""
    ts, prev, nxt = F.col("ts_us"), F.col("prev_ts"), F.col("next_ts")
    cut = F.col("session_last") - F.lit(size_us)
    inside = ts >= cut
    linked = inside & prev.isNotNull() & (prev >= cut)
    gap = ts - prev
    opens = inside & (~linked | (gap > burst_gap_us))
    burst = opens & ((F.col("n") > 1) | F.coalesce(nxt - ts <= burst_gap_us, F.lit(False)))
    wide_gap = gap.cast("decimal(18,0)")
    pick = lambda c: F.sum(F.when(inside, F.col(c)).otherwise(0))
    return [
        pick("n").alias(f"{name}_n"),
        pick("bytes").alias(f"{name}_bytes"),
        F.sum(F.when(inside, F.col("sumsq")).otherwise(0).cast("decimal(20,0)")).alias(f"{name}_sumsq"),
        F.min(F.when(inside, ts)).alias(f"{name}_start"),
        F.max(F.when(inside, ts)).alias(f"{name}_end"),
        F.sum(F.when(linked, wide_gap * wide_gap)).alias(f"{name}_gapsq"),
        F.sum(F.when(burst, 1).otherwise(0)).alias(f"{name}_bursts"),
        F.sum(F.when(linked & (gap <= burst_gap_us), gap).otherwise(0)).alias(f"{name}_burst_us"),
    ]


def _window_measures(name: str, size_us: int) -> dict[str, Column]:
    c = lambda s: F.col(f"{name}_{s}")
    n = c("n")
    span = (c("end") - c("start")) / 1e6
    duration = F.when(n < 2, size_us / 1e6).otherwise(F.greatest(span, F.lit(FLOOR_S)))
    gaps = n - 1  # those inside an instant are 0 and add nothing to the sums
    values = [
        n / duration,
        c("bytes") / duration,
        c("bytes") / n,
        pop_std(n, c("bytes"), c("sumsq")),
        F.when(gaps > 0, span / gaps).otherwise(0.0),
        F.when(c("gapsq").isNotNull(), pop_std(gaps, c("end") - c("start"), c("gapsq")) / 1e6).otherwise(0.0),
        c("bursts").cast("double"),
        F.when(c("bursts") > 0, c("burst_us") / 1e6 / c("bursts")).otherwise(0.0),
    ]
    return {f"{name}_window_{m}": F.coalesce(v, F.lit(0.0)) for m, v in zip(WINDOW_MEASURES, values)}


def trends() -> dict[str, Column]:
    """Medium minus short rates; relative change of sizes and gaps, 0 if the short value is 0."""
    s, m = (lambda x: F.col(f"short_window_{x}")), (lambda x: F.col(f"medium_window_{x}"))
    change = lambda x: F.when(s(x) > 0, F.abs(m(x) - s(x)) / s(x)).otherwise(0.0)
    return {
        "packet_rate_trend": m("packet_rate") - s("packet_rate"),
        "byte_rate_trend": m("byte_rate") - s("byte_rate"),
        "packet_size_variation": change("packet_size_mean"),
        "inter_arrival_variation": change("inter_arrival_mean"),
    }


def temporal_features(
    packets: DataFrame,
    cfg: SessionConfig = SessionConfig(),
    windows: WindowConfig = WindowConfig(),
    enabled: Sequence[str] = (),
    disabled: Sequence[str] = (),
) -> DataFrame:
    """The 28 temporal features per session, all windows in one aggregate."""
    sizes = windows.sizes()
    aggs = [a for n, size in sizes.items() for a in _window_aggregates(n, size, windows.burst_gap_us)]
    grouped = session_instants(packets, cfg).groupBy(*KEY).agg(*aggs)
    measures = {k: v for n, size in sizes.items() for k, v in _window_measures(n, size).items()}
    wide = grouped.select(*KEY, *[v.alias(k) for k, v in measures.items()]).withColumns(trends())
    names = enabled_features(TEMPORAL_FEATURES, enabled, disabled)
    return wide.select(S.session_id().alias("session_id"), *KEY, *names)


def session_parts(packets: DataFrame, cfg: SessionConfig, aggs: Sequence[Column], measures: dict[str, Column]) -> DataFrame:
    """Parts of sessions: per chunk a row with measures and window aggregates, and rows with symbols only.

    The measures are taken in one scan of the packets and give the sessions; times and symbols are folded in a second
    one. All packets of a chunk belong to one session.
    """
    chunks = S.session_chunks(packets, cfg, measures)
    seq, whole = Window.partitionBy(*KEY).orderBy("chunk"), Window.partitionBy(*KEY)
    borders = chunks.select(
        *CHUNK, "session_seq", F.struct(*measures).alias("measures"),
        F.min("first_ts").over(whole).alias("session_first"), F.max("last_ts").over(whole).alias("session_last"),
        F.lag("last_ts").over(seq).alias("__prev_chunk"), F.lead("first_ts").over(seq).alias("__next_chunk"),
    )
    inside = Window.partitionBy(*CHUNK, "batch").orderBy("ts_us")
    rows = fold_packets(packets, cfg).withColumns({"__prev": F.lag("ts_us").over(inside), "__next": F.lead("ts_us").over(inside)})
    placed = rows.join(borders, CHUNK).withColumns(
        {"prev_ts": F.coalesce("__prev", "__prev_chunk"), "next_ts": F.coalesce("__next", "__next_chunk")}
    )
    return placed.groupBy(*CHUNK, "batch").agg(
        F.first("session_seq").alias("session_seq"), F.first("measures").alias("measures"), F.first("symbols").alias("symbols"), *aggs,
    )


# How the parts of a window's aggregates merge.
_EXTREMES = {"start": F.min, "end": F.max}


def flow_features(
    packets: DataFrame,
    cfg: SessionConfig = SessionConfig(),
    windows: WindowConfig = WindowConfig(),
) -> DataFrame:
    """Statistical and temporal features in one row per session, from two scans of the packets.

    Parts meet once more by session, where symbols are added up. The aggregates of a chunk are one row beside them, told
    apart by the chunk.
    """
    sizes = windows.sizes()
    measures = {k: v for k, v in S.packet_measures().items() if k not in S.FIRST_MERGE}
    aggs = [a for n, size in sizes.items() for a in _window_aggregates(n, size, windows.burst_gap_us)]
    parts = session_parts(packets, cfg, aggs, measures)
    of_windows = [c for c in parts.columns if c.partition("_")[0] in sizes]
    own = F.array(F.struct(F.lit(INSTANT).alias("kind"), F.col("chunk").alias("at"), F.lit(0).cast("bigint").alias("n")))
    part = F.when(F.col("batch").isNull(), F.struct("measures.*", *of_windows))
    rows = (
        parts.select(*KEY, part.alias("part"), F.when(F.col("batch").isNull(), own).otherwise(F.col("symbols")).alias("symbols"))
        .repartition(*KEY)
        .select(*KEY, "part", F.inline("symbols"))
    )
    counted = rows.groupBy(*KEY, "kind", "at").agg(F.sum("n").alias("c"), F.first("part", ignorenulls=True).alias("part"))
    c = F.col("c")

    def entropy(kind: int) -> Column:
        mine = F.col("kind") == kind
        total = F.sum(F.when(mine, c))
        return F.when(F.count(F.when(mine, c)) > 1, F.log2(total) - F.sum(F.when(mine, c * F.log2(c))) / total).otherwise(0.0)

    def merged(name: str) -> Column:
        return _EXTREMES.get(name.rpartition("_")[2], F.sum)(name)

    sessions = counted.select(*KEY, "kind", "c", "part.*").groupBy(*KEY).agg(
        *[S.merge(n).alias(n) for n in measures], *[merged(n).alias(n) for n in of_windows],
        *[entropy(kind).alias(n) for n, kind in zip(ENTROPIES, (BYTE, SRC_PORT, DST_PORT))],
    )
    columns = aggregate_features() | {k: v for n, size in sizes.items() for k, v in _window_measures(n, size).items()}
    wide = sessions.select(
        *KEY, "protocol", "first_ts", "last_ts", *ENTROPIES, *[v.alias(k) for k, v in columns.items()]
    ).withColumns(trends())
    return wide.select(S.session_id().alias("session_id"), *KEY, "protocol", "first_ts", "last_ts", *ALL_FEATURES).fillna(0.0, ALL_FEATURES)


def trailing_windows(
    packets: DataFrame, size_us: int, cfg: SessionConfig = SessionConfig()
) -> DataFrame:
    """State of the trailing window after each instant of a session.

    Every instant adds its packets at its time and takes them away one microsecond after
    the window has passed, so the window is a running sum: linear, with no frame rescans.
    Packets of one instant share a row. The oldest time in the window is the successor of
    the last instant taken away.
    """
    rows = session_instants(packets, cfg)
    both = rows.select(
        *KEY, "chunk", "session_first", "session_last", "next_ts",
        F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign"),
        "ts_us", "n", "bytes", "sumsq",
    )
    at = F.when(F.col("sign") == 1, F.col("ts_us")).otherwise(F.col("ts_us") + size_us + 1)
    sweep = both.withColumn("at", at).where(F.col("at") <= F.col("session_last")).withColumns(
        {
            "slice": F.expr(f"(at - pmod(at, {cfg.chunk_us})) DIV {cfg.chunk_us}"),
            "oldest": F.when(F.col("sign") == -1, F.col("next_ts")),
        }
    )
    totals = running_totals(
        sweep, KEY, "slice", ["at", "sign"],
        {
            "w_n": F.col("sign") * F.col("n"),
            "w_bytes": F.col("sign") * F.col("bytes"),
            "w_sumsq": (F.col("sign") * F.col("sumsq")).cast("decimal(20,0)"),
        },
        {"oldest_left": F.col("oldest")},
    )
    start = F.coalesce("oldest_left", "session_first")
    span = (F.col("at") - start) / 1e6
    duration = F.when(F.col("w_n") < 2, size_us / 1e6).otherwise(F.greatest(span, F.lit(FLOOR_S)))
    return totals.where(F.col("sign") == 1).select(
        S.session_id().alias("session_id"), *KEY, F.col("at").alias("ts_us"),
        F.col("w_n").alias("window_packets"),
        F.col("w_bytes").alias("window_bytes"),
        (F.col("w_n") / duration).alias("packet_rate"),
        (F.col("w_bytes") / duration).alias("byte_rate"),
        (F.col("w_bytes") / F.col("w_n")).alias("packet_size_mean"),
        pop_std(F.col("w_n"), F.col("w_bytes"), F.col("w_sumsq")).alias("packet_size_std"),
        F.when(F.col("w_n") > 1, span / (F.col("w_n") - 1)).otherwise(0.0).alias("inter_arrival_mean"),
    )


def session_packets(packets: DataFrame, cfg: SessionConfig) -> DataFrame:
    """Packets in the order of time and id, with the times before and after inside the session."""
    inside = Window.partitionBy("session_key", "chunk").orderBy("ts_us", "packet_id")
    length = F.coalesce(F.col("length"), F.lit(0)).cast("bigint")
    local = S.keyed(packets, cfg).select("session_key", "chunk", "ts_us", "packet_id", length.alias("length")).withColumns({
        "__prev": F.lag("ts_us").over(inside), "__next": F.lead("ts_us").over(inside), "next_id": F.lead("packet_id").over(inside),
    })
    return local.join(session_borders(packets, cfg), ["session_key", "chunk"]).select(
        *KEY, "ts_us", "packet_id", "length", "session_first", "session_last", "next_id",
        F.coalesce("__prev", "__prev_chunk").alias("prev_ts"), F.coalesce("__next", "__next_chunk").alias("next_ts"),
    )


def _events(sizes: Sequence[int], burst_gap_us: int) -> Column:
    """What a packet adds to its session's windows and takes away again, each at its time.

    A packet enters with the gap before it and leaves each window with the gap after it, so a window's gaps
    are those between its own packets. A burst is a run of short gaps: there are as many as short gaps, less
    the pairs of short gaps side by side. Such a pair is complete when the next packet enters, and gone when
    the packet before has left; where that happens first, the window never holds it. A burst that the window
    cuts on its left loses gaps and pairs alike, so what is left of it still counts as one.
    """
    ts, prev, nxt, length = (F.col(c) for c in ("ts_us", "prev_ts", "next_ts", "length"))
    before, after = ts - prev, nxt - ts
    short = lambda gap: F.coalesce((gap <= burst_gap_us).cast("int"), F.lit(0))
    nothing = F.lit(None).cast("bigint")

    def event(at, order, window, sign, n, gap, pairs, oldest, id_) -> Column:
        gap = F.coalesce(gap, F.lit(0)) if gap is not None else F.lit(0).cast("bigint")
        is_short = F.lit(0) if n == 0 else short(before if sign == 1 else after)
        return F.struct(
            at.alias("at"), F.lit(order).alias("order"), id_.alias("id"), F.lit(window).cast("int").alias("window"), F.lit(sign * n).cast("bigint").alias("n"),
            (length * sign * n).alias("bytes"), (length * length * sign * n).cast("decimal(20,0)").alias("sumsq"),
            (gap.cast("decimal(18,0)") * gap.cast("decimal(18,0)") * sign).cast("decimal(36,0)").alias("gap2"),
            (is_short * sign).cast("bigint").alias("shorts"), F.when(is_short == 1, gap * sign).otherwise(F.lit(0)).cast("bigint").alias("short_us"),
            (pairs * sign).cast("bigint").alias("pairs"), oldest.alias("oldest"),
        )

    no_id = F.lit(None).cast("bigint")
    none = F.lit(0)
    own = F.col("packet_id").cast("bigint")
    out = [event(ts, 2, None, 1, 1, before, none, nothing, own)]
    both = (short(before) == 1) & (short(after) == 1)
    for w, size in enumerate(sizes):
        out.append(event(ts + size + 1, 0, w, -1, 1, after, none, nxt, no_id))
        holds = both & (prev + size >= nxt)
        out += [
            F.when(holds, event(nxt, 1, w, 1, 0, None, F.lit(1), nothing, F.col("next_id").cast("bigint"))),
            F.when(holds, event(prev + size + 1, 0, w, -1, 0, None, F.lit(1), nothing, no_id)),
        ]
    return F.filter(F.array(*out), lambda e: e.isNotNull() & (e["at"] <= F.col("session_last")))


def packet_windows(
    packets: DataFrame, cfg: SessionConfig = SessionConfig(), windows: WindowConfig = WindowConfig()
) -> DataFrame:
    """The 28 temporal features as they stand after each packet of a session.

    A window of a packet holds it and the earlier packets of its session (by time, then id) that are not
    older than the window's size; packets of one time count by their ids. One sweep over entering and leaving
    packets carries the state of all windows as running sums, cut into time slices: linear in the packets
    for any size, and no window is read again. Ids must tell packets of one time apart.
    """
    sizes = windows.sizes()
    swept = session_packets(packets, cfg).select(*KEY, "session_first", F.explode(_events(list(sizes.values()), windows.burst_gap_us)).alias("e")).select(
        *KEY, "session_first", "e.*"
    ).withColumn("slice", F.expr(f"(at - pmod(at, {cfg.chunk_us})) DIV {cfg.chunk_us}"))
    kinds = ("n", "bytes", "sumsq", "gap2", "shorts", "short_us", "pairs")
    here = lambda w, c: F.when(F.col("window").isNull() | (F.col("window") == w), F.col(c)).otherwise(0)
    # An entering packet comes after the pair that it completes: same time and id, later order.
    totals = running_totals(
        swept, KEY, "slice", [F.col("at"), F.col("order") > 0, F.col("id"), F.col("order")],
        {f"{name}_{c}": here(w, c) for w, name in enumerate(sizes) for c in kinds},
        {f"{name}_oldest": F.when(F.col("window") == w, F.col("oldest")) for w, name in enumerate(sizes)},
    ).where("order = 2")
    measures: dict[str, Column] = {}
    for name, size in sizes.items():
        c = lambda s, name=name: F.col(f"{name}_{s}")
        n, gaps = c("n"), c("n") - 1
        span = F.col("at") - F.coalesce(c("oldest"), "session_first")
        duration = F.when(n < 2, size / 1e6).otherwise(F.greatest(span / 1e6, F.lit(FLOOR_S)))
        bursts = c("shorts") - c("pairs")
        values = [
            n / duration, c("bytes") / duration, c("bytes") / n, pop_std(n, c("bytes"), c("sumsq")),
            F.when(gaps > 0, span / 1e6 / gaps).otherwise(0.0),
            F.when(gaps > 1, pop_std(gaps, span, c("gap2")) / 1e6).otherwise(0.0),
            bursts.cast("double"),
            F.when(bursts > 0, c("short_us") / 1e6 / bursts).otherwise(0.0),
        ]
        measures |= {f"{name}_window_{m}": v for m, v in zip(WINDOW_MEASURES, values)}
    wide = totals.select(*KEY, F.col("at").alias("ts_us"), F.col("id").alias("packet_id"), *[v.alias(k) for k, v in measures.items()])
    return wide.withColumns(trends()).select(S.session_id().alias("session_id"), *KEY, "ts_us", "packet_id", *TEMPORAL_FEATURES)


def sliding_features(
    packets: DataFrame, size_us: int, step_us: int, keys: Sequence[str] = ("src_ip",)
) -> DataFrame:
    """Tumbling or sliding window aggregates with fan-out counts per key.

    Packets are combined per step and endpoint before they are copied to their windows.
    """
    ts = F.col("ts_us")
    length = F.col("length").cast("bigint")
    steps = -(-size_us // step_us)
    step = F.expr(f"(ts_us - pmod(ts_us, {step_us})) DIV {step_us}")
    if size_us % step_us:
        raise ValueError("window size must be a multiple of the step")
    syn = F.sum(F.when((F.col("protocol") == 6) & (F.col("flags").bitwiseAND(2) != 0), 1).otherwise(0))
    small = packets.withColumn("__step", step).groupBy(*keys, "__step", "dst_ip", "dst_port").agg(
        F.count(F.lit(1)).alias("n"), F.sum(length).alias("bytes"), syn.alias("syn"),
        F.sum(F.when(F.col("protocol").isin(1, 58), 1).otherwise(0)).alias("icmp"),
        F.sum(F.when(F.col("icmp_type") == 8, 1).otherwise(0)).alias("echo_request"),
        F.sum(F.when(F.col("icmp_type") == 0, 1).otherwise(0)).alias("echo_reply"),
        F.max(length).alias("max_len"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
    )
    counts = ("n", "bytes", "syn", "icmp", "echo_request", "echo_reply")
    copied = small.withColumn(
        "__w", F.explode(F.sequence(F.col("__step") - (steps - 1), F.col("__step")))
    )
    # Every endpoint row stands once for its port, with the measures, and once for its host.
    # Counting distinct values is then counting groups, and no window collects raw endpoints.
    nothing = [F.lit(None).cast("bigint").alias(c) for c in (*counts, "max_len", "first_ts", "last_ts")]
    as_port = F.struct(F.lit("port").alias("kind"), F.col("dst_port").cast("string").alias("value"),
                       *[F.col(c) for c in (*counts, "max_len", "first_ts", "last_ts")])
    as_host = F.struct(F.lit("host").alias("kind"), F.col("dst_ip").alias("value"), *nothing)
    sides = copied.select(*keys, "__w", F.explode(F.array(as_port, as_host)).alias("s")).select(*keys, "__w", "s.*")

    def merge(rows: DataFrame, by: Sequence[str], *more: Column) -> DataFrame:
        return rows.groupBy(*by).agg(
            *[F.sum(c).alias(c) for c in counts], F.max("max_len").alias("max_len"),
            F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), *more,
        )

    distinct = merge(sides, [*keys, "__w", "kind", "value"])
    seen = lambda kind: F.count_if((F.col("kind") == kind) & F.col("value").isNotNull())
    whole = merge(
        distinct, [*keys, "__w"],
        seen("port").alias("unique_dest_ports"), seen("host").alias("unique_dest_hosts"),
    ).withColumnsRenamed({
        "n": "packet_count", "bytes": "byte_count", "syn": "syn_count", "icmp": "icmp_count",
        "echo_request": "echo_request_count", "echo_reply": "echo_reply_count", "max_len": "max_packet_size",
    })
    span = (F.col("last_ts") - F.col("first_ts")) / 1e6
    duration = F.when(F.col("packet_count") < 2, size_us / 1e6).otherwise(F.greatest(span, F.lit(FLOOR_S)))
    return whole.select(
        *keys,
        (F.col("__w") * step_us).alias("window_start_us"),
        "packet_count", "byte_count", "syn_count", "icmp_count", "echo_request_count",
        "echo_reply_count", "max_packet_size", "unique_dest_ports", "unique_dest_hosts",
        (F.col("packet_count") / duration).alias("packets_per_second"),
        F.when(F.col("echo_reply_count") > 0, F.col("echo_request_count") / F.col("echo_reply_count"))
        .otherwise(0.0)
        .alias("request_response_ratio"),
    )


def fan_out(
    packets: DataFrame, key: str = "src_ip", exact: bool = True, targets: Sequence[str] = ("dst_ip", "dst_port")
) -> DataFrame:
    """Distinct peers and ports per host, exactly or with a sketch (5 % standard error).

    The exact form first removes duplicates map-side, per target, so no key is expanded.
    """
    if not exact:
        return packets.groupBy(key).agg(
            F.count(F.lit(1)).alias("packet_count"),
            *[F.approx_count_distinct(t).alias(f"unique_{t}") for t in targets],
        )
    out = packets.groupBy(key).agg(F.count(F.lit(1)).alias("packet_count"))
    for t in targets:
        distinct = packets.where(F.col(t).isNotNull()).groupBy(key, t).agg(F.lit(1).alias("one"))
        counted = distinct.groupBy(key).agg(F.count(F.lit(1)).alias(f"unique_{t}"))
        out = out.join(counted, key, "left")
    return out.fillna(0, [f"unique_{t}" for t in targets])


def spec_features(packets: DataFrame, cfg: SessionConfig = SessionConfig()) -> DataFrame:
    """Features named by the protocol specs: window sizes, retransmissions, segments, ports, echoes, mean entropy of payloads."""
    win, length = F.col("winsize").cast("bigint"), F.col("length").cast("bigint")
    tcp = F.col("protocol") == 6
    payload = F.coalesce(F.octet_length("payload"), F.lit(0)).cast("bigint")
    data = tcp & (payload > 0)
    one = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    measures = {
        "first_ts": F.min("ts_us"), "last_ts": F.max("ts_us"), "n": F.count(F.lit(1)),
        "win_n": F.count(F.when(tcp, win)), "win": F.sum(F.when(tcp, win)),
        "win_sq": F.sum(F.when(tcp, win * win)),
        "segments": one(data), "segment_bytes": F.sum(F.when(data, payload)),
        "min_port": F.min("dst_port"), "max_port": F.max("dst_port"), "max_len": F.max(length),
        "echo_request": one(F.col("icmp_type") == 8), "echo_reply": one(F.col("icmp_type") == 0),
        "entropy": F.sum("__entropy"),
    }
    chunks = S.session_chunks(packets.withColumn("__entropy", byte_entropy("payload")), cfg, measures)
    merged = chunks.groupBy(*KEY).agg(
        *[F.sum(c).alias(c) for c in ("n", "win_n", "win", "segments", "segment_bytes", "echo_request", "echo_reply", "entropy")],
        F.sum(F.col("win_sq").cast("decimal(20,0)")).alias("win_sq"),
        F.min("min_port").alias("min_port"), F.max("max_port").alias("max_port"),
        F.max("max_len").alias("max_len"),
    )
    numbered = chunks.select("session_key", "chunk", "session_seq")
    # Distinct (sender, sequence) pairs per chunk, then per session; repeats are retransmissions.
    seen = (
        S.keyed(packets, cfg).where(data).groupBy("session_key", "chunk", "src_ip", "seq")
        .agg(F.lit(1).alias("one")).join(numbered, ["session_key", "chunk"])
        .groupBy(*KEY, "src_ip", "seq").agg(F.lit(1).alias("one"))
        .groupBy(*KEY).agg(F.count(F.lit(1)).alias("distinct_segments"))
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return merged.join(seen, KEY, "left").select(
        S.session_id().alias("session_id"),
        F.col("max_len").alias("packet_size_max"),
        ratio("win", "win_n").alias("window_size_mean"),
        F.coalesce(pop_std(F.col("win_n"), F.col("win"), F.col("win_sq")), F.lit(0.0)).alias("window_size_std"),
        (F.col("segments") - F.coalesce("distinct_segments", F.lit(0))).alias("retransmission_count"),
        ratio("segment_bytes", "segments").alias("segment_size_mean"),
        F.coalesce(F.col("max_port") - F.col("min_port"), F.lit(0)).alias("port_range"),
        F.col("echo_request").alias("echo_request_count"),
        F.col("echo_reply").alias("echo_reply_count"),
        ratio("echo_request", "echo_reply").alias("request_response_ratio"),
        ratio("entropy", "n").alias("payload_entropy_mean"),
    )


def sequences(
    rows: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str],
    features: Sequence[str],
    label: str,
    length: int = 30,
    pad: bool = False,
    block: int = 1000,
) -> DataFrame:
    """Last ``length`` feature rows up to each row, with the label of that row.

    Rows are numbered per key and cut into blocks of equal size; the tail of a block is
    copied into the next one, so every task sees whole sequences of a bounded block.
    """
    if block < length:
        raise ValueError("block must not be shorter than a sequence")
    numbered = running_totals(rows, keys, chunk, order, {"__rn": F.lit(1)})
    own = F.expr(f"(__rn - 1) DIV {block}")
    tail = (F.col("__rn") - 1) % block >= block - (length - 1)
    spread = numbered.withColumn("__own", own).withColumn(
        "__block", F.explode(F.when(tail, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own")))
    )
    w = Window.partitionBy(*keys, "__block").orderBy("__rn").rowsBetween(-(length - 1), 0)
    item = F.struct(*[F.col(f).cast("double").alias(f) for f in features])
    out = spread.withColumn("sequence", F.collect_list(item).over(w)).where(
        F.col("__block") == F.col("__own")
    )
    if pad:
        zero = F.struct(*[F.lit(0.0).alias(f) for f in features])
        missing = F.array_repeat(zero, F.lit(length) - F.size("sequence"))
        out = out.withColumn("sequence", F.concat(missing, "sequence"))
    else:
        out = out.where(F.size("sequence") == length)
    return out.select(*keys, *order, F.col("__rn").alias("row_no"), "sequence", F.col(label).alias("label"))
