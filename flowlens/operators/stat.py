"""Statistical features of a session, from its merged chunk aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.config import SessionConfig
from flowlens.functions.entropy import byte_counts
from flowlens.functions.scalars import enabled_features
from flowlens.operators import sessions as S
from flowlens.schemas import STAT_FEATURES

KEY = ["session_key", "session_seq"]


def pop_std(n: Column, total: Column, squares: Column) -> Column:
    """Population deviation from exact integer sums: no cancellation for equal values."""
    n_dec, t_dec = n.cast("decimal(13,0)"), total.cast("decimal(18,0)")
    spread = squares.cast("decimal(24,0)") * n_dec - t_dec * t_dec
    return F.when(n > 1, F.sqrt(F.greatest(spread.cast("double"), F.lit(0.0))) / n).otherwise(0.0)


def _duration() -> Column:
    """0 for one packet, at least 0.001 s otherwise."""
    span = (F.col("last_ts") - F.col("first_ts")) / 1e6
    return F.when(F.col("n") < 2, 0.0).when(span > 0, span).otherwise(0.001)


def aggregate_features() -> dict[str, Column]:
    """The features that follow from the session aggregate alone."""
    n = F.col("n")
    duration = _duration()
    ratio = lambda c: F.col(c) / n
    dbl = lambda c: F.col(c).cast("double")
    return {
        "packet_count": dbl("n"),
        "byte_count": dbl("bytes"),
        "flow_duration": duration,
        "avg_packet_size": F.col("bytes") / n,
        "std_packet_size": pop_std(n, F.col("bytes"), F.col("sumsq")),
        "min_packet_size": dbl("min_len"),
        "max_packet_size": dbl("max_len"),
        "bytes_per_second": F.when(duration > 0, F.col("bytes") / duration).otherwise(0.0),
        "packets_per_second": F.when(duration > 0, n / duration).otherwise(0.0),
        "tcp_syn_count": dbl("syn"),
        "tcp_ack_count": dbl("ack"),
        "tcp_fin_count": dbl("fin"),
        "tcp_rst_count": dbl("rst"),
        "tcp_flag_ratio": F.when(F.col("tcp_n") > 0, F.col("flagged") / F.col("tcp_n")).otherwise(0.0),
        "tcp_packet_ratio": ratio("tcp_n"),
        "udp_packet_ratio": ratio("udp_n"),
        "icmp_packet_ratio": ratio("icmp_n"),
        "avg_payload_size": ratio("pl_bytes"),
        "payload_size_std": pop_std(n, F.col("pl_bytes"), F.col("pl_sumsq")),
        "outbound_packet_ratio": ratio("out_n"),
        "inbound_packet_ratio": (n - F.col("out_n")) / n,
    }


def entropy_of_counts(count: str = "c") -> Column:
    """Aggregate: base-2 entropy of the counts of one group."""
    c = F.col(count)
    total = F.sum(c)
    # H = log2(N) - sum(c*log2 c)/N; a single symbol gives exactly 0.
    return F.when(F.count(c) <= 1, 0.0).otherwise(F.log2(total) - F.sum(c * F.log2(c)) / total)


def numbering(packets: DataFrame, cfg: SessionConfig) -> DataFrame:
    chunks = S.session_chunks(packets, cfg, {"first_ts": F.min("ts_us"), "last_ts": F.max("ts_us")})
    return chunks.select("session_key", "chunk", "session_seq")


ENTROPIES = {"payload_entropy": "payload", "src_port_entropy": "src_port", "dst_port_entropy": "dst_port"}


def session_entropies(
    packets: DataFrame, cfg: SessionConfig = SessionConfig(), names: Sequence[str] = tuple(ENTROPIES)
) -> DataFrame:
    """Entropy of payload bytes and of ports over the packets of each session.

    Symbols are counted per (key, chunk) before anything is joined, and payloads are never
    put together. All kinds share one join and one aggregation.
    """
    keyed = S.keyed(packets, cfg)
    code = {n: i for i, n in enumerate(ENTROPIES)}  # a number keeps the many symbol rows short
    parts = []
    ports = [n for n in names if n != "payload_entropy"]
    if ports:
        sides = F.explode(
            F.array(*[F.struct(F.lit(code[n]).alias("kind"), F.col(ENTROPIES[n]).alias("symbol")) for n in ports])
        )
        parts.append(
            keyed.select("session_key", "chunk", sides.alias("s")).select("session_key", "chunk", "s.*")
            .where("symbol IS NOT NULL").groupBy("session_key", "chunk", "kind", "symbol")
            .agg(F.count(F.lit(1)).alias("c"))
            .select("session_key", "chunk", "kind", F.array("symbol").alias("symbols"), F.array("c").alias("counts"))
        )
    if "payload_entropy" in names:
        parts.append(
            byte_counts(keyed, ["session_key", "chunk"], "payload").withColumn("kind", F.lit(code["payload_entropy"]))
            .select("session_key", "chunk", "kind", "symbols", "counts")
        )
    counted = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    symbols = F.explode(F.arrays_zip("symbols", "counts")).alias("z")
    per_symbol = (
        counted.join(numbering(packets, cfg), ["session_key", "chunk"])
        .select(*KEY, "kind", symbols).select(*KEY, "kind", "z.*")
        .groupBy(*KEY, "kind", "symbols").agg(F.sum("counts").alias("c"))
    )
    per_kind = per_symbol.groupBy(*KEY, "kind").agg(entropy_of_counts().alias("h"))
    return per_kind.groupBy(*KEY).agg(
        *[F.coalesce(F.max(F.when(F.col("kind") == code[n], F.col("h"))), F.lit(0.0)).alias(n) for n in names]
    )


def stat_features(
    packets: DataFrame,
    cfg: SessionConfig = SessionConfig(),
    enabled: Sequence[str] = (),
    disabled: Sequence[str] = (),
) -> DataFrame:
    """The 24 statistical features (or the enabled ones) per session.

    Entropy features that are not enabled are not computed.
    """
    names = enabled_features(STAT_FEATURES, enabled, disabled)
    out = S.session_aggregates(packets, cfg)
    columns = aggregate_features()
    wanted = [n for n in ENTROPIES if n in names]
    if wanted:
        out = out.join(session_entropies(packets, cfg, wanted), KEY, "left")
        columns |= {n: F.coalesce(F.col(n), F.lit(0.0)) for n in wanted}
    return out.select(
        S.session_id().alias("session_id"), *KEY, "protocol", "first_ts", "last_ts",
        *[columns[n].alias(n) for n in names],
    )
