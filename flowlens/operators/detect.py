"""Detection: rules, thresholds, model scores, typing and the hybrid decision."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.config import DetectionConfig, FilterRuleConfig, RuleConfig
from flowlens.functions.scalars import case_of, has_flag
from flowlens.functions.specs import ACK, PROTOCOL_SPECS, RULE_REASONS, SYN
from flowlens.schemas import ALL_FEATURES, MODEL_FEATURES


def _or0(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def rule_columns(rules: RuleConfig = RuleConfig(), threshold: float = 0.7) -> dict[str, Column]:
    """Score (highest fired rule), type (first fired rule) and reasons of the three rules."""
    count, syn = _or0("packet_count"), _or0("tcp_syn_count")
    entropy = _or0("payload_entropy")
    fired = {
        "large_packet": _or0("avg_packet_size") > rules.large_packet,
        "high_entropy": entropy > rules.high_entropy,
        "syn_flood": (count >= rules.syn_min_packets) & (syn / F.greatest(count, F.lit(1.0)) > rules.syn_ratio),
    }
    points = {"large_packet": F.lit(0.8), "high_entropy": F.least(entropy / 10.0, F.lit(1.0)), "syn_flood": F.lit(0.9)}
    nothing = ~(fired["large_packet"] | fired["high_entropy"] | fired["syn_flood"])
    score = F.when(nothing, 0.1).otherwise(
        F.greatest(*[F.when(c, points[n]).otherwise(0.0) for n, c in fired.items()])
    )
    kind = F.coalesce(*[F.when(c, n) for n, c in fired.items()], F.lit("normal"))
    reasons = F.array_compact(F.array(*[F.when(c, RULE_REASONS[n]) for n, c in fired.items()]))
    return {
        "rule_score": score,
        "rule_type": kind,
        "rule_anomaly": score >= threshold,
        "reasons": reasons,
    }


def protocol_threshold(cfg: DetectionConfig = DetectionConfig(), protocol: str = "protocol") -> Column:
    return case_of(F.col(protocol), cfg.protocol_thresholds, F.lit(cfg.threshold))


def anomaly_type() -> Column:
    """Type of an anomaly found by a model."""
    count = _or0("packet_count")
    flood = (F.col("protocol") == 6) & (count > 50) & (_or0("tcp_syn_count") / count > 0.8)
    return (
        F.when(flood, "syn_flood")
        .when(_or0("payload_entropy") > 7.5, "high_entropy")
        .when(_or0("avg_packet_size") > 1400, "large_payload")
        .otherwise("generic_anomaly")
    )


def detect(
    features: DataFrame, cfg: DetectionConfig = DetectionConfig(), model_name: str = "model", threshold_by: str = "protocol"
) -> DataFrame:
    """Decision per row in the configured mode, with the threshold of the protocol in ``threshold_by``.

    ``model_score`` is the anomaly probability; without the column, or with NULL in it, only
    the rules speak.
    """
    if "model_score" not in features.columns:
        features = features.withColumn("model_score", F.lit(None).cast("double"))
    rows = features.withColumns(
        {
            **rule_columns(cfg.rules, cfg.threshold),
            "threshold_used": protocol_threshold(cfg, threshold_by),
            "model_type": anomaly_type(),
        }
    )
    hit = F.coalesce(F.col("model_score") >= F.col("threshold_used"), F.lit(False))
    score = F.coalesce("model_score", F.lit(0.0))
    if cfg.mode == "rule_only":
        out = {
            "anomaly_score": F.col("rule_score"), "is_anomaly": F.col("rule_anomaly"),
            "anomaly_type": F.col("rule_type"), "detection_method": F.lit("rule_based"),
            "threshold_used": F.lit(cfg.threshold),
        }
    elif cfg.mode == "model_only":
        out = {
            "anomaly_score": score, "is_anomaly": hit,
            "anomaly_type": F.when(hit, F.col("model_type")).otherwise("normal"),
            "detection_method": F.lit(f"model_{model_name}"), "threshold_used": F.col("threshold_used"),
            "reasons": F.array().cast("array<string>"),
        }
    elif cfg.mode == "hybrid":
        out = {
            "anomaly_score": F.greatest(score, "rule_score"),
            "is_anomaly": hit | F.col("rule_anomaly"),
            "anomaly_type": F.when(hit, F.col("model_type")).otherwise(F.col("rule_type")),
            "detection_method": F.when(hit, f"model_{model_name}").otherwise("rule_based"),
            "threshold_used": F.when(hit, F.col("threshold_used")).otherwise(cfg.threshold),
        }
    else:
        raise ValueError(f"unknown detection mode {cfg.mode!r}")
    return rows.withColumns(out).drop("rule_score", "rule_type", "rule_anomaly", "model_type")


def sigmoid(decision: str | Column) -> Column:
    d = F.col(decision) if isinstance(decision, str) else decision
    return 1 / (1 + F.exp(-d))


def column_mode(df: DataFrame, name: str, default: int = 6) -> DataFrame:
    """Most frequent value (smallest wins ties) as a one-row frame; the default if there is none."""
    counts = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("__n"))
    best = counts.agg(F.max_by(F.col(name), F.struct("__n", -F.col(name))).alias("__m"))
    return best.select(F.coalesce("__m", F.lit(default)).alias(name))


def configured_rules(df: DataFrame, cfg: FilterRuleConfig = FilterRuleConfig()) -> DataFrame:
    """Reasons of the configured size, protocol, rate and flag rules."""
    tests = {
        "size": F.col("length") > cfg.max_normal_size,
        "protocol": F.col("protocol").isin(list(cfg.suspicious_protocols)),
        "rate": F.col("packets_per_second") > cfg.max_packets_per_second,
        "flags": F.col("flags").isin(list(cfg.suspicious_flags)),
    }
    return df.withColumn("reasons", F.array_compact(F.array(*[F.when(c, n) for n, c in tests.items()])))


def range_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per feature outside the normal range of the row's protocol.

    Features without a column are not tested; unknown protocols use the default ranges.
    """
    known = [p for p in PROTOCOL_SPECS if p >= 0]
    tests = []
    for protocol, spec in PROTOCOL_SPECS.items():
        applies = F.col("protocol") == protocol if protocol >= 0 else ~F.col("protocol").isin(known)
        for feature, (lo, hi) in spec["normal_ranges"].items():
            if feature in df.columns:
                value = F.col(feature).cast("double")
                tests.append(
                    F.when(
                        applies & ~value.between(lo, hi),
                        F.struct(F.lit(feature).alias("feature"), value.alias("value")),
                    )
                )
    hits = df.withColumn("__v", F.explode(F.array_compact(F.array(*tests))))
    return hits.select(*keys, "__v.feature", "__v.value")


# Default limits; the rates are the upper normal bounds of the protocols.
PATTERN_LIMITS: Mapping[str, float] = {
    "syn_ratio": 0.8, "syn_packets": 50, "scan_ports": 5, "icmp_rate": 10,
    "packet_rate": 100, "payload_bytes": 1400, "amplification_bytes": 1400,
    "ping_requests": 10, "flood_ports": 5, "icmp6_rate": 10, "retransmissions": 5, "least_window": 512, "duration_s": 3600,
    "dns_bytes": 512, "odd_bytes": 1500,
}
# Types that hosts and routers send in normal operation: echoes, unreachable, redirect, time exceeded, bad header, timestamps;
# for IPv6 errors, echoes and neighbour discovery.
ICMP_TYPES = {1: (0, 3, 5, 8, 11, 12, 13, 14), 58: (1, 2, 3, 4, 128, 129, 130, 131, 132, 133, 134, 135, 136, 137, 143)}


def attack_patterns(windows: DataFrame, keys: Sequence[str], limits: Mapping[str, float] = PATTERN_LIMITS) -> DataFrame:
    """Named patterns that a host window shows, one row per pattern."""
    lim = {**PATTERN_LIMITS, **limits}
    n = F.col("packet_count")
    tests = {
        "syn_flood": (n > lim["syn_packets"]) & (F.col("syn_count") / n > lim["syn_ratio"]),
        "port_scan": F.col("unique_dest_ports") > lim["scan_ports"],
        "icmp_flood": F.col("icmp_count") / n * F.col("packets_per_second") > lim["icmp_rate"],
        "high_packet_rate": F.col("packets_per_second") > lim["packet_rate"],
        "large_payload": F.col("max_packet_size") > lim["payload_bytes"],
        "high_request_response_ratio": F.col("request_response_ratio") > 2,
        "ping_flood": F.col("echo_request_count") > lim["ping_requests"],
    }
    found = F.array_compact(F.array(*[F.when(c, p) for p, c in tests.items()]))
    return windows.withColumn("pattern", F.explode(found)).select(*keys, "pattern")


def protocol_floods(
    packets: DataFrame, size_us: int, step_us: int, key: str = "src_ip", limits: Mapping[str, float] = PATTERN_LIMITS
) -> DataFrame:
    """Windows of a host that reach many UDP ports, or send ICMPv6 at a high rate: one row per pattern."""
    from flowlens.operators.temporal import sliding_features

    lim = {**PATTERN_LIMITS, **limits}
    udp = sliding_features(packets.where("protocol = 17"), size_us, step_us, [key])
    icmp6 = sliding_features(packets.where("protocol = 58"), size_us, step_us, [key])
    ports = udp.where(F.col("unique_dest_ports") > lim["flood_ports"]).select(key, "window_start_us", F.lit("port_flood").alias("pattern"))
    rate = icmp6.where(F.col("packets_per_second") > lim["icmp6_rate"]).select(key, "window_start_us", F.lit("icmp6_flood").alias("pattern"))
    return ports.unionByName(rate)


def session_patterns(sessions: DataFrame, keys: Sequence[str], limits: Mapping[str, float] = PATTERN_LIMITS) -> DataFrame:
    """Patterns of TCP sessions: repeated segments, small windows, long duration.

    ``sessions`` has protocol, duration, retransmission_count and window_size_mean.
    """
    lim = {**PATTERN_LIMITS, **limits}
    tests = {
        "excessive_retransmissions": F.col("retransmission_count") > lim["retransmissions"],
        "unusual_window_size": F.col("window_size_mean") < lim["least_window"],
        "long_duration": F.col("duration") > lim["duration_s"],
    }
    found = F.array_compact(F.array(*[F.when(c & (F.col("protocol") == 6), p) for p, c in tests.items()]))
    return sessions.withColumn("pattern", F.explode(found)).select(*keys, "pattern")


def packet_patterns(packets: DataFrame, limits: Mapping[str, float] = PATTERN_LIMITS) -> DataFrame:
    """Patterns visible in a single packet: odd flag pairs, large UDP and DNS answers, rare ICMP messages, odd sizes."""
    lim = {**PATTERN_LIMITS, **limits}
    flags = F.coalesce(F.col("flags"), F.lit(0))
    odd = (F.col("protocol") == 6) & (
        (flags == 0) | (has_flag(flags, SYN) & (has_flag(flags, 0x01) | has_flag(flags, 0x04)))
        | (has_flag(flags, 0x01) & ~has_flag(flags, ACK))
    )
    tests = {
        "unusual_flag_combination": odd,
        "amplification_attack": (F.col("protocol") == 17) & (F.col("length") > lim["amplification_bytes"]),
        "dns_amplification": (F.col("protocol") == 17) & (F.col("src_port") == 53) & (F.col("length") > lim["dns_bytes"]),
        "unusual_type_code": F.when(F.col("protocol") == 1, ~F.col("icmp_type").isin(list(ICMP_TYPES[1])) | (F.col("icmp_code") > 15))
        .when(F.col("protocol") == 58, ~F.col("icmp_type").isin(list(ICMP_TYPES[58])) | (F.col("icmp_code") > 15)),
        "unusual_size": ~F.col("protocol").isin([p for p in PROTOCOL_SPECS if p >= 0]) & (F.col("length") > lim["odd_bytes"]),
    }
    found = F.array_compact(F.array(*[F.when(c, p) for p, c in tests.items()]))
    return packets.withColumn("pattern", F.explode(found)).select("packet_id", "pattern")


def detect_batch(features: DataFrame, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Decides a whole file under the threshold of its most frequent protocol, added as ``threshold_protocol``.

    Typing still goes by each row's own protocol; rows of a file without that column count as TCP.
    """
    if "protocol" not in features.columns:
        features = features.withColumn("protocol", F.lit(6))
    most = column_mode(features, "protocol").scalar()
    return detect(features.withColumn("threshold_protocol", most), cfg, threshold_by="threshold_protocol")


def model_columns(features: DataFrame) -> DataFrame:
    """Identity columns and the 15 columns of the model vector, in its order; a missing one is 0 and TCP is the missing protocol."""
    identity = [c for c in features.columns if c not in ALL_FEATURES and c != "protocol"]
    protocol = F.col("protocol") if "protocol" in features.columns else F.lit(6)
    numbers = [
        (F.col(c).cast("double") if c in features.columns else F.lit(0.0)).alias(c) for c in MODEL_FEATURES
    ]
    return features.select(*identity, protocol.alias("protocol"), *numbers)


def detect_file(
    spark: SparkSession, path: str, out: str, cfg: DetectionConfig = DetectionConfig(), fmt: str = "parquet",
    models: Mapping[int, object] | None = None, fallback=None,
) -> DataFrame:
    """Reads a feature file, scores it with the models of its protocols if there are any, decides, and writes the rows.

    Models see the 15 model columns: those the file lacks are 0, statistics it has beyond them are left out.
    """
    features = (spark.read.option("header", "true").option("inferSchema", "true") if fmt == "csv" else spark.read).format(fmt).load(path)
    scored = route(model_columns(features), models or {}, fallback) if models or fallback else features
    detect_batch(scored, cfg).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def model_score(transformed: DataFrame) -> Column:
    """Anomaly score of a model's output: the probability, else the sigmoid of the decision value, else the 0/1 prediction."""
    from pyspark.ml.functions import vector_to_array

    if "probability" in transformed.columns:
        return vector_to_array("probability")[1]
    if "rawPrediction" in transformed.columns:
        return sigmoid(vector_to_array("rawPrediction")[1])
    return F.col("prediction").cast("double")


def route(features: DataFrame, models: Mapping[int, object], fallback=None) -> DataFrame:
    """Scores each row with the model of its protocol; rows without one take the fallback, or NULL.

    ``models`` maps a protocol to a fitted pipeline. The models follow each other over one scan; a model's
    score stands behind a test of the protocol.
    """
    protocol = F.col("protocol")
    listed = [(protocol == p, model) for p, model in models.items()]
    if fallback is not None:
        listed.append((~F.coalesce(protocol.isin(list(models)), F.lit(False)), fallback))
    rows, scores = features, []
    for i, (applies, model) in enumerate(listed):
        out = model.transform(rows)
        scores.append(f"__score_{i}")
        rows = out.select(*rows.columns, F.when(applies, model_score(out)).alias(scores[-1]))
    score = F.coalesce(*scores) if scores else F.lit(None).cast("double")
    return rows.withColumn("model_score", score).select(*features.columns, "model_score")
