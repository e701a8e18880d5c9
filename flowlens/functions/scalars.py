"""Column functions: protocol names, flags, entropy, parsing and validation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.entropy import byte_entropy
from flowlens.functions.specs import (
    ACK, FIN, PACKET_PROTOCOL_NAMES, PROTOCOL_NUMBERS, PROTOCOL_SPECS, RST, SYN,
)
from flowlens.schemas import MODEL_FEATURES, STAT_FEATURES, TEMPORAL_FEATURES, WINDOW_MEASURES


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def case_of(key: Column, table: dict, default: Column | None = None) -> Column:
    """CASE lookup of a small constant table."""
    out = None
    for k, v in table.items():
        hit = F.lit(v)
        out = F.when(key == F.lit(k), hit) if out is None else out.when(key == F.lit(k), hit)
    return out.otherwise(default) if default is not None else out


def is_ip(protocol: str | Column = "protocol") -> Column:
    return col(protocol).isNotNull()


def capture_filter(
    protocols: Iterable[int] | None = None,
    hosts: Iterable[str] | None = None,
    ports: Iterable[int] | None = None,
) -> Column:
    """Protocol, host and port predicates joined by AND; an absent part passes all."""
    cond = F.lit(True)
    if protocols is not None:
        cond &= F.col("protocol").isin(list(protocols))
    if hosts is not None:
        cond &= F.col("src_ip").isin(list(hosts)) | F.col("dst_ip").isin(list(hosts))
    if ports is not None:
        either = F.col("src_port").isin(list(ports)) | F.col("dst_port").isin(list(ports))
        cond &= F.coalesce(either, F.lit(False))
    return cond


def protocol_name(protocol: str | Column) -> Column:
    p = col(protocol)
    return case_of(p, PACKET_PROTOCOL_NAMES, F.concat(F.lit("unknown("), p.cast("string"), F.lit(")")))


def protocol_number(name: str | Column) -> Column:
    return case_of(F.lower(col(name)), PROTOCOL_NUMBERS, F.lit(-1))


def spec_row(protocol: str | Column, member: str) -> Column:
    """A member of the protocol's spec; unknown protocols get the default spec."""
    def lit(v):
        return F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)

    p, out = col(protocol), None
    for number, spec in PROTOCOL_SPECS.items():
        if number >= 0:
            out = (F if out is None else out).when(p == number, lit(spec[member]))
    return out.otherwise(lit(PROTOCOL_SPECS[-1][member]))


def has_flag(flags: Column, bit: int) -> Column:
    return F.coalesce(flags.bitwiseAND(F.lit(bit)) != 0, F.lit(False))


def text_flag(flags: str | Column, kind: str) -> Column:
    """Indicator of a flag named in a text such as ``SYN+ACK``; ``ratio`` is text <> '0'."""
    text = F.coalesce(col(flags).cast("string"), F.lit("nan"))
    if kind == "ratio":
        return (text != "0").cast("int")
    return text.contains(kind.upper()).cast("int")


def raw_to_model(df: DataFrame) -> DataFrame:
    """Raw labelled sample to the model columns; sizes are copied as they are."""
    present = set(df.columns)

    def source(name: str, value: Column) -> Column:
        return (value if name in present else F.lit(0)).cast("double")

    out = {}
    for f in MODEL_FEATURES:
        if f == "flow_duration":
            out[f] = source("session_duration", F.col("session_duration"))
        elif f == "payload_entropy":
            out[f] = source("payload_entropy", F.col("payload_entropy"))
        elif f.startswith("tcp_"):
            kind = f.split("_")[1] if f != "tcp_flag_ratio" else "ratio"
            out[f] = source("tcp_flags", text_flag("tcp_flags", kind))
        else:
            out[f] = source("packet_size", F.col("packet_size"))
    keep = [F.col("label").cast("int").alias("label")] if "label" in present else []
    return df.select(*[c.alias(n) for n, c in out.items()], *keep)


def raw_to_features(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Raw labelled sample to the 52 features, one row being a flow of one packet."""
    size = F.coalesce(F.col("packet_size"), F.lit(0)).cast("double")
    duration = F.coalesce(F.col("session_duration"), F.lit(0.0))
    gap = F.coalesce(F.col("inter_arrival_time"), F.lit(0.0))
    text = F.coalesce(F.col("tcp_flags"), F.lit(""))
    flag = {k: text.contains(k.upper()).cast("double") for k in ("syn", "ack", "fin", "rst")}
    per_second = lambda x: F.when(duration > 0, x / duration).otherwise(0.0)
    zero, half = F.lit(0.0), F.lit(0.5)
    out = {name: zero for name in [*STAT_FEATURES, *TEMPORAL_FEATURES]}
    out |= {
        "packet_count": F.lit(1.0), "byte_count": size, "flow_duration": duration,
        "avg_packet_size": size, "min_packet_size": size, "max_packet_size": size,
        "bytes_per_second": per_second(size), "packets_per_second": per_second(F.lit(1.0)),
        "avg_payload_size": size,
        "payload_entropy": F.coalesce(F.col("payload_entropy"), zero),
        "tcp_flag_ratio": F.when(text != "", sum(flag.values()) / 4).otherwise(0.0),
        "tcp_packet_ratio": F.coalesce((F.col("protocol") == 6).cast("double"), zero),
        "udp_packet_ratio": F.coalesce((F.col("protocol") == 17).cast("double"), zero),
        "icmp_packet_ratio": F.coalesce((F.col("protocol") == 1).cast("double"), zero),
        "outbound_packet_ratio": half, "inbound_packet_ratio": half,
    }
    out |= {f"tcp_{k}_count": c for k, c in flag.items()}
    for w in ("short", "medium", "long"):
        values = [out["packets_per_second"], out["bytes_per_second"], size, zero, gap]
        out |= {f"{w}_window_{m}": v for m, v in zip(WINDOW_MEASURES, values)}
    return df.select(
        *keep, *[c.alias(n) for n, c in out.items()],
        F.coalesce(F.col("label"), F.lit(0)).cast("int").alias("label"),
    )


def packet_features(packets: DataFrame) -> DataFrame:
    """Per-packet projection: sizes, payload and flag bits, ICMP type and code."""
    cols = set(packets.columns)
    payload = F.coalesce(F.octet_length("payload"), F.lit(0))
    tcp = F.col("protocol") == 6
    icmp = F.col("protocol").isin(1, 58)
    flags = F.coalesce(F.col("flags"), F.lit(0))

    def bit(mask: int) -> Column:
        return F.when(tcp, has_flag(flags, mask).cast("int"))

    def optional(name: str, when: Column, default: int | None) -> Column:
        if name not in cols:
            return F.lit(None).cast("int")
        value = F.col(name) if default is None else F.coalesce(F.col(name), F.lit(default))
        return F.when(when, value)

    return packets.select(
        "packet_id",
        F.col("length").alias("packet_size"),
        payload.alias("payload_size"),
        byte_entropy("payload").alias("payload_entropy"),
        (payload > 0).cast("int").alias("has_payload"),
        F.when(tcp, flags).alias("tcp_flags"),
        bit(SYN).alias("tcp_flag_syn"), bit(ACK).alias("tcp_flag_ack"),
        bit(FIN).alias("tcp_flag_fin"), bit(RST).alias("tcp_flag_rst"),
        optional("winsize", tcp, None).alias("window_size"),
        optional("icmp_type", icmp, -1).alias("icmp_type"),
        optional("icmp_code", icmp, -1).alias("icmp_code"),
    )


def project_model_features(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The 15 model columns as DOUBLE; a missing or non-numeric value becomes 0."""
    present = set(df.columns)

    def one(name: str) -> Column:
        if name not in present:
            return F.lit(0.0).alias(name)
        return F.coalesce(F.expr(f"try_cast(`{name}` AS DOUBLE)"), F.lit(0.0)).alias(name)

    return df.select(*keep, *[one(f) for f in MODEL_FEATURES])


def enabled_features(all_names: Sequence[str], enabled=(), disabled=()) -> list[str]:
    """An explicit list wins; otherwise all names minus the disabled ones."""
    return [n for n in (enabled or all_names) if enabled or n not in set(disabled)]


def is_ipv4(text: str | Column) -> Column:
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return F.coalesce(col(text).rlike(f"^{octet}(\\.{octet}){{3}}$"), F.lit(False))


def is_ipv6(text: str | Column) -> Column:
    """Groups of one to four hex digits, at most one ``::``, optional IPv4 tail."""
    t = col(text)
    v4_tail = F.substring_index(t, ":", -1)
    bare = F.when(v4_tail.contains("."), F.regexp_replace(t, r"[0-9.]+$", "0:0")).otherwise(t)
    groups = F.filter(F.split(bare, ":"), lambda g: g != "")
    shape = bare.rlike(r"^[0-9A-Fa-f:]+$") & ~F.exists(groups, lambda g: F.length(g) > 4)
    doubles = F.size(F.split(bare, "::")) - 1
    edges = ~bare.rlike(r"(^:[^:])|([^:]:$)|(:::)")
    count = F.size(groups)
    full = ((doubles == 0) & (count == 8)) | ((doubles == 1) & (count <= 7))
    return F.coalesce(
        shape & edges & full & (~v4_tail.contains(".") | is_ipv4(v4_tail)), F.lit(False)
    )


def is_valid_ip(text: str | Column) -> Column:
    return is_ipv4(text) | is_ipv6(text)


# Accepted timestamp formats, in order of trial.
TIMESTAMP_FORMATS = [
    "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss",
    "MM/dd/yyyy HH:mm:ss.SSSSSS", "MM/dd/yyyy HH:mm:ss",
]


def parse_timestamp_us(text: str | Column) -> Column:
    """Epoch microseconds of a UTC text in one of four formats or of epoch seconds, else NULL."""
    t = col(text)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    zero = F.timestamp_micros(F.lit(0).cast("bigint"))
    tried = [
        F.unix_micros(zero + (F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz") - epoch))
        for f in TIMESTAMP_FORMATS
    ]
    seconds = F.round(t.try_cast("double") * 1_000_000).cast("bigint")
    return F.coalesce(*tried, seconds)


def timestamp_text(ts_us: str | Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """UTC text of epoch microseconds, whatever the session time zone."""
    base = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    zero = F.timestamp_micros(F.lit(0).cast("bigint"))
    return F.date_format(base + (F.timestamp_micros(col(ts_us)) - zero), fmt)


def epoch_seconds(value: str | Column) -> Column:
    """Epoch seconds from a value that may be in milliseconds (above 1e10)."""
    v = col(value)
    return F.when(v > 1e10, v / 1000).otherwise(v)


# Accepted names of a report field, in order of preference.
FIELD_ALIASES = {
    "src_ip": ["src_ip", "source_ip", "src_address", "source_address", "src_addr"],
    "dst_ip": ["dst_ip", "destination_ip", "dst_address", "destination_address", "dst_addr"],
    "protocol": ["protocol", "proto", "protocol_name", "protocol_type"],
    "anomaly_type": ["anomaly_type", "detection_method", "type", "anomaly_category"],
    "anomaly_score": ["anomaly_score", "score"],
    "threshold": ["threshold_used", "threshold"],
    "details": ["details", "description"],
}


def resolve_aliases(df: DataFrame, default: str = "N/A") -> DataFrame:
    """One text column per report field, from the first alias that holds a value."""
    present = set(df.columns)

    def field(names: list[str]) -> Column:
        values = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in present]
        return F.coalesce(*values, F.lit(default))

    return df.withColumns({k: field(v) for k, v in FIELD_ALIASES.items()})


def split_valid(df: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all required fields, and the rejected rest."""
    ok = F.lit(True)
    for name in required:
        ok &= F.col(name).isNotNull()
    return df.where(ok), df.where(~ok)


def to_json_rows(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, F.to_json(F.struct(*[c for c in df.columns if c not in keep])).alias("json"))
