"""Column lists and schemas (as DDL text, which every reader takes)."""

from __future__ import annotations

from flowlens.functions.specs import TEMPORAL_WINDOWS

# Feature names and their order are the data contract.
STAT_FEATURES = [
    "packet_count", "byte_count", "flow_duration", "avg_packet_size",
    "std_packet_size", "min_packet_size", "max_packet_size",
    "bytes_per_second", "packets_per_second",
    "tcp_syn_count", "tcp_ack_count", "tcp_fin_count", "tcp_rst_count",
    "tcp_flag_ratio", "tcp_packet_ratio", "udp_packet_ratio", "icmp_packet_ratio",
    "avg_payload_size", "payload_entropy", "payload_size_std",
    "src_port_entropy", "dst_port_entropy",
    "outbound_packet_ratio", "inbound_packet_ratio",
]

# The eight measures of a window and the four trends.
WINDOW_MEASURES = [
    "packet_rate", "byte_rate", "packet_size_mean", "packet_size_std",
    "inter_arrival_mean", "inter_arrival_std", "burst_count", "burst_duration_mean",
]
TREND_FEATURES = [
    "packet_rate_trend", "byte_rate_trend",
    "packet_size_variation", "inter_arrival_variation",
]
TEMPORAL_FEATURES = [
    f"{w}_window_{m}" for w in TEMPORAL_WINDOWS for m in WINDOW_MEASURES
] + TREND_FEATURES

ALL_FEATURES = STAT_FEATURES + TEMPORAL_FEATURES

# The model vector and its order.
MODEL_FEATURES = [
    "packet_count", "byte_count", "flow_duration", "avg_packet_size",
    "std_packet_size", "min_packet_size", "max_packet_size",
    "bytes_per_second", "packets_per_second",
    "tcp_syn_count", "tcp_ack_count", "tcp_fin_count", "tcp_rst_count",
    "tcp_flag_ratio", "payload_entropy",
]

# Columns that may not be negative after cleaning.
NON_NEGATIVE = [
    "packet_count", "byte_count", "flow_duration", "avg_packet_size",
    "std_packet_size", "min_packet_size", "max_packet_size",
    "bytes_per_second", "packets_per_second", "tcp_syn_count",
    "tcp_ack_count", "tcp_fin_count", "tcp_rst_count", "tcp_flag_ratio",
    "payload_entropy", "payload_size_std", "src_port_entropy",
    "dst_port_entropy", "outbound_packet_ratio", "inbound_packet_ratio",
]
ADDRESS_COLUMNS = ["src_ip", "dst_ip", "src_mac", "dst_mac"]

PACKET = (
    "packet_id BIGINT, ts_us BIGINT, src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, "
    "protocol INT, length INT, flags INT, payload BINARY"
)
RAW_FRAME = ("source STRING, record_offset BIGINT, ts_us BIGINT, wire_length INT, frame BINARY")
RAW_SAMPLE = (
    "timestamp DOUBLE, src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, protocol INT, "
    "protocol_name STRING, packet_size INT, tcp_flags STRING, payload_entropy DOUBLE, "
    "session_duration DOUBLE, inter_arrival_time DOUBLE, window_size INT, retransmissions INT, "
    "icmp_type INT, icmp_code INT, anomaly_type STRING, label INT"
)
DETECTION = (
    "session_id STRING, timestamp DOUBLE, src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, "
    "protocol INT, anomaly_score DOUBLE, is_anomaly BOOLEAN, anomaly_type STRING, "
    "detection_method STRING, threshold_used DOUBLE, reasons ARRAY<STRING>"
)
FEEDBACK = (
    "anomaly_id STRING, session_id STRING, is_correct BOOLEAN, actual_type STRING, "
    "features MAP<STRING, DOUBLE>, detection_result STRUCT<is_anomaly: BOOLEAN, anomaly_score: DOUBLE, "
    "protocol: STRING>, timestamp DOUBLE"
)
MODEL_ROW = ", ".join(f"{c} DOUBLE" for c in MODEL_FEATURES) + ", label INT"
FEATURE_ROW = ", ".join(f"{c} DOUBLE" for c in ALL_FEATURES) + ", label INT"
METRIC = (
    "protocol STRING, model_type STRING, f1 DOUBLE, precision DOUBLE, recall DOUBLE, accuracy DOUBLE, "
    "auc DOUBLE, confusion ARRAY<ARRAY<BIGINT>>, sample_count BIGINT, ts_us BIGINT"
)
