"""Protocol facts: numbers, names, preferences, patterns and normal ranges."""

from __future__ import annotations

TEMPORAL_WINDOWS = ["short", "medium", "long"]

# Protocol names and numbers.
PROTOCOL_NUMBERS = {
    "tcp": 6, "udp": 17, "icmp": 1, "igmp": 2, "ipip": 4,
    "tcp6": 6, "udp6": 17, "icmp6": 58, "unknown": -1,
}
PACKET_PROTOCOL_NAMES = {6: "tcp", 17: "udp", 1: "icmp"}

# TCP flag bits.
FIN, SYN, RST, PSH, ACK, URG = 0x01, 0x02, 0x04, 0x08, 0x10, 0x20

# One entry per known protocol; -1 stands for every other protocol.
PROTOCOL_SPECS = {
    6: {
        "name": "tcp",
        "key_features": [
            "packet_size_mean", "packet_size_std", "packet_size_max",
            "tcp_flags", "tcp_flag_syn", "tcp_flag_ack", "tcp_flag_fin",
            "window_size_mean", "window_size_std",
            "inter_arrival_time_mean", "inter_arrival_time_std",
            "retransmission_count", "segment_size_mean",
            "flow_duration", "packets_per_second",
            "bytes_per_second", "payload_entropy_mean",
        ],
        "model_preference": ["lstm", "xgboost", "random_forest"],
        "anomaly_patterns": [
            "syn_flood", "port_scan", "unusual_flag_combination",
            "excessive_retransmissions", "unusual_window_size",
            "long_duration", "high_packet_rate",
        ],
        "normal_ranges": {
            "retransmission_count": (0, 5),
            "packets_per_second": (0, 100),
            "window_size_mean": (0, 65535),
        },
    },
    17: {
        "name": "udp",
        "key_features": [
            "packet_size_mean", "packet_size_std", "packet_size_max",
            "payload_size_mean", "payload_size_std",
            "flow_duration", "packets_per_second",
            "bytes_per_second", "payload_entropy_mean",
            "port_range", "unique_dest_ports",
        ],
        "model_preference": ["xgboost", "random_forest", "logistic_regression"],
        "anomaly_patterns": [
            "amplification_attack", "dns_amplification",
            "large_payload", "port_flood", "high_packet_rate",
        ],
        "normal_ranges": {
            "packet_size_mean": (0, 1500),
            "packets_per_second": (0, 200),
            "unique_dest_ports": (1, 5),
        },
    },
    1: {
        "name": "icmp",
        "key_features": [
            "packet_size_mean", "packet_size_std",
            "icmp_type", "icmp_code",
            "request_response_ratio", "echo_request_count",
            "echo_reply_count", "flow_duration",
            "packets_per_second", "bytes_per_second",
        ],
        "model_preference": ["random_forest", "xgboost", "logistic_regression"],
        "anomaly_patterns": [
            "icmp_flood", "ping_flood", "unusual_type_code",
            "high_request_response_ratio", "high_packet_rate",
        ],
        "normal_ranges": {
            "request_response_ratio": (0.5, 2),
            "packets_per_second": (0, 10),
            "echo_request_count": (0, 10),
        },
    },
    58: {
        "name": "icmp6",
        "key_features": [
            "packet_size_mean", "packet_size_std",
            "icmp_type", "icmp_code",
            "flow_duration", "packets_per_second",
            "bytes_per_second",
        ],
        "model_preference": ["random_forest", "logistic_regression"],
        "anomaly_patterns": ["icmp6_flood", "unusual_type_code", "high_packet_rate"],
        "normal_ranges": {"packets_per_second": (0, 10)},
    },
    -1: {
        "name": "unknown",
        "key_features": [
            "packet_size_mean", "packet_size_std",
            "flow_duration", "packets_per_second",
            "bytes_per_second",
        ],
        "model_preference": ["xgboost", "random_forest"],
        "anomaly_patterns": ["unusual_size", "high_packet_rate"],
        "normal_ranges": {"packet_size_mean": (0, 1500), "packets_per_second": (0, 100)},
    },
}

# Texts of the fired rules, in rule order.
RULE_REASONS = {"large_packet": "大数据包", "high_entropy": "高熵", "syn_flood": "SYN Flood"}
