"""Default parameters of the operators, as immutable dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field

US = 1_000_000  # microseconds per second


@dataclass(frozen=True)
class SessionConfig:
    timeout_us: int = 300 * US
    # A chunk never exceeds the timeout, so all packets of a chunk share a session.
    chunk_us: int = 10 * US
    mode: str = "compat"

    @staticmethod
    def of(timeout_us: int, mode: str = "compat") -> "SessionConfig":
        return SessionConfig(timeout_us, max(1, timeout_us // 30), mode)


@dataclass(frozen=True)
class WindowConfig:
    # Window name, size and step in microseconds.
    short: tuple[int, int] = (10 * US, 2 * US)
    medium: tuple[int, int] = (60 * US, 10 * US)
    long: tuple[int, int] = (300 * US, 60 * US)
    burst_gap_us: int = 100_000

    def sizes(self) -> dict[str, int]:
        return {"short": self.short[0], "medium": self.medium[0], "long": self.long[0]}


@dataclass(frozen=True)
class RuleConfig:
    large_packet: float = 1500
    high_entropy: float = 7.0
    syn_ratio: float = 0.9
    syn_min_packets: int = 100


@dataclass(frozen=True)
class FilterRuleConfig:
    """Size, protocol, rate and flag rules of the configured rule set."""

    max_normal_size: int = 1500
    suspicious_protocols: tuple[int, ...] = (1,)
    max_packets_per_second: float = 100
    suspicious_flags: tuple[int, ...] = (0x01, 0x29)


@dataclass(frozen=True)
class DetectionConfig:
    mode: str = "hybrid"
    threshold: float = 0.7
    protocol_thresholds: dict[int, float] = field(
        default_factory=lambda: {6: 0.6, 17: 0.8, 1: 0.9}
    )
    rules: RuleConfig = RuleConfig()


@dataclass(frozen=True)
class AlertConfig:
    threshold: float = 0.7
    interval_us: int = 60 * US


@dataclass(frozen=True)
class RetrainConfig:
    min_samples: int = 1000
    max_history_days: int = 30
    retrain_full_interval_s: int = 604_800
    drop_threshold: float = 0.1
    f1_model_change: float = 0.3
    f1_ensemble: float = 0.4
    performance_threshold: float = 0.7
    evaluation_threshold: float = 0.75
    target_f1: float = 0.9
    min_gain: float = 0.01
