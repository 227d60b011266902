"""Settings: built-in defaults, overridden by YAML, overridden by the environment."""

from __future__ import annotations

import dataclasses
import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from cardwatch.functions import fixed


@dataclass
class StreamSettings:
    brokers: str = "localhost:9092"
    input_topic: str = "transactions"
    fraud_output_topic: str = "fraud_predictions"
    legit_output_topic: str = "legit_predictions"
    error_output_topic: str = "error_predictions"
    max_offsets_per_trigger: int = 1000
    trigger_interval: str = "10 seconds"
    watermark: str = "24 hours"


@dataclass
class StateSettings:
    velocity_ttl: int = 604_800  # seconds: 7 days
    ato_baseline_ttl: int = 2_592_000  # seconds: 30 days


@dataclass
class ModelSettings:
    base_threshold: float = 0.0564
    hold_threshold: float = 0.10
    block_threshold: float = 0.20


@dataclass
class ThresholdWeights:
    """Weights of (base, velocity, amount, takeover) thresholds per risk profile."""

    high_ato: list[float] = field(default_factory=lambda: [0.1, 0.2, 0.1, 0.6])
    high_velocity: list[float] = field(default_factory=lambda: [0.2, 0.5, 0.2, 0.1])
    high_amount: list[float] = field(default_factory=lambda: [0.2, 0.2, 0.5, 0.1])
    normal: list[float] = field(default_factory=lambda: [0.6, 0.2, 0.1, 0.1])


@dataclass
class VelocitySettings:
    high_1h_count: int = 5
    high_6h_count: int = 15
    high_24h_count: int = 30
    amount_spike_3x: float = 3.0
    amount_spike_5x: float = 5.0


@dataclass
class TakeoverSettings:
    geo_anomaly_distance: float = 1000.0
    geo_anomaly_weight: float = 0.30
    new_address_ip_weight: float = 0.20
    email_mismatch_weight: float = 0.35
    high_amount_weight: float = 0.15
    unusual_card_weight: float = 0.10
    high_amount_threshold: float = 2000.0
    ato_detection_threshold: float = 0.6
    risky_email_domains: list[str] = field(
        default_factory=lambda: list(fixed.PROFILE_RISKY_DOMAINS))


@dataclass
class Settings:
    kafka: StreamSettings = field(default_factory=StreamSettings)
    redis: StateSettings = field(default_factory=StateSettings)
    model: ModelSettings = field(default_factory=ModelSettings)
    threshold_weights: ThresholdWeights = field(default_factory=ThresholdWeights)
    velocity: VelocitySettings = field(default_factory=VelocitySettings)
    ato: TakeoverSettings = field(default_factory=TakeoverSettings)

    def validate(self) -> Settings:
        m = self.model
        if not 0 < m.base_threshold <= m.hold_threshold < m.block_threshold <= 1:
            raise ValueError("thresholds must satisfy 0 < base <= hold < block <= 1")
        for name, weights in vars(self.threshold_weights).items():
            if len(weights) != 4:
                raise ValueError(f"threshold_weights.{name} needs four numbers")
        return self


# environment variable -> (section, field, type)
ENVIRONMENT = {
    "KAFKA_BROKERS": ("kafka", "brokers", str),
    "KAFKA_INPUT_TOPIC": ("kafka", "input_topic", str),
    "KAFKA_FRAUD_TOPIC": ("kafka", "fraud_output_topic", str),
    "KAFKA_LEGIT_TOPIC": ("kafka", "legit_output_topic", str),
    "BASE_THRESHOLD": ("model", "base_threshold", float),
    "HOLD_THRESHOLD": ("model", "hold_threshold", float),
    "BLOCK_THRESHOLD": ("model", "block_threshold", float),
}


def resolve_config(
    path: str | None = None, env: Mapping[str, str] | None = None
) -> Settings:
    """Unknown sections and keys of the file are ignored."""
    settings = Settings()
    if path and os.path.exists(path):
        import yaml

        with open(path) as handle:
            loaded = yaml.safe_load(handle) or {}
        for section, values in loaded.items():
            target = getattr(settings, section, None)
            if not dataclasses.is_dataclass(target) or not isinstance(values, dict):
                continue
            for name, value in values.items():
                if hasattr(target, name):
                    setattr(target, name, value)
    env = os.environ if env is None else env
    for name, (section, attribute, kind) in ENVIRONMENT.items():
        if env.get(name):
            setattr(getattr(settings, section), attribute, kind(env[name]))
    return settings.validate()
