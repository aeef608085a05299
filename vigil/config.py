"""Settings. They are plain scalars and become literals of the plans."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    sensitivity: float = 1.0
    interval_s: float = 15.0
    tau_fast_s: float = 180.0
    tau_slow_s: float = 7200.0
    ewma_ttl_s: int = 7200
    prior_ttl_s: int = 86400
    remote_ceiling: int = 32768
    threat_cap: int = 5000
    accounting: bool = True
    table_max_default: int = 200_000
    persist_gap_s: int = 180
    persist_ttl_s: int = 3600
    emit_ttl_s: int = 3600
    cooldown_s: int = 180
    heartbeat_s: int = 7200
    throttle_s: int = 300
    weight_resource: float = 0.45
    weight_behavior: float = 0.45
    weight_threat: float = 0.10

    @property
    def s(self) -> float:
        return min(10.0, max(0.1, self.sensitivity if self.sensitivity > 0 else 1.0))

    @property
    def threshold_flows(self) -> int:
        return int(2000 / self.s)


@dataclass(frozen=True)
class Scaler:
    """Thresholds that move with the sensitivity."""

    s: float = 1.0

    def high(self, v: int) -> int:
        return v if v <= 0 else max(1, math.ceil(v / self.s))

    def low(self, v: int) -> int:
        return v if v <= 0 else max(1, math.ceil(v * self.s))

    def above(self, v: float) -> float:
        return v / self.s

    def below(self, v: float) -> float:
        return v * self.s

    def ratio(self, base: float) -> float:
        return min(1.0, max(0.0, 0.5 + (base - 0.5) / self.s))

    def anomaly(self, base: float) -> float:
        return min(0.99, max(0.05, base / self.s))


DEFAULT = Config()
IDENTITY = ["host_id", "instance", "ip", "direction"]
SNAPSHOT = [*IDENTITY, "snapshot_ts"]
