"""Defaults and durations."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_UNITS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000, "d": 86_400_000_000_000}


def parse_duration(text: str) -> int:
    """Nanoseconds of `10s`, `1m30s`, `250ms`; a bare number is seconds."""
    text = text.strip()
    if re.fullmatch(r"\d+(\.\d+)?", text):
        return round(float(text) * 1e9)
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|ms|s|m|h|d)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"not a duration: {text!r}")
    return round(sum(float(a) * _UNITS[b] for a, b in parts))


def format_duration(ns: int) -> str:
    out = ""
    for unit in ("d", "h", "m", "s", "ms", "us", "ns"):
        n, ns = divmod(ns, _UNITS[unit])
        out += f"{n}{unit}" if n else ""
    return out or "0s"


@dataclass(frozen=True)
class ScoreConfig:
    threshold: float = 3.0
    min_reference: int = 10
    rel_floor: float = 1e-3
    onset_persistence: int = 3
    onset_lookback_s: float = 30.0


@dataclass(frozen=True)
class WalkConfig:
    backward: float = 0.2
    damping: float = 0.85
    iterations: int = 200
    tolerance: float = 1e-10


@dataclass(frozen=True)
class SpotConfig:
    risk: float = 1e-4
    init_quantile: float = 0.98
    calibration: int = 120
    max_peaks: int = 400
    max_observations: int = 50_000
    min_peaks: int = 10


@dataclass(frozen=True)
class DetectorConfig:
    baseline_points: int = 240
    min_baseline: int = 30
    rel_floor: float = 0.02
    spot: SpotConfig = field(default_factory=SpotConfig)
    fallback_threshold: float = 6.0
    cusum_k: float = 1.0
    cusum_h: float = 12.0
    cusum_clip: float = 4.0
    freeze_max_points: int = 180
    learnable_run: int = 2
    max_surprise: float = 30.0


@dataclass(frozen=True)
class IncidentConfig:
    min_surprise: float = 1.0
    confirm_windows: int = 3
    min_services: int = 2
    severe_surprise: float = 8.0
    rca_delay: str = "30s"
    rca_interval: str = "60s"
    resolve_after: str = "180s"
    reference: str = "20m"
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class EngineConfig:
    resolution: str = "10s"
    lateness: str = "20s"
    trace_timeout: str = "8s"
    retention: str = "2h"
    novelty_horizon: str = "1h"
    novelty_warmup: str = "10m"
    incident: IncidentConfig = field(default_factory=IncidentConfig)
    detector: DetectorConfig = field(default_factory=DetectorConfig)

    def __post_init__(self):
        ns = parse_duration
        if ns(self.lateness) < ns(self.trace_timeout) + ns(self.resolution):
            raise ValueError("lateness must cover trace_timeout and one window")
        if ns(self.retention) < ns(self.incident.reference) + ns("600s"):
            raise ValueError("retention must cover the reference period and ten minutes")
