"""Operator settings: parsed and clamped, never rejected.

A value that can't be read becomes the default, one out of range the nearest
bound, so a setting that comes as text from a form or a column works as well.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields
from decimal import Decimal
from typing import Any


def clamp(value: Any, default: float, low: float = -math.inf, high: float = math.inf) -> float:
    """``value`` as a number within [low, high]; ``default`` where it is none."""
    try:
        x = float(value)
    except (TypeError, ValueError):
        return default
    return default if math.isnan(x) else min(max(x, low), high)


def number(default: float, low: float = -math.inf, high: float = math.inf, whole: bool = False) -> Any:
    """A dataclass field that is clamped on construction."""
    return field(default=default, metadata={"range": (default, low, high, whole)})


@dataclass(frozen=True)
class Settings:
    """Base of all settings: applies the ranges of its :func:`number` fields."""

    def __post_init__(self) -> None:
        for f in fields(self):
            if "range" in f.metadata:
                default, low, high, whole = f.metadata["range"]
                x = clamp(getattr(self, f.name), default, low, high)
                object.__setattr__(self, f.name, int(x) if whole and math.isfinite(x) else x)


@dataclass(frozen=True)
class AnomalySettings(Settings):
    method: str = "zscore"
    window: int = number(100, 2, 1_000_000, whole=True)
    zscore_threshold: float = number(3.0, 0)
    zscore_warning: float = number(2.0, 0)
    iqr_multiplier: float = number(1.5, 0)
    min_threshold: float | None = None
    max_threshold: float | None = None
    margin_percent: float = number(10.0, 0, 100)
    lower_percentile: float = number(5.0, 0, 100)
    upper_percentile: float = number(95.0, 0, 100)
    ema_alpha: float = number(0.3, 0.0, 1.0)
    deviation: str = "stddev"
    deviation_threshold: float = number(2.0, 0)
    deviation_warning: float = number(1.5, 0)
    cusum_target: float | None = None
    cusum_threshold: float = number(5.0, 0)
    cusum_warning: float = number(3.5, 0)
    cusum_drift: float = number(0.5, 0)
    hysteresis: bool = True
    consecutive: int = number(1, 1, 1000, whole=True)
    exit_percent: float = number(10.0, 0, 100)

    @property
    def exit_count(self) -> int:
        """Normal samples in a row that end an anomaly."""
        return max(self.consecutive, math.ceil(self.consecutive * (1 + self.exit_percent / 100)))

    @property
    def iqr_warning(self) -> float:
        """0.8 times the multiplier, as decimals: the product of doubles is a little more than 1.2 for 1.5, and values on the limit would be missed."""
        return float(Decimal("0.8") * Decimal(str(self.iqr_multiplier)))

    @property
    def warmup(self) -> int:
        return 4 if self.method == "iqr" else 2


@dataclass(frozen=True)
class SignalSettings(Settings):
    fft_size: int = number(256, 2, 1 << 20, whole=True)
    sampling_rate: float = number(1000.0, 1e-9)
    window: str = "hann"
    peak_threshold: float = number(0.1, 0, 1)
    low_hz: float = number(500.0, 0)
    high_hz: float = number(2000.0, 0)
    tolerance: float = number(0.05, 0)
    rpm: float = number(1800.0, 0)
    crest_limit: float = number(6.0, 0)
    kurtosis_limit: float = number(4.0, 0)
    min_distance: int = number(10, 1, whole=True)


@dataclass(frozen=True)
class TrendSettings(Settings):
    method: str = "linear"
    window: int = number(50, 2, 1_000_000, whole=True)
    steps: int = number(10, 1, 10_000, whole=True)
    alpha: float = number(0.3, 0, 1)
    beta: float = number(0.1, 0, 1)
    threshold: float | None = None
    warning: float | None = None
    time_window_s: float = number(10.0, 0)
    unit: str = "hours"


@dataclass(frozen=True)
class HealthSettings(Settings):
    aggregation: str = "weighted"
    critical: float = number(20.0, 0, 100)
    degraded: float = number(40.0, 0, 100)
    warning: float = number(60.0, 0, 100)
    attention: float = number(80.0, 0, 100)
    weights: tuple[tuple[str, float], ...] = ()
