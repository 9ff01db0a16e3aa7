"""Engineered features of machines: pumps, air handling, cutting tools, motors, vibration bands."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condmon.operators.signal import per_frame

#: Fixed values: (good, warning, critical, weight) of each indicator of motor health.
MOTOR = {
    "current_imbalance": (0.02, 0.05, 0.1, 0.15),
    "THD": (0.05, 0.1, 0.15, 0.15),
    "vib_rms": (2.0, 4.5, 7.0, 0.30),
    "vib_crest": (3.0, 4.5, 6.0, 0.20),
    "vib_kurtosis": (3.5, 5.0, 7.0, 0.20),
}
#: Frequency bands in Hz of the vibration features, and of the motor's.
BANDS = ((0, 100), (100, 200), (200, 500), (500, 1000), (1000, 3000))
MOTOR_BANDS = ((0, 100), (100, 500), (500, 1000), (1000, 3000), (3000, 5000))
SLIPS = (0.02, 0.03, 0.04, 0.05)


def _c(name: str) -> Column:
    return F.col(name).cast("double")


def _ratio(a: Column, b: Column) -> Column:
    """0 where the divisor is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0.0)))


def _add(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


def pump(df: DataFrame) -> DataFrame:
    """From p_inlet, p_outlet (bar), flow, current, bearing_temp, vibration_rms: pressure rise, hydraulic power (kW), efficiency (0 to 1, at 400 V three-phase and a power factor of 0.85), energy by flow, temperature rise, vibration by flow, suction margin."""
    rise = _c("p_outlet") - _c("p_inlet")
    hydraulic = _c("flow") * rise * 100 / 36
    electrical = _c("current") * (400 * 0.85 * math.sqrt(3) / 1000)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), hydraulic / F.nullif(electrical, F.lit(0.0))))
    return _add(
        df, delta_p=rise, hydraulic_power=hydraulic, efficiency=share, specific_energy=_ratio(_c("current"), _c("flow")),
        temp_rise=_c("bearing_temp") - 25, vib_flow_ratio=_ratio(_c("vibration_rms"), _c("flow")), npsh_margin=_c("p_inlet") - 0.5,
    )


def hvac(df: DataFrame, rated_airflow: float) -> DataFrame:
    """From mixed, supply, return and outdoor temperatures, airflow, fan_power, filter_dp, chw_valve, fan_vibration: differences and indicators of coil, fan, filter and economiser."""
    load = _c("airflow") / rated_airflow + 0.1
    coil = _c("mixed_temp") - _c("supply_temp")
    outside = (_c("return_temp") - _c("mixed_temp")) / (_c("return_temp") - _c("outdoor_temp") + 0.1)
    return _add(
        df, delta_t_coil=coil, delta_t_room=_c("return_temp") - _c("supply_temp"), fan_efficiency=_c("airflow") / (_c("fan_power") * 1000 + 1),
        filter_loading=_c("filter_dp") / load, specific_fan_power=_c("fan_power") * 1000 / (_c("airflow") + 1),
        economizer_eff=F.greatest(F.lit(-1.0), F.least(F.lit(1.0), outside)), cooling_eff=coil / (_c("chw_valve") + 1) * 10, vib_airflow_ratio=_c("fan_vibration") / load,
    )


def energy_waste(df: DataFrame, baseline: float = 1.0) -> Column:
    """kW lost to a fan over 1.2 times its baseline specific power, and to supply air over 57 degrees."""
    fan = F.when(F.col("specific_fan_power") > baseline * 1.2, (F.col("specific_fan_power") - baseline) * _c("airflow") / 1000).otherwise(0.0)
    cooling = F.when(_c("supply_temp") > 57, (_c("supply_temp") - 55) * _c("airflow") * 1.08 / 12000).otherwise(0.0)
    return fan + cooling


def waste_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg("energy_waste_kw").alias("mean_kw"), F.sum("energy_waste_kw").alias("sum_kw"))


def wear_state(wear: Column) -> Column:
    """Wear in mm, held within 0 and 1: new to 0.1, good to 0.2, worn to 0.3, critical."""
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), wear))
    return F.when(w <= 0.1, "new").when(w <= 0.2, "good").when(w <= 0.3, "worn").when(w.isNotNull(), "critical")


def cutting_tool(df: DataFrame) -> DataFrame:
    """Force ratios, specific cutting energy, power, vibration and acoustic ratios, cutting speed and wear state."""
    force, vib = _c("force_resultant"), _c("vibration_rms")
    return _add(
        df, force_xy_ratio=_c("force_x") / (_c("force_y") + 1), force_z_ratio=_c("force_z") / (force + 1), specific_energy=force / (_c("feed_rate") * _c("depth_of_cut") * 10 + 1),
        power_force_ratio=_c("power_kw") * 1000 / (force + 1), vib_force_ratio=vib / (force / 1000 + 0.1), ae_vib_ratio=_c("ae_rms") / (vib + 0.1),
        temp_normalized=_c("temperature") / 200, cutting_speed=_c("spindle_speed") * (math.pi * 10 / 1000), wear_state=wear_state(_c("wear_vb")),
    )


def piecewise(x: Column, good: float, warning: float, critical: float) -> Column:
    """100 up to good, 70 at warning, 30 at critical, on to 0 at twice critical."""
    between = lambda top, points, a, b: top - points * (x - a) / (b - a)
    beyond = F.greatest(F.lit(0.0), 30 - 30 * (x - critical) / critical)
    return F.when(x <= good, 100.0).when(x <= warning, between(100, 30, good, warning)).when(x <= critical, between(70, 40, warning, critical)).when(x.isNotNull(), beyond)


def motor_health(df: DataFrame, metrics: dict[str, tuple[float, float, float, float]] | None = None) -> DataFrame:
    """Adds ``motor_health``: weighted mean of the scores of the indicators that the table has."""
    have = {n: m for n, m in (metrics or MOTOR).items() if n in df.columns}
    total = sum(m[3] for m in have.values())
    score = sum((piecewise(_c(n), *m[:3]) * m[3] for n, m in have.items()), F.lit(0.0))
    return df.withColumn("motor_health", score / total if total else F.lit(0.0))


def _moments(x: np.ndarray) -> dict[str, float]:
    rms, sd, d = float(np.sqrt((x**2).mean())), float(x.std()), x - x.mean()
    peak = float(np.abs(x).max())
    return {"rms": rms, "peak": peak, "crest": peak / rms if rms else 0.0, "sd": sd, "kurtosis": float((d**4).mean() / sd**4) if sd else 0.0, "skewness": float((d**3).mean() / sd**3) if sd else 0.0}


def _shares(f: np.ndarray, power: np.ndarray, bands: tuple) -> dict[str, float]:
    total = power.sum()
    return {f"band_{a}_{b}": float(power[(f >= a) & (f < b)].sum() / total) if total else 0.0 for a, b in bands}


def _doubles(names: list[str]) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


def vibration_bands(df: DataFrame) -> DataFrame:
    """Per frame: rms, peak, crest, sd, kurtosis (3 for a normal signal), skewness, power-weighted centroid and spread, share of power by band."""
    names = ["rms", "peak", "crest", "sd", "kurtosis", "skewness", "centroid", "spread", *[f"band_{a}_{b}" for a, b in BANDS]]

    def kernel(x: np.ndarray, rate: float) -> dict:
        f, power = np.fft.rfftfreq(len(x), 1 / rate), (np.abs(np.fft.rfft(x)) / len(x)) ** 2
        total = power.sum() or 1.0
        centroid = float((f * power).sum() / total)
        return _moments(x) | {"centroid": centroid, "spread": float(np.sqrt(((f - centroid) ** 2 * power).sum() / total))} | _shares(f, power, BANDS)

    return per_frame(df, _doubles(names), kernel)


def motor_vibration(df: DataFrame) -> DataFrame:
    """Per frame: rms, peak, crest, kurtosis, dominant frequency and share of power by band."""
    names = ["rms", "peak", "crest", "kurtosis", "dominant_frequency", *[f"band_{a}_{b}" for a, b in MOTOR_BANDS]]

    def kernel(x: np.ndarray, rate: float) -> dict:
        half = len(x) // 2
        f, size = np.arange(half) * rate / len(x), np.abs(np.fft.fft(x))[:half] * 2 / len(x)
        return _moments(x) | {"dominant_frequency": float(f[size.argmax()]) if half else None} | _shares(f, size**2, MOTOR_BANDS)

    return per_frame(df, _doubles(names), kernel)


def motor_current(df: DataFrame, supply_hz: float = 50.0) -> DataFrame:
    """Per frame of a phase current: fundamental, THD over harmonics 3 to 13, slip sidebands over the fundamental."""
    names = ["phase_rms", "fundamental", "THD", *[f"sideband_{round(100 * s)}pct" for s in SLIPS]]

    def kernel(x: np.ndarray, rate: float) -> dict:
        f, size = np.fft.fftfreq(len(x), 1 / rate), np.abs(np.fft.fft(x)) / len(x)
        at = lambda hz: float(size[np.abs(f - hz).argmin()])
        base = 2 * at(supply_hz)
        over = lambda v: v / base if base else 0.0
        sides = {f"sideband_{round(100 * s)}pct": over(at(supply_hz * (1 - 2 * s)) + at(supply_hz * (1 + 2 * s))) for s in SLIPS}
        return {"phase_rms": float(np.sqrt((x**2).mean())), "fundamental": base, "THD": over(math.sqrt(sum(at(supply_hz * h) ** 2 for h in range(3, 14, 2))))} | sides

    return per_frame(df, _doubles(names), kernel)


def imbalance(a: Column, b: Column, c: Column) -> Column:
    """Spread of three phase values over their mean; 0 where the mean is 0."""
    return _ratio(F.greatest(a, b, c) - F.least(a, b, c), (a + b + c) / 3)


def with_noise(df: DataFrame, columns: list[str], share: float, seed: int) -> DataFrame:
    """Normal noise on the columns, a share of each one's deviation."""
    spread = df.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    for i, c in enumerate(columns):
        df = df.withColumn(c, F.col(c) + F.randn(seed + i) * F.lit((spread[c] or 0.0) * share))
    return df


def flip_labels(df: DataFrame, label: str, classes: list[str], share: float, seed: int) -> DataFrame:
    """Label noise: that share of rows gets another class, drawn evenly."""
    others = F.filter(F.array(*map(F.lit, classes)), lambda c: c != F.col(label))
    drawn = F.get(others, F.floor(F.rand(seed + 1) * F.size(others)).cast("int"))
    return df.withColumn(label, F.when(F.rand(seed) < share, F.coalesce(drawn, F.col(label))).otherwise(F.col(label)))
