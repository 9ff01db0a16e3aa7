"""Trends, rates of change and remaining useful life."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condmon.config import TrendSettings
from condmon.functions import stats
from condmon.functions.chunks import sliding, within_span
from condmon.functions.folds import Fold, field, ordered


def linear(df: DataFrame, s: TrendSettings, keys: list[str], order: list[str], bucket: Column | None = None, chunk: int = 1_000_000) -> DataFrame:
    """Least squares on the place in the buffer, three rows at least: ``slope``, ``intercept`` (at the buffer's first row), ``trend``, ``r2``, ``predictions`` of the next steps.

    With ``bucket``, which must not fall along the order, long series are cut into chunks.
    """

    def fitted(df: DataFrame, keys: list[str]) -> DataFrame:
        w = stats.trailing(keys, order, s.window)
        df = df.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("double"))
        n = F.count(F.lit(1)).over(w)
        sx, sy = F.var_pop("__at").over(w), F.var_pop("value").over(w)
        cov = F.covar_pop("__at", "value").over(w)
        df = df.withColumn("__n", n).withColumn("slope", F.when(n >= 3, cov / F.nullif(sx, F.lit(0.0))))
        df = df.withColumn("__m", F.avg("value").over(w)).withColumn("r2", F.when(n >= 3, F.coalesce(cov * cov / F.nullif(sx * sy, F.lit(0.0)), F.lit(0.0))))
        df = df.withColumn("intercept", F.col("__m") - F.col("slope") * (F.col("__n") - 1) / 2)
        ahead = F.transform(F.sequence(F.lit(0), F.lit(s.steps - 1)), lambda k: F.col("intercept") + F.col("slope") * (F.col("__n") + k))
        df = df.withColumn("predictions", F.when(F.col("slope").isNotNull(), ahead))
        return _with_threshold(df.withColumn("trend", _direction(F.col("slope"))), s, keys, order, w).drop("__at", "__n", "__m")

    return fitted(df, keys) if bucket is None else sliding(df, keys, order, bucket, s.window, fitted, chunk)


def _direction(slope: Column) -> Column:
    return F.when(slope > 0.01, "increasing").when(slope < -0.01, "decreasing").when(slope.isNotNull(), "stable")


def _with_threshold(df: DataFrame, s: TrendSettings, keys: list[str], order: list[str], w) -> DataFrame:
    """``steps_to_threshold``: number of the first prediction at or over it; ``time_to_threshold_ms`` by the mean interval of the buffer (needs ``ts``)."""
    if s.threshold is None:
        return df
    hit = F.array_position(F.transform("predictions", lambda p: p >= s.threshold), True)
    df = df.withColumn("steps_to_threshold", F.nullif(hit, F.lit(0).cast("long")))
    if "ts" not in df.columns:
        return df
    ms = F.unix_millis(F.col("ts").cast("timestamp_ltz"))
    gap = (F.max(ms).over(w) - F.min(ms).over(w)) / F.nullif(F.count(F.lit(1)).over(w) - 1, F.lit(0))
    return df.withColumn("time_to_threshold_ms", F.col("steps_to_threshold") * gap)


def holt(df: DataFrame, s: TrendSettings, keys: list[str], order: list[str], bucket: Column | None = None, chunk: int = 1_000_000) -> DataFrame:
    """Double exponential smoothing run anew over each buffer: ``level``, ``slope``, ``predictions``.  With ``bucket`` long series are cut into chunks."""
    a, b = F.lit(s.alpha), F.lit(s.beta)

    def step(state: Column, x: Column) -> Column:
        level = a * x + (1 - a) * (state["level"] + state["slope"])
        return F.struct(level.alias("level"), (b * (level - state["level"]) + (1 - b) * state["slope"]).alias("slope"))

    def fitted(df: DataFrame, keys: list[str]) -> DataFrame:
        w = stats.trailing(keys, order, s.window)
        df = df.withColumn("__v", F.collect_list(F.col("value").cast("double")).over(w))
        v = F.col("__v")
        first = F.struct(F.get(v, F.lit(0)).alias("level"), (F.get(v, F.lit(1)) - F.get(v, F.lit(0))).alias("slope"))
        # an array's own size is needed: a slice from 2 to its end
        smoothed = F.aggregate(F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))), first, step)
        df = df.withColumn("__f", F.when(F.size(v) >= 3, smoothed))
        df = df.withColumn("level", F.col("__f.level")).withColumn("slope", F.col("__f.slope"))
        ahead = F.transform(F.sequence(F.lit(1), F.lit(s.steps)), lambda k: F.col("level") + F.col("slope") * k)
        df = df.withColumn("predictions", F.when(F.col("level").isNotNull(), ahead)).withColumn("trend", _direction(F.col("slope")))
        return _with_threshold(df, s, keys, order, w).drop("__v", "__f")

    return fitted(df, keys) if bucket is None else sliding(df, keys, order, bucket, s.window, fitted, chunk)


def rate_of_change(df: DataFrame, keys: list[str], order: list[str], threshold: float | None = None, percent: bool = False, bucket: Column | None = None) -> DataFrame:
    """Adds ``rate`` a second (of the previous value in percent, if asked), null where time does not advance, and ``is_anomaly`` over the threshold.

    With ``bucket``, an expression that never falls along the order, long series are cut into chunks.
    """

    def rated(d: DataFrame, k: list[str]) -> DataFrame:
        w = Window.partitionBy(*k).orderBy(*order)
        seconds = (F.unix_micros(F.col("ts").cast("timestamp_ltz")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp_ltz"))) / 1e6
        before = F.lag("value").over(w)
        change = F.col("value") - before
        if percent:
            change = change / F.nullif(F.abs(before), F.lit(0.0)) * 100
        return d.withColumn("rate", F.when(seconds > 0, change / F.nullif(seconds, F.lit(0.0))))

    df = rated(df, keys) if bucket is None else sliding(df, keys, order, bucket, 2, rated)
    return df.withColumn("is_anomaly", F.abs("rate") > threshold) if threshold is not None else df


def acceleration(df: DataFrame, s: TrendSettings, keys: list[str], order: list[str], span_s: float | None = None) -> DataFrame:
    """Adds ``acceleration``: change between the last two valid rates of the time window over its mean spacing, which is the window by its rows.

    The window holds the rows so far of the last ``time_window_s``; a rate is
    valid where time advances, and both its rows must be in the window.  Series
    are cut into chunks of time of ``span_s`` (64 windows), with a window before
    each as context.
    """
    reach = round(s.time_window_s * 1e6)

    def found(d: DataFrame, k: list[str]) -> DataFrame:
        rows = Window.partitionBy(*k).orderBy(*order)
        upto, before = rows.rowsBetween(Window.unboundedPreceding, 0), rows.rowsBetween(Window.unboundedPreceding, -1)
        at, last = F.col("__us"), F.lag("__us").over(rows)
        rate = F.struct(((F.col("value") - F.lag("value").over(rows)) / ((at - last) / 1e6)).alias("rate"), last.alias("since"))
        d = d.withColumn("__rate", F.when(at > last, rate))
        pair = F.struct("__rate", F.last("__rate", ignorenulls=True).over(before).alias("other"))
        d = d.withColumn("__pair", F.last(F.when(F.col("__rate").isNotNull(), pair), ignorenulls=True).over(upto))
        times = Window.partitionBy(*k).orderBy("__us")
        same = Window.partitionBy(*k, "__us")
        later = F.count(F.lit(1)).over(same) - F.row_number().over(same.orderBy(*order))
        n = F.count(F.lit(1)).over(times.rangeBetween(-reach, 0)) - later
        both = (F.col("__pair.__rate.since") >= at - reach) & (F.col("__pair.other.since") >= at - reach)
        step = (F.col("__pair.__rate.rate") - F.col("__pair.other.rate")) / (F.lit(s.time_window_s) / n)
        return d.withColumn("__n", n).withColumn("acceleration", F.when(both & (F.col("__n") >= 3), step)).drop("__rate", "__pair", "__n")

    timed = df.withColumn("__us", F.unix_micros(F.col("ts").cast("timestamp_ltz")))
    return within_span(timed, keys, "__us", reach, found, None if span_s is None else round(span_s * 1e6)).drop("__us")


# Remaining useful life -------------------------------------------------------


#: Reliability at which a part counts as used up.
END_RELIABILITY = 0.1


def _neighbours(x: np.ndarray, width: int) -> np.ndarray:
    """The ``width // 2`` values on either side of each place (last axis), itself included; NaN beyond the ends."""
    h = width // 2
    edge = np.full((*x.shape[:-1], h), np.nan)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([edge, x, edge], axis=-1), 2 * h + 1, axis=-1)


def median_filter(x: np.ndarray, width: int = 5) -> np.ndarray:
    """Centred, the ends with fewer values, the upper of two middles; over the last axis of many windows at once."""
    near = np.sort(_neighbours(x, width), axis=-1)  # NaN last
    held = (~np.isnan(near)).sum(axis=-1, keepdims=True)
    return np.take_along_axis(near, held // 2, axis=-1)[..., 0]


def smooth(x: np.ndarray, width: int) -> np.ndarray:
    return np.nanmean(_neighbours(x, width), axis=-1)


def theil_sen(x: np.ndarray) -> np.ndarray:
    """Median of pairwise slopes (the upper middle) of each window, by selection; over 50 points both ends are thinned to every len // 25-th, the far end counted from the near one's next."""
    n = x.shape[-1]
    step = n // 25 if n > 50 else 1
    near, hop = np.meshgrid(np.arange(0, n, step), 1 + np.arange(0, n, step), indexing="ij")
    far = near + hop
    near, far = near[far < n], far[far < n]
    if not len(near):
        return np.zeros(x.shape[:-1])
    middle = len(near) // 2
    return np.partition((x[..., far] - x[..., near]) / (far - near), middle, axis=-1)[..., middle]


def least_squares(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = x.shape[-1]
    d = np.arange(n) - (n - 1) / 2
    slope = (x * d).sum(axis=-1) / (d * d).sum() if n > 1 else np.zeros(x.shape[:-1])
    return slope, x.mean(axis=-1) - slope * (n - 1) / 2


#: Percentages of B-lives; phases by the shape below a bound.
B_LIVES = (1, 5, 10, 50)
_gamma = np.vectorize(math.gamma, otypes=[np.float64])


def weibull(x: np.ndarray, interval: np.ndarray) -> dict[str, np.ndarray]:
    """Of each window: shape from the coefficient of variation (0.5 to 5), scale from the degradation so far, B-lives, reliability and hazard now; NaN where the last value is the largest or nothing rises."""
    n = x.shape[-1]
    low, span, mean = x.min(axis=-1), np.ptp(x, axis=-1), x.mean(axis=-1)
    with np.errstate(all="ignore"):
        left = np.where(span > 0, 1 - (x[..., -1] - low) / span, np.nan)
        fits = (n >= 3) & (least_squares(x)[0] > 0) & (left > 0) & (left < 1)
        cv = np.where(mean != 0, x.std(axis=-1) / mean, 0.0)
        beta = np.where(fits, np.where(cv > 0, np.clip(1 / cv, 0.5, 5.0), 2.0), np.nan)
        eta = (n - 1) * interval / (-np.log(left)) ** (1 / beta)
        elapsed = (n - 1) * interval
        out = {"beta": beta, "eta": eta, "mttf": eta * _gamma(1 + 1 / np.where(fits, beta, 1.0)), "reliability": np.exp(-((elapsed / eta) ** beta)), "hazard": beta / eta * (elapsed / eta) ** (beta - 1)}
        out |= {f"b{p}": eta * (-math.log(1 - p / 100)) ** (1 / beta) for p in B_LIVES}
    return {k: np.where(fits, v, np.nan) for k, v in out.items()}


def phase(beta: float) -> str:
    return "infant_mortality" if beta < 1 else "useful_life" if beta == 1 else "wear_out" if beta < 4 else "rapid_wear_out"


def remaining_many(x: np.ndarray, ms: np.ndarray, failure: float, method: str = "linear") -> list[dict | None]:
    """Remaining useful life in the unit of ``ms`` at the end of each window (windows x values, all finite), computed together; None under five values."""
    n = x.shape[-1]
    if n < 5:
        return [None] * len(x)
    now_ = x[:, -1]
    smoothed = smooth(median_filter(x), max(3, n // 10))
    line, intercept = least_squares(smoothed)
    robust = theil_sen(smoothed)
    slope, now = 0.7 * robust + 0.3 * line, smoothed[:, -1]
    interval = (ms[:, -1] - ms[:, 0]) / (n - 1)
    rest = ((x - (intercept[:, None] + line[:, None] * np.arange(n))) ** 2).sum(axis=1)
    total = ((x - x.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)
    margin = 1.96 * np.sqrt(rest / max(1, n - 2)) * math.sqrt(1 + 1 / n)
    with np.errstate(all="ignore"):
        per = interval / slope
        figures = {"rul": (failure - now) * per, "lower": np.maximum(0.0, (failure - margin - now) * per), "upper": (failure + margin - now) * per, "confidence": np.clip(np.where(total > 0, 1 - rest / total, 0.0), 0.0, 1.0)}
        w = weibull(x, interval) if method == "weibull" else {}
        fitted = ~np.isnan(w["beta"]) if w else np.zeros(len(x), dtype=bool)
        if fitted.any():
            life = np.maximum(0.0, w["eta"] * (-math.log(END_RELIABILITY)) ** (1 / w["beta"]) - (n - 1) * interval)
            spread = 1.96 / (w["hazard"] * math.sqrt(n))
            sure = np.clip(1 - np.abs(w["reliability"] - (1 - now_ / failure)), 0.3, 1.0)
            for name, v in (("rul", life), ("lower", np.maximum(0.0, life - spread)), ("upper", life + spread), ("confidence", sure)):
                figures[name] = np.where(fitted, v, figures[name])
        part = np.minimum(100.0, now / failure * 100) if failure else None
    common = {"smoothed": now, "slope": slope, "robust_slope": robust, "line_slope": line, "interval": interval, **figures}
    lists = {k: v.tolist() for k, v in common.items()}
    lives = {f"weibull_{k}": v.tolist() for k, v in w.items()}
    out: list[dict | None] = []
    for i in range(len(x)):
        if now_[i] >= failure:
            out.append({"rul": 0.0, "status": "failed", "confidence": 1.0, "model": method, "degraded": 100.0})
            continue
        r = {k: v[i] for k, v in lists.items()} | {"degraded": None if part is None else float(part[i])}
        if r["slope"] <= 1e-4:
            stable = {k: r[k] for k in ("smoothed", "slope", "robust_slope", "line_slope", "degraded")}
            out.append({"rul": None, "status": "stable", "confidence": 0.5, "model": method, **stable})
            continue
        step = r.pop("interval")
        if fitted[i]:
            r |= {k: v[i] for k, v in lives.items()} | {"model": "weibull"}
            r["phase"] = phase(r["weibull_beta"])
        else:
            r["model"] = "linear" if method == "weibull" else method
        r["status"] = "critical" if r["rul"] < 10 * step else "warning" if r["rul"] < 50 * step else "healthy"
        out.append(r)
    return out


def remaining(x: np.ndarray, ms: np.ndarray, failure: float, method: str = "linear") -> dict | None:
    """:func:`remaining_many` of one window, values that are not finite left out."""
    good = np.isfinite(x) & np.isfinite(ms)
    return remaining_many(x[good].astype(np.float64)[None], ms[good].astype(np.float64)[None], failure, method)[0]


#: Milliseconds in a unit; cycles stay as they are.
UNITS = {"hours": 3_600_000.0, "minutes": 60_000.0, "days": 86_400_000.0, "cycles": 1.0}


#: Windows whose slopes are computed together.
TOGETHER = 256
LIVES = tuple(f"weibull_b{p}" for p in B_LIVES)


class Rul(Fold):
    """Remaining useful life over the buffer of the last ``window`` finite samples (``value``, ``ms``); the windows of a batch are computed together."""

    inputs = ("value", "ms")
    outputs = (
        *[field(n, "double") for n in ("rul", "rul_lower", "rul_upper", "rul_confidence", "degraded", "rul_slope", "weibull_beta", "weibull_eta", "weibull_mttf", *LIVES, "reliability", "hazard")],
        field("phase", "string"), field("rul_status", "string"), field("rul_model", "string"), field("is_anomaly", "boolean"),
    )

    def __init__(self, s: TrendSettings) -> None:
        self.s = s

    def start(self) -> dict:
        return {"x": [], "ms": []}

    def step(self, state, columns):
        s, n = self.s, len(columns["value"])
        out: dict[str, list] = {f.name: [None] * n for f in self.outputs}
        good = [i for i, (x, ms) in enumerate(zip(columns["value"], columns["ms"], strict=True)) if x is not None and ms is not None and math.isfinite(x) and math.isfinite(ms)]
        held = len(state["x"])
        x, ms = ([*state[k], *[columns[c][i] for i in good]] for k, c in (("x", "value"), ("ms", "ms")))
        state["x"], state["ms"] = x[-s.window :], ms[-s.window :]
        if s.threshold is None or not good:
            return out
        whole = [np.array(v, dtype=np.float64) for v in (x, ms)]
        ends = held + np.arange(len(good))
        sizes = np.minimum(ends + 1, s.window)
        for size in sorted(set(sizes.tolist())):  # one size but for the first rows of a series
            which = np.flatnonzero(sizes == size)
            views = [np.lib.stride_tricks.sliding_window_view(v, size) for v in whole]
            for first in range(0, len(which), TOGETHER):
                part = which[first : first + TOGETHER]
                found = remaining_many(*[v[ends[part] - size + 1] for v in views], s.threshold, s.method)
                for k, r in zip(part.tolist(), found, strict=True):
                    if r is not None:
                        self._put(out, good[k], columns["value"][good[k]], r)
        return out

    def _put(self, out: dict[str, list], at: int, x: float, r: dict) -> None:
        unit = UNITS.get(self.s.unit, UNITS["hours"])
        in_unit = lambda v: v / unit if v is not None else None
        warned = self.s.warning is not None and x >= self.s.warning
        values = {
            "rul": in_unit(r.get("rul")), "rul_lower": in_unit(r.get("lower")) or None, "rul_upper": in_unit(r.get("upper")), "rul_confidence": r.get("confidence"), "degraded": r.get("degraded"), "rul_slope": r.get("slope"),
            **{n: r.get(n) for n in ("weibull_beta", "weibull_eta", "weibull_mttf", "phase")}, **{n: in_unit(r.get(n)) for n in LIVES}, "reliability": r.get("weibull_reliability"), "hazard": r.get("weibull_hazard"),
            "rul_status": r["status"], "rul_model": r["model"], "is_anomaly": r["status"] in ("critical", "failed") or warned,
        }
        for n, v in values.items():
            out[n][at] = v


def remaining_life(df: DataFrame, s: TrendSettings, keys: list[str], order: list[str], bucket: Column | None = None, chunk: int = 100_000) -> DataFrame:
    """Adds the remaining useful life (in ``s.unit``), its bounds, confidence, status, B-lives (in ``s.unit``), life phase, reliability, hazard (a millisecond) and Weibull figures at every row; needs ``ts``.

    With ``bucket``, which must not fall along the order, series are cut into
    chunks of finite samples; the others have no result.
    """
    timed = df.withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp_ltz")).cast("double"))
    if bucket is None:
        return ordered(timed, keys, order, Rul(s)).drop("ms")
    usable = F.coalesce(F.col("ms").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")), F.lit(False))
    fold = Rul(s)
    found = sliding(timed.where(usable), keys, order, bucket, s.window, lambda d, k: ordered(d, k, order, fold), chunk)
    void = [F.lit(None).cast(f.dataType).alias(f.name) for f in fold.outputs]
    rest = timed.select(*[c for c in timed.columns if c not in {f.name for f in fold.outputs}], *void).where(~usable)
    return found.unionByName(rest).drop("ms")
