"""Statistics as Column expressions, without UDFs.

Aggregates take a column and an optional window: with one they slide, without
one they are plain aggregates.  The ``array_*`` forms work on an array column.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def _over(x: Column, w: WindowSpec | None) -> Column:
    return x.over(w) if w is not None else x


def trailing(keys: list[str], order: list[str], rows: int) -> WindowSpec:
    """The last ``rows`` rows of a series, the present one included."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(rows - 1), 0)


def mean(x: Column, w: WindowSpec | None = None) -> Column:
    """Null on nothing."""
    return _over(F.avg(x), w)


def stddev(x: Column, w: WindowSpec | None = None) -> Column:
    """Population; 0 on nothing."""
    return F.coalesce(_over(F.stddev_pop(x), w), F.lit(0.0))


def array_deviation(values: Column) -> Column:
    """Population deviation of an array by Welford's recurrence in the order of the array: the rounding of SQL, where the aggregate's own form may differ in the last bit; 0 on nothing."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def add(a: Column, x: Column) -> Column:
        mean = a["mean"] + (x - a["mean"]) / (a["n"] + 1.0)
        return F.struct((a["n"] + 1.0).alias("n"), mean.alias("mean"), (a["squares"] + (x - mean) * (x - a["mean"])).alias("squares"))

    done = lambda a: F.coalesce(F.sqrt(a["squares"] / F.nullif(a["n"], F.lit(0.0))), F.lit(0.0))
    return F.aggregate(values.cast("array<double>"), start, add, done)


def stddev_sample(x: Column, w: WindowSpec | None = None) -> Column:
    """Sample; 0 under two values."""
    return F.coalesce(_over(F.stddev_samp(x), w), F.lit(0.0))


def variance(x: Column, w: WindowSpec | None = None) -> Column:
    return F.coalesce(_over(F.var_pop(x), w), F.lit(0.0))


def percentile(x: Column, p: float, w: WindowSpec | None = None) -> Column:
    """Linear interpolation at ``p / 100 * (n - 1)``; 0 on nothing."""
    return F.coalesce(_over(F.percentile(x, p / 100), w), F.lit(0.0))


def median(x: Column, w: WindowSpec | None = None) -> Column:
    return percentile(x, 50, w)


def values(x: Column, w: WindowSpec | None = None) -> Column:
    """The values themselves, sorted."""
    return F.sort_array(_over(F.collect_list(x), w))


def quartiles(ordered: Column) -> Column:
    """Struct q1, median, q3 of a sorted array, without interpolation: the element at ``floor(n * p)``."""
    at = lambda p: F.get(ordered, F.floor(F.size(ordered) * F.lit(p)).cast("int"))
    return F.struct(at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"))


def iqr_bounds(q: Column, k: Column | float = 1.5) -> Column:
    """Struct lower, upper from a quartiles struct."""
    k = F.lit(k) if isinstance(k, (int, float)) else k
    spread = q["q3"] - q["q1"]
    return F.struct((q["q1"] - k * spread).alias("lower"), (q["q3"] + k * spread).alias("upper"))


def zscore(x: Column, m: Column, s: Column) -> Column:
    """0 where the deviation is 0."""
    return F.when(s == 0, F.lit(0.0)).otherwise((x - m) / s)


def pearson(x: Column, y: Column, w: WindowSpec | None = None) -> Column:
    """Within [-1, 1]; 0 where either side is constant; null on nothing."""
    sx, sy = _over(F.stddev_pop(x), w), _over(F.stddev_pop(y), w)
    return correlation(_over(F.covar_pop(x, y), w), sx, sy)


def correlation(covariance: Column, sx: Column, sy: Column) -> Column:
    """The same from a covariance and both deviations (population)."""
    r = covariance / F.nullif(sx * sy, F.lit(0.0))
    return F.when(sx.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(r, F.lit(0.0)))))


def average_rank(keys: list[str], value: str) -> Column:
    """Rank from 1 within ``keys``; ties share the mean of their ranks."""
    r = F.rank().over(Window.partitionBy(*keys).orderBy(value))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return r + (ties - 1) / 2.0


def skewness(x: Column, w: WindowSpec | None = None) -> Column:
    """Bias factor of the sample form over z-scores of the population form; 0 under three values or when constant."""
    n, s = _over(F.count(x), w).cast("double"), _over(F.stddev_pop(x), w)
    g = _over(F.skewness(x), w)
    return F.when((n < 3) | (s == 0), F.lit(0.0)).otherwise(g * n * n / F.nullif((n - 1) * (n - 2), F.lit(0.0)))


def kurtosis(x: Column, w: WindowSpec | None = None) -> Column:
    """Excess kurtosis with the sample form's factors over population z-scores; 0 under four values or when constant."""
    n, s = _over(F.count(x), w).cast("double"), _over(F.stddev_pop(x), w)
    fourth = (_over(F.kurtosis(x), w) + 3) * n
    low = F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when((n < 4) | (s == 0), F.lit(0.0)).otherwise(n * (n + 1) / ((n - 1) * low) * fourth - 3 * (n - 1) * (n - 1) / low)


def rms(x: Column, w: WindowSpec | None = None) -> Column:
    return F.coalesce(F.sqrt(_over(F.avg(x * x), w)), F.lit(0.0))


def crest_factor(x: Column, w: WindowSpec | None = None) -> Column:
    r = rms(x, w)
    return F.when(r == 0, F.lit(0.0)).otherwise(_over(F.max(F.abs(x)), w) / r)


# Over arrays ---------------------------------------------------------------


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def array_mean(a: Column) -> Column:
    """Null on an empty array."""
    return array_sum(a) / F.nullif(F.size(a), F.lit(0))


def array_moment(a: Column, center: Column, power: int) -> Column:
    """Mean of (x - center) to ``power``."""
    return array_mean(F.transform(a, lambda x: F.pow(x - center, F.lit(float(power)))))


def array_stddev(a: Column) -> Column:
    return F.coalesce(F.sqrt(array_moment(a, array_mean(a), 2)), F.lit(0.0))


def array_median(a: Column) -> Column:
    s = F.sort_array(a)
    n = F.size(a)
    at = lambda i: F.get(s, i.cast("int"))
    return F.coalesce((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2, F.lit(0.0))


def array_rms(a: Column) -> Column:
    return F.coalesce(F.sqrt(array_mean(F.transform(a, lambda x: x * x))), F.lit(0.0))


def moving_average(a: Column, width: int) -> Column:
    """Trailing mean of up to ``width`` elements at each place."""
    return F.transform(a, lambda _, i: array_mean(F.slice(a, F.greatest(i - (width - 1), F.lit(0)) + 1, F.least(i + 1, F.lit(width)))))


def ema_series(a: Column, alpha: float) -> Column:
    """Exponential moving average of an array, seeded with its first element."""
    step = lambda s, x: F.concat(s, F.array(F.when(F.size(s) == 0, x).otherwise(F.lit(alpha) * x + F.lit(1 - alpha) * F.coalesce(F.get(s, F.size(s) - 1), x))))
    return F.aggregate(a, F.array().cast("array<double>"), step)
