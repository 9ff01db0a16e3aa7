"""Records of several values: splitting, aggregation, per-value analysis, correlation, Mahalanobis distance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condmon.config import AnomalySettings
from condmon.functions import stats
from condmon.functions.chunks import numbered, sliding
from condmon.functions.folds import Fold, field, ordered
from condmon.functions.windows import MOMENTS, RankCorrelation, moments
from condmon.operators.anomaly import measure


def split(df: DataFrame, values: str, keep: list[str]) -> DataFrame:
    """One row a value of an array, map or number column: ``value_name``, ``value_index``, ``value``, ``total_values``."""
    kind = df.schema[values].dataType.typeName()
    v = F.col(values)
    if kind == "map":
        out = df.select(*keep, F.size(v).alias("total_values"), F.posexplode(v).alias("value_index", "value_name", "value"))
    elif kind == "array":
        out = df.select(*keep, F.size(v).alias("total_values"), F.posexplode(v).alias("value_index", "value")).withColumn("value_name", F.concat(F.lit("value"), F.col("value_index").cast("string")))
    else:
        out = df.select(*keep, F.lit(1).alias("total_values"), F.lit(0).alias("value_index"), v.alias("value"), F.lit("value").alias("value_name"))
    return out.select(*keep, "value_name", "value_index", F.col("value").cast("double").alias("value"), "total_values")


def parallel(df: DataFrame, values: str, keep: list[str]) -> DataFrame:
    """One row a record: ``values`` (array of double), ``value_names`` and ``value_count`` of an array, map or number column; null records have none."""
    kind = df.schema[values].dataType.typeName()
    v = F.col(values)
    if kind == "map":
        numbers, names = F.map_values(v), F.map_keys(v)
    elif kind == "array":
        numbers = v
        names = F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.concat(F.lit("value"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    else:
        numbers, names = F.array(v), F.array(F.lit("value"))
    return df.where(v.isNotNull()).select(*keep, numbers.cast("array<double>").alias("values"), names.alias("value_names"), F.size(numbers).alias("value_count"))


def aggregate(values: Column) -> Column:
    """Struct of mean, median, min, max, sum, range, stddev (population) and count of an array."""
    a = F.filter(values.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x))
    return F.struct(
        stats.array_mean(a).alias("mean"), stats.array_median(a).alias("median"), F.array_min(a).alias("min"), F.array_max(a).alias("max"),
        stats.array_sum(a).alias("sum"), (F.array_max(a) - F.array_min(a)).alias("range"), stats.array_stddev(a).alias("stddev"), F.size(a).alias("count"),
    )


def primary(aggregates: Column, method: str) -> Column:
    """The chosen one of :func:`aggregate`; an unknown method is the mean."""
    return aggregates[method if method in ("mean", "median", "min", "max", "sum", "range", "stddev") else "mean"]


def analyze(df: DataFrame, s: AnomalySettings, keys: list[str], order: list[str], bucket: Column | None = None) -> DataFrame:
    """Per-value verdicts (``is_anomaly``) over each value's own buffer: z-score and threshold in one level, IQR always with 1.5."""
    if s.method == "iqr":
        s = AnomalySettings(**{**s.__dict__, "iqr_multiplier": 1.5})
    out = measure(df, s, keys, order) if bucket is None else sliding(df, keys, order, bucket, s.window, lambda d, k: measure(d, s, k, order))
    return out.withColumn("is_anomaly", F.col("raw_severity") == "critical").drop("raw_severity")


def flag_records(verdicts: DataFrame, record: list[str]) -> DataFrame:
    return verdicts.groupBy(*record).agg(F.count_if("is_anomaly").alias("anomaly_count"), (F.count_if("is_anomaly") > 0).alias("has_anomaly"))


class Mahalanobis(Fold):
    """Distance of each record from the last ``window`` records of its entity (itself included), at least ten; sample covariance with a ridge, pseudo-inverse.

    Without ``gaps`` a vector that holds a null or a value that is not finite, or
    has another length than its entity's first, has no distance and joins no
    buffer.  With ``gaps`` such values (and places beyond a shorter vector's end)
    are missing: a record with any value joins the buffer and is compared on its
    own columns; each column's values are moved together, so the k-th value of
    one meets the k-th of another, means are over the values there are, and
    covariances are divided by the records in the buffer less one.
    """

    inputs = ("vector",)
    outputs = (field("distance", "double"), field("severity", "string"))

    def __init__(self, window: int = 100, critical: float = 3.0, warning: float = 2.0, gaps: bool = False) -> None:
        self.window, self.critical, self.warning, self.gaps = window, critical, warning, gaps

    def start(self) -> dict:
        return {"rows": []}

    def _usable(self, v: list | None, dims: int | None) -> list | None:
        if v is None or not len(v):
            return None
        x = [y if y is not None and np.isfinite(y) else None for y in v]
        if self.gaps:
            return x if any(y is not None for y in x) else None
        return x if None not in x and dims in (None, len(x)) else None

    def step(self, state, columns):
        vectors = columns["vector"]
        out, level = [None] * len(vectors), [None] * len(vectors)
        rows, good, held = list(state["rows"]), [], len(state["rows"])
        for i, v in enumerate(vectors):
            x = self._usable(v, len(rows[0]) if rows else None)
            if x is not None:
                rows.append(x)
                good.append(i)
        state["rows"] = rows[-self.window :]
        if not good:
            return {"distance": out, "severity": level}
        dim = max(map(len, rows))
        x = np.array([[*r, *[None] * (dim - len(r))] for r in rows], dtype=np.float64)
        ends = held + np.arange(len(good))  # place of each new row
        sizes = np.minimum(ends + 1, self.window)
        missing = np.concatenate([[0], np.cumsum(np.isnan(x).any(axis=1))])
        whole = missing[ends + 1] == missing[ends + 1 - sizes]  # windows without a gap are taken together
        for size in sorted(set(sizes[whole].tolist())):  # one size but for the first rows of a series
            if size < 10:
                continue
            which = np.flatnonzero(whole & (sizes == size))
            for part in np.array_split(which, max(1, len(which) // 512)):
                w = np.lib.stride_tricks.sliding_window_view(x, size, axis=0)[ends[part] - size + 1]  # rows x dim x size
                centred = w - w.mean(axis=2, keepdims=True)
                found = self._distance(np.einsum("ndk,nek->nde", centred, centred) / (size - 1), centred[:, :, -1])
                for i, m in zip(part, found.tolist(), strict=True):
                    out[good[i]], level[good[i]] = m, self._level(m, dim)
        if not whole.all():
            compact = [c[~np.isnan(c)] for c in x.T]
            upto = np.concatenate([np.zeros((1, dim), dtype=np.int64), np.cumsum(~np.isnan(x), axis=0)])
            for i in np.flatnonzero(~whole & (sizes >= 10)).tolist():
                here = np.flatnonzero(~np.isnan(x[ends[i]]))
                first, last = upto[ends[i] + 1 - sizes[i]], upto[ends[i] + 1]
                centred, at = np.zeros((len(here), int((last - first)[here].max()))), np.zeros(len(here))
                for k, c in enumerate(here.tolist()):  # what lacks at a column's end adds nothing to a product
                    part = compact[c][first[c] : last[c]]
                    at[k] = x[ends[i], c] - part.mean()
                    centred[k, : len(part)] = part - part.mean()
                m = float(self._distance((centred @ centred.T / (sizes[i] - 1))[None], at[None])[0])
                out[good[i]], level[good[i]] = m, self._level(m, len(here))
        return {"distance": out, "severity": level}

    @staticmethod
    def _distance(c: np.ndarray, d: np.ndarray) -> np.ndarray:
        c = c + np.eye(c.shape[1]) * np.maximum(1e-6, 1e-6 * np.einsum("ndd->nd", c).max(axis=1))[:, None, None]
        return np.sqrt(np.maximum(0.0, np.einsum("nd,nde,ne->n", d, np.linalg.pinv(c, hermitian=True), d)))

    def _level(self, m: float, dim: int) -> str:
        return "critical" if m > np.sqrt(dim * self.critical) else "warning" if m > np.sqrt(dim * self.warning) else "normal"


def mahalanobis(df: DataFrame, entity: list[str], order: list[str], vector: str, window: int = 100, gaps: bool = False, bucket: Column | None = None, chunk: int = 100_000) -> DataFrame:
    """Adds ``distance`` and ``severity`` of each record's vector (:class:`Mahalanobis`).

    With ``bucket``, which must not fall along the order, long series are cut
    into chunks of records that can join a buffer; the others have no result.
    """
    rows, fold = df.withColumn("vector", F.col(vector).cast("array<double>")), Mahalanobis(window, gaps=gaps)
    if bucket is None:
        return ordered(rows, entity, order, fold)
    rows = rows.select(*[c for c in rows.columns if c not in ("distance", "severity")])
    v = F.col("vector")
    there = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.coalesce((F.size(v) > 0) & (F.exists(v, there) if gaps else F.forall(v, there)), F.lit(False))
    if not gaps:  # the length that counts is that of the series' first good vector
        first = rows.where(usable).groupBy(*[F.col(k).alias(f"__of_{k}") for k in entity]).agg(F.min_by(F.size(v), F.struct(*order)).alias("__dims"))
        rows = rows.join(first, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in entity], "left").select(*rows.columns, "__dims")
        usable = F.coalesce(usable & (F.size(v) == F.col("__dims")), F.lit(False))
    found = sliding(rows.where(usable), entity, order, bucket, window, lambda d, k: ordered(d, k, order, fold), chunk)
    rest = rows.where(~usable).select("*", F.lit(None).cast("double").alias("distance"), F.lit(None).cast("string").alias("severity"))
    return found.unionByName(rest).drop("__dims")


def mahalanobis_2d(df: DataFrame, entity: list[str], order: list[str], x: str, y: str, window: int = 100) -> DataFrame:
    """The two-dimensional case in closed form over the moments of each window."""
    sample = lambda s, n: F.when(F.col(n) > 1, F.col(s) / (F.col(n) - 1))
    df = moments(df, entity, order, x, y, window)
    df = df.withColumn("__a", sample("__sxx", "__nx")).withColumn("__b", sample("__sxy", "__nxy")).withColumn("__c", sample("__syy", "__ny"))
    ridge = F.greatest(F.lit(1e-6), F.lit(1e-6) * F.greatest("__a", "__c"))
    df = df.withColumn("__p", F.col("__a") + ridge).withColumn("__q", F.col("__c") + ridge)
    square = (F.col("__q") * F.pow("__dx", F.lit(2.0)) - 2 * F.col("__b") * F.col("__dx") * F.col("__dy") + F.col("__p") * F.pow("__dy", F.lit(2.0))) / (F.col("__p") * F.col("__q") - F.col("__b") * F.col("__b"))
    df = df.withColumn("distance", F.when(F.col("__n") >= 10, F.sqrt(F.greatest(square, F.lit(0.0)))))
    level = F.when(F.col("distance") > float(np.sqrt(6.0)), "critical").when(F.col("distance") > 2.0, "warning").when(F.col("distance").isNotNull(), "normal")
    return df.withColumn("severity", level).drop("__a", "__b", "__c", "__p", "__q", *[f.name for f in MOMENTS])


def correlate(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, window: int = 100, method: str = "pearson", threshold: float = 0.7, bucket: Column | None = None, chunk: int = 1_000_000) -> DataFrame:
    """Adds ``correlation`` of the last ``window`` pairs (three at least) and ``is_anomalous``: a correlation *below* the threshold is the fault.

    With ``bucket``, an expression that never falls along the order, long series are cut into chunks.
    """

    def found(d: DataFrame, k: list[str]) -> DataFrame:
        if method == "spearman":
            pairs = d.withColumn("__x", F.col(x).cast("double")).withColumn("__y", F.col(y).cast("double"))
            return ordered(pairs, k, order, RankCorrelation(window)).drop("__x", "__y")
        made = moments(d, k, order, x, y, window)
        sx, sy = (F.when(F.col(f"__n{c}") > 0, F.sqrt(F.col(f"__s{c}{c}") / F.col(f"__n{c}"))) for c in "xy")
        r = stats.correlation(F.when(F.col("__nxy") > 0, F.col("__sxy") / F.col("__nxy")), sx, sy)
        return made.withColumn("correlation", F.when(F.col("__n") >= 3, r)).drop(*[f.name for f in MOMENTS])

    out = found(df, keys) if bucket is None else sliding(df, keys, order, bucket, window, found, chunk)
    return out.withColumn("is_anomalous", F.abs("correlation") < threshold)


def cross_correlation(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, block: int = 4096, bucket: Column | None = None) -> DataFrame:
    """``lag``, ``correlation`` for lags of up to a quarter of each series' length, both ways, and ``best`` (first largest).

    Series are cut into blocks of ``block`` samples.  Blocks near enough to hold
    a pair at some lag meet, and a pair of blocks gives its sums for all lags at
    once by a Fourier transform; the sums of all pairs are then added up by lag.
    ``bucket``, of the ``order`` columns and never falling along them, lets rows
    be numbered in two steps.
    """
    w = Window.partitionBy(*keys)
    of = df.select(*keys, *[F.col(c) for c in order if c not in keys], F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).where("__x is not null and __y is not null")
    facts = of.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.avg("__x").alias("__mx"), F.avg("__y").alias("__my"), (F.stddev_pop("__x") * F.stddev_pop("__y")).alias("__scale"))
    placed = of.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1) if bucket is None else numbered(of, keys, order, bucket)
    at = placed.join(facts.select(*keys, "__mx", "__my"), keys)
    sample = F.struct("__i", (F.col("__x") - F.col("__mx")).alias("x"), (F.col("__y") - F.col("__my")).alias("y"))
    cells = at.groupBy(*keys, F.floor(F.col("__i") / block).alias("__b")).agg(F.array_sort(F.collect_list(sample)).alias("__s"))
    most = F.floor(F.col("__n") / 4)
    reach, last = F.floor(most / block) + 1, F.floor((F.col("__n") - 1) / block)
    others = F.sequence(F.greatest(F.lit(0), F.col("__b") - reach), F.least(last, F.col("__b") + reach))
    left = cells.join(facts, keys).select(*keys, "__n", "__scale", "__b", F.col("__s.x").alias("__u"), F.explode(others).alias("__c"))
    right = cells.select(*keys, F.col("__b").alias("__c"), F.col("__s.y").alias("__v"))

    @F.pandas_udf("array<double>")
    def products(a, b):
        import pandas as pd

        return pd.Series([np.fft.irfft(np.conj(np.fft.rfft(u, 2 * block)) * np.fft.rfft(v, 2 * block), 2 * block) for u, v in zip(a, b, strict=True)])

    pairs = left.join(right, [*keys, "__c"]).select(*keys, "__n", "__scale", ((F.col("__c") - F.col("__b")) * block).alias("__gap"), F.posexplode(products("__u", "__v")).alias("__k", "__part"))
    lags = pairs.withColumn("lag", F.col("__gap") + F.when(F.col("__k") < block, F.col("__k")).otherwise(F.col("__k") - 2 * block)).where(F.abs("lag") <= most)
    sums = lags.groupBy(*keys, "__n", "__scale", "lag").agg(F.sum("__part").alias("__sum"))
    r = F.col("__sum") / ((F.col("__n") - F.abs("lag")) * F.nullif(F.col("__scale"), F.lit(0.0)))
    made = sums.withColumn("correlation", F.coalesce(r, F.lit(0.0))).select(*keys, "lag", "correlation")
    first = F.row_number().over(w.orderBy(F.desc("correlation"), "lag"))
    return made.withColumn("best", first == 1)
