"""Isolation forest and principal-component monitoring as ordered folds, and PCA scoring of a table."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condmon.functions.chunks import numbered
from condmon.functions.folds import Fold, field, ordered

EULER = 0.5772156649015329


def _expected(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n <= 1 else 2 * (math.log(n - 1) + EULER) - 2 * (n - 1) / n if n > 2 else 1.0


class Forest:
    """Isolation forest after Liu, Ting and Zhou: random splits to a height limit, score ``2 ** (-mean path / c(n))``; seeded."""

    def __init__(self, x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.size = min(sample, len(x))
        limit = math.ceil(math.log2(max(2, self.size)))
        self.trees = [self._grow(x[rng.choice(len(x), self.size, replace=False)], limit, rng) for _ in range(trees)]

    def _grow(self, x: np.ndarray, height: int, rng: np.random.Generator) -> tuple:
        low, high = x.min(axis=0), x.max(axis=0)
        open_ = np.flatnonzero(high > low)
        if height == 0 or len(x) <= 1 or not len(open_):
            return (len(x),)
        f = int(rng.choice(open_))
        cut = float(rng.uniform(low[f], high[f]))
        left = x[:, f] < cut
        return f, cut, self._grow(x[left], height - 1, rng), self._grow(x[~left], height - 1, rng)

    def _paths(self, tree: tuple, x: np.ndarray, depth: int) -> np.ndarray:
        if len(tree) == 1:
            return np.full(len(x), depth + _expected(tree[0]))
        f, cut, left, right = tree
        out, side = np.empty(len(x)), x[:, f] < cut
        if side.any():
            out[side] = self._paths(left, x[side], depth + 1)
        if (~side).any():
            out[~side] = self._paths(right, x[~side], depth + 1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        mean = np.mean([self._paths(t, x, 0) for t in self.trees], axis=0)
        return 2.0 ** (-mean / max(_expected(self.size), 1e-9))


class IsolationFold(Fold):
    """Features (value, change, place in the buffer); trained at ten samples, in ``incremental`` and ``adaptive`` mode again every ``retrain`` samples; before that |z| > 3 decides.

    The threshold is the score at the contamination share of the training
    scores until ten samples are scored, then that of the last ``window`` scored
    samples, the present one included.
    """

    outputs = (field("score", "double"), field("threshold", "double"), field("is_anomaly", "boolean"), field("severity", "string"))

    def __init__(self, window: int = 100, trees: int = 100, contamination: float = 0.1, mode: str = "batch", retrain: int = 50, seed: int = 7) -> None:
        self.window, self.n, self.share, self.again, self.retrain, self.seed = window, trees, contamination, mode != "batch", retrain, seed
        self.forests: dict[tuple, Forest] = {}

    def start(self) -> dict:
        return {"buffer": [], "trained_on": None, "since": 0, "scores": [], "limit": None}

    def _features(self, b: list[float]) -> np.ndarray:
        v = np.array(b)
        return np.column_stack([v, np.diff(v, prepend=v[0]), np.arange(len(v))])

    def _forest(self, train: list[float]) -> Forest:
        key = tuple(train)
        if key not in self.forests:
            self.forests = {key: Forest(self._features(train), self.n, 256, self.seed)}
        return self.forests[key]

    def limit(self, scores: list[float]) -> float:
        """The score at the contamination share, from the highest; the highest where the share is under one score."""
        return sorted(scores, reverse=True)[min(len(scores) - 1, int(len(scores) * self.share))] or 0.5

    def judged(self, state: dict, score: float) -> tuple[float, bool]:
        """Threshold and verdict of a score, which joins the last ones first."""
        state["scores"] = (state["scores"] + [score])[-self.window :]
        if len(state["scores"]) >= 10:
            state["limit"] = self.limit(state["scores"])
        return state["limit"], score >= state["limit"]

    def step(self, state, columns):
        rows: list[tuple] = []
        waiting: list[tuple[int, tuple[float, float, int]]] = []  # rows that the present forest has to score

        def score() -> None:
            if waiting:
                found = self._forest(state["trained_on"]).score(np.array([f for _, f in waiting], dtype=np.float64))
                for (at, _), s in zip(waiting, found.tolist(), strict=True):
                    rows[at] = (s, *self.judged(state, s))
                waiting.clear()

        for x in columns["value"]:
            rows.append((None, None, None))
            if x is None or not math.isfinite(x):
                continue
            b = state["buffer"]
            b.append(x)
            del b[: -self.window]
            state["since"] += 1
            if len(b) >= 10 and (state["trained_on"] is None or (self.again and state["since"] >= self.retrain)):
                score()
                state["trained_on"], state["since"] = list(b), 0
                state["limit"] = self.limit(self._forest(b).score(self._features(b)).tolist())
            if state["trained_on"] is None:
                sd = float(np.std(b))
                rows[-1] = (None, None, bool(len(b) > 1 and sd > 0 and abs(x - float(np.mean(b))) / sd > 3.0))
            else:
                waiting.append((len(rows) - 1, (x, x - b[-2] if len(b) > 1 else 0.0, len(b) - 1)))
        score()
        words = {None: None, True: "warning", False: "normal"}
        return {"score": [r[0] for r in rows], "threshold": [r[1] for r in rows], "is_anomaly": [r[2] for r in rows], "severity": [words[r[2]] for r in rows]}


def isolation_forest(df: DataFrame, keys: list[str], order: list[str], **settings) -> DataFrame:
    return ordered(df, keys, order, IsolationFold(**settings))


def normal_cdf(z: float) -> float:
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


class Components:
    """Standardised principal components: deviations of 0 count as 1, components up to the wanted share of variance."""

    def __init__(self, x: np.ndarray, share: float = 0.95, sigma: float = 3.0, count: int | None = None) -> None:
        self.mean, sd = x.mean(axis=0), x.std(axis=0)
        self.sd = np.where(sd == 0, 1.0, sd)
        z = (x - self.mean) / self.sd
        value, vector = np.linalg.eigh(z.T @ z / max(1, len(x) - 1))
        value, vector = value[::-1], vector[:, ::-1]
        part = np.cumsum(value) / max(value.sum(), 1e-300)
        k = count or int(np.searchsorted(part, share - 1e-12) + 1)
        self.value, self.axes = np.maximum(value[:k], 0), vector[:, :k]
        t2, spe, _ = self.apply(x)
        at = min(len(x) - 1, int(len(x) * min(0.9999, max(0.5, normal_cdf(sigma)))))
        self.t2_limit, self.spe_limit = float(np.sort(t2)[at]), float(np.sort(spe)[at])

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """T², squared prediction error, and share of each variable in the residual."""
        z = (x - self.mean) / self.sd
        s = z @ self.axes
        used = self.value > 1e-10
        residual = np.abs(z - s @ self.axes.T)
        return ((s[:, used] ** 2) / self.value[used]).sum(axis=1), (residual**2).sum(axis=1), residual / np.maximum(residual.sum(axis=1, keepdims=True), 1e-300)

    def rebuilt(self, x: np.ndarray) -> np.ndarray:
        """The values that the components alone give."""
        return ((x - self.mean) / self.sd) @ self.axes @ self.axes.T * self.sd + self.mean


class PcaFold(Fold):
    """Trains once on the first max(10, window / 2) records; then T² and SPE against their limits (t2, spe or combined), and the variables that contribute a tenth or more, three at most: share, index, original and reconstructed value."""

    inputs = ("vector",)
    outputs = (field("t2", "double"), field("spe", "double"), field("t2_limit", "double"), field("spe_limit", "double"), field("is_anomaly", "boolean"), field("contributors", "doubles"), field("contributor_index", "longs"), field("original", "doubles"), field("reconstructed", "doubles"), field("top", "long"))

    def __init__(self, window: int = 100, method: str = "t2", share: float = 0.95, sigma: float = 3.0) -> None:
        self.need, self.method, self.share, self.sigma = max(10, window // 2), method, share, sigma
        self.models: dict[tuple, Components] = {}

    def start(self) -> dict:
        return {"rows": []}

    def _model(self, rows: list[list[float]]) -> Components:
        key = tuple(map(tuple, rows))
        if key not in self.models:
            self.models = {key: Components(np.array(rows), self.share, self.sigma)}
        return self.models[key]

    def step(self, state, columns):
        out: dict[str, list] = {f.name: [] for f in self.outputs}
        for v in columns["vector"]:
            row: dict = {}
            if v is not None and len(v) >= 2 and np.isfinite(np.array(v, dtype=np.float64)).all():
                if len(state["rows"]) < self.need:
                    state["rows"] = [*state["rows"], list(v)]
                if len(state["rows"]) >= self.need:
                    m = self._model(state["rows"])
                    t2, spe, part = (a[0] for a in m.apply(np.array([v])))
                    over = {"t2": t2 > m.t2_limit, "spe": spe > m.spe_limit}
                    names = sorted((i for i in range(len(part)) if part[i] >= 0.1), key=lambda i: -part[i])[:3]
                    row = {"t2": float(t2), "spe": float(spe), "t2_limit": m.t2_limit, "spe_limit": m.spe_limit, "is_anomaly": bool(over.get(self.method, over["t2"] or over["spe"])), "contributors": [float(part[i]) for i in names], "contributor_index": [int(i) for i in names], "original": [float(v[i]) for i in names], "reconstructed": [float(x) for x in m.rebuilt(np.array([v], dtype=np.float64))[0][names]], "top": names[0] if names else None}
            for n in out:
                out[n].append(row.get(n))
        return out


def _model_rows(train: DataFrame, keys: list[str], share: float, sigma: float) -> DataFrame:
    """One row of model a series, from its training rows (``vector``, ``__i``), which are a bounded number."""
    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType([*(T.StructField(f"__of_{k}", train.schema[k].dataType) for k in keys), *(T.StructField(f"__{n}", k) for n, k in (("mean", doubles), ("sd", doubles), ("value", doubles), ("axes", T.ArrayType(doubles)), ("t2_limit", T.DoubleType()), ("spe_limit", T.DoubleType())))])

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("__i", "ascending")]).column("vector").to_pylist()
        m = Components(np.array([r for r in rows if len(r) == len(rows[0])], dtype=np.float64), share, sigma)
        made = [[m.mean.tolist()], [m.sd.tolist()], [m.value.tolist()], [m.axes.T.tolist()], [m.t2_limit], [m.spe_limit]]
        return pa.Table.from_arrays([*(table.column(k).slice(0, 1) for k in keys), *(pa.array(v) for v in made)], names=schema.names)

    return train.select(*keys, "__i", "vector").groupBy(*keys).applyInArrow(run, schema)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _judged(rows: DataFrame, method: str) -> DataFrame:
    """The columns of :class:`PcaFold` for rows that carry their series' model, as array expressions."""
    z = F.transform("vector", lambda x, i: (x - F.get("__mean", i)) / F.get("__sd", i))
    rows = rows.withColumn("__z", z).withColumn("__s", F.transform("__axes", lambda a: _dot(F.col("__z"), a)))
    along = F.aggregate(F.zip_with("__s", "__axes", lambda s, a: F.transform(a, lambda x: x * s)), F.transform("__z", lambda _: F.lit(0.0)), lambda t, a: F.zip_with(t, a, lambda x, y: x + y))
    t2 = F.aggregate(F.zip_with("__s", "__value", lambda s, v: F.when(v > 1e-10, s * s / v).otherwise(0.0)), F.lit(0.0), lambda t, x: t + x)
    rows = rows.withColumn("__along", along).withColumn("t2", t2).withColumn("__r", F.zip_with("__z", "__along", lambda x, y: F.abs(x - y)))
    rows = rows.withColumn("spe", _dot(F.col("__r"), F.col("__r"))).withColumn("__total", F.greatest(F.aggregate("__r", F.lit(0.0), lambda t, x: t + x), F.lit(1e-300)))
    over = {"t2": F.col("t2") > F.col("__t2_limit"), "spe": F.col("spe") > F.col("__spe_limit")}
    ranked = F.array_sort(F.filter(F.transform("__r", lambda x, i: F.struct((-x / F.col("__total")).alias("share"), i.cast("long").alias("index"))), lambda c: c["share"] <= -0.1))
    rows = rows.withColumn("__top", F.slice(ranked, 1, 3))
    pick = lambda a: F.transform("__top", lambda c: F.get(a, c["index"].cast("int")))
    rebuilt = F.transform("__along", lambda x, i: x * F.get("__sd", i) + F.get("__mean", i))
    return rows.select(
        "*", F.col("__t2_limit").alias("t2_limit"), F.col("__spe_limit").alias("spe_limit"), over.get(method, over["t2"] | over["spe"]).alias("is_anomaly"),
        F.transform("__top", lambda c: -c["share"]).alias("contributors"), F.transform("__top", lambda c: c["index"]).alias("contributor_index"),
        pick("vector").alias("original"), pick(rebuilt).alias("reconstructed"), F.get("__top", F.lit(0))["index"].alias("top"),
    )


def pca(df: DataFrame, keys: list[str], order: list[str], vector: str, names: list[str] | None = None, bucket: Column | None = None, window: int = 100, method: str = "t2", share: float = 0.95, sigma: float = 3.0) -> DataFrame:
    """The columns of :class:`PcaFold`; with the variables' ``names`` also ``contributor_names``.

    With ``bucket``, which must not fall along the order, no series is one task:
    the model of a series, a few numbers, comes from its first rows and is joined
    to the others.  There a vector of another length than its series' first has
    no result (the fold's rows are of one length).
    """
    rows = df.withColumn("vector", F.col(vector).cast("array<double>"))
    fold = PcaFold(window, method, share, sigma)
    if bucket is None:
        out = ordered(rows, keys, order, fold)
    else:
        outputs = {f.name for f in fold.outputs}
        rows = rows.select(*[c for c in rows.columns if c not in outputs])
        v = F.col("vector")
        usable = F.coalesce((F.size(v) >= 2) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        placed = numbered(rows.where(usable), keys, order, bucket)
        models = _model_rows(placed.where(F.col("__i") < fold.need), keys, share, sigma)
        on = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys]
        told = (F.col("__i") >= fold.need - 1) & (F.size("vector") == F.size("__mean"))
        joined = placed.join(models, on, "left")
        judged = _judged(joined, method)
        found = judged.select(*rows.columns, *[F.when(told, F.col(f.name)).cast(f.dataType).alias(f.name) for f in fold.outputs])
        out = found.unionByName(rows.where(~usable).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fold.outputs]))
    return out.withColumn("contributor_names", F.transform("contributor_index", lambda i: F.get(F.array(*map(F.lit, names)), i.cast("int")))) if names else out


def moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and cross products of the vectors of a table, over all rows: each task adds up its own, Spark adds up the tasks', and d * (d + 1) + 1 numbers are collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                x = np.column_stack([np.ones(len(x)), x])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], names=["cell", "part"])

    cells = df.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "cell long, part double").groupBy("cell").agg(F.sum("part").alias("part")).orderBy("cell").collect()
    if not cells:
        return 0, np.zeros(0), np.zeros((0, 0))
    whole = np.array([r["part"] for r in cells]).reshape(math.isqrt(len(cells)), -1)
    return round(whole[0, 0]), whole[0, 1:], whole[1:, 1:]


def exact_percentile(df: DataFrame, column: str, share: float) -> float | None:
    """Percentile with linear interpolation of all rows; null without a row.

    Approximate bounds around it are found first, rows below them only counted,
    and those between sorted by all tasks, of which two are collected.
    """
    n = df.count()
    if not n:
        return None
    rank = share * (n - 1)
    low, high = df.select(F.percentile_approx(column, F.array(F.lit(max(0.0, share - 0.01)), F.lit(min(1.0, share + 0.01))), 10_000)).first()[0]
    below = df.where(F.col(column) < low).count()
    near = df.where(F.col(column).between(low, high)).select(column).orderBy(column).offset(max(0, int(rank) - below)).limit(2).collect()
    first, last = near[0][0], near[-1][0]
    return first + (last - first) * (rank - int(rank))


def reconstruction_error(df: DataFrame, vector: str, share: float = 0.95) -> DataFrame:
    """Adds ``error`` (mean squared residual of standardised components up to ``share`` of the variance), ``limit`` (its 95th percentile) and ``is_anomaly`` (over it), all fitted on all rows.

    Rows whose vector is null or holds a null or a value that is not finite are
    left out; vectors must be of one length; an empty table gives an empty one.
    """
    good = df.where(F.col(vector).isNotNull() & F.forall(F.col(vector).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    n, sums, products = moments(good, vector)
    if not n:
        return good.select("*", *[F.lit(None).cast(k).alias(c) for c, k in (("error", "double"), ("limit", "double"), ("is_anomaly", "boolean"))])
    mean = sums / n
    covariance = products / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(covariance), 0))
    sd = np.where(sd == 0, 1.0, sd)
    value, axes = np.linalg.eigh(covariance / np.outer(sd, sd))
    value, axes = np.maximum(value[::-1], 0), axes[:, ::-1]
    k = int(np.searchsorted(np.cumsum(value) / max(value.sum(), 1e-300), share - 1e-12) + 1)
    shared = df.sparkSession.sparkContext.broadcast((mean, sd, axes[:, :k]))  # d * (k + 2) numbers

    @F.pandas_udf(T.DoubleType())
    def error(v):
        import pandas as pd

        m, scale, a = shared.value
        z = (np.stack(v.to_numpy()) - m) / scale
        return pd.Series(((z - z @ a @ a.T) ** 2).mean(axis=1))

    scored = good.withColumn("error", error(F.col(vector).cast("array<double>")))
    limit = exact_percentile(scored, "error", 0.95)
    return scored.withColumn("limit", F.lit(limit)).withColumn("is_anomaly", F.col("error") > F.col("limit"))
