"""Collecting training datasets: features, labels, validation, statistics, splits, windows, exports."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condmon.functions.chunks import numbered, sliding
from condmon.functions.folds import Fold, field
from condmon.functions.parsing import finite, lenient_number


def features(df: DataFrame, names: list[str], source: str | None = None) -> DataFrame:
    """Adds ``values``: the named columns, or keys of a map or struct column ``source`` (dotted paths reach into structs), as doubles; what can't be read is 0."""
    def one(name: str) -> Column:
        if source is None:
            c = F.col(name)
        elif df.schema[source].dataType.typeName() == "map":
            c = F.col(source)[name]
        else:
            c = F.col(f"{source}.{name}")
        x = lenient_number(c.cast("string"))
        return F.when(finite(x), x).otherwise(0.0)

    return df.withColumn("values", F.array(*[one(n) for n in names]))


def label(df: DataFrame, mode: str, manual: str | None = None, columns: tuple[str, ...] = ("label", "class", "category", "is_anomaly")) -> DataFrame:
    """Adds ``label``: fixed (manual), the first given of the columns (fromMessage), or none."""
    if mode == "manual":
        made = F.lit(manual)
    elif mode == "fromMessage":
        have = [F.col(c).cast("string") for c in columns if c in df.columns]
        made = F.coalesce(*have) if have else F.lit(None).cast("string")
    else:
        made = F.lit(None).cast("string")
    return df.withColumn("label", made)


def severity(df: DataFrame, columns: tuple[str, ...] = ("severity", "fault_severity")) -> DataFrame:
    have = [F.col(c).try_cast("double") for c in columns if c in df.columns]
    return df.withColumn("severity", F.coalesce(*have, F.lit(0.0)))


def rul_label(df: DataFrame, keys: list[str], order: list[str], start: float, unit: str = "samples", bucket: Column | None = None) -> DataFrame:
    """Adds ``label``: the countdown after each sample, 0 at least; units other than samples count elapsed time of ``ts``.

    With ``bucket``, which must not fall along the order, no series is one task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    gone_to = lambda gone: F.greatest(F.lit(0.0), F.lit(float(start)) - gone)
    if unit == "samples":
        if bucket is None:
            return df.withColumn("label", gone_to(F.row_number().over(w).cast("double")))
        return numbered(df, keys, order, bucket).withColumn("label", gone_to((F.col("__i") + 1).cast("double"))).drop("__i")
    ms = F.unix_millis(F.col("ts").cast("timestamp_ltz"))
    per = {"seconds": 1e3, "hours": 3.6e6, "days": 8.64e7}[unit]
    if bucket is None:
        return df.withColumn("label", gone_to((ms - F.first(ms).over(w)) / per))
    first = df.groupBy(*[F.col(k).alias(f"__of_{k}") for k in keys]).agg(F.min_by(F.struct(ms.alias("ms")), F.struct(*order)).getField("ms").alias("__first"))
    joined = df.join(first, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys], "left").select(*df.columns, "__first")
    return joined.withColumn("label", gone_to((ms - F.col("__first")) / per)).drop("__first")


def valid(df: DataFrame, arity: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``values`` are all finite and of the given number; and the others with a ``reason``."""
    v = F.col("values")
    reason = F.when(v.isNull(), "no values").when(F.size(v) != arity, "wrong number of values").when(~F.forall(v, finite), "value not finite")
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def feature_stats(df: DataFrame, names: list[str]) -> DataFrame:
    """(feature, count, mean, std (population), min, max) in one pass."""
    made = {"count": F.count, "mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    each = [F.struct(F.lit(n).alias("feature"), *[f(F.get("values", F.lit(i))).alias(k) for k, f in made.items()]) for i, n in enumerate(names)]
    return df.agg(F.array(*each).alias("z")).select(F.explode("z").alias("z")).select("z.*")


def label_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce(F.col("label").cast("string"), F.lit("unlabeled")).alias("label")).count()


def portable_hash(id_col: Column, seed: int) -> Column:
    """A number below 2**32 that SQL engines compute alike."""
    return F.pmod((id_col + F.lit(seed)) * F.lit(2654435761), F.lit(1 << 32))


#: Ranges of hashes at most into which rows are counted for a split.
SPLIT_BUCKETS = 1 << 20


def split(df: DataFrame, id_col: str, train: float = 0.7, validation: float = 0.15, seed: int = 0, bucket_rows: int = 20_000) -> DataFrame:
    """Adds ``split``: floor(n * train) rows, floor(n * validation) rows, the rest test, in a seeded order.

    Exact sizes without one sorted partition: rows are counted by hash range
    (about ``bucket_rows`` each, SPLIT_BUCKETS ranges at most, so that the
    counts that are broadcast are a million rows of three numbers; beyond, ranges
    grow) first, and row numbers within a range continue those counts.
    """
    buckets = max(1, min(SPLIT_BUCKETS, -(-df.count() // bucket_rows)))
    h = portable_hash(F.col(id_col), seed)
    rows = df.withColumn("__h", h).withColumn("__b", F.floor(F.col("__h") * buckets / (1 << 32)))
    counts = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as buckets
    whole = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select("__b", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias("__all"))
    placed = rows.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy("__h", id_col))).join(F.broadcast(offsets), "__b")
    at = F.col("__r") + F.col("__before")
    a, b = F.floor(F.col("__all") * F.lit(train)), F.floor(F.col("__all") * F.lit(validation))
    return placed.withColumn("split", F.when(at <= a, "train").when(at <= a + b, "validation").otherwise("test")).drop("__h", "__b", "__r", "__before", "__all")


def group_split(df: DataFrame, group: str, share: float = 0.8, seed: int = 0) -> DataFrame:
    """Adds ``split`` by group, so that no unit is in both parts."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(group)), F.lit(10_000)) / 10_000
    return df.withColumn("split", F.when(u < share, "train").otherwise("test"))


def windows(df: DataFrame, keys: list[str], order: list[str], size: int, overlap_percent: float = 0.0, column: str = "values", bucket: Column | None = None, chunk: int = 1_000_000) -> DataFrame:
    """Full windows of ``size`` rows every floor(size * (1 - overlap)) rows (one at least): ``window`` (array of rows), ``label`` of the last row.

    With ``bucket``, which must not fall along the order, long series are cut
    into chunks; a row is copied only into the windows that are kept.
    """
    slide = max(1, int(size * (1 - overlap_percent / 100)))
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        made = df.withColumn("__n", F.row_number().over(w)).withColumn("window", F.collect_list(column).over(w.rowsBetween(-(size - 1), 0)))
        return made.where((F.col("__n") >= size) & ((F.col("__n") - size) % slide == 0)).drop("__n", column)

    def listed(d: DataFrame, k: list[str]) -> DataFrame:
        w = Window.partitionBy(*k).orderBy(*order).rowsBetween(-(size - 1), 0)
        return d.withColumn("window", F.collect_list(column).over(w))

    made = sliding(df, keys, order, bucket, size, listed, chunk, number=True)
    return made.where((F.col("__i") + 1 >= size) & ((F.col("__i") + 1 - size) % slide == 0)).drop("__i", column)


def sequences(df: DataFrame, unit: str, order: list[str], size: int = 30, column: str = "values", bucket: Column | None = None, chunk: int = 1_000_000) -> DataFrame:
    """Adds ``sequence``: the ``size`` rows before each row of its unit, where there are as many.  With ``bucket`` long units are cut into chunks."""

    def listed(d: DataFrame, k: list[str]) -> DataFrame:
        return d.withColumn("sequence", F.collect_list(column).over(Window.partitionBy(*k).orderBy(*order).rowsBetween(-size, -1)))

    made = listed(df, [unit]) if bucket is None else sliding(df, [unit], order, bucket, size + 1, listed, chunk)
    return made.where(F.size("sequence") == size)


def scaler(df: DataFrame, names: list[str]) -> DataFrame:
    """(feature, mean, scale, var) with population variance; a scale of 0 is 1."""
    s = feature_stats(df, names)
    return s.select("feature", "mean", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")).alias("scale"), (F.col("std") * F.col("std")).alias("var"))


# Exports ---------------------------------------------------------------------


def safe_name(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_-]", "_", name)[:100] or "dataset"


def timestamp(ts: Column, style: str) -> Column:
    """ISO text, unix seconds or unix milliseconds."""
    t = ts.cast("timestamp_ltz")
    if style == "unix":
        return F.unix_seconds(t)
    if style == "unix_ms":
        return F.unix_millis(t)
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def to_csv(df: DataFrame, path: str, names: list[str], compression: str = "none", style: str = "iso") -> None:
    """Timestamp, one column a feature, label and severity; written by all tasks."""
    cells = [F.col("values")[i].alias(n) for i, n in enumerate(names)]
    df.select(timestamp(F.col("ts"), style).alias("timestamp"), *cells, "label", "severity").write.option("header", True).option("compression", compression).csv(path)


def to_jsonl(df: DataFrame, path: str, style: str = "iso", compression: str = "none") -> None:
    """One object a line; null labels and zero severities are left out."""
    some = F.nullif(F.col("severity"), F.lit(0.0)).alias("severity")
    df.select(F.col("values").alias("features"), timestamp(F.col("ts"), style).alias("timestamp"), "label", some).write.option("ignoreNullFields", True).option("compression", compression).json(path)


def document(df: DataFrame, name: str, names: list[str]) -> str:
    """The whole dataset as one JSON document.  For small datasets: it is built on the driver; larger ones go to :func:`to_jsonl`."""
    rows = df.select("values", "label", "severity").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("over 100000 rows: export as JSON lines instead")
    classes = sorted({str(r["label"]) for r in rows if r["label"] is not None})
    info = {"name": name, "samples": len(rows), "features": names, "classes": classes, "featureDimension": len(names)}
    return json.dumps({"datasetInfo": info, "data": [{"x": r["values"], "y": r["label"], "severity": r["severity"]} for r in rows]})


def metadata(df: DataFrame, name: str, names: list[str]) -> dict:
    """Dataset description: number of samples, feature statistics, and ``labels``, a table of all labels and their counts."""
    features_ = {r["feature"]: {k: r[k] for k in ("count", "mean", "std", "min", "max")} for r in feature_stats(df, names).collect()}
    return {"datasetInfo": {"name": name, "samples": df.count()}, "features": {"names": names, "statistics": features_}, "labels": label_counts(df)}


def collector(path: str, names: list[str], fmt: str = "json"):
    """A ``foreachBatch`` writer: each micro-batch's valid rows are appended under the batch's id, so a replayed batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        good, _ = valid(batch, len(names))
        good.write.mode("overwrite").format(fmt).save(f"{path}/batch={batch_id}")

    return write


#: What a control row may ask of a collector.
ACTIONS = ("save", "export", "clear", "stats", "pause", "resume", "resetRul")


class Collector(Fold):
    """Buffer policy of a collector: rows of ``values`` and ``label`` are samples, rows with an ``action`` control.

    ``save`` and ``export`` hand on the buffer (and clear it, with
    ``clear_exported``), ``clear`` forgets samples, count and countdown,
    ``pause`` and ``resume`` stop and go on taking samples, ``stats`` reports,
    ``resetRul`` sets the countdown to ``rul_value`` or its start.  With
    ``autosave`` a buffer of ``size`` is handed on and cleared; without, the
    oldest go over twice the size.  With ``rul_start`` labels are the countdown
    after each sample.  Samples with missing or infinite values, or another
    number of them than the first, are not taken and counted in ``rejected``.

    ``event`` names what a row did (null: nothing but buffering), ``exported``
    and ``labels`` are handed on, ``samples`` are in the buffer after (at an
    export: in it), ``collected`` since the last clear.
    """

    inputs = ("values", "label", "action", "rul_value")
    outputs = (field("event", "string"), field("exported", "vectors"), field("labels", "strings"), field("samples", "long"), field("collected", "long"), field("dropped", "long"), field("rejected", "long"))

    def __init__(self, size: int = 1000, autosave: bool = False, clear_exported: bool = False, rul_start: float | None = None) -> None:
        self.size, self.autosave, self.clear_exported, self.rul_start = size, autosave, clear_exported, rul_start

    def start(self) -> dict:
        return {"buffer": [], "labels": [], "paused": False, "collected": 0, "dropped": 0, "rejected": 0, "arity": None, "rul": self.rul_start}

    def _export(self, state: dict, clear: bool) -> tuple:
        made = "export", list(state["buffer"]) or None, list(state["labels"]) if state["buffer"] else None, len(state["buffer"])
        if clear:
            state["buffer"], state["labels"] = [], []
        return made

    def _control(self, state: dict, action: str, rul_value: float | None) -> tuple:
        if action in ("save", "export"):
            return self._export(state, self.clear_exported)
        if action == "clear":
            state.update(buffer=[], labels=[], collected=0, rul=self.rul_start)
        elif action in ("pause", "resume"):
            state["paused"] = action == "pause"
        elif action == "resetRul":
            state["rul"] = self.rul_start if rul_value is None else rul_value
        return (action if action in ACTIONS else "unknown"), None, None, len(state["buffer"])

    def _sample(self, state: dict, values: list | None, label: str | None) -> tuple | None:
        if state["paused"]:
            return None
        if not values or any(x is None or not math.isfinite(x) for x in values) or len(values) != (state["arity"] or len(values)):
            state["rejected"] += 1
            return None
        state["arity"] = len(values)
        if self.rul_start is not None:
            state["rul"] = max(0.0, state["rul"] - 1)
            label = repr(float(state["rul"]))
        state["buffer"].append(list(values))
        state["labels"].append(label)
        state["collected"] += 1
        if self.autosave and len(state["buffer"]) >= self.size:
            return self._export(state, True)
        over = len(state["buffer"]) - 2 * self.size
        if over > 0:
            state["buffer"], state["labels"] = state["buffer"][over:], state["labels"][over:]
            state["dropped"] += over
        return None

    def step(self, state, columns):
        out = []
        for values, label, action, rul_value in zip(*[columns[c] for c in self.inputs], strict=True):
            made = self._control(state, action, rul_value) if action is not None else self._sample(state, values, label)
            made = made or (None, None, None, len(state["buffer"]))
            out.append((*made, state["collected"], state["dropped"], state["rejected"]))
        return {f.name: [o[k] for o in out] for k, f in enumerate(self.outputs)}


def controlled(samples: DataFrame, controls: DataFrame) -> DataFrame:
    """Samples and control rows as one input of :class:`Collector` or :class:`condmon.operators.analyst.Triggered`; columns that one side lacks are null."""
    return samples.unionByName(controls, allowMissingColumns=True)
