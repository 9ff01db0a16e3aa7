"""Readings from loose input: numbers in text, records of sensors, named readings, valid and rejected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text that counts as a number.
STRICT = r"^-?\d*\.?\d+([eE][-+]?\d+)?$"
LENIENT = r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def strict_number(text: Column) -> Column:
    """Text that is a number as a whole (blanks around it aside), else null."""
    t = F.trim(text)
    return F.when(t.rlike(STRICT), t.try_cast("double"))


def lenient_number(text: Column) -> Column:
    """The number that text begins with ("12abc" is 12), else null."""
    return F.nullif(F.regexp_extract(text, LENIENT, 1), F.lit("")).try_cast("double")


def records_to_readings(df: DataFrame, sensors: str = "sensors") -> DataFrame:
    """One row a sensor of a map column: ``series_id``, ``value``; the other columns ride along."""
    rest = [c for c in df.columns if c not in (sensors, "series_id", "value")]
    return df.select(*rest, F.explode(sensors).alias("series_id", "value"))


def named_to_map(readings: Column) -> Column:
    """Array of (name, value) to a map; the last of equal names counts."""
    names = F.array_distinct(F.transform(readings, lambda r: r["name"]))
    last = lambda n: F.element_at(F.filter(readings, lambda r: r["name"] == n), -1)["value"]
    return F.map_from_arrays(names, F.transform(names, last))


def validated(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``valid`` and ``reason`` (null, missing, not finite) of a numeric column."""
    x = F.col(value)
    reason = F.when(x.isNull(), "missing").when(F.isnan(x), "not a number").when(~finite(x), "infinite")
    return df.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def safe_key(name: Column) -> Column:
    """A sensor name fit for a file or state key: other characters become ``_``, 64 at most."""
    return F.substring(F.regexp_replace(name, "[^A-Za-z0-9_.-]", "_"), 1, 64)


def segments(df: DataFrame, keys: list[str], order: list[str], reset: str = "reset", bucket: Column | None = None) -> DataFrame:
    """Adds ``segment``: the number of resets up to a row, its own included.  With it among the keys, a reset starts afresh.

    With ``bucket``, which must not fall along the order, resets are counted by
    bucket first, so no series is one task.
    """
    from pyspark.sql import Window

    one = F.coalesce(F.col(reset).cast("int"), F.lit(0))
    if bucket is None:
        return df.withColumn("segment", F.sum(one).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    rows, both = df.withColumn("__bucket", bucket), [*keys, "__bucket"]
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*both).agg(F.sum(one).alias("__n"))
    offsets = counts.select(*[F.col(k).alias(f"__of_{k}") for k in both], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = rows.withColumn("__r", F.sum(one).over(Window.partitionBy(*both).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    joined = within.join(offsets, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in both], "left")
    return joined.select(*[c for c in df.columns if c != "segment"], (F.col("__r") + F.col("__before")).alias("segment"))


def route(df: DataFrame, condition: str = "is_anomaly") -> tuple[DataFrame, DataFrame]:
    """The two outputs of a detector: normal rows, anomalous rows (null counts as normal)."""
    c = F.coalesce(F.col(condition), F.lit(False))
    return df.where(~c), df.where(c)


def output_topic(df: DataFrame, output: str = "", mode: str = "scalar", column: str = "topic") -> DataFrame:
    """Adds or replaces the topic of a detector's rows.

    scalar: ``output`` where one is set, else the row's own.  multi: as scalar,
    but a row that came without a topic (null or empty) gets none.  batch: the
    row's own, else ``batch-analysis``; ``output`` plays no part.
    """
    if mode not in ("scalar", "multi", "batch"):
        raise ValueError("mode must be scalar, multi or batch")
    own = F.nullif(F.col(column).cast("string"), F.lit("")) if column in df.columns else F.lit(None).cast("string")
    if mode == "batch":
        made = F.coalesce(own, F.lit("batch-analysis"))
    elif mode == "multi":
        made = F.when(own.isNotNull(), F.lit(output) if output else own)
    else:
        made = F.lit(output) if output else own
    return df.withColumn(column, made)


def parse_object(text: Column) -> Column:
    """A JSON object of numbers (or numeric text) to a map of doubles; other values are null."""
    raw = F.from_json(text, "map<string,string>")
    return F.transform_values(raw, lambda _, v: lenient_number(v))
