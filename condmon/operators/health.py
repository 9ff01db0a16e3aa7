"""Health index from per-sensor assessments: expressions and aggregates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condmon.config import HealthSettings


def _given(c: str, kind: str) -> Column:
    return F.col(c).cast(kind)


def penalties() -> list[tuple[Column, str, int]]:
    """(condition, reason, points) of each penalty on an assessment row."""
    z, d = F.abs(_given("z_score", "double")), F.abs(_given("deviation_percent", "double"))
    rising = (F.col("trend") == "increasing") & (_given("slope", "double") > 0)
    return [
        (_given("is_anomaly", "boolean"), "anomaly detected", 30),
        (z > 3, "high z-score", 40),
        ((z > 2) & (z <= 3), "elevated z-score", 20),
        (d > 30, "large deviation", 30),
        ((d > 15) & (d <= 30), "moderate deviation", 15),
        (rising, "rising trend", 10),
    ]


def sensor_scores(df: DataFrame) -> DataFrame:
    """Adds ``score`` (0 to 100) and ``factors`` (reason, impact) to assessment rows (is_anomaly, z_score, deviation_percent, trend, slope, confidence).

    Under a confidence of 0.5 part of the loss is given back, in proportion.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    lost = sum((F.when(yes(c), F.lit(p)).otherwise(0) for c, _, p in penalties()), F.lit(0))
    base = F.lit(100) - lost
    c = _given("confidence", "double")
    back = F.when(c < 0.5, F.floor((100 - base) * (1 - c / 0.5) * 0.5 + 0.5)).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(100), base + F.coalesce(back, F.lit(0)))).cast("double")
    factor = lambda c, reason, p: F.when(yes(c), F.struct(F.lit(reason).alias("reason"), F.lit(-p).alias("impact")))
    return df.withColumn("score", score).withColumn("factors", F.array_compact(F.array(*[factor(*p) for p in penalties()])))


def status(score: Column, s: HealthSettings) -> Column:
    return F.when(score < s.critical, "critical").when(score < s.degraded, "degraded").when(score < s.warning, "warning").when(score < s.attention, "attention").otherwise("healthy")


def weight_of(sensor: Column, s: HealthSettings) -> Column:
    """The sensor's weight; a missing one, and 0, count as 1."""
    given = [F.when(sensor == n, F.lit(float(w))) for n, w in s.weights]
    w = F.coalesce(*given, F.lit(1.0)) if given else F.lit(1.0)
    return F.when(w == 0, F.lit(1.0)).otherwise(w)


def dynamic_weights(df: DataFrame, entity: str, order: list[str], s: HealthSettings) -> DataFrame:
    """Adds ``weight``: lowered for a frequent alarm (rate over 0.3 of at least 10), an erratic sensor (coefficient of variation over 0.5 of its last 50 values) and low confidence, by a factor within 0.1 and 1."""
    upto = Window.partitionBy(entity, "sensor").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = Window.partitionBy(entity, "sensor").orderBy(*order).rowsBetween(-49, 0)
    seen = F.count(F.lit(1)).over(upto)
    rate = F.count_if(F.coalesce("is_anomaly", F.lit(False))).over(upto) / seen
    m = F.avg("value").over(last)
    cv = F.stddev_pop("value").over(last) / F.nullif(F.abs(m), F.lit(0.0))
    alarm = F.when((seen >= 10) & (rate > 0.3), 1 - (rate - 0.3)).otherwise(1.0)
    erratic = F.when((F.count("value").over(last) >= 10) & (cv > 0.5), F.greatest(F.lit(0.5), 1 - (cv - 0.5))).otherwise(1.0)
    factor = alarm * erratic * F.coalesce(_given("confidence", "double"), F.lit(1.0))
    return df.withColumn("weight", weight_of(F.col("sensor"), s) * F.greatest(F.lit(0.1), F.least(F.lit(1.0), factor)))


def index(scored: DataFrame, keys: list[str], s: HealthSettings) -> DataFrame:
    """One row a record: ``health`` by the aggregation (weighted, minimum, average, geometric; unknown 0; no sensors 100), ``status``, ``is_bad``, ``worst_sensor`` (lowest under 100, ties by name, else null).

    A ``weight`` column, where present, is used instead of the settings' weights.
    """
    x = F.col("score")
    w = F.col("weight") if "weight" in scored.columns else weight_of(F.col("sensor"), s)
    made = {
        "weighted": F.sum(x * w) / F.sum(F.when(x.isNotNull(), w)),
        "minimum": F.min(x),
        "average": F.avg(x),
        "geometric": F.when(F.min(x) <= 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.ln(F.greatest(x, F.lit(1e-300)))))),
    }.get(s.aggregation, F.lit(0.0))
    lowest = F.min_by(F.when(x < 100, F.col("sensor")), F.when(x < 100, F.struct(x, F.col("sensor"))))
    out = scored.groupBy(*keys).agg(F.coalesce(made, F.lit(100.0)).alias("health"), lowest.alias("worst_sensor"), F.count(x).alias("sensors"))
    out = out.withColumn("status", status(F.col("health"), s))
    return out.withColumn("is_bad", F.col("status").isin("critical", "degraded", "warning"))


def rescale(health: Column, unit: bool) -> Column:
    """0 to 1 instead of 0 to 100."""
    return health / 100 if unit else health


def trend(df: DataFrame, entity: str, order: list[str], health: str = "health") -> DataFrame:
    """Adds ``health_trend`` over the last ten scores: the later half's mean more than 2 above or below the earlier half's; unknown under three."""
    w = Window.partitionBy(entity).orderBy(*order).rowsBetween(-9, 0)
    h = F.col("__h")
    half = F.floor(F.size(h) / 2).cast("int")
    avg = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(a), F.lit(0))
    change = avg(F.slice(h, half + 1, F.size(h) - half)) - avg(F.slice(h, F.lit(1), half))
    label = F.when(F.size(h) < 3, "unknown").when(change > 2, "improving").when(change < -2, "degrading").otherwise("stable")
    return df.withColumn("__h", F.collect_list(F.col(health).cast("double")).over(w)).withColumn("health_trend", label).drop("__h")
