"""Queries of model versions over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condmon.operators import versions
from condmon.plans.catalogue import R, query, readings


@query(f"""WITH {R}, v AS (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS version, date_trunc('day', ts) + INTERVAL 1 DAY AS valid_from, avg(value) AS mean, coalesce(nullif(stddev_samp(value), 0), 1) AS std FROM r WHERE ts IS NOT NULL GROUP BY ALL)
SELECT series_id, seq, v.version AS model_version, round((value - mean) / std, 4) AS score FROM r ASOF LEFT JOIN v ON r.ts >= v.valid_from""")
def ml_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings standardised by the model of their time: one version a day, trained on that day, valid from the next."""
    rows = readings(spark, sf_dir)
    day = F.date_trunc("day", "ts")
    std = F.coalesce(F.nullif(F.stddev_samp("value"), F.lit(0.0)), F.lit(1.0))
    trained = rows.where("ts is not null").groupBy(day.alias("day")).agg(F.array(F.avg("value"), std).alias("parameters"))
    table = trained.select(F.date_format("day", "yyyy-MM-dd").alias("version"), (F.col("day") + F.expr("INTERVAL 1 DAY")).alias("valid_from"), "parameters")

    def load(version: dict):
        mean, scale = version["parameters"]
        return lambda x: (x - mean) / scale

    found = versions.predict_versions(rows.withColumn("features", F.array("value")), table, load)
    return found.select("series_id", "seq", "model_version", F.round(F.get("prediction", F.lit(0)), 4).alias("score"))
