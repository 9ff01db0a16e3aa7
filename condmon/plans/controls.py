"""Queries of control rows and output shaping: triggers of batches, a collector's buffer policy, topics, over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condmon.config import AnomalySettings
from condmon.functions.folds import ordered
from condmon.functions.parsing import output_topic, route
from condmon.operators import analyst, anomaly, dataset
from condmon.plans.catalogue import KEYS, ORDER, R, _day, query, readings


@query(f"""WITH {R}, f AS (SELECT *, seq % 37 = 0 AS flush FROM r), g AS (SELECT *, coalesce(sum(CASE WHEN flush THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lot FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY series_id, lot ORDER BY ts DESC, seq DESC) AS back, bool_or(flush) OVER (PARTITION BY series_id, lot) AS fired FROM g)
SELECT series_id, max(seq) FILTER (flush) AS seq, 'manual' AS kind, count(*) FILTER (back <= 24) AS count, round(avg(value) FILTER (back <= 24), 6) AS mean, count(*) FILTER (back > 24) AS dropped FROM k WHERE fired GROUP BY series_id, lot""")
def ll_triggered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buffers of the newest 24 readings, handed on where a row asks for it."""
    rows = readings(spark, sf_dir).withColumn("flush", F.col("seq") % 37 == 0)
    out = analyst.triggered(rows, KEYS, ORDER, analyst.Triggered("manual", cap=24), bucket=_day())
    mean = F.aggregate("fired", F.lit(0.0), lambda a, x: a + x) / F.size("fired")
    return out.select("series_id", "seq", "kind", F.size("fired").cast("long").alias("count"), F.round(mean, 6).alias("mean"), "dropped")


ACTS = "CASE WHEN seq % 101 = 0 THEN 'pause' WHEN seq % 101 = 17 THEN 'resume' WHEN seq % 53 = 5 THEN 'export' WHEN seq % 211 = 3 THEN 'clear' END"


@query(f"""WITH {R}, a AS (SELECT *, {ACTS} AS action FROM r),
p AS (SELECT *, coalesce(last_value(CASE WHEN action IN ('pause', 'resume') THEN action = 'pause' END IGNORE NULLS) OVER w, false) AS paused, sum(CASE WHEN action = 'clear' THEN 1 ELSE 0 END) OVER w AS life FROM a WINDOW w AS (PARTITION BY series_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
n AS (SELECT *, count(*) FILTER (action IS NULL AND NOT paused) OVER (PARTITION BY series_id, life ORDER BY ts, seq) AS taken FROM p),
e AS (SELECT series_id, life, seq, taken FROM n WHERE action = 'export' AND taken > 0),
s AS (SELECT e.series_id, e.seq, count(*) AS held, round(sum(n.value), 4) AS total FROM e JOIN n ON n.series_id = e.series_id AND n.life = e.life AND n.action IS NULL AND NOT n.paused AND n.taken <= e.taken AND n.taken > e.taken - 40 GROUP BY ALL)
SELECT n.series_id, n.seq, action AS event, CAST(least(taken, 40) AS BIGINT) AS samples, taken AS collected, s.total FROM n LEFT JOIN s USING (series_id, seq) WHERE action IS NOT NULL""")
def td_collector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collector of 20 samples without autosave, with control rows that pause, resume, export and clear."""
    action = F.expr(ACTS)
    rows = readings(spark, sf_dir).withColumn("action", action)
    sample = F.when(F.col("action").isNull(), F.array("value"))
    rows = rows.withColumns({"values": sample, "label": F.lit(None).cast("string"), "rul_value": F.lit(None).cast("double")})
    out = ordered(rows, KEYS, ORDER, dataset.Collector(size=20)).where("event is not null")
    total = F.aggregate("exported", F.lit(0.0), lambda a, v: a + v[0])
    return out.select("series_id", "seq", "event", "samples", "collected", F.round(total, 4).alias("total"))


@query("""WITH t AS (SELECT event_type AS series_id, event_id AS seq, CASE WHEN event_id % 3 > 0 THEN 'plant/' || event_type END AS topic,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) >= 2 AND (value < 2 OR value > 54) AS odd FROM events)
SELECT series_id, seq, CASE WHEN odd THEN 'alarms' ELSE topic END AS scalar, CASE WHEN topic IS NOT NULL THEN CASE WHEN odd THEN 'alarms' ELSE topic END END AS multi, coalesce(topic, 'batch-analysis') AS batch FROM t""")
def ad_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of detected rows: anomalies go to a topic of their own, in the three ways that the modes have."""
    own = F.when(F.col("seq") % 3 > 0, F.concat(F.lit("plant/"), F.col("series_id")))
    s = AnomalySettings(method="threshold", min_threshold=2.0, max_threshold=54.0, margin_percent=0.0, hysteresis=False)
    rows = anomaly.detect(readings(spark, sf_dir).withColumn("topic", own), s, KEYS, ORDER, bucket=_day())
    normal, odd = route(rows)

    def shaped(d: DataFrame, output: str) -> DataFrame:
        for mode in ("scalar", "multi", "batch"):
            d = output_topic(d.withColumn(mode, F.col("topic")), output, mode, mode)
        return d.select("series_id", "seq", "scalar", "multi", "batch")

    return shaped(normal, "").unionByName(shaped(odd, "alarms"))
