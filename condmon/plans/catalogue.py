"""Registered queries over the driver's tables, each with its SQL where SQL can say it.

``events`` by type stand in for sensor series, ``orders`` by day and segment for
trends, ``lineitem`` for records of several values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condmon.config import AnomalySettings, HealthSettings, SignalSettings, TrendSettings
from condmon.functions import stats
from condmon.functions.chunks import framed
from condmon.operators import analyst, anomaly, dataset, features, health, inference, multivalue, multivariate, signal, trend, vision

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KEYS, ORDER = ["series_id"], ["ts", "seq"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as readings: (series_id, ts, seq, value)."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), "ts", F.col("event_id").alias("seq"), "value")


def _day():
    """Never falls along the order: rolling detectors cut long series by it."""
    return F.date_trunc("day", "ts")


def _year():
    """The same for series of days."""
    return F.year("day")


def _range():
    """The same for series ordered by order number."""
    return F.floor(F.col("ts") / 100_000)


def _r(c: str, n: int = 6):
    """Rounded, without a negative zero."""
    return (F.round(c, n) + F.lit(0.0)).alias(c)


R = "r AS (SELECT event_type AS series_id, ts, event_id AS seq, value FROM events)"
W = "PARTITION BY series_id ORDER BY ts, seq ROWS BETWEEN {n} PRECEDING AND CURRENT ROW"


def _w(rows: int) -> str:
    return W.format(n=rows - 1)


# Anomaly detection -----------------------------------------------------------

ZSCORE = f"""
WITH {R}, b AS (SELECT *, count(*) OVER w AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM r WINDOW w AS ({_w(100)})),
z AS (SELECT *, CASE WHEN sd = 0 THEN 0.0 ELSE (value - m) / sd END AS z FROM b),
v AS (SELECT *, CASE WHEN n < 2 THEN NULL WHEN abs(z) > {{high}} THEN 'critical' WHEN abs(z) > {{low}} THEN 'warning' ELSE 'normal' END AS severity FROM z)"""


@query(ZSCORE.format(high=3.0, low=2.0) + " SELECT series_id, seq, round(z, 6) AS score, severity, severity <> 'normal' AS raw_anomaly FROM v")
def ad_zscore_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = anomaly.detect(readings(spark, sf_dir), AnomalySettings(hysteresis=False), KEYS, ORDER, bucket=_day())
    return out.select("series_id", "seq", _r("score"), "severity", "raw_anomaly")


@query(f"""
WITH {R}, b AS (SELECT *, list(value) OVER ({_w(100)}) AS l FROM r),
q AS (SELECT *, len(l) AS n, list_sort(l)[CAST(floor(len(l) * 0.25) AS INTEGER) + 1] AS q1, list_sort(l)[CAST(floor(len(l) * 0.75) AS INTEGER) + 1] AS q3 FROM b)
SELECT series_id, seq, CASE WHEN n < 4 THEN NULL WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 'critical'
  WHEN value < q1 - 0.8 * 1.5 * (q3 - q1) OR value > q3 + 0.8 * 1.5 * (q3 - q1) THEN 'warning' ELSE 'normal' END AS severity FROM q""")
def ad_iqr_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.detect(readings(spark, sf_dir), AnomalySettings(method="iqr", hysteresis=False), KEYS, ORDER, bucket=_day()).select("series_id", "seq", "severity")


@query("""
SELECT event_type AS series_id, event_id AS seq, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) < 2 THEN NULL
  WHEN value < 2 OR value > 60 THEN 'critical' WHEN value < 2.2 OR value > 54 THEN 'warning' ELSE 'normal' END AS severity FROM events""")
def ad_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = AnomalySettings(method="threshold", min_threshold=2.0, max_threshold=60.0, hysteresis=False)
    return anomaly.detect(readings(spark, sf_dir), s, KEYS, ORDER, bucket=_day()).select("series_id", "seq", "severity")


@query(f"""
WITH {R}, b AS (SELECT *, count(*) OVER w AS n, quantile_cont(value, [0.05, 0.95]) OVER w AS p FROM r WINDOW w AS ({_w(100)}))
SELECT series_id, seq, CASE WHEN n < 2 THEN NULL WHEN value < p[1] OR value > p[2] THEN 'critical' ELSE 'normal' END AS severity FROM b""")
def ad_percentile_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.detect(readings(spark, sf_dir), AnomalySettings(method="percentile", hysteresis=False), KEYS, ORDER, bucket=_day()).select("series_id", "seq", "severity")


@query(ZSCORE.format(high=2.0, low=1.5) + " SELECT series_id, seq, round(abs(z), 6) AS score, severity FROM v")
def ad_moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = anomaly.detect(readings(spark, sf_dir), AnomalySettings(method="moving_average", hysteresis=False), KEYS, ORDER, bucket=_day())
    return out.select("series_id", "seq", _r("score"), "severity")


@query(ZSCORE.format(high=3.0, low=2.0) + """,
raw AS (SELECT *, severity IS NOT NULL AND severity <> 'normal' AS raw FROM v),
t AS (SELECT *, CASE WHEN severity IS NOT NULL AND raw <> lag(raw, 1, false) OVER (PARTITION BY series_id ORDER BY ts, seq) THEN 1 ELSE 0 END AS turn FROM raw),
g AS (SELECT *, sum(turn) OVER (PARTITION BY series_id ORDER BY ts, seq) AS run FROM t),
l AS (SELECT *, count(severity) OVER (PARTITION BY series_id, run ORDER BY ts, seq) AS len FROM g),
e AS (SELECT *, CASE WHEN raw AND len >= 1 THEN true WHEN NOT raw AND severity IS NOT NULL AND len >= 2 THEN false END AS event FROM l)
SELECT series_id, seq, severity, CASE WHEN severity IS NOT NULL THEN coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), false) END AS is_anomaly FROM e""")
def ad_zscore_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.detect(readings(spark, sf_dir), AnomalySettings(), KEYS, ORDER, bucket=_day()).select("series_id", "seq", "severity", "is_anomaly")


@query(f"""
WITH RECURSIVE {R}, b AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts, seq) AS i, coalesce(stddev_pop(value) OVER ({_w(100)}), 0) AS sd FROM r),
f AS (SELECT series_id, i, value AS ema FROM b WHERE i = 2 UNION ALL SELECT b.series_id, b.i, 0.3 * b.value + 0.7 * f.ema FROM f JOIN b ON b.series_id = f.series_id AND b.i = f.i + 1),
m AS (SELECT b.*, f.ema, CASE WHEN f.ema IS NULL OR sd = 0 THEN 0.0 ELSE abs(value - f.ema) / sd END AS score FROM b LEFT JOIN f USING (series_id, i))
SELECT series_id, seq, round(ema, 6) AS ema, round(score, 6) AS score, CASE WHEN i < 2 THEN NULL WHEN score > 2.0 THEN 'critical' WHEN score > 1.5 THEN 'warning' ELSE 'normal' END AS severity FROM m""")
def ad_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = anomaly.detect(readings(spark, sf_dir), AnomalySettings(method="ema", hysteresis=False), KEYS, ORDER, bucket=_day())
    return out.select("series_id", "seq", _r("ema"), _r("score"), "severity")


@query(f"""
WITH RECURSIVE {R}, b AS (SELECT series_id, seq, row_number() OVER (PARTITION BY series_id ORDER BY ts, seq) AS i, value - 10 AS d FROM r),
f AS (SELECT series_id, i, CAST(NULL AS DOUBLE) AS top, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS down FROM b WHERE i = 1
  UNION ALL SELECT n.series_id, n.i, greatest(n.u, n.w), CASE WHEN greatest(n.u, n.w) > 50 THEN 0 ELSE n.u END, CASE WHEN greatest(n.u, n.w) > 50 THEN 0 ELSE n.w END
  FROM (SELECT b.series_id, b.i, greatest(0, f.up + b.d - 0.5) AS u, greatest(0, f.down - b.d - 0.5) AS w FROM f JOIN b ON b.series_id = f.series_id AND b.i = f.i + 1) n)
SELECT b.series_id, b.seq, round(f.top, 6) AS score, CASE WHEN b.i < 2 THEN NULL WHEN f.top > 50 THEN 'critical' WHEN f.top > 35 THEN 'warning' ELSE 'normal' END AS severity FROM b JOIN f USING (series_id, i)""")
def ad_cusum(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = AnomalySettings(method="cusum", cusum_target=10.0, cusum_threshold=50.0, cusum_warning=35.0, hysteresis=False)
    return anomaly.detect(readings(spark, sf_dir), s, KEYS, ORDER, bucket=_day()).select("series_id", "seq", _r("score"), "severity")


@query(ZSCORE.format(high=3.0, low=0.67 * 3.0) + """
SELECT series_id, count(*) AS total, count(*) FILTER (severity <> 'normal') AS anomalies, count(*) FILTER (severity = 'warning') AS warnings,
  count(*) FILTER (severity = 'normal' OR severity IS NULL) AS normal, round(count(*) FILTER (severity <> 'normal') / count(*), 6) AS anomaly_rate, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, min(value) AS min, max(value) AS max FROM v GROUP BY series_id""")
def ad_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = anomaly.summary(anomaly.detect_batch(readings(spark, sf_dir), AnomalySettings(), KEYS, ORDER, bucket=_day()), KEYS)
    return out.select("series_id", "total", "anomalies", "warnings", "normal", _r("anomaly_rate"), _r("mean"), _r("sd"), "min", "max")


#: Order numbers and lines repeat within a supplier; the part and its price make the order of records total.
RECORD_ORDER = ["ts", "seq", "part", "price"]
SENSORS = """l AS (SELECT l_suppkey AS entity_id, l_orderkey AS ts, l_linenumber AS seq, l_partkey AS part, l_extendedprice AS price, CAST(l_quantity AS DOUBLE) AS a, CAST(l_extendedprice AS DOUBLE) AS b, CAST(l_discount AS DOUBLE) AS c FROM lineitem),
v AS (SELECT entity_id, ts, seq, part, price, unnest([{'sensor': 'quantity', 'value': a}, {'sensor': 'price', 'value': b}, {'sensor': 'discount', 'value': c}], recursive := true) FROM l),
w AS (SELECT *, row_number() OVER o AS i, count(*) OVER w AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM v
  WINDOW o AS (PARTITION BY entity_id, sensor ORDER BY ts, seq, part, price), w AS (PARTITION BY entity_id, sensor ORDER BY ts, seq, part, price ROWS 99 PRECEDING)),
z AS MATERIALIZED (SELECT *, CASE WHEN n < 2 THEN NULL WHEN sd = 0 THEN 'normal' WHEN abs((value - m) / sd) > 3 THEN 'critical' WHEN abs((value - m) / sd) > 2 THEN 'warning' ELSE 'normal' END AS level FROM w)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by supplier as records of three sensors."""
    d = table(spark, sf_dir, "lineitem")
    sensors = F.struct(F.col("l_quantity").cast("double").alias("quantity"), F.col("l_extendedprice").cast("double").alias("price"), F.col("l_discount").cast("double").alias("discount"))
    return d.select(F.col("l_suppkey").alias("entity_id"), F.col("l_orderkey").alias("ts"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("price"), sensors.alias("sensors"))


@query(f"""WITH RECURSIVE {SENSORS},
f AS (SELECT entity_id, sensor, i, 0 AS a, 0 AS c, false AS up, CAST(NULL AS BOOLEAN) AS final, CAST('warmup' AS VARCHAR) AS severity FROM z WHERE i = 1
  UNION ALL SELECT entity_id, sensor, i, CASE WHEN raw THEN a + 1 WHEN up AND c + 1 >= 3 THEN 0 ELSE a END, CASE WHEN raw THEN 0 ELSE c + 1 END, CASE WHEN raw THEN a + 1 >= 2 ELSE up AND c + 1 < 3 END, CASE WHEN raw THEN a + 1 >= 2 ELSE up AND c + 1 < 3 END,
    CASE WHEN raw AND a + 1 >= 2 THEN level WHEN NOT raw AND up AND c + 1 < 3 THEN 'warning' ELSE 'normal' END
  FROM (SELECT z.entity_id, z.sensor, z.i, f.a, f.c, f.up, z.level, z.level <> 'normal' AS raw FROM f JOIN z ON z.entity_id = f.entity_id AND z.sensor = f.sensor AND z.i = f.i + 1))
SELECT entity_id, ts, seq, part, price, coalesce(bool_or(final), false) AS is_anomaly,
  CASE max(CASE WHEN NOT coalesce(final, false) THEN 0 WHEN severity = 'critical' THEN 2 WHEN severity = 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'normal' END AS severity,
  coalesce(string_agg(sensor, ',' ORDER BY sensor) FILTER (final), '') AS anomaly_sensors, 0 AS skipped FROM f JOIN z USING (entity_id, sensor, i) GROUP BY ALL""")
def ad_multi_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-sensor mode with its own hysteresis; one row a record.  Long series are cut by ranges of order numbers."""
    out = anomaly.detect_sensors(records(spark, sf_dir), AnomalySettings(consecutive=2), "entity_id", RECORD_ORDER, bucket=_range())[1]
    return out.select("entity_id", *RECORD_ORDER, "is_anomaly", "severity", F.array_join("anomaly_sensors", ",").alias("anomaly_sensors"), F.size("skipped_sensors").alias("skipped"))


@query(f"""WITH RECURSIVE {R},
b AS (SELECT *, value > 30 AS said, value > 50 AS was, row_number() OVER (PARTITION BY series_id ORDER BY ts, seq) AS i FROM r WHERE seq % 10 = 0),
c AS (SELECT *, count(*) FILTER (said) OVER w AS p, count(*) FILTER (said AND NOT was) OVER w AS fp, count(*) FILTER (NOT said) OVER w AS n, count(*) FILTER (NOT said AND was) OVER w AS fn FROM b WINDOW w AS (PARTITION BY series_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
d AS MATERIALIZED (SELECT *, CASE WHEN i < 10 THEN 0 WHEN p > 0 AND fp / p > 0.05 THEN 0.1 * (fp / p - 0.05) WHEN n > 0 AND fn / n > 0.1 THEN -0.1 * (fn / n - 0.05) ELSE 0 END AS change FROM c),
a AS (SELECT series_id, i, CAST(0 AS DOUBLE) AS adjustment FROM d WHERE i = 1 UNION ALL SELECT d.series_id, d.i, least(0.5, greatest(-0.5, a.adjustment + d.change)) FROM a JOIN d ON d.series_id = a.series_id AND d.i = a.i + 1),
s AS (SELECT series_id, ts, adjustment FROM a JOIN d USING (series_id, i)),
q AS (SELECT r.*, s.adjustment, count(*) OVER w AS k, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM r ASOF LEFT JOIN s ON s.series_id = r.series_id AND r.ts >= s.ts
  WINDOW w AS (PARTITION BY r.series_id ORDER BY r.ts, r.seq ROWS 99 PRECEDING)),
z AS (SELECT *, abs(CASE WHEN sd = 0 THEN 0 ELSE (value - m) / sd END) / (1 + coalesce(adjustment, 0)) AS z FROM q),
v AS (SELECT *, CASE WHEN k < 2 THEN NULL WHEN z > 3 THEN 'critical' WHEN z > 2 THEN 'warning' ELSE 'normal' END AS severity FROM z)
SELECT series_id, seq, round(adjustment, 6) AS adjustment, severity, severity <> 'normal' AS is_anomaly FROM v""")
def ad_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds adapted by feedback: every tenth event is labelled by whether its value is over 50."""
    r = readings(spark, sf_dir)
    feedback = r.where("seq % 10 = 0").select("series_id", "ts", "seq", (F.col("value") > 30).alias("predicted"), (F.col("value") > 50).alias("actual"))
    return anomaly.adaptive(r, feedback, AnomalySettings(hysteresis=False), KEYS, ORDER, bucket=_day()).select("series_id", "seq", _r("adjustment"), "severity", "is_anomaly")


# Several values ----------------------------------------------------------------

ITEMS = "i AS (SELECT l_orderkey, l_linenumber, [CAST(l_quantity AS DOUBLE), CAST(l_discount AS DOUBLE), CAST(l_tax AS DOUBLE)] AS v FROM lineitem)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [F.col(n).cast("double") for n in ("l_quantity", "l_discount", "l_tax")]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array(*c).alias("v"))


@query(f"WITH {ITEMS} SELECT l_orderkey, l_linenumber, 'value' || (k - 1) AS value_name, CAST(k - 1 AS INTEGER) AS value_index, v[k] AS value, 3 AS total_values FROM i, range(1, 4) t(k)")
def mv_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multivalue.split(_items(spark, sf_dir), "v", ["l_orderkey", "l_linenumber"])


@query(f"""WITH {ITEMS} SELECT l_orderkey, l_linenumber, round(list_avg(v), 6) AS mean, round(list_median(v), 6) AS median, list_min(v) AS min, list_max(v) AS max, round(list_sum(v), 6) AS sum,
  round(list_max(v) - list_min(v), 6) AS range, round(list_stddev_pop(v), 6) AS stddev FROM i""")
def mv_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _items(spark, sf_dir).select("l_orderkey", "l_linenumber", multivalue.aggregate(F.col("v")).alias("a")).select("l_orderkey", "l_linenumber", "a.*")
    return a.select("l_orderkey", "l_linenumber", _r("mean"), _r("median"), "min", "max", _r("sum"), _r("range"), _r("stddev"))


@query(ZSCORE.format(high=3.0, low=2.0) + " SELECT series_id, count(*) FILTER (n >= 2 AND abs(z) > 3.0) AS anomaly_count, count(*) FILTER (n >= 2 AND abs(z) > 3.0) > 0 AS has_anomaly FROM v GROUP BY series_id")
def mv_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multivalue.flag_records(multivalue.analyze(readings(spark, sf_dir), AnomalySettings(), KEYS, ORDER, bucket=_day()), KEYS)


#: Order numbers and lines repeat; the values make the order total.
PAIR_ORDER = ["ts", "seq", "x", "y"]
PW = "PARTITION BY series_id ORDER BY ts, seq, x, y ROWS BETWEEN {n} PRECEDING AND CURRENT ROW"
PAIRS = "p AS (SELECT l_suppkey AS series_id, l_orderkey AS ts, l_linenumber AS seq, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("series_id"), F.col("l_orderkey").alias("ts"), F.col("l_linenumber").alias("seq"), F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))


@query(f"""WITH {PAIRS}, c AS (SELECT *, count(*) OVER w AS n, stddev_pop(x) OVER w AS sx, stddev_pop(y) OVER w AS sy, covar_pop(x, y) OVER w AS cov FROM p WINDOW w AS ({PW.format(n=49)}))
SELECT series_id, ts, seq, CASE WHEN n >= 3 THEN round(CASE WHEN sx * sy = 0 THEN 0 ELSE greatest(-1, least(1, cov / (sx * sy))) END, 3) + 0.0 END AS correlation FROM c""")
def mv_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multivalue.correlate(_pairs(spark, sf_dir), KEYS, PAIR_ORDER, "x", "y", 50, bucket=_range()).select("series_id", "ts", "seq", _r("correlation", 3))


@query(f"""WITH {PAIRS}, l AS (SELECT *, list(x) OVER w AS lx, list(y) OVER w AS ly FROM p WINDOW w AS ({PW.format(n=9)})),
k AS (SELECT series_id, ts, seq, list_transform(lx, lambda a: len(list_filter(lx, lambda b: b < a)) + (len(list_filter(lx, lambda b: b = a)) + 1) / 2.0) AS rx,
  list_transform(ly, lambda a: len(list_filter(ly, lambda b: b < a)) + (len(list_filter(ly, lambda b: b = a)) + 1) / 2.0) AS ry FROM l),
c AS (SELECT *, list_stddev_pop(rx) AS sx, list_stddev_pop(ry) AS sy, list_sum(list_transform(list_zip(rx, ry), lambda z: (z[1] - list_avg(rx)) * (z[2] - list_avg(ry)))) / len(rx) AS cov FROM k)
SELECT series_id, ts, seq, CASE WHEN len(rx) >= 3 THEN round(CASE WHEN sx * sy = 0 THEN 0 ELSE cov / (sx * sy) END, 3) END AS correlation FROM c""")
def mv_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multivalue.correlate(_pairs(spark, sf_dir), KEYS, PAIR_ORDER, "x", "y", 10, "spearman", bucket=_range()).select("series_id", "ts", "seq", _r("correlation", 3))


DAYS = "d AS (SELECT c_mktsegment AS series_id, CAST(o_orderdate AS DATE) AS day, count(*) AS n, sum(CAST(o_totalprice AS DOUBLE)) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by day and market segment: (series_id, day, n, value, ts, seq)."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("series_id"))
    d = o.join(c, o.o_custkey == c.c_custkey).groupBy("series_id", F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("double")).alias("value"))
    return d.withColumn("ts", F.col("day").cast("timestamp")).withColumn("seq", F.lit(0))


@query(f"""WITH {DAYS}, b AS (SELECT series_id, CAST(n AS DOUBLE) AS x, value AS y, row_number() OVER (PARTITION BY series_id ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS c FROM d),
z AS (SELECT *, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy, stddev_pop(x) OVER w AS sx, stddev_pop(y) OVER w AS sy FROM b WINDOW w AS (PARTITION BY series_id)),
l AS (SELECT a.series_id, b.i - a.i AS lag, sum(a.dx * b.dy) / (count(*) * nullif(any_value(a.sx) * any_value(a.sy), 0)) AS r FROM z a JOIN z b ON a.series_id = b.series_id AND abs(b.i - a.i) <= a.c // 4 GROUP BY 1, 2)
SELECT series_id, CAST(lag AS INTEGER) AS lag, round(coalesce(r, 0), 5) AS correlation FROM l""")
def mv_cross_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir).withColumn("x", F.col("n").cast("double"))
    return multivalue.cross_correlation(d, KEYS, ["day"], "x", "value", bucket=_year()).select("series_id", F.col("lag").cast("int").alias("lag"), _r("correlation", 5))


@query(f"""WITH {PAIRS}, c AS (SELECT *, count(*) OVER w AS n, var_samp(x) OVER w AS a, covar_samp(x, y) OVER w AS b, var_samp(y) OVER w AS c, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy FROM p WINDOW w AS ({PW.format(n=49)})),
k AS (SELECT *, a + greatest(1e-6, 1e-6 * greatest(a, c)) AS pa, c + greatest(1e-6, 1e-6 * greatest(a, c)) AS pc FROM c),
m AS (SELECT *, CASE WHEN n >= 10 THEN sqrt(greatest((pc * dx * dx - 2 * b * dx * dy + pa * dy * dy) / (pa * pc - b * b), 0)) END AS distance FROM k)
SELECT series_id, ts, seq, round(distance, 2) AS distance FROM m""")
def mv_mahalanobis_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multivalue.mahalanobis_2d(_pairs(spark, sf_dir), KEYS, PAIR_ORDER, "x", "y", 50).select("series_id", "ts", "seq", _r("distance", 2))


@query(f"""WITH {DAYS}, v AS (SELECT series_id, day, CAST(n AS DOUBLE) AS x, value AS y, value / n AS z FROM d),
c AS (SELECT *, count(*) OVER w AS n, var_samp(x) OVER w AS a, var_samp(y) OVER w AS b, var_samp(z) OVER w AS c, covar_samp(x, y) OVER w AS d, covar_samp(x, z) OVER w AS e, covar_samp(y, z) OVER w AS f,
  x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy, z - avg(z) OVER w AS dz FROM v WINDOW w AS (PARTITION BY series_id ORDER BY day ROWS 59 PRECEDING)),
r AS (SELECT * REPLACE (a + g AS a, b + g AS b, c + g AS c) FROM (SELECT *, greatest(1e-6, 1e-6 * greatest(a, b, c)) AS g FROM c)),
q AS (SELECT *, ((b * c - f * f) * dx * dx + (a * c - e * e) * dy * dy + (a * b - d * d) * dz * dz + 2 * ((e * f - d * c) * dx * dy + (d * f - b * e) * dx * dz + (d * e - a * f) * dy * dz))
  / (a * (b * c - f * f) - d * (d * c - e * f) + e * (d * f - b * e)) AS square FROM r),
k AS (SELECT *, CASE WHEN n >= 10 THEN sqrt(greatest(square, 0)) END AS m FROM q)
SELECT series_id, day, round(m, 4) AS distance, CASE WHEN m > 3 THEN 'critical' WHEN m > sqrt(6.0) THEN 'warning' WHEN m IS NOT NULL THEN 'normal' END AS severity FROM k""")
def mv_mahalanobis(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir).withColumn("v", F.array(F.col("n").cast("double"), "value", F.col("value") / F.col("n")))
    return multivalue.mahalanobis(d, KEYS, ["day"], "v", 60, bucket=_year()).select("series_id", "day", _r("distance", 4), F.col("severity"))


# Forest and components -----------------------------------------------------------


@query()
def iforest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir)
    return multivariate.isolation_forest(d, KEYS, ["day"]).select("series_id", "day", _r("score"), "is_anomaly", "severity")


# Eigenvalues of a 3 x 3 correlation matrix in closed form; z' P z for the projection P on an eigenvector is a polynomial of R in z (Sylvester).
@query(f"""WITH {DAYS}, b AS (SELECT series_id, day, [CAST(n AS DOUBLE), value, value / n] AS v, row_number() OVER (PARTITION BY series_id ORDER BY day) AS i FROM d),
m AS (SELECT series_id, count(*) AS n, [avg(v[1]), avg(v[2]), avg(v[3])] AS mean, [stddev_pop(v[1]), stddev_pop(v[2]), stddev_pop(v[3])] AS sd, corr(v[1], v[2]) AS a, corr(v[1], v[3]) AS b, corr(v[2], v[3]) AS c FROM b WHERE i <= 50 GROUP BY 1),
p AS (SELECT *, sqrt((a * a + b * b + c * c) / 3) AS p FROM m), f AS (SELECT *, acos(greatest(-1, least(1, a * b * c / pow(p, 3)))) / 3 AS phi FROM p),
e AS (SELECT *, 1 + 2 * p * cos(phi) AS l1, 1 + 2 * p * cos(phi + 2 * pi() / 3) AS l3 FROM f), g AS (SELECT *, 3 - l1 - l3 AS l2 FROM e),
z AS (SELECT b.series_id, day, i, n, l1, l2, l3, CASE WHEN l1 / 3 >= 0.95 THEN 1 WHEN (l1 + l2) / 3 >= 0.95 THEN 2 ELSE 3 END AS k, (v[1] - mean[1]) / sd[1] AS x, (v[2] - mean[2]) / sd[2] AS y, (v[3] - mean[3]) / sd[3] AS w, a, b AS bb, c FROM b JOIN g USING (series_id)),
r AS (SELECT *, x + a * y + bb * w AS x1, a * x + y + c * w AS y1, bb * x + c * y + w AS w1 FROM z), q AS (SELECT *, x1 + a * y1 + bb * w1 AS x2, a * x1 + y1 + c * w1 AS y2, bb * x1 + c * y1 + w1 AS w2 FROM r),
o AS (SELECT series_id, day, i, n, k, [x, y, w] AS z, [{", ".join(f"{{'l': l{i}, 'p': [(x2 - (l{j} + l{k}) * x1 + l{j} * l{k} * x) / t, (y2 - (l{j} + l{k}) * y1 + l{j} * l{k} * y) / t, (w2 - (l{j} + l{k}) * w1 + l{j} * l{k} * w) / t]}}".replace("/ t", f"/ ((l{i} - l{j}) * (l{i} - l{k}))") for i, j, k in ((1, 2, 3), (2, 1, 3), (3, 1, 2)))}] AS parts FROM q),
s AS (SELECT series_id, day, i, list_sum([(z[1] * c.p[1] + z[2] * c.p[2] + z[3] * c.p[3]) / (c.l * n / (n - 1)) for c in parts[1:k]]) AS t2, coalesce(list_sum([z[1] * c.p[1] + z[2] * c.p[2] + z[3] * c.p[3] for c in parts[k + 1:]]), 0) AS spe,
  [abs(coalesce(list_sum([c.p[j] for c in parts[k + 1:]]), 0)) for j in range(1, 4)] AS rest FROM o),
l AS (SELECT series_id, max(t2) AS t2_limit, max(spe) AS spe_limit FROM s WHERE i <= 50 GROUP BY 1)
SELECT series_id, day, CASE WHEN i >= 50 THEN round(t2, 6) + 0.0 END AS t2, CASE WHEN i >= 50 THEN round(spe, 6) + 0.0 END AS spe, CASE WHEN i >= 50 THEN t2 > t2_limit OR spe > spe_limit END AS is_anomaly,
  CASE WHEN i >= 50 THEN CAST(list_position(rest, list_max(rest)) - 1 AS BIGINT) END AS top FROM s JOIN l USING (series_id)""")
def pca_t2_spe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir).withColumn("v", F.array(F.col("n").cast("double"), "value", F.col("value") / F.col("n")))
    return multivariate.pca(d, KEYS, ["day"], "v", bucket=_year(), method="combined").select("series_id", "day", _r("t2"), _r("spe"), "is_anomaly", "top")


@query()
def pca_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return multivariate.reconstruction_error(d, "embedding").select("vec_id", _r("error"), "is_anomaly")


# Signals -------------------------------------------------------------------------

SA = """f AS (SELECT user_id, count(*) AS samples, avg(value) AS mean, stddev_pop(value) AS sd, sqrt(avg(value * value)) AS rms, max(abs(value)) AS peak, max(value) - min(value) AS peak_to_peak, avg(abs(value)) AS level FROM events GROUP BY user_id),
m AS (SELECT e.user_id, avg(pow(e.value - f.mean, 3)) AS m3, avg(pow(e.value - f.mean, 4)) AS m4 FROM events e JOIN f USING (user_id) GROUP BY e.user_id),
g AS (SELECT f.*, peak / rms AS crest, rms / level AS form, peak / level AS impulse, CASE WHEN sd = 0 THEN 0 ELSE m3 / pow(sd, 3) END AS skewness, CASE WHEN sd = 0 THEN 0 ELSE m4 / pow(sd, 4) - 3 END AS kurtosis FROM f JOIN m USING (user_id)),
v AS (SELECT *, 100 - CASE WHEN crest > 5 THEN 20 ELSE 0 END - CASE WHEN abs(kurtosis) > 3 THEN 20 ELSE 0 END - CASE WHEN abs(skewness) > 1 THEN 10 ELSE 0 END AS health FROM g)"""


def _vibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.vibration(table(spark, sf_dir, "events"), ["user_id"])


@query(f"""WITH {SA} SELECT user_id, samples, round(rms, 6) AS rms, round(crest, 6) AS crest, round(form, 6) AS form, round(impulse, 6) AS impulse, round(kurtosis, 4) AS kurtosis, round(skewness, 4) AS skewness, health,
  CASE WHEN samples >= 10 THEN crest > 6 OR abs(kurtosis) > 4 END AS is_anomaly FROM v""")
def sa_vibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signal.vibration_verdict(_vibration(spark, sf_dir), SignalSettings())
    return out.select("user_id", "samples", _r("rms"), _r("crest"), _r("form"), _r("impulse"), _r("kurtosis", 4), _r("skewness", 4), "health", "is_anomaly")


@query(f"""WITH {SA}, s AS (SELECT user_id, rms * 0.1 AS v FROM v) SELECT user_id, CASE WHEN v <= 1.12 THEN 'A' WHEN v <= 2.8 THEN 'B' WHEN v <= 7.1 THEN 'C' ELSE 'D' END AS zone,
  round(100 * CASE WHEN v <= 1.12 THEN v / 1.12 WHEN v <= 2.8 THEN (v - 1.12) / 1.68 WHEN v <= 7.1 THEN (v - 2.8) / 4.3 ELSE 1 END, 4) AS zone_progress FROM s""")
def sa_iso10816(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vibration(spark, sf_dir).withColumn("speed", signal.velocity(F.col("rms") * 0.1, "mm_s"))
    return signal.iso_zone(v, "speed", "class2").select("user_id", "zone", _r("zone_progress", 4))


def frames(spark: SparkSession, sf_dir: str, size: int = 256) -> DataFrame:
    """Events by type in frames of ``size`` samples in order: (series_id, frame, samples, sampling_rate).  A buffer that is not full has no spectrum, so a shorter last frame gives no row."""
    return framed(readings(spark, sf_dir), KEYS, ORDER, _day(), size).withColumn("sampling_rate", F.lit(1000.0))


FRAMES = """s AS (SELECT event_type AS series_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events),
x AS (SELECT series_id, i // 64 AS frame, i % 64 AS k, value FROM s), whole AS (SELECT series_id, frame FROM x GROUP BY ALL HAVING count(*) = 64)"""


@query(f"""WITH {FRAMES}, y AS (SELECT x.* FROM x JOIN whole USING (series_id, frame)),
t AS (SELECT series_id, frame, b, sqrt(pow(sum(value * cos(2 * pi() * b * k / 64)), 2) + pow(sum(value * sin(2 * pi() * b * k / 64)), 2)) / 64 AS m FROM y, range(32) r(b) GROUP BY ALL)
SELECT series_id, CAST(frame AS BIGINT) AS frame, round(sum(m * m), 5) AS energy, round(sum(b * 1000.0 / 64 * m) / sum(m), 4) AS centroid FROM t GROUP BY ALL""")
def sa_fft(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signal.fft(frames(spark, sf_dir, 64), SignalSettings(fft_size=64, window="rectangular"))
    return out.select("series_id", "frame", _r("energy", 5), _r("centroid", 4))


@query(f"""WITH {FRAMES}, y AS (SELECT x.*, value - avg(value) OVER (PARTITION BY series_id, frame) AS d FROM x JOIN whole USING (series_id, frame)),
v AS (SELECT series_id, frame, sum(d * d) AS p FROM y GROUP BY ALL)
SELECT a.series_id, CAST(a.frame AS BIGINT) AS frame, CAST(b.k - a.k AS INTEGER) AS lag, round(sum(a.d * b.d) / any_value(v.p), 6) AS r FROM y a JOIN y b ON a.series_id = b.series_id AND a.frame = b.frame AND b.k - a.k BETWEEN 0 AND 10
JOIN v ON v.series_id = a.series_id AND v.frame = a.frame GROUP BY ALL""")
def sa_acf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signal.advanced(frames(spark, sf_dir, 64)).select("series_id", "frame", F.posexplode("acf").alias("lag", "r"))
    return out.select("series_id", "frame", "lag", _r("r"))


LONG = """s AS (SELECT event_type AS series_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events),
x AS (SELECT series_id, i // 256 AS frame, i % 256 AS k, value FROM s), whole AS (SELECT series_id, frame FROM x GROUP BY ALL HAVING count(*) = 256),
y AS (SELECT x.* FROM x JOIN whole USING (series_id, frame))"""


@query(f"""WITH {LONG}, l AS (SELECT series_id, frame, list(value ORDER BY k) AS v, 0.2 * stddev_pop(value) AS tol, avg(value) AS m FROM y GROUP BY ALL),
p AS (SELECT series_id, frame, count(*) FILTER (near) AS b, count(*) FILTER (near AND abs(v[i + 3] - v[j + 3]) <= tol) AS a
  FROM (SELECT l.*, i, j, abs(v[i + 1] - v[j + 1]) <= tol AND abs(v[i + 2] - v[j + 2]) <= tol AS near FROM l, range(254) p(i), range(254) q(j) WHERE i < j) GROUP BY ALL),
c AS (SELECT series_id, frame, [list_sum([(v[k + 1] - m) * (v[k + 1 + g] - m) for k in range(256 - g)]) / list_sum([(x - m) * (x - m) for x in v]) for g in range(11)] AS r FROM l)
SELECT series_id, CAST(frame AS BIGINT) AS frame, round(CASE WHEN a > 0 AND b > 0 THEN -ln(a / b) ELSE 0 END, 6) + 0.0 AS sample_entropy,
  CAST(list_min([k for k in range(2, 10) if r[k + 1] > r[k] AND r[k + 1] > r[k + 2] AND r[k + 1] > 0.3]) AS INTEGER) AS period FROM p JOIN c USING (series_id, frame)""")
def sa_sample_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.advanced(frames(spark, sf_dir)).select("series_id", "frame", _r("sample_entropy"), "period")


@query(f"""WITH {LONG}, l AS (SELECT series_id, frame, list(value ORDER BY k) AS v FROM y GROUP BY ALL),
e AS (SELECT series_id, frame, v, [[k] for k in range(1, 255) if (v[k + 1] > v[k] AND v[k + 1] > v[k + 2] AND v[k + 1] >= 0.1) OR (v[k + 1] < v[k] AND v[k + 1] < v[k + 2] AND v[k + 1] <= -0.1)] AS hits FROM l),
t AS (SELECT series_id, frame, v, CASE WHEN len(hits) > 0 THEN list_reduce(hits, lambda kept, k: CASE WHEN k[1] - kept[-1] >= 10 THEN kept || k ELSE kept END) ELSE [] END AS hits FROM e)
SELECT series_id, CAST(frame AS BIGINT) AS frame, CAST(len(hits) AS INTEGER) AS peaks, round(list_avg([abs(v[k + 1]) for k in hits]), 6) AS average_peak, round(list_max([abs(v[k + 1]) for k in hits]), 6) AS max_peak, false AS is_peak FROM t""")
def sa_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.peaks(frames(spark, sf_dir), SignalSettings()).select("series_id", "frame", F.size("peaks").alias("peaks"), _r("average_peak"), _r("max_peak"), "is_peak")


def _section(name: str, of: str, cutoff: float, high: bool) -> str:
    """SQL of a Butterworth section over the list ``x`` of the relation ``of``, ended by turning the list round: applied twice it has no phase."""
    k = f"tan(pi() * {cutoff} / 1000)"
    norm = f"(1 + sqrt(2) * {k} + {k} * {k})"
    b0 = f"(1 / {norm})" if high else f"({k} * {k} / {norm})"
    b1, a1, a2 = f"({-2 if high else 2} * {b0})", f"(2 * ({k} * {k} - 1) / {norm})", f"((1 - sqrt(2) * {k} + {k} * {k}) / {norm})"
    y = f"({b0} * v.x + s.s1)"
    start = "{'x': CAST(0 AS DOUBLE), 's1': CAST(0 AS DOUBLE), 's2': CAST(0 AS DOUBLE), 'y': CAST([] AS DOUBLE[])}"
    item = "{'x': t, 's1': CAST(0 AS DOUBLE), 's2': CAST(0 AS DOUBLE), 'y': CAST([] AS DOUBLE[])}"
    step = f"{{'x': CAST(0 AS DOUBLE), 's1': {b1} * v.x - {a1} * {y} + s.s2, 's2': {b0} * v.x - {a2} * {y}, 'y': list_append(s.y, {y})}}"
    return f"{name} AS (SELECT series_id, frame, list_reverse(list_reduce(list_prepend({start}, list_transform(x, lambda t: {item})), lambda s, v: {step}).y) AS x FROM {of})"


#: Peaks of envelope spectra: (series_id, frame, b, m, before, after, top).
ENVELOPES = f"""{LONG}, f0 AS (SELECT series_id, frame, list(value ORDER BY k) AS x FROM y GROUP BY ALL), {", ".join(_section(f"f{i + 1}", f"f{i}", c, h) for i, (c, h) in enumerate(((50, True), (50, True), (300, False), (300, False))))},
e AS (SELECT series_id, frame, [list_avg([abs(u) for u in x[greatest(1, i - 5):least(256, i + 5)]]) for i in range(1, 257)] AS x FROM f4),
h AS (SELECT series_id, frame, k, x[k + 1] * (0.5 - 0.5 * cos(2 * pi() * k / 255)) AS v FROM e, range(256) r(k)),
g AS (SELECT series_id, frame, b, sqrt(pow(sum(v * cos(2 * pi() * b * k / 256)), 2) + pow(sum(v * sin(2 * pi() * b * k / 256)), 2)) / 256 AS m FROM h, range(128) r(b) GROUP BY ALL),
n AS (SELECT *, lag(m) OVER w AS before, lead(m) OVER w AS after, max(m) OVER (PARTITION BY series_id, frame) AS top FROM g WINDOW w AS (PARTITION BY series_id, frame ORDER BY b))"""


@query(f"""WITH {ENVELOPES}
SELECT series_id, CAST(frame AS BIGINT) AS frame, fault, CAST(harmonic AS INTEGER) AS harmonic, round(b * 1000.0 / 256, 6) AS frequency, CASE WHEN m > 0.5 THEN 'high' WHEN m > 0.2 THEN 'medium' ELSE 'low' END AS severity
FROM n, (VALUES ('BPFO', 89.0), ('BPFI', 135.0), ('BSF', 58.0), ('FTF', 10.0), ('1X', 25.0), ('2X', 50.0)) t(fault, rate), range(1, 4) u(harmonic)
WHERE m > before AND m > after AND m / top > 0.05 AND abs(b * 1000.0 / 256 - rate * harmonic) / (rate * harmonic) <= 0.05""")
def sa_envelope_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = SignalSettings(low_hz=50.0, high_hz=300.0)
    rates = signal.fault_table(spark, {"BPFO": 89.0, "BPFI": 135.0, "BSF": 58.0, "FTF": 10.0, "1X": 25.0, "2X": 50.0})
    return signal.match_faults(signal.envelope_spectrum(frames(spark, sf_dir), s), rates, s, ["series_id", "frame"]).select("series_id", "frame", "fault", "harmonic", _r("frequency"), "severity")


@query(f"""WITH {LONG}, h AS (SELECT series_id, frame, k, value * (0.5 - 0.5 * cos(2 * pi() * k / 255)) AS v FROM y),
g AS (SELECT series_id, frame, b, ln(greatest(sqrt(pow(sum(v * cos(2 * pi() * b * k / 256)), 2) + pow(sum(v * sin(2 * pi() * b * k / 256)), 2)) / 256, 1e-10)) AS m FROM h, range(128) r(b) GROUP BY ALL),
c AS (SELECT series_id, frame, q, abs(sum(m * cos(2 * pi() * q * b / 128)) / 128) AS size FROM g, range(128) r(q) GROUP BY ALL),
n AS (SELECT *, lag(size) OVER w AS before, lead(size) OVER w AS after, max(size) FILTER (q >= 5) OVER (PARTITION BY series_id, frame) AS top FROM c WINDOW w AS (PARTITION BY series_id, frame ORDER BY q)),
k AS (SELECT series_id, frame, 1000.0 / q AS frequency, size / top AS share FROM n WHERE q BETWEEN 6 AND 100 AND size > before AND size > after AND size / top > 0.1)
SELECT series_id, CAST(frame AS BIGINT) AS frame, CASE WHEN o = 0 THEN 'gear_mesh' ELSE 'sideband' END AS fault, round(frequency, 6) AS frequency,
  CASE WHEN share > CASE WHEN o = 0 THEN 0.5 ELSE 0.3 END THEN 'high' WHEN o > 0 OR share > 0.25 THEN 'medium' ELSE 'low' END AS severity
FROM k, range(4) t(o), (VALUES (4), (7)) gears(teeth) WHERE abs(frequency - 30 * (teeth + o)) / (30 * (teeth + o)) < 0.1""")
def sa_cepstrum_gears(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signal.cepstral(frames(spark, sf_dir), SignalSettings())
    return signal.match_gears(out, signal.gear_table(spark, [4, 7], 1800.0), ["series_id", "frame"]).select("series_id", "frame", "fault", _r("frequency"), "severity")


@query(f"""WITH {ENVELOPES}, t AS (SELECT event_type AS series_id, user_id AS machine, avg(value) AS speed FROM events GROUP BY ALL),
o AS (SELECT series_id, machine, fault, harmonic, speed * ratio * harmonic AS target FROM t, (VALUES ('1X', 1.0), ('BPFO', 3.56), ('BPFI', 5.4), ('FTF', 0.4)) r(fault, ratio), range(1, 4) u(harmonic))
SELECT series_id, CAST(frame AS BIGINT) AS frame, machine, fault, CAST(harmonic AS INTEGER) AS harmonic, round(b * 1000.0 / 256, 6) AS frequency, round(target, 6) AS target
FROM n JOIN o USING (series_id) WHERE m > before AND m > after AND m / top > 0.05 AND abs(b * 1000.0 / 256 - target) / target <= 0.01""")
def sa_fleet_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelope peaks against the fault rates of every machine: users stand in for machines of a type, the mean of their events for the speed."""
    s = SignalSettings(low_hz=50.0, high_hz=300.0, tolerance=0.01)
    machines = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series_id"), F.col("user_id").alias("machine")).agg(F.avg("value").alias("speed"))
    speed = F.col("speed")
    faults = signal.fleet_faults(machines, ["series_id", "machine"], {"1X": speed, "BPFO": speed * 3.56, "BPFI": speed * 5.4, "FTF": speed * 0.4})
    # rounded where they are made, not once for each of many more matches
    faults = faults.withColumn("shown_target", _r("target"))
    spectra = signal.envelope_spectrum(frames(spark, sf_dir), s).withColumn("peaks", F.transform("peaks", lambda p: p.withField("shown_frequency", F.round(p["frequency"], 6) + F.lit(0.0))))
    out = signal.match_fleet(spectra, faults, s, KEYS, ["series_id", "frame"])
    return out.select("series_id", "frame", "machine", "fault", F.col("harmonic").cast("int").alias("harmonic"), F.col("shown_frequency").alias("frequency"), F.col("shown_target").alias("target"))


# Trends --------------------------------------------------------------------------


@query(f"""WITH {DAYS}, b AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY day) AS i FROM d),
f AS (SELECT *, count(*) OVER w AS c, regr_slope(value, i) OVER w AS slope, avg(value) OVER w AS m FROM b WINDOW w AS (PARTITION BY series_id ORDER BY day ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT series_id, day, CASE WHEN c >= 3 THEN round(slope, 1) END AS slope, CASE WHEN c >= 3 THEN round(m - slope * (c - 1) / 2, 0) END AS intercept,
  CASE WHEN c < 3 THEN NULL WHEN slope > 0.01 THEN 'increasing' WHEN slope < -0.01 THEN 'decreasing' ELSE 'stable' END AS trend FROM f""")
def tp_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.linear(daily(spark, sf_dir), TrendSettings(), KEYS, ["day"], bucket=_year()).select("series_id", "day", _r("slope", 1), _r("intercept", 0), "trend")


@query(f"""WITH {DAYS}, b AS (SELECT *, list(value) OVER (PARTITION BY series_id ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS l FROM d),
f AS (SELECT series_id, day, len(l) AS c, list_reduce(list_prepend({{'level': l[1], 'slope': l[2] - l[1], 'x': 0.0}}, list_transform(l[2:], lambda v: {{'level': 0.0, 'slope': 0.0, 'x': v}})),
  lambda s, v: {{'level': 0.3 * v.x + 0.7 * (s.level + s.slope), 'slope': 0.1 * (0.3 * v.x + 0.7 * (s.level + s.slope) - s.level) + 0.9 * s.slope, 'x': 0.0}}) AS h FROM b)
SELECT series_id, day, CASE WHEN c >= 3 THEN round(h.level, 2) END AS level, CASE WHEN c >= 3 THEN round(h.slope, 2) END AS slope FROM f""")
def tp_holt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.holt(daily(spark, sf_dir), TrendSettings(window=20), KEYS, ["day"], bucket=_year()).select("series_id", "day", _r("level", 2), _r("slope", 2))


@query(f"""WITH {R}, l AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS dt, value - lag(value) OVER w AS dv FROM r WINDOW w AS (PARTITION BY series_id ORDER BY ts, seq))
SELECT series_id, seq, CASE WHEN dt > 0 THEN round(dv / dt, 6) END AS rate, CASE WHEN dt > 0 THEN abs(dv / dt) > 1.0 END AS is_anomaly FROM l""")
def tp_rate_of_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.rate_of_change(readings(spark, sf_dir), KEYS, ORDER, 1.0, bucket=_day()).select("series_id", "seq", _r("rate"), "is_anomaly")


@query(f"""WITH {R}, l AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY series_id ORDER BY ts, seq) AS i FROM r),
h AS (SELECT a.series_id, a.seq, list(b.us ORDER BY b.i) AS t, list(b.value ORDER BY b.i) AS v FROM l a JOIN l b ON a.series_id = b.series_id AND b.i <= a.i AND b.us BETWEEN a.us - 1800000000 AND a.us GROUP BY ALL),
k AS (SELECT *, list_filter(list_transform(range(2, len(t) + 1), lambda j: CASE WHEN t[j] > t[j - 1] THEN (v[j] - v[j - 1]) / ((t[j] - t[j - 1]) / 1e6) END), lambda x: x IS NOT NULL) AS rates FROM h)
SELECT series_id, seq, CASE WHEN len(t) >= 3 AND len(rates) >= 2 THEN round((rates[-1] - rates[-2]) / (1800.0 / len(t)), 7) END AS acceleration FROM k""")
def tp_acceleration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.acceleration(readings(spark, sf_dir), TrendSettings(time_window_s=1800.0), KEYS, ORDER).select("series_id", "seq", _r("acceleration", 7))


# The median filter, the mean of its values, all pairwise slopes and least squares of each buffer, written out as lists.
RUL = """l AS (SELECT series_id, day, list(x) OVER w AS x, list(epoch_ms(CAST(day AS TIMESTAMP))) OVER w AS ms FROM c WINDOW w AS (PARTITION BY series_id ORDER BY day ROWS 49 PRECEDING)),
n AS (SELECT *, len(x) AS n, greatest(3, len(x) // 10) // 2 AS h, x[-1] AS now FROM l),
f AS (SELECT *, [list_sort(x[greatest(1, i - 2):least(n, i + 2)])[(least(n, i + 2) - greatest(1, i - 2) + 1) // 2 + 1] for i in range(1, n + 1)] AS m FROM n),
s AS (SELECT *, [list_avg(m[greatest(1, i - h):least(n, i + h)]) for i in range(1, n + 1)] AS s FROM f),
t AS (SELECT *, list_sort(flatten([[(s[j] - s[i]) / (j - i) for j in range(i + 1, n + 1)] for i in range(1, n)])) AS slopes, list_sum([(i - (n + 1) / 2.0) * s[i] for i in range(1, n + 1)]) / (n * (n * n - 1) / 12.0) AS line FROM s WHERE n >= 5),
g AS (SELECT *, 0.7 * slopes[len(slopes) // 2 + 1] + 0.3 * line AS slope, s[n] AS level, list_avg(s) - line * (n - 1) / 2 AS start, (ms[n] - ms[1]) / (n - 1) AS step FROM t),
e AS (SELECT *, list_sum([pow(x[i] - start - line * (i - 1), 2) for i in range(1, n + 1)]) AS rest, list_sum([pow(v - list_avg(x), 2) for v in x]) AS total FROM g),
k AS (SELECT *, 1.96 * sqrt(rest / greatest(1, n - 2)) * sqrt(1 + 1.0 / n) AS margin, CASE WHEN now >= goal THEN 'failed' WHEN slope <= 0.0001 THEN 'stable' ELSE 'open' END AS kind FROM e)"""


@query(f"""WITH {DAYS}, c AS (SELECT series_id, day, sum(value) OVER (PARTITION BY series_id ORDER BY day) AS x FROM d), {RUL.replace("goal", "1e9")},
r AS (SELECT series_id, day, kind, step, CASE kind WHEN 'failed' THEN 0 WHEN 'open' THEN (1e9 - level) / slope * step END AS rul, CASE WHEN kind = 'open' THEN greatest(0, (1e9 - margin - level) / slope * step) END AS low,
  CASE kind WHEN 'failed' THEN 1 WHEN 'stable' THEN 0.5 ELSE greatest(0, least(1, 1 - rest / total)) END AS sure FROM k)
SELECT series_id, day, round(rul / 86400000, 4) + 0.0 AS rul, round(nullif(low, 0) / 86400000, 4) AS rul_lower, CASE WHEN kind <> 'open' THEN kind WHEN rul < 10 * step THEN 'critical' WHEN rul < 50 * step THEN 'warning' WHEN kind IS NOT NULL THEN 'healthy' END AS rul_status,
  round(sure, 4) AS rul_confidence FROM (SELECT series_id, day FROM d) LEFT JOIN r USING (series_id, day)""")
def tp_rul(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remaining life of cumulative revenue towards a fixed limit."""
    from pyspark.sql import Window

    d = daily(spark, sf_dir).withColumn("value", F.sum("value").over(Window.partitionBy("series_id").orderBy("day")))
    out = trend.remaining_life(d, TrendSettings(threshold=1e9, unit="days"), KEYS, ["day"], bucket=_year())
    return out.select("series_id", "day", _r("rul", 4), _r("rul_lower", 4), "rul_status", _r("rul_confidence", 4))


@query(f"""WITH {DAYS}, c AS (SELECT series_id, day, value AS x FROM d), {RUL.replace("goal", "1e7")},
w AS (SELECT *, 1 - (now - list_min(x)) / (list_max(x) - list_min(x)) AS alive, list_sum([(i - (n + 1) / 2.0) * x[i] for i in range(1, n + 1)]) > 0 AS rises, least(5, greatest(0.5, list_avg(x) / list_aggregate(x, 'stddev_pop'))) AS b FROM k),
v AS (SELECT *, kind = 'open' AND rises AND alive > 0 AND alive < 1 AS fits FROM w), u AS (SELECT *, CASE WHEN fits THEN (n - 1) * step / pow(-ln(CASE WHEN fits THEN alive END), 1 / b) END AS eta FROM v),
r AS (SELECT series_id, day, kind, step, fits, b, eta, CASE WHEN kind = 'failed' THEN 0 WHEN fits THEN greatest(0, eta * pow(-ln(0.1), 1 / b) - (n - 1) * step) WHEN kind = 'open' THEN (1e7 - level) / slope * step END AS rul FROM u)
SELECT series_id, day, round(rul / 86400000, 2) + 0.0 AS rul, CASE WHEN kind <> 'open' THEN 'weibull' WHEN fits THEN 'weibull' WHEN kind IS NOT NULL THEN 'linear' END AS rul_model, CASE WHEN fits THEN round(b, 4) END AS weibull_beta,
  CASE WHEN fits THEN round(eta * pow(-ln(0.9), 1 / b) / 86400000, 4) END AS weibull_b10, CASE WHEN fits THEN CASE WHEN b < 1 THEN 'infant_mortality' WHEN b = 1 THEN 'useful_life' WHEN b < 4 THEN 'wear_out' ELSE 'rapid_wear_out' END END AS phase,
  CASE WHEN kind <> 'open' THEN kind WHEN rul < 10 * step THEN 'critical' WHEN rul < 50 * step THEN 'warning' WHEN kind IS NOT NULL THEN 'healthy' END AS rul_status FROM (SELECT series_id, day FROM d) LEFT JOIN r USING (series_id, day)""")
def tp_rul_weibull(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trend.remaining_life(daily(spark, sf_dir), TrendSettings(method="weibull", threshold=1e7, unit="days"), KEYS, ["day"], bucket=_year())
    return out.select("series_id", "day", _r("rul", 2), "rul_model", _r("weibull_beta", 4), _r("weibull_b10", 4), "phase", "rul_status")


# Health --------------------------------------------------------------------------

ASSESS = f"""a AS (SELECT event_type AS sensor, CAST(ts AS DATE) AS day, avg(value) AS value, stddev_pop(value) AS sd, count(*) AS n FROM events GROUP BY 1, 2),
b AS (SELECT *, avg(value) OVER (PARTITION BY sensor) AS m, stddev_pop(value) OVER (PARTITION BY sensor) AS s FROM a),
c AS (SELECT *, CASE WHEN s = 0 THEN 0 ELSE (value - m) / s END AS z, (value - m) / m * 100 AS dev, CASE WHEN n < 20 THEN 0.3 ELSE 0.9 END AS confidence FROM b),
p AS (SELECT *, 100 - CASE WHEN abs(z) > 2.5 THEN 30 ELSE 0 END - CASE WHEN abs(z) > 3 THEN 40 WHEN abs(z) > 2 THEN 20 ELSE 0 END - CASE WHEN abs(dev) > 30 THEN 30 WHEN abs(dev) > 15 THEN 15 ELSE 0 END AS base FROM c),
k AS (SELECT *, CAST(greatest(0, least(100, base + CASE WHEN confidence < 0.5 THEN floor((100 - base) * (1 - confidence / 0.5) * 0.5 + 0.5) ELSE 0 END)) AS DOUBLE) AS score FROM p)"""


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type, assessed against the type's days."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("sensor"), F.col("ts").cast("date").alias("day")).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("sensor")
    m, s = F.avg("value").over(w), F.stddev_pop("value").over(w)
    z = stats.zscore(F.col("value"), m, s)
    return e.select("sensor", "day", "value", (F.abs(z) > 2.5).alias("is_anomaly"), z.alias("z_score"), ((F.col("value") - m) / m * 100).alias("deviation_percent"), F.lit("stable").alias("trend"), F.lit(0.0).alias("slope"), F.when(F.col("n") < 20, 0.3).otherwise(0.9).alias("confidence"))


def _health_sql(made: str) -> str:
    status = "CASE WHEN health < 20 THEN 'critical' WHEN health < 40 THEN 'degraded' WHEN health < 60 THEN 'warning' WHEN health < 80 THEN 'attention' ELSE 'healthy' END"
    worst = "min_by(CASE WHEN score < 100 THEN sensor END, CASE WHEN score < 100 THEN (score, sensor) END)"
    return f"WITH {ASSESS}, h AS (SELECT day, {made} AS health, {worst} AS worst_sensor FROM k GROUP BY day) SELECT day, round(health, 6) AS health, {status} AS status, worst_sensor FROM h"


def _health(spark: SparkSession, sf_dir: str, how: str, weights: tuple = ()) -> DataFrame:
    out = health.index(health.sensor_scores(assessments(spark, sf_dir)), ["day"], HealthSettings(aggregation=how, weights=weights))
    return out.select("day", _r("health"), "status", "worst_sensor")


@query(_health_sql("sum(score * CASE WHEN sensor = 'error' THEN 3.0 ELSE 1.0 END) / sum(CASE WHEN sensor = 'error' THEN 3.0 ELSE 1.0 END)"))
def hi_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _health(spark, sf_dir, "weighted", (("error", 3.0), ("click", 0.0)))


@query(_health_sql("min(score)"))
def hi_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _health(spark, sf_dir, "minimum")


@query(_health_sql("avg(score)"))
def hi_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _health(spark, sf_dir, "average")


@query(_health_sql("CASE WHEN min(score) <= 0 THEN 0.0 ELSE exp(avg(ln(score))) END"))
def hi_geometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _health(spark, sf_dir, "geometric")


@query(f"WITH {ASSESS} SELECT sensor, day, score FROM k")
def hi_sensor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.sensor_scores(assessments(spark, sf_dir)).select("sensor", "day", "score")


@query(f"""WITH {ASSESS}, w AS (SELECT *, count(*) OVER u AS seen, count(*) FILTER (abs(z) > 2.5) OVER u / count(*) OVER u AS rate, count(value) OVER l AS held, stddev_pop(value) OVER l / nullif(abs(avg(value) OVER l), 0) AS cv
  FROM k WINDOW u AS (PARTITION BY sensor ORDER BY day ROWS UNBOUNDED PRECEDING), l AS (PARTITION BY sensor ORDER BY day ROWS 49 PRECEDING)),
f AS (SELECT *, greatest(0.1, least(1, CASE WHEN seen >= 10 AND rate > 0.3 THEN 1.3 - rate ELSE 1 END * CASE WHEN held >= 10 AND cv > 0.5 THEN greatest(0.5, 1.5 - cv) ELSE 1 END * confidence)) * CASE WHEN sensor = 'error' THEN 2.5 ELSE 1 END AS weight FROM w),
h AS (SELECT 'm' AS machine, day, sum(score * weight) / sum(weight) AS health FROM f GROUP BY day),
t AS (SELECT *, list(health) OVER (ORDER BY day ROWS 9 PRECEDING) AS l FROM h),
d AS (SELECT *, list_avg(l[len(l) // 2 + 1:]) - list_avg(l[:len(l) // 2]) AS change FROM t)
SELECT machine, day, round(health, 6) AS health, CASE WHEN len(l) < 3 THEN 'unknown' WHEN change > 2 THEN 'improving' WHEN change < -2 THEN 'degrading' ELSE 'stable' END AS health_trend FROM d""")
def hi_dynamic_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assessments(spark, sf_dir).withColumn("machine", F.lit("m"))
    scored = health.dynamic_weights(health.sensor_scores(a), "machine", ["day"], HealthSettings(weights=(("error", 2.5),)))
    return health.trend(health.index(scored, ["machine", "day"], HealthSettings()), "machine", ["day"]).select("machine", "day", _r("health"), "health_trend")


# Datasets ------------------------------------------------------------------------


@query("""WITH o AS (SELECT event_id, row_number() OVER (ORDER BY (event_id + 7) * 2654435761 % 4294967296, event_id) AS i, count(*) OVER () AS n FROM events)
SELECT event_id, CASE WHEN i <= floor(n * 0.7) THEN 'train' WHEN i <= floor(n * 0.7) + floor(n * 0.15) THEN 'validation' ELSE 'test' END AS split FROM o""")
def td_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.split(table(spark, sf_dir, "events").select("event_id"), "event_id", seed=7)


STATS_SQL = " UNION ALL ".join(f"SELECT '{f}' AS feature, count(v) AS count, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, min(v) AS min, max(v) AS max FROM (SELECT CAST({c} AS DOUBLE) AS v FROM lineitem)" for f, c in (("quantity", "l_quantity"), ("price", "l_extendedprice"), ("discount", "l_discount")))


@query(STATS_SQL)
def td_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["quantity", "price", "discount"]
    d = dataset.features(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return dataset.feature_stats(d, names).select("feature", "count", _r("mean", 4), _r("std", 4), "min", "max")


@query("""WITH w AS (SELECT event_type AS series_id, event_id AS seq, row_number() OVER w AS n, list(value) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS l FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
SELECT series_id, seq, len(l) AS size, round(list_sum(l), 6) AS total FROM w WHERE n >= 10 AND (n - 10) % 5 = 0""")
def td_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dataset.windows(readings(spark, sf_dir), KEYS, ORDER, 10, 50.0, "value", bucket=_day())
    return out.select("series_id", "seq", F.size("window").cast("long").alias("size"), F.round(F.aggregate("window", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


@query("""SELECT event_type AS series_id, event_id AS seq, CAST(greatest(0, 100 - row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS DOUBLE) AS label FROM events""")
def td_rul_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.rul_label(readings(spark, sf_dir), KEYS, ORDER, 100, bucket=_day()).select("series_id", "seq", "label")


@query("SELECT event_type AS label, count(*) AS count FROM events GROUP BY 1")
def td_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.label_counts(dataset.label(table(spark, sf_dir, "events").withColumn("label", F.col("event_type")), "fromMessage"))


@query("""WITH w AS (SELECT event_type AS series_id, event_id AS seq, list(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS l FROM events)
SELECT series_id, seq, round(list_sum(l), 6) AS total FROM w WHERE len(l) = 30""")
def fe_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dataset.sequences(readings(spark, sf_dir), "series_id", ORDER, 30, "value", bucket=_day())
    return out.select("series_id", "seq", F.round(F.aggregate("sequence", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, CAST(l_discount AS DOUBLE) AS x, CAST(l_tax AS DOUBLE) AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, round((0.15 * CASE WHEN x <= 0.02 THEN 100 WHEN x <= 0.05 THEN 100 - 30 * (x - 0.02) / (0.05 - 0.02) WHEN x <= 0.1 THEN 70 - 40 * (x - 0.05) / (0.1 - 0.05) ELSE greatest(0, 30 - 30 * (x - 0.1) / 0.1) END
  + 0.15 * CASE WHEN t <= 0.05 THEN 100 WHEN t <= 0.1 THEN 100 - 30 * (t - 0.05) / (0.1 - 0.05) WHEN t <= 0.15 THEN 70 - 40 * (t - 0.1) / (0.15 - 0.1) ELSE greatest(0, 30 - 30 * (t - 0.15) / 0.15) END) / 0.3, 4) AS motor_health FROM p""")
def fe_motor_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").cast("double").alias("current_imbalance"), F.col("l_tax").cast("double").alias("THD"))
    return features.motor_health(d).select("l_orderkey", "l_linenumber", _r("motor_health", 4))


@query(f"""WITH {LONG}, m AS (SELECT *, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS sd FROM y WINDOW w AS (PARTITION BY series_id, frame)),
k AS (SELECT series_id, frame, sqrt(avg(value * value)) AS rms, avg(pow((value - mean) / sd, 4)) AS kurtosis FROM m GROUP BY ALL),
p AS (SELECT series_id, frame, b * 1000.0 / 256 AS f, (pow(sum(value * cos(2 * pi() * b * k / 256)), 2) + pow(sum(value * sin(2 * pi() * b * k / 256)), 2)) / 65536 AS p FROM y, range(129) r(b) GROUP BY series_id, frame, b)
SELECT series_id, CAST(frame AS BIGINT) AS frame, round(any_value(rms), 6) AS rms, round(any_value(kurtosis), 6) AS kurtosis, round(sum(f * p) / sum(p), 4) AS centroid, round(sum(p) FILTER (f < 100) / sum(p), 6) AS band_0_100
FROM p JOIN k USING (series_id, frame) GROUP BY ALL""")
def fe_vibration_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.vibration_bands(frames(spark, sf_dir)).select("series_id", "frame", _r("rms"), _r("kurtosis"), _r("centroid", 4), _r("band_0_100"))


# Inference, vision, analyst --------------------------------------------------------


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 4) AS total, list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) > 0.5 AS is_anomaly FROM embeddings""")
def ml_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in model (the sum of the features) through the inference path."""
    d = inference.input_vector(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    out = inference.predict(d, lambda: lambda x: x.sum(axis=1, keepdims=True))
    return out.select("vec_id", F.round(out.prediction[0], 4).alias("total"), inference.anomaly(out.prediction).alias("is_anomaly"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: exp(CAST(v AS DOUBLE))) AS x FROM embeddings)
SELECT vec_id, CAST(list_position(x, list_max(x)) - 1 AS INTEGER) AS class, round(list_max(x) / list_sum(x), 6) AS probability FROM e""")
def vi_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = vision.classify(F.col("embedding").cast("array<double>"))
    return table(spark, sf_dir, "embeddings").select("vec_id", top[0].alias("t")).select("vec_id", F.col("t.class").alias("class"), F.round("t.probability", 6).alias("probability"))


@query("""WITH e AS (SELECT vec_id, [abs(CAST(x AS DOUBLE)) * 4 for x in embedding] AS v FROM embeddings),
b AS (SELECT vec_id, [{'x1': v[i * 6 + 1] - v[i * 6 + 3] / 2, 'y1': v[i * 6 + 2] - v[i * 6 + 4] / 2, 'x2': v[i * 6 + 1] + v[i * 6 + 3] / 2, 'y2': v[i * 6 + 2] + v[i * 6 + 4] / 2, 's': v[i * 6 + 5] * v[i * 6 + 6], 'i': i} for i in range(10)] AS boxes FROM e),
o AS (SELECT vec_id, list_transform(list_sort([{'key': -b.s, 'i': b.i, 'b': b} for b in boxes]), lambda z: [z.b]) AS boxes FROM b)
SELECT vec_id, CAST(len(list_reduce(boxes, lambda kept, n: CASE WHEN len([k for k in kept if greatest(0, least(k.x2, n[1].x2) - greatest(k.x1, n[1].x1)) * greatest(0, least(k.y2, n[1].y2) - greatest(k.y1, n[1].y1))
  > 0.45 * ((k.x2 - k.x1) * (k.y2 - k.y1) + (n[1].x2 - n[1].x1) * (n[1].y2 - n[1].y1) - greatest(0, least(k.x2, n[1].x2) - greatest(k.x1, n[1].x1)) * greatest(0, least(k.y2, n[1].y2) - greatest(k.y1, n[1].y1)))]) > 0 THEN kept ELSE kept || n END)) AS INTEGER) AS boxes FROM o""")
def vi_boxes_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.abs(v) * 4)
    found = vision.nms(vision.boxes(flat, 6, "yolo", 0.0))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(found).alias("boxes"))


@query(f"""WITH {R}, b AS (SELECT *, (row_number() OVER (PARTITION BY series_id ORDER BY ts, seq) - 1) // 50 AS batch FROM r)
SELECT series_id, CAST(batch AS BIGINT) AS batch, count(*) AS count, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, min(value) AS min, max(value) AS max, round(max(value) - min(value), 6) AS range FROM b GROUP BY ALL""")
def ll_batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analyst.batch_stats(analyst.batches(readings(spark, sf_dir), KEYS, ORDER, 50, bucket=_day()), ["series_id", "batch"], order=ORDER)
    return out.select("series_id", "batch", "count", _r("mean"), _r("sd"), "min", "max", _r("range"))


def _digits(x: str, n: int) -> str:
    return f"regexp_replace(CAST(CAST(printf('%.{n}g', {x}) AS DOUBLE) AS VARCHAR), '[.]0$', '')"


@query(f"""WITH {R}, b AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts, seq) - 1 AS i FROM r),
s AS (SELECT series_id, i // 50 AS batch, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd, min(value) AS low, max(value) AS high, string_agg({_digits("value", 6)}, ', ' ORDER BY seq) AS samples FROM b GROUP BY ALL)
SELECT series_id, CAST(batch AS BIGINT) AS batch, 'Sensor ' || series_id || ': n=' || n || {" || ".join(f"' {label}=' || {_digits(c, 4)}" for label, c in (("mean", "mean"), ("stdDev", "sd"), ("min", "low"), ("max", "high"), ("range", "high - low")))} || chr(10) || samples AS prompt FROM s""")
def ll_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analyst.batch_stats(analyst.batches(readings(spark, sf_dir), KEYS, ORDER, 50, bucket=_day()), ["series_id", "batch"], order=ORDER)
    return analyst.prompts(out, "series_id", "Sensor {series}: {stats}\n{samples}").select("series_id", "batch", "prompt")


# Statistics ------------------------------------------------------------------------


@query("""WITH s AS (SELECT event_type AS series_id, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd, stddev_samp(value) AS ss, median(value) AS med, quantile_cont(value, 0.9) AS p90, sqrt(avg(value * value)) AS rms, max(abs(value)) / sqrt(avg(value * value)) AS crest FROM events GROUP BY 1),
z AS (SELECT e.event_type AS series_id, sum(pow((e.value - s.mean) / s.sd, 3)) AS z3, sum(pow((e.value - s.mean) / s.sd, 4)) AS z4 FROM events e JOIN s ON s.series_id = e.event_type GROUP BY 1)
SELECT series_id, round(mean, 6) AS mean, round(sd, 6) AS sd, round(ss, 6) AS ss, round(med, 6) AS med, round(p90, 6) AS p90, round(rms, 6) AS rms, round(crest, 6) AS crest,
  round(n / ((n - 1.0) * (n - 2)) * z3, 4) AS skew, round(n * (n + 1.0) / ((n - 1.0) * (n - 2) * (n - 3)) * z4 - 3.0 * (n - 1) * (n - 1) / ((n - 2.0) * (n - 3)), 4) AS kurt FROM s JOIN z USING (series_id)""")
def st_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("value")
    made = {"mean": stats.mean(x), "sd": stats.stddev(x), "ss": stats.stddev_sample(x), "med": stats.median(x), "p90": stats.percentile(x, 90), "rms": stats.rms(x), "crest": stats.crest_factor(x)}
    out = readings(spark, sf_dir).groupBy("series_id").agg(*[F.round(c, 6).alias(n) for n, c in made.items()], F.round(stats.skewness(x), 4).alias("skew"), F.round(stats.kurtosis(x), 4).alias("kurt"))
    return out


@query("""SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rank FROM events""")
def st_average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", stats.average_rank(["event_type"], "value").alias("rank"))


# Further operators -----------------------------------------------------------------


@query(f"""WITH RECURSIVE {R}, b AS (SELECT series_id, seq, row_number() OVER (PARTITION BY series_id ORDER BY ts, seq) AS i, value - avg(value) OVER ({_w(100)}) AS d FROM r),
f AS (SELECT series_id, i, CAST(NULL AS DOUBLE) AS top, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS down FROM b WHERE i = 1
  UNION ALL SELECT n.series_id, n.i, greatest(n.u, n.w), CASE WHEN greatest(n.u, n.w) > 50 THEN 0 ELSE n.u END, CASE WHEN greatest(n.u, n.w) > 50 THEN 0 ELSE n.w END
  FROM (SELECT b.series_id, b.i, greatest(0, f.up + b.d - 0.5) AS u, greatest(0, f.down - b.d - 0.5) AS w FROM f JOIN b ON b.series_id = f.series_id AND b.i = f.i + 1) n)
SELECT b.series_id, b.seq, round(f.top, 5) AS score FROM b JOIN f USING (series_id, i)""")
def ad_cusum_buffer_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a target each value is held against the mean of its buffer."""
    s = AnomalySettings(method="cusum", cusum_threshold=50.0, cusum_warning=35.0, hysteresis=False)
    return anomaly.detect(readings(spark, sf_dir), s, KEYS, ORDER, bucket=_day()).select("series_id", "seq", _r("score", 5))


@query(f"WITH {ITEMS} SELECT l_orderkey, l_linenumber, v[1] + v[2] + v[3] AS total, 'value0,value1,value2' AS names, 3 AS value_count FROM i")
def mv_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = multivalue.parallel(_items(spark, sf_dir), "v", ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", (F.col("values")[0] + F.col("values")[1] + F.col("values")[2]).alias("total"), F.array_join("value_names", ",").alias("names"), "value_count")


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, CAST(l_tax AS DOUBLE) AS inlet, CAST(l_discount AS DOUBLE) AS outlet, CAST(l_quantity AS DOUBLE) AS flow, CAST(l_extendedprice AS DOUBLE) / 1000 AS current FROM lineitem)
SELECT l_orderkey, l_linenumber, round(flow * (outlet - inlet) * 100 / 36, 6) + 0.0 AS hydraulic_power, round(greatest(0, least(1, flow * (outlet - inlet) * 100 / 36 / (current * (400 * 0.85 * sqrt(3.0) / 1000)))), 9) + 0.0 AS efficiency,
  round(current / flow, 10) AS specific_energy, round(inlet - 0.5, 6) AS npsh_margin FROM p""")
def fe_pump(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_tax").alias("p_inlet"), F.col("l_discount").alias("p_outlet"), F.col("l_quantity").alias("flow"), (F.col("l_extendedprice").cast("double") / 1000).alias("current"), F.lit(40.0).alias("bearing_temp"), F.lit(2.0).alias("vibration_rms"))
    return features.pump(d).select("l_orderkey", "l_linenumber", _r("hydraulic_power"), _r("efficiency", 9), _r("specific_energy", 10), _r("npsh_margin"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS q, CAST(l_extendedprice AS DOUBLE) AS e, CAST(l_tax AS DOUBLE) AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, round((75 - t * 100) - 55, 6) AS delta_t_coil, round(e / (q * 1000 + 1), 6) AS fan_efficiency, round(1.5 / (e / 50000 + 0.1), 6) AS filter_loading,
  round(greatest(-1, least(1, (78 - (75 - t * 100)) / (78 - (60 + q) + 0.1))), 6) + 0.0 AS economizer_eff FROM p""")
def fe_hvac(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, e, t = (F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_tax"))
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (75 - t * 100).alias("mixed_temp"), F.lit(55.0).alias("supply_temp"), F.lit(78.0).alias("return_temp"), (60 + q).alias("outdoor_temp"), e.alias("airflow"), q.alias("fan_power"), F.lit(1.5).alias("filter_dp"), F.lit(50.0).alias("chw_valve"), F.lit(2.0).alias("fan_vibration"))
    return features.hvac(d, 50_000.0).select("l_orderkey", "l_linenumber", _r("delta_t_coil"), _r("fan_efficiency"), _r("filter_loading"), _r("economizer_eff"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS q, CAST(l_extendedprice AS DOUBLE) AS e, CAST(l_discount AS DOUBLE) * 4 AS w FROM lineitem)
SELECT l_orderkey, l_linenumber, round(q / (e + 1), 8) AS force_z_ratio, round(e / (q * 2 * 10 + 1), 5) AS specific_energy, round(q * (pi() * 10 / 1000), 6) AS cutting_speed,
  CASE WHEN w <= 0.1 THEN 'new' WHEN w <= 0.2 THEN 'good' WHEN w <= 0.3 THEN 'worn' ELSE 'critical' END AS wear_state FROM p""")
def fe_cutting_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, e, w = F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double"), F.col("l_discount").cast("double") * 4
    one = {n: F.lit(1.0) for n in ("force_x", "force_y", "vibration_rms", "power_kw", "ae_rms", "temperature")}
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", q.alias("force_z"), e.alias("force_resultant"), q.alias("feed_rate"), F.lit(2.0).alias("depth_of_cut"), q.alias("spindle_speed"), w.alias("wear_vb"), *[c.alias(n) for n, c in one.items()])
    return features.cutting_tool(d).select("l_orderkey", "l_linenumber", _r("force_z_ratio", 8), _r("specific_energy", 5), _r("cutting_speed"), "wear_state")


@query("""SELECT event_id, event_type AS label, CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE 0.0 END AS severity,
  CAST(greatest(0, 500 - row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS DOUBLE) AS rul FROM events""")
def td_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and severities of messages, and the countdown label."""
    e = readings(spark, sf_dir).withColumn("class", F.col("series_id")).withColumn("fault_severity", F.when(F.col("seq") % 3 == 0, "0.5"))
    named = dataset.severity(dataset.label(e, "fromMessage")).withColumnRenamed("label", "message")
    return dataset.rul_label(named, KEYS, ORDER, 500, bucket=_day()).select(F.col("seq").alias("event_id"), F.col("message").alias("label"), "severity", F.col("label").alias("rul"))


@query("""SELECT event_id, [CAST(value AS DOUBLE), CASE WHEN event_id % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(event_id AS DOUBLE) END, 0.0][1] AS f1,
  CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE CAST(event_id AS DOUBLE) END AS f2, 0.0 AS f3, event_id % 7 <> 0 AS valid FROM events""")
def td_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named features out of text, what can't be read is 0; and rows of the right arity told from others."""
    m = F.create_map(F.lit("f1"), F.col("value").cast("string"), F.lit("f2"), F.when(F.col("event_id") % 5 == 0, "kg").otherwise(F.concat(F.col("event_id").cast("string"), F.lit("kg"))))
    d = dataset.features(table(spark, sf_dir, "events").withColumn("m", m), ["f1", "f2", "f3"], "m")
    cut = d.withColumn("values", F.when(F.col("event_id") % 7 == 0, F.slice("values", 1, 2)).otherwise(F.col("values")))
    good, bad = dataset.valid(cut, 3)
    both = good.withColumn("valid", F.lit(True)).unionByName(bad.drop("reason").withColumn("valid", F.lit(False)))
    return both.select("event_id", F.col("values")[0].alias("f1"), F.col("values")[1].alias("f2"), F.coalesce(F.get("values", F.lit(2)), F.lit(0.0)).alias("f3"), "valid")


@query("""WITH e AS (SELECT vec_id, [list_position([CAST(embedding[c * 16 + i + 1] AS DOUBLE) for c in range(4)], list_max([CAST(embedding[c * 16 + i + 1] AS DOUBLE) for c in range(4)])) - 1 for i in range(16)] AS m FROM embeddings),
x AS (SELECT vec_id, unnest(m) AS class FROM e)
SELECT vec_id, CAST(class AS INTEGER) AS class, count(*) AS pixels, count(*) / 16 AS fraction FROM x GROUP BY ALL""")
def vi_class_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as class maps of four planes of sixteen pixels."""
    d = table(spark, sf_dir, "embeddings").select("vec_id", vision.class_map(F.col("embedding").cast("array<double>"), 4, 16).alias("classes"))
    return vision.class_shares(d, ["vec_id"], "classes").select("vec_id", "class", "pixels", "fraction")


@query("""WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings), i AS (SELECT vec_id, v, g, [k for k in range(16) if v[g * 16 + k + 1] > 0.05] AS inside FROM e, range(4) t(g))
SELECT vec_id, CAST(g AS INTEGER) AS instance, len(inside) AS area, list_min([k % 4 for k in inside]) AS min_x, list_max([k // 4 for k in inside]) AS max_y, len(inside) / 16 AS fraction FROM i WHERE len(inside) > 0""")
def vi_instance_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.array(*[F.slice(v, g * 16 + 1, 16) for g in range(4)]).alias("masks"))
    return vision.instance_masks(d, ["vec_id"], "masks", 4, 0.05).select("vec_id", "instance", "area", F.col("min_x").cast("long").alias("min_x"), F.col("max_y").cast("long").alias("max_y"), "fraction")


@query("""WITH RECURSIVE e AS (SELECT vec_id, CAST(vec_id // 16 AS BIGINT) AS map, embedding FROM embeddings),
p AS (SELECT map, vec_id % 4 * 8 + k % 8 AS x, vec_id % 16 // 4 * 8 + k // 8 AS y, CAST(embedding[k + 1] AS DOUBLE) AS v FROM e, range(64) r(k) WHERE embedding[k + 1] > 0.08),
r AS (SELECT map, x, y, y * 32 + x AS root FROM p UNION SELECT p.map, p.x, p.y, r.root FROM r JOIN (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) d(dx, dy) ON true JOIN p ON p.map = r.map AND p.x = r.x + dx AND p.y = r.y + dy),
g AS (SELECT map, x, y, min(root) AS root FROM r GROUP BY ALL)
SELECT map, count(*) AS area, round(max(v), 6) AS peak, CAST(min(x) AS BIGINT) AS min_x, CAST(min(y) AS BIGINT) AS min_y, CAST(max(x) AS BIGINT) AS max_x, CAST(max(y) AS BIGINT) AS max_y FROM g JOIN p USING (map, x, y) GROUP BY map, root""")
def vi_tiled_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as tiles of 8 x 8, sixteen to a map."""
    i = F.col("vec_id")
    d = table(spark, sf_dir, "embeddings").select(F.floor(i / 16).cast("long").alias("map"), (i % 4 * 8).cast("long").alias("x0"), (F.floor(i % 16 / 4) * 8).cast("long").alias("y0"), F.lit(8).alias("width"), "embedding")
    return vision.tiled_regions(d, ["map"], "embedding", 0.08).withColumn("peak", F.round("peak", 6))



@query("""WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings), p AS (SELECT vec_id, v, [v[2 * k + 1] for k in range(32)] AS x, [v[2 * k + 2] for k in range(32)] AS y FROM e)
SELECT vec_id, round(abs(list_sum([x[k + 1] * y[(k + 1) % 32 + 1] - x[(k + 1) % 32 + 1] * y[k + 1] for k in range(32)])) / 2, 6) AS area,
  round(list_sum([sqrt(pow(x[(k + 1) % 32 + 1] - x[k + 1], 2) + pow(y[(k + 1) % 32 + 1] - y[k + 1], 2)) for k in range(32)]), 6) AS perimeter,
  CAST(len([k for k in range(21) if v[3 * k + 3] >= 0.1]) AS INTEGER) AS keypoints, list_max(v) AS top, round(list_avg(v), 6) + 0.0 AS mean FROM p""")
def vi_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as polygons of 32 points, as 21 keypoints and as heat maps."""
    v = F.col("embedding").cast("array<double>")
    points = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct(F.get(v, 2 * k).alias("x"), F.get(v, 2 * k + 1).alias("y")))
    d = table(spark, sf_dir, "embeddings").select("vec_id", vision.polygon(points).alias("p"), vision.visible_keypoints(v, 0.1).alias("keypoints"), vision.heatmap(v).alias("h"))
    return d.select("vec_id", F.round("p.area", 6).alias("area"), F.round("p.perimeter", 6).alias("perimeter"), "keypoints", F.col("h.max").alias("top"), (F.round("h.mean", 6) + F.lit(0.0)).alias("mean"))


@query("""WITH t AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_custkey || 'abc' WHEN 1 THEN ' ' || c_acctbal WHEN 2 THEN 'n/a' WHEN 3 THEN '1e3' ELSE '' END AS text FROM customer)
SELECT c_custkey, TRY_CAST(trim(text) AS DOUBLE) AS strict, CASE c_custkey % 5 WHEN 0 THEN CAST(c_custkey AS DOUBLE) WHEN 1 THEN CAST(trim(text) AS DOUBLE) WHEN 3 THEN 1000.0 END AS lenient FROM t""")
def st_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in text: whole texts, and what a text begins with."""
    from condmon.functions import parsing

    k = F.col("c_custkey")
    text = F.when(k % 5 == 0, F.concat(k.cast("string"), F.lit("abc"))).when(k % 5 == 1, F.concat(F.lit(" "), F.col("c_acctbal").cast("string"))).when(k % 5 == 2, "n/a").when(k % 5 == 3, "1e3").otherwise("")
    return table(spark, sf_dir, "customer").select("c_custkey", parsing.strict_number(text).alias("strict"), parsing.lenient_number(text).alias("lenient"))
