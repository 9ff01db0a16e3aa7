"""Further registered queries: parsing, per-value analysis, time to a threshold, motor spectra, boxes, regions, tracking figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condmon.config import AnomalySettings, TrendSettings
from condmon.functions import parsing, stats
from condmon.operators import analyst, anomaly, dataset, features, health, inference, multivalue, signal, trend, vision
from condmon.plans.catalogue import DAYS, KEYS, LONG, ORDER, ZSCORE, R, _day, _year, _health, _health_sql, _items, _r, _w, daily, frames, query, readings, table

# Statistics and parsing ------------------------------------------------------------


@query("SELECT event_type AS series_id, round(var_pop(value), 4) AS variance, round(var_pop(value) FILTER (value > 50), 4) AS upper FROM events GROUP BY 1")
def st_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("value")
    out = readings(spark, sf_dir).groupBy("series_id").agg(stats.variance(x).alias("variance"), stats.variance(F.when(x > 50, x)).alias("upper"))
    return out.select("series_id", _r("variance", 4), _r("upper", 4))


@query("""WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings)
SELECT vec_id, CAST(k - 1 AS INTEGER) AS i, round(list_reduce(v[:k], lambda s, x: 0.3 * x + (1 - 0.3) * s), 9) + 0.0 AS ema, round(list_avg(v[greatest(1, k - 4):k]), 9) + 0.0 AS average FROM e, range(1, 65) t(k)""")
def st_smoothed_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential and moving averages within an array."""
    v = F.col("embedding").cast("array<double>")
    both = F.arrays_zip(stats.ema_series(v, 0.3).alias("ema"), stats.moving_average(v, 5).alias("average"))
    out = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(both).alias("i", "z"))
    return out.select("vec_id", "i", F.col("z.ema").alias("ema"), F.col("z.average").alias("average")).select("vec_id", "i", _r("ema", 9), _r("average", 9))


@query("""SELECT c_custkey, 'balance' AS series_id, CAST(c_acctbal AS DOUBLE) AS value FROM customer UNION ALL SELECT c_custkey, 'key', CAST(c_custkey AS DOUBLE) FROM customer UNION ALL SELECT c_custkey, 'word', NULL FROM customer""")
def ad_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects of numbers and numeric text as one reading a sensor."""
    text = F.concat(F.lit('{"balance": '), F.col("c_acctbal").cast("string"), F.lit(', "key": "'), F.col("c_custkey").cast("string"), F.lit('kg", "word": "n/a"}'))
    return parsing.records_to_readings(table(spark, sf_dir, "customer").select("c_custkey", parsing.parse_object(text).alias("sensors")))


@query("""SELECT user_id, CAST(ts AS DATE) AS day, event_type AS series_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2, 3""")
def hi_named_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named readings of a user's day as a map, the last of equal names counts."""
    listed = F.array_sort(F.collect_list(F.struct("ts", "event_id", F.col("event_type").alias("name"), "value")))
    days = table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(listed.alias("l"))
    return parsing.records_to_readings(days.select("user_id", "day", parsing.named_to_map(F.col("l")).alias("sensors")))


@query("""WITH v AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST('nan' AS DOUBLE) WHEN 2 THEN CAST('inf' AS DOUBLE) ELSE 1.5 END AS x, c_name || ' / ' || c_mktsegment AS name FROM customer)
SELECT c_custkey, c_custkey % 4 = 3 AS valid, CASE c_custkey % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'not a number' WHEN 2 THEN 'infinite' END AS reason, left(regexp_replace(name, '[^A-Za-z0-9_.-]', '_', 'g'), 64) AS key FROM v""")
def sr_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with the reason why they don't count, and names fit for keys."""
    k = F.col("c_custkey")
    x = F.when(k % 4 == 1, float("nan")).when(k % 4 == 2, float("inf")).when(k % 4 == 3, 1.5)
    d = table(spark, sf_dir, "customer").select("c_custkey", x.alias("value"), parsing.safe_key(F.concat("c_name", F.lit(" / "), "c_mktsegment")).alias("key"))
    return parsing.validated(d).select("c_custkey", "valid", "reason", "key")


@query(ZSCORE.format(high=3.0, low=2.0) + " SELECT series_id, seq, CASE WHEN coalesce(severity <> 'normal', false) THEN 1 ELSE 0 END AS output FROM v")
def ad_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two outputs of a detector, numbered 0 (normal) and 1 (anomalous)."""
    verdicts = anomaly.detect(readings(spark, sf_dir), AnomalySettings(hysteresis=False), KEYS, ORDER, bucket=_day())
    normal, anomalous = parsing.route(verdicts)
    return normal.withColumn("output", F.lit(0)).unionByName(anomalous.withColumn("output", F.lit(1))).select("series_id", "seq", "output")


@query("""WITH s AS (SELECT event_type AS series_id, event_id AS seq, CAST(sum(CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM events)
SELECT series_id, segment, count(*) AS n, min(seq) AS first_seq FROM s GROUP BY ALL""")
def ad_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resets cut a series into segments."""
    r = readings(spark, sf_dir).withColumn("reset", F.col("seq") % 97 == 0)
    return parsing.segments(r, KEYS, ORDER, bucket=_day()).groupBy("series_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


# Per-value analysis ----------------------------------------------------------------


@query(f"""WITH {R}, b AS (SELECT *, list_sort(list(value) OVER ({_w(100)})) AS l FROM r),
q AS (SELECT *, len(l) AS n, l[CAST(floor(len(l) * 0.25) AS INTEGER) + 1] AS q1, l[CAST(floor(len(l) * 0.75) AS INTEGER) + 1] AS q3 FROM b)
SELECT series_id, seq, CASE WHEN n >= 4 THEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) END AS is_anomaly FROM q""")
def mv_analyze_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set multiplier of 3 has no effect in this mode."""
    s = AnomalySettings(method="iqr", iqr_multiplier=3.0)
    return multivalue.analyze(readings(spark, sf_dir), s, KEYS, ORDER, bucket=_day()).select("series_id", "seq", "is_anomaly")


@query("SELECT event_type AS series_id, event_id AS seq, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) >= 2 THEN value < 2 OR value > 60 END AS is_anomaly FROM events")
def mv_analyze_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = AnomalySettings(method="threshold", min_threshold=2.0, max_threshold=60.0)
    return multivalue.analyze(readings(spark, sf_dir), s, KEYS, ORDER, bucket=_day()).select("series_id", "seq", "is_anomaly")


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, list_sort([CAST(l_quantity AS DOUBLE), CAST(l_discount AS DOUBLE), CAST(l_tax AS DOUBLE)]) AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, round(v[2], 6) AS median, round(v[3] - v[1], 6) AS range, round(list_avg(v), 6) AS other FROM i""")
def mv_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen aggregate of a record; an unknown method is the mean."""
    a = _items(spark, sf_dir).withColumn("a", multivalue.aggregate(F.col("v")))
    made = [multivalue.primary(F.col("a"), m).alias(n) for n, m in (("median", "median"), ("range", "range"), ("other", "mode"))]
    return a.select("l_orderkey", "l_linenumber", *made).select("l_orderkey", "l_linenumber", _r("median"), _r("range"), _r("other"))


# Trends and health -----------------------------------------------------------------


@query(f"""WITH {DAYS}, b AS (SELECT *, list(value) OVER w AS l, (max(epoch_ms(CAST(day AS TIMESTAMP))) OVER w - min(epoch_ms(CAST(day AS TIMESTAMP))) OVER w) / nullif(count(*) OVER w - 1, 0) AS gap
  FROM d WINDOW w AS (PARTITION BY series_id ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
f AS (SELECT series_id, day, gap, len(l) AS c, list_reduce(list_prepend({{'level': l[1], 'slope': l[2] - l[1], 'x': 0.0}}, list_transform(l[2:], lambda v: {{'level': 0.0, 'slope': 0.0, 'x': v}})),
  lambda s, v: {{'level': 0.3 * v.x + 0.7 * (s.level + s.slope), 'slope': 0.1 * (0.3 * v.x + 0.7 * (s.level + s.slope) - s.level) + 0.9 * s.slope, 'x': 0.0}}) AS h FROM b),
k AS (SELECT series_id, day, gap, CASE WHEN c >= 3 THEN list_position([h.level + h.slope * k >= 300000 for k in range(1, 13)], true) END AS steps FROM f)
SELECT series_id, day, CAST(nullif(steps, 0) AS BIGINT) AS steps, round(nullif(steps, 0) * gap, 3) AS ms FROM k""")
def tp_steps_to_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trend.holt(daily(spark, sf_dir), TrendSettings(window=20, steps=12, threshold=300_000.0), KEYS, ["day"], bucket=_year())
    return out.select("series_id", "day", F.col("steps_to_threshold").alias("steps"), F.round("time_to_threshold_ms", 3).alias("ms"))


@query(_health_sql("avg(score)").replace("round(health, 6) AS health", "round(health / 100, 8) AS health"))
def hi_unit_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _health(spark, sf_dir, "average")
    return h.select("day", health.rescale(F.col("health"), True).alias("health"), "status", "worst_sensor").withColumn("health", F.round("health", 8))


# Signals and machine features ------------------------------------------------------


@query("""WITH f AS (SELECT user_id, sqrt(avg(value * value)) AS rms FROM events GROUP BY 1)
SELECT user_id, round(rms, 6) AS mm_s, round(rms * 1000, 4) AS m_s, round(rms * 9810 / (2 * pi() * 25), 5) AS g, round(rms * 1000 / (2 * pi() * 50), 6) AS m_s2, CAST(NULL AS DOUBLE) AS raw FROM f""")
def sa_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Velocities of accelerations and speeds in several units; without a speed of rotation 50 Hz are taken."""
    rms = F.col("rms")
    v = table(spark, sf_dir, "events").groupBy("user_id").agg(stats.rms(F.col("value")).alias("rms"))
    made = {"mm_s": (signal.velocity(rms, "mm_s"), 6), "m_s": (signal.velocity(rms, "m_s"), 4), "g": (signal.velocity(rms, "g", 1500.0), 5), "m_s2": (signal.velocity(rms, "m_s2"), 6)}
    return v.select("user_id", *[F.round(c, n).alias(k) for k, (c, n) in made.items()], signal.velocity(rms, "raw").alias("raw"))


SPECTRUM = "p AS (SELECT series_id, frame, b, sqrt(pow(sum(value * cos(2 * pi() * b * k / 256)), 2) + pow(sum(value * sin(2 * pi() * b * k / 256)), 2)) / 256 AS m FROM y, range(128) r(b) GROUP BY series_id, frame, b)"


@query(f"""WITH {LONG}, {SPECTRUM}, k AS (SELECT series_id, frame, sqrt(avg(value * value)) AS rms FROM y GROUP BY ALL),
a AS (SELECT series_id, frame, 2 * any_value(m) FILTER (b = 13) AS base, sqrt(sum(m * m * CASE WHEN b = 127 THEN 2 ELSE 1 END) FILTER (b IN (38, 64, 90, 115, 127))) AS odd FROM p GROUP BY ALL)
SELECT series_id, CAST(frame AS BIGINT) AS frame, round(rms, 6) AS phase_rms, round(base, 6) AS fundamental, round(odd / base, 6) AS "THD" FROM a JOIN k USING (series_id, frame)""")
def fe_motor_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase figures of frames as currents; harmonics over the highest frequency count at its bin."""
    return features.motor_current(frames(spark, sf_dir)).select("series_id", "frame", _r("phase_rms"), _r("fundamental"), _r("THD"))


@query(f"""WITH {LONG}, {SPECTRUM}, k AS (SELECT series_id, frame, sqrt(avg(value * value)) AS rms, max(abs(value)) AS peak FROM y GROUP BY ALL)
SELECT series_id, CAST(frame AS BIGINT) AS frame, round(any_value(peak) / any_value(rms), 6) AS crest, round(arg_max(b, m) * 1000.0 / 256, 6) AS dominant_frequency,
  round(sum(m * m) FILTER (b * 1000.0 / 256 < 100) / sum(m * m), 6) AS band_0_100, round(sum(m * m) FILTER (b * 1000.0 / 256 >= 100) / sum(m * m), 6) AS band_100_500 FROM p JOIN k USING (series_id, frame) GROUP BY ALL""")
def fe_motor_vibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.motor_vibration(frames(spark, sf_dir))
    return out.select("series_id", "frame", _r("crest"), _r("dominant_frequency"), _r("band_0_100"), _r("band_100_500"))


@query("""WITH p AS (SELECT l_suppkey, CAST(l_quantity AS DOUBLE) AS power, CAST(l_extendedprice AS DOUBLE) AS air, 54 + CAST(l_discount AS DOUBLE) * 100 AS supply FROM lineitem),
w AS (SELECT l_suppkey, CASE WHEN power * 1000 / (air + 1) > 1.2 THEN (power * 1000 / (air + 1) - 1) * air / 1000 ELSE 0 END + CASE WHEN supply > 57 THEN (supply - 55) * air * 1.08 / 12000 ELSE 0 END AS kw FROM p)
SELECT l_suppkey, round(avg(kw), 6) AS mean_kw, round(sum(kw), 3) AS sum_kw FROM w GROUP BY 1""")
def fe_energy_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    power, air = F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double")
    d = table(spark, sf_dir, "lineitem").select("l_suppkey", air.alias("airflow"), (54 + F.col("l_discount").cast("double") * 100).alias("supply_temp"), (power * 1000 / (air + 1)).alias("specific_fan_power"))
    out = features.waste_summary(d.withColumn("energy_waste_kw", features.energy_waste(d)), ["l_suppkey"])
    return out.select("l_suppkey", _r("mean_kw"), _r("sum_kw", 3))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS a, CAST(l_tax AS DOUBLE) * 100 AS b, CAST(l_discount AS DOUBLE) * 100 AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, round((greatest(a, b, c) - least(a, b, c)) / ((a + b + c) / 3), 6) AS imbalance FROM p""")
def fe_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = F.col("l_quantity").cast("double"), F.col("l_tax").cast("double") * 100, F.col("l_discount").cast("double") * 100
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(features.imbalance(a, b, c), 6).alias("imbalance"))


# Datasets --------------------------------------------------------------------------


@query(" UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg(v), 4) AS mean, round(CASE WHEN stddev_pop(v) = 0 THEN 1 ELSE stddev_pop(v) END, 4) AS scale, round(var_pop(v), 3) AS var FROM (SELECT CAST({c} AS DOUBLE) AS v FROM lineitem)" for f, c in (("quantity", "l_quantity"), ("tax", "l_tax"), ("one", "1"))))
def fe_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(F.array(F.col("l_quantity").cast("double"), F.col("l_tax").cast("double"), F.lit(1.0)).alias("values"))
    return dataset.scaler(d, ["quantity", "tax", "one"]).select("feature", _r("mean", 4), _r("scale", 4), _r("var", 3))


@query("""SELECT event_id, strftime(date_trunc('milliseconds', ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS unix, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS unix_ms FROM events""")
def td_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", *[dataset.timestamp(F.col("ts"), s).alias(s) for s in ("iso", "unix", "unix_ms")])


@query("""WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, n, 1 AS parts FROM u""")
def fe_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's rows are in one part."""
    out = dataset.group_split(table(spark, sf_dir, "events"), "user_id", 0.8, 3)
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").cast("int").alias("parts"))


# Inference and vision ---------------------------------------------------------------


@query("""WITH e AS (SELECT vec_id % 4 AS part, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings), p AS (SELECT part, v, list_sum(v) AS p FROM e)
SELECT part, count(*) AS rows, round(avg(p), 6) AS prediction_mean, round(max(p), 6) AS prediction_max, round(min(p), 6) AS prediction_min, round(avg(list_avg(v)), 8) AS input_mean, max(list_max(v)) AS input_max, min(list_min(v)) AS input_min,
  round(sqrt(sum(list_sum([x * x for x in v])) / (64 * count(*)) - pow(avg(list_avg(v)), 2)), 6) AS input_std, CAST(count(*) FILTER (p > 0.5) AS BIGINT) AS anomalies FROM p GROUP BY part""")
def ml_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracking figures of predictions and inputs."""
    v = F.col("embedding").cast("array<double>")
    d = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 4).alias("part"), v.alias("features"), F.array(stats.array_sum(v)).alias("prediction"))
    out = inference.metrics(d, keys=["part"])
    return out.select("part", "rows", _r("prediction_mean"), _r("prediction_max"), _r("prediction_min"), _r("input_mean", 8), "input_max", "input_min", _r("input_std"), "anomalies")


@query("""SELECT c_custkey, [CAST(c_acctbal AS DOUBLE), CAST(c_nationkey AS DOUBLE), CAST(0 AS DOUBLE)][1] AS a, CAST(c_nationkey AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS c, CAST(c_custkey AS DOUBLE) AS nested, CAST(c_nationkey AS DOUBLE) AS known FROM customer""")
def ml_input_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of models from structs, nested arrays and structs with a field of features."""
    bal, nation, key = F.col("c_acctbal").cast("double"), F.col("c_nationkey"), F.col("c_custkey")
    d = table(spark, sf_dir, "customer").select(
        "c_custkey", F.struct(bal.alias("p"), nation.cast("string").alias("q"), F.lit("n/a").alias("r")).alias("s"), F.array(F.array(key.cast("double"))).alias("n"), F.struct(key.alias("id"), F.array(nation).alias("features")).alias("k")
    )
    out = inference.input_vector(inference.input_vector(inference.input_vector(d, "s", "sv"), "n", "nv"), "k", "kv")
    return out.select("c_custkey", *[F.col("sv")[i].alias(n) for i, n in enumerate("abc")], F.col("nv")[0].alias("nested"), F.col("kv")[0].alias("known"))


BOXES = """e AS (SELECT vec_id, [abs(CAST(x AS DOUBLE)) * 4 for x in embedding] AS v FROM embeddings), b AS (SELECT vec_id, i, v[i * 6 + 1] AS cx, v[i * 6 + 2] AS cy, v[i * 6 + 3] AS w, v[i * 6 + 4] AS h, v[i * 6 + 5] AS score, v[i * 6 + 6] AS class FROM e, range(10) t(i))"""


@query(f"WITH {BOXES} SELECT vec_id, round(2 * cx, 6) AS x1, round(3 * cy, 6) AS y1, round(2 * w, 6) AS x2, round(3 * h, 6) AS y2, round(score, 6) AS score, CAST(round(class) AS INTEGER) AS class FROM b WHERE score >= 0.5")
def vi_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes by their corners, scaled, over a score."""
    flat = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.abs(v) * 4)
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(vision.boxes(flat, 6, "xyxy", 0.5, 2.0, 3.0)).alias("b")).select("vec_id", "b.*")
    return d.select("vec_id", *[_r(c) for c in ("x1", "y1", "x2", "y2", "score")], "class")


@query("""WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings), c AS (SELECT vec_id, v, k, CASE WHEN k IN (0, 3) THEN -1 ELSE 1 END AS a, CASE WHEN k < 2 THEN -1 ELSE 1 END AS b FROM e, range(4) t(k))
SELECT vec_id, CAST(k AS INTEGER) AS corner, round(v[1] + a * v[3] / 2 * cos(v[5]) - b * v[4] / 2 * sin(v[5]), 8) + 0.0 AS x, round(v[2] + a * v[3] / 2 * sin(v[5]) + b * v[4] / 2 * cos(v[5]), 8) + 0.0 AS y FROM c""")
def vi_rotated_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vision.rotated_corners(*[v[i] for i in range(5)])).alias("corner", "p")).select("vec_id", "corner", "p.*")
    return d.select("vec_id", "corner", _r("x", 8), _r("y", 8))


@query("""WITH RECURSIVE e AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings), cells AS (SELECT vec_id, i, i % 8 AS x, i // 8 AS y, v[i + 1] AS s FROM e, range(64) t(i) WHERE v[i + 1] > 0.05),
edges AS (SELECT a.vec_id, a.i, b.i AS j FROM cells a JOIN cells b ON a.vec_id = b.vec_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
reach AS (SELECT vec_id, i, i AS j FROM cells UNION SELECT r.vec_id, r.i, e.j FROM reach r JOIN edges e ON e.vec_id = r.vec_id AND e.i = r.j),
named AS (SELECT vec_id, i, min(j) AS region FROM reach GROUP BY ALL)
SELECT vec_id, CAST(count(*) AS INTEGER) AS area, max(s) AS peak, CAST(min(x) AS INTEGER) AS min_x, CAST(min(y) AS INTEGER) AS min_y, CAST(max(x) AS INTEGER) AS max_x, CAST(max(y) AS INTEGER) AS max_y,
  any_value(whole) / 64 AS fraction FROM named JOIN cells USING (vec_id, i) JOIN (SELECT vec_id, count(*) AS whole FROM cells GROUP BY 1) USING (vec_id) GROUP BY vec_id, region""")
def vi_anomaly_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as score maps of eight by eight pixels."""
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("scores"))
    return vision.anomaly_map(d, "scores", 8, 0.05).select("vec_id", "fraction", F.explode("regions").alias("r")).select("vec_id", "r.*", "fraction")


# Batches of language-model input ----------------------------------------------------


@query("""WITH b AS (SELECT event_type AS series_id, event_id AS seq, value, CAST(floor(epoch_us(ts) / 14400000000) AS BIGINT) AS batch, row_number() OVER (PARTITION BY event_type, floor(epoch_us(ts) / 14400000000) ORDER BY ts DESC, event_id DESC) <= 8 AS kept FROM events)
SELECT series_id, batch, count(*) AS seen, count(*) FILTER (kept) AS count, round(avg(value) FILTER (kept), 6) AS mean, max(value) FILTER (kept) AS max FROM b GROUP BY ALL""")
def ll_timed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches by an interval of four hours, of which a buffer of eight keeps the newest."""
    b = analyst.timed_batches(readings(spark, sf_dir), KEYS, ORDER, 14_400, 8)
    x = F.when(F.col("kept"), F.col("value"))
    return b.groupBy("series_id", "batch").agg(F.count(F.lit(1)).alias("seen"), F.count(x).alias("count"), F.round(F.avg(x), 6).alias("mean"), F.max(x).alias("max"))
