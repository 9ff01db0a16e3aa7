"""Golden vectors of the other operators."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from condmon.config import AnomalySettings, HealthSettings, SignalSettings, TrendSettings
from condmon.functions import folds, parsing, stats
from condmon.operators import analyst, dataset, features, health, inference, multivalue, multivariate, signal, trend, vision


def one(spark, column, rows="select 1 as x"):
    return spark.sql(rows).select(column.alias("v")).first()["v"]


def test_statistics(spark):
    x = [2, 4, 4, 4, 5, 5, 7, 9]
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    v = F.col("v")
    r = df.agg(stats.mean(v).alias("m"), stats.stddev(v).alias("sd"), stats.variance(v).alias("var"), stats.stddev_sample(v).alias("ss"), stats.median(v).alias("med"), stats.quartiles(stats.values(v)).alias("q"), stats.skewness(v).alias("sk"), stats.kurtosis(v).alias("ku")).first()
    z = (np.array(x) - 5) / 2
    n = 8
    assert (r.m, r.sd, r.var, r.med) == (5, 2, 4, 4.5) and r.ss == pytest.approx(math.sqrt(32 / 7))
    assert tuple(r.q) == (4.0, 5.0, 7.0)
    assert r.sk == pytest.approx(n / (7 * 6) * (z**3).sum())
    assert r.ku == pytest.approx(n * 9 / (7 * 6 * 5) * (z**4).sum() - 3 * 49 / (6 * 5))
    assert spark.createDataFrame([], "v double").agg(stats.stddev(v).alias("sd")).first().sd == 0


def test_array_statistics(spark):
    a = F.array(*[F.lit(float(v)) for v in (1, 2, 3, 4, 5)])
    assert one(spark, stats.moving_average(a, 3)) == [1, 1.5, 2, 3, 4]
    assert one(spark, stats.ema_series(a, 0.5)) == [1, 1.5, 2.25, 3.125, 4.0625]
    assert one(spark, stats.array_median(a)) == 3 and one(spark, stats.array_rms(a)) == pytest.approx(math.sqrt(11))


def test_parsing(spark):
    df = spark.createDataFrame([("12abc",), (" 3.5e1 ",), ("x",), (None,), ("-.5",)], "t string")
    rows = df.select(parsing.strict_number(F.col("t")).alias("s"), parsing.lenient_number(F.col("t")).alias("l")).collect()
    assert [r.s for r in rows] == [None, 35.0, None, None, -0.5]
    assert [r.l for r in rows] == [12.0, 35.0, None, None, -0.5]


def test_signal_kernels():
    t = np.arange(256) / 1000
    f, m = signal.spectrum(np.sin(2 * np.pi * 50 * t), 1000, "hann")
    assert abs(f[signal.spectral_peaks(f, m, 0.1)[0]] - 50) < 7.8
    f, m = signal.spectrum(np.sin(2 * np.pi * 8 * np.arange(64) / 64), 64, "rectangular")
    assert f[m.argmax()] == 8 and m.max() == pytest.approx(0.5)
    x = np.sin(2 * np.pi * 5 * np.arange(400) / 400)
    assert signal.periodicity(np.ones(3)) is None and signal.autocorrelation(x)[0] == pytest.approx(1)
    assert signal.sample_entropy(np.tile([1.0, 2.0], 50)) == pytest.approx(0.0, abs=0.05)
    assert signal.autocorrelation(np.ones(9)).size == 0
    mixed = np.sin(2 * np.pi * 20 * np.arange(1000) / 1000) + np.sin(2 * np.pi * 200 * np.arange(1000) / 1000)
    kept = signal.band_pass(mixed, 1000, 100, 300)
    assert np.abs(np.fft.rfft(kept))[200] > 20 * np.abs(np.fft.rfft(kept))[20]


def test_vibration_and_iso(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [3, -4] * 8], "k string, value double")
    r = signal.vibration(df, ["k"]).first()
    assert r.rms == pytest.approx(3.53553, abs=1e-5) and (r.peak, r.peak_to_peak) == (4, 7)
    assert r.kurtosis == pytest.approx(-2) and r.skewness == pytest.approx(0, abs=1e-9)
    z = signal.iso_zone(spark.createDataFrame([(10.6,), (None,), (1.0,)], "v double"), "v").collect()
    assert [x.zone for x in z] == ["D", "N/A", "A"] and z[0].zone_severity == "critical"


def test_frames(spark):
    x = np.sin(2 * np.pi * 50 * np.arange(256) / 1000)
    df = spark.createDataFrame([("a", x.tolist(), 1000.0), ("b", None, 1000.0), ("c", [1.0, float("nan")], 1000.0)], "series_id string, samples array<double>, sampling_rate double")
    rows = {r.series_id: r for r in signal.fft(df, SignalSettings()).collect()}
    assert abs(rows["a"].dominant_frequency - 50) < 7.8 and rows["b"].peaks is None and rows["c"].peaks is None
    s = SignalSettings(low_hz=20, high_hz=200)
    found = signal.match_faults(signal.envelope_spectrum(df, s), signal.fault_table(spark, {"1X": 100.0}), s, ["series_id"])
    assert found.columns[-1] == "severity"
    assert signal.cepstral(df, s).where("cepstrum is not null").count() == 1


def test_multivalue(spark):
    df = spark.createDataFrame([(1, [10.0, 20.0, 30.0])], "id int, v array<double>")
    a = df.select(multivalue.aggregate(F.col("v")).alias("a")).first().a
    assert (a.mean, a.sum, a.range, a.min, a.max) == (20, 60, 20, 10, 30)
    assert multivalue.split(df, "v", ["id"]).count() == 3
    pairs = spark.createDataFrame([("a", i, float(i), 2.0 * i + 1) for i in range(1, 21)], "k string, seq int, x double, y double")
    for method in ("pearson", "spearman"):
        last = multivalue.correlate(pairs, ["k"], ["seq"], "x", "y", 100, method).orderBy(F.desc("seq")).first()
        assert last.correlation == pytest.approx(1) and not last.is_anomalous
    wave = spark.createDataFrame([("a", i, math.sin(0.5 * i), math.sin(0.5 * (i - 2))) for i in range(20)], "k string, seq int, x double, y double")
    assert multivalue.cross_correlation(wave, ["k"], ["seq"], "x", "y").where("best").first().lag == 2


def test_mahalanobis_forms_agree(spark):
    rng = np.random.default_rng(2)
    rows = [("a", i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (40, 2)))]
    df = spark.createDataFrame(rows, "k string, seq int, x double, y double")
    flat = multivalue.mahalanobis_2d(df, ["k"], ["seq"], "x", "y", 20).orderBy("seq").collect()
    full = multivalue.mahalanobis(df.withColumn("v", F.array("x", "y")), ["k"], ["seq"], "v", 20).orderBy("seq").collect()
    assert [r.distance for r in flat[:9]] == [None] * 9
    assert [r.distance for r in flat[9:]] == pytest.approx([r.distance for r in full[9:]], rel=1e-6)


def test_forest_and_components():
    out = folds.step_all(multivariate.IsolationFold(), {"value": [50 + 0.01 * i for i in range(40)] + [500.0]})
    assert out["is_anomaly"][-1] and out["score"][-1] >= out["threshold"][-1]
    rows = [[float(i), float(i)] for i in range(1, 41)] + [[20.0, -20.0]]
    out = folds.step_all(multivariate.PcaFold(window=20, method="combined"), {"vector": rows})
    assert out["is_anomaly"][-1] and out["t2"][-1] == pytest.approx(3.3, abs=0.01) and out["spe"][-1] == pytest.approx(96.97, abs=0.01)
    assert out["t2_limit"][-1] == pytest.approx(2.2091, abs=1e-3)


def test_mahalanobis_of_batches():
    rng = np.random.default_rng(3)
    vectors = [[float(v) for v in r] for r in rng.normal(0, 1, (70, 3))]
    vectors[20], vectors[33], vectors[41] = None, [1.0, float("nan"), 0.0], [1.0]
    fold = multivalue.Mahalanobis(25)
    whole, state = folds.step_all(fold, {"vector": vectors}), fold.start()
    parts = [fold.step(state, {"vector": vectors[i : i + 9]}) for i in range(0, 70, 9)]
    assert [v for p in parts for v in p["severity"]] == list(whole["severity"])
    held = []
    for v, got in zip(vectors, whole["distance"], strict=True):
        if v is None or len(v) != 3 or not np.isfinite(v).all():
            assert got is None
            continue
        held = [*held, v][-25:]
        if len(held) < 10:
            assert got is None
            continue
        c = np.cov(np.array(held), rowvar=False)
        c += np.eye(3) * max(1e-6, 1e-6 * c.diagonal().max())
        d = np.array(v) - np.mean(held, axis=0)
        assert got == pytest.approx(np.sqrt(d @ np.linalg.pinv(c) @ d))


def test_isolation_threshold_of_given_scores():
    """The training threshold holds until ten samples are scored; then the last scores decide, the present one among them; nothing is emptied."""
    fold = multivariate.IsolationFold(window=12, contamination=0.2)
    state = fold.start() | {"limit": 0.9}
    scores = [0.1 * (k % 7) + 0.01 * k for k in range(30)]
    for k, s in enumerate(scores):
        limit, flag = fold.judged(state, s)
        last = sorted(scores[max(0, k - 11) : k + 1], reverse=True)
        want = 0.9 if k < 9 else last[int(len(last) * 0.2)]
        assert limit == want and flag == (s >= want)
    assert fold.limit([0.0]) == 0.5 and fold.limit([0.7, 0.2]) == 0.7


@pytest.mark.parametrize("mode", ["batch", "incremental"])
def test_forest_scores_do_not_depend_on_batches(mode):
    values = [float(v) for v in np.random.default_rng(4).normal(50, 3, 90)]
    values[30] = None
    fold = lambda: multivariate.IsolationFold(window=40, trees=15, mode=mode, retrain=20)
    whole, one, state = folds.step_all(fold(), {"value": values}), fold(), fold().start()
    parts = [one.step(state, {"value": values[i : i + 7]}) for i in range(0, len(values), 7)]
    for name in whole:
        assert list(whole[name]) == [v for p in parts for v in p[name]]


@pytest.mark.parametrize("n", [3, 50, 51, 75, 100, 200])
def test_theil_sen_of_all_lengths(n):
    x = np.cumsum(np.random.default_rng(n).normal(0, 1, n))
    step = n // 25 if n > 50 else 1
    slopes = sorted((x[b] - x[a]) / (b - a) for a in range(0, n, step) for b in range(a + 1, n, step))
    assert trend.theil_sen(x) == slopes[len(slopes) // 2]


def test_rahmonics_and_severities(spark):
    c = np.zeros(120)
    c[5], c[8], c[20], c[40], c[110] = 2.0, -1.5, 0.5, 0.1, 1.0
    assert signal.rahmonics(c, 1000.0) == [(0.008, -1.5, 0.75), (0.02, 0.5, 0.25)]  # 5 only scales, 110 is out of band, 40 too small
    assert signal.rahmonics(np.zeros(120), 1000.0) == [] and signal.rahmonics(np.ones(4), 1000.0) == []
    item = "array<struct<frequency:double,magnitude:double,normalized:double>>"
    peaks = spark.createDataFrame([(1, [(100.0, 0.6, 1.0), (100.0, 0.5, 1.0), (100.0, 0.1, 1.0)])], f"frame int, peaks {item}")
    got = signal.match_faults(peaks, signal.fault_table(spark, {"1X": 100.0}, 1), SignalSettings(), ["frame"]).orderBy(F.desc("magnitude"))
    assert [r.severity for r in got.collect()] == ["high", "medium", "low"]
    gears = spark.createDataFrame([(1, [(40.0, 0.0, 0.6), (40.0, 0.0, 0.5), (40.0, 0.0, 0.25), (100.0, 0.0, 0.31), (100.0, 0.0, 0.3), (44.0, 0.0, 1.0)])], f"frame int, rahmonics {item}")
    table = signal.gear_table(spark, [4, 10], 600.0, 1)
    assert sorted((r.gear, r.fault, r.target) for r in table.collect()) == [(1, "gear_mesh", 40.0), (1, "sideband", 50.0), (2, "gear_mesh", 100.0), (2, "sideband", 110.0)]
    found = signal.match_gears(gears, table, ["frame"])
    assert sorted((r.gear, r.fault, r.normalized, r.severity) for r in found.collect()) == [
        (1, "gear_mesh", 0.25, "low"), (1, "gear_mesh", 0.5, "medium"), (1, "gear_mesh", 0.6, "high"),
        (2, "gear_mesh", 0.3, "medium"), (2, "gear_mesh", 0.31, "medium"), (2, "sideband", 0.3, "medium"), (2, "sideband", 0.31, "high"),
    ]
    verdict = signal.frame_verdict(gears.union(gears.withColumn("frame", F.lit(2))), found, ["frame"]).orderBy("frame").collect()
    assert [(r.fault_count, r.has_fault) for r in verdict] == [(7, True), (0, False)]


def test_dynamic_weights_scale_the_configured_ones(spark):
    rows = [("m", "a", i, 1.0, i % 2 == 0, 0.9) for i in range(20)] + [("m", "b", i, 1.0, False, 0.05) for i in range(20)]
    df = spark.createDataFrame(rows, "e string, sensor string, seq int, value double, is_anomaly boolean, confidence double")
    out = health.dynamic_weights(df, "e", ["seq"], HealthSettings(weights=(("a", 2.5),))).where("seq = 19")
    got = {r.sensor: r.weight for r in out.collect()}
    assert got["a"] == pytest.approx(2.5 * (1 - 0.2) * 0.9) and got["b"] == pytest.approx(0.1)


def test_reconstruction_error_uses_all_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (500, 2)) @ rng.normal(0, 1, (2, 5)) + rng.normal(0, 0.01, (500, 5))
    x[7] = x[7] + rng.normal(0, 3, 5)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [float("nan")] * 5)], "id int, v array<double>").repartition(7)
    out = {r.id: r for r in multivariate.reconstruction_error(df, "v").collect()}
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    value, axes = np.linalg.eigh(z.T @ z / len(z))
    k = int(np.searchsorted(np.cumsum(value[::-1]) / value.sum(), 0.95) + 1)
    a = axes[:, ::-1][:, :k]
    error = ((z - z @ a @ a.T) ** 2).mean(axis=1)
    assert len(out) == 500 and [out[i].error for i in range(500)] == pytest.approx(list(error), abs=1e-9)
    assert out[0].limit == pytest.approx(np.percentile(error, 95)) and out[7].is_anomaly
    assert multivariate.reconstruction_error(df.limit(0), "v").count() == 0
    for n in (1, 2, 37):
        some = spark.createDataFrame([(float(v),) for v in rng.integers(0, 9, n)], "x double")
        assert multivariate.exact_percentile(some, "x", 0.95) == pytest.approx(np.percentile([r.x for r in some.collect()], 95))


def test_contributors(spark):
    rows = [[float(i), 2.0 * i + (i % 3), float(i % 5)] for i in range(1, 41)] + [[20.0, -20.0, 3.0]]
    fold = multivariate.PcaFold(window=20, method="combined", share=0.6)
    out = folds.step_all(fold, {"vector": rows})
    m = multivariate.Components(np.array(rows[:10]), 0.6)
    last = {k: v[-1] for k, v in out.items()}
    assert last["original"] == [rows[-1][i] for i in last["contributor_index"]]
    assert last["reconstructed"] == pytest.approx(list(m.rebuilt(np.array([rows[-1]]))[0][last["contributor_index"]]))
    df = spark.createDataFrame([("a", i, r) for i, r in enumerate(rows)], "k string, seq int, v array<double>")
    named = multivariate.pca(df, ["k"], ["seq"], "v", ["x", "y", "z"], window=20, share=0.6).orderBy(F.desc("seq")).first()
    assert named.contributor_names == ["xyz"[i] for i in named.contributor_index]


def test_cross_correlation_in_blocks(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(0, 1, 203), rng.normal(0, 1, 203)
    df = spark.createDataFrame([("a", i, float(x[i]), float(y[i])) for i in range(203)] + [("b", i, 1.0, 2.0) for i in range(9)], "k string, seq int, x double, y double")
    got = {(r.k, r.lag): r.correlation for r in multivalue.cross_correlation(df, ["k"], ["seq"], "x", "y", block=16).collect()}
    dx, dy = x - x.mean(), y - y.mean()
    for lag in range(-50, 51):
        pairs = [dx[i] * dy[i + lag] for i in range(203) if 0 <= i + lag < 203]
        assert got["a", lag] == pytest.approx(np.mean(pairs) / (x.std() * y.std()))
    assert {v for (k, _), v in got.items() if k == "b"} == {0.0} and len(got) == 101 + 5


def test_split_and_parallel(spark):
    df = spark.createDataFrame([(1, {"a": 1.0, "b": 2.0}, [5.0], 7.0), (2, None, None, None), (3, {}, [], 1.0)], "id int, m map<string,double>, v array<double>, x double")
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(multivalue.split(df, "m", ["id"])) == [(1, "a", 0, 1.0, 2), (1, "b", 1, 2.0, 2)]
    assert rows(multivalue.split(df, "v", ["id"])) == [(1, "value0", 0, 5.0, 1)]
    assert [tuple(r) for r in multivalue.parallel(df, "m", ["id"]).collect()] == [(1, [1.0, 2.0], ["a", "b"], 2), (3, [], [], 0)]
    assert [tuple(r) for r in multivalue.parallel(df, "v", ["id"]).collect()] == [(1, [5.0], ["value0"], 1), (3, [], [], 0)]


def test_trend(spark):
    rows = [("a", i, 2.0 * i) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, seq int, value double").withColumn("ts", F.timestamp_seconds(F.col("seq")))
    r = trend.linear(df, TrendSettings(steps=5, threshold=23.0), ["k"], ["seq"]).orderBy(F.desc("seq")).first()
    assert r.slope == pytest.approx(2) and r.predictions == pytest.approx([20, 22, 24, 26, 28]) and r.trend == "increasing"
    assert r.steps_to_threshold == 3 and r.time_to_threshold_ms == 3000
    assert trend.rate_of_change(df, ["k"], ["seq"]).orderBy(F.desc("seq")).first().rate == pytest.approx(2)
    assert trend.acceleration(df, TrendSettings(), ["k"], ["seq"]).orderBy(F.desc("seq")).first().acceleration == pytest.approx(0)
    x, level, slope = [2.0 * i for i in range(10)], 0.0, 2.0
    for v in x[1:]:
        last, level = level, 0.3 * v + 0.7 * (level + slope)
        slope = 0.1 * (level - last) + 0.9 * slope
    r = trend.holt(df, TrendSettings(), ["k"], ["seq"]).orderBy(F.desc("seq")).first()
    assert (r.level, r.slope) == pytest.approx((level, slope))


def test_remaining_life(spark):
    hour = 3_600_000.0
    r = trend.remaining(np.array([50 + 5.0 * i for i in range(10)]), np.arange(10) * hour, 150.0)
    assert r["robust_slope"] == pytest.approx(4.166667, abs=1e-6) and r["line_slope"] == pytest.approx(4.055556, abs=1e-6)
    assert r["rul"] / hour == pytest.approx(14.516129, abs=1e-5) and r["lower"] / hour == pytest.approx(12.973270, abs=1e-5) and r["upper"] / hour == pytest.approx(16.058988, abs=1e-5)
    assert r["confidence"] == pytest.approx(0.962671, abs=1e-6)
    assert trend.remaining(np.ones(9), np.arange(9.0), 5.0)["status"] == "stable"
    assert trend.remaining(np.array([1, 2, 3, 4, 9.0]), np.arange(5.0), 5.0)["status"] == "failed"
    assert trend.remaining(np.array([1.0, 2]), np.arange(2.0), 5.0) is None
    up = np.array([1, 3, 2, 5, 4, 7, 6, 9, 8.5])
    assert trend.remaining(up, np.arange(9) * hour, 20.0, "weibull")["model"] == "weibull"
    assert trend.remaining(np.sort(up), np.arange(9) * hour, 20.0, "weibull")["model"] == "linear"


def test_health(spark):
    schema = "r string, sensor string, value double, is_anomaly boolean, z_score double, deviation_percent double, trend string, slope double, confidence double"
    df = spark.createDataFrame([("a", "temperature", 1.0, False, 0.0, 0.0, "stable", 0.0, 1.0), ("a", "vibration", 1.0, True, 0.0, 0.0, "stable", 0.0, 1.0)], schema)
    r = health.index(health.sensor_scores(df), ["r"], HealthSettings(weights=(("vibration", 3.0),))).first()
    assert r.health == 77.5 and r.status == "attention" and r.worst_sensor == "vibration"
    bad = spark.createDataFrame([("a", "bad", 1.0, True, 3.5, 0.0, "stable", 0.0, 1.0), ("a", "good", 1.0, None, None, None, None, None, None)], schema)
    r = health.index(health.sensor_scores(bad), ["r"], HealthSettings(aggregation="minimum")).first()
    assert r.health == 30 and r.status == "degraded" and r.is_bad
    t = spark.createDataFrame([("m", i, float(90 - 3 * i)) for i in range(12)], "e string, seq int, health double")
    got = [x.health_trend for x in health.trend(t, "e", ["seq"]).orderBy("seq").collect()]
    assert got[:2] == ["unknown", "unknown"] and got[-1] == "degrading"


def test_dataset(spark, tmp_path):
    df = spark.createDataFrame([("a", i, {"f1": str(i), "f2": f"{2 * i}kg"}) for i in range(10)], "k string, seq int, m map<string,string>")
    df = dataset.severity(dataset.label(dataset.features(df, ["f1", "f2", "f3"], "m"), "manual", "ok")).withColumn("ts", F.timestamp_seconds(F.col("seq")))
    s = {r.feature: r for r in dataset.feature_stats(df, ["f1", "f2", "f3"]).collect()}
    assert s["f2"].mean == 9 and s["f3"].max == 0 and s["f1"]["count"] == 10
    assert [r.label for r in dataset.rul_label(df, ["k"], ["seq"], 10).orderBy("seq").limit(3).collect()] == [9, 8, 7]
    assert dataset.windows(df, ["k"], ["seq"], 5).count() == 2
    assert {r.split: r["count"] for r in dataset.split(df, "seq").groupBy("split").count().collect()} == {"train": 7, "validation": 1, "test": 2}
    dataset.to_jsonl(df, str(tmp_path / "j"))
    dataset.to_csv(df, str(tmp_path / "c"), ["f1", "f2", "f3"])
    assert spark.read.json(str(tmp_path / "j")).count() == 10 and spark.read.csv(str(tmp_path / "c"), header=True).columns[1:4] == ["f1", "f2", "f3"]
    assert json.loads(dataset.document(df, "d", ["f1", "f2", "f3"]))["datasetInfo"]["samples"] == 10
    about = dataset.metadata(df, "d", ["f1", "f2", "f3"])
    assert about["datasetInfo"]["samples"] == 10 and [tuple(r) for r in about["labels"].collect()] == [("ok", 10)]
    good, bad = dataset.valid(df, 2)
    assert good.count() == 0 and bad.first().reason == "wrong number of values"


def test_features(spark):
    df = spark.createDataFrame([(1.0, 3.0, 36.0, 10.0, 45.0, 2.0)], "p_inlet double, p_outlet double, flow double, current double, bearing_temp double, vibration_rms double")
    r = features.pump(df).first()
    assert r.delta_p == 2 and r.hydraulic_power == 200 and r.efficiency == 1 and r.temp_rise == 20
    assert [one(spark, features.wear_state(F.lit(w))) for w in (0.0, 0.15, 0.3, 0.9)] == ["new", "good", "worn", "critical"]
    h = features.motor_health(spark.createDataFrame([(0.01, 0.1)], "current_imbalance double, THD double")).first().motor_health
    assert h == pytest.approx((100 + 70) / 2)
    wave = spark.createDataFrame([([math.sin(2 * math.pi * 50 * i / 1000) for i in range(1000)], 1000.0)], "samples array<double>, sampling_rate double")
    assert features.motor_current(wave).first().THD == pytest.approx(0, abs=1e-6)
    assert features.vibration_bands(wave).first().band_0_100 == pytest.approx(1)


def test_inference(spark, tmp_path):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), (None,)], "features array<double>")
    out = inference.predict(df, lambda: lambda x: x * 2).collect()
    assert out[0].prediction == [2, 4, 6, 8] and out[1].prediction is None
    p = tmp_path / "m.pkl"
    p.write_bytes(b"x")
    with pytest.raises(PermissionError):
        inference.allowed(str(p), [str(tmp_path / "other")])
    with pytest.raises(ValueError):
        inference.verified(str(p), "00")
    assert inference.format_of("a/b.onnx") == "onnx" and inference.shape_of("1,2,2", 4) == [1, 2, 2] and inference.shape_of("1,3", 4) == [1, 4]
    calls = []

    def send(url, body, timeout):
        calls.append(url)
        return (503, b"") if len(calls) == 1 else (200, json.dumps({"predictions": [[1.0]]}).encode())

    assert inference.http_model("http://x", send=send)()(np.ones((1, 2))).tolist() == [[1.0]] and len(calls) == 2
    nested = inference.input_vector(spark.sql("select array(array(1, 2), array(3)) as a"), "a").first().features
    assert nested == [1, 2, 3]


def test_vision(spark):
    flat = F.array(*[F.lit(v) for v in (10.0, 10.0, 20.0, 20.0, 0.9, 0.0, 30.0, 30.0, 40.0, 40.0, 0.8, 1.0)])
    found = one(spark, vision.boxes(flat))
    assert len(found) == 2 and found[0].x1 == 10 and [b["class"] for b in found] == [0, 1]
    close = F.array(*[F.lit(v) for v in (10.0, 10.0, 20.0, 20.0, 0.9, 0.0, 11.0, 10.0, 20.0, 20.0, 0.8, 0.0)])
    assert len(one(spark, vision.nms(vision.boxes(close)))) == 1
    top = one(spark, vision.classify(F.array(*[F.lit(v) for v in (0.1, 0.7, 0.15, 0.05)])))
    assert top[0]["class"] == 1 and top[0].probability == pytest.approx(0.377671, abs=1e-6)
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (50, 0), (50, 30), (0, 30))])
    p = one(spark, vision.polygon(square))
    assert (p.area, p.perimeter) == (1500, 160)
    field = F.array(*[F.lit(float(v)) for v in range(16)])
    assert tuple(one(spark, vision.heatmap(field))) == (0, 15, 7.5)
    scores = np.zeros((8, 8))
    scores[1:3, 1:3] = 0.9
    assert vision.regions(scores, 0.5)[0]["area"] == 4
    image = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    assert (vision.png_pixels(vision.png_file(image)) == image).all()
    assert vision.resize(image, 4, 4).tolist() == image.tolist() and vision.resize(image, 2, 2, "nearest").shape == (2, 2, 3)
    df = spark.createDataFrame([(vision.png_file(image),), (b"no",)], "png binary")
    rows = vision.to_tensor(df, "png", 2, 2).collect()
    assert rows[0]["shape"] == [1, 3, 2, 2] and len(rows[0]["tensor"]) == 12 and rows[1]["tensor"] is None


def test_analyst(spark):
    assert analyst.stats_line({"count": 3, "mean": 1.23456, "sd": 0.5}) == "n=3 mean=1.235 stdDev=0.5"
    assert analyst.samples_list([1.0, 2.5, 3.0], 2) == "(showing last 2 of 3)\n2.5, 3"
    assert analyst.extract_json('x ```json\n{"a": [1, 2]}\n``` y') == {"a": [1, 2]} and analyst.extract_json('say {"b": "}"} ok') == {"b": "}"}
    assert analyst.extract_json("none") is None and analyst.at_path({"a": [5]}, "a.0") == 5
    assert analyst.fill("{a} {b}", {"a": 1}) == "1 {b}"
    df = spark.createDataFrame([("a", i, float(i)) for i in range(7)], "series_id string, seq int, value double")
    b = analyst.batch_stats(analyst.batches(df, ["series_id"], ["seq"], 3), ["series_id", "batch"])
    asked = analyst.ask(analyst.prompts(b, "series_id", "{series} {stats}"), lambda system, user: analyst.Answer('{"ok": true}', 5, 2), "s")
    assert analyst.usage(asked).first().input_tokens == 15 and asked.select(analyst.json_field(F.col("answer"), "ok").alias("v")).first().v == "true"

    def refused(url, headers, body, timeout):
        return 429, b"slow down"

    with pytest.raises(analyst.CallError) as e:
        analyst.chat_provider("http://x", "m", "k", send=refused)("s", "u")
    assert e.value.kind == "rate-limit"


def test_batch_mean_is_summed_in_order(spark):
    """The order of rows in a table does not show in a mean's last bit; nulls count for nothing."""
    values = [0.1, 0.2, 0.3, 1e16, 1.0, -1e16, None, 0.7]
    total = 0.0
    for v in values:
        total += v or 0.0
    made = [("a", i, v) for i, v in enumerate(values)] + [("b", 0, None)]
    for rows in (made, made[::-1], made[3:] + made[:3]):
        got = {r.k: r for r in analyst.batch_stats(spark.createDataFrame(rows, "k string, seq long, value double"), ["k"], order=["seq"]).collect()}
        assert got["a"]["mean"] == total / 7 and got["a"]["count"] == 7
        assert got["b"]["mean"] is None and got["b"]["count"] == 0


def test_routes(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "i int, is_anomaly boolean")
    normal, odd = parsing.route(df)
    assert normal.count() == 2 and odd.count() == 1
    s = parsing.segments(spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, None)], "k string, seq int, reset boolean"), ["k"], ["seq"])
    assert [r.segment for r in s.orderBy("seq").collect()] == [0, 1, 1]
