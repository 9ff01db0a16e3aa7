"""Operators cut into small chunks give the rows of their whole-series forms; windows computed together those of one by one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from condmon.config import SignalSettings, TrendSettings
from condmon.functions import folds
from condmon.functions.chunks import framed, numbered
from condmon.functions.parsing import segments
from condmon.operators import analyst, dataset, multivalue, multivariate, signal, trend

KEYS, ORDER = ["k"], ["seq"]


def bucket():
    return F.floor(F.col("seq") / 7)


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k, n in (("a", 61), ("b", 5), (None, 23)):
        for i, v in enumerate(np.cumsum(rng.normal(1, 2, n)).tolist()):
            value = None if i % 11 == 7 else float("nan") if i % 13 == 8 else float("inf") if i == 30 else v
            rows.append((k, i, 1_700_000_000 + 3600 * i, value, None if i % 9 == 4 else [v, None if i % 5 == 2 else v * v % 7, float(i % 6)]))
    return spark.createDataFrame(rows, "k string, seq long, s long, value double, v array<double>").withColumn("ts", F.timestamp_seconds("s")).drop("s").cache()


def rows(df):
    def plain(x):
        return "nan" if isinstance(x, float) and math.isnan(x) else round(x, 8) if isinstance(x, float) else tuple(map(plain, x)) if isinstance(x, list) else x

    return sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)


def test_row_numbers_and_frames(series):
    got = {(r.k, r.seq): r["__i"] for r in numbered(series, KEYS, ORDER, bucket()).collect()}
    assert got == {(r.k, r.seq): r.seq for r in series.collect()}  # null keys, too
    frames = {(r.k, r.frame): r.samples for r in framed(series, KEYS, ORDER, bucket(), 10, "seq").collect()}
    assert frames == {(k, f): list(range(10 * f, 10 * f + 10)) for k, n in (("a", 6), (None, 2)) for f in range(n)}


@pytest.mark.parametrize(
    "form",
    [
        lambda d, **b: trend.linear(d.fillna(0.0, ["value"]).replace(float("nan"), 0.0).where("seq <> 30"), TrendSettings(window=9, threshold=40.0), KEYS, ORDER, **b),
        lambda d, **b: trend.holt(d.fillna(0.0, ["value"]).replace(float("nan"), 0.0).where("seq <> 30"), TrendSettings(window=9), KEYS, ORDER, **b),
        lambda d, **b: dataset.windows(d, KEYS, ORDER, 6, 50.0, "seq", **b),
        lambda d, **b: dataset.sequences(d, "k", ORDER, 6, "seq", **b),
        lambda d, **b: trend.remaining_life(d, TrendSettings(window=12, threshold=90.0, unit="hours"), KEYS, ORDER, **b),
        lambda d, **b: trend.remaining_life(d, TrendSettings(window=12, threshold=90.0, method="weibull"), KEYS, ORDER, **b),
        lambda d, **b: multivalue.mahalanobis(d, KEYS, ORDER, "v", 12, **b),
        lambda d, **b: multivalue.mahalanobis(d, KEYS, ORDER, "v", 12, gaps=True, **b),
    ],
)
def test_chunks_equal_whole_series(series, form):
    assert rows(form(series, bucket=bucket(), chunk=15)) == rows(form(series))


def test_counts_and_components_equal_whole_series(series):
    for form in (
        lambda **b: dataset.rul_label(series, KEYS, ORDER, 30, **b),
        lambda **b: dataset.rul_label(series, KEYS, ORDER, 30, "hours", **b),
        lambda **b: analyst.batches(series, KEYS, ORDER, 4, **b),
        lambda **b: segments(series.withColumn("reset", F.col("value") > 20), KEYS, ORDER, **b),
        lambda **b: multivariate.pca(series, KEYS, ORDER, "v", ["x", "y", "z"], window=22, method="combined", share=0.6, **b),
    ):
        assert rows(form(bucket=bucket())) == rows(form())


def test_empty_tables(series):
    none = series.where("false")
    assert multivariate.pca(none, KEYS, ORDER, "v", bucket=bucket()).count() == 0
    assert multivalue.mahalanobis(none, KEYS, ORDER, "v", bucket=bucket()).count() == 0
    assert trend.remaining_life(none, TrendSettings(threshold=1.0), KEYS, ORDER, bucket=bucket()).count() == 0


def test_mahalanobis_with_gaps():
    rng = np.random.default_rng(8)
    vectors = [[None if rng.random() < 0.2 else float(x) for x in r] for r in rng.normal(0, 1, (60, 3))]
    vectors[5], vectors[20], vectors[31] = None, [None, None, None], [0.5, 1.0]
    fold = multivalue.Mahalanobis(25, gaps=True)
    got, state = folds.step_all(fold, {"vector": vectors})["distance"], fold.start()
    parts = [x for i in range(0, 60, 7) for x in fold.step(state, {"vector": vectors[i : i + 7]})["distance"]]
    held, checked = [], 0
    for v, one, two in zip(vectors, got, parts, strict=True):
        if v is None or all(x is None for x in v):
            assert one is None and two is None
            continue
        held = [*held, [*v, *[None] * (3 - len(v))]][-25:]
        if len(held) < 10:
            assert one is None and two is None
            continue
        here = [c for c in range(len(v)) if v[c] is not None]
        columns = [[r[c] for r in held if r[c] is not None] for c in here]
        means = [sum(c) / len(c) for c in columns]
        cov = np.array([[sum((p - a) * (q - b) for p, q in zip(x, y, strict=False)) / (len(held) - 1) for y, b in zip(columns, means, strict=True)] for x, a in zip(columns, means, strict=True)])
        cov += np.eye(len(here)) * max(1e-6, 1e-6 * cov.diagonal().max())
        d = np.array([v[c] for c in here]) - means
        want = math.sqrt(max(0.0, d @ np.linalg.pinv(cov, hermitian=True) @ d))
        assert one == pytest.approx(want) and two == pytest.approx(want)
        checked += 1
    assert checked > 30


def test_remaining_life_of_many_windows():
    rng = np.random.default_rng(1)
    x, ms = np.cumsum(rng.normal(0.5, 2, (40, 60)), axis=1), np.tile(np.arange(60) * 1000.0, (40, 1))
    for method in ("linear", "weibull"):
        assert trend.remaining_many(x, ms, 60.0, method) == [trend.remaining(a, b, 60.0, method) for a, b in zip(x, ms, strict=True)]


def test_weibull_figures():
    s = TrendSettings(threshold=20.0, method="weibull", unit="cycles")
    x = [1, 3, 2, 5, 4, 7, 6, 9, float("inf"), None, 8.5]
    out = folds.step_all(trend.Rul(s), {"value": x, "ms": [10.0 * i for i in range(11)]})
    assert out["rul_model"][8:10] == [None, None] and out["rul_model"][10] == "weibull"  # infinite and missing samples join no buffer
    beta, eta = out["weibull_beta"][10], out["weibull_eta"][10]
    assert beta == pytest.approx(np.mean([v for v in x if v and v < 10]) / np.std([v for v in x if v and v < 10]))
    for p in trend.B_LIVES:
        assert 1 - math.exp(-((out[f"weibull_b{p}"][10] / eta) ** beta)) == pytest.approx(p / 100)
    assert out["reliability"][10] == pytest.approx(1 - (8.5 - 1) / 8) and out["phase"][10] == "wear_out" and out["hazard"][10] > 0


def test_fleet_matches_equal_every_pair(spark):
    rng, s = np.random.default_rng(4), SignalSettings(tolerance=0.05)
    peaks = [(m, i, [(float(f), float(g), 1.0) for f, g in zip(rng.uniform(0.5, 400, 6), rng.uniform(0, 1, 6), strict=True)] + [(0.0, 1.0, 1.0), (105.0, 0.3, 1.0), (95.0, 0.1, 1.0)]) for m in ("a", "b", None) for i in range(5)]
    frames = spark.createDataFrame(peaks, "m string, frame int, peaks array<struct<frequency double, magnitude double, normalized double>>")
    machines = spark.createDataFrame([("a", 33.0), ("b", 100.0), ("c", 7.0), ("d", None), ("e", 0.0)], "m string, rate double")
    faults = signal.fleet_faults(machines, ["m"], {"X": F.col("rate"), "Y": F.col("rate") * 2.5})
    assert faults.count() == 18
    got = {(r.m, r.frame, r.fault, r.harmonic, r.frequency, r.severity) for r in signal.match_fleet(frames, faults, s, ["m"], ["m", "frame"]).collect()}
    level = lambda g: "high" if g > 0.5 else "medium" if g > 0.2 else "low"
    want = {(m, i, r.fault, r.harmonic, f, level(g)) for m, i, p in peaks for f, g, _ in p for r in faults.collect() if r.m == m and f > 0 and abs(f - r.target) / r.target <= 0.05}
    assert got == want and len(want) > 20


def test_fleet_matches_frequencies_before_frames(spark, monkeypatch):
    """Peaks of many frames at few frequencies: what is matched grows with the machines, only the result with frames times machines; lots and lists change nothing."""
    monkeypatch.setattr(signal, "GIVEN", 50)
    monkeypatch.setattr(signal, "LISTED", 4)
    monkeypatch.setattr(signal, "PARTS", 8)
    rows, write = {}, signal.written
    monkeypatch.setattr(signal, "written", lambda df, name: rows.setdefault(name, write(df, name)))
    peaks = [("a", i, [(float(f), g, 1.0) for f, g in ((50, 0.6), (100, 0.1 * (i % 4)), (7, 0.9))]) for i in range(40)] + [("b", 0, [(50.0, 0.3, 1.0)]), (None, 0, [(50.0, 0.3, 1.0)]), ("a", 40, [])]
    frames = spark.createDataFrame(peaks, "m string, frame int, peaks array<struct<frequency double, magnitude double, normalized double>>")
    machines = spark.createDataFrame([("a", f"u{i}", 49.6 + 0.02 * i) for i in range(30)] + [("b", "w", 50.0), (None, "x", 50.0)], "m string, machine string, rate double")
    faults = signal.fleet_faults(machines, ["m", "machine"], {"X": F.col("rate")}, harmonics=2)
    got = signal.match_fleet(frames, faults, SignalSettings(tolerance=0.005), ["m"], ["m", "frame"]).collect()
    near = lambda f, t: abs(f - t) / t <= 0.005
    level = lambda g: "high" if g > 0.5 else "medium" if g > 0.2 else "low"
    want = [(m, i, r.machine, r.harmonic, f, level(g)) for m, i, p in peaks for f, g, _ in p for r in faults.collect() if r.m == m and m is not None and near(f, r.target)]
    assert sorted((r.m, r.frame, r.machine, r.harmonic, r.frequency, r.severity) for r in got) == sorted(want) and len(want) > 1500
    assert rows["fleet-met"].count() == len({(m, u, h, f) for m, _, u, h, f, _ in want}) < 70


def test_envelopes_of_many_frames_at_once(spark, monkeypatch):
    """The filters run over frames together, whatever their order, length and rate, and give the same bits as over each alone."""
    rng, s = np.random.default_rng(8), SignalSettings(low_hz=50.0, high_hz=300.0)
    sizes = [256, 64, 256, 300, 256, 8, 64]
    made = [(i, rng.exponential(20, n).tolist(), 2000.0 if i == 4 else 1000.0) for i, n in enumerate(sizes)] + [(7, None, 1000.0), (8, [], 1000.0), (9, [1.0, math.nan], 1000.0), (10, [1.0] * 256, None)]
    df = spark.createDataFrame(made, "i int, samples array<double>, sampling_rate double").coalesce(1)
    for together in (1 << 20, 300):
        monkeypatch.setattr(signal, "TOGETHER", together)
        got = {r.i: r for r in signal.envelope_spectrum(df, s).collect()}
        assert [got[i].envelope for i in range(7, 11)] == [None] * 4 and got[7].peaks is None
        for i, x, rate in made[:7]:
            e = signal.envelope(np.array(x[-256:]), rate, 50.0, 300.0)
            assert got[i].envelope == e.tolist() and [p.asDict() for p in got[i].peaks] == signal._peaks(*signal.spectrum(e, rate), 0.05)
