"""Folds over chunks give what the serial fold gives, for chunks of any size."""

import random

import pytest
from pyspark.sql import functions as F

from condmon.config import AnomalySettings
from condmon.functions import scans
from condmon.functions.folds import Cusum, Ema, SensorHysteresis, ordered, step_all
from condmon.operators import anomaly

KEYS, ORDER = ["series_id"], ["ts", "seq"]


def series(kind, n=400, seed=1):
    rng = random.Random(seed)
    if kind == "quiet":
        return [rng.gauss(0, 0.4) for _ in range(n)]
    if kind == "busy":
        return [rng.choice([-3.0, 4.0, 0.25, 9.0]) for _ in range(n)]
    if kind == "ramp":
        return [0.6 + 0.0001 * i for i in range(n)]  # rises for ever: no chunk forgets its start
    return [None if rng.random() < 0.2 else rng.gauss(0, 2) for _ in range(n)]


@pytest.mark.parametrize("kind", ["quiet", "busy", "ramp", "gaps"])
@pytest.mark.parametrize("chunk", [1, 3, 40, 1000])
def test_summaries_compose(kind, chunk):
    x = series(kind)
    raw = [None if v is None else v > 1 for v in x]
    folds = [(Ema(0.3), {"value": x}), (Ema(0.001), {"value": x}), (Cusum(0.5, 5.0), {"deviation": x}), (Cusum(0.5, 1e9), {"deviation": x})]
    folds += [(SensorHysteresis(enter, leave), {"raw_anomaly": raw, "raw_severity": ["critical"] * len(x)}) for enter, leave in ((1, 1), (2, 3), (3, 2))]
    for fold, columns in folds:
        state, known = fold.start(), 0
        for i in range(0, len(x), chunk):
            part = {c: v[i : i + chunk] for c, v in columns.items()}
            told = fold.carry(state, fold.summary(part))
            fold.step(state, part)
            if told is not None:
                known += 1
                assert told.keys() == state.keys()
                for k, v in state.items():
                    assert told[k] == (pytest.approx(v, rel=1e-9, abs=1e-9) if isinstance(v, float) else v)
        if not isinstance(fold, Cusum) or kind == "quiet" or fold.limit > 1e6:
            assert known == -(-len(x) // chunk)


@pytest.mark.parametrize("kind, chunk", [("busy", 7), ("ramp", 40), ("busy", 1000)])
def test_scanned_equals_ordered(spark, kind, chunk):
    rows = [(k, i // 3, i, x) for k, seed in (("a", 1), ("b", 2)) for i, x in enumerate(series(kind, 300, seed))] + [("c", 0, 0, 1.0)]
    df = spark.createDataFrame(rows, "series_id string, ts int, seq int, deviation double").withColumn("value", F.col("deviation"))
    for fold in (Ema(0.3), Cusum(0.5, 5.0)):
        names = [f.name for f in fold.outputs]
        want = {(r.series_id, r.seq): [r[c] for c in names] for r in ordered(df, KEYS, ORDER, fold).collect()}
        got = {(r.series_id, r.seq): [r[c] for c in names] for r in scans.scanned(df, KEYS, ORDER, fold, F.floor(F.col("ts") / 4), chunk).collect()}
        assert got.keys() == want.keys()
        assert all(a == b or a == pytest.approx(b, rel=1e-9, abs=1e-9) for k in want for a, b in zip(got[k], want[k], strict=True))


def test_what_does_not_settle_is_folded_serially(spark, monkeypatch):
    monkeypatch.setattr(scans, "ROUNDS", 1)
    df = spark.createDataFrame([("a", i, i, x) for i, x in enumerate(series("busy", 90))], "series_id string, ts int, seq int, deviation double")
    got = [r.cusum_max for r in scans.scanned(df, KEYS, ORDER, Cusum(0.5, 5.0), F.floor(F.col("ts") / 4), 3).orderBy("seq").collect()]
    assert got == step_all(Cusum(0.5, 5.0), {"deviation": series("busy", 90)})["cusum_max"]


@pytest.mark.parametrize("method", ["ema", "cusum"])
def test_detect_in_chunks(spark, method):
    rows = [("a", i // 2, i, x) for i, x in enumerate(series("gaps", 300))] + [("b", i, i, x) for i, x in enumerate(series("busy", 50))]
    df = spark.createDataFrame(rows, "series_id string, ts int, seq int, value double")
    s = AnomalySettings(method=method, window=20, consecutive=2)
    shown = lambda d: {(r.series_id, r.seq): (r.severity, r.raw_anomaly, r.is_anomaly, r.skipped) for r in d.collect()}
    assert shown(anomaly.detect(df, s, KEYS, ORDER, F.floor(F.col("ts") / 8), 25)) == shown(anomaly.detect(df, s, KEYS, ORDER))


def test_sensors_in_chunks(spark):
    rng = random.Random(4)
    rows = [(e, i, 0, {s: rng.choice([0.0, 0.1, 0.2, 8.0]) if rng.random() > 0.1 else float("nan") for s in ("p", "q")}) for e in (1, 2) for i in range(120)]
    df = spark.createDataFrame(rows, "entity long, ts int, seq int, sensors map<string,double>")
    s = AnomalySettings(window=15, consecutive=2)
    key = lambda r: (r.entity, r.ts)
    for chunked, plain in zip(anomaly.detect_sensors(df, s, "entity", ["ts", "seq"], bucket=F.floor(F.col("ts") / 9), chunk=16), anomaly.detect_sensors(df, s, "entity", ["ts", "seq"]), strict=True):
        names = [c for c in ("sensor", "is_anomaly", "severity", "skipped", "anomaly_sensors", "skipped_sensors") if c in plain.columns]
        assert sorted((key(r), *(str(r[c]) for c in names)) for r in chunked.collect()) == sorted((key(r), *(str(r[c]) for c in names)) for r in plain.collect())
