"""Records judged in one pass give what a row a sensor, with windows and the serial fold, gives."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from condmon.config import AnomalySettings
from condmon.functions import scans, sensors
from condmon.functions.folds import SensorHysteresis
from condmon.operators import anomaly

ORDER = ["ts", "seq"]


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def records(spark, n=90, seed=4):
    rng = random.Random(seed)
    value = lambda: rng.choice([0.0, 0.0, 0.0, 8.0]) + rng.gauss(0, 1) if rng.random() > 0.1 else rng.choice([float("nan"), float("inf"), None])
    rows = [(e, i // 2, i, rng.choice([None, 1.3]), {s: value() for s in ("p", "q", "r") if s != "r" or rng.random() > 0.7}) for e in ("a", "b", None) for i in range(n)]
    rows += [("c", 0, 0, None, {}), ("c", 1, 0, None, None), ("d", 0, 0, None, {"q": 1.0})]
    return spark.createDataFrame(rows, "entity string, ts int, seq int, cfg_zscore_warning double, sensors map<string,double>")


def shown(df):
    num = lambda v: None if v is None else round(v, 9) if isinstance(v, float) and math.isfinite(v) else str(v)
    return sorted(str([(c, num(r[c])) for c in df.columns]) for r in df.collect())


@pytest.mark.parametrize("settings", [{"window": 15, "consecutive": 2}, {"window": 2}, {"hysteresis": False}])
def test_in_one_pass_equals_a_row_a_sensor(spark, small_batches, settings):
    s = AnomalySettings(**settings)
    for df in (records(spark), records(spark).drop("cfg_zscore_warning").where("sensors is not null").withColumn("sensors", F.struct(F.col("sensors")["q"].alias("q"), F.col("sensors")["p"].alias("p")))):
        for got, want in zip(anomaly.detect_sensors(df, s, "entity", ORDER), anomaly._by_sensor(df, s, "entity", ORDER, "sensors", None, 1_000_000), strict=True):
            assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
            assert shown(got) == shown(want)


def test_records_are_dealt_once_and_nothing_is_stored(spark, monkeypatch):
    """A row a sensor took some twelve times the tables of disk: dealt for the windows, the scan's summaries, its replay and the records, and stored between."""
    stored = []
    monkeypatch.setattr(scans, "written", lambda df, name: stored.append(name) or df)
    found = anomaly.detect_sensors(records(spark).where("entity is not null"), AnomalySettings(consecutive=2), "entity", ORDER, bucket=F.floor(F.col("ts") / 9))[1]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not stored and plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan and found.count() == 181


def test_equal_records_are_one_across_batches(spark, small_batches):
    rows = [("a", i // 5, 0, {f"s{i % 5}": 1.0 if i < 200 or i % 5 else 50.0}) for i in range(300)]
    df = spark.createDataFrame(rows, "entity string, ts int, seq int, sensors map<string,double>")
    got, want = anomaly.detect_sensors(df, AnomalySettings(), "entity", ORDER)[1], anomaly._by_sensor(df, AnomalySettings(), "entity", ORDER, "sensors", None, 10**6)[1]
    assert shown(got) == shown(want) and got.count() == 60


@pytest.mark.parametrize("enter, leave", [(1, 1), (1, 2), (2, 3), (4, 5)])
def test_hysteresis_of_many_series_equals_the_fold(enter, leave):
    rng = random.Random(enter)
    fold = SensorHysteresis(enter, leave)
    for _ in range(30):
        states = [fold.start() for _ in range(4)]
        for _ in range(3):
            parts = [[rng.choice([0, 0, 0, 1, 2]) for _ in range(rng.randint(1, 12))] for _ in states]
            begun = {i: sensors.Standing(np.zeros(0), *s.values()) for i, s in enumerate(states)}
            first = np.concatenate([np.arange(len(p)) == 0 for p in parts])
            final, levels, ends = sensors.held_up(np.concatenate([np.array(p) for p in parts]), first, begun, [0, 1, 2, 3], enter, leave)
            want = [fold.step(s, {"raw_anomaly": [v > 0 for v in p], "raw_severity": [sensors.LEVELS[v + 1] for v in p]}) for s, p in zip(states, parts, strict=True)]
            assert final.tolist() == [x for w in want for x in w["is_anomaly"]]
            assert [sensors.LEVELS[v + 1] for v in levels.tolist()] == [x for w in want for x in w["severity"]]
            assert [(e.anomalies, e.on) for _, e in sorted(ends.items())] == [(s["anomalies"], s["on"]) for s in states]


def test_windows_are_summed_in_order():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 11, 5000) / 100
    sizes = np.minimum(np.where(np.arange(5000) < 4300, np.arange(5000), np.arange(5000) % 13) + 1, 40)
    mean, sd = sensors.in_order(x, sizes, 40)
    for i in [*range(60), *range(4080, 4110), *range(4290, 4400), 4999]:
        total = m = q = 0.0
        for k, v in enumerate(x[i + 1 - sizes[i] : i + 1].tolist()):
            d = v - m
            total, m = total + v, m + d / (k + 1)
            q += (v - m) * d
        assert mean[i] == total / sizes[i] and sd[i] == math.sqrt(q / sizes[i])


@pytest.mark.parametrize("settings, chunk", [({"window": 15, "consecutive": 2}, 16), ({"window": 40, "consecutive": 3}, 7), ({"window": 5, "hysteresis": False}, 11)])
def test_in_chunks_equals_one_pass(spark, small_batches, settings, chunk):
    """Chunks shorter than the window, sensors that are rare, and an entity that is not cut."""
    s = AnomalySettings(**settings)
    df = records(spark)
    for got, want in zip(anomaly.detect_sensors(df, s, "entity", ORDER, bucket=F.floor(F.col("ts") / 9), chunk=chunk), anomaly.detect_sensors(df, s, "entity", ORDER), strict=True):
        assert got.columns == want.columns and shown(got) == shown(want)


@pytest.mark.parametrize("enter, leave", [(1, 1), (2, 3), (4, 5)])
def test_states_of_the_hysteresis(enter, leave):
    """Every state leads where the fold does."""
    rng = random.Random(leave)
    fold = SensorHysteresis(enter, leave)
    for n in range(25):
        level = np.array([rng.choice([0, 0, 1, 2]) for _ in range(n)], np.int64)
        begun = sensors.states(enter, leave)
        for b, e in zip(zip(*begun, strict=True), zip(*sensors.turned(begun, level, enter, leave), strict=True), strict=True):
            state = dict(zip(("anomalies", "normals", "on"), (int(b[0]), int(b[1]), bool(b[2])), strict=True))
            fold.step(state, {"raw_anomaly": (level > 0).tolist(), "raw_severity": ["warning"] * n})
            assert (e[0], e[2]) == (state["anomalies"], state["on"]) and (not e[2] or e[1] == state["normals"])
