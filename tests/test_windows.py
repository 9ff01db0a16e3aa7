"""Ordered sliding windows against sorting anew for every row."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from condmon.functions import stats, windows
from condmon.functions.folds import step_all
from condmon.functions.windows import OrderStatistics, RankCorrelation, average_ranks
from condmon.operators import multivalue


@pytest.mark.parametrize("window", [1, 2, 7, 100])
@pytest.mark.parametrize("cut", [1, 5, 1000])
def test_order_statistics(window, cut):
    rng = random.Random(window)
    x = [rng.choice([None, float("inf"), float(rng.randint(0, 5)), rng.gauss(0, 1)]) for _ in range(300)]
    fold = OrderStatistics(window, 10, 90)
    state, got = fold.start(), []
    for i in range(0, len(x), cut):
        out = fold.step(state, {"value": x[i : i + cut]})
        got += list(zip(*out.values(), strict=True))
    held = []
    for v, row in zip(x, got, strict=True):
        if v is None or v == float("inf"):
            assert row == (len(held), None, None, None, None, None)
            continue
        held = [*held, v][-window:]
        s = sorted(held)
        n = len(s)
        assert row[:4] == (n, s[int(n * 0.25)], s[int(n * 0.5)], s[int(n * 0.75)])
        assert row[4:] == pytest.approx(tuple(np.percentile(s, [10, 90])))


def test_average_ranks():
    assert average_ranks(np.array([[3.0, 1.0, 3.0, 2.0], [5.0, 5.0, 5.0, 5.0]])).tolist() == [[3.5, 1.0, 3.5, 2.0], [2.5] * 4]


@pytest.mark.parametrize("cut", [1, 4, 1000])
def test_rank_correlation(cut):
    rng = random.Random(cut)
    x = [rng.choice([None, *map(float, range(4))]) for _ in range(150)]
    y = [None if v is None or rng.random() < 0.1 else v + rng.choice([0.0, 1.0, 2.0]) for v in x]
    fold = RankCorrelation(9)
    state, got = fold.start(), []
    for i in range(0, len(x), cut):
        got += fold.step(state, {"__x": x[i : i + cut], "__y": y[i : i + cut]})["correlation"]
    held = []
    for a, b, r in zip(x, y, got, strict=True):
        if a is None or b is None:
            assert r is None
            continue
        held = [*held, (a, b)][-9:]
        if len(held) < 3:
            assert r is None
            continue
        ranks = [[sum(w < v for w in side) + (sum(w == v for w in side) + 1) / 2 for v in side] for side in zip(*held, strict=True)]
        sd = np.std(ranks[0]) * np.std(ranks[1])
        assert r == pytest.approx(0.0 if sd == 0 else float(np.mean((np.array(ranks[0]) - np.mean(ranks[0])) * (np.array(ranks[1]) - np.mean(ranks[1])))) / sd)


def test_whole_series_and_streams_agree():
    x = [float((i * 37) % 11) for i in range(50)]
    assert step_all(OrderStatistics(10), {"value": x})["buffer_size"] == [min(i + 1, 10) for i in range(50)]


@pytest.fixture()
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def pairs(spark):
    """Series of several lengths over many batches, with nulls on either side, a null key, equal values and prices far from zero."""
    rng = np.random.default_rng(8)
    rows = []
    for k, n in (("a", 41), ("b", 1), ("c", 12), (None, 9), ("d", 30)):
        for i in range(n):
            x, y = (7.1, 9e6 + 0.1) if k == "c" else (float(rng.integers(0, 5)), 9e6 + float(rng.normal()))
            rows.append((k, i, None if k == "a" and i % 6 == 2 or k == "d" and i < 12 else x, None if k == "a" and i % 10 == 5 else y))
    return spark.createDataFrame(rows, "k string, seq long, x double, y double")


def test_moments_equal_window_aggregates(spark, small_batches):
    w = stats.trailing(["k"], ["seq"], 8)
    got = windows.moments(pairs(spark), ["k"], ["seq"], "x", "y", 8)
    sums = {
        "__n": F.count(F.lit(1)).over(w), "__nx": F.count("x").over(w), "__ny": F.count("y").over(w), "__nxy": F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).over(w),
        "__sxx": F.coalesce(F.var_pop("x").over(w), F.lit(0.0)) * F.count("x").over(w), "__syy": F.coalesce(F.var_pop("y").over(w), F.lit(0.0)) * F.count("y").over(w),
        "__sxy": F.coalesce(F.covar_pop("x", "y").over(w), F.lit(0.0)) * F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).over(w),
        "__dx": F.col("x") - F.avg("x").over(w), "__dy": F.col("y") - F.avg("y").over(w),
    }
    expected = {(r.k, r.seq): r for r in pairs(spark).select("k", "seq", *[c.alias(n) for n, c in sums.items()]).collect()}
    rows = got.collect()
    assert len(rows) == len(expected) == 93
    for r in rows:
        for name in sums:
            assert r[name] == pytest.approx(expected[r.k, r.seq][name], abs=1e-7), (r, name)
    assert all(r["__sxx"] == r["__syy"] == 0 for r in rows if r.k == "c")  # equal values have no deviation, whatever their rounding


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_correlation_of_short_series_is_dealt_once(spark, small_batches):
    """Where no series is longer than a chunk rows are neither numbered nor joined, and no frame is gone over row by row."""
    bucket = F.floor(F.col("seq") / 5)
    whole = multivalue.correlate(pairs(spark), ["k"], ["seq"], "x", "y", 8, bucket=bucket)
    assert _exchanges(whole) == 1 and "Window" not in whole._jdf.queryExecution().executedPlan().toString()
    cut = multivalue.correlate(pairs(spark), ["k"], ["seq"], "x", "y", 8, bucket=bucket, chunk=10)
    plain = lambda df: {(r.k, r.seq): r.correlation for r in df.collect()}
    assert plain(whole) == pytest.approx(plain(cut), abs=1e-9, nan_ok=True)
    assert plain(whole)["d", 11] == plain(cut)["d", 11] is None  # no x so far


def test_mahalanobis_2d_goes_over_no_frame_row_by_row(spark, small_batches):
    df = pairs(spark).where("x is not null and y is not null")
    got = multivalue.mahalanobis_2d(df, ["k"], ["seq"], "x", "y", 12)
    assert _exchanges(got) == 1 and "Window" not in got._jdf.queryExecution().executedPlan().toString()
    found = {(r.k, r.seq): r.distance for r in got.collect()}
    rows = [(r.x, r.y) for r in df.where("k = 'a'").orderBy("seq").collect()[-12:]]
    last = df.where("k = 'a'").agg(F.max("seq")).first()[0]
    c = np.cov(np.array(rows).T)
    c += np.eye(2) * max(1e-6, 1e-6 * c.diagonal().max())
    d = np.array(rows[-1]) - np.mean(rows, axis=0)
    assert found["a", last] == pytest.approx(float(np.sqrt(d @ np.linalg.inv(c) @ d)), abs=1e-6)
    assert found["c", 8] is None and found["c", 11] == 0
