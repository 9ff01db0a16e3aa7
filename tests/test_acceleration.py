"""Acceleration against the rule in plain Python, row by row."""

import random

import pytest

from condmon.config import TrendSettings
from condmon.operators import trend


def by_hand(rows, window):
    """(seq, acceleration): rates of the rows of the window so far, those without elapsed time passed over."""
    out, held = [], []
    for t, seq, v in sorted(rows):
        held = [h for h in [*held, (t, v)] if t - h[0] <= window]
        rates = [(b[1] - a[1]) / (b[0] - a[0]) for a, b in zip(held, held[1:], strict=False) if b[0] > a[0]]
        out.append((seq, (rates[-1] - rates[-2]) / (window / len(held)) if len(held) >= 3 and len(rates) >= 2 else None))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "t double, seq int, value double").selectExpr("'k' as k", "timestamp_micros(cast(t * 1e6 as bigint)) as ts", "seq", "value")


def test_rows_without_elapsed_time(spark):
    rows = [(0.0, 0, 0.0), (1.0, 1, 1.0), (1.0, 2, 3.0), (2.0, 3, 4.0), (4.0, 4, 10.0), (5.0, 5, 11.0)]
    got = [r.acceleration for r in trend.acceleration(frame(spark, rows), TrendSettings(time_window_s=10.0), ["k"], ["ts", "seq"]).orderBy("seq").collect()]
    assert got[:3] == [None, None, None] and got[3] == 0.0
    assert got == [x if x is None else pytest.approx(x) for _, x in by_hand(rows, 10.0)]


@pytest.mark.parametrize("span", [None, 5.0, 17.0])
@pytest.mark.parametrize("gap", [1, 4])
def test_chunks_of_time(spark, span, gap):
    rng = random.Random(gap)
    t, rows = 0.0, []
    for i in range(300):
        t += rng.choice([0, 0, 1, gap, 1 if i % 50 else 40])
        rows.append((t, i, rng.choice([1.0, 2.5, 7.0])))
    s = TrendSettings(time_window_s=5.0)
    got = {r.seq: r.acceleration for r in trend.acceleration(frame(spark, rows), s, ["k"], ["ts", "seq"], span).collect()}
    assert got == {i: x if x is None else pytest.approx(x) for i, x in by_hand(rows, 5.0)}
