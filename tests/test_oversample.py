"""The neighbour join against brute force, and class sizes of the resampling."""

import numpy as np
import pytest

from condmon.operators import oversample


def near_by_hand(queries, points, k):
    out = []
    for i, x in queries:
        best = sorted((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in points if j != i)[:k]
        out += [(i, r + 1, j, round(d**0.5, 9)) for r, (d, j) in enumerate(best)]
    return sorted(out)


@pytest.fixture(params=["clusters", "copies", "grid"])
def cloud(request):
    rng = np.random.default_rng(3)
    if request.param == "clusters":
        x = np.concatenate([rng.normal(c, 0.3, (80, 3)) for c in rng.normal(0, 5, (5, 3))])
    elif request.param == "copies":
        x = np.concatenate([np.zeros((200, 3)), np.ones((90, 3)), rng.integers(0, 3, (110, 3))]).astype(float)
    else:
        x = rng.integers(0, 9, (400, 3)).astype(float)
    return [(int(i), [float(v) for v in r]) for i, r in zip(rng.permutation(len(x)), x, strict=True)]


@pytest.mark.parametrize("k", [4])
def test_nearest_equals_brute_force(spark, monkeypatch, cloud, k):
    monkeypatch.setattr(oversample, "CELL_POINTS", 20)
    monkeypatch.setattr(oversample, "LOT", 16)
    df = spark.createDataFrame([*cloud, (None, [0.0] * 3), (9000, None), (9001, [0.0, None, 1.0]), (9002, [float("nan"), 0.0, 0.0])], "id long, v array<double>")
    some = df.where("id % 3 = 0 or id is null")
    got = sorted((r.id, r["rank"], r.neighbour, round(r.distance, 9)) for r in oversample.nearest(some, df, k, "id", "v").collect())
    assert got == near_by_hand([p for p in cloud if p[0] % 3 == 0], cloud, k)


def test_few_or_no_points(spark):
    one = spark.createDataFrame([(1, [0.0]), (2, [3.0])], "id long, v array<double>")
    assert [tuple(r) for r in oversample.nearest(one, one, 5, "id", "v").orderBy("id").collect()] == [(1, 1, 2, 3.0), (2, 1, 1, 3.0)]
    assert oversample.nearest(one.limit(0), one.limit(0), 5, "id", "v").count() == 0
    assert oversample.nearest(one, one.limit(0), 5, "id", "v").count() == 0


def labelled(spark, few, many, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(v) for v in rng.normal(0, 1, 2)], "fault") for i in range(few)] + [(1000 + i, [float(v) for v in rng.normal(1.5, 1, 2)], "ok") for i in range(many)]
    return spark.createDataFrame(rows, "id long, v array<double>, y string"), {r[0]: r[1] for r in rows}


@pytest.mark.parametrize("few, many", [(6, 40), (30, 31)])
def test_smote_balances_on_edges_of_the_class(spark, few, many):
    df, at = labelled(spark, few, many)
    made = oversample.smote(df, "id", "v", "y", "fault").collect()
    assert len(made) == many - few
    per = np.bincount([r.base for r in made], minlength=few)
    assert per.max() - per.min() <= 1
    near = {}
    for i, _, j, _ in near_by_hand([(i, at[i]) for i in range(few)], [(i, at[i]) for i in range(few)], 5):
        near.setdefault(i, set()).add(j)
    for r in made:
        assert r.neighbour in near[r.base] and 0 <= r.gap < 1
        assert np.allclose(r["values"], np.array(at[r.base]) + r.gap * (np.array(at[r.neighbour]) - np.array(at[r.base])))
    again = oversample.smote(df.repartition(7), "id", "v", "y", "fault").collect()
    assert sorted(made) == sorted(again)


def test_adasyn_follows_the_border(spark):
    df, at = labelled(spark, 20, 120, 1)
    made = oversample.adasyn(df, "id", "v", "y", "fault").collect()
    hard = {i: 0 for i in range(20)}
    for i, _, j, _ in near_by_hand([(i, at[i]) for i in range(20)], list(at.items()), 5):
        hard[i] += j >= 1000
    want = {i: int(np.rint(h * 100.0 / sum(hard.values()))) for i, h in hard.items()}
    assert {i: sum(r.base == i for r in made) for i in range(20)} == want
    assert all(r.neighbour < 1000 for r in made)


def test_nothing_to_resample(spark):
    df, _ = labelled(spark, 5, 40)
    for f in (oversample.smote, oversample.adasyn):
        assert f(df, "id", "v", "y", "fault").count() == 0
        assert f(df, "id", "v", "y", "ok").count() == 0
        assert f(df.limit(0), "id", "v", "y", "fault").count() == 0
    apart = spark.createDataFrame([(i, [float(i)], "fault") for i in range(8)] + [(100 + i, [1e6 + i], "ok") for i in range(20)], "id long, v array<double>, y string")
    assert oversample.adasyn(apart, "id", "v", "y", "fault").count() == 0
    assert oversample.smote(apart, "id", "v", "y", "fault").count() == 12


def test_tomek_links(spark):
    df, at = labelled(spark, 40, 60, 2)
    first = {i: j for i, _, j, _ in near_by_hand(list(at.items()), list(at.items()), 1)}
    want = sorted((i, j) for i, j in first.items() if first[j] == i and i < j and (i < 1000) != (j < 1000))
    assert sorted(map(tuple, oversample.tomek_links(df, "id", "v", "y").collect())) == want and want


def test_pivots_are_searched_in_two_levels(monkeypatch):
    """A point meets about twice the root of the pivots, not all; no cell that holds a point within the bound stays closed; other cells mostly do."""
    rng = np.random.default_rng(4)
    x = np.unique(rng.integers(0, 400, (6000, 2)), axis=0).astype(float)
    pivots, made, plain = oversample.Pivots(rng.permutation(x)[:900]), [0], oversample._squares

    def counted(a, b):
        made[0] += len(a) * len(b)
        return plain(a, b)

    monkeypatch.setattr(oversample, "_squares", counted)
    cell, reach, far = pivots.place(x)
    assert made[0] < len(x) * 900 / 5
    np.testing.assert_allclose(reach, np.sqrt(((x - pivots.points[cell]) ** 2).sum(axis=1)))
    radius, top_radius = np.full(900, -1.0), np.full(len(pivots.top), -1.0)
    np.maximum.at(radius, cell, reach)
    np.maximum.at(top_radius, pivots.top_of[cell], far)
    asked = x[:300]
    found = np.sort(plain(asked, x), axis=1)[:, 5]
    for bound in (np.sqrt(found), np.full(300, np.inf)):
        opened = {(int(q), int(c)) for row, cells, _ in pivots.open(asked, cell[:300], bound, radius, top_radius, 6) for q, c in zip(row, cells, strict=True)}
        needed = {(q, int(cell[j])) for q in range(300) for j in np.flatnonzero(plain(asked[q : q + 1], x)[0] <= found[q]) if cell[j] != cell[q]}
        assert needed and needed <= opened
        assert len(opened) < 300 * 900 / (20 if np.isfinite(bound[0]) else 2)


def test_nearest_ids_of_many_rows_at_once():
    square = np.array([[4.0, 1.0, 1.0], [9.0, 9.0, 0.0], [5.0, 6.0, 7.0]])
    row, near, who = oversample._nearest_ids(square, np.array([np.inf, 9.0, 4.0]), np.array([5, 8, 3, 2, 7]), np.array([0, 2, 3, 5]), 3)
    assert list(zip(row.tolist(), near.tolist(), who.tolist(), strict=True)) == [(0, 1.0, 2), (0, 1.0, 3), (0, 1.0, 7), (1, 0.0, 2), (1, 0.0, 7), (1, 9.0, 3)]
