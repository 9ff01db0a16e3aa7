"""Regions of tiled maps equal those of whole maps; components of links equal a search."""

import numpy as np
from pyspark.sql import functions as F

from condmon.functions.graphs import rooted
from condmon.operators import vision

SCHEMA = "k string, x0 long, y0 long, width int, s array<double>"


def cut(key, score, size):
    h, w = score.shape
    return [(key, x, y, min(size, w - x), [float(v) for v in score[y : y + size, x : x + size].ravel()]) for y in range(0, h, size) for x in range(0, w, size)]


def spiral(n):
    out = np.zeros((n, n))
    out[::2] = 1
    out[1::4, -1] = out[3::4, 0] = 1  # one snake through all lines
    return out


def test_tiled_regions_equal_whole_maps(spark):
    rng = np.random.default_rng(6)
    maps = {"a": rng.random((30, 41)), "b": spiral(33), None: rng.random((9, 9)) * 1.2, "none": np.zeros((12, 12)), "full": np.ones((16, 16))}
    tiles = [t for k, m in maps.items() for t in cut(k, m, 7)] + [("void", 0, 0, 5, None), ("void", 5, 0, 0, []), ("void", 9, 0, 3, []), ("void", 0, 9, 2, [float("nan"), 0.0])]
    got = vision.tiled_regions(spark.createDataFrame(tiles, SCHEMA).repartition(5), ["k"], "s", 0.55).collect()
    flat = lambda k, r: (str(k), r["area"], r["peak"], r["min_x"], r["min_y"], r["max_x"], r["max_y"])
    want = sorted(flat(k, r) for k, m in maps.items() for r in vision.regions(m, 0.55))
    assert sorted(flat(r.k, r.asDict()) for r in got) == want
    assert [w for w in want if w[0] == "b"] == [("b", int(spiral(33).sum()), 1.0, 0, 0, 32, 32)]
    assert vision.tiled_regions(spark.createDataFrame([], SCHEMA), ["k"], "s").count() == 0


def test_labels_equal_a_flood():
    rng = np.random.default_rng(2)
    for inside in [rng.random((17, 23)) < p for p in (0.3, 0.6, 0.9)] + [spiral(21) > 0]:
        label, seen = vision.labelled(inside), np.full(inside.shape, inside.size)
        for start in np.flatnonzero(inside).tolist():
            todo = [divmod(start, inside.shape[1])]
            while todo:
                y, x = todo.pop()
                if 0 <= y < inside.shape[0] and 0 <= x < inside.shape[1] and inside[y, x] and seen[y, x] == inside.size:
                    seen[y, x] = start
                    todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
        assert (label == seen).all()


def test_components(spark):
    rng = np.random.default_rng(9)
    pairs = {("g", int(a), int(b)) for a, b in rng.integers(0, 120, (80, 2))} | {("h", i, i + 1) for i in range(40)} | {(None, 5, 5), (None, 6, 9)} | {("star", 1, i) for i in range(50)}
    got = {(r.k, r.node): r.root for r in rooted(spark.createDataFrame(list(pairs), "k string, a long, b long"), ["k"]).collect()}
    root = {}
    find = lambda n: n if root.setdefault(n, n) == n else find(root[n])
    for k, a, b in pairs:
        if a != b:
            x, y = sorted([find((k, a))[1], find((k, b))[1]])
            root[(k, y)] = (k, x)
    assert got == {n: find(n)[1] for n in list(root)}
    assert rooted(spark.createDataFrame([], "k string, a long, b long"), ["k"]).count() == 0


def test_a_large_region_of_many_tiles(spark):
    tiles = cut("m", spiral(64), 4)
    r = vision.tiled_regions(spark.createDataFrame(tiles, SCHEMA), ["k"], "s").select("area", F.col("max_x") - F.col("min_x")).collect()
    assert [tuple(x) for x in r] == [(int(spiral(64).sum()), 63)]
