"""Registered queries of ``plans.details`` against their SQL, and batches by time."""

import datetime as dt
import inspect
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from condmon.operators import analyst
from condmon.plans import catalogue, details

SF = "/root/testdata/sf0.01"  # smaller tables have no whole frame
NAMES = [n for n, f in inspect.getmembers(details, inspect.isfunction) if f.__module__ == details.__name__]


def plain(v):
    if v is None or v != v:
        return None
    return v if isinstance(v, bool | str) else float(v) if isinstance(v, int | float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    made = catalogue.QUERIES[name](spark, SF)
    want = con.execute(catalogue.ORACLES[name])
    names = sorted(d[0] for d in want.description)
    assert sorted(made.columns) == names
    place = [[d[0] for d in want.description].index(n) for n in names]
    expected = sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=repr)
    got = sorted((tuple(plain(v) for v in r) for r in made.select(*names).collect()), key=repr)
    assert expected
    assert got == expected


def test_timed_batches_keep_the_newest(spark):
    at = [dt.datetime(2024, 1, 1, 0, m) for m in (0, 1, 2, 10)]
    rows = [("a", t, i) for i, t in enumerate(at)] + [("a", None, 9), ("b", at[0], 0)]
    d = spark.createDataFrame(rows, "series_id string, ts timestamp, seq int")
    out = analyst.timed_batches(d, ["series_id"], ["ts", "seq"], 300, 2)
    assert {(r.series_id, r.seq): r.kept for r in out.collect()} == {("a", 0): False, ("a", 1): True, ("a", 2): True, ("a", 3): True, ("a", 9): True, ("b", 0): True}
    assert out.where("ts IS NULL").select("batch").first()[0] is None
    assert analyst.timed_batches(d.where(F.lit(False)), ["series_id"], ["ts", "seq"], 300).count() == 0
