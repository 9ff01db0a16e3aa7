"""Rows are scored by the model version of their time."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from condmon.operators import versions
from condmon.plans import catalogue
from condmon.plans.versions import ml_versions

SCHEMA = "version string, valid_from timestamp, stage string, factor double"
START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


@pytest.fixture
def load():
    return lambda version: lambda x: x.sum(axis=1) * version["factor"]


def test_versions_by_time(spark, load):
    rng = random.Random(4)
    table = [("a", at(10), "production", 1.0), ("b", at(20), "production", 2.0), ("c", at(20), "production", 3.0), ("d", at(25), "staging", 9.0), ("e", at(40), "production", 4.0), (None, at(1), "production", 7.0), ("f", None, "production", 7.0)]
    many = [(f"m{i:02}", at(50 + i), "production", float(i)) for i in range(2 * versions.HELD)]
    rows = [(i, None if i % 29 == 7 else at(rng.randrange(80)), None if i % 17 == 3 else [float(i)] * (1 + i % 3), "old") for i in range(3000)]
    d = spark.createDataFrame(rows, "n int, ts timestamp, features array<double>, Prediction string").repartition(3)
    found = versions.predict_versions(d, spark.createDataFrame(table + many, SCHEMA), load, stage="production")
    assert found.columns == ["n", "ts", "features", "model_version", "prediction"]
    valid = sorted((r for r in table + many if r[0] and r[1] and r[2] == "production"), key=lambda r: (r[1], r[0]))
    for r in found.collect():
        _, ts, x, _ = rows[r.n]
        own = [v for v in valid if ts is not None and v[1] <= ts][-1:]
        assert r.model_version == (own[0][0] if own else None)
        assert r.prediction == ([sum(x) * own[0][3]] if own and x is not None else None)
    empty = spark.createDataFrame([], SCHEMA)
    assert {(r.model_version, r.prediction) for r in versions.predict_versions(d, empty, load).collect()} == {(None, None)}
    assert versions.predict_versions(d.limit(0), empty, load).count() == 0


def test_too_many_versions(spark):
    table = spark.range(versions.VERSIONS + 1).select(F.col("id").cast("string").alias("version"), F.timestamp_seconds("id").alias("valid_from"))
    with pytest.raises(ValueError, match="versions"):
        versions.known(table)


def test_stream_takes_up_a_version(spark, load, tmp_path):
    place, source, seen = str(tmp_path / "versions"), str(tmp_path / "in"), []
    row = lambda v, m, f: {"version": v, "valid_from": at(m), "stage": "production", "factor": f}
    versions.publish(spark, place, row("one", 0, 1.0), SCHEMA)
    put = lambda rows: spark.createDataFrame([(n, at(m), [1.0]) for n, m in rows], "n int, ts timestamp, features array<double>").coalesce(1).write.mode("append").parquet(source)
    put([(1, 5), (2, 15)])
    stream = spark.readStream.schema("n int, ts timestamp, features array<double>").parquet(source)
    keep = lambda df, i: seen.extend((r.n, r.model_version, r.prediction[0]) for r in df.collect())
    q = stream.writeStream.foreachBatch(versions.follow(lambda s: s.read.parquet(place), load, keep)).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        versions.publish(spark, place, row("two", 10, 2.0), SCHEMA)
        put([(3, 5), (4, 15)])  # an old row and a new one, after the version came
        q.processAllAvailable()
        assert q.exception() is None
    finally:
        q.stop()
    assert sorted(seen) == [(1, "one", 1.0), (2, "one", 1.0), (3, "one", 1.0), (4, "two", 2.0)]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    want = con.execute(f"SELECT series_id, seq, model_version, score FROM ({catalogue.ORACLES['ml_versions']}) ORDER BY seq").fetchall()
    got = [tuple(r) for r in ml_versions(spark, sf).orderBy("seq").collect()]
    assert got == want and len({r[2] for r in got}) > 2
