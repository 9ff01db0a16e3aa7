"""Batch equals stream; file sources and sinks."""

import random

import pytest

from condmon.config import AnomalySettings
from condmon.functions import folds
from condmon.operators import anomaly
from condmon.sources import files
from condmon.streaming import adapters


@pytest.mark.parametrize("step", [7, 20])
def test_stream_equals_batch(spark, tmp_path, step):
    rng = random.Random(9)
    rows = [(n, {"a": rng.gauss(10, 2) * (4 if n % 17 == 3 else 1), "b": 5 + 0.2 * n + rng.gauss(0, 1)}) for n in range(60)]
    schema = "n long, sensors map<string,double>"
    for i in range(0, 60, step):  # one file a micro-batch
        spark.createDataFrame(rows[i : i + step], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = AnomalySettings(method="ema", window=15)

    def shape(df):
        return df.selectExpr("n", "explode(sensors) as (series_id, value)")

    batch = anomaly.detect(shape(spark.createDataFrame(rows, schema)), s, ["series_id"], ["n"])
    stream = shape(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    out = adapters.stateful(stream, ["series_id"], ["n"], folds.Detector(s))
    name = f"out{step}"
    q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    key = lambda df: sorted((r.series_id, r.n, r.severity or "", str(r.is_anomaly)) for r in df.select("series_id", "n", "severity", "is_anomaly").collect())
    assert key(spark.table(name)) == key(batch)


def test_files(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text('{"timestamp": "2024-01-01T00:00:00Z", "machineId": "m", "sensors": {"a": {"value": 1.5, "unit": "C"}}}')
    assert files.snapshot(spark, str(p)).first().sensors == {"a": 1.5}
    n = tmp_path / "n.ndjson"
    n.write_text('{"t": 1.0, "x": 2.0, "y": 3.0}\n{"t": 2.0, "x": 4.0, "y": 5.0}\n')
    assert files.ndjson(spark, str(n)).count() == 4


def test_sinks(spark):
    assert adapters.matches("a/b", "a/*") and adapters.matches("x", "*") and not adapters.matches("x", "y")
    got = []
    adapters.routed("is_anomaly", lambda d, i: got.append(("n", d.count())), lambda d, i: got.append(("a", d.count())))(spark.createDataFrame([(True,), (False,), (None,)], "is_anomaly boolean"), 0)
    assert got == [("n", 2), ("a", 1)]
