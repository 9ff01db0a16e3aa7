"""Control rows: triggers, pending ones, timers, pause, clear and the buffer policy, in batch and in streams."""

import random

import pytest
from pyspark.sql import functions as F

from condmon.functions.folds import step_all
from condmon.operators import analyst, dataset
from condmon.streaming import adapters

KEYS, ORDER = ["series_id"], ["seq"]


def fired(fold, values, flush=None, **more):
    out = step_all(fold, {"value": values, "flush": flush or [False] * len(values), **more})
    return [(i, k, v, d) for i, (v, k, d) in enumerate(zip(out["fired"], out["kind"], out["dropped"], strict=True)) if v is not None]


def test_batch_and_manual_triggers():
    assert fired(analyst.Triggered("batch", 3), [1.0, None, 2.0, float("nan"), 3.0, 4.0]) == [(4, "batch", [1.0, 2.0, 3.0], 0)]
    flush = [True, False, True, True, False]
    assert fired(analyst.Triggered("manual"), [None, 1.0, 2.0, None, 5.0], flush) == [(2, "manual", [1.0, 2.0], 0)]
    assert fired(analyst.Triggered("manual", cap=2), [1.0, 2.0, 3.0], [False, False, True]) == [(2, "manual", [2.0, 3.0], 1)]
    with pytest.raises(ValueError):
        analyst.Triggered("never")


def test_pending_triggers_become_one():
    flush = [True, False, True, True, False]
    fold = analyst.Triggered("manual", collapse=True)
    assert fired(fold, [1.0, 2.0, 3.0, 4.0, 5.0], flush) == [(0, "manual", [1.0], 0), (4, "manual", [2.0, 3.0, 4.0, 5.0], 0)]
    assert fired(fold, [1.0, 2.0], [True, False]) == [(0, "manual", [1.0], 0)]
    assert fired(analyst.Triggered("batch", 2, collapse=True), [1.0] * 7) == [(1, "batch", [1.0, 1.0], 0), (6, "batch", [1.0] * 5, 0)]


@pytest.mark.parametrize("mode", ["batch", "manual"])
@pytest.mark.parametrize("chunk", [7, 500])
def test_triggers_in_chunks(spark, mode, chunk):
    rng = random.Random(2)
    n = 40 if chunk == 1 else 200
    rows = [(s, i, None if rng.random() < 0.2 else float(i), rng.random() < 0.06) for s in "ab" for i in range(n)]
    df = spark.createDataFrame(rows, "series_id string, seq int, value double, flush boolean")
    fold = analyst.Triggered(mode, size=6, cap=15)
    shown = lambda d: sorted(map(tuple, d.select("series_id", "seq", "kind", "fired", "dropped").collect()))
    whole = shown(analyst.triggered(df, KEYS, ORDER, fold))
    assert whole and shown(analyst.triggered(df, KEYS, ORDER, fold, F.floor(F.col("seq") / 10), chunk)) == whole
    with pytest.raises(ValueError):
        analyst.triggered(df, KEYS, ORDER, analyst.Triggered("interval"))


def collected(fold, rows):
    names = ("values", "label", "action", "rul_value")
    out = step_all(fold, {n: [r.get(n) for r in rows] for n in names})
    return [{k: out[k][i] for k in out} for i in range(len(rows))]


def test_collector_policy():
    sample = lambda x, label=None: {"values": [x], "label": label}
    act = lambda a, **more: {"action": a, **more}
    out = collected(dataset.Collector(size=2), [sample(1.0, "a"), act("pause"), sample(2.0), act("resume"), sample(3.0, "b"), sample(float("inf")), {"values": [1.0, 2.0]}, act("export"), act("stats"), sample(4.0), sample(5.0), sample(6.0), act("save"), act("clear"), act("export"), act("what")])
    assert [r["event"] for r in out] == [None, "pause", None, "resume", None, None, None, "export", "stats", None, None, None, "export", "clear", "export", "unknown"]
    assert out[7]["exported"] == [[1.0], [3.0]] and out[7]["labels"] == ["a", "b"] and out[7]["rejected"] == 2 and out[8]["samples"] == 2
    assert out[12]["exported"] == [[3.0], [4.0], [5.0], [6.0]] and out[12]["dropped"] == 1 and out[12]["collected"] == 5
    assert out[13]["collected"] == 0 and out[14]["exported"] is None
    saved = collected(dataset.Collector(size=2, autosave=True), [sample(float(i)) for i in range(5)])
    assert [(i, r["exported"]) for i, r in enumerate(saved) if r["event"]] == [(1, [[0.0], [1.0]]), (3, [[2.0], [3.0]])] and saved[4]["samples"] == 1
    rul = collected(dataset.Collector(rul_start=3.0), [sample(1.0), sample(1.0), act("resetRul", rul_value=9.0), sample(1.0), act("resetRul"), sample(1.0), act("export")])
    assert rul[-1]["labels"] == ["2.0", "1.0", "8.0", "2.0"]


def run(df, tmp_path, name, seconds=180):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(seconds)
    return q


def files(spark, tmp_path, lots, schema):
    for lot in lots:
        spark.createDataFrame(lot, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_control_stream_pauses_exports_and_clears(spark, tmp_path):
    schema = "series_id string, seq int, values array<double>, label string, action string, rul_value double"
    s = lambda i, x: ("m", i, [x], "ok", None, None)
    a = lambda i, what: ("m", i, None, None, what, None)
    lots = [[s(0, 0.0), s(1, 1.0)], [a(2, "pause"), s(3, 3.0)], [s(4, 4.0), a(5, "resume")], [s(6, 6.0), a(7, "export")], [a(8, "clear"), s(9, 9.0), a(10, "export")]]
    stream = files(spark, tmp_path, lots, schema)
    run(adapters.stateful(stream, KEYS, ORDER, dataset.Collector(size=10)), tmp_path, "collector")
    out = {r.seq: r for r in spark.table("collector").where("event is not null").collect()}
    assert sorted(out) == [2, 5, 7, 8, 10]
    assert out[7].exported == [[0.0], [1.0], [6.0]] and out[10].exported == [[9.0]] and out[10].collected == 1


def test_manual_trigger_in_a_stream_collapses(spark, tmp_path):
    schema = "series_id string, seq int, value double, flush boolean"
    lots = [[("m", 0, 0.0, False), ("m", 1, 1.0, False)], [("m", 2, 2.0, True), ("m", 3, 3.0, True), ("m", 4, 4.0, False)], [("m", 5, 5.0, False)]]
    stream = files(spark, tmp_path, lots, schema)
    run(adapters.stateful(stream, KEYS, ORDER, analyst.Triggered("manual", collapse=True)), tmp_path, "manual")
    out = [(r.seq, r.kind, r.fired) for r in spark.table("manual").where("fired is not null").orderBy("seq").collect()]
    assert out == [(2, "manual", [0.0, 1.0, 2.0]), (4, "manual", [3.0, 4.0])]


def test_event_time_interval_equals_timed_batches(spark, tmp_path):
    schema = "series_id string, seq int, ms long, value double, flush boolean"
    rows = [(s, i, 1_000 * i + 10, float(i), False) for i in range(24) for s in "xy"]
    lots = [rows[i : i + 12] for i in range(0, 48, 12)] + [[("x", 99, 100_000, 0.0, False)], [("x", 100, 100_001, 0.0, False)]]
    stream = files(spark, tmp_path, lots, schema).withColumn("ts", F.expr("timestamp_millis(ms)")).withWatermark("ts", "1 second")
    run(adapters.stateful(stream, KEYS, ORDER, analyst.Triggered("interval", event_ms="ms"), every_ms=5_000, event_ms="ms"), tmp_path, "timed")
    out = sorted((r.series_id, r.fired, r.kind) for r in spark.table("timed").where("fired is not null").collect())
    assert out == sorted((s, [float(i) for i in range(k, min(k + 5, 24))], "interval") for s in "xy" for k in range(0, 24, 5))
    batch = analyst.timed_batches(spark.createDataFrame(rows, schema).withColumn("ts", F.expr("timestamp_millis(ms)")), KEYS, ["ts"], 5)
    assert sorted((r.series_id, sorted(r.v)) for r in batch.groupBy("series_id", "batch").agg(F.collect_list("value").alias("v")).collect()) == [(s, v) for s, v, _ in out]


def test_processing_time_interval_fires_without_new_rows_of_the_key(spark, tmp_path):
    schema = "series_id string, seq int, value double, flush boolean"
    stream = files(spark, tmp_path, [[("x", 0, 7.0, False)], [("y", 0, 8.0, False)]], schema)
    out = adapters.stateful(stream, KEYS, ORDER, analyst.Triggered("interval"), every_ms=200)
    q = out.writeStream.format("memory").queryName("ticks").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            q.awaitTermination(1)
            got = sorted((r.series_id, r.fired) for r in spark.table("ticks").where("fired is not null").collect())
            if len(got) == 2:
                break
    finally:
        q.stop()
    assert got == [("x", [7.0]), ("y", [8.0])]


def test_topics(spark):
    from condmon.functions.parsing import output_topic

    df = spark.createDataFrame([("a",), ("",), (None,)], "topic string")
    shown = lambda *args: [r.topic for r in output_topic(df, *args).collect()]
    assert shown() == ["a", None, None] and shown("out") == ["out"] * 3
    assert shown("out", "multi") == ["out", None, None] and shown("", "multi") == ["a", None, None]
    assert shown("out", "batch") == ["a", "batch-analysis", "batch-analysis"]
    assert output_topic(df.drop("topic").selectExpr("1 as x"), "out").columns == ["x", "topic"]
    with pytest.raises(ValueError):
        output_topic(df, "out", "other")
