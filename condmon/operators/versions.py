"""Versions of a model: every row is scored by the version that is valid at its time, in batch and in a running stream.

A versions table has one row a version: ``version``, ``valid_from``, ``stage``
where there are stages, and whatever the loader needs (path, digest, parameters).
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condmon.operators.inference import BATCH, Predict, _outputs, file_model

#: Versions at most, and models that a task holds at a time.
VERSIONS, HELD = 4096, 4

Load = Callable[[dict[str, Any]], Predict]


def file_models(roots: list[str]) -> Load:
    """Loader of versions with ``path`` and, where known, ``sha256``: files within the allowed folders, digest checked."""
    return lambda v: file_model(v["path"], roots, v.get("sha256"))()


def known(versions: DataFrame, stage: str | None = None) -> list[dict[str, Any]]:
    """The versions by ``valid_from`` and ``version``, with ``from`` in microseconds; versions without either take no part, of one time the greatest counts.  Over VERSIONS are an error."""
    rows = versions.where(F.col("version").isNotNull() & F.col("valid_from").isNotNull())
    if stage is not None:
        rows = rows.where(F.col("stage") == stage)
    found = rows.withColumn("from", F.unix_micros(F.col("valid_from").cast("timestamp_ltz"))).orderBy("from", "version").limit(VERSIONS + 1).collect()
    if len(found) > VERSIONS:
        raise ValueError(f"over {VERSIONS} versions: retire old ones or give a stage")
    return list({r["from"]: r.asDict(recursive=True) for r in found}.values())


def predict_versions(df: DataFrame, versions: DataFrame, load: Load, at: str = "ts", features: str = "features", out: str = "prediction", stage: str | None = None) -> DataFrame:
    """Adds ``model_version`` (text) and the output of that version's model as an array of doubles.

    The version of a row is the latest with ``valid_from`` at or before ``at``.
    Rows before all versions, without a time or without features have a null
    output (the first two a null version, too).  The table of versions, VERSIONS
    rows at most, is read when this is called and sent to the workers; rows do
    not move.  A task loads a model at its first row and holds HELD of them.
    """
    rest = [c for c in df.columns if c.lower() not in (out.lower(), "model_version")]
    schema = T.StructType([*[df.schema[c] for c in rest], T.StructField("model_version", T.StringType()), T.StructField(out, T.ArrayType(T.DoubleType()))])
    listed = known(versions, stage)
    starts = np.array([v["from"] for v in listed], dtype=np.int64)
    shared = df.sparkSession.sparkContext.broadcast(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: OrderedDict[int, Predict] = OrderedDict()

        def model(i: int) -> Predict:
            if i not in models:
                if len(models) == HELD:
                    models.popitem(last=False)
                models[i] = load(shared.value[i])
            models.move_to_end(i)
            return models[i]

        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                when = batch.column(len(rest))
                place = np.searchsorted(starts, when.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), side="right") - 1
                rows = batch.column(rest.index(features)).to_pylist()
                made: list = [None] * len(rows)
                for i in np.unique(place[place >= 0]).tolist():
                    own = np.flatnonzero(place == i).tolist()
                    if any(rows[k] is not None for k in own):
                        for k, v in zip(own, _outputs(model(i), [rows[k] for k in own]), strict=True):
                            made[k] = v
                names = [str(shared.value[i]["version"]) if i >= 0 else None for i in place.tolist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(names, pa.string()), pa.array(made, pa.list_(pa.float64()))], names=schema.names)

    return df.select(*rest, F.unix_micros(F.col(at).cast("timestamp_ltz")).alias("__at")).mapInArrow(run, schema)


def follow(read: Callable[[SparkSession], DataFrame], load: Load, write: Callable[[DataFrame, int], None], **kwargs: Any) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: reads the versions anew for every micro-batch and hands its scored rows to ``write``.  A version added to the table is used from the next micro-batch on, without a restart; rows of before its time keep the version of their time."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        write(predict_versions(rows, read(rows.sparkSession), load, **kwargs), batch_id)

    return batch


def publish(spark: SparkSession, table: str, version: dict[str, Any], schema: str) -> None:
    """Append one version to the table (Parquet) of versions; running streams take it up by :func:`follow`."""
    spark.createDataFrame([version], schema).coalesce(1).write.mode("append").parquet(table)
