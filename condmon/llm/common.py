"""Shared helpers of the training-data operators.

Row contract used everywhere in this subpackage: a null text counts as the
empty text; columns that an operator does not need ride along untouched; an
input column whose name clashes (ignoring case) with an output column is
replaced by the output.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Arrow batches are cut to about this many text bytes before any numpy work.
SLICE_BYTES = 1 << 20
#: Rows and bytes at most in one Arrow batch that Spark hands to a Python worker.
ARROW_ROWS, ARROW_BYTES = 2000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to :data:`ARROW_ROWS` and :data:`ARROW_BYTES` so that a batch of long texts fits a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Where it is unset a local master gets a new temporary one, and a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="condmon-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/condmon/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Hand free memory back to the system at the end of a task: Python workers stay for later stages, and what one stage needed would add up with the next one's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``limit`` bytes (one longer text stands alone)."""
    n = batch.num_rows
    if not n:
        return
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < n:
        base = total[start] - sizes[start]
        end = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts on end, and the n+1 offsets of the rows; nulls are empty."""
    array = pc.fill_null(array.cast(pa.large_string() if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else pa.large_binary()), "" if not pa.types.is_binary(array.type) and not pa.types.is_large_binary(array.type) else b"")
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns of these names, ignoring case."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def append_columns(df: DataFrame, text_col: str, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list]], limit: int = SLICE_BYTES, keep_text: bool = True) -> DataFrame:
    """Add columns computed from each row's text by Arrow-batched Python.

    ``make()`` runs once per task and gives the function from a slice of rows
    to one list or array per field.  Without ``keep_text`` the text itself does
    not come back from Python.
    """
    bounded_batches(df.sparkSession)
    new = [f.name for f in fields]
    keep = [c for c in df.columns if c.lower() not in {n.lower() for n in new} and (keep_text or c != text_col)]
    source = df.withColumn("__text", F.col(f"`{text_col}`")).select(*[F.col(f"`{c}`") for c in keep], "__text")
    schema = T.StructType([source.schema[c] for c in keep] + fields)
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in slices(batch, "__text", limit):
                out = fn(part)
                columns = [part.column(i) for i in range(len(keep))]
                columns += [x if isinstance(x, pa.Array) else pa.array(x, type=k) for x, k in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *new])
        del fn
        give_back()

    return source.mapInArrow(run, schema)
