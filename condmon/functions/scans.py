"""Ordered folds over series too long for one task: summaries of chunks, composed, then replayed.

1. A series is cut into chunks (:func:`condmon.functions.chunks.numbered`).
   Every chunk gives a summary of what it does to any state, and the end that
   it leads to from the state it was run from (at first the empty one).
2. The summaries of a series, one row a chunk, are composed in order: that gives
   each chunk the state it starts from.  Where a summary cannot tell (it says
   None), the chunk is run again from the state believed so far, with all others
   in that case, until every chunk has been run from, or its summary holds for,
   the state it really starts from.
3. Every chunk is replayed from its state.

Averages compose as affine maps and hystereses as transition tables, so they are
settled in one round.  Cumulative sums compose as maxima of sums while nothing
exceeds the limit, and forget their start where they touch zero before that; a
chunk between two such states is run again.  What is not settled after ROUNDS is
folded serially by key, which is slow but the same.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condmon.functions.chunks import numbered
from condmon.functions.folds import Fold, ordered
from condmon.functions.lineage import written

ROUNDS = 8


def _pieces(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Runs of rows of one chunk within batches, and whether a chunk begins there."""
    now = None
    for batch in batches:
        marks = list(zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in [*keys, "__chunk"]], strict=True))
        start = 0
        while start < len(marks):
            end = start + 1
            while end < len(marks) and marks[end] == marks[start]:
                end += 1
            yield marks[start] != now, batch.slice(start, end - start)
            now, start = marks[start], end


def _columns(piece: pa.RecordBatch, names: tuple[str, ...]) -> dict[str, list]:
    return {c: piece.column(piece.schema.get_field_index(c)).to_pylist() for c in names}


def _runs(rows: DataFrame, keys: list[str], fold: Fold) -> DataFrame:
    """(keys, __chunk, __from, __end, __summary): each chunk run from ``__from``."""
    kept = rows.select(*keys, "__chunk", "__i", "__from", *fold.inputs)
    schema = T.StructType([*(kept.schema[k] for k in [*keys, "__chunk", "__from"]), T.StructField("__end", T.StringType()), T.StructField("__summary", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held = None, {}

        def done() -> pa.RecordBatch:
            state = json.loads(head.column(head.schema.get_field_index("__from"))[0].as_py())
            summary = fold.summary(held)
            fold.step(state, held)
            made = [pa.array([json.dumps(x)]) for x in (state, summary)]
            return pa.RecordBatch.from_arrays([*(head.column(head.schema.get_field_index(k)) for k in [*keys, "__chunk", "__from"]), *made], names=schema.names)

        for new, piece in _pieces(batches, keys):
            if new and head is not None:
                yield done()
            if new:
                head, held = piece.slice(0, 1), {c: [] for c in fold.inputs}
            for c, v in _columns(piece, fold.inputs).items():
                held[c].extend(v)
        if head is not None:
            yield done()

    return _dealt(kept, keys).mapInArrow(run, schema)


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(*keys, "__chunk").sortWithinPartitions(*keys, "__chunk", "__i")


def _composed(runs: DataFrame, keys: list[str], fold: Fold) -> DataFrame:
    """(keys, __chunk, __start, __again): the state each chunk starts from as far as known, and whether it must be run again."""
    schema = T.StructType([*(runs.schema[k] for k in [*keys, "__chunk"]), T.StructField("__start", T.StringType()), T.StructField("__again", T.BooleanType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("__chunk", "ascending")])
        state, starts, again = fold.start(), [], []
        for was, end, summary in zip(*[table.column(c).to_pylist() for c in ("__from", "__end", "__summary")], strict=True):
            starts.append(json.dumps(state))
            exact = json.loads(was) == state
            after = json.loads(end) if exact else fold.carry(state, json.loads(summary))
            again.append(after is None)
            state = json.loads(end) if after is None else after
        return pa.Table.from_arrays([*(table.column(k) for k in [*keys, "__chunk"]), pa.array(starts, pa.string()), pa.array(again, pa.bool_())], names=schema.names)

    return runs.groupBy(*keys).applyInArrow(run, schema)


def _replayed(rows: DataFrame, keys: list[str], fold: Fold, names: list[str]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    kept = [c for c in rows.columns if c not in ("__chunk", "__i", "__start")]
    kinds = [to_arrow_type(f.dataType) for f in fold.outputs]
    schema = T.StructType([*(rows.schema[c] for c in kept), *fold.outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for new, piece in _pieces(batches, keys):
            if new:
                state = json.loads(piece.column(piece.schema.get_field_index("__start"))[0].as_py())
            out = fold.step(state, _columns(piece, fold.inputs))
            yield pa.RecordBatch.from_arrays([*(piece.column(piece.schema.get_field_index(c)) for c in kept), *(pa.array(out[n], type=k) for n, k in zip(names, kinds, strict=True))], names=schema.names)

    return _dealt(rows, keys).mapInArrow(run, schema)


def scanned(df: DataFrame, keys: list[str], order: list[str], fold: Fold, bucket: Column, chunk: int = 1_000_000) -> DataFrame:
    """As :func:`condmon.functions.folds.ordered`, with a series dealt over as many tasks as it has chunks.  ``bucket`` must not fall along the order; keys must not be null.  A column ``__i`` that :func:`condmon.functions.chunks.sliding` has left is taken for the row numbers."""
    names = [f.name for f in fold.outputs]
    df = df.select(*[c for c in df.columns if c not in names])
    placed = df if "__i" in df.columns else numbered(df, keys, order, bucket)
    rows = written(placed.withColumn("__chunk", F.floor(F.col("__i") / chunk).cast("long")), "scan-rows")
    fresh = F.lit(json.dumps(fold.start()))
    runs = written(_runs(rows.withColumn("__from", fresh), keys, fold), "scan-runs")
    for _ in range(ROUNDS):
        starts = written(_composed(runs, keys, fold), "scan-starts")
        open_ = starts.where("__again")
        if open_.isEmpty():
            return _replayed(rows.join(starts.drop("__again"), [*keys, "__chunk"]), keys, fold, names)
        more = _runs(rows.join(open_.select(*keys, "__chunk", F.col("__start").alias("__from")), [*keys, "__chunk"]), keys, fold)
        runs = written(runs.join(open_.select(*keys, "__chunk"), [*keys, "__chunk"], "left_anti").unionByName(more), "scan-runs")
    return ordered(df.drop("__i"), keys, order, fold)
