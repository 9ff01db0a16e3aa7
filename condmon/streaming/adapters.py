"""Structured Streaming forms of the ordered folds, and sinks.

:func:`stateful` runs the same fold as the batch driver in
``transformWithStateInPandas``: a micro-batch's rows of a key are sorted by the
given order and folded on from the key's state, which lives in the state store
and expires after ``ttl_ms`` without rows.  Rows that arrive in a later
micro-batch than their successors are folded in arrival order, as in the
batch form of a source without event time; set a watermark on the input to drop
rows that are too late.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from condmon.functions.folds import Fold


class FoldProcessor(StatefulProcessor):
    """Runs a fold over a key's rows; with ``every_ms`` a timer at the next multiple of it calls the fold's ``tick``.

    Processing-time timers run while rows are held; event-time ones fall due when
    the watermark passes the end of the interval that a row's ``event_ms`` is in.
    """

    def __init__(self, fold: Fold, keys: list[str], order: list[str], columns: list[str], ttl_ms: int | None, every_ms: int | None, event_ms: str | None) -> None:
        self.fold, self.keys, self.order, self.columns, self.ttl_ms, self.every_ms, self.event_ms = fold, keys, order, columns, ttl_ms, every_ms, event_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fold", "state string", self.ttl_ms)

    def _known(self) -> dict:
        return json.loads(self.state.get()[0]) if self.state.exists() else {"fold": self.fold.start(), "timers": []}

    def _schedule(self, known: dict, times: list[int]) -> None:
        for end in sorted({(t // self.every_ms + 1) * self.every_ms for t in times} - set(known["timers"])):
            self.handle.registerTimer(end)
            known["timers"].append(end)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable").reset_index(drop=True)
        known = self._known()
        given = {c: [None if pd.isna(v) else v for v in frame[c]] if frame[c].map(pd.api.types.is_scalar).all() else frame[c].map(lambda v: None if v is None else list(v)).tolist() for c in self.fold.inputs}
        made = self.fold.step(known["fold"], given)
        if self.every_ms:
            self._schedule(known, [int(t) for t in frame[self.event_ms].dropna()] if self.event_ms else [] if known["timers"] else [timerValues.getCurrentProcessingTimeInMs()])
        self.state.update((json.dumps(known, default=float),))
        yield pd.concat([frame[self.columns], pd.DataFrame({f.name: pd.Series(made[f.name], dtype=object) for f in self.fold.outputs})], axis=1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, end = self._known(), expiredTimerInfo.getExpiryTimeInMs()
        made = self.fold.tick(known["fold"], end)
        known["timers"] = [t for t in known["timers"] if t != end]
        self.state.update((json.dumps(known, default=float),))
        if made:
            row = dict.fromkeys(self.columns) | dict(zip(self.keys, key, strict=True)) | made
            yield pd.DataFrame({c: pd.Series([v], dtype=object) for c, v in row.items()})

    def close(self) -> None:
        pass


def stateful(df: DataFrame, keys: list[str], order: list[str], fold: Fold, ttl_ms: int | None = None, every_ms: int | None = None, event_ms: str | None = None) -> DataFrame:
    """The streaming form of :func:`condmon.functions.folds.ordered`.  Needs the RocksDB state store provider.

    With ``every_ms`` the fold's ``tick`` is called at every multiple of it:
    of processing time, or of event time where ``event_ms`` names a column of
    whole milliseconds (the input then needs a watermark).  What a tick gives is
    a row of its keys and outputs.
    """
    names = {f.name for f in fold.outputs}
    columns = [c for c in df.columns if c not in names]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in (df.schema[c] for c in columns)] + list(fold.outputs))
    mode = "EventTime" if event_ms else "ProcessingTime" if every_ms or ttl_ms is not None else "None"
    return df.select(*columns).groupBy(*keys).transformWithStateInPandas(FoldProcessor(fold, keys, order, columns, ttl_ms, every_ms, event_ms), schema, "Append", mode)


def publish(send: Callable[[str, list[str]], None], topic: str, size: int = 100) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: rows as JSON to subscribers of ``topic`` and of ``*``, in lots of ``size`` from the executors."""
    def write(batch: DataFrame, batch_id: int) -> None:
        def part(rows) -> None:
            lot: list[str] = []
            for r in rows:
                lot.append(r)
                if len(lot) == size:
                    send(topic, lot)
                    lot = []
            if lot:
                send(topic, lot)

        batch.toJSON().foreachPartition(part)

    return write


def matches(topic: str, subscription: str) -> bool:
    """A subscription is a topic, ``*``, or a prefix that ends in ``*``."""
    return subscription in ("*", topic) or (subscription.endswith("*") and topic.startswith(subscription[:-1]))


def routed(condition: str, normal: Callable[[DataFrame, int], None], anomalous: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink of two outputs; the micro-batch is cached while both are written."""
    from condmon.functions.parsing import route

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            a, b = route(batch, condition)
            normal(a, batch_id)
            anomalous(b, batch_id)
        finally:
            batch.unpersist()

    return write
