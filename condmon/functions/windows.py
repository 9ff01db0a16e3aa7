"""Sliding windows that need their values in order (quartiles, percentiles, rank correlation), and moments of pairs.

The window is a queue and a sorted list: a new value is inserted by bisection
and the one that leaves is removed, where a window function would sort anew for
every row.  As folds they run by key, in chunks (:mod:`condmon.functions.chunks`)
and in streams.  Moments are taken of many windows at a time, whatever series
they are of.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condmon.functions.folds import Fold, _finite, field


class OrderStatistics(Fold):
    """Of the last ``window`` finite values: ``buffer_size``, quartiles without interpolation (``q1``, ``q2``, ``q3``: the value at floor(n p)) and percentiles ``low`` and ``high`` (0 to 100) by linear interpolation."""

    outputs = (field("buffer_size", "long"), *(field(n, "double") for n in ("q1", "q2", "q3", "low", "high")))

    def __init__(self, window: int, low: float = 5.0, high: float = 95.0) -> None:
        self.window, self.ends = window, (low / 100, high / 100)

    def start(self) -> dict:
        return {"buffer": []}

    def step(self, state, columns):
        queue = deque(state["buffer"])
        row, out = sorted(queue), []
        for x in columns["value"]:
            if not _finite(x):
                out.append((len(row),) + (None,) * 5)
                continue
            queue.append(x)
            insort(row, x)
            if len(queue) > self.window:
                del row[bisect_left(row, queue.popleft())]
            n = len(row)
            ends = []
            for p in self.ends:
                k, part = divmod(p * (n - 1), 1)
                a, b = row[int(k)], row[min(int(k) + 1, n - 1)]
                ends.append(a + (b - a) * part)
            out.append((n, row[int(n * 0.25)], row[int(n * 0.5)], row[int(n * 0.75)], *ends))
        state["buffer"] = list(queue)
        return {f.name: [o[k] for o in out] for k, f in enumerate(self.outputs)}


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1 along the rows; ties share the mean of theirs."""
    n = x.shape[1]
    order = np.argsort(x, axis=1, kind="stable")
    s = np.take_along_axis(x, order, axis=1)
    first, last = np.ones(x.shape, bool), np.ones(x.shape, bool)
    first[:, 1:] = s[:, 1:] != s[:, :-1]
    last[:, :-1] = first[:, 1:]
    place = np.arange(n)
    low = np.maximum.accumulate(np.where(first, place, 0), axis=1)
    high = np.minimum.accumulate(np.where(last, place, n)[:, ::-1], axis=1)[:, ::-1]
    out = np.empty(x.shape)
    np.put_along_axis(out, order, (low + high) / 2 + 1, axis=1)
    return out


class RankCorrelation(Fold):
    """Spearman's correlation of the last ``window`` pairs, three at least; pairs with a side that is null or not finite have none and join no buffer."""

    inputs = ("__x", "__y")
    outputs = (field("correlation", "double"),)

    def __init__(self, window: int) -> None:
        self.window = window

    def start(self) -> dict:
        return {"x": [], "y": []}

    def step(self, state, columns):
        good = [i for i, (a, b) in enumerate(zip(columns["__x"], columns["__y"], strict=True)) if _finite(a) and _finite(b)]
        out: list[float | None] = [None] * len(columns["__x"])
        held = len(state["x"])
        x, y = (np.array([*state[s], *[columns[f"__{s}"][i] for i in good]], dtype=np.float64) for s in ("x", "y"))
        state["x"], state["y"] = x[-self.window :].tolist(), y[-self.window :].tolist()
        ends = held + np.arange(len(good))
        sizes = np.minimum(ends + 1, self.window)
        for size in np.unique(sizes[sizes >= 3]).tolist():
            which = np.flatnonzero(sizes == size)
            for part in np.array_split(which, max(1, len(which) * size >> 19)):
                rx, ry = (average_ranks(np.lib.stride_tricks.sliding_window_view(v, size)[ends[part] - size + 1]) for v in (x, y))
                rx, ry = rx - (size + 1) / 2, ry - (size + 1) / 2
                bottom = np.sqrt((rx**2).sum(axis=1) * (ry**2).sum(axis=1))
                r = np.divide((rx * ry).sum(axis=1), bottom, out=np.zeros(len(part)), where=bottom > 0)
                for i, v in zip(part.tolist(), r.tolist(), strict=True):
                    out[good[i]] = v
        return {"correlation": out}


#: What :func:`moments` adds: rows; of x, of y and of whole pairs the values that are not null, the sums of their squares (products) about the mean; and what a row's own values are off the means.
MOMENTS = (*(field(f"__{n}", "long") for n in ("n", "nx", "ny", "nxy")), *(field(f"__{n}", "double") for n in ("sxx", "syy", "sxy", "dx", "dy")))
#: Windows taken at a time.
_WINDOWS = 2048


def _centred(w: np.ndarray, there: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Windows less their means, and the counts; what is not ``there`` is 0.  First less one of their own values, so that equal values give 0 and no rounding."""
    if there is None:
        w = w - w[:, -1:]
        return w - w.mean(axis=1, keepdims=True), np.full(len(w), w.shape[1])
    n = there.sum(axis=1)
    w = np.where(there, w - np.take_along_axis(w, there.argmax(axis=1)[:, None], axis=1), 0.0)
    return np.where(there, w - w.sum(axis=1, keepdims=True) / np.maximum(n, 1)[:, None], 0.0), n


def _moments(x: np.ndarray, y: np.ndarray, has_x: np.ndarray, has_y: np.ndarray, ends: np.ndarray, sizes: np.ndarray, rows: int) -> dict[str, np.ndarray]:
    """:data:`MOMENTS` of the windows of ``sizes`` values up to the places ``ends``."""
    views = [np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(rows - 1, v.dtype), v]), rows) for v in (x, y, has_x, has_y)]
    out = {f.name: np.zeros(len(ends), np.int64 if f.dataType == T.LongType() else np.float64) for f in MOMENTS}
    out["__n"] = sizes
    gaps = np.concatenate([[0], np.cumsum(~(has_x & has_y))])
    whole = (sizes == rows) & (gaps[ends + 1] == gaps[ends + 1 - sizes])
    for plain in (True, False):
        which = np.flatnonzero(whole == plain)
        for i in range(0, len(which), _WINDOWS):
            part = which[i : i + _WINDOWS]
            wx, wy, hx, hy = (v[ends[part]] if not plain or k < 2 else None for k, v in enumerate(views))
            if plain:
                (cx, nx), (cy, ny) = _centred(wx, None), _centred(wy, None)
                px, py, nxy = cx, cy, nx
            else:
                inside = np.arange(rows) >= rows - sizes[part][:, None]
                hx, hy = hx & inside, hy & inside
                (cx, nx), (cy, ny) = _centred(wx, hx), _centred(wy, hy)
                (px, nxy), (py, _) = _centred(wx, hx & hy), _centred(wy, hx & hy)
            for name, v in (("nx", nx), ("ny", ny), ("nxy", nxy), ("dx", cx[:, -1]), ("dy", cy[:, -1])):
                out[f"__{name}"][part] = v
            for name, a, b in (("sxx", cx, cx), ("syy", cy, cy), ("sxy", px, py)):
                out[f"__{name}"][part] = np.einsum("ij,ij->i", a, b)
    return out


def moments(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, rows: int) -> DataFrame:
    """Adds :data:`MOMENTS` of the last ``rows`` pairs of each series: sums about the mean of each window, two passes over it, with nothing carried on that could drift.

    Rows stream through sorted by key; the last ``rows - 1`` of a batch are kept for the next.
    """
    given = df.withColumn("__x", F.col(x).cast("double")).withColumn("__y", F.col(y).cast("double"))
    schema = T.StructType([*df.schema.fields, *MOMENTS])
    kept = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, [np.zeros(0), np.zeros(0), np.zeros(0, bool), np.zeros(0, bool)]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            new = np.zeros(n, bool)
            for c in columns:
                codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            new[0] = last is None or [c[0].as_py() for c in columns] != last
            last = [c[n - 1].as_py() for c in columns]
            if new[0]:
                held = [h[:0] for h in held]
            values = [batch.column(batch.schema.get_field_index(c)) for c in ("__x", "__y")]
            here = [*(v.fill_null(0.0).to_numpy(zero_copy_only=False) for v in values), *(v.is_valid().to_numpy(zero_copy_only=False) for v in values)]
            before = len(held[0])
            whole = [np.concatenate(p) for p in zip(held, here, strict=True)]
            ends = before + np.arange(n)
            begins = np.maximum.accumulate(np.where(new, ends, 0))
            made = _moments(*whole, ends, np.minimum(ends - begins + 1, rows), rows)
            made["__dx"], made["__dy"] = (pa.array(made[name], mask=~ok) for name, ok in (("__dx", here[2]), ("__dy", here[3])))
            held = [w[max(begins[-1], len(w) - (rows - 1)) :] if rows > 1 else w[:0] for w in whole]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *(pa.array(made[f.name]) for f in MOMENTS)], names=schema.names)

    return given.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
