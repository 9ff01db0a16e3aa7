"""Quality classifier: a factorisation machine over hashed words, structure statistics and the text's own metadata (sizes in bytes, words and lines; no column of labels, language or source).

Score of a text with features x: ``w0 + w.x + 1/2 sum_f ((sum_i v_if x_i)^2 -
sum_i v_if^2 x_i^2)``, the pairwise interactions of rank RANK in time linear
in the features, through the logistic function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from condmon.llm.common import SLICE_BYTES, append_columns, bounded_batches, give_back, slices, text_bytes
from condmon.llm.labelled import in_order
from condmon.llm.shingles import words

#: Buckets of hashed words, and rank of the interactions.
BUCKETS, RANK = 1 << 14, 6
STATISTICS = 18
_U = np.uint64

_KIND = np.zeros((8, 256))
for _i, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), [32, *range(9, 14)], b"!?", b"|*#$%&@^~<>{}[]\\/=+_", b".,;:'\"()-", range(128, 256))):
    _KIND[_i, list(_chars)] = 1


def _sums(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(x)])
    return total[offsets[1:]] - total[offsets[:-1]]


def describe(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Statistics (rows x STATISTICS), and the distinct hashed words of all rows: row, bucket, weight (square root of their share)."""
    rows = len(offsets) - 1
    n = np.maximum(1, np.diff(offsets))
    stats = np.zeros((rows, STATISTICS))
    if not len(text):
        stats[:, 17] = 1
        return stats, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for i in range(8):
        stats[:, i] = _sums(_KIND[i][text], offsets) / n
    h, row, a, b = words(text, offsets)
    count = np.bincount(row, minlength=rows)
    m = np.maximum(1, count)
    stats[:, 8] = np.bincount(row, weights=b - a, minlength=rows) / m / 16
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    stats[:, 9] = np.bincount(row, weights=again, minlength=rows) / m
    order = np.lexsort((h, row))
    hs, rs = h[order], row[order]
    first = np.ones(len(hs), dtype=bool)
    first[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
    places = np.flatnonzero(first)
    of, times = rs[places], np.diff(np.append(places, len(hs)))
    distinct = np.bincount(of, minlength=rows)
    stats[:, 10] = distinct / m
    most = np.zeros(rows)
    np.maximum.at(most, of, times)
    stats[:, 11] = most / m
    stats[:, 12] = np.log1p(count) / 10
    stats[:, 13] = np.log1p(np.diff(offsets)) / 12
    lines = _sums((text == 10).astype(np.float64), offsets) + 1
    stats[:, 14] = np.log1p(m / lines) / 5
    # words of capitals only, and words that end on a mark that no sentence needs
    capital = np.concatenate([[0], np.cumsum(_KIND[0][text])])
    stats[:, 15] = np.bincount(row, weights=(capital[b] - capital[a]) >= np.maximum(2, 0.6 * (b - a)), minlength=rows) / m
    marks = np.concatenate([[0], np.cumsum(_KIND[5][text])])
    stats[:, 16] = np.bincount(row, weights=(marks[b] - marks[a]) > 0, minlength=rows) / m
    stats[:, 17] = count == 0
    bucket = (hs[places] >> _U(20)).astype(np.int64) % BUCKETS
    return stats, of, bucket, np.sqrt(times / m[of])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray
    #: False where the labelled texts lacked a class: every text has the same score, which tells nothing.
    trained: bool = True


def _raw(model: Model, stats: np.ndarray, row: np.ndarray, bucket: np.ndarray, weight: np.ndarray, square_weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Score before the logistic function, and sum_i v_i x_i of every row.  Words of a bucket may be summed up to ``weight``, their squares to ``square_weight``."""
    rows = len(stats)
    squares = weight * weight if square_weight is None else square_weight
    x = np.clip((stats - model.mean) / model.scale, -5, 5) / 3
    vs = model.v[BUCKETS:]
    linear = model.w0 + x @ model.w[BUCKETS:] + np.bincount(row, weights=model.w[bucket] * weight, minlength=rows)
    total, square = x @ vs, x**2 @ vs**2
    for f in range(RANK):
        z = model.v[:, f][bucket]
        total[:, f] += np.bincount(row, weights=z * weight, minlength=rows)
        square[:, f] += np.bincount(row, weights=z * z * squares, minlength=rows)
    return linear + 0.5 * (total**2 - square).sum(axis=1), total


def _describe_all(texts: list[str], most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`describe` in slices of about ``most`` bytes, so that the driver holds the figures and not the working arrays of all texts."""
    parts, held, size, done = [], [], 0, 0
    for i, t in enumerate(texts):
        held.append(t)
        size += len(t)
        if size >= most or i == len(texts) - 1:
            stats, row, bucket, weight = describe(*text_bytes(pa.array(held, type=pa.string())))
            parts.append((stats, (row + done).astype(np.int32), bucket.astype(np.int32), weight))
            done += len(held)
            held, size = [], 0
    if not parts:
        return np.zeros((0, STATISTICS)), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0)
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(4))


def train(texts: list[str], labels: list[int], steps: int = 60, seed: int = 11) -> Model:
    """AdaGrad on the balanced logistic loss over all given texts (the caller bounds them)."""
    stats, row, bucket, weight = _describe_all(texts)
    return _fit(np.array(labels, dtype=np.float64), stats, row, bucket, weight, weight**2, steps, seed)


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole texts to their statistics and the sums over the words of each bucket: BUCKETS entries a text at most, however long it is."""
    for batch in batches:
        for part in slices(batch, "t", SLICE_BYTES):
            texts = part.column(part.schema.get_field_index("t"))
            stats, row, bucket, weight = describe(*text_bytes(texts))
            pair, of = np.unique(row * BUCKETS + bucket, return_inverse=True)
            sums = [np.bincount(of, weights=w, minlength=len(pair)) for w in (weight, weight**2)]
            cuts = np.searchsorted(pair, np.arange(len(stats) + 1) * BUCKETS)
            cells = [[x[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)] for x in ((pair % BUCKETS).astype("<i4"), *sums)]
            key = [sha256(t.as_buffer()).digest() if t.as_buffer() is not None else b"" for t in texts]
            head = [part.column(part.schema.get_field_index(n)) for n in ("id", "y", "place")]
            yield pa.RecordBatch.from_arrays([*head, pa.array(key, pa.binary()), pa.array([x.tobytes() for x in stats], pa.binary()), *[pa.array(c, pa.binary()) for c in cells]], names=["id", "y", "place", "key", "stats", "bucket", "weight", "square"])
    give_back()


def fit(sample: DataFrame) -> Model:
    """:func:`train` on the whole texts of ``labelled.chosen``: they are described on the executors, and only the figures are collected."""
    bounded_batches(sample.sparkSession)
    kind = sample.schema["id"].dataType.simpleString()
    rows = in_order(sample.select("id", "y", "place", "t").mapInArrow(_figures, f"id {kind}, y int, place long, key binary, stats binary, bucket binary, weight binary, square binary").collect())
    y = np.array([r["y"] for r in rows], dtype=np.float64)
    read = lambda name, dtype: [np.frombuffer(r[name], dtype=dtype) for r in rows]
    bucket = read("bucket", "<i4")
    whole = lambda parts: np.concatenate(parts) if parts else np.zeros(0)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(b) for b in bucket])
    return _fit(y, np.array(read("stats", "<f8")).reshape(-1, STATISTICS), row, whole(bucket), whole(read("weight", "<f8")), whole(read("square", "<f8")))


def _fit(y: np.ndarray, stats: np.ndarray, row: np.ndarray, bucket: np.ndarray, weight: np.ndarray, squares: np.ndarray, steps: int = 60, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    size = BUCKETS + STATISTICS
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS), 1.0 if not len(y) or y.max() else -1.0, np.zeros(size), np.zeros((size, RANK)), trained=False)
    mean, scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3)
    w0, w, v = 0.0, np.zeros(size), rng.normal(0, 0.01, (size, RANK))
    gw, gv, g0 = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6
    balance = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    x = np.clip((stats - mean) / scale, -5, 5) / 3
    for step in range(steps):
        model = Model(mean, scale, w0, w, v)
        raw, total = _raw(model, stats, row, bucket, weight, squares)
        d = balance * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y)
        dw = np.concatenate([np.bincount(bucket, weights=d[row] * weight, minlength=BUCKETS), x.T @ d]) + 1e-4 * w
        dv = np.empty_like(v)
        own = np.bincount(bucket, weights=d[row] * squares, minlength=BUCKETS)
        for f in range(RANK):
            dv[:BUCKETS, f] = np.bincount(bucket, weights=d[row] * weight * total[row, f], minlength=BUCKETS) - own * v[:BUCKETS, f]
            dv[BUCKETS:, f] = x.T @ (d * total[:, f]) - (x**2).T @ d * v[BUCKETS:, f]
        dv += 1e-4 * v
        rate = 0.3 / (1 + step / 30)
        g0, gw, gv = g0 + d.sum() ** 2, gw + dw**2, gv + dv**2
        w0, w, v = w0 - rate * d.sum() / np.sqrt(g0), w - rate * dw / np.sqrt(gw), v - 0.3 * rate * dv / np.sqrt(gv)
    return Model(mean, scale, float(w0), w, v)


def score(df: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds ``score`` (double, 0 to 1) of every whole text.

    Null and empty texts are scored by the statistics of a text without words.
    Repeated rows get equal scores, an empty table gives an empty one, an input
    column named ``score`` (in any case) is replaced, other columns ride along.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # (BUCKETS + STATISTICS) * (RANK + 1) numbers

    def make():
        m = shared.value

        def fn(batch: pa.RecordBatch) -> list:
            raw, _ = _raw(m, *describe(*text_bytes(batch.column(batch.num_columns - 1))))
            return [1 / (1 + np.exp(-np.clip(raw, -30, 30)))]

        return fn

    return append_columns(df, text_col, [T.StructField("score", T.DoubleType())], make, limit=1 << 20, keep_text=keep_text)
