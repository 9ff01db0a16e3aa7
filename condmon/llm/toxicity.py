"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on pieces of ordinary texts, one on
what toxic texts hold besides (runs of their bytes made of strings of GRAM bytes
that ordinary texts rarely have).  Overlapping windows of running text are compressed
with the ordinary dictionary alone and with the toxic one before it, so that
both know the ordinary language equally well; what the second saves on a window
is its gain.  The gains of all windows of a text give its features: windows
over a threshold (count and share), the largest two, and the mean.  A logistic
model on them gives the score.

Dictionaries are trained on three fifths of the training rows; the size of the
toxic one, the threshold and the model are calibrated on the other two fifths,
which the dictionaries have not seen.

Trained dictionaries are loaded as raw content: their entropy tables would code
the letters of a window so well that a match saves little of what is measured.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condmon.llm.common import SLICE_BYTES, append_columns, bounded_batches, give_back, slices, text_bytes
from condmon.llm.labelled import in_order

#: Bytes of a window, and from one window to the next.
WINDOW, STRIDE = 48, 24
#: Bytes of a piece that dictionaries are trained on, and pieces of a text at most, spread evenly over it.
PIECE, PIECES = 256, 64
#: Bytes of the ordinary dictionary; sizes of the toxic one that are tried.
ORDINARY, TOXIC = 112 << 10, (256, 512, 1024, 2048, 4096)
#: Segment and string lengths of the dictionary trainer; strings by which toxic text is told from ordinary text.
SEGMENT, GRAM = 16, 6
#: Such a string is in so many toxic texts, and so many times as frequent there.
SEVERAL, LIFT = 4, 12
#: Gains that are tried as threshold.
THRESHOLDS = range(1, 13)
PARAMETERS = {"window_log": 18, "hash_log": 16, "chain_log": 17, "search_log": 7, "min_match": 4, "target_length": 64, "strategy": zstandard.STRATEGY_LAZY2, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    threshold: int
    weights: tuple[float, ...]


#: Where a class is missing: every text has the same low score.
NOTHING = Model(b"\0" * 8, b"\0" * 8, 1, (-3.0, 0.0, 0.0, 0.0, 0.0, 0.0))


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts on end: start and length of every window, and windows of each text.  The last window ends where its text does; an empty text has none."""
    sizes = np.diff(offsets)
    count = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE)), 0)
    row = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(sizes[row], WINDOW)
    return offsets[:-1][row] + np.minimum(nth * STRIDE, sizes[row] - length), length, count


class Coders:
    """Compressed sizes of windows with the ordinary dictionary and with each toxic one before it."""

    def __init__(self, ordinary: bytes, toxic: list[bytes]) -> None:
        parameters = zstandard.ZstdCompressionParameters(**PARAMETERS)
        load = lambda d: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=parameters)
        self.coders = [load(ordinary), *[load(t + ordinary) for t in toxic]]

    def gains(self, text: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """For each toxic dictionary the gains of all windows, and the windows of each text."""
        start, length, count = windows(offsets)
        raw = _LOWER[text].tobytes()
        found: list[list[int]] = [[] for _ in self.coders]
        for i in range(0, len(start), 50_000):
            places = np.stack([start[i : i + 50_000], length[i : i + 50_000]], axis=1).astype("<u8")
            buffer = zstandard.BufferWithSegments(raw, places.tobytes())
            for sizes, coder in zip(found, self.coders, strict=True):
                out = coder.multi_compress_to_buffer(buffer)
                sizes.extend(len(out[k]) for k in range(len(out)))
        base, *others = (np.array(f, dtype=np.int64) for f in found)
        return [base - o for o in others], count


def figures(gain: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Per text: windows over each of THRESHOLDS, the largest two gains, sum of gains, windows."""
    out = np.zeros((len(count), len(THRESHOLDS) + 4), dtype=np.int64)
    row = np.repeat(np.arange(len(count)), count)
    for k, t in enumerate(THRESHOLDS):
        out[:, k] = np.bincount(row[gain >= t], minlength=len(count))
    full = np.flatnonzero(count)
    if len(full):
        ends = np.cumsum(count)[full]
        order = np.lexsort((gain, row))
        ranked = np.maximum(0, gain[order])
        out[full, -4] = ranked[ends - 1]
        out[full, -3] = np.where(count[full] > 1, ranked[np.maximum(0, ends - 2)], 0)
    out[:, -2] = np.bincount(row, weights=gain, minlength=len(count)).astype(np.int64)
    out[:, -1] = count
    return out


def features(f: np.ndarray, threshold: int) -> np.ndarray:
    over, n = f[:, threshold - THRESHOLDS[0]], np.maximum(1, f[:, -1])
    return np.stack([np.log1p(over), over / n, f[:, -4] / 8, f[:, -3] / 8, np.clip(f[:, -2] / n, -4, 4)], axis=1)


def _pieces(raw: bytes) -> list[bytes]:
    """At most PIECES pieces, spread over the whole text, lower-cased."""
    step = max(PIECE, -(-len(raw) // PIECES))
    return [raw[i : i + PIECE].lower() for i in range(0, len(raw), step)]


def _grams(raw: bytes) -> np.ndarray:
    """Every string of GRAM bytes as a number."""
    words = np.ndarray((len(raw),), dtype="<u8", buffer=raw + b"\0" * 8, strides=(1,))[: max(0, len(raw) - GRAM + 1)]
    return words & _U((1 << 8 * GRAM) - 1)


def _texts_with(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Strings of GRAM bytes in order, and the texts that have each."""
    each = [np.unique(np.concatenate([_grams(p) for p in t])) for t in texts if t]
    return np.unique(np.concatenate(each or [np.zeros(0, _U)]), return_counts=True)


def _telling(good: list[list[bytes]], bad: list[list[bytes]]) -> np.ndarray:
    """Strings (in order) of several toxic texts that are LIFT times rarer in ordinary texts."""
    known, often = _texts_with(good)
    strings, texts = _texts_with(bad)
    at = np.minimum(np.searchsorted(known, strings), max(0, len(known) - 1))
    ordinary = np.where(known[at] == strings, often[at], 0) if len(known) else np.zeros(len(strings), np.int64)
    strange = texts * len(good) >= LIFT * (ordinary + 0.5) * len(bad)
    several = strange & (texts >= min(SEVERAL, len(bad)))
    return strings[several if several.any() else strange]


def _runs(piece: bytes, telling: np.ndarray) -> list[bytes]:
    """The runs of a piece that telling strings cover."""
    grams = _grams(piece)
    if not len(grams) or not len(telling):
        return []
    found = np.flatnonzero(telling[np.minimum(np.searchsorted(telling, grams), len(telling) - 1)] == grams)
    change = np.zeros(len(piece) + 1, dtype=np.int64)
    np.add.at(change, found, 1)
    np.add.at(change, found + GRAM, -1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(change[:-1]) > 0, [0]])))
    return [piece[a:b] for a, b in edge.reshape(-1, 2).tolist()]


def _trained(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary of ``size`` bytes, the most useful last; samples too few for the trainer are the content themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT if size < ORDINARY else SEGMENT * 3 // 2, d=GRAM, f=20, accel=1, split_point=1.0).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b"\0" * 8


def dictionaries(good: list[list[bytes]], bad: list[list[bytes]]) -> tuple[bytes, list[bytes]]:
    """The ordinary dictionary and the toxic ones of all sizes, from the pieces of each text."""
    telling = _telling(good, bad)
    strange = _trained([s for t in bad for p in t for s in _runs(p, telling)], max(TOXIC))
    return _trained([p for t in good for p in t], ORDINARY), [strange[-size:] for size in TOXIC]


def _least(raw: bytes) -> list[int]:
    """The least four hashes of the word triples."""
    words = raw.lower().split()
    return sorted({crc32(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))})[:4]


def _originals(rows: list) -> list:
    """Rows that are no near copies of earlier ones, by the least hashes of their word triples: what only a family of copies has tells nothing."""
    seen: set[int] = set()
    out = []
    for r in rows:
        if seen.isdisjoint(r["least"]):
            out.append(r)
        seen.update(r["least"])
    return out


def _rows_of(make, names: list[str]):
    """mapInArrow function over ``labelled.chosen`` rows: id, label, place and key with ``make(texts)``'s columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", SLICE_BYTES):
                texts = part.column(part.schema.get_field_index("t"))
                head = [part.column(part.schema.get_field_index(n)) for n in ("id", "y", "place")]
                key = [sha256(t.encode("utf-8")).digest() for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([*head, pa.array(key, pa.binary()), *make(texts)], names=["id", "y", "place", "key", *names])
        give_back()

    return run


def fit(sample: DataFrame) -> Model:
    """The model from ``labelled.chosen`` rows.

    The executors cut texts into pieces and compress the whole texts; the driver
    collects at most PIECES pieces of PIECE bytes a row, and then figures.
    Equal texts and near copies count once in training.
    """
    bounded_batches(sample.sparkSession)
    head = f"id {sample.schema['id'].dataType.simpleString()}, y int, place long, key binary"
    texts = sample.select("id", "y", "place", "t")

    def cut(column: pa.Array) -> list:
        raw = [t.encode("utf-8") for t in column.to_pylist()]
        return [pa.array([_least(r) for r in raw], pa.list_(pa.int64())), pa.array([_pieces(r) for r in raw], pa.list_(pa.binary()))]

    first = F.pmod("place", F.lit(5)) < 3
    held = lambda where: in_order(texts.where(where).mapInArrow(_rows_of(cut, ["least", "pieces"]), f"{head}, least array<bigint>, pieces array<binary>").collect())
    rows = held(first)
    rest = ~first
    if {r["y"] for r in rows} != {0, 1}:  # too few rows to part
        rows, rest = held(F.lit(True)), F.lit(True)
    good, bad = ([[bytes(p) for p in r["pieces"]] for r in _originals([r for r in rows if r["y"] == y])] for y in (0, 1))
    del rows
    if not good or not bad:
        return NOTHING
    ordinary, toxic = dictionaries(good, bad)

    def measured(column: pa.Array) -> list:
        gains, count = _worker(ordinary, *toxic).gains(*text_bytes(column))
        return [pa.array([f.tolist() for f in figures(g, count)], pa.list_(pa.int64())) for g in gains]

    names = [f"f{size}" for size in TOXIC]
    run, kind = _rows_of(measured, names), ", ".join([head, *[f"{n} array<bigint>" for n in names]])
    found = in_order(texts.where(rest).mapInArrow(run, kind).collect())
    if {r["y"] for r in found} != {0, 1}:
        found = in_order(texts.mapInArrow(run, kind).collect())
    y = np.array([r["y"] for r in found], dtype=np.float64)
    best = None
    for name, dictionary in zip(names, toxic, strict=True):
        f = np.array([r[name] for r in found], dtype=np.int64)
        for threshold in THRESHOLDS:
            loss, w = _logistic(features(f, threshold), y)
            if best is None or loss < best[0]:
                best = loss, Model(ordinary, dictionary, threshold, tuple(float(v) for v in w))
    return best[1]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Balanced log loss and weights, by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(y)), x])
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, ridge = np.zeros(x.shape[1]), 1e-3 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.clip(np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (p - y)) + ridge @ w), -4, 4)
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()), w


_workers: dict[tuple, Coders] = {}


def _worker(ordinary: bytes, *toxic: bytes) -> Coders:
    if (ordinary, *toxic) not in _workers:
        _workers.clear()
        _workers[ordinary, *toxic] = Coders(ordinary, list(toxic))
    return _workers[ordinary, *toxic]


def score(df: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds ``score`` (double, 0 to 1) of every whole text.

    Null and empty texts have no window and get the score of all-zero figures;
    a text under WINDOW bytes is one window.  Repeated rows get equal scores, an
    empty table gives an empty one, an input column named ``score`` (in any
    case) is replaced, other columns ride along.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # two dictionaries and a few numbers

    def make():
        m = shared.value
        w = np.array(m.weights)

        def fn(batch: pa.RecordBatch) -> list:
            gains, count = _worker(m.ordinary, m.toxic).gains(*text_bytes(batch.column(batch.num_columns - 1)))
            return [1 / (1 + np.exp(-np.clip(w[0] + features(figures(gains[0], count), m.threshold) @ w[1:], -30, 30)))]

        return fn

    return append_columns(df, text_col, [T.StructField("score", T.DoubleType())], make, limit=1 << 20, keep_text=keep_text)
