"""Z-scores and hysteresis of all sensors of a record, in one pass over records dealt by entity.

A row a sensor, dealt anew for the windows, the hysteresis and the records, takes
many times the input of disk.  Here the records themselves are dealt, once; they
stream through in order, the sensors of one together, and numpy takes the windows
of many series at a time.  What is kept of an entity from one batch to the next is
by sensor: its last ``window - 1`` values and where its hysteresis stands.

Entities too long for one task go in chunks (:func:`in_chunks`).  One pass tells of
a chunk, by sensor, its first ``window - 1`` values, which need those before them;
its last; and where the rest leads from every state of the hysteresis.  Composed
in order that gives each chunk the state it starts from, and a second pass judges.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condmon.config import AnomalySettings
from condmon.functions.chunks import numbered
from condmon.functions.folds import field
from condmon.functions.lineage import written

#: By level plus one.
LEVELS = ("warmup", "normal", "warning", "critical")
#: What a sensor's value gets.
VERDICT = (
    *(field(n, k) for n, k in (("sensor", "string"), ("value", "double"), ("buffer_size", "long"), ("mean", "double"), ("sd", "double"), ("score", "double"))),
    *(field(n, k) for n, k in (("raw_severity", "string"), ("raw_anomaly", "boolean"), ("is_anomaly", "boolean"), ("severity", "string"), ("skipped", "boolean"))),
)
#: What a record gets.
RECORD = (field("is_anomaly", "boolean"), field("severity", "string"), *(T.StructField(n, T.ArrayType(T.StringType(), False)) for n in ("anomaly_sensors", "skipped_sensors")))
#: Windows taken at a time.
_WINDOWS = 4096


class Readings(NamedTuple):
    """Values of a batch of records: the sensor (a place in ``names``, which are sorted), the row, the value (NaN for null), whether it is null."""

    names: list[str]
    code: np.ndarray
    row: np.ndarray
    value: np.ndarray
    null: np.ndarray


class Standing(NamedTuple):
    """Of a sensor: the last values, and anomalies, normals and verdict of :class:`condmon.functions.folds.SensorHysteresis`."""

    buffer: np.ndarray
    anomalies: int = 0
    normals: int = 0
    on: bool = False


def in_order(x: np.ndarray, sizes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of the window of ``sizes`` values (at most ``rows``) that ends at each place: every window summed up anew from its first value to its last, the deviation by Welford's recurrence, so that nothing drifts and a series gives the same wherever it lies."""
    mean, square = np.empty(len(x)), np.empty(len(x))
    padded = np.concatenate([np.zeros(rows - 1), x])
    short = np.flatnonzero(sizes < rows)
    short = short[np.argsort(-sizes[short], kind="stable")]
    blocks = [(i, min(i + _WINDOWS, len(x))) for i in range(0, len(x), _WINDOWS)]
    with np.errstate(all="ignore"):
        for low, high in (b for b in blocks if (sizes[b[0] : b[1]] == rows).any()):  # nonsense at short windows, which come after
            total, m, q, d, t = np.zeros((5, high - low))
            for j in range(rows):
                v = padded[low + j : high + j]
                total += v
                np.subtract(v, m, out=d)
                m += np.divide(d, j + 1.0, out=t)
                np.subtract(v, m, out=t)
                q += np.multiply(t, d, out=t)
            mean[low:high], square[low:high] = total / rows, q / rows
        for i in range(0, len(short), _WINDOWS):
            at = short[i : i + _WINDOWS]
            n = sizes[at]
            begin = at - n + 1
            total, m, q = np.zeros((3, len(at)))
            for j in range(int(n[0])):
                k = int(np.searchsorted(-n, -j, side="left"))  # the first k have more than j values
                v = x[begin[:k] + j]
                total[:k] += v
                d = v - m[:k]
                m[:k] += d / (j + 1.0)
                q[:k] += (v - m[:k]) * d
            mean[at], square[at] = total / n, q / n
        return mean, np.sqrt(square)


def _above(x: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """NaN is above every number, as Spark has it."""
    return (x > limit) | (np.isnan(x) & ~np.isnan(limit))


def _starts(*marks: np.ndarray) -> np.ndarray:
    first = np.ones(len(marks[0]), bool)
    first[1:] = np.logical_or.reduce([m[1:] != m[:-1] for m in marks])
    return first


def held_up(level: np.ndarray, first: np.ndarray, begun: dict[int, Standing], wanted: list[int], enter: int, leave: int) -> tuple[np.ndarray, np.ndarray, dict[int, Standing]]:
    """Hysteresis of :class:`condmon.functions.folds.SensorHysteresis` over the levels of many series, one after the other, each from its ``first``: verdicts, levels after it, and how the series ``wanted`` end.  ``begun`` has where series stand at first, by number; only anomalies take a step of Python."""
    leave = max(leave, 1)
    series = np.cumsum(first) - 1
    n = int(series[-1]) + 1 if len(series) else 0
    begins = np.flatnonzero(first)
    events = np.flatnonzero(level > 0)
    ends: dict[int, Standing] = {}
    rows: list[tuple[int, bool]] = []
    now, a, on, before = -1, 0, False, 0
    for e, s in zip(events.tolist(), series[events].tolist(), strict=True):
        if s != now:
            old = begun.get(s, Standing(level[:0]))
            now, a, on, normals = s, old.anomalies, old.on, old.normals + e - int(begins[s])
        else:
            normals = e - before - 1
        a = min((0 if on and normals >= leave else a) + 1, max(enter, 1))
        on, before = a >= enter, e
        rows.append((a, on))
    then = np.zeros(len(level), bool)
    then[events] = [r[1] for r in rows]
    at = np.zeros(len(level), np.int64)
    at[events] = [r[0] for r in rows]
    place = np.arange(len(level))
    last = np.maximum.accumulate(np.where(level > 0, place, -1))
    own = last >= begins[series]
    calm, up, count = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, np.int64)
    for s, old in begun.items():
        calm[s], up[s], count[s] = old.normals, old.on, old.anomalies
    since = np.where(own, place - last, calm[series] + place - begins[series] + 1)
    stays = np.where(own, then[last], up[series]) & (since < leave)
    final = np.where(level > 0, then, stays)
    shown = np.where(final, np.where(level > 0, level, 1), 0)
    stops = np.append(begins[1:], len(level)) - 1
    for s in wanted:
        z = int(stops[s])
        on, a, normals = (bool(then[last[z]]), int(at[last[z]]), int(since[z])) if own[z] else (bool(up[s]), int(count[s]), int(since[z]))
        over = on and normals >= leave
        ends[s] = Standing(level[:0], 0 if over else a, min(normals, leave), on and not over)
    return final, shown, ends


def states(enter: int, leave: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anomalies, normals and verdict of every state of the hysteresis that makes a difference: off after fewer than ``enter`` anomalies, on after fewer than ``leave`` normals."""
    off, on = np.arange(enter), np.arange(leave)
    return np.append(off, np.full(leave, enter)), np.append(np.zeros(enter, np.int64), on), np.append(np.zeros(enter, bool), np.ones(leave, bool))


def turned(at: tuple[np.ndarray, np.ndarray, np.ndarray], level: np.ndarray, enter: int, leave: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the levels of one series lead from many states at once."""
    a, c, on = at
    before = -1
    for e in [*np.flatnonzero(level > 0).tolist(), len(level)]:
        c = c + (e - before - 1)
        over = on & (c >= leave)
        a, on = np.where(over, 0, a), on & ~over
        if e < len(level):
            a, c = np.minimum(a + 1, enter), np.zeros_like(c)
            on = a >= enter
        before = e
    return a, np.where(on, c, 0), on


def _scored(x: np.ndarray, size: np.ndarray, high: np.ndarray, low: np.ndarray, s: AnomalySettings) -> dict[str, np.ndarray]:
    mean, sd = in_order(x, size, s.window)
    with np.errstate(all="ignore"):
        score = np.where(sd == 0, 0.0, (x - mean) / sd)
    off = np.abs(score)
    level = np.where(_above(off, high), 2, np.where(_above(off, low), 1, 0))
    return {"mean": mean, "sd": sd, "score": score, "level": np.where(size < s.warmup, -1, level)}


def judged(state: dict[str, Standing], r: Readings, segment: np.ndarray, limits: tuple[np.ndarray, np.ndarray], s: AnomalySettings) -> tuple[dict[str, np.ndarray], dict[str, Standing]]:
    """Verdicts of the finite values of a batch, and the state after it.

    ``segment`` numbers the entities of the rows; those of 0 go on from ``state``.
    ``limits`` are those of critical and warning, row by row.  The arrays hold the
    place in ``r`` (``at``), ``row``, ``code``, ``size``, ``mean``, ``sd``,
    ``score``, ``level`` (-1 while warming up), ``final`` and ``shown``.
    """
    good = np.flatnonzero(np.isfinite(r.value))
    known = [(k, state[name].buffer) for k, name in enumerate(r.names) if name in state]
    none = np.full(sum(len(b) for _, b in known), -1)
    code = np.concatenate([np.repeat(np.array([k for k, _ in known], np.int64), np.array([len(b) for _, b in known], np.int64)), r.code[good]])
    row, at = np.concatenate([none, r.row[good]]), np.concatenate([none, good])
    x = np.concatenate([*(b for _, b in known), r.value[good]])
    order = np.argsort(code * (len(segment) + 1) + row + 1, kind="stable")
    code, row, at, x = code[order], row[order], at[order], x[order]
    part = np.where(row < 0, 0, segment[row])
    place, first = np.arange(len(x)), _starts(code, part)
    begin = np.maximum.accumulate(np.where(first, place, 0))
    size = np.minimum(place - begin + 1, s.window)
    scored = _scored(x, size, limits[0][row], limits[1][row], s)
    level = scored["level"]
    final, shown = level > 0, level.copy()
    ends: dict[int, Standing] = {}
    latest = int(segment[-1])
    if s.hysteresis:
        use = np.flatnonzero((row >= 0) & (level >= 0))
        if len(use):
            c, p = code[use], part[use]
            begins = _starts(c, p)
            c, p = c[begins], p[begins]
            begun = {i: state[r.names[c[i]]] for i in np.flatnonzero(p == 0).tolist() if r.names[c[i]] in state}
            final[use], shown[use], ended = held_up(level[use], begins, begun, np.flatnonzero(p == latest).tolist(), s.consecutive, s.exit_count)
            ends = {int(c[i]): e for i, e in ended.items()}

    after = dict(state) if latest == 0 else {}
    for z in np.flatnonzero(np.append(code[1:] != code[:-1], True)).tolist() if len(x) else []:
        if part[z] == latest:
            name = r.names[code[z]]
            old = ends.get(int(code[z])) or after.get(name, Standing(x[:0]))
            after[name] = old._replace(buffer=x[max(int(begin[z]), z + 2 - s.window) : z + 1].copy())
    own = row >= 0
    named = {"at": at, "row": row, "code": code, "size": size, **scored, "final": final, "shown": shown, "value": x}
    return {k: v[own] for k, v in named.items()}, after


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _doubles(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return a.fill_null(float("nan")).to_numpy(zero_copy_only=False), a.is_null().to_numpy(zero_copy_only=False)


def _readings(batch: pa.RecordBatch, fields: list[str] | None) -> Readings:
    """``fields``: sensors in columns ``__v0``, ``__v1`` and so on; otherwise they are in the map ``__v``."""
    n = batch.num_rows
    if fields is not None:
        values = (np.concatenate(x) for x in zip(*(_doubles(_column(batch, f"__v{i}")) for i in range(len(fields))), strict=True))
        return Readings(fields, np.repeat(np.arange(len(fields)), n), np.tile(np.arange(n), len(fields)), *values)
    maps = _column(batch, "__v")
    offsets = maps.offsets.to_numpy()
    keys, items = (a.slice(offsets[0], offsets[-1] - offsets[0]) for a in (maps.keys, maps.items))
    coded = keys.dictionary_encode()
    names = coded.dictionary.to_pylist()
    rank = np.argsort(np.argsort(np.array(names, dtype=object))) if names else np.zeros(0, np.int64)
    code = rank[coded.indices.to_numpy(zero_copy_only=False)].astype(np.int64)
    return Readings(sorted(names), code, np.repeat(np.arange(n), np.diff(offsets)), *_doubles(items))


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """Whether a row differs from the one before."""
    return _starts(*(c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in columns))


def _lists(row: np.ndarray, code: np.ndarray, names: list[str], n: int) -> pa.Array:
    """The names of each of ``n`` rows, sorted and once each."""
    pairs = np.unique(row * max(len(names), 1) + code)
    row, code = np.divmod(pairs, max(len(names), 1))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(names, pa.string()).take(pa.array(code)))


def _text(level: np.ndarray) -> pa.Array:
    return pa.array(LEVELS).take(pa.array(level + 1))


def _merged(a: pa.RecordBatch, b: pa.RecordBatch) -> pa.RecordBatch:
    """Two rows of one record as one."""
    x, y = a.to_pylist()[0], b.to_pylist()[0]
    x |= {"is_anomaly": x["is_anomaly"] or y["is_anomaly"], "severity": max(x["severity"], y["severity"], key=LEVELS.index)}
    x |= {c: sorted({*x[c], *y[c]}) for c in ("anomaly_sensors", "skipped_sensors")}
    return pa.RecordBatch.from_pylist([x], schema=a.schema)


def _limits(s: AnomalySettings) -> list[tuple[str, float]]:
    """Columns that override the limits of critical and warning, and the limits."""
    return [("cfg_zscore_threshold", s.zscore_threshold), ("cfg_zscore_warning", s.zscore_warning)]


def _given(batch: pa.RecordBatch, s: AnomalySettings) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array(_column(batch, n).cast(pa.float64()).fill_null(d)) if n in batch.schema.names else np.full(batch.num_rows, d) for n, d in _limits(s))


def _wide(df: DataFrame, sensors: str) -> tuple[DataFrame, list[str] | None]:
    """The sensors of a struct as columns ``__v0``, ``__v1`` and so on, and their names; of a map as ``__v``, and None."""
    kind = df.schema[sensors].dataType
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fieldNames())
        values = [F.col(sensors)[n].cast("double").alias(f"__v{i}") for i, n in enumerate(fields)]
    else:
        fields, values = None, [F.col(sensors).cast("map<string,double>").alias("__v")]
    return df.select(*(c for c in df.columns if c != sensors), *values), fields


def _needed(df: DataFrame, s: AnomalySettings, keys: list[str], order: list[str], records: bool) -> DataFrame:
    """Only what a row a record takes, with ``records``."""
    own = [*keys, *order, "__i", "__chunk", *(n for n, _ in _limits(s))]
    return df.select(*(c for c in df.columns if c in own or c.startswith("__v"))) if records else df


def by_record(df: DataFrame, s: AnomalySettings, keys: list[str], order: list[str], sensors: str, records: bool) -> DataFrame:
    """Verdicts of the z-score (:data:`VERDICT`), a row a sensor; or with ``records`` a row a record: its keys, order and :data:`RECORD`.

    ``sensors`` is a map, or a struct whose fields are the sensors.  Records with
    the same keys and order are one; those without a sensor give no row.
    """
    wide, fields = _wide(df, sensors)
    rows = _needed(wide, s, keys, order, records).repartition(*keys).sortWithinPartitions(*keys, *order)
    return _judged(rows, fields, s, keys, [*keys, *order] if records else [c for c in df.columns if c != sensors], records)


def in_chunks(df: DataFrame, s: AnomalySettings, keys: list[str], order: list[str], sensors: str, bucket: Column, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Both results of :func:`by_record`, with entities cut into chunks of ``chunk`` records; ``bucket`` must not fall along the order, which must be total."""
    wide, fields = _wide(df, sensors)
    rows = written(numbered(wide, keys, order, bucket).withColumn("__chunk", F.floor(F.col("__i") / chunk).cast("long")), "sensor-rows")
    starts = written(_composed(_summaries(rows, fields, s, keys, order), s, keys), "sensor-starts").withColumn("__i", F.lit(-1).cast("long"))
    rest = [c for c in df.columns if c != sensors]

    def made(records: bool) -> DataFrame:
        both = _needed(rows, s, keys, order, records).unionByName(starts, allowMissingColumns=True)
        return _judged(_in_chunks(both, keys), fields, s, keys, [*keys, *order] if records else rest, records)

    return made(False), made(True)


def _in_chunks(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(*keys, "__chunk").sortWithinPartitions(*keys, "__chunk", "__i")


def _summaries(rows: DataFrame, fields: list[str] | None, s: AnomalySettings, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, ``__chunk``, ``__summary``): of each chunk by sensor its first and last values, and the states that the rest leads to."""
    marks = [*keys, "__chunk"]
    schema = T.StructType([*(rows.schema[k] for k in marks), T.StructField("__summary", T.StringType())])
    plain = AnomalySettings(**{**s.__dict__, "hysteresis": False})
    enter, leave = max(s.consecutive, 1), max(s.exit_count, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, heads, paths = None, {}, {}, {}

        def done() -> pa.RecordBatch:
            told = {n: {"head": [np.concatenate(h).tolist() for h in zip(*heads[n], strict=True)], "tail": state[n].buffer.tolist(), "ends": [x.tolist() for x in paths[n]]} for n in heads}
            return pa.RecordBatch.from_arrays([*(_column(now, k) for k in marks), pa.array([json.dumps(told)])], names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            for a, b in pairwise([*np.flatnonzero(_changes([_column(batch, k) for k in marks])).tolist(), batch.num_rows]):
                piece = batch.slice(a, b - a)
                head = piece.select(marks).slice(0, 1)
                if now is None or head.to_pylist() != now.to_pylist():
                    if now is not None:
                        yield done()
                    now, state, heads, paths = head, {}, {}, {}
                r, given = _readings(piece, fields), _given(piece, s)
                v, state = judged(state, r, np.zeros(b - a, np.int64), given, plain)
                for k in np.unique(v["code"]).tolist():
                    name, own = r.names[k], v["code"] == k
                    first = own & (v["size"] < s.window)
                    heads.setdefault(name, []).append((v["value"][first], *(x[v["row"][first]] for x in given)))
                    paths[name] = turned(paths.get(name, states(enter, leave)), v["level"][own & ~first], enter, leave)
        if now is not None:
            yield done()

    return _in_chunks(_needed(rows, s, keys, [], True), keys).mapInArrow(run, schema)


def _composed(summaries: DataFrame, s: AnomalySettings, keys: list[str]) -> DataFrame:
    """(keys, ``__chunk``, ``__start``): the state of each sensor that a chunk starts from."""
    schema = T.StructType([*(summaries.schema[k] for k in [*keys, "__chunk"]), T.StructField("__start", T.StringType())])
    enter, leave = max(s.consecutive, 1), max(s.exit_count, 1)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("__chunk", "ascending")])
        state: dict[str, Standing] = {}
        starts = []
        for told in table.column("__summary").to_pylist():
            starts.append(json.dumps({n: [x.buffer.tolist(), *x[1:]] for n, x in state.items()}))
            for name, d in json.loads(told).items():
                old = state.get(name, Standing(np.zeros(0)))
                value, high, low = (np.array(x, np.float64) for x in d["head"])
                x = np.concatenate([old.buffer, value])
                blank = np.zeros(len(old.buffer))
                size = np.minimum(np.arange(len(x)) + 1, s.window)
                level = _scored(x, size, np.concatenate([blank, high]), np.concatenate([blank, low]), s)["level"][len(blank) :]
                (a,), (c,), (on,) = turned((np.array([old.anomalies]), np.array([old.normals]), np.array([old.on])), level[level >= 0], enter, leave)
                a, c, on = (e[enter + c if on else a] for e in d["ends"])
                tail = np.array(d["tail"], np.float64)
                state[name] = Standing(np.concatenate([old.buffer, tail])[1 - s.window :], a, c, on)
        return pa.Table.from_arrays([*(table.column(k) for k in [*keys, "__chunk"]), pa.array(starts, pa.string())], names=schema.names)

    return summaries.groupBy(*keys).applyInArrow(run, schema)


def _judged(rows: DataFrame, fields: list[str] | None, s: AnomalySettings, keys: list[str], shown: list[str], records: bool) -> DataFrame:
    """Verdicts of rows in order.  Where there is a column ``__start``, a row that has it is no record but gives the state for those after it."""
    schema = T.StructType([*(rows.schema[c] for c in shown), *(RECORD if records else VERDICT)])
    chunked = "__start" in rows.columns

    def long(batch: pa.RecordBatch, r: Readings, v: dict[str, np.ndarray]) -> pa.RecordBatch:
        bad = np.flatnonzero(~np.isfinite(r.value))
        n, m = len(v["row"]), len(bad)
        place = np.concatenate([v["at"], bad])
        padded = lambda a, kind=None: pa.concat_arrays([pa.array(a) if kind is None else a, pa.nulls(m, pa.array(a).type if kind is None else kind)])
        calm = v["level"] < 0
        made = {
            "sensor": pa.array(r.names, pa.string()).take(pa.array(r.code[place])), "value": pa.array(r.value[place], mask=r.null[place]), "buffer_size": padded(v["size"]), "mean": padded(v["mean"]), "sd": padded(v["sd"]), "score": padded(v["score"]),
            "raw_severity": padded(_text(v["level"]), pa.string()), "raw_anomaly": padded(pa.array(v["level"] > 0, mask=calm), pa.bool_()), "is_anomaly": padded(pa.array(v["final"], mask=calm), pa.bool_()),
            "severity": padded(_text(v["shown"]), pa.string()), "skipped": pa.array(np.arange(n + m) >= n),
        }
        at = pa.array(r.row[place])
        return pa.RecordBatch.from_arrays([*(_column(batch, c).take(at) for c in shown), *(made[f.name] for f in VERDICT)], names=schema.names)

    def short(batch: pa.RecordBatch, r: Readings, v: dict[str, np.ndarray]) -> pa.RecordBatch:
        first = _changes([_column(batch, c) for c in shown])
        record = np.cumsum(first) - 1
        n = int(record[-1]) + 1
        on, worst, there = v["final"], np.zeros(n, np.int64), np.zeros(n, bool)
        there[record[r.row]] = True
        for k in (1, 2):
            worst[record[v["row"][on & (v["shown"] == k)]]] = k
        bad = np.flatnonzero(~np.isfinite(r.value))
        lists = _lists(record[v["row"][on]], v["code"][on], r.names, n), _lists(record[r.row[bad]], r.code[bad], r.names, n)
        any_ = np.zeros(n, bool)
        any_[record[v["row"][on]]] = True
        heads = pa.array(np.flatnonzero(first))
        out = pa.RecordBatch.from_arrays([*(_column(batch, c).take(heads) for c in shown), pa.array(any_), _text(worst), *lists], names=schema.names)
        return out if there.all() else out.filter(pa.array(there))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, Standing] | None, pa.RecordBatch]]:
        for batch in batches:
            heads = np.flatnonzero(_column(batch, "__start").is_valid().to_numpy(zero_copy_only=False)).tolist() if chunked else []
            if not heads or heads[0]:
                yield None, batch.slice(0, heads[0] if heads else batch.num_rows)
            for a, b in pairwise([*heads, batch.num_rows] if heads else []):
                begun = json.loads(_column(batch, "__start")[a].as_py())
                yield {n: Standing(np.array(x, np.float64), *more) for n, (x, *more) in begun.items()}, batch.slice(a + 1, b - a - 1)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, {}
        for begun, batch in pieces(batches):
            n = batch.num_rows
            state = state if begun is None else begun
            if not n:
                continue
            columns = [_column(batch, k) for k in keys]
            new = _changes(columns)
            new[0] = False
            if not chunked and last is not None and [c[0].as_py() for c in columns] != last:
                state = {}
            last = [c[n - 1].as_py() for c in columns]
            r = _readings(batch, fields)
            v, state = judged(state, r, np.cumsum(new), _given(batch, s), s)
            yield (short if records else long)(batch, r, v)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A record may go on in the next batch."""
        kept, mark = None, lambda b: [_column(b, c)[0].as_py() for c in shown]
        for batch in judge(batches):
            if not batch.num_rows:
                continue
            if kept is not None and mark(kept) == mark(batch):
                kept = _merged(kept, batch.slice(0, 1))
                batch = batch.slice(1)
                if not batch.num_rows:
                    continue
            if kept is not None:
                yield kept
            if batch.num_rows > 1:
                yield batch.slice(0, batch.num_rows - 1)
            kept = batch.slice(batch.num_rows - 1)
        if kept is not None:
            yield kept

    return rows.mapInArrow(whole if records else judge, schema)
