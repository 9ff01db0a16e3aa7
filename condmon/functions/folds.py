"""Ordered folds: operators whose next answer depends on their last.

A fold never knows whether it runs in batch or in a stream.  ``start()`` gives
the state (plain lists and numbers, so it can be stored) and ``step(state,
columns)`` consumes rows of one key in order and gives output columns.

:func:`ordered` is the batch driver: rows are dealt by key, sorted within
partitions and streamed through, so a long series is never held in memory.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condmon.config import AnomalySettings


class Fold:
    """Names of the input columns, fields of the output."""

    inputs: tuple[str, ...] = ("value",)
    outputs: tuple[T.StructField, ...] = ()

    def start(self) -> dict:
        return {}

    def step(self, state: dict, columns: dict[str, list]) -> dict[str, list]:
        raise NotImplementedError

    def tick(self, state: dict, at_ms: int) -> dict | None:
        """One row of outputs when a timer expires, or None: only in streams (:func:`condmon.streaming.adapters.stateful`)."""
        return None

    def summary(self, columns: dict[str, list]) -> dict | None:
        """What the rows do to any state, for :mod:`condmon.functions.scans`."""
        return None

    def carry(self, state: dict, summary: dict | None) -> dict | None:
        """The state after rows of that summary, or None where it cannot tell."""
        return None


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, {"double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType(), "long": T.LongType(), "doubles": T.ArrayType(T.DoubleType()), "longs": T.ArrayType(T.LongType()), "strings": T.ArrayType(T.StringType()), "vectors": T.ArrayType(T.ArrayType(T.DoubleType()))}[kind])


def ordered(df: DataFrame, keys: list[str], order: list[str], fold: Fold) -> DataFrame:
    """``df`` with the fold's outputs; rows of a key are folded by ``order``.  Columns named like an output are replaced."""
    names = [f.name for f in fold.outputs]
    kept = [c for c in df.columns if c not in names]
    schema = T.StructType([df.schema[c] for c in kept] + list(fold.outputs))
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in fold.outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = list(zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys], strict=True))
            columns = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in fold.inputs if c in kept}
            out: dict[str, list] = {n: [] for n in names}
            start = 0
            while start < len(key):
                end = start
                while end < len(key) and key[end] == key[start]:
                    end += 1
                if key[start] != now:
                    now, state = key[start], fold.start()
                for n, x in fold.step(state, {c: v[start:end] for c, v in columns.items()}).items():
                    out[n].extend(x)
                start = end
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(out[n], type=k) for n, k in zip(names, kinds, strict=True)]], names=[*kept, *names])

    dealt = df.select(*kept).repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, schema)


def _finite(x: float | None) -> bool:
    return x is not None and math.isfinite(x)


class Ema(Fold):
    """Exponential average of a series from its second valid sample on (the first only warms up)."""

    outputs = (field("ema", "double"),)

    def __init__(self, alpha: float) -> None:
        self.alpha = alpha

    def start(self) -> dict:
        return {"seen": 0, "ema": None}

    def step(self, state, columns):
        out = []
        for x in columns["value"]:
            if not _finite(x):
                out.append(None)
                continue
            state["seen"] += 1
            if state["seen"] >= 2:
                last = state["ema"]
                state["ema"] = x if last is None else self.alpha * x + (1 - self.alpha) * last
            out.append(state["ema"])
        return {"ema": out}

    def summary(self, columns):
        """An affine map of the average so far, and the ends from states that have seen no or one value."""
        x = [v for v in columns["value"] if _finite(v)]
        shift = 0.0
        for v in x:
            shift = self.alpha * v + (1 - self.alpha) * shift
        ends = []
        for seen in (0, 1):
            state = {"seen": seen, "ema": None}
            self.step(state, {"value": x})
            ends.append(state["ema"])
        return {"n": len(x), "scale": (1 - self.alpha) ** len(x), "shift": shift, "ends": ends}

    def carry(self, state, summary):
        seen, n = state["seen"], summary["n"]
        if not n:
            return dict(state)
        ema = summary["ends"][seen] if seen < 2 else summary["scale"] * state["ema"] + summary["shift"]
        return {"seen": seen + n, "ema": ema}


class Cusum(Fold):
    """Two-sided cumulative sums of ``deviation``; both start anew after exceeding ``limit``.  Null deviations (warm-up) are passed over."""

    inputs = ("deviation",)
    outputs = (field("cusum_pos", "double"), field("cusum_neg", "double"), field("cusum_max", "double"))

    def __init__(self, drift: float, limit: float) -> None:
        self.drift, self.limit = drift, limit

    def start(self) -> dict:
        return {"up": 0.0, "down": 0.0}

    def step(self, state, columns):
        up, down, top = [], [], []
        for d in columns["deviation"]:
            if d is None:
                for x in (up, down, top):
                    x.append(None)
                continue
            state["up"] = max(0.0, state["up"] + d - self.drift)
            state["down"] = max(0.0, state["down"] - d - self.drift)
            top.append(max(state["up"], state["down"]))
            if top[-1] > self.limit:
                state["up"] = state["down"] = 0.0
            up.append(state["up"])
            down.append(state["down"])
        return {"cusum_pos": up, "cusum_neg": down, "cusum_max": top}

    def summary(self, columns):
        """For either sum, up to the first excess from zero: its total, its greatest and least partial sum; and the ends from zero."""
        zero, sides, exceeded = self.start(), {"up": [0.0, 0.0, 0.0], "down": [0.0, 0.0, 0.0]}, False
        for d in columns["deviation"]:
            if d is None:
                continue
            top = max(zero["up"] + d - self.drift, zero["down"] - d - self.drift)
            if not exceeded and top <= self.limit:
                for side, x in (("up", d - self.drift), ("down", -d - self.drift)):
                    s = sides[side]
                    s[0] += x
                    s[1], s[2] = max(s[1], s[0]), min(s[2], s[0])
            exceeded |= top > self.limit
            self.step(zero, {"deviation": [d]})
        return {"end": zero, "exceeded": exceeded, **sides}

    def carry(self, state, summary):
        after, merged = {}, True
        for side in ("up", "down"):
            total, most, least = summary[side]
            if state[side] + most > self.limit - 1e-9 * (1 + abs(self.limit)):
                return None  # may exceed where the run from zero did not
            # a sum that comes down to zero goes on as the one from zero
            clear = state[side] + least < -1e-9 * (1 + abs(least))
            merged &= clear or state[side] == 0
            after[side] = summary["end"][side] if clear or state[side] == 0 else max(summary["end"][side], state[side] + total)
        return after if merged or not summary["exceeded"] else None


class SensorHysteresis(Fold):
    """Hysteresis of the multi-sensor mode: short runs are never anomalous, normals keep an anomaly up until the exit count, and only then the run of anomalies starts anew."""

    inputs = ("raw_anomaly", "raw_severity")
    outputs = (field("is_anomaly", "boolean"), field("severity", "string"))

    def __init__(self, enter: int, leave: int) -> None:
        self.enter, self.leave = enter, leave

    def start(self) -> dict:
        return {"anomalies": 0, "normals": 0, "on": False}

    def step(self, state, columns):
        flags, levels = [], []
        for raw, level in zip(columns["raw_anomaly"], columns["raw_severity"], strict=True):
            if raw is None:
                flags.append(None)
                levels.append(level)
                continue
            final = raw
            if raw:
                state["anomalies"] += 1
                state["normals"] = 0
                final = state["anomalies"] >= self.enter
            else:
                state["normals"] += 1
                if state["on"] and state["normals"] < self.leave:
                    final, level = True, "warning"
                elif state["on"]:
                    state["anomalies"] = 0
            state["on"] = final
            flags.append(final)
            levels.append(level if final else "normal")
            # more than these counts change nothing
            state["anomalies"], state["normals"] = min(state["anomalies"], self.enter), min(state["normals"], max(self.leave, 0))
        return {"is_anomaly": flags, "severity": levels}

    def summary(self, columns):
        """A transition table, the end from every state, composed run by run of equal verdicts; after some rows a run changes no state any more."""
        states = [(a, n, on) for a in range(max(self.enter, 0) + 1) for n in range(max(self.leave, 0) + 1) for on in (False, True)]
        number = {k: i for i, k in enumerate(states)}
        longest = max(self.enter, self.leave, 0) + 2
        powers = {}
        for raw in (False, True):
            once = np.array([number[self._next(k, raw)] for k in states])
            powers[raw] = [np.arange(len(states)), once]
            for _ in range(longest - 1):
                powers[raw].append(once[powers[raw][-1]])
        raws = np.array([r for r in columns["raw_anomaly"] if r is not None], dtype=bool)
        starts = np.flatnonzero(np.append(True, raws[1:] != raws[:-1])) if len(raws) else np.zeros(0, np.int64)
        at = powers[False][0]
        for raw, n in zip(raws[starts].tolist(), np.diff(np.append(starts, len(raws))).tolist(), strict=True):
            at = powers[raw][min(n, longest)][at]
        return {json.dumps(k): list(states[i]) for k, i in zip(states, at.tolist(), strict=True)}

    def _next(self, state: tuple, raw: bool) -> tuple:
        now = dict(zip(("anomalies", "normals", "on"), state, strict=True))
        self.step(now, {"raw_anomaly": [raw], "raw_severity": ["critical"]})
        return tuple(now.values())

    def carry(self, state, summary):
        return dict(zip(("anomalies", "normals", "on"), summary[json.dumps(tuple(state.values()))], strict=True))


class AdaptiveThreshold(Fold):
    """Threshold adjustment from feedback: false-positive rate over target loosens, else false-negative rate over twice the target tightens; within half of the threshold either way."""

    inputs = ("predicted", "actual")
    outputs = (field("adjustment", "double"),)

    def __init__(self, target: float = 0.05, rate: float = 0.1, least: int = 10) -> None:
        self.target, self.rate, self.least = target, rate, least

    def start(self) -> dict:
        return {"tp": 0, "fp": 0, "tn": 0, "fn": 0, "adjustment": 0.0}

    def step(self, state, columns):
        out = []
        for predicted, actual in zip(columns["predicted"], columns["actual"], strict=True):
            state[("t" if bool(predicted) == bool(actual) else "f") + ("p" if predicted else "n")] += 1
            said, unsaid = state["tp"] + state["fp"], state["tn"] + state["fn"]
            if said + unsaid >= self.least:
                false_alarms = state["fp"] / said if said else 0.0
                misses = state["fn"] / unsaid if unsaid else 0.0
                if false_alarms > self.target:
                    change = self.rate * (false_alarms - self.target)
                elif misses > 2 * self.target:
                    change = -self.rate * (misses - self.target)
                else:
                    change = 0.0
                state["adjustment"] = min(0.5, max(-0.5, state["adjustment"] + change))
            out.append(state["adjustment"])
        return {"adjustment": out}


class Detector(Fold):
    """All scalar methods and the scalar hysteresis over a bounded buffer: the streaming form of :func:`condmon.operators.anomaly.detect`."""

    outputs = (field("raw_anomaly", "boolean"), field("severity", "string"), field("is_anomaly", "boolean"))

    def __init__(self, settings: AnomalySettings) -> None:
        self.s = settings

    def start(self) -> dict:
        return {"buffer": [], "ema": None, "up": 0.0, "down": 0.0, "run": 0, "calm": 0, "on": False}

    def level(self, state: dict, x: float) -> str:
        s, b = self.s, np.array(state["buffer"])
        two = lambda v, high, low: "critical" if v > high else "warning" if v > low else "normal"
        sd = b.std()
        if s.method == "iqr":
            o = np.sort(b)
            q1, q3 = o[int(len(o) * 0.25)], o[int(len(o) * 0.75)]
            out = lambda k: x < q1 - k * (q3 - q1) or x > q3 + k * (q3 - q1)
            return "critical" if out(s.iqr_multiplier) else "warning" if out(s.iqr_warning) else "normal"
        if s.method == "threshold":
            low, high, m = s.min_threshold, s.max_threshold, s.margin_percent / 100
            if (low is not None and x < low) or (high is not None and x > high):
                return "critical"
            near = (low is not None and x < low * (1 + m)) or (high is not None and x > high * (1 - m))
            return "warning" if near else "normal"
        if s.method == "percentile":
            low, high = np.percentile(b, [s.lower_percentile, s.upper_percentile])
            return "critical" if x < low or x > high else "normal"
        if s.method == "cusum":
            d = x - (b.mean() if s.cusum_target is None else s.cusum_target)
            state["up"], state["down"] = max(0.0, state["up"] + d - s.cusum_drift), max(0.0, state["down"] - d - s.cusum_drift)
            top = max(state["up"], state["down"])
            if top > s.cusum_threshold:
                state["up"] = state["down"] = 0.0
            return two(top, s.cusum_threshold, s.cusum_warning)
        if s.method in ("ema", "moving_average"):
            center = b.mean()
            if s.method == "ema":
                first = state["ema"] is None
                state["ema"] = center = x if first else s.ema_alpha * x + (1 - s.ema_alpha) * state["ema"]
                if first:
                    return "normal"
            off = abs(x - center)
            scale = sd if s.deviation == "stddev" else abs(center) / 100
            return two(0.0 if scale == 0 else off / scale, s.deviation_threshold, s.deviation_warning)
        return two(0.0 if sd == 0 else abs(x - b.mean()) / sd, s.zscore_threshold, s.zscore_warning)

    def step(self, state, columns):
        s, raw_out, level_out, final_out = self.s, [], [], []
        for x in columns["value"]:
            if not _finite(x):
                raw_out.append(None), level_out.append(None), final_out.append(None)
                continue
            state["buffer"] = (state["buffer"] + [x])[-s.window :]
            if len(state["buffer"]) < s.warmup:
                raw_out.append(None), level_out.append(None), final_out.append(None)
                continue
            level = self.level(state, x)
            raw = level != "normal"
            state["run"], state["calm"] = (state["run"] + 1, 0) if raw else (0, state["calm"] + 1)
            if not s.hysteresis:
                state["on"] = raw
            elif raw and state["run"] >= s.consecutive:
                state["on"] = True
            elif not raw and state["calm"] >= s.exit_count:
                state["on"] = False
            raw_out.append(raw), level_out.append(level), final_out.append(state["on"])
        return {"raw_anomaly": raw_out, "severity": level_out, "is_anomaly": final_out}


def latest_before(left: DataFrame, right: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """As-of join: each left row with the last right row of its keys at or before it, by a union and one window (no range join)."""
    from pyspark.sql import Window

    void = [F.lit(None).cast(right.schema[c].dataType).alias(f"__{c}") for c in columns]
    a = left.select(*keys, order, F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), *void, F.lit(None).cast("boolean").alias("__has"))
    b = right.select(*keys, order, F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__has"))
    w = Window.partitionBy(*keys).orderBy(order, "__side").rowsBetween(Window.unboundedPreceding, 0)
    packed = F.last(F.when(F.col("__has"), F.struct(*[F.col(f"__{c}").alias(c) for c in columns])), ignorenulls=True).over(w)
    joined = a.unionByName(b).withColumn("__found", packed).where("__side = 1")
    return joined.select("__row.*", *[F.col(f"__found.{c}").alias(c) for c in columns])


def step_all(fold: Fold, columns: dict[str, list]) -> dict[str, list]:
    """The fold over one whole series, for tests and small uses."""
    return fold.step(fold.start(), columns)


FoldFactory = Callable[[], Fold]
