"""Batches of readings summarised by a language model: buffering, prompts, calls, answers."""

from __future__ import annotations

import json
import math
import re
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condmon.functions.chunks import numbered
from condmon.functions.folds import Fold, field, ordered
from condmon.functions.scans import scanned

#: Columns that are never readings.
NOT_READINGS = ("timestamp", "time", "ts", "_ts", "epoch", "datetime", "date", "id", "_id")


def batches(df: DataFrame, keys: list[str], order: list[str], size: int = 50, bucket: Column | None = None) -> DataFrame:
    """Adds ``batch``: the number of the group of ``size`` rows in a series, and ``complete`` (the last one may be short).  With ``bucket``, which must not fall along the order, rows are counted in two steps and no series is one task."""
    if bucket is None:
        n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        out = df.withColumn("batch", F.floor((n - 1) / size))
    else:
        out = numbered(df, keys, order, bucket).withColumn("batch", F.floor(F.col("__i") / size)).drop("__i")
    return out.withColumn("complete", F.count(F.lit(1)).over(Window.partitionBy(*keys, "batch")) == size)


def timed_batches(df: DataFrame, keys: list[str], order: list[str], seconds: int, cap: int = 10_000) -> DataFrame:
    """Adds ``batch``: the number of the interval of ``seconds`` (since 1970) that ``ts`` falls into, and ``kept``: whether a row is among the newest ``cap`` of its batch, as in a buffer that drops its oldest.  Rows without a time are in the batch null."""
    batch = F.floor(F.unix_micros(F.col("ts").cast("timestamp_ltz")) / (seconds * 1_000_000))
    out = df.withColumn("batch", batch)
    newest = Window.partitionBy(*keys, "batch").orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return out.withColumn("kept", F.row_number().over(newest) <= cap)


class Triggered(Fold):
    """A bounded buffer of readings that is handed on whole: when it holds ``size`` (batch), at a row with ``flush`` (manual), or when a timer expires (interval).

    A row's own value is buffered before it triggers; an empty buffer does not
    fire; over ``cap`` the oldest values go and are counted in ``dropped``.
    ``fired`` has the values in order, ``kind`` the trigger.

    In a stream the call that follows takes as long as the micro-batch.  With
    ``collapse`` the triggers of a micro-batch after its first are pending and
    become one at its last row, manual if any of them was.

    With ``event_ms`` (a column of whole milliseconds) an interval takes the
    values before its end only, however late the timer is; without it all.
    """

    outputs = (field("fired", "doubles"), field("kind", "string"), field("dropped", "long"))

    def __init__(self, mode: str = "batch", size: int = 50, cap: int = 10_000, collapse: bool = False, event_ms: str | None = None) -> None:
        if mode not in ("batch", "manual", "interval"):
            raise ValueError("mode must be batch, manual or interval")
        self.mode, self.size, self.cap, self.collapse, self.event_ms = mode, size, cap, collapse, event_ms
        self.inputs = ("value", "flush") + ((event_ms,) if event_ms else ())

    def start(self) -> dict:
        return {"buffer": [], "times": [], "dropped": 0}

    def _fire(self, state: dict, until: int | None = None) -> tuple[list[float], int] | None:
        if until is None:
            values, state["buffer"], state["times"] = state["buffer"], [], []
        else:
            due = [t is None or t < until for t in state["times"]]
            values = [x for x, d in zip(state["buffer"], due, strict=True) if d]
            for name in ("buffer", "times"):
                state[name] = [x for x, d in zip(state[name], due, strict=True) if not d]
        if not values:
            return None
        dropped, state["dropped"] = state["dropped"], 0
        return values, dropped

    def step(self, state, columns):
        n = len(columns["value"])
        out: list[tuple] = [(None, None, None)] * n
        busy, pending = False, None
        for i in range(n):
            x = columns["value"][i]
            if x is not None and math.isfinite(x):
                state["buffer"].append(x)
                state["times"].append(columns[self.event_ms][i] if self.event_ms else None)
                if len(state["buffer"]) > self.cap:
                    state["buffer"], state["times"] = state["buffer"][-self.cap :], state["times"][-self.cap :]
                    state["dropped"] += 1
            flush = bool(columns["flush"][i])
            kind = "manual" if self.mode == "manual" and flush else "batch" if self.mode == "batch" and len(state["buffer"]) >= self.size else None
            if kind and busy:
                pending = "manual" if "manual" in (kind, pending) else kind
            elif kind:
                made = self._fire(state)
                busy = self.collapse and made is not None
                out[i] = (made[0], kind, made[1]) if made else out[i]
        if pending and (made := self._fire(state)):
            out[-1] = (made[0], pending, made[1])
        return {f.name: [o[k] for o in out] for k, f in enumerate(self.outputs)}

    def tick(self, state, at_ms):
        made = self._fire(state, at_ms if self.event_ms else None) if self.mode == "interval" else None
        return made and {"fired": made[0], "kind": "interval", "dropped": made[1]}

    def summary(self, columns):
        """Of rows in manual mode: whether one flushes, and the buffer they leave; in batch mode: their number and last values."""
        x = [v for v in columns["value"] if v is not None and math.isfinite(v)]
        if self.mode == "batch":
            return {"n": len(x), "last": x[-(self.size - 1) :] if self.size > 1 else []}
        state = self.start()
        self.step(state, columns)
        return {"flushed": any(columns["flush"]), **state}

    def carry(self, state, summary):
        if self.event_ms or self.collapse or self.mode == "interval" or (self.mode == "batch" and self.size > self.cap):
            return None
        if self.mode == "batch":
            left = (len(state["buffer"]) + summary["n"]) % self.size
            values = (state["buffer"] + summary["last"])[-left:] if left else []
            return {"buffer": values, "times": [None] * len(values), "dropped": 0}
        if summary["flushed"]:  # whatever was held is gone at the first flush that finds a value
            return {k: summary[k] for k in ("buffer", "times", "dropped")}
        values = state["buffer"] + summary["buffer"]
        over = max(0, len(values) - self.cap)
        return {"buffer": values[over:], "times": [None] * (len(values) - over), "dropped": state["dropped"] + summary["dropped"] + over}


def triggered(df: DataFrame, keys: list[str], order: list[str], fold: Triggered, bucket: Column | None = None, chunk: int = 1_000_000) -> DataFrame:
    """The rows that fired, with ``fired``, ``kind`` and ``dropped``.  With ``bucket``, which must not fall along the order, long series are cut into chunks."""
    if fold.mode == "interval" or fold.collapse:
        raise ValueError("timers and pending triggers are of streams: use timed_batches for intervals of a table")
    out = ordered(df, keys, order, fold) if bucket is None else scanned(df, keys, order, fold, bucket, chunk)
    return out.where("fired is not null")


def numeric_columns(df: DataFrame) -> list[str]:
    kinds = (T.NumericType,)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name.lower() not in NOT_READINGS]


def batch_stats(df: DataFrame, keys: list[str], value: str = "value", order: list[str] | None = None) -> DataFrame:
    """Count, mean, deviation (population), min, max, range and the values in order of ``seq`` where there is one.

    The mean is a sum in order (of ``order``, or ``seq``): a prompt shows four
    digits, and where a mean lies halfway between two of them, the last bit that
    the order of a sum leaves open decides.
    """
    x = F.col(value)
    by = order or (["seq"] if "seq" in df.columns else [])
    summed = F.aggregate(F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(*by, x.alias("__v"))))), F.lit(0.0), lambda s, r: s + r["__v"])
    mean = summed / F.nullif(F.count(x), F.lit(0)) if by else F.avg(x)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", x.alias("v")))), lambda s: s["v"]) if "seq" in df.columns else F.collect_list(x)
    return df.groupBy(*keys).agg(F.count(x).alias("count"), mean.alias("mean"), F.stddev_pop(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"), (F.max(x) - F.min(x)).alias("range"), listed.alias("samples"))


def digits(x: float | None, n: int) -> str:
    """A number to ``n`` significant digits, without trailing zeros; n/a for none."""
    if x is None or x != x or x in (float("inf"), float("-inf")):
        return "n/a"
    v = float(f"{x:.{n}g}")
    return str(int(v)) if v == int(v) and abs(v) < 1e21 else repr(v)


def stats_line(s: dict[str, Any]) -> str:
    names = (("count", "n"), ("mean", "mean"), ("sd", "stdDev"), ("min", "min"), ("max", "max"), ("range", "range"))
    return " ".join(f"{label}={int(s[k]) if k == 'count' else digits(s[k], 4)}" for k, label in names if s.get(k) is not None)


def _last(items: list, most: int) -> tuple[str, list]:
    return (f"(showing last {most} of {len(items)})\n", items[-most:]) if len(items) > most else ("", items)


def samples_list(values: list[float], most: int = 100) -> str:
    if not values:
        return "(empty)"
    head, used = _last(values, most)
    return head + ", ".join(digits(v, 6) for v in used)


def records_table(records: list[dict], columns: list[str], most: int = 100) -> str:
    if not records:
        return "(empty)"
    if not columns:
        return "(no columns)"
    head, used = _last(records, most)
    first = len(records) - len(used) + 1
    return head + "\n".join(f"t={first + i} " + " ".join(f"{c}={digits(r.get(c), 6)}" for c in columns) for i, r in enumerate(used))


def column_stats(stats: dict[str, dict]) -> str:
    if not stats:
        return "(no columns)"
    width = min(20, max(map(len, stats)) + 1) + 1
    return "\n".join("  " + f"{c}:".ljust(width) + " ".join([f"n={s.get('count', 0)}", *[f"{label}={digits(s.get(k), 4)}" for k, label in (("mean", "mean"), ("sd", "stdDev"), ("min", "min"), ("max", "max"))]]) for c, s in stats.items())


def fill(template: str, values: dict[str, Any]) -> str:
    """``{name}`` is replaced where the name is known, and stays otherwise."""
    return re.sub(r"\{(\w+)\}", lambda m: str(values[m[1]]) if m[1] in values else m[0], template)


def csv_list(text: str) -> list[str]:
    return [p.strip() for p in text.split(",") if p.strip()]


@F.pandas_udf(T.StringType())
def _prompt(template, series, stats, samples):  # pragma: no cover - runs on executors
    import pandas as pd

    return pd.Series([fill(t, {"series": s, "stats": stats_line(dict(st)), "samples": samples_list(list(v)), "count": st["count"]}) for t, s, (_, st), v in zip(template, series, stats.iterrows(), samples, strict=True)])


def prompts(stats: DataFrame, series: str, template: str) -> DataFrame:
    """Adds ``prompt``: the template with {series}, {stats}, {samples} and {count} filled in."""
    s = F.struct(*[F.col(c) for c in ("count", "mean", "sd", "min", "max", "range")])
    return stats.withColumn("prompt", _prompt(F.lit(template), F.col(series).cast("string"), s, F.col("samples")))


# Answers -----------------------------------------------------------------------


def balanced(text: str) -> str | None:
    """The first bracketed stretch that closes; brackets in quoted text don't count."""
    start = re.search(r"[{\[]", text)
    if start is None:
        return None
    opening = text[start.start()]
    closing, depth = {"{": "}", "[": "]"}[opening], 0
    for m in re.finditer(r'"(?:\\.|[^"\\])*"|[{}\[\]]', text[start.start() :], re.S):
        depth += (m[0] == opening) - (m[0] == closing)
        if depth == 0 and m[0] == closing:
            return text[start.start() : start.start() + m.end()]
    return None


def extract_json(text: str | None) -> Any:
    """JSON of an answer: the whole, a fenced block, or the first balanced brackets; None if there is none."""
    whole = (text or "").strip()
    fence = re.search(r"```(?:json)?\s*(.*?)```", whole, re.S | re.I)
    for part in filter(None, (whole, fence[1].strip() if fence else None, balanced(whole))):
        try:
            return json.loads(part)
        except ValueError:
            continue
    return None


def at_path(value: Any, path: str) -> Any:
    """Dotted path; numbers are places in lists; None where it leads nowhere."""
    for part in path.split(".") if path else []:
        if isinstance(value, list) and part.isdigit() and int(part) < len(value):
            value = value[int(part)]
        elif isinstance(value, dict) and part in value:
            value = value[part]
        else:
            return None
    return value


def json_field(answer: Column, path: str) -> Column:
    """A field of the JSON in an answer, as text."""

    @F.pandas_udf(T.StringType())
    def pick(texts):
        import pandas as pd

        found = [at_path(extract_json(t), path) for t in texts]
        return pd.Series([None if v is None else v if isinstance(v, str) else json.dumps(v) for v in found])

    return pick(answer)


# Calls -------------------------------------------------------------------------


class CallError(RuntimeError):
    """A failed call, with its kind: auth, rate-limit, http, timeout, network or config."""

    def __init__(self, message: str, kind: str, status: int | None = None) -> None:
        super().__init__(message)
        self.kind, self.status = kind, status


@dataclass(frozen=True)
class Answer:
    text: str
    input_tokens: int = 0
    output_tokens: int = 0


Provider = Callable[[str, str], Answer]
Send = Callable[[str, dict, bytes, float], tuple[int, bytes]]


def _send(url: str, headers: dict, body: bytes, timeout: float) -> tuple[int, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()
    except TimeoutError as e:
        raise CallError("timed out", "timeout") from e
    except OSError as e:
        raise CallError(str(e), "network") from e


def chat_provider(url: str, model: str, key: str | None, style: str = "openai", timeout: float = 30, send: Send = _send) -> Provider:
    """A provider of chat completions over HTTP.  Styles differ in headers, body and where the text is: ``openai`` (and compatible servers), ``messages``, ``generate``, ``local``."""
    def call(system: str, user: str) -> Answer:
        if not model or not user:
            raise CallError("model and prompt are required", "config")
        if style == "messages":
            headers, body = {"x-api-key": key or "", "anthropic-version": "2023-06-01"}, {"model": model, "max_tokens": 1024, "system": system, "messages": [{"role": "user", "content": user}]}
            text, used = "content.0.text", ("usage.input_tokens", "usage.output_tokens")
        elif style == "generate":
            headers, body = {"x-goog-api-key": key or ""}, {"systemInstruction": {"parts": [{"text": system}]}, "contents": [{"role": "user", "parts": [{"text": user}]}]}
            text, used = "candidates.0.content.parts.0.text", ("usageMetadata.promptTokenCount", "usageMetadata.candidatesTokenCount")
        elif style == "local":
            headers, body = {}, {"model": model, "stream": False, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
            text, used = "message.content", ("prompt_eval_count", "eval_count")
        else:
            headers, body = {"Authorization": f"Bearer {key}"} if key else {}, {"model": model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
            text, used = "choices.0.message.content", ("usage.prompt_tokens", "usage.completion_tokens")
        status, data = send(url, {"Content-Type": "application/json", **headers}, json.dumps(body).encode(), timeout)
        if status >= 400:
            raise CallError(f"{status}: {data[:400].decode('utf-8', 'replace')}", "auth" if status in (401, 403) else "rate-limit" if status == 429 else "http", status)
        parsed = json.loads(data or b"{}")
        return Answer(str(at_path(parsed, text) or ""), *[int(at_path(parsed, u) or 0) for u in used])

    return call


def ask(df: DataFrame, provider: Provider, system: str, prompt: str = "prompt") -> DataFrame:
    """Adds ``answer``, ``error_kind``, ``input_tokens``, ``output_tokens``: one call a row, a failed one is told in its row and does not end the job."""
    rest = df.columns
    extra = [T.StructField("answer", T.StringType()), T.StructField("error_kind", T.StringType()), T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType())]

    def run(frames):
        import pandas as pd

        for frame in frames:
            made = []
            for text in frame[prompt]:
                try:
                    a = provider(system, text)
                    made.append((a.text, None, a.input_tokens, a.output_tokens))
                except CallError as e:
                    made.append((None, e.kind, 0, 0))
            yield pd.concat([frame.reset_index(drop=True), pd.DataFrame(made, columns=[f.name for f in extra])], axis=1)

    return df.mapInPandas(run, T.StructType([df.schema[c] for c in rest] + extra))


def usage(answers: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return answers.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("calls"), F.count("error_kind").alias("errors"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
