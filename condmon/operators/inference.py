"""Model inference over batches, with pluggable runtimes loaded once a Python worker."""

from __future__ import annotations

import hashlib
import json
import os
import pickle
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Predict = Callable[[np.ndarray], np.ndarray]
#: Rows that go to a model at once.
BATCH = 1024
#: Formats by file name ending.
FORMATS = {".onnx": "onnx", ".tflite": "tflite", ".keras": "keras", ".h5": "keras", ".pkl": "sklearn", ".joblib": "sklearn", "model.json": "tfjs"}


def format_of(path: str) -> str:
    """By ending; a folder with saved_model.pb is a SavedModel."""
    low = path.lower()
    for ending, name in FORMATS.items():
        if low.endswith(ending):
            return name
    if os.path.isdir(path) and os.path.exists(os.path.join(path, "saved_model.pb")):
        return "savedmodel"
    raise ValueError(f"no runtime for {path}")


def _onnx(path: str) -> Predict:
    import onnxruntime

    session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
    name = session.get_inputs()[0].name
    return lambda x: session.run(None, {name: x.astype(np.float32)})[0]


def _sklearn(path: str) -> Predict:
    with open(path, "rb") as f:
        model = pickle.load(f)  # noqa: S301  only files that allowed() and verified() let through
    return model.predict_proba if hasattr(model, "predict_proba") else model.predict


def _keras(path: str) -> Predict:
    import keras  # an optional runtime

    model = keras.models.load_model(path)
    return lambda x: model.predict(x, verbose=0)


#: Loaders by format; :func:`register_runtime` adds or replaces one.
RUNTIMES: dict[str, Callable[[str], Predict]] = {"onnx": _onnx, "sklearn": _sklearn, "keras": _keras, "savedmodel": _keras}


def register_runtime(name: str, load: Callable[[str], Predict]) -> None:
    RUNTIMES[name] = load


def allowed(path: str, roots: list[str]) -> str:
    """The real path, if it is inside one of the roots; else an error."""
    real = Path(path).resolve()
    if not any(real.is_relative_to(Path(r).resolve()) for r in roots):
        raise PermissionError(f"{path} is outside the allowed folders")
    return str(real)


def verified(path: str, sha256: str | None) -> str:
    """The path, if the file has the given digest."""
    if sha256:
        h = hashlib.sha256()
        with open(path, "rb") as f:
            while part := f.read(1 << 20):
                h.update(part)
        if h.hexdigest() != sha256.lower():
            raise ValueError(f"{path}: digest is {h.hexdigest()}")
    return path


class _NoForeignRedirect(urllib.request.HTTPRedirectHandler):
    """Credentials are dropped where a redirect leads to another host."""

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        new = super().redirect_request(req, fp, code, msg, headers, newurl)
        if new is not None and urllib.request.urlparse(newurl).netloc != urllib.request.urlparse(req.full_url).netloc:
            new.remove_header("Authorization")
        return new


def fetch(url: str, to: str, sha256: str | None = None, token: str | None = None, timeout: float = 60) -> str:
    """Download a model on the driver, once; ship it with ``SparkContext.addFile``."""
    if not os.path.exists(to):
        request = urllib.request.Request(url, headers={"Authorization": f"Bearer {token}"} if token else {})
        with urllib.request.build_opener(_NoForeignRedirect).open(request, timeout=timeout) as r, open(to + ".part", "wb") as f:
            while part := r.read(1 << 20):
                f.write(part)
        os.replace(to + ".part", to)
    return verified(to, sha256)


def sidecar(path: str) -> dict[str, Any]:
    """The model's metadata file next to it (``metadata.json`` or ``<name>_metadata.json``); empty if there is none."""
    folder, stem = os.path.dirname(path), os.path.splitext(os.path.basename(path))[0]
    for name in (f"{stem}_metadata.json", "metadata.json"):
        if os.path.exists(p := os.path.join(folder, name)):
            with open(p, encoding="utf-8") as f:
                return json.load(f)
    return {}


def input_vector(df: DataFrame, column: str, out: str = "features") -> DataFrame:
    """Adds a flat array of doubles from a number, an array (nested ones are flattened), a struct or a map (its features, values or input, else all values); what can't be read is 0."""
    kind = df.schema[column].dataType
    c = F.col(column)
    zero = lambda x: F.coalesce(F.nanvl(x.try_cast("double"), F.lit(0.0)), F.lit(0.0))
    while isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        c, kind = F.flatten(c), kind.elementType
    if isinstance(kind, T.ArrayType):
        made = F.transform(c, zero)
    elif isinstance(kind, T.MapType):
        made = F.transform(F.map_values(c), zero)
    elif isinstance(kind, T.StructType):
        names = [f.name for f in kind.fields]
        known = next((n for n in ("features", "values", "input") if n in names), None)
        made = F.transform(c[known], zero) if known else F.array(*[zero(c[n]) for n in names])
    else:
        made = F.array(zero(c))
    return df.withColumn(out, made)


def shape_of(text: str | None, n: int) -> list[int]:
    """A shape such as "1,3,224,224" if its size fits ``n`` values, else [1, n]."""
    try:
        dims = [int(d) for d in (text or "").replace("x", ",").split(",") if d.strip()]
    except ValueError:
        dims = []
    return dims if dims and int(np.prod(dims)) == n else [1, n]


def _outputs(model: Predict, rows: list, shape: list[int] | None = None) -> list:
    """The model's output for each row as a list; null rows give null.  Rows of one length go to the model together."""
    made: list = [None] * len(rows)
    sizes: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        if r is not None:
            sizes.setdefault(len(r), []).append(i)
    for places in sizes.values():
        x = np.array([rows[i] for i in places], dtype=np.float64)
        y = np.asarray(model(x.reshape(len(places), *shape[1:]) if shape else x), dtype=np.float64).reshape(len(places), -1)
        for i, v in zip(places, y.tolist(), strict=True):
            made[i] = v
    return made


def predict(df: DataFrame, load: Callable[[], Predict], features: str = "features", out: str = "prediction", shape: list[int] | None = None) -> DataFrame:
    """Adds the model's output as an array of doubles.  ``load`` runs once a worker process; rows with null features get null."""
    rest = [c for c in df.columns if c != out]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                rows = batch.column(batch.schema.get_field_index(features)).to_pylist()
                made = _outputs(model, rows, shape)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, type=pa.list_(pa.float64()))], names=[*rest, out])

    return df.select(*rest).mapInArrow(run, schema)


def file_model(path: str, roots: list[str], sha256: str | None = None) -> Callable[[], Predict]:
    """Loader of a model file within the allowed folders, digest checked on each worker."""
    kind = format_of(path)
    return lambda: RUNTIMES[kind](verified(allowed(path, roots), sha256))


def http_model(url: str, timeout: float = 60, retries: int = 2, send: Callable[[str, bytes, float], tuple[int, bytes]] | None = None) -> Callable[[], Predict]:
    """A model behind HTTP (POST {"inputs": rows}, {"predictions": rows} back); errors other than 4xx are tried again."""

    def post(u: str, body: bytes, limit: float) -> tuple[int, bytes]:
        try:
            with urllib.request.urlopen(urllib.request.Request(u, body, {"Content-Type": "application/json"}), timeout=limit) as r:
                return r.status, r.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()

    def model(x: np.ndarray) -> np.ndarray:
        body = json.dumps({"inputs": x.tolist()}).encode()
        for attempt in range(retries + 1):
            try:
                status, data = (send or post)(f"{url}/batch_predict", body, timeout)
            except OSError:
                status, data = 599, b""
            if status < 400:
                return np.array(json.loads(data)["predictions"])
            if status < 500 or attempt == retries:
                raise RuntimeError(f"{url}: {status} {data[:200]!r}")
        raise AssertionError

    return lambda: model


def anomaly(prediction: Column) -> Column:
    """One value: over 0.5; two or more: the second over the first."""
    p = lambda i: F.get(prediction, F.lit(i))
    return F.when(F.size(prediction) >= 2, p(1) > p(0)).otherwise(p(0) > 0.5)


def metrics(df: DataFrame, prediction: str = "prediction", features: str = "features", keys: list[str] | None = None) -> DataFrame:
    """Tracking figures: rows, mean, max and min of predictions, mean, max, min and deviation of inputs, anomalies."""
    p, x = F.col(prediction), F.col(features)
    rows = df.select(*(keys or []), p.alias("p"), x.alias("x"), anomaly(p).cast("int").alias("a"))
    total = lambda c: F.sum(F.aggregate(c, F.lit(0.0), lambda s, v: s + v))
    square = F.sum(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    n, m = F.sum(F.size("x")), total(F.col("x")) / F.nullif(F.sum(F.size("x")), F.lit(0))
    return rows.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("rows"), (total(F.col("p")) / F.nullif(F.sum(F.size("p")), F.lit(0))).alias("prediction_mean"), F.max(F.array_max("p")).alias("prediction_max"), F.min(F.array_min("p")).alias("prediction_min"),
        m.alias("input_mean"), F.max(F.array_max("x")).alias("input_max"), F.min(F.array_min("x")).alias("input_min"), F.sqrt(F.greatest(F.lit(0.0), square / F.nullif(n, F.lit(0)) - m * m)).alias("input_std"), F.sum("a").alias("anomalies"),
    )


#: Use cases with their input and output contracts; weights are not part of this package.
CATALOG = [
    {"id": "imagenet-squeezenet", "task": "classification", "input": {"shape": [1, 3, 224, 224], "layout": "nchw", "normalize": "imagenet"}, "output": "classification"},
    {"id": "coco-yolov10n", "task": "detection", "input": {"shape": [1, 3, 640, 640], "layout": "nchw", "normalize": "0-1"}, "output": "boxes"},
    {"id": "coco-pose-yolov8n", "task": "keypoints", "input": {"shape": [1, 3, 640, 640], "layout": "nchw", "normalize": "0-1"}, "output": "keypoints"},
    {"id": "depth-anything-v2-small", "task": "depth", "input": {"shape": [1, 3, 252, 252], "layout": "nchw", "normalize": "imagenet"}, "output": "heatmap"},
    {"id": "surface-defect-seg", "task": "segmentation", "input": {"shape": [1, 3, 32, 32], "layout": "nchw", "normalize": "0-1"}, "output": "segmentation"},
    {"id": "bearing-fault-clf", "task": "classification", "input": {"shape": [1, 5], "layout": "vector"}, "output": "classification"},
]
