"""Images and the outputs of vision models: decoding, tensors, boxes, masks, polygons, keypoints, heat maps."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condmon.functions.graphs import rooted
from condmon.functions.lineage import written

#: Channel means and deviations of the ImageNet normalisation, and grey weights.
MEAN, STD, GREY = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225), (0.299, 0.587, 0.114)


def kind(data: Column) -> Column:
    """png, jpeg or null, by the first bytes."""
    head = F.hex(F.substring(data, 1, 8))
    return F.when(head == "89504E470D0A1A0A", "png").when(F.substring(head, 1, 6) == "FFD8FF", "jpeg")


def png_pixels(data: bytes) -> np.ndarray:
    """Height x width x 3 of an 8-bit PNG (grey, RGB or either with alpha; not interlaced)."""
    at, chunks = 8, []
    width = height = channels = 0
    while at < len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            width, height, depth, color, _, _, lace = struct.unpack(">IIBBBBB", body)
            channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(color, 0)
            if depth != 8 or lace or not channels:
                raise ValueError("only 8-bit grey and RGB without interlacing")
        elif name == b"IDAT":
            chunks.append(body)
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(chunks)), dtype=np.uint8).reshape(height, -1)
    out = np.zeros((height, width * channels), dtype=np.int64)
    for y in range(height):
        f, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        up = out[y - 1] if y else np.zeros_like(line)
        if f == 0:
            out[y] = line
        elif f == 2:
            out[y] = (line + up) & 255
        else:  # the left neighbour counts: byte by byte
            row = out[y]
            for i in range(len(line)):
                left = row[i - channels] if i >= channels else 0
                corner = up[i - channels] if i >= channels else 0
                if f == 1:
                    guess = left
                elif f == 3:
                    guess = (left + up[i]) // 2
                else:
                    p = left + up[i] - corner
                    guess = min((left, up[i], corner), key=lambda v: abs(p - v))
                row[i] = (line[i] + guess) & 255
    image = out.reshape(height, width, channels).astype(np.uint8)
    return np.repeat(image[:, :, :1], 3, axis=2) if channels <= 2 else image[:, :, :3]


def png_file(image: np.ndarray) -> bytes:
    """An RGB PNG."""
    h, w, _ = image.shape
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def resize(image: np.ndarray, height: int, width: int, mode: str = "bilinear") -> np.ndarray:
    """Half-pixel centres, clamped at the edges."""
    def axis(n: int, m: int):
        p = (np.arange(m) + 0.5) * (n / m) - 0.5
        low = np.clip(np.floor(p).astype(int), 0, n - 1)
        return p, low, np.minimum(low + 1, n - 1), np.clip(p - low, 0, 1)

    (py, y0, y1, wy), (px, x0, x1, wx) = axis(image.shape[0], height), axis(image.shape[1], width)
    if mode == "nearest":
        near = lambda p, n: np.clip(np.floor(p + 0.5).astype(int), 0, n - 1)
        return image[near(py, image.shape[0])][:, near(px, image.shape[1])]
    f = image.astype(np.float64)
    mix = lambda a, b, w: a + (b - a) * w
    top, bottom = mix(f[y0][:, x0], f[y0][:, x1], wx[None, :, None]), mix(f[y1][:, x0], f[y1][:, x1], wx[None, :, None])
    return np.floor(mix(top, bottom, wy[:, None, None]) + 0.5).astype(np.uint8)


def tensor(image: np.ndarray, normalize: str = "0-1", grayscale: bool = False, bgr: bool = False, layout: str = "nchw", mean=(0.0, 0.0, 0.0), std=(1.0, 1.0, 1.0)) -> tuple[np.ndarray, list[int]]:
    """Flat values and shape."""
    x = image.astype(np.float64)
    x = (x @ np.array(GREY))[:, :, None] if grayscale else x[:, :, ::-1] if bgr else x
    c = x.shape[2]
    given = lambda m, s: (x / 255 - np.array(m)[:c]) / np.where(np.array(s)[:c] == 0, 1, np.array(s)[:c])
    x = {"0-255": lambda: x, "-1-1": lambda: x / 127.5 - 1, "imagenet": lambda: given(MEAN, STD), "custom": lambda: given(mean, std)}.get(normalize, lambda: x / 255)()
    h, w, _ = x.shape
    return (x if layout == "nhwc" else x.transpose(2, 0, 1)).reshape(-1), [1, h, w, c] if layout == "nhwc" else [1, c, h, w]


def to_tensor(df: DataFrame, image: str, height: int, width: int, mode: str = "bilinear", **settings) -> DataFrame:
    """Adds ``tensor`` (floats) and ``shape`` of PNG bytes; other and broken images get nulls."""
    rest = [c for c in df.columns if c not in ("tensor", "shape")]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField("tensor", T.ArrayType(T.FloatType())), T.StructField("shape", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in batches:
            values, shapes = [], []
            for data in batch.column(batch.schema.get_field_index(image)).to_pylist():
                try:
                    v, s = tensor(resize(png_pixels(data), height, width, mode), **settings)
                    values.append(v.astype(np.float32).tolist())
                    shapes.append(s)
                except (ValueError, TypeError, struct.error, zlib.error):
                    values.append(None)
                    shapes.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, type=pa.list_(pa.float32())), pa.array(shapes, type=pa.list_(pa.int32()))], names=[*rest, "tensor", "shape"])

    return df.select(*rest).mapInArrow(run, schema)


# Boxes -----------------------------------------------------------------------


def boxes(flat: Column, width: int = 6, style: str = "xyxy", threshold: float = 0.5, sx: float = 1.0, sy: float = 1.0) -> Column:
    """Array of boxes (x1, y1, x2, y2, score, class) from a flat output of ``width`` values a box: corners, or centre, size, objectness and class scores (yolo)."""
    rows = F.floor(F.size(flat) / width).cast("int")
    at = lambda i, k: F.get(flat, i * width + k).cast("double")

    def one(i: Column) -> Column:
        if style == "yolo":
            scores = F.slice(flat, i * width + 6, F.lit(max(0, width - 5)))
            best = F.array_max(scores)
            score = at(i, 4) * (F.coalesce(best, F.lit(1.0)) if width > 5 else 1.0)
            cls = F.coalesce(F.array_position(scores, best).cast("int") - 1, F.lit(0))
            x1, y1, x2, y2 = at(i, 0) - at(i, 2) / 2, at(i, 1) - at(i, 3) / 2, at(i, 0) + at(i, 2) / 2, at(i, 1) + at(i, 3) / 2
        else:
            x1, y1, x2, y2 = (at(i, k) for k in range(4))
            score = at(i, 4) if width > 4 else F.lit(1.0)
            cls = F.round(at(i, 5)).cast("int") if width > 5 else F.lit(0)
        return F.struct((x1 * sx).alias("x1"), (y1 * sy).alias("y1"), (x2 * sx).alias("x2"), (y2 * sy).alias("y2"), score.cast("double").alias("score"), cls.alias("class"))

    numbered = F.when(rows > 0, F.sequence(F.lit(0), rows - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(numbered, one), lambda b: b["score"] >= threshold)


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes over their union; 0 where both are empty."""
    side = lambda p, q: F.greatest(F.lit(0.0), F.least(a[q], b[q]) - F.greatest(a[p], b[p]))
    area = lambda c: F.greatest(F.lit(0.0), c["x2"] - c["x1"]) * F.greatest(F.lit(0.0), c["y2"] - c["y1"])
    both = side("x1", "x2") * side("y1", "y2")
    return F.coalesce(both / F.nullif(area(a) + area(b) - both, F.lit(0.0)), F.lit(0.0))


def nms(found: Column, limit: float = 0.45) -> Column:
    """Greedy suppression within a class: best score first, each box kept unless it overlaps a kept one of its class over the limit."""
    best = F.array_sort(found, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0))
    none = F.slice(best, F.lit(1), F.lit(0))
    clash = lambda kept, b: F.exists(kept, lambda k: (k["class"] == b["class"]) & (iou(k, b) > limit))
    return F.aggregate(best, none, lambda kept, b: F.when(clash(kept, b), kept).otherwise(F.concat(kept, F.array(b))))


def rotated_corners(cx: Column, cy: Column, w: Column, h: Column, angle: Column) -> Column:
    """The four corners of a rotated box, in order around it."""
    point = lambda u, v: F.struct((cx + u * w / 2 * F.cos(angle) - v * h / 2 * F.sin(angle)).alias("x"), (cy + u * w / 2 * F.sin(angle) + v * h / 2 * F.cos(angle)).alias("y"))
    return F.array(point(-1, -1), point(1, -1), point(1, 1), point(-1, 1))


# Masks, polygons, heat maps ----------------------------------------------------


def class_map(flat: Column, classes: int, pixels: int) -> Column:
    """Class of each pixel: the largest of ``classes`` planes, the first of equals."""
    plane = lambda i: F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.get(flat, c * pixels + i))
    return F.transform(F.sequence(F.lit(0), F.lit(pixels - 1)), lambda i: (F.array_position(plane(i), F.array_max(plane(i))) - 1).cast("int"))


def class_shares(df: DataFrame, keys: list[str], classes: str) -> DataFrame:
    """(class, pixels, fraction) of each image."""
    each = df.select(*keys, F.size(classes).alias("__n"), F.explode(classes).alias("class"))
    return each.groupBy(*keys, "class").agg(F.count(F.lit(1)).alias("pixels"), (F.count(F.lit(1)) / F.first("__n")).alias("fraction"))


def instance_masks(df: DataFrame, keys: list[str], masks: str, width: int, threshold: float = 0.5) -> DataFrame:
    """Area, bounds and fraction of every mask (array of flat masks) over the threshold."""
    each = df.select(*keys, F.posexplode(masks).alias("instance", "m")).select(*keys, "instance", F.size("m").alias("n"), F.posexplode("m").alias("i", "v")).where(F.col("v") > threshold)
    x, y = F.col("i") % width, F.floor(F.col("i") / width)
    return each.groupBy(*keys, "instance").agg(F.count(F.lit(1)).alias("area"), F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"), (F.count(F.lit(1)) / F.first("n")).alias("fraction"))


def polygon(points: Column) -> Column:
    """Struct area (shoelace), perimeter, min_x, min_y, max_x, max_y of an array of (x, y)."""
    following = F.concat(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(1), F.lit(1)))
    total = lambda f: F.aggregate(F.zip_with(points, following, f), F.lit(0.0), lambda s, v: s + v)
    axis = lambda n: F.transform(points, lambda p: p[n])
    return F.struct(
        (F.abs(total(lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2).alias("area"), total(lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"])).alias("perimeter"),
        F.array_min(axis("x")).alias("min_x"), F.array_min(axis("y")).alias("min_y"), F.array_max(axis("x")).alias("max_x"), F.array_max(axis("y")).alias("max_y"),
    )


def visible_keypoints(flat: Column, threshold: float = 0.5) -> Column:
    """Keypoints (x, y, confidence triples) whose confidence reaches the threshold, counted."""
    n = F.floor(F.size(flat) / 3).cast("int")
    return F.when(n > 0, F.size(F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(flat, i * 3 + 2) >= threshold))).otherwise(0)


def heatmap(flat: Column) -> Column:
    """Struct min, max, mean."""
    return F.struct(F.array_min(flat).alias("min"), F.array_max(flat).alias("max"), (F.aggregate(flat, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(flat), F.lit(0))).alias("mean"))


def labelled(inside: np.ndarray) -> np.ndarray:
    """For each place of a mask the smallest place (in reading order) of its 4-connected region, or the number of places outside of all.

    Labels take their neighbours' least, roots are hooked to it and paths
    halved, so the passes grow with the logarithm of a region's length.
    """
    h, w = inside.shape
    out = h * w
    label = np.append(np.where(inside, np.arange(out).reshape(h, w), out).ravel(), out)
    while True:
        at = label[:-1].reshape(h, w)
        padded = np.pad(at, 1, constant_values=out)
        least = np.where(inside, np.minimum.reduce([at, padded[:-2, 1:-1], padded[2:, 1:-1], padded[1:-1, :-2], padded[1:-1, 2:]]), out)
        new = label.copy()
        np.minimum.at(new, at.ravel(), least.ravel())
        new[:-1] = np.minimum(new[:-1], least.ravel())
        new[out] = out
        new = new[new]
        if (new == label).all():
            return at
        label = new


def regions(score: np.ndarray, threshold: float) -> list[dict]:
    """4-connected regions over the threshold, largest area first: area, peak, bounds."""
    inside = score > threshold
    label = labelled(inside)
    out = []
    for v in np.unique(label[inside]):
        y, x = np.nonzero(label == v)
        out.append({"area": len(y), "peak": float(score[y, x].max()), "min_x": int(x.min()), "min_y": int(y.min()), "max_x": int(x.max()), "max_y": int(y.max())})
    return sorted(out, key=lambda r: -r["area"])


#: Figures of a region besides its keys.
FIGURES = {"area": "long", "peak": "double", "min_x": "long", "min_y": "long", "max_x": "long", "max_y": "long"}


def tiled_regions(tiles: DataFrame, keys: list[str], scores: str, threshold: float = 0.5) -> DataFrame:
    """Regions over the threshold of score maps larger than a row: (keys, area, peak, min_x, min_y, max_x, max_y), one row a region.

    A tile is a row: flat ``scores``, ``width`` of its lines, and ``x0``, ``y0`` of
    its first place in its map; tiles must not overlap.  Regions are labelled
    within tiles, tiles' border places meet their neighbours by a join, and the
    labels that touch are united (:func:`condmon.functions.graphs.rooted`), so
    what travels are borders and one row a region of a tile.  Tiles without
    scores or width have no region; NaN is over no threshold.
    """
    kept = tiles.select(*keys, "x0", "y0", "width", F.col(scores).cast("array<double>").alias("__scores")).where("width > 0 and __scores is not null")
    place = "array<struct<x:long,y:long>>"
    schema = T.StructType([*(kept.schema[k] for k in keys), T.StructField("node", T.LongType()), *T._parse_datatype_string(", ".join(f"{n} {k}" for n, k in FIGURES.items())).fields, T.StructField("border", T._parse_datatype_string(place))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c, batch=batch: batch.column(batch.schema.get_field_index(c))
            rows: list[int] = []
            out: dict[str, list] = {n: [] for n in ("node", *FIGURES, "border")}
            for i, (x0, y0, width) in enumerate(zip(*[column(c).to_pylist() for c in ("x0", "y0", "width")], strict=True)):
                flat = np.array(column("__scores")[i].as_py(), dtype=np.float64)
                if not len(flat):
                    continue
                score = flat.reshape(-1, width)
                inside = score > threshold
                y, x = np.nonzero(inside)
                if not len(y):
                    continue
                roots, which = np.unique(labelled(inside)[inside], return_inverse=True)
                edge = (y == 0) | (x == 0) | (y == score.shape[0] - 1) | (x == width - 1)
                order = np.argsort(which, kind="stable")
                starts = np.searchsorted(which[order], np.arange(len(roots)))
                over = lambda f, v, order=order, starts=starts: f.reduceat(v[order], starts).tolist()
                rows += [i] * len(roots)
                out["node"] += (((roots // width + y0) << 31) + roots % width + x0).tolist()
                out["area"] += over(np.add, np.ones(len(y), dtype=np.int64))
                out["peak"] += over(np.maximum, score[y, x])
                for name, v in (("x", x + x0), ("y", y + y0)):
                    out[f"min_{name}"] += over(np.minimum, v)
                    out[f"max_{name}"] += over(np.maximum, v)
                borders: list[list[dict]] = [[] for _ in roots]
                for k, bx, by in zip(which[edge].tolist(), (x[edge] + x0).tolist(), (y[edge] + y0).tolist(), strict=True):
                    borders[k].append({"x": bx, "y": by})
                out["border"] += borders
            kinds = [pa.int64(), *(pa.float64() if k == "double" else pa.int64() for k in FIGURES.values()), pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64())]))]
            head = [column(k).take(pa.array(rows, pa.int64())) for k in keys]
            yield pa.RecordBatch.from_arrays([*head, *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], names=schema.names)

    parts = written(kept.mapInArrow(run, schema), "regions")
    border = parts.select(*keys, "node", F.explode("border").alias("p")).select(*keys, "node", "p.x", "p.y")
    beside = F.explode(F.array(F.struct((F.col("x") + 1).alias("x"), F.col("y").alias("y")), F.struct(F.col("x").alias("x"), (F.col("y") + 1).alias("y"))))
    other = border.select(*[F.col(k).alias(f"__of_{k}") for k in keys], F.col("node").alias("b"), F.col("x").alias("__x"), F.col("y").alias("__y"))
    met = border.select(*keys, F.col("node").alias("a"), beside.alias("p"))
    same = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys]
    links = met.join(other, [*same, F.col("p.x") == F.col("__x"), F.col("p.y") == F.col("__y")]).where("a <> b").select(*keys, "a", "b")
    roots = rooted(links, keys)
    named = roots.select(*[F.col(k).alias(f"__of_{k}") for k in keys], F.col("node").alias("__node"), "root")
    united = parts.join(named, [*same, F.col("node") == F.col("__node")], "left").withColumn("root", F.coalesce("root", "node"))
    whole = {"area": F.sum, "peak": F.max, "min_x": F.min, "min_y": F.min, "max_x": F.max, "max_y": F.max}
    return united.groupBy(*keys, "root").agg(*[f(n).alias(n) for n, f in whole.items()]).drop("root")


def anomaly_map(df: DataFrame, scores: str, width: int, threshold: float = 0.5) -> DataFrame:
    """Adds ``regions`` and ``fraction`` of pixels over the threshold of each flat score map."""
    item = T.StructType([T.StructField("area", T.IntegerType()), T.StructField("peak", T.DoubleType()), *[T.StructField(n, T.IntegerType()) for n in ("min_x", "min_y", "max_x", "max_y")]])

    @F.pandas_udf(T.ArrayType(item))
    def found(maps):
        import pandas as pd

        return pd.Series([[tuple(r.values()) for r in regions(np.asarray(m, dtype=np.float64).reshape(-1, width), threshold)] if m is not None else None for m in maps])

    over = F.size(F.filter(scores, lambda v: v > threshold))
    return df.withColumn("regions", found(F.col(scores).cast("array<double>"))).withColumn("fraction", over / F.nullif(F.size(scores), F.lit(0)))


def classify(scores: Column, top: int = 3, softmax: bool = True) -> Column:
    """The ``top`` classes (class, probability), best first, the smaller class of equals."""
    peak = F.array_max(scores)
    raised = F.transform(scores, lambda v: F.exp(v - peak)) if softmax else scores
    total = F.aggregate(raised, F.lit(0.0), lambda s, v: s + v) if softmax else F.lit(1.0)
    ranked = F.array_sort(F.transform(raised, lambda v, i: F.struct((-(v / total)).alias("p"), i.alias("class"))))
    return F.transform(F.slice(ranked, F.lit(1), F.lit(top)), lambda r: F.struct(r["class"].alias("class"), (-r["p"]).alias("probability")))


def draw(image: np.ndarray, found: list[dict], color: tuple[int, int, int] = (255, 0, 0)) -> np.ndarray:
    """A copy with the outlines of boxes."""
    out = image.copy()
    for b in found:
        x1, y1, x2, y2 = (int(round(b[k])) for k in ("x1", "y1", "x2", "y2"))
        x1, x2 = sorted((min(max(x1, 0), out.shape[1] - 1), min(max(x2, 0), out.shape[1] - 1)))
        y1, y2 = sorted((min(max(y1, 0), out.shape[0] - 1), min(max(y2, 0), out.shape[0] - 1)))
        out[[y1, y2], x1 : x2 + 1] = color
        out[y1 : y2 + 1, [x1, x2]] = color
    return out
