"""Oversampling of a rare class: SMOTE, ADASYN and Tomek links over an exact neighbour join.

*Neighbour join* (:func:`nearest`).  Points fall to their nearest top pivot, and
then to the nearest of the pivots under it, so that placing one costs about twice
the root of the number of pivots.  A query first looks in its own cell; the k-th
distance it finds there bounds what is left: another cell can hold a nearer point
only if the distance to its pivot less the cell's radius, and the distance to the
plane between that pivot and the query's nearest one beside it, are within that
bound; first so for all cells under a top pivot together.  So the pairs of the
table are never made, and the result is exact.

Equal points are one, with their smallest ids, before anything is paired: a
value that a third of all rows share costs one point.  A cell is cut into lots
of at most LOT points and LOT queries, so no task holds a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condmon.functions.chunks import numbered
from condmon.functions.lineage import written

#: Points aimed at in a cell, and pivots at most (they are held by the driver and by every worker).
CELL_POINTS, PIVOTS = 512, 16384
#: Numbers at most that all pivots have.
_PIVOT_NUMBERS = 1 << 22
#: Points and queries at most that meet in one task.
LOT = 2048
#: Distance pairs computed at a time.
_PAIRS = 1 << 20


def _distinct(df: DataFrame, id_col: str, values_col: str, keep: int) -> DataFrame:
    """(point, ids, salts): distinct points, their ``keep`` smallest ids, cut by salted groups first, and the salts of their rows."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(values_col).cast("array<double>").alias("point")).where("id is not null and point is not null")
    rows = rows.where(F.forall("point", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.withColumn("salt", _salt())
    least = Window.partitionBy("point", "salt").orderBy("id")
    some = rows.withColumn("r", F.row_number().over(least)).where(F.col("r") <= keep)
    return some.groupBy("point").agg(F.slice(F.sort_array(F.collect_list("id")), 1, keep).alias("ids"), F.collect_set("salt").alias("salts"))


def _salt() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(64))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b, summed coordinate by coordinate in order."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1] if a.ndim == 2 else 0):
        out += (a[:, k, None] - b[None, :, k]) ** 2
    return out


class Pivots:
    """Points under top points: every one is under its nearest of the first few."""

    def __init__(self, points: np.ndarray) -> None:
        self.top = points[: max(1, round(len(points) ** 0.5))]
        home = np.concatenate([_squares(points[i : i + 1024], self.top).argmin(axis=1) for i in range(0, len(points), 1024)])
        order = np.argsort(home, kind="stable")
        self.points, self.top_of = points[order], home[order]
        self.starts = np.searchsorted(self.top_of, np.arange(len(self.top) + 1))
        self.apart = np.sqrt(_squares(self.top, self.top))

    def under(self, t: int) -> slice:
        return slice(self.starts[t], self.starts[t + 1])

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell of each row, its distance to the pivot and to the top pivot."""
        top, far = np.zeros(len(x), np.int64), np.zeros(len(x))
        cell, reach = np.zeros(len(x), np.int64), np.zeros(len(x))
        step = max(1, _PAIRS // len(self.top))
        for i in range(0, len(x), step):
            square = _squares(x[i : i + step], self.top)
            top[i : i + step], far[i : i + step] = square.argmin(axis=1), np.sqrt(square.min(axis=1))
        for t, rows in _groups(top):
            square = _squares(x[rows], self.points[self.under(t)])
            cell[rows], reach[rows] = self.starts[t] + square.argmin(axis=1), np.sqrt(square.min(axis=1))
        return cell, reach, far

    def open(self, x: np.ndarray, own: np.ndarray, bound: np.ndarray, radius: np.ndarray, top_radius: np.ndarray, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, cell, bound): the cells but its own that may hold a point within the row's bound.  Where that is infinite, the distance to the ``keep``-th top pivot bounds: they are points."""
        step = max(1, _PAIRS // len(self.top))
        for i in range(0, len(x), step):
            part, home = x[i : i + step], self.top_of[own[i : i + step]]
            square = _squares(part, self.top)
            least = np.partition(square, keep - 1, axis=1)[:, keep - 1] if len(self.top) >= keep else np.full(len(part), np.inf)
            within = np.minimum(bound[i : i + step], np.nextafter(np.sqrt(least), np.inf))
            # a little more than the bound, so that rounding never closes a cell
            limit = np.nextafter(within, np.inf) * (1 + 1e-9) + 1e-9
            near = square[np.arange(len(home)), home]
            row, top = np.nonzero(_within(square, near, self.apart[home], limit, top_radius))
            for t, some in _groups(top):
                rows = row[some]
                pivots = self.points[self.under(t)]
                for j in range(0, len(rows), max(1, _PAIRS // len(pivots))):
                    r = rows[j : j + max(1, _PAIRS // len(pivots))]
                    square_t = _squares(part[r], pivots)
                    nearest_ = square_t.argmin(axis=1)
                    gaps = np.sqrt(_squares(pivots[nearest_], pivots))
                    at, cell = np.nonzero(_within(square_t, square_t[np.arange(len(r)), nearest_], gaps, limit[r], radius[self.under(t)]))
                    cell = cell + self.starts[t]
                    other = cell != own[i + r[at]]
                    yield i + r[at][other], cell[other], limit[r[at][other]]


def _within(square: np.ndarray, near: np.ndarray, gap: np.ndarray, limit: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Whether a cell can hold a point within the limit: by its radius (under 0: it is empty), and by the plane between its pivot and the nearest, with some room for rounding."""
    plane = np.divide(square * (1 - 1e-12) - near[:, None] * (1 + 1e-12), 2 * gap, out=np.zeros_like(square), where=gap > 0)
    return (np.sqrt(square) - radius <= limit[:, None]) & (radius >= 0) & (plane <= limit[:, None])


def _groups(of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value and the places that have it."""
    order = np.argsort(of, kind="stable")
    values, begins = np.unique(of[order], return_index=True)
    for v, some in zip(values.tolist(), np.split(order, begins[1:]), strict=True):
        yield v, some


def _placed(points: DataFrame, pivots: Pivots) -> DataFrame:
    """Adds ``cell``, ``reach`` (distance to its pivot) and ``far`` (to its top pivot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = pivots.place(_matrix(batch.column(batch.schema.get_field_index("point"))))
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, made)], names=[*batch.schema.names, "cell", "reach", "far"])

    return points.mapInArrow(run, T.StructType([*points.schema.fields, T.StructField("cell", T.LongType()), T.StructField("reach", T.DoubleType()), T.StructField("far", T.DoubleType())]))


def _others(queries: DataFrame, pivots: Pivots, radius: np.ndarray, top_radius: np.ndarray, keep: int) -> DataFrame:
    """(q, point, cell, bound): the cells besides its own that a query must still look in, from its ``bound``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, bound = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            for row, cell, limit in pivots.open(_matrix(batch.column(1)), own, bound, radius, top_radius, keep):
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(cell), pa.array(limit)], names=["q", "point", "cell", "bound"])

    return queries.select("q", "point", "cell", "bound").mapInArrow(run, "q long, point array<double>, cell long, bound double")


def _nearest_ids(square: np.ndarray, limit: np.ndarray, ids: np.ndarray, begins: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, distance squared, id) of the k least in each row of a table of squares, within the row's limit; a column stands for its ids, and ties go to smaller ids."""
    few = square <= limit[:, None]
    if square.shape[1] > k and few.sum() > 4 * k * len(square):
        few &= square <= np.partition(square, k - 1, axis=1)[:, k - 1 : k]
    row, column = np.nonzero(few)
    each = np.diff(begins)[column]
    inner = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    who, near, row = ids[np.repeat(begins[column], each) + inner], np.repeat(square[row, column], each), np.repeat(row, each)
    order = np.lexsort((who, near, row))
    row, near, who = row[order], near[order], who[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], near[place < k], who[place < k]


def _met(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """(q, found): the k nearest points of each query among those of its cell, within its ``bound``, as (distance squared, id), lot by lot."""
    lots = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / LOT).cast("int").alias(name))
    grid = lots(points, "p_lots").join(lots(queries, "q_lots"), "cell")
    mine = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    p = points.join(grid, "cell").withColumn("p_lot", mine("point", "p_lots")).withColumn("q_lot", all_of("q_lots")).select("cell", "p_lot", "q_lot", "point", "ids")
    q = queries.join(grid, "cell").withColumn("q_lot", mine("q", "q_lots")).withColumn("p_lot", all_of("p_lots")).select("cell", "p_lot", "q_lot", "q", "point", "bound")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        made = [(np.zeros(0, np.int64), np.zeros(1, np.int32), np.zeros(0), np.zeros(0, np.int64))]
        if left.num_rows and right.num_rows:
            x, y, asked, bound = _matrix(left.column("point")), _matrix(right.column("point")), left.column("q").to_numpy(), left.column("bound").to_numpy()
            lists = right.column("ids").combine_chunks()
            lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
            ids, begins = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            step = max(1, _PAIRS // len(y))
            for i in range(0, len(x), step):
                row, near, who = _nearest_ids(_squares(x[i : i + step], y), bound[i : i + step] ** 2, ids, begins, k)
                some, first = np.unique(row, return_index=True)
                made.append((asked[i + some], np.append(first, len(row)).astype(np.int32), near, who))
        tables = []
        for q_ids, offsets, near, who in made:
            listed = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v)) for v in (near, who)]
            tables.append(pa.Table.from_arrays([pa.array(q_ids), *listed], names=["q", "near", "who"]))
        return pa.concat_tables(tables)

    found = q.groupBy("cell", "p_lot", "q_lot").cogroup(p.groupBy("cell", "p_lot", "q_lot")).applyInArrow(run, "q long, near array<double>, who array<long>")
    return found.select("q", F.arrays_zip("near", "who").alias("found"))


def _best(found: DataFrame, k: int) -> DataFrame:
    return found.groupBy("q").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k).alias("found"))


def nearest(queries: DataFrame, points: DataFrame, k: int, id_col: str, values_col: str) -> DataFrame:
    """The k nearest points of every query but the one with its own id: (id, ``rank`` from 1, ``neighbour``, ``distance``), Euclidean, ties to the smaller id.

    Rows with a null id or with values that are null or not finite take no part;
    all vectors must have one length.  Fewer than k other points give fewer rows.
    """
    spark = points.sparkSession
    keep = k + 1
    known = written(_distinct(points, id_col, values_col, keep), "nearest-points")
    facts = known.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("point")).alias("dims")).first()
    wanted = max(1, min(PIVOTS, -(-facts.n // CELL_POINTS), _PIVOT_NUMBERS // max(1, facts.dims or 1)))
    # by hash, about twice as many as are wanted are sorted
    some = known.where(F.pmod(F.xxhash64("point"), F.lit(max(1, facts.n))) < 2 * wanted + 64)
    chosen = np.array([r.point for r in some.orderBy(F.xxhash64("point"), "point").limit(wanted).select("point").collect()])
    asked = _distinct(queries, id_col, values_col, 1).select(F.col("ids")[0].alias("q"), "point", "salts")
    if not len(chosen):
        return spark.createDataFrame([], "id long, rank int, neighbour long, distance double")
    pivots = Pivots(chosen)
    placed = written(_placed(known, pivots), "nearest-cells")
    radius, top_radius = np.full(len(pivots.points), -1.0), np.full(len(pivots.top), -1.0)
    for r in placed.groupBy("cell").agg(F.max("reach").alias("r"), F.max("far").alias("f")).collect():
        radius[r.cell], t = r.r, pivots.top_of[r.cell]
        top_radius[t] = max(top_radius[t], r.f)
    homes = written(_placed(asked, pivots).select("q", "point", "salts", "cell"), "nearest-queries")
    infinite = F.lit(float("inf"))
    first = written(_best(_met(homes.withColumn("bound", infinite), placed, keep), keep), "nearest-home")
    bound = F.when(F.size("found") >= keep, F.sqrt(F.element_at("found", -1)["near"])).otherwise(infinite)
    bounded = homes.join(first, "q", "left").withColumn("bound", F.coalesce(bound, infinite))
    more = _met(written(_others(bounded, pivots, radius, top_radius, keep), "nearest-others"), placed, keep)
    best = _best(first.unionByName(more), keep).join(homes.select("q", "point", "salts"), "q").select("point", "found", "salts")
    rows = queries.select(F.col(id_col).cast("long").alias("id"), F.col(values_col).cast("array<double>").alias("point"))
    # a point that many queries share: its list is one row, copied to the salts that its queries have
    rows = rows.withColumn("salt", _salt())
    dealt = best.withColumn("salt", F.explode("salts")).drop("salts")
    own = rows.join(dealt, ["point", "salt"]).select("id", F.slice(F.filter("found", lambda f: f["who"] != F.col("id")), 1, k).alias("found"))
    return own.select("id", F.posexplode("found").alias("place", "f")).select("id", (F.col("place") + 1).alias("rank"), F.col("f.who").alias("neighbour"), F.sqrt("f.near").alias("distance"))


# Resampling ------------------------------------------------------------------------


def _draw(seed: int, *cols: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def _number(digest: Column, part: int) -> Column:
    """Eight hex digits of a digest as a number below 2**32."""
    return F.conv(F.substring(digest, 1 + 8 * part, 8), 16, 10).cast("long")


def _synthetic(rare: DataFrame, copies: DataFrame, k: int, id_col: str, values_col: str, seed: int) -> DataFrame:
    """(base, copy, neighbour, gap, values): ``copies`` (id, copies) new points, each on the way from its base to one of its k neighbours."""
    near = nearest(rare, rare, k, id_col, values_col)
    points = rare.select(F.col(id_col).cast("long").alias("id"), F.col(values_col).cast("array<double>").alias("v"))
    made = copies.where("copies > 0").select("id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).withColumn("draw", _draw(seed, F.col("id"), F.col("copy")))
    made = made.withColumn("rank", (F.pmod(_number(F.col("draw"), 0), F.lit(k)) + 1).cast("int")).withColumn("gap", _number(F.col("draw"), 1) / F.lit(float(1 << 32)))
    ends = made.join(near.select("id", "rank", "neighbour"), ["id", "rank"]).join(points, "id").join(points.select(F.col("id").alias("neighbour"), F.col("v").alias("u")), "neighbour")
    between = F.zip_with("v", "u", lambda a, b: a + F.col("gap") * (b - a))
    return ends.select(F.col("id").alias("base"), F.col("copy"), "neighbour", "gap", between.alias("values"))


def _sizes(df: DataFrame, label_col: str, minority) -> tuple[int, int]:
    r = df.agg(F.count_if(F.col(label_col) == minority).alias("few"), F.count_if(F.col(label_col) != minority).alias("many")).first()
    return r.few, r.many


def _clean(df: DataFrame, id_col: str, values_col: str) -> DataFrame:
    v = F.col(values_col).cast("array<double>")
    return df.where(F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


NONE = "base long, copy long, neighbour long, gap double, values array<double>"


def smote(df: DataFrame, id_col: str, values_col: str, label_col: str, minority, neighbours: int = 5, seed: int = 42) -> DataFrame:
    """New points of the class ``minority``, as many as it lacks to the other rows: (base, copy, neighbour, gap, values).

    Every base gives total // rows points and the first of them, in a seeded
    order, one more; neighbours are the ``neighbours`` nearest of the class, or
    all others if fewer.  Fewer than six rows of the class give none, as does a
    class that is no minority.  Rows with a null id, label or values take no
    part.  ids must be unique.
    """
    df = _clean(df, id_col, values_col)
    few, many = _sizes(df, label_col, minority)
    total = many - few
    if few < 6 or total <= 0:
        return df.sparkSession.createDataFrame([], NONE)
    rare = df.where(F.col(label_col) == minority)
    order = rare.select(F.col(id_col).cast("long").alias("id")).withColumn("h", _draw(seed, F.col("id")))
    placed = numbered(order, [], ["h", "id"], F.substring("h", 1, 3))
    copies = placed.select("id", F.lit(total // few).cast("long") + F.when(F.col("__i") < total % few, 1).otherwise(0))
    return _synthetic(rare, copies.toDF("id", "copies"), min(neighbours, few - 1), id_col, values_col, seed)


def adasyn(df: DataFrame, id_col: str, values_col: str, label_col: str, minority, neighbours: int = 5, seed: int = 42) -> DataFrame:
    """As :func:`smote`, but a base gives points in proportion to the rows of the other class among its nearest of all (rounded half to even); none where no base has any."""
    df = _clean(df, id_col, values_col)
    few, many = _sizes(df, label_col, minority)
    total = many - few
    if few < 6 or total <= 0:
        return df.sparkSession.createDataFrame([], NONE)
    rare, k = df.where(F.col(label_col) == minority), min(neighbours, few - 1)
    labels = df.select(F.col(id_col).cast("long").alias("neighbour"), (F.col(label_col) != minority).alias("other"))
    hard = written(nearest(rare, df, k, id_col, values_col).join(labels, "neighbour").groupBy("id").agg(F.count_if("other").alias("hard")), "adasyn-hard")
    whole = hard.agg(F.sum("hard")).first()[0] or 0
    if not whole:
        return df.sparkSession.createDataFrame([], NONE)
    copies = hard.select("id", F.rint(F.col("hard") * F.lit(float(total)) / F.lit(float(whole))).cast("long").alias("copies"))
    return _synthetic(rare, copies, k, id_col, values_col, seed)


def tomek_links(df: DataFrame, id_col: str, values_col: str, label_col: str) -> DataFrame:
    """(a, b), a < b: rows of different classes that are each other's nearest; dropping them clears the border after oversampling."""
    one = nearest(df, df, 1, id_col, values_col).select("id", "neighbour")
    back = one.select(F.col("neighbour").alias("id"), F.col("id").alias("neighbour"))
    label = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("y"))
    both = one.join(back, ["id", "neighbour"]).where("id < neighbour").join(label, "id").join(label.select(F.col("id").alias("neighbour"), F.col("y").alias("z")), "neighbour")
    return both.where("y <> z").select(F.col("id").alias("a"), F.col("neighbour").alias("b"))
