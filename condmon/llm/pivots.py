"""Exact top-k inner products by pivot-table elimination.

Vectors are integer.  PIVOTS pivots are chosen far apart from a bounded sample,
and the distances of every vector to all of them are computed once.  For a query
q and a candidate c the table gives ``d(q, c) >= max_p |d(q, p) - d(c, p)| = L``
and with it ``q.c <= (|q|^2 + |c|^2 - L^2) / 2``.  A query's candidates are
walked in the order of this bound, LOT at a time, until the next bound is under
the k-th score found by then.  Each query starts with its k-th score among the
sample, so whole groups of candidates can fall to their first bound.

Distances are kept as 16-bit steps and the bounds rounded up by what that loses,
so stopping is exact.  Scores are integer sums: in doubles where they fit 53
bits, else in 64-bit integers.

Candidates are dealt once into groups of about GROUP rows, one task each, and
stay there; the query rows travel to every group.  A task holds its group and
streams the queries through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condmon.llm.common import bounded_batches, give_back, written

#: Pivots, rows that they are chosen from, rows of a group of candidates, and the fewest worth a task of their own.
PIVOTS, SAMPLE, GROUP, LEAST = 256, 2048, 1 << 16, 2048
#: Candidates evaluated at a time, and queries whose bounds are computed together.
LOT, QUERIES = 256, 32


def choose_pivots(vectors: np.ndarray) -> np.ndarray:
    """Farthest-first: each pivot is the vector farthest from those before."""
    chosen = [0]
    near = ((vectors - vectors[0]) ** 2).sum(axis=1)
    while len(chosen) < min(PIVOTS, len(vectors)):
        i = int(near.argmax())
        if near[i] == 0:
            break
        chosen.append(i)
        near = np.minimum(near, ((vectors - vectors[i]) ** 2).sum(axis=1))
    return vectors[chosen]


def scaled(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``id`` and ``v`` (array of long) of the rows that take part: an id, and a vector without null or non-finite components."""
    v = F.col(f"`{vec_col}`")
    good = v.isNotNull() & F.col(f"`{id_col}`").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(good).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


class Group:
    """A group of candidates with its pivot table."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, sample: tuple[np.ndarray, np.ndarray], k: int) -> None:
        self.ids, self.vectors, self.pivots, self.k = ids, vectors, pivots, k
        self.sample_ids, self.sample = sample
        x = vectors.astype(np.float64)
        self.square = (x**2).sum(axis=1)
        table = _distances(x, pivots)
        self.top = float(table.max(initial=1.0))
        self.step = 2 * self.top / 16000  # a query's distances are clipped to twice the largest of the group
        self.table = np.ascontiguousarray(np.round(table / self.step).astype(np.int16).T)
        self.largest = float(self.square.max(initial=0.0))

    def _dot(self, vectors: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
        return (vectors @ q) if exact else (vectors.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)

    def _known(self, ids: np.ndarray, vectors: np.ndarray, exact: bool) -> np.ndarray:
        """A score that at least k candidates of the sample reach, for each query."""
        least = np.iinfo(np.int64).min
        if len(self.sample_ids) <= self.k:
            return np.full(len(ids), least)
        scores = vectors @ self.sample.T if exact else (vectors.astype(np.float64) @ self.sample.T.astype(np.float64)).astype(np.int64)
        scores[ids[:, None] == self.sample_ids[None, :]] = least
        return np.partition(scores, -self.k, axis=1)[:, -self.k]

    def search(self, ids: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """For each query: its id, the ids and scores of its best (k at most), and the candidates evaluated."""
        x = vectors.astype(np.float64)
        square = (x**2).sum(axis=1)
        sample_largest = float((self.sample.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0))
        exact = float(square.max(initial=0.0)) * max(self.largest, sample_largest) >= 2.0**104
        near = _distances(x, self.pivots)
        table = np.round(np.minimum(near, 2 * self.top) / self.step).astype(np.int16)
        known = self._known(ids, vectors, exact)
        gap, one = np.empty((len(ids), len(self.ids)), np.int16), np.empty((len(ids), len(self.ids)), np.int16)
        gap[:] = 0
        for p in range(len(self.pivots)):
            np.subtract(table[:, p, None], self.table[p][None, :], out=one)
            np.abs(one, out=one)
            np.maximum(gap, one, out=gap)
        # rounding moves each distance by half a step at most, and squares of n terms lose some last bits
        slack = self.step + 1e-6 * (1 + max(self.top, float(near.max(initial=0.0))))
        low = np.maximum(0.0, gap * self.step - slack)
        whole = square[:, None] + self.square[None, :]
        bound = (whole - low * low) / 2 + 1e-9 * whole + 1e-6
        for r, query in enumerate(ids.tolist()):
            kth, done = int(known[r]), 0
            alive = np.flatnonzero((bound[r] >= kth) & (self.ids != query))
            order = alive[np.argsort(-bound[r][alive])]
            who, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
            while done < len(order) and bound[r, order[done]] >= kth:
                some = order[done : done + LOT]
                s = self._dot(self.vectors[some], vectors[r], exact)
                who, score = np.concatenate([who, self.ids[some[s >= kth]]]), np.concatenate([score, s[s >= kth]])
                if len(who) > self.k:
                    best = np.lexsort((who, -score))[: self.k]
                    who, score = who[best], score[best]
                if len(who) == self.k:
                    kth = max(kth, int(score.min()))
                done += len(some)
            yield query, who, score, done


def _search(k: int, dim: int, pivots: np.ndarray, sample: tuple[np.ndarray, np.ndarray]):
    """Rows (g, asked, id, v) in that order: the candidates of a group, then the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, group = None, [], None
        for batch in batches:
            g, asked, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            vectors = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(g), dim)
            cuts = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (asked[1:] != asked[:-1]))) if len(g) else []
            for a, b in zip(cuts, [*cuts[1:], len(g)], strict=True):
                if g[a] != now:
                    now, held, group = g[a], [], None
                if not asked[a]:
                    held.append((ids[a:b].copy(), vectors[a:b].copy()))
                    continue
                if not held and group is None:
                    continue
                if group is None:
                    group, held = Group(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), pivots, sample, k), []
                for i in range(a, b, QUERIES):
                    j = min(b, i + QUERIES)
                    query, who, score, many = ([] for _ in range(4))
                    for one, w, s, n in group.search(ids[i:j], vectors[i:j]):
                        query += [np.full(len(w) + 1, one)]
                        who += [w, [-1]]
                        score += [s, [n]]
                        many += [np.zeros(len(w), bool), [True]]
                    columns = [np.concatenate(c) for c in (query, who, score, many)]
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0].astype(np.int64)), pa.array(columns[1].astype(np.int64)), pa.array(columns[2].astype(np.int64)), pa.array(columns[3].astype(bool))], names=["query_id", "vec_id", "score", "figure"])
        del held, group
        give_back()

    return run


_KIND = "query_id long, vec_id long, score long, figure boolean"


def search(df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """The best of each query and group (``query_id``, ``vec_id``, ``score``), and for each of them a row with ``figure`` true whose score is the number of candidates evaluated."""
    spark = df.sparkSession
    bounded_batches(spark)
    rows = written(scaled(df, id_col, vec_col, scale).withColumn("dim", F.size("v")), "vectors")
    out = spark.createDataFrame([], _KIND)
    for dim, n in sorted(rows.where("dim > 0").groupBy("dim").count().collect()):  # lengths of vectors, not rows
        out = out.unionByName(_one_length(rows.where(F.col("dim") == dim).select("id", "v"), queries, k, dim, n))
    return out


def top_k(df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """Each query's ``k`` best inner products: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``.

    ``queries`` tells the query rows by ``id``; candidates are all rows but
    those with the query's own id.  Components become floor(scale * x) with x as
    double.  Vectors that are null or have null or non-finite components, empty
    vectors, and rows without an id, take no part.  Vectors are searched among
    those of their own length; ties go to the smaller id; fewer than ``k``
    candidates give fewer rows; an empty table gives an empty one.  Of rows that
    repeat an id each is a candidate; as a query such an id stands for its least
    vector.  Scores beyond 64 bits wrap.
    """
    found = search(df, queries, k, id_col, vec_col, scale).where("not figure")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def evaluated(df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """``query_id`` and ``evaluated``: candidates whose inner product was computed, the rest having fallen to their bounds."""
    return search(df, queries, k, id_col, vec_col, scale).where("figure").groupBy("query_id").agg(F.sum("score").alias("evaluated"))


def _one_length(rows: DataFrame, queries: Column, k: int, dim: int, n: int) -> DataFrame:
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()  # SAMPLE rows
    ids, vectors = np.array([r["id"] for r in drawn], dtype=np.int64), np.array([r["v"] for r in drawn], dtype=np.int64).reshape(len(drawn), dim)
    pivots = choose_pivots(vectors.astype(np.float64))
    deal = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(-(-n // GROUP), min(deal, -(-n // LEAST)))
    candidates = rows.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g"), F.lit(False).alias("asked"), "id", "v")
    asked = rows.where(queries).groupBy("id").agg(F.min("v").alias("v")).select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(True).alias("asked"), "id", "v")
    dealt = candidates.unionByName(asked).repartition(max(deal, groups), "g").sortWithinPartitions("g", "asked")
    return dealt.mapInArrow(_search(k, dim, pivots, (ids, vectors)), _KIND)
