"""Connected components of links within groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condmon.functions.lineage import written


def rooted(links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, root): for every node of the links (keys, a, b) the smallest one that it is connected with in its group.

    Large and small stars by turns (Kiveris and others): each node's larger
    neighbours are linked to its smallest one, then each node and its smaller
    neighbours to the smallest of those, until no link changes.  Minima are
    aggregates, so no node's links are gathered, and every round is cut by a
    written table.
    """
    of = [F.col(k).alias(f"__of_{k}") for k in keys]
    same = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys]
    edge = lambda d: d.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    def star(d: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Each link with the least of its ``a`` and all neighbours of it; and those minima."""
        low = d.groupBy(*of, F.col("a").alias("__a")).agg(F.least(F.min("b"), F.min("a")).alias("m"))
        return d.join(low, [*same, F.col("a") == F.col("__a")]).select(*keys, "a", "b", "m"), low

    edges = written(edge(links), "links")
    while True:
        both = edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        large = edge(star(both)[0].where("b > a").select(*keys, F.col("b").alias("a"), F.col("m").alias("b")))
        met, low = star(written(large, "links"))
        own = low.select(*[F.col(f"__of_{k}").alias(k) for k in keys], F.col("__a").alias("a"), F.col("m").alias("b"))
        new = written(edge(met.select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own)), "links")
        if new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty():
            break
        edges = new
    leaves = new.select(*keys, F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(leaves.select(*keys, F.col("root").alias("node"), "root").distinct())
