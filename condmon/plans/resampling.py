"""Queries of oversampling: neighbour joins over ``orders`` and ``customer``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condmon.operators import oversample
from condmon.plans.catalogue import query, table

POINTS = """p AS MATERIALIZED (SELECT o_orderkey AS id, floor(o_totalprice / 100) AS x, CAST(datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS y,
  o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AS rare FROM orders),
s AS (SELECT count(*) FILTER (rare) AS few, count(*) FILTER (NOT rare) - count(*) FILTER (rare) AS total FROM p),
n AS (SELECT a.id, b.id AS neighbour, row_number() OVER (PARTITION BY a.id ORDER BY pow(a.x - b.x, 2) + pow(a.y - b.y, 2), b.id) AS rank FROM p a JOIN p b ON a.rare AND b.rare AND a.id <> b.id QUALIFY rank <= 5)"""

MADE = """m AS (SELECT id, copy, md5(concat_ws(':', '42', id, copy)) AS h FROM (SELECT id, unnest(range(1, copies + 1)) AS copy FROM c)),
d AS (SELECT id, copy, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 5 + 1 AS rank, CAST('0x' || substr(h, 9, 8) AS BIGINT) / 4294967296.0 AS gap FROM m)
SELECT d.id AS base, d.copy, n.neighbour, round(gap, 9) AS gap, round(a.x + gap * (b.x - a.x), 6) AS x, round(a.y + gap * (b.y - a.y), 6) AS y
FROM d JOIN n USING (id, rank) JOIN p a ON a.id = d.id JOIN p b ON b.id = n.neighbour"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as points of price and day; the rare class is urgent ones in progress."""
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    rare = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array(F.floor(F.col("o_totalprice") / 100).cast("double"), days).alias("v"), rare.alias("rare"))


def _shown(made: DataFrame) -> DataFrame:
    return made.select("base", "copy", "neighbour", F.round("gap", 9).alias("gap"), F.round(F.col("values")[0], 6).alias("x"), F.round(F.col("values")[1], 6).alias("y"))


@query(f"WITH {POINTS}, c AS (SELECT id, total // few + CASE WHEN row_number() OVER (ORDER BY md5(concat_ws(':', '42', id)), id) <= total % few THEN 1 ELSE 0 END AS copies FROM p, s WHERE rare), {MADE}")
def fe_smote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New points of the rare class until both classes are of one size."""
    return _shown(oversample.smote(points(spark, sf_dir), "id", "v", "rare", True))


@query(f"""WITH {POINTS}, a AS (SELECT a.id, b.rare, row_number() OVER (PARTITION BY a.id ORDER BY pow(a.x - b.x, 2) + pow(a.y - b.y, 2), b.id) AS rank FROM p a JOIN p b ON a.rare AND a.id <> b.id QUALIFY rank <= 5),
h AS (SELECT id, count(*) FILTER (NOT rare) AS hard FROM a GROUP BY id),
c AS (SELECT id, CAST(round_even(hard * CAST(total AS DOUBLE) / (SELECT CAST(sum(hard) AS DOUBLE) FROM h), 0) AS BIGINT) AS copies FROM h, s), {MADE}""")
def fe_adasyn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New points of the rare class, more of them where the other class is near."""
    return _shown(oversample.adasyn(points(spark, sf_dir), "id", "v", "rare", True))


@query("""WITH p AS MATERIALIZED (SELECT c_custkey AS id, floor(c_acctbal / 10) AS x, c_nationkey * 40.0 AS y, c_mktsegment = 'BUILDING' AS rare FROM customer),
o AS (SELECT a.id, any_value(a.rare) AS rare, min(struct_pack(d := pow(a.x - b.x, 2) + pow(a.y - b.y, 2), id := b.id)).id AS neighbour FROM p a JOIN p b ON a.id <> b.id GROUP BY a.id)
SELECT a.id AS a, b.id AS b FROM o a JOIN o b ON a.neighbour = b.id AND b.neighbour = a.id AND a.id < b.id AND a.rare <> b.rare""")
def fe_tomek_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of different classes that are each other's nearest."""
    v = F.array(F.floor(F.col("c_acctbal") / 10).cast("double"), F.col("c_nationkey") * F.lit(40.0))
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), v.alias("v"), (F.col("c_mktsegment") == "BUILDING").alias("rare"))
    return oversample.tomek_links(d, "id", "v", "rare")
