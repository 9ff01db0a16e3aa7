"""Sharding by proportional stratified interleaving.

Rows of each source are put into a seeded order, each row gets the fractional
rank (rank + 1/2) / rows of its source, all rows are sorted by that fraction
and the order is cut into equal runs, so every shard has the mixture of the
whole and row counts differ by one at most.

No source and no shard is ever one task: both ranks are counted in two steps.
Rows fall into narrow buckets of the sort key; row numbers within a bucket plus
the row counts of the buckets before it are the exact rank.  The bucket counts
are an aggregate with a bounded number of rows for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condmon.llm.common import written, without

#: Rows aimed at in one bucket of the two-step ranks.
BUCKET_ROWS = 20_000


def seeded(seed: int, *cols: Column) -> Column:
    """A portable hash: hex MD5 of the seed and the columns."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))


def _ranked(df: DataFrame, groups: list[str], bucket: str, order: list[str], out: str) -> DataFrame:
    """Adds ``out``: the row number from 0 within ``groups`` by (bucket, order), counted in two steps."""
    keys = [*groups, bucket]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*keys).orderBy(*order)
    inner = df.withColumn("__row", F.row_number().over(within) - 1)
    on = [inner[k].eqNullSafe(offsets[k]) for k in keys]
    joined = inner.join(offsets, on=on, how="left")
    return joined.select(*[inner[c] for c in df.columns], (F.col("__row") + F.col("__before")).alias(out))


def interleave(df: DataFrame, shards: int, id_col: str = "doc_id", source_col: str = "source", seed: int = 17) -> DataFrame:
    """Adds ``shard`` (int) and ``slot`` (long, gapless from 0 within its shard) to every row.

    A null source is a source of its own.  Equal hashes (repeated ids) go by
    id, then by all remaining columns that can be ordered as text, so that only
    rows that are alike in all of them are interchangeable.  A row without an id
    is placed by a hash of all its columns, so such rows spread, however many.
    Texts are read only for that hash, so very long ones cost nothing more.  An
    empty table gives an empty one.  Columns named like an output are replaced.
    """
    clean = without(df, ["shard", "slot"])
    total = clean.count()
    buckets = max(1, min(1 << 20, -(-total // BUCKET_ROWS)))
    tie = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in clean.columns])
    h = F.when(F.col(f"`{id_col}`").isNull(), seeded(seed, F.lit("null"), tie)).otherwise(seeded(seed, F.col(f"`{id_col}`")))
    top = F.conv(F.substring(h, 1, 8), 16, 10).cast("long")
    rows = clean.select(F.struct(*[F.col(f"`{c}`") for c in clean.columns]).alias("__all"), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("__s"), F.col(f"`{source_col}`").isNull().alias("__null"), h.alias("__h"), F.col(f"`{id_col}`").alias("__id"), tie.alias("__tie"), F.floor(top * buckets / F.lit(1 << 32)).cast("long").alias("__b"))
    ranked = _ranked(rows, ["__s", "__null"], "__b", ["__h", "__id", "__tie"], "__r")
    sizes = rows.groupBy("__s", "__null").agg(F.count(F.lit(1)).alias("__size"))
    placed = ranked.join(sizes, ["__s", "__null"])
    # (2 rank + 1) / (2 size), compared exactly: scaled to integers of a common fineness, ties by source and rank.
    frac = ((F.col("__r") * 2 + 1).cast("double") / (F.col("__size") * 2).cast("double")).alias("__f")
    spread = placed.select("__all", "__s", "__null", "__r", frac).withColumn("__g", F.floor(F.col("__f") * buckets).cast("long")).withColumn("__one", F.lit(0))
    order = written(spread, "interleave")
    final = _ranked(order, ["__one"], "__g", ["__f", "__s", "__null", "__r"], "__pos")
    base, extra = divmod(total, shards)
    wide = extra * (base + 1)  # rows of the first shards, which take one more
    pos = F.col("__pos")
    shard = F.when(pos < wide, F.floor(pos / F.lit(base + 1))).otherwise(F.lit(extra) + F.floor((pos - wide) / F.lit(max(base, 1))))
    first = F.when(F.col("shard") < extra, F.col("shard") * (base + 1)).otherwise(wide + (F.col("shard") - extra) * base)
    out = final.withColumn("shard", shard.cast("int")).withColumn("slot", (pos - first).cast("long"))
    return out.select(*[F.col("__all").getField(c).alias(c) for c in clean.columns], "shard", "slot")
