"""Sliding windows over series too long for one task.

A window function keeps a series in one task.  A frame of the last ``rows`` rows
needs only that many: here each series is cut into chunks of ``chunk`` rows, and
every chunk starts with the last ``rows - 1`` rows of the one before as context.
Row numbers are counted in two steps (rows by time bucket, then within a
bucket), so no step has a whole series in one task.  Frames bounded by time
instead of a count go in chunks of time (:func:`within_span`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], order: list[str], bucket: Column) -> DataFrame:
    """Adds ``__i``: the row number from 0 within the keys.  ``bucket`` must not fall along the order."""
    rows = df.withColumn("__bucket", bucket)
    counts = rows.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    both = [*keys, "__bucket"]
    offsets = counts.select(*[F.col(k).alias(f"__of_{k}") for k in both], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(*order)) - 1)
    on = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in both]
    return within.join(offsets, on, "left").select(*df.columns, (F.col("__r") + F.col("__before")).alias("__i"))


def framed(df: DataFrame, keys: list[str], order: list[str], bucket: Column, size: int, value: str = "value", out: str = "samples") -> DataFrame:
    """Whole frames of ``size`` rows in order: (keys, ``frame``, ``out``).  A shorter last frame gives no row; what ``frame`` counts is rows, null values among them."""
    cut = numbered(df.select(*keys, *order, value), keys, order, bucket).withColumn("frame", F.floor(F.col("__i") / size))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__i", value))), lambda s: s[value])
    return cut.groupBy(*keys, "frame").agg(listed.alias(out)).where(F.size(out) == size)


def sliding(df: DataFrame, keys: list[str], order: list[str], bucket: Column, rows: int, apply: Callable[[DataFrame, list[str]], DataFrame], chunk: int = 1_000_000, keep: bool = False, number: bool = False) -> DataFrame:
    """``apply(df, keys)`` with frames of at most ``rows`` rows, run chunk by chunk.

    ``apply`` must be such that a row's result depends on its own and the
    ``rows - 1`` rows before it; context rows are dropped from its result.  With
    ``keep`` the column ``__chunk`` stays, for :func:`last_known`; with ``number``
    ``__i`` does, for :func:`condmon.functions.scans.scanned`.

    Where no series is longer than a chunk (counted first, by key), nothing is
    cut: rows are dealt by key once, instead of by bucket, to their offsets and
    to their chunks.
    """
    chunk = max(chunk, rows)
    longest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if longest <= chunk:
        own = df.withColumn("__chunk", F.lit(0).cast("long")) if keep else df
        if number:
            own = own.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
        return apply(own, keys)
    at = numbered(df, keys, order, bucket)
    own = F.floor(F.col("__i") / chunk)
    late = F.col("__i") % chunk >= chunk - (rows - 1)
    homes = F.when(late, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = at.withColumn("__chunk", F.explode(homes)).withColumn("__own", F.col("__chunk") == own)
    return apply(dealt, [*keys, "__chunk"]).where("__own").drop("__own", *([] if number else ["__i"]), *([] if keep else ["__chunk"]))


def last_known(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the last ``value`` that is not null at or before each row, carried from chunk to chunk (``__chunk``, dropped); one row a chunk is all that crosses."""
    at = F.struct(*order)
    ends = df.groupBy(*keys, "__chunk").agg(F.max_by(value, F.when(F.col(value).isNotNull(), at)).alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "__chunk", F.last("__end", ignorenulls=True).over(before).alias("__carried"))
    upto = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = df.withColumn("__last", F.last(value, ignorenulls=True).over(upto)).join(carried, [*keys, "__chunk"])
    return own.withColumn(out, F.coalesce("__last", "__carried")).drop("__last", "__carried", "__chunk")


def within_span(df: DataFrame, keys: list[str], at: str, reach: int, apply: Callable[[DataFrame, list[str]], DataFrame], span: int | None = None) -> DataFrame:
    """``apply(df, keys)`` with frames that reach back ``reach`` of the whole number ``at`` (a time), run chunk by chunk of ``span`` of it.

    ``apply`` must be such that a row's result depends on no row earlier than
    ``at - reach``.  A chunk starts with the rows of the last ``reach`` before it
    as context, which are dropped from its result; rows without ``at`` are one
    chunk of their own.
    """
    span = max(span or 64 * reach, reach, 1)
    own = F.floor(F.col(at) / span)
    late = F.pmod(F.col(at), F.lit(span)) >= span - reach
    dealt = df.withColumn("__chunk", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own)))).withColumn("__own", F.col("__chunk").eqNullSafe(own))
    return apply(dealt, [*keys, "__chunk"]).where("__own").drop("__own", "__chunk")
