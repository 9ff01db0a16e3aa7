"""Mixing sources to target weights by iterative proportional fitting; DataFrame operations only.

Token totals are aggregated to cells of all margins (source, language, topic).
Raking multiplies the cells' weights by target over present share, one margin
after the other, until the rounds are done.  A document's expected number of
copies is its cell's calibrated weight over its tokens, and a seeded hash of the
id turns that into a draw.

The cells are the only thing iterated on.  Up to CELLS of them sit in one
partition, where the windows over a margin need no exchange; beyond that they
are dealt by margin value.  Every ROUNDS rounds the cells are written to the
shared folder, which cuts the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condmon.llm.common import without, written

#: Cells that one partition may hold, and rounds in one plan.
CELLS, ROUNDS = 100_000, 5
#: Cells up to which they are broadcast to the documents.
BROADCAST_CELLS = 20_000


def tokens(text: Column) -> Column:
    """Token estimate: a token for every four bytes begun; null and empty texts have none."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4.0).cast("long")


def topic(text: Column) -> Column:
    """A stand-in for a topic label, by form alone: lists, and prose by length.  Any other column can be the margin."""
    n = F.octet_length(F.coalesce(text, F.lit("")))
    return F.when(F.instr(F.coalesce(text, F.lit("")), " | ") > 0, "list").when(n < 1000, "brief").when(n < 6000, "article").otherwise("long")


def uniform(seed: int, id_col: Column) -> Column:
    """A number in [0, 1) that the seed and the id decide."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def rake(cells: DataFrame, margins: list[str], targets: dict[str, float], rounds: int = 20) -> DataFrame:
    """Adds ``w``: cell shares (sum one) whose margins have the target shares.

    ``cells`` has the margin columns and ``t`` (tokens, over 0).  ``targets``
    gives each margin an exponent: the target share of a value is its token
    share to that power, made to sum to one (1 keeps, 0 makes all values equal).
    The number of rounds is fixed; the last margin is met exactly, the others as
    far as the rounds have come.
    """
    few = cells.count() <= CELLS
    total = F.lit(float(cells.agg(F.sum("t")).first()[0] or 1))
    now = cells.withColumn("w", F.col("t") / total)
    for m in margins:
        shares = cells.groupBy(m).agg(F.sum("t").alias("mt")).select(m, F.pow(F.col("mt") / total, F.lit(float(targets[m]))).alias("p"))
        goal = shares.select(m, (F.col("p") / F.lit(float(shares.agg(F.sum("p")).first()[0] or 1))).alias(f"goal_{m}"))  # a row for each value of the margin
        now = now.join(goal, m)
    now = written(now, "cells")
    for first in range(0, rounds, ROUNDS):
        now = now.coalesce(1) if few else now
        for _ in range(min(ROUNDS, rounds - first)):
            for m in margins:
                now = now.withColumn("w", F.col("w") * F.col(f"goal_{m}") / F.sum("w").over(Window.partitionBy(m)))
        now = written(now, "cells")
    return now.drop(*[f"goal_{m}" for m in margins])


def mix(df: DataFrame, margins: dict[str, Column], targets: dict[str, float], token_col: str, id_col: str = "doc_id", share: float = 0.5, seed: int = 23, rounds: int = 20) -> DataFrame:
    """Adds ``expected`` (double: copies that the targets call for if the sample has ``share`` of all tokens) and ``copies`` (int, drawn: its whole part, and one more with the probability of the rest).

    ``margins`` names each margin and gives its value of a row; null is a value
    of its own.  Rows without tokens have no weight to calibrate: expected is
    ``share``.  Rows with the same id have the same draw; texts are read only for
    their length, so very long ones cost nothing more.  Equal weights need no
    tie rule: each row is drawn on its own.  An empty table gives an empty one;
    columns named like an output are replaced.
    """
    names = list(margins)
    rows = without(df, ["expected", "copies"])
    keys = {m: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null")) for m, c in margins.items()}
    keyed = rows.select("*", *[c.alias(f"__{m}") for m, c in keys.items()])
    cells = written(keyed.groupBy(*[F.col(f"__{m}").alias(m) for m in names]).agg(F.sum(token_col).alias("t")).where("t > 0"), "cells")
    fitted = rake(cells, names, targets, rounds)
    total = F.lit(float(fitted.agg(F.sum("t")).first()[0] or 1))
    rates = fitted.select(*[F.col(m).alias(f"__{m}") for m in names], (F.lit(share) * F.col("w") * total / F.col("t")).alias("__rate"))
    rates = written(rates, "rates")
    if rates.count() <= BROADCAST_CELLS:
        rates = F.broadcast(rates)
    joined = keyed.join(rates, [f"__{m}" for m in names], "left")
    expected = F.when(F.coalesce(F.col(token_col), F.lit(0)) > 0, F.col("__rate")).otherwise(F.lit(share))
    whole = F.floor("expected")
    out = joined.withColumn("expected", expected).withColumn("copies", (whole + F.when(uniform(seed, F.col(f"`{id_col}`")) < F.col("expected") - whole, 1).otherwise(0)).cast("int"))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], "expected", "copies")
