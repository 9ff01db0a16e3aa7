"""Labelled rows for the classifiers: folds by id, and bounded samples with whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condmon.llm.common import written


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % parts


def chosen(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``y``, ``place`` (seeded order of ids) and whole text ``t`` of at most ``rows`` ids of each label that are not ``held_out``, as a table.

    Only ids of a row with a text and a label 0 or 1 are drawn, texts of any
    length; null ids, texts and labels take no part, and empty tables give no
    row.  Of several labels of an id the larger counts; of several texts of an
    id the least in byte order, so there is one row an id.
    """
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(id_col).agg(F.max(label).cast("int").alias("y")).where(~held_out)
    known = known.select(F.col(id_col).alias("id"), "y", F.xxhash64(id_col).alias("place")).join(texts.select("id"), "id", "left_semi")
    some = [known.where(F.col("y") == y).orderBy("place", "id").limit(rows) for y in (0, 1)]
    drawn = texts.join(F.broadcast(some[0].union(some[1])), "id")  # twice ``rows`` ids at most are broadcast
    return written(drawn.groupBy("id", "y", "place").agg(F.min("t").alias("t")), "sample")


def in_order(rows: list) -> list:
    """Collected figures of :func:`chosen` rows by label, place and id; of equal texts (``key``) the first, so a text with both labels counts as 0."""
    found: dict = {}
    for r in sorted(rows, key=lambda r: (r["y"], r["place"], r["id"])):
        found.setdefault(bytes(r["key"]), r)
    return list(found.values())
