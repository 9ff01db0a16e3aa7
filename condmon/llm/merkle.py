"""Merkle manifest of a dataset by superblock reduction.

A leaf is the digest of a row's columns.  The leaves of a group (a source), in
order, are reduced by ``fanout`` to a subroot, the subroots in order of their
groups to the root.

Nodes are dealt by superblock: the index of a node divided by fanout ** k.  A
superblock is reduced by k levels at once in ``applyInPandas``; its roots are
the nodes of the next round, so a group of any size takes
log(rows) / (k log fanout) rounds and no task ever holds more than some
superblocks.  On the way back each superblock is cogrouped with the proof of
its own root, and the lower and the upper proof of a node are put together.

Indices are counted in two steps over a range-dealt table, so that a group with
most of the rows is many tasks' work; a tie of whole rows is dealt as well.
Texts are hashed where they are read and never shuffled: a node is 32 bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condmon.llm.common import bounded_batches, written

FANOUT = 3
#: Levels that a superblock is reduced by; 3 ** 7 = 2,187 nodes.
LEVELS = 7
#: Nodes aimed at in one call of the reducing function (several superblocks of small groups).
LOT = 4000
#: Stands in a proof's step where the node's own digest belongs.
SELF = "_"


def encoded(col: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value as text."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*cols: Column) -> Column:
    """Lowercase hex SHA-256 of a row's columns, in this order."""
    return F.sha2(F.concat(*[encoded(c) for c in cols]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda own, step: F.sha2(F.replace(step, F.lit(SELF), own), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof on end, from the leaf up, left to right."""
    return F.replace(F.array_join(proof, ""), F.lit(SELF), F.lit(""))


def _digest(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def _levels(nodes: list[str], n: int, fanout: int, levels: int) -> list[list[str]]:
    """The nodes of a superblock and what they become, level by level; ``n`` nodes are in the whole group at first."""
    out = [nodes]
    while n > 1 and len(out) <= levels:
        out.append([_digest(out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
        n = -(-n // fanout)
    return out


def _steps(tiers: list[list[str]], at: int, fanout: int) -> list[str]:
    """The proof of one node within its superblock."""
    steps = []
    for tier in tiers[:-1]:
        first = at - at % fanout
        run = tier[first : first + fanout]
        run[at - first] = SELF
        steps.append("".join(run))
        at //= fanout
    return steps


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the runs of equal keys."""
    if not len(keys):
        return []
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist()
    return list(zip(cuts, [*cuts[1:], len(keys)], strict=True))


def _numbered(df: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """Adds ``idx`` (from 0 within the groups, in order) and ``n`` (rows of the group), without a task for a group."""
    deal = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    keys = [*groups, *order, "__tie"]
    ranged = tied.repartitionByRange(deal, *[F.col(k).asc_nulls_first() for k in keys])
    held = written(ranged.withColumn("__part", F.spark_partition_id()), "merkle-order")
    counts = held.groupBy("__part", *groups).agg(F.count(F.lit(1)).alias("__c"))
    of = Window.partitionBy(*groups)
    before = of.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", *groups, F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"), F.sum("__c").over(of).alias("n"))
    row = F.row_number().over(Window.partitionBy("__part", *groups).orderBy(*[F.col(k).asc_nulls_first() for k in [*order, "__tie"]])) - 1
    placed = held.withColumn("__row", row)
    on = [placed[k].eqNullSafe(offsets[k]) for k in ("__part", *groups)]
    return placed.join(offsets, on).select(*[placed[c] for c in df.columns], (F.col("__row") + F.col("__before")).alias("idx"), "n")


def _dealt(nodes: DataFrame, lots: int, span: int) -> DataFrame:
    """Nodes with their superblock (group and block number) and the lot that it is worked on in."""
    block = F.floor(F.col("idx") / F.lit(span)).cast("long")
    return nodes.withColumn("up", block).withColumn("block", F.concat_ws("/", "group", block)).withColumn("lot", _lot(lots))


def _lot(lots: int) -> Column:
    return F.pmod(F.xxhash64("block"), F.lit(lots))


def _reduced(dealt: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Roots of all superblocks: nodes of the next round."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "idx"], kind="stable")
        rows = []
        for i, j in _runs(pdf["block"].to_numpy()):
            n = int(pdf["n"].iat[i])
            tiers = _levels([d.hex() for d in pdf["node"].iloc[i:j]], n, fanout, levels)
            rows.append((pdf["group"].iat[i], int(pdf["up"].iat[i]), -(-n // fanout**levels), bytes.fromhex(tiers[-1][0])))
        return pd.DataFrame(rows, columns=["group", "idx", "n", "node"])

    return dealt.select("lot", "block", "group", "up", "idx", "n", "node").groupBy("lot").applyInPandas(run, "group string, idx long, n long, node binary")


def _proved(dealt: DataFrame, lots: int, upper: DataFrame, extra: list[str], fanout: int, levels: int) -> DataFrame:
    """``dealt`` nodes with proof, subroot and root, from those of their superblocks' roots.  In Arrow, as the columns that ride along keep their types."""
    kept = dealt.select(*extra, "group", "idx").schema
    schema = T.StructType([*kept.fields, T.StructField("proof", T.ArrayType(T.StringType())), T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType())])

    def run(nodes: pa.Table, tops: pa.Table) -> pa.Table:
        nodes = nodes.sort_by([("block", "ascending"), ("idx", "ascending")])
        above = {t["block"]: t for t in tops.to_pylist()}
        block, digests, n = nodes.column("block").to_pylist(), nodes.column("node").to_pylist(), nodes.column("n").to_pylist()
        proofs, subs, roots = [], [], []
        for i, j in _runs(np.array(block, dtype=object)):
            top = above[block[i]]
            tiers = _levels([d.hex() for d in digests[i:j]], n[i], fanout, levels)
            proofs += [_steps(tiers, at, fanout) + top["proof"] for at in range(j - i)]
            subs += [top["subroot"]] * (j - i)
            roots += [top["root"]] * (j - i)
        made = [pa.array(proofs, type=pa.list_(pa.string())), pa.array(subs, type=pa.string()), pa.array(roots, type=pa.string())]
        return pa.Table.from_arrays([*(nodes.column(c) for c in kept.names), *made], names=schema.names)

    tops = upper.withColumn("block", F.concat_ws("/", "group", "idx")).select("block", "proof", "subroot", "root").withColumn("lot", _lot(lots))
    return dealt.groupBy("lot").cogroup(tops.groupBy("lot")).applyInArrow(run, schema)


class _Tree:
    """All rounds of the trees of some groups: ``nodes`` (group, idx, n, node, and ``extra`` columns), and their ``roots``."""

    def __init__(self, nodes: DataFrame, extra: list[str], fanout: int, levels: int) -> None:
        self.extra, self.fanout, self.levels, self.rounds = extra, fanout, levels, []
        while True:
            lots = max(1, -(-nodes.count() // LOT))
            dealt = _dealt(nodes, lots, fanout**levels)
            self.rounds.append((dealt, lots))
            nodes = written(_reduced(dealt, fanout, levels), "merkle-nodes")
            if (nodes.agg(F.max("n")).first()[0] or 1) == 1:
                break
        self.roots = nodes

    def proofs(self, tops: DataFrame) -> DataFrame:
        """Proofs of the first nodes, from those of the roots (group, idx 0, proof, subroot, root)."""
        for k in range(len(self.rounds) - 1, -1, -1):
            tops = _proved(*self.rounds[k], tops, self.extra if k == 0 else [], self.fanout, self.levels)
            if k:
                tops = written(tops, "merkle-proofs")
        return tops


def manifest(df: DataFrame, leaf_col: str, group_col: str = "source", order_col: str = "doc_id", fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Adds ``subroot``, ``root`` and ``proof`` to every row: a list of steps from the leaf to the root.

    A step is the text that the node above is the digest of, with ``_`` in the
    node's own place; :func:`folded` recomputes the root from any leaf and
    :func:`siblings` lists what a proof holds.

    ``leaf_col`` has hex digests (see :func:`leaf`).  Leaves of a group ascend by
    ``order_col``; null comes first, and rows that tie (repeated or null ids) go
    by their leaf, so equal rows are interchangeable.  A null group is a group
    of its own before all others; groups ascend bytewise.  A row with a null leaf
    is an error, as no proof can hold it.  The columns of ``df`` ride along, so
    select few before: they are shuffled three times.  Very long texts are no
    matter here, only their leaves come in.  Columns named like an output are
    replaced; an empty table gives an empty one.
    """
    bounded_batches(df.sparkSession)
    made = {"subroot", "root", "proof"}
    keep = [c for c in df.columns if c.lower() not in made]
    names = {c: f"__in{i}" for i, c in enumerate(keep)}
    q = lambda c: F.col(f"`{c}`")
    group = F.coalesce(F.concat(F.lit("="), q(group_col).cast("string")), F.lit(""))  # the empty text comes before every "=..."
    node = F.unhex(F.when(F.length(q(leaf_col)) == 64, q(leaf_col)).otherwise(F.raise_error(F.lit("a leaf must be a digest of 64 hex digits"))))
    base = df.select(*[q(c).alias(names[c]) for c in keep], group.alias("group"), q(order_col).alias("__order"), node.alias("node"))
    leaves = written(_numbered(base, ["group"], ["__order", "node"]).drop("__order"), "merkle-leaves")
    low = _Tree(leaves, list(names.values()), fanout, levels)
    heads = low.roots.select(F.lit("").alias("all"), "group", "node")
    ranked = _numbered(heads, ["all"], ["group"])
    upper = _Tree(ranked.select(F.col("all").alias("group"), F.col("group").alias("__source"), F.lower(F.hex("node")).alias("__sub"), "idx", "n", "node"), ["__source", "__sub"], fanout, levels)
    peak = upper.roots.select("group", "idx", F.array().cast("array<string>").alias("proof"), F.lit("").alias("subroot"), F.lower(F.hex("node")).alias("root"))
    tops = upper.proofs(peak).select(F.col("__source").alias("group"), F.lit(0).cast("long").alias("idx"), "proof", F.col("__sub").alias("subroot"), "root")
    done = low.proofs(written(tops, "merkle-tops"))
    return done.select(*[F.col(names[c]).alias(c) for c in keep], "subroot", "root", "proof")
