"""MinHash near-dedup with b-bit signatures.

1. Every text gives its set of word shingles and ``BANDS * ROWS`` minima, one
   hash a band of ``ROWS`` minima.
2. Rows with equal sets are one class, known by its smallest id; only classes
   go on, so exact copies cost one aggregation and no pairs.
3. Classes that share a band are candidates.  Only the pairs of the smallest
   class of a band with the others are made (as many as the band has members).
4. The candidates alone get their full sets and a signature: the low ``BITS``
   bits of ``MINIMA`` further minima, packed.  Signatures are compared by bit
   counts; the share of equal fields is corrected for chance collisions
   (2**-BITS), and pairs estimated under ``FLOOR`` go, 4.3 standard deviations
   below the limit.
5. The rest is confirmed on full sets, 100 * intersection >= 75 * union.
6. Links become components.  A band whose members are in several components
   after that is looked at again, in lots of bounded size: pairs of members of
   different components, first the best four of each member, then all that are
   left.  So no link between components is lost, and a large group of near
   copies, which is one component after the first steps, never makes its pairs.

A pair at the limit shares no band with probability (1 - .75**4)**32 = 5e-6 and
is estimated too low with probability 1e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condmon.llm.common import append_columns, give_back, text_bytes, written
from condmon.llm.shingles import mix, sets

BANDS, ROWS, MINIMA, BITS = 32, 4, 1024, 2
#: Link limit in hundredths, words in a shingle, and the least estimate that is confirmed.
LIMIT, SIZE, FLOOR = 75, 5, 0.68
#: Ids up to which the candidates are broadcast to the documents (16 bytes each); beyond that both are dealt by id.
BROADCAST_IDS = 1_000_000
#: Members of a star that are confirmed in one task.
STAR_ROWS = 500
#: Members of a band that are compared in one group.
LOT = 512

_U = np.uint64


def _minima(value: np.ndarray, offsets: np.ndarray, count: int, seed: int) -> np.ndarray:
    """32-bit minima (count x rows) of the sets that are not empty."""
    x = mix(np.arange(1, 2 * count + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))
    starts = offsets[:-1][np.diff(offsets) > 0]
    least = np.empty((count, len(starts)), dtype=np.uint32)
    work = np.empty_like(value)
    for j in range(count if len(starts) else 0):
        np.bitwise_xor(value, x[j], out=work)
        np.multiply(work, x[count + j] | _U(1), out=work)
        least[j] = np.minimum.reduceat(work, starts) >> _U(32)
    return least


def band_hashes(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Band hashes (rows x BANDS) of the sets that are not empty."""
    least = _minima(value, offsets, BANDS * ROWS, 0).astype(_U)
    bands = np.zeros((BANDS, least.shape[1]), dtype=_U)
    for r in range(ROWS):
        bands = mix(bands + least[r::ROWS] + _U(r + 1))
    return mix(bands + np.arange(1, BANDS + 1, dtype=_U)[:, None]).T


def signatures(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Packed low bits of minima (rows x MINIMA * BITS / 8) of the sets that are not empty."""
    low = (_minima(value, offsets, MINIMA, 99) & np.uint32(2**BITS - 1)).astype(np.uint8).T
    return np.ascontiguousarray(low[:, 0::4] | (low[:, 1::4] << 2) | (low[:, 2::4] << 4) | (low[:, 3::4] << 6))


def equal_fields(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal BITS-wide fields of packed signatures, counted on the bits of a xor b."""
    x = np.bitwise_xor(a, b).view("<u8")
    x = (x | (x >> _U(1))) & _U(0x5555555555555555)
    return MINIMA - np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def estimate(equal: np.ndarray) -> np.ndarray:
    """Similarity from the share of equal fields, corrected for collisions by chance."""
    chance = 2.0**-BITS
    return (equal / MINIMA - chance) / (1 - chance)


def describe(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``n_shingles``, ``k1``/``k2`` (hash of the whole set; null for an empty one) and ``bands``."""
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]

    def make():
        def fn(batch: pa.RecordBatch) -> list:
            value, offsets = sets(*text_bytes(batch.column(batch.num_columns - 1)), SIZE)
            counts = np.diff(offsets)
            full = np.flatnonzero(counts)
            bands = np.ascontiguousarray(band_hashes(value, offsets))
            starts = offsets[:-1][full]
            keys = [np.add.reduceat(mix(value + _U(c)), starts) if len(full) else np.zeros(0, _U) for c in (1, 2)]
            where = np.full(len(counts), -1)
            where[full] = np.arange(len(full))
            pick = pa.array(where, mask=where < 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(full) * BANDS + 1, BANDS), type=pa.int32()), pa.array(bands.reshape(-1).view(np.int64)))
            return [pa.array(counts, type=pa.int64()), *[pa.array(k.view(np.int64)).take(pick) for k in keys], lists.take(pick)]

        return fn

    return append_columns(df, text_col, fields, make, limit=1 << 20, keep_text=False)


def full_sets(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``set`` (binary: sorted 64-bit shingles) and ``sig`` (binary, null for an empty set)."""

    def make():
        def fn(batch: pa.RecordBatch) -> list:
            value, offsets = sets(*text_bytes(batch.column(batch.num_columns - 1)), SIZE)
            packed = iter(signatures(value, offsets))
            ends = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
            return [[value[a:b].tobytes() for a, b in ends], [next(packed).tobytes() if b > a else None for a, b in ends]]

        return fn

    return append_columns(df, text_col, [T.StructField("set", T.BinaryType()), T.StructField("sig", T.BinaryType())], make, limit=1 << 20)


def _likely(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures leave a link possible."""
    both = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                keep = estimate(equal_fields(x, y)) >= FLOOR
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b) those whose full sets link.

    The pairs of one ``a`` form a star.  Stars are cut into parts of about
    STAR_ROWS pairs; the set of ``a`` goes to every part, each ``b`` to one.
    """
    sized = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / STAR_ROWS).cast("int")
    heads = sized.select("a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).join(shingles.select(F.col("rep").alias("a"), "set"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "set")
    members = pairs.join(sized, "a").select("a", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"), "b").join(shingles.select(F.col("rep").alias("b"), "set"), "b").select("a", "part", "b", "set")
    together = heads.unionByName(members)
    deal = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tops = None, []
        for batch in batches:
            found = []
            for a, part, b, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (a, part) != now:
                    now, tops = (a, part), []
                own = np.frombuffer(data, dtype=_U)
                if b is None:
                    tops.append(own)
                    continue
                for top in tops:
                    small, large = (own, top) if len(own) <= len(top) else (top, own)
                    if 100 * len(small) < LIMIT * len(large):
                        continue
                    at = np.searchsorted(large, small)
                    same = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                    if 100 * same >= LIMIT * (len(own) + len(top) - same):
                        found.append((a, b))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], type=pa.int64()) for i in (0, 1)], names=["a", "b"])

    return together.repartition(deal, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """Distinct links (a, b) to ``node``, ``component``: the smallest node reachable, for every node that has a link.

    Alternating large-star and small-star rounds over the links; each round is
    an aggregation and a join, written to the shared folder.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _across(members: DataFrame, sigs: DataFrame, bands: DataFrame, most: int | None) -> DataFrame:
    """Of the members (key, rep, comp) of each band that is split over components: pairs of different components with an estimate of FLOOR or more.

    Every member outside the band's largest component looks at all others; with
    ``most`` it names that many of its best in each lot.  A pair is made in the
    first band that its members share.  A band's members are dealt into lots of
    about LOT rows, each a group of its own; those that look travel to every lot
    of their band, and a task holds one lot at a time.
    """
    deal = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    split = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("comps"), F.max(F.struct("n", "comp")).alias("top")).where("comps > 1")
    split = split.select("key", F.ceil(F.col("n") / LOT).cast("int").alias("lots"), F.col("top.comp").alias("top"))
    rows = members.join(split, "key").join(sigs, "rep").join(bands, "rep")
    told = ("rep", "comp", "top", "bands", "sig")
    hosts = rows.select("key", F.pmod(F.xxhash64("rep"), "lots").cast("int").alias("lot"), F.lit(False).alias("looks"), *told)
    looking = rows.where("comp <> top").select("key", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.lit(True).alias("looks"), *told)

    def pairs(key: int, lot: tuple, one: tuple) -> tuple[np.ndarray, np.ndarray]:
        rep, comp, bands, sig = lot
        own_rep, own_comp, top, own_bands, own_sig = one
        # of two members that both look, the smaller one makes the pair
        other = np.flatnonzero((comp != own_comp) & ((comp == top) | (rep > own_rep)))
        e = estimate(equal_fields(own_sig, sig[other]))
        other, e = other[e >= FLOOR], e[e >= FLOOR]
        first = (bands[other] == own_bands).argmax(axis=1) == int(np.argmax(own_bands == key))
        other, e = other[first], e[first]
        if most is not None and len(other) > most:
            other = other[np.argpartition(-e, most)[:most]]
        return np.minimum(rep[other], own_rep), np.maximum(rep[other], own_rep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, lot = None, [], None
        for batch in batches:
            found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for key, place, looks, rep, comp, top, bands, sig in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (key, place) != now:
                    now, held, lot = (key, place), [], None
                bands, sig = np.array(bands, dtype=np.int64), np.frombuffer(sig, dtype=np.uint8)
                if not looks:
                    held.append((rep, comp, bands, sig))
                elif held:
                    lot = lot or tuple(np.array([h[i] for h in held]) for i in range(4))
                    found.append(pairs(key, lot, (rep, comp, top, bands, sig)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found])) for i in (0, 1)], names=["a", "b"])
        del held, lot
        give_back()

    dealt = hosts.unionByName(looking).repartition(deal, "key", "lot").sortWithinPartitions("key", "lot", "looks")
    return dealt.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, component) after further links: the components of components."""
    of = lambda c: (F.col(c) == F.col(f"n_{c}"), F.coalesce(F.col(f"c_{c}"), F.col(c)).alias(f"l_{c}"))
    both = links
    for c in ("a", "b"):
        both = both.join(label.select(F.col("node").alias(f"n_{c}"), F.col("component").alias(f"c_{c}")), of(c)[0], "left")
    upper = components(both.select(of("a")[1].alias("a"), of("b")[1].alias("b")))
    moved = label.join(upper.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return written(moved.unionByName(upper.join(label.select("node"), "node", "left_anti")), "labels")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: ``id_col`` (long), ``n_shingles``, ``component_id`` (smallest id reachable over links, its own included) and ``kept`` (id = component_id).

    A text without words has an empty set and no link; null and empty texts are
    such.  A row with a null id has no component (null) and is kept.  Rows that
    share an id are one document: they share a component.  Texts of any length
    count whole.  Other columns of the input are not read; an empty table gives
    an empty one.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("node"), F.col(f"`{text_col}`").alias("text"))
    known = written(describe(docs, "text").select("node", "n_shingles", "k1", "k2", "bands"), "minhash")
    some = known.where("node is not null and k1 is not null")
    classes = written(some.groupBy("k1", "k2").agg(F.min("node").alias("rep"), F.any_value("bands").alias("bands")), "classes")
    member = some.select("node", "k1", "k2").join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b")).distinct()
    keys = classes.select("rep", F.explode("bands").alias("key"))
    heads = keys.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("key", "a")
    shared = written(keys.join(heads, "key").select("key", "rep", "a"), "shared")
    # Full sets and signatures are needed of classes that share a band with another.
    wanted = written(shared.select(F.col("rep").alias("node")).distinct(), "wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    shingles = written(full_sets(docs.where("text is not null").join(wanted, "node", "left_semi"), "text").where("sig is not null").select(F.col("node").alias("rep"), "set", "sig"), "sets")
    sigs = shingles.select("rep", "sig")
    tested = written(_likely(shared.where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), sigs).distinct(), "likely")
    label = written(components(confirm(tested, shingles)), "labels")
    for most in (4, None):
        members = written(shared.select("key", "rep").join(label, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("comp")), "members")
        fresh = written(_across(members, sigs, classes.select("rep", "bands"), most).join(tested, ["a", "b"], "left_anti"), "fresh")
        label = _joined(label, written(confirm(fresh, shingles), "links"))
        tested = tested.unionByName(fresh)
    final = components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(member))
    out = known.select("node", "n_shingles").join(final.withColumnRenamed("node", "other"), F.col("node") == F.col("other"), "left")
    root = F.coalesce("component", "node")
    return out.select(F.col("node").alias(id_col), "n_shingles", root.alias("component_id"), F.coalesce(F.col("node") == root, F.lit(True)).alias("kept"))
