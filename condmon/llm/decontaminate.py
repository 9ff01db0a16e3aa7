"""Benchmark decontamination by a prefix-filtered set join.

A window is WINDOW consecutive words of a benchmark item (all words of a
shorter one).  A document has a window exactly if it has all its shingles (runs
of SHINGLE words) at the window's places, so it has the rarest of them: of each
window only that one, its prefix for a containment of 1, is joined.

1. Shingles of the items are counted over all documents (:func:`_counts`).
2. Shingles are ordered by that count; each window gives its first one.  The
   windows of an item that share it are one entry: shingle, its place in the
   item, first and last start of the windows.
3. Every document shingle that is in the index gives candidates.  The place of
   the shingle bounds the starts, the document's ends bound the lengths, and a
   candidate without a start left goes.
4. The words around the shingle are compared, first by hash, then by their
   bytes; the starts whose windows agree whole are hits.

Documents are never shuffled: the index travels.  It goes in blocks of at most
BLOCK bytes; items of more than one block are looked for block by block, with
the hits found so far carried along in a written table.  A passage or item that
is everywhere costs its own occurrences and no group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condmon.llm.common import append_columns, bounded_batches, give_back, slices, text_bytes, without, written
from condmon.llm.shingles import _BASE, mix, words

WINDOW, SHINGLE = 10, 5
#: Bytes of item words in one block of the index; what is made of them takes about six times that in a worker.
BLOCK = 16 << 20
_U = np.uint64
#: Every byte outside words becomes a blank; A-Z become small letters.
_CLEAN = np.full(256, 32, dtype=np.uint8)
_CLEAN[48:58] = np.arange(48, 58)
_CLEAN[65:91] = np.arange(97, 123)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)
_BITS = 22


class Words:
    """Words of some texts on end: ``hash``, ``row``, first byte ``a`` and end ``b``, and the texts' words ``begin[row]`` to ``begin[row + 1]``."""

    def __init__(self, text: np.ndarray, offsets: np.ndarray) -> None:
        self.clean = _CLEAN[text]
        self.hash, self.row, self.a, self.b = words(self.clean, offsets) if len(text) else (np.zeros(0, _U), *[np.zeros(0, np.int64)] * 3)
        self.begin = np.searchsorted(self.row, np.arange(len(offsets)))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, token) of every run of ``size`` words of one text."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        g = np.zeros(n, dtype=_U)
        for k in range(size):
            g = g * _U(_BASE) + self.hash[k : k + n]
        at = np.flatnonzero(self.row[:n] == self.row[size - 1 :])
        return at, mix(g[at] + _U(size))

    def between(self, i: int, j: int) -> list[bytes]:
        """Words i to j - 1, which are of one text."""
        return self.clean[self.a[i] : self.b[j - 1]].tobytes().split()


class _Known:
    """A sorted array of tokens with a bit table before it."""

    def __init__(self, tokens: np.ndarray) -> None:
        self.tokens = tokens
        self.bits = np.zeros(1 << _BITS, dtype=bool)
        self.bits[tokens & _U((1 << _BITS) - 1)] = True

    def of(self, token: np.ndarray) -> np.ndarray:
        """Places in ``token`` of those that are known."""
        at = np.flatnonzero(self.bits[token & _U((1 << _BITS) - 1)])
        place = np.minimum(np.searchsorted(self.tokens, token[at]), max(0, len(self.tokens) - 1))
        return at[self.tokens[place] == token[at]] if len(self.tokens) else at[:0]


@dataclass
class Index:
    """Entries in token order, and the distinct item texts that they point to."""

    size: np.ndarray  # words of the shingle
    token: np.ndarray
    item: np.ndarray
    at: np.ndarray  # word of the item that the shingle starts at
    first: np.ndarray  # starts of the windows that have it as their rarest
    last: np.ndarray
    texts: list[bytes]
    names: list[list[str]]

    def ready(self) -> Index:
        """What a worker needs besides, made once in each task."""
        joined = b"".join(self.texts)
        self.words = Words(np.frombuffer(joined, np.uint8), np.cumsum([0, *map(len, self.texts)]))
        n = np.diff(self.words.begin)
        self.width = np.minimum(n, WINDOW)
        self.known = {s: _Known(np.unique(self.token[self.size == s])) for s in np.unique(self.size).tolist()}
        return self

    def search(self, docs: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, end, item) of all runs of windows in the documents."""
        found = []
        for size, known in self.known.items():
            where, token = docs.shingles(size)
            some = known.of(token)
            lo = np.searchsorted(self.token, token[some], side="left")
            hi = np.searchsorted(self.token, token[some], side="right")
            many = hi - lo
            entry = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            word = np.repeat(where[some], many)
            keep = self.size[entry] == size
            found.append(self._confirmed(docs, size, word[keep], entry[keep]))
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))

    def _confirmed(self, docs: Words, size: int, word: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        item = self.item[entry]
        at, width, base = self.at[entry], self.width[item], self.words.begin[item]
        zero = word - at  # where the item's first word would be
        row = docs.row[word]
        lo = np.maximum(self.first[entry], docs.begin[row] - zero)
        hi = np.minimum(self.last[entry], docs.begin[row + 1] - zero - width)
        ok = lo <= hi
        zero, at, lo, hi, width, base, item = (x[ok] for x in (zero, at, lo, hi, width, base, item))
        left, right = np.zeros(len(zero), np.int64), np.zeros(len(zero), np.int64)
        for reach, step in ((left, -1), (right, 1)):
            going = np.arange(len(zero))
            for k in range(1, WINDOW + 1):
                place = at[going] - k if step < 0 else at[going] + size - 1 + k
                inside = (place >= lo[going]) & (place < hi[going] + width[going])
                going, place = going[inside], place[inside]
                going = going[docs.hash[zero[going] + place] == self.words.hash[base[going] + place]]
                reach[going] = k
        lo, hi = np.maximum(lo, at - left), np.minimum(hi, at + size + right - width)
        out = []
        for k in np.flatnonzero(lo <= hi).tolist():
            i, j, w = int(lo[k]), int(hi[k]), int(width[k])
            ours = docs.between(int(zero[k]) + i, int(zero[k]) + j + w)
            theirs = self.words.between(int(base[k]) + i, int(base[k]) + j + w)
            starts = [(i, j)] if ours == theirs else [(s, s) for s in range(i, j + 1) if ours[s - i : s - i + w] == theirs[s - i : s - i + w]]
            out += [(zero[k] + s, zero[k] + e + w, item[k]) for s, e in starts]
        found = np.array(out, dtype=np.int64).reshape(-1, 3)
        return found[:, 0], found[:, 1], found[:, 2]


def _spans(hit: np.ndarray, docs: Words, rows: int) -> list[list[list[int]]]:
    """[first byte, end) of each text's runs of hit words, counted from the text's start."""
    edge = hit.copy()
    edge[1:] &= ~hit[:-1] | (docs.row[1:] != docs.row[:-1])
    stop = hit.copy()
    stop[:-1] &= ~hit[1:] | (docs.row[1:] != docs.row[:-1])
    out: list[list[list[int]]] = [[] for _ in range(rows)]
    for row, a, b in zip(docs.row[edge].tolist(), docs.a[edge].tolist(), docs.b[stop].tolist(), strict=True):
        out[row].append([a, b])
    return out


def _items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, text, names, n_words): distinct word sequences with the ids that have them."""
    low = F.translate(F.col(f"`{text_col}`"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    clean = F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    named = items.select(F.col(f"`{id_col}`").cast("string").alias("name"), clean.alias("text")).where("name is not null and text <> ''")
    distinct = named.groupBy("text").agg(F.sort_array(F.collect_set("name")).alias("names"))
    return distinct.select(F.sha2("text", 256).alias("item"), "text", "names", F.size(F.split("text", " ")).alias("n_words"))


def _item_shingles(items: DataFrame) -> DataFrame:
    """(item, n_words, at, size, token) of all shingles of the items."""

    def make():
        def fn(part: pa.RecordBatch) -> list:
            w = Words(*text_bytes(part.column(part.schema.get_field_index("__text"))))
            out = []
            for i, j in zip(w.begin[:-1].tolist(), w.begin[1:].tolist(), strict=True):
                one = np.arange(max(1, j - i - SHINGLE + 1))
                size = min(SHINGLE, j - i)
                g = np.zeros(len(one), dtype=_U)
                for k in range(size):
                    g = g * _U(_BASE) + w.hash[i + k : i + k + len(one)]
                out.append(mix(g + _U(size)).view(np.int64).tolist())
            return [out]

        return fn

    tokens = append_columns(items.select("item", "n_words", "text"), "text", [T.StructField("tokens", T.ArrayType(T.LongType()))], make, keep_text=False)
    return tokens.select("item", "n_words", F.least("n_words", F.lit(SHINGLE)).alias("size"), F.posexplode("tokens").alias("at", "token"))


def _counts(docs: DataFrame, text_col: str, shingles: DataFrame, blocks: int) -> DataFrame:
    """(token, size, count): occurrences in all documents of the items' shingles, added up in each task first."""
    spark, found = docs.sparkSession, []
    for k in range(blocks):
        rows = shingles.where(F.col("block") == k).select("size", "token").distinct().toPandas()
        by_size = {int(s): np.sort(g["token"].to_numpy().view(_U)) for s, g in rows.groupby("size")}
        shared = spark.sparkContext.broadcast(by_size)

        def run(batches, shared=shared):
            known = {s: _Known(t) for s, t in shared.value.items()}
            count = {s: np.zeros(len(k.tokens), np.int64) for s, k in known.items()}
            for batch in batches:
                docs = Words(*text_bytes(batch.column(0)))
                for s, k in known.items():
                    token = docs.shingles(s)[1]
                    np.add.at(count[s], np.searchsorted(k.tokens, token[k.of(token)]), 1)
            for s, k in known.items():
                some = np.flatnonzero(count[s])
                yield pa.RecordBatch.from_arrays([pa.array(k.tokens[some].view(np.int64)), pa.array(np.full(len(some), s, np.int32)), pa.array(count[s][some])], names=["token", "size", "seen"])

        found.append(docs.select(F.col(f"`{text_col}`").alias("__text")).mapInArrow(_sliced(run), "token long, size int, seen long"))
    union = found[0]
    for f in found[1:]:
        union = union.union(f)
    return union.groupBy("token", "size").agg(F.sum("seen").alias("seen"))


def _sliced(run):
    def cut(batches):
        yield from run(p for b in batches for p in slices(b, "__text"))
        give_back()

    return cut


def _entries(shingles: DataFrame, counts: DataFrame) -> DataFrame:
    """The index: for every item, its windows' rarest shingles."""
    ranked = shingles.join(counts, ["token", "size"], "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    reach = Window.partitionBy("item").orderBy("at").rowsBetween(0, WINDOW - SHINGLE)
    rarest = ranked.withColumn("best", F.min(F.struct("seen", "token", "at")).over(reach)).where(F.col("at") <= F.greatest(F.lit(0), F.col("n_words") - WINDOW))
    return rarest.groupBy("block", "item", "size", F.col("best.token").alias("token"), F.col("best.at").alias("place")).agg(F.min("at").alias("first"), F.max("at").alias("last"))


def _index(items: DataFrame, entries: DataFrame, block: int) -> Index:
    held = items.where(F.col("block") == block).select("item", "text", "names").collect()
    number = {r["item"]: i for i, r in enumerate(held)}
    rows = sorted((int(r.token) % (1 << 64), r.size, number[r["item"]], r.place, r.first, r.last) for r in entries.where(F.col("block") == block).select("token", "size", "item", "place", F.col("first").alias("first"), F.col("last").alias("last")).collect())
    token = np.array([r[0] for r in rows], dtype=_U)
    rest = np.array([r[1:] for r in rows], dtype=np.int64).reshape(-1, 5)
    return Index(rest[:, 0], token, rest[:, 1], rest[:, 2], rest[:, 3], rest[:, 4], [r.text.encode() + b" " for r in held], [list(r.names) for r in held])


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds ``n_words``, ``n_hit`` (words in any occurrence of a window), ``items`` (ids with occurring windows, sorted as text, each once) and ``spans`` ([first byte, end) of the runs of hit words in the UTF-8 text).

    Words are runs of digits, letters and non-ASCII characters; A-Z count as
    small.  A null text (of a document or an item) has no words; an item without
    words or without an id takes no part; items of the same words are looked for
    once and named all; an id of several texts is named once.  Documents need no
    id: repeated rows and null ids are judged by their own texts.  Texts are read
    whole, in lots of a megabyte and a longer one alone.  Columns named like an
    output (ignoring case) are replaced; empty tables give no rows or no hits.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    made = ["n_words", "n_hit", "items", "spans"]
    body = "__body" if text_col.lower() in made else text_col
    docs = without(docs.withColumnRenamed(text_col, body), made)
    listed = written(_items(items, item_col, item_text), "decontaminate-items")
    total = listed.agg(F.sum(F.length("text") + F.size("names") * 16)).first()[0] or 0
    blocks = max(1, -(-total // BLOCK))
    listed = listed.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    shingles = written(_item_shingles(listed).join(listed.select("item", "block"), "item"), "decontaminate-shingles")
    entries = written(_entries(shingles, _counts(docs, body, shingles, blocks)), "decontaminate-index")
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))]
    for block in range(blocks):
        shared = spark.sparkContext.broadcast(_index(listed, entries, block))
        last = block == blocks - 1
        out = docs
        if block:
            out = written(docs, "decontaminate-block").withColumnsRenamed({"items": "__items", "spans": "__spans"}).drop("n_words", "n_hit")
        docs = append_columns(out, body, fields, _judge(shared, block > 0), keep_text=keep_text or not last)
        docs = docs.drop("__items", "__spans")
    return docs.withColumnRenamed(body, text_col) if body != text_col and keep_text else docs


def _judge(shared, before: bool):
    def make():
        index = shared.value.ready()

        def fn(part: pa.RecordBatch) -> list:
            rows = part.num_rows
            text, offsets = text_bytes(part.column(part.schema.get_field_index("__text")))
            docs = Words(text, offsets)
            begin, end, item = index.search(docs)
            change = np.zeros(len(docs.hash) + 1, dtype=np.int64)
            np.add.at(change, begin, 1)
            np.add.at(change, end, -1)
            hit = np.cumsum(change[:-1]) > 0
            named: list[set] = [set() for _ in range(rows)]
            for row, i in np.unique(np.stack([docs.row[begin], item], axis=1), axis=0).tolist() if len(begin) else []:
                named[row].update(index.names[i])
            if before:
                for row, (names, spans) in enumerate(zip(part.column(part.schema.get_field_index("__items")).to_pylist(), part.column(part.schema.get_field_index("__spans")).to_pylist(), strict=True)):
                    named[row].update(names)
                    for a, b in spans:
                        hit[np.searchsorted(docs.a, offsets[row] + a) : np.searchsorted(docs.b, offsets[row] + b, side="right")] = True
            spans = [[[a - o, b - o] for a, b in s] for s, o in zip(_spans(hit, docs, rows), offsets[:-1].tolist(), strict=True)]
            return [np.diff(docs.begin).tolist(), np.bincount(docs.row[hit], minlength=rows).tolist(), [sorted(n) for n in named], spans]

        return fn

    return make


def contaminated(n_hit: Column) -> Column:
    """Whether a document has any word of a benchmark window."""
    return n_hit > 0
