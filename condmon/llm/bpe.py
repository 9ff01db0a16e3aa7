"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary.  A pre-token whose bytes
are a vocabulary entry is resolved with one probe and one comparison.
Tier two: for the misses, a heap of mergeable neighbours over linked bytes;
the lowest rank merges first, the leftmost of equal ranks before the others.

Both tiers sit behind a bounded memo per Python worker: natural text repeats
its pre-tokens, so most of a corpus is one dictionary lookup a pre-token.
Nothing is shuffled; the vocabulary (bounded by its own size, about 1 MB for
50k entries) is broadcast.
"""

from __future__ import annotations

import base64
import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from condmon.llm.common import append_columns

#: Entries of a worker's memo; it starts anew when full.
MEMO_ENTRIES = 200_000
#: The public GPT-2 split in terms of the standard library's classes, which
#: agree with the Unicode ones on the characters that PLAIN lets through.
FAST = re.compile(r" ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
FAST_FOR = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NOT_PLAIN = re.compile("[^\t\n\r -~¡-±´-¸º»¿-ɏ‐-‧₠-₿]")


def read_ranks(path: str) -> list[bytes]:
    """Vocabulary file of base64 token and rank a line; gives the tokens in rank order."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys in n slots, one seed per bucket of about four keys.

    A bucket with a single key left for last takes any free slot, written as a
    negative seed.
    """

    def __init__(self, keys: list[bytes]) -> None:
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 4)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            groups[h % self.buckets].append(i)
        self.seed = [0] * self.buckets
        self.slot_key = [-1] * n
        order = sorted(range(self.buckets), key=lambda b: -len(groups[b]))
        for b in order:
            members = groups[b]
            if len(members) < 2:
                break
            d = 1
            while True:
                places = [self._place(hashes[i], d) for i in members]
                if len(set(places)) == len(places) and all(self.slot_key[p] < 0 for p in places):
                    break
                d += 1
            self.seed[b] = d
            for i, p in zip(members, places, strict=True):
                self.slot_key[p] = i
        free = iter([p for p in range(n) if self.slot_key[p] < 0])
        for b in order:
            if len(groups[b]) == 1:
                p = next(free)
                self.seed[b], self.slot_key[p] = -p - 1, groups[b][0]

    def _place(self, h: int, d: int) -> int:
        x = ((h >> 20) + d * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 29)) % self.n

    def probe(self, key: bytes) -> int:
        """The only key number that ``key`` can have; the caller compares the bytes."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = self.seed[h % self.buckets]
        return self.slot_key[-d - 1 if d < 0 else self._place(h, d)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE of one piece: heap of (rank, start, end) of neighbours, bytes linked through ``end`` and ``before``."""
    n = len(piece)
    get = ranks.get
    end, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapify(heap)
    while heap:
        _, i, e = heappop(heap)
        m = end[i]
        if not m or m >= e or end[m] != e:
            continue  # one of the two has merged meanwhile
        end[i], end[m] = e, 0
        if e < n:
            before[e] = i
            r = get(piece[i : end[e]])
            if r is not None:
                heappush(heap, (r, i, end[e]))
        p = before[i]
        if p >= 0:
            r = get(piece[p:e])
            if r is not None:
                heappush(heap, (r, p, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class _Memo(dict):
    """Pre-token to its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, tokens: list[bytes], table: PerfectHash) -> None:
        super().__init__()
        self.tokens, self.table = tokens, table
        self.ranks = {t: i for i, t in enumerate(tokens)}

    def __missing__(self, word: str) -> bytes:
        key = word.encode("utf-8")
        i = self.table.probe(key)
        ids = [i] if i >= 0 and self.tokens[i] == key else merge(key, self.ranks)
        value = np.array(ids, dtype="<u4").tobytes()
        self[word] = value
        return value


_memos: dict[tuple, _Memo] = {}


def _memo(key: tuple, tokens: list[bytes], table: PerfectHash) -> _Memo:
    if key not in _memos:
        _memos.clear()
        _memos[key] = _Memo(tokens, table)
    return _memos[key]


def _encoder(memo: _Memo, pattern: str):
    """Text to its ids as bytes."""
    slow = regex.compile(pattern)
    fast = FAST if pattern == FAST_FOR else None

    def one(text: str | None) -> bytes:
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        if not text:
            return b""
        find = fast if fast is not None and NOT_PLAIN.search(text) is None else slow
        return b"".join(map(memo.__getitem__, find.findall(text)))

    return one


def _decoder(tokens: list[bytes]):
    get = tokens.__getitem__
    return lambda ids: b"".join(map(get, np.frombuffer(ids or b"", dtype="<u4").tolist()))


IDS, COUNT, DECODED, SAME = T.StructField("token_ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.BinaryType()), T.StructField("round_trip", T.BooleanType())


def encode(df: DataFrame, vocab_path: str, pattern: str, text_col: str = "text", back: str | None = None, keep_text: bool = True) -> DataFrame:
    """Adds ``token_ids`` (binary: little-endian unsigned 32-bit ids) and ``n_tokens`` (long) of each whole text; with ``back`` "bytes" also ``decoded``, the bytes that the ids decode to, with "check" ``round_trip``, whether those are the text's.

    Each match of ``pattern`` is encoded on its own, without special tokens.
    Null and empty texts have no ids; texts of any length are encoded whole.
    Repeated rows give repeated results, an empty table gives an empty one, and
    input columns named like an output (in any case) are replaced.
    """
    tokens = read_ranks(vocab_path)
    shared = df.sparkSession.sparkContext.broadcast((tokens, PerfectHash(tokens)))

    def make():
        one = _encoder(_memo((vocab_path, len(shared.value[0])), *shared.value), pattern)
        undo = _decoder(shared.value[0])

        def fn(batch: pa.RecordBatch) -> list:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            ids = [one(t) for t in texts]
            made = [ids, [len(x) // 4 for x in ids]]
            if back == "bytes":
                made.append([undo(x) for x in ids])
            elif back == "check":
                made.append([undo(x) == (t or "").encode("utf-8") for x, t in zip(ids, texts, strict=True)])
            return made

        return fn

    more = {"bytes": [DECODED], "check": [SAME]}.get(back or "", [])
    return append_columns(df, text_col, [IDS, COUNT, *more], make, keep_text=keep_text)


def decode(df: DataFrame, vocab_path: str, ids_col: str = "token_ids") -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of the tokens in ``ids_col``, joined.  Null ids give no bytes; an id outside the vocabulary raises."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(vocab_path))

    def make():
        undo = _decoder(shared.value)
        return lambda batch: [[undo(x) for x in batch.column(batch.num_columns - 1).to_pylist()]]

    return append_columns(df, ids_col, [DECODED], make)
