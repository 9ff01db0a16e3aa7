"""Suffix-array dedup over a prefix-free parse, distributed.

Task: remove every byte covered by a string of ``LENGTH`` bytes that also
starts in a document with a smaller id.

*Parse.*  A rolling hash runs over all strings of ``TRIGGER`` bytes.  The usual
rule "hash divisible by p" leaves gaps of any length, so the trigger of a
string of ``LENGTH`` bytes is the leftmost one of least hash inside it: equal
strings have equal triggers at equal places, and the triggers cut a text into
phrases.  The phrase of a trigger is the stretch of text covered by all strings
that it is the trigger of; every string of ``LENGTH`` bytes lies in exactly one
phrase, and the set of phrases is the dictionary.

*Order.*  Suffixes are ordered by their phrase first (the parse symbol), then by
the suffix array of the dictionary, both to ``LENGTH`` bytes: more never decides.
A phrase that a smaller document has goes as a whole, which settles nearly all of
a repetitive corpus without looking at bytes.  What is left of the dictionary,
each phrase at its smallest document, is compared through *contexts*: a string
holds its trigger and either HALF bytes before it or as many after it, so two
phrases with a string in common have one of these contexts in common.  Only the
strings of phrases that share a context with another send their bytes; they are
dealt over the cluster, sorted, and each run of equal ones belongs to its
smallest document.

*Scale.*  Texts are packed once into batches of about ``BATCH`` bytes, written
to the shared folder as a table bucketed by batch, and never shuffled again.
All three questions (phrases, contexts, strings) are dealt by a hash of what is
asked, distinct in its batch, so a passage, a trigger or a context in a third of
all documents sends one entry a batch and never gathers its phrases in one task.
Hashes only deal and filter where bytes are to follow, but for phrases: a phrase
is known by 128 bits, two polynomials modulo 2 ** 64 whose bases and byte values
are drawn anew for every call, so that no text can be made to collide.  Two
phrases that differ in how often a byte is in them agree with probability
2 ** -128; permuted ones of the at most 84 bytes with 2 ** -68 at worst.  Long texts are worked on in chunks of ``CHUNK`` strings;
cutting a phrase in two is harmless.
"""

from __future__ import annotations

import secrets
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condmon.llm.common import bounded_batches, give_back, shared_dir, slices, text_bytes, written

LENGTH = 50
TRIGGER = 16
WINDOW = LENGTH - TRIGGER + 1
#: Bytes before or after the trigger that a context has.
HALF = (LENGTH - TRIGGER) // 2
BATCH = 1 << 21
CHUNK = 1 << 20
#: Text bytes whose phrases share a bucket of the dictionary.
BUCKET_TEXT = 8 << 20
NO_ID = np.iinfo(np.int64).max

_U = np.uint64
_C1, _C2, _C3 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xFF51AFD7ED558CCD)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=_U)
    out[1:] = _U(base)
    return np.multiply.accumulate(out)


class _Polynomial:
    """Prefix hashes under a drawn odd base with a drawn value for every byte."""

    def __init__(self, key: int, number: int) -> None:
        rng = np.random.default_rng([key, number])
        self.value = rng.integers(0, 1 << 64, 256, dtype=_U)
        self.base = int(rng.integers(0, 1 << 64, dtype=_U)) & ~7 | 5
        self.power = self.inverse = np.zeros(0, dtype=_U)

    def sums(self, text: np.ndarray) -> np.ndarray:
        n = len(text)
        if len(self.power) < n + 1:
            self.power, self.inverse = _powers(self.base, n + 1), _powers(pow(self.base, -1, 1 << 64), n + 1)
        out = np.zeros(n + 1, dtype=_U)
        np.cumsum(self.value[text] * self.power[:n], out=out[1:])
        return out

    def between(self, sums: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[first]) * self.inverse[first]


_drawn: dict[int, tuple[_Polynomial, _Polynomial]] = {}


def _polynomials(key: int) -> tuple[_Polynomial, _Polynomial]:
    """The two of a key; a process keeps those of the last one."""
    if key not in _drawn:
        _drawn.clear()
        _drawn[key] = (_Polynomial(key, 1), _Polynomial(key, 2))
    return _drawn[key]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x *= _C3
    x ^= x >> _U(29)
    return x


class Phrases:
    """The phrases of a batch: ``at`` place of the trigger, ``lo`` and ``hi`` first and last start of its strings, ``doc`` row of the batch, ``phrase`` and ``check`` two 64-bit hashes under the key, ``context`` (two columns) those of the trigger with HALF bytes after it and with HALF + 1 before it, for phrases that have them."""

    def __init__(self, text: np.ndarray, offsets: np.ndarray, key: int = 0) -> None:
        parts = [self._chunk(text, offsets, key, a, min(a + CHUNK, len(text) - LENGTH + 1)) for a in range(0, max(0, len(text) - LENGTH + 1), CHUNK)]
        none = np.zeros(0, dtype=np.int64)
        self.at, self.lo, self.hi = (np.concatenate([p[i] for p in parts]) if parts else none for i in range(3))
        self.phrase, self.check = (np.concatenate([p[i] for p in parts]) if parts else none.astype(_U) for i in (3, 4))
        self.context = np.concatenate([p[5] for p in parts]) if parts else np.zeros((0, 2), _U)
        self.doc = np.searchsorted(offsets, self.lo, side="right") - 1

    @staticmethod
    def _chunk(text: np.ndarray, offsets: np.ndarray, key: int, a: int, b: int) -> tuple[np.ndarray, ...]:
        part = np.concatenate([text[a : b + LENGTH - 1], np.zeros(8, np.uint8)])
        n = b - a + LENGTH - 1
        words = np.ndarray((n,), dtype="<u8", buffer=part, strides=(1,)).copy()
        grams = n - TRIGGER + 1
        h = words[:grams] * _C1
        h += words[8 : 8 + grams] * _C2
        h = _mix(h)
        m = (h & _U(0xFFFFFFFF00000000)) | np.arange(grams, dtype=_U)
        width = 1
        while width * 2 <= WINDOW:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < WINDOW:
            m = np.minimum(m[: -(WINDOW - width)], m[WINDOW - width :])
        q = (m & _U(0xFFFFFFFF)).astype(np.int64)
        whole = np.ones(b - a, dtype=bool)
        ends = offsets[(offsets > a) & (offsets < b + LENGTH)] - a
        for e in ends.tolist():
            whole[max(0, e - LENGTH + 1) : e] = False
        new = np.ones(b - a, dtype=bool)
        new[1:] = (q[1:] != q[:-1]) | (whole[1:] != whole[:-1])
        starts = np.flatnonzero(new)
        stops = np.append(starts[1:], b - a) - 1
        keep = whole[starts]
        lo, hi = starts[keep], stops[keep]
        at = q[lo]
        first, second = _polynomials(key)
        sums, others = first.sums(part[:n]), second.sums(part[:n])
        shape = ((hi - lo) << 8 | (at - lo)).astype(_U) * _C2
        phrase, check = _mix(first.between(sums, lo, hi + LENGTH) ^ shape), second.between(others, lo, hi + LENGTH) ^ shape
        context = np.empty((len(at), 2), dtype=_U)
        for k, (i, j) in enumerate(((at, at + TRIGGER + HALF), (at - HALF - 1, at + TRIGGER))):
            context[:, k] = _mix(first.between(sums, np.maximum(i, 0), np.minimum(j, n)) + _U(k + 1)) >> _U(16)
        return at + a, lo + a, hi + a, phrase, check, context


def _squeeze(*columns: np.ndarray) -> bytes:
    """Columns as byte planes, compressed; 64-bit hashes of 48 bits give six planes."""
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T) for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in planes))


def _expand(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n = len(raw) // sum(sizes)
    out, at = [], 0
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).reshape(-1).view(kind))
        at += n * size
    return out


def _six(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :6]).view("V6").reshape(-1)


def _eight(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 8), np.uint8)
    out[:, :6] = x.view(np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _bucket(h: np.ndarray, buckets: int, bits: int = 48) -> np.ndarray:
    """Bucket of a hash, by its range."""
    return ((h >> _U(bits - 32)) * _U(buckets)) >> _U(32)


class _Batch:
    """A packed batch, its phrases and the distinct ones in (phrase, check) order."""

    def __init__(self, row: dict, key: int = 0) -> None:
        raw = zstandard.ZstdDecompressor().decompress(row["blob"]) if row["n_bytes"] else b""
        self.text = np.frombuffer(raw, dtype=np.uint8)
        self.offsets = np.frombuffer(row["offsets"], dtype="<i8")
        self.ids = np.frombuffer(row["ids"], dtype="<i8")
        p = self.phrases = Phrases(self.text, self.offsets, key)
        known = np.flatnonzero(self.ids[p.doc] != NO_ID)
        owner = self.ids[p.doc[known]]
        order = np.lexsort((owner, p.check[known], p.phrase[known]))
        self.order = known[order]  # phrases in order
        t, f, owner = p.check[self.order], p.phrase[self.order], owner[order]
        first = np.ones(len(t), dtype=bool)
        first[1:] = (t[1:] != t[:-1]) | (f[1:] != f[:-1])
        self.kind = np.cumsum(first) - 1  # of each phrase in order: number of its distinct phrase
        self.first = self.order[first]
        self.owner = owner[first]
        self.later = owner > self.owner[self.kind] if len(t) else np.zeros(0, bool)
        self.check, self.phrase = t[first], f[first]

    def contexts(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the dictionary's phrases that are here (code 1): number of the distinct phrase, half (0: trigger and what follows, 1: what precedes and trigger) and 48-bit hash of each context."""
        p, kinds = self.phrases, np.flatnonzero(codes == 1)
        which = self.first[kinds]
        found = []
        for half, has in enumerate((p.at[which] - p.hi[which] <= HALF, p.at[which] - p.lo[which] > HALF)):
            some = np.flatnonzero(has)
            found.append((kinds[some], np.full(len(some), half), p.context[which[some], half]))
        return tuple(np.concatenate([f[i] for f in found]) for i in range(3))

    def strings(self, kind: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All strings of these halves of distinct phrases: number of the distinct phrase, and start."""
        p, which = self.phrases, self.first[kind]
        least = np.where(half == 0, np.maximum(p.lo[which], p.at[which] - HALF), p.lo[which])
        most = np.where(half == 0, p.hi[which], np.minimum(p.hi[which], p.at[which] - HALF - 1))
        counts = most - least + 1
        entry = np.repeat(np.arange(len(which)), counts)
        return kind[entry], np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + least[entry]

    def bytes_at(self, start: np.ndarray) -> np.ndarray:
        """The strings that start there, as fixed LENGTH bytes."""
        if not len(start):
            return np.zeros(0, f"V{LENGTH}")
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.text, LENGTH)[start]).view(f"V{LENGTH}").reshape(-1)


def _runs(keys: np.ndarray, buckets: int, bits: int = 48) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of hashes whose buckets are in order."""
    if not len(keys):
        return []
    b = _bucket(keys, buckets, bits)
    cuts = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    return [(int(b[i]), int(i), int(j)) for i, j in zip(cuts, np.append(cuts[1:], len(b)), strict=True)]


def _codes(answers: list[dict] | None, kind: str = "u1") -> np.ndarray:
    """Answers of all buckets on end."""
    parts = [np.frombuffer(zstandard.ZstdDecompressor().decompress(a["codes"]), dtype=kind) for a in sorted(answers or [], key=lambda a: a["bucket"])]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _words(strings: np.ndarray) -> np.ndarray:
    """Strings as rows of big-endian 64-bit words, whose order is that of the bytes."""
    rows = np.zeros((len(strings), LENGTH + -LENGTH % 8), np.uint8)
    rows[:, :LENGTH] = strings.view(np.uint8).reshape(len(strings), LENGTH)
    return rows.view(">u8").astype(_U)


def _in_order(strings: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order of strings, equal ones by owner; firsts of equal ones in that order; and the number of each entry's distinct string."""
    words = _words(strings)
    order = np.lexsort((owner, *[words[:, i] for i in range(words.shape[1] - 1, -1, -1)]))
    w = words[order]
    first = np.ones(len(w), dtype=bool)
    first[1:] = (w[1:] != w[:-1]).any(axis=1)
    number = np.empty(len(w), dtype=np.int64)
    number[order] = np.cumsum(first) - 1
    return order, first, number


class _Open:
    """The strings of a batch that other phrases may have too: ``kind``, ``start`` and ``number`` of each, and the distinct ones (``string``, ``owner``, ``hash``), bucket by bucket in suffix order."""

    def __init__(self, b: _Batch, phrase_codes: np.ndarray, context_codes: np.ndarray, buckets: int) -> None:
        kind, half, hashes = b.contexts(phrase_codes)
        shared = context_codes[np.unique(hashes, return_inverse=True)[1]] == 1 if len(hashes) else np.zeros(0, bool)
        self.kind, self.start = b.strings(kind[shared], half[shared])
        strings = b.bytes_at(self.start)
        order, first, number = _in_order(strings, b.owner[self.kind])
        some = order[first]
        h = np.zeros(len(some), dtype=_U)
        for word in _words(strings[some]).T:
            h = _mix(h * _C2 + word * _C1)
        h >>= _U(16)
        dealt = np.argsort(_bucket(h, buckets), kind="stable")
        self.string, self.owner, self.hash = strings[some][dealt], b.owner[self.kind[some]][dealt], h[dealt]
        place = np.empty(len(dealt), dtype=np.int64)
        place[dealt] = np.arange(len(dealt))
        self.number = place[number]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _rows(rows: Iterator[tuple], names: list[str], kinds: list, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of about ``size`` bytes."""
    held: list[tuple] = []
    n = 0
    for row in rows:
        held.append(row)
        n += sum(len(x) for x in row if isinstance(x, bytes))
        if n > size or len(held) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], type=k) for i, k in enumerate(kinds)], names=names)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], type=k) for i, k in enumerate(kinds)], names=names)
    give_back()


def _pack(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            seq = 0
            base = TaskContext.get().partitionId() << 33
            for batch in batches:
                for part in slices(batch, "__text", BATCH):
                    text, offsets = text_bytes(part.column(part.num_columns - 1))
                    ids = part.column(part.num_columns - 2).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8")
                    rest = pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))], names=keep) if keep else None
                    sink = pa.BufferOutputStream()
                    if rest is not None:
                        with pa.ipc.new_stream(sink, rest.schema) as w:
                            w.write_batch(rest)
                    z = zstandard.ZstdCompressor(level=3)
                    yield base + seq, len(text), ids.tobytes(), offsets.astype("<i8").tobytes(), z.compress(sink.getvalue().to_pybytes()), z.compress(text.tobytes())
                    seq += 1

        return _rows(rows(), ["bid", "n_bytes", "ids", "offsets", "rest", "blob"], [pa.int64(), pa.int64()] + [pa.binary()] * 4)

    return run


def _asking(ask):
    """mapInArrow function from batches to (bucket, bid, entries)."""

    def run(batches):
        def rows():
            for row in _batches(batches):
                for bucket, entries in ask(row):
                    yield bucket, row["bid"], entries

        return _rows(rows(), ["bucket", "bid", "entries"], [pa.int64(), pa.int64(), pa.binary()])

    return run


def _answering(answer):
    """mapInArrow function over (bucket, bid, entries) in bucket order: ``answer(list of entries)`` gives an array for each, with a code an entry."""

    def run(batches):
        def rows():
            now, held = None, []
            for batch in batches:
                for bucket, bid, entries in zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("bucket", "bid", "entries")], strict=True):
                    if bucket != now and held:
                        yield from done(now, held)
                        held = []
                    now = bucket
                    held.append((bid, entries))
            if held:
                yield from done(now, held)

        def done(bucket, held):
            for (bid, _), codes in zip(held, answer([e for _, e in held]), strict=True):
                yield bid, bucket, zstandard.ZstdCompressor(level=3).compress(codes.tobytes())

        return _rows(rows(), ["bid", "bucket", "codes"], [pa.int64(), pa.int64(), pa.binary()])

    return run


def _parted(values: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1])


def _ask_phrases(buckets: int, key: int = 0):
    def ask(row):
        b = _Batch(row, key)
        for k, i, j in _runs(b.phrase, buckets, 64):
            yield k, _squeeze(b.phrase[i:j], b.check[i:j], b.owner[i:j])

    return ask


def _first_owners(entries: list[bytes]) -> list[np.ndarray]:
    """1: the phrase joins the dictionary here; 2: a smaller document has it."""
    parts = [_expand(e, "<u8", "<u8", "<i8") for e in entries]
    phrase, check, owner = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((owner, check, phrase))
    f, t, o = phrase[order], check[order], owner[order]
    first = np.append(True, (f[1:] != f[:-1]) | (t[1:] != t[:-1]))
    code = np.empty(len(o), dtype=np.uint8)
    code[order] = np.where(o > o[first][np.cumsum(first) - 1], 2, 1)
    return _parted(code, [len(p[2]) for p in parts])


def _ask_contexts(buckets: int, key: int = 0):
    def ask(row):
        b = _Batch(row, key)
        kind, _, hashes = b.contexts(_codes(row["a1"]))
        owner = b.owner[kind]
        order = np.lexsort((owner, hashes))
        h, o = hashes[order], owner[order]
        starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        h, least, most = h[starts], o[starts], o[np.append(starts[1:], len(o)) - 1] if len(starts) else o
        for k, i, j in _runs(h, buckets):
            yield k, _squeeze(_six(h[i:j]), least[i:j], most[i:j] - least[i:j])

    return ask


def _shared_contexts(entries: list[bytes]) -> list[np.ndarray]:
    """1: phrases of several documents have the context."""
    parts = [_expand(e, "V6", "<i8", "<i8") for e in entries]
    h, least = _eight(np.concatenate([p[0] for p in parts])), np.concatenate([p[1] for p in parts])
    most = least + np.concatenate([p[2] for p in parts])
    order = np.argsort(h, kind="stable")
    starts = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
    several = np.minimum.reduceat(least[order], starts) < np.maximum.reduceat(most[order], starts)
    code = np.empty(len(h), dtype=np.uint8)
    code[order] = np.repeat(several, np.diff(np.append(starts, len(h))))
    return _parted(code, [len(p[0]) for p in parts])


def _ask_strings(buckets: int, key: int = 0):
    def ask(row):
        if row["a2"]:
            o = _Open(_Batch(row, key), _codes(row["a1"]), _codes(row["a2"]), buckets)
            for k, i, j in _runs(o.hash, buckets):
                head = _squeeze(o.owner[i:j])
                yield k, len(head).to_bytes(4, "little") + head + zstandard.ZstdCompressor(level=3).compress(o.string[i:j].tobytes())

    return ask


def _smaller_owners(entries: list[bytes]) -> list[np.ndarray]:
    """1: a smaller document has the string, by its bytes."""
    cut = [4 + int.from_bytes(e[:4], "little") for e in entries]
    owners = [_expand(e[4:n], "<i8")[0] for e, n in zip(entries, cut, strict=True)]
    strings = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(e[n:]), dtype=f"V{LENGTH}") for e, n in zip(entries, cut, strict=True)])
    owner = np.concatenate(owners)
    order, first, number = _in_order(strings, owner)
    return _parted((owner > owner[order][first][number]).astype(np.uint8), [len(o) for o in owners])


def _removed(b: _Batch, row: dict, buckets: int) -> np.ndarray:
    """Which bytes of the batch go."""
    p, n = b.phrases, len(b.text)
    change = np.zeros(n + LENGTH + 1, dtype=np.int32)
    codes = _codes(row["a1"])
    if len(codes):
        gone = b.order[b.later | (codes[b.kind] == 2)]
        np.add.at(change, p.lo[gone], 1)
        np.add.at(change, p.hi[gone] + LENGTH, -1)
    if row["a3"]:
        o = _Open(b, codes, _codes(row["a2"]), buckets)
        # a string's answer is its least owner's; those that share it in the batch with a larger owner go too
        hit = np.flatnonzero((_codes(row["a3"])[o.number] == 1) | (b.owner[o.kind] > o.owner[o.number]))
        kind, step = o.kind[hit], o.start[hit] - p.at[b.first[o.kind[hit]]]
        # every phrase of that kind in the owner's own document shares the fate of the first one
        of, place = b.kind[~b.later], b.order[~b.later]
        begin = np.searchsorted(of, kind, side="left")
        many = np.searchsorted(of, kind, side="right") - begin
        which = np.repeat(begin, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        starts = p.at[place[which]] + np.repeat(step, many)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + LENGTH, -1)
    return np.cumsum(change[:n]) > 0


def _finish(names: list[str], as_text: bool, buckets: int, key: int):
    def run(batches):
        for row in _batches(batches):
            b = _Batch(row, key)
            gone = _removed(b, row, buckets)
            kept, removed, spans = [], [], []
            for i, j in zip(b.offsets[:-1].tolist(), b.offsets[1:].tolist(), strict=True):
                g = gone[i:j]
                n = int(g.sum())
                removed.append(n)
                if not n:
                    kept.append(b.text[i:j].tobytes())
                    spans.append([])
                    continue
                kept.append(b.text[i:j][~g].tobytes())
                edge = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(np.int8), [0]])))
                spans.append(edge.reshape(-1, 2).tolist())
            rest = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(row["rest"])).read_next_batch() if names else None
            columns = [rest.column(i) for i in range(len(names))] if names else []
            if as_text:
                columns.append(pa.array([k.decode("utf-8", "ignore") for k in kept], type=pa.string()))
            columns += [pa.array(np.diff(b.offsets), type=pa.int64()), pa.array(kept, type=pa.binary()), pa.array(removed, type=pa.int64()), pa.array(spans, type=pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *(["text"] if as_text else []), "n_bytes", "kept", "n_removed", "spans"])
        give_back()

    return run


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """The input's columns without the text, and ``n_bytes``, ``kept`` (binary), ``n_removed`` and ``spans`` ([start, end) byte pairs, maximal).

    Null and empty texts, and texts under ``LENGTH`` bytes, stay as they are;
    texts of any length are judged whole.
    A row with a null id takes no part and stays whole.  Rows that share an id
    do not remove each other's bytes.  Repeats within one document stay.
    Columns named like an output are replaced; an empty table gives an empty
    one.  With ``as_text`` there is also ``text``: what is kept, without the
    bytes of characters that were cut in two.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    new = {"n_bytes", "kept", "n_removed", "spans"} | ({"text"} if as_text else set())
    keep = [c for c in df.columns if c != text_col and c.lower() not in new]
    deal = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    name = f"condmon_pfp_{uuid.uuid4().hex}"
    packed = source.mapInArrow(_pack(keep), "bid long, n_bytes long, ids binary, offsets binary, rest binary, blob binary")
    packed.repartition(deal, "bid").write.bucketBy(deal, "bid").option("path", f"{shared_dir(spark)}/condmon/{name}").option("compression", "none").saveAsTable(name)
    table = spark.table(name)
    total = table.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_TEXT))
    key = secrets.randbits(128)

    def answers(rows: DataFrame, ask, answer, column: str) -> DataFrame:
        asked = rows.mapInArrow(_asking(ask(buckets, key)), "bucket long, bid long, entries binary")
        found = asked.repartition(deal, "bucket").sortWithinPartitions("bucket").mapInArrow(_answering(answer), "bid long, bucket long, codes binary")
        return written(found, f"pfp-{column}").groupBy("bid").agg(F.collect_list(F.struct("bucket", "codes")).alias(column)).hint("shuffle_hash")

    text = table.drop("rest")
    a1 = answers(text, _ask_phrases, _first_owners, "a1")
    a2 = answers(text.join(a1, "bid", "left"), _ask_contexts, _shared_contexts, "a2")
    a3 = answers(text.join(a1, "bid", "left").join(a2, "bid", "left"), _ask_strings, _smaller_owners, "a3")
    whole = table.join(a1, "bid", "left").join(a2, "bid", "left").join(a3, "bid", "left")
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("text", T.StringType())] * as_text + [T.StructField("n_bytes", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))])
    return whole.mapInArrow(_finish(keep, as_text, buckets, key), schema)
