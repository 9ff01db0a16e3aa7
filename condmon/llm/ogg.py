"""Media columns: Ogg physical bitstreams (RFC 3533) written and read.

Writing puts the bytes of a payload as 8-bit unsigned mono samples into packets
of one logical stream and a short comment into a second one, interleaved page
by page.  Reading verifies every page checksum, reassembles packets from the
lacing values across pages, demultiplexes the logical streams by serial number
and derives timestamps from granule positions.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from condmon.llm.common import append_columns

#: Samples a second of the sample stream; its granule position counts samples.
RATE = 8000
#: Payloads are padded with spaces to a positive multiple of this.
UNIT = 192
#: Samples in one packet.
PACKET = 4096
#: Samples between two comments of the comment stream.
NOTE = 1 << 10
#: Fixed values of the format: capture pattern and header flags.
CAPTURE, CONTINUED, FIRST, LAST = b"OggS", 1, 2, 4
HEADER = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC (polynomial 0x04c11db7, unreflected, from zero), by the reflected CRC of bit-reversed bytes."""
    x = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(serial: int, seq: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, seq, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def paginate(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """Pages of one logical stream; packets are (bytes, granule position at their end).  A page holds 255 lacing values at most and packets run on over pages."""
    segments: list[tuple[int, bytes, int]] = []  # lacing value, bytes, granule where a packet ends or -1
    for body, granule in packets:
        whole = len(body) // 255
        for i in range(whole):
            segments.append((255, body[i * 255 : i * 255 + 255], -1))
        segments.append((len(body) - whole * 255, body[whole * 255 :], granule))
    pages, seq = [], 0
    starts = [0, 1] if len(packets) > 1 and len(segments) > 1 and segments[0][2] >= 0 else [0]  # the first packet has a page of its own
    cuts = starts + [i for i in range(starts[-1] + 255, len(segments), 255)] + [len(segments)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = segments[a:b]
        ends = [g for _, _, g in part if g >= 0]
        flags = (FIRST if a == 0 else 0) | (LAST if b == len(segments) else 0) | (CONTINUED if a and segments[a - 1][2] < 0 else 0)
        pages.append(_page(serial, seq, flags, ends[-1] if ends else -1, bytes(s[0] for s in part), b"".join(s[1] for s in part)))
        seq += 1
    return pages


def write(payload: bytes, comment: bytes = b"text as 8-bit samples") -> bytes:
    """A physical stream of the payload's samples and of comments (one for every NOTE samples begun), page by page in turn; serials follow from the payload, so equal payloads give equal files."""
    serial = zlib.crc32(payload)
    other = (serial + 1) & 0xFFFFFFFF
    packets = [(b"\x01pcm8" + struct.pack("<IBQ", RATE, 1, len(payload)), 0)]
    packets += [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    sound, notes = paginate(packets, serial), paginate([(b"\x03note", 0), *[(comment + b" from %d" % i, i) for i in range(0, max(1, len(payload)), NOTE)]], other)
    pages = [sound[0], notes[0]]
    for i in range(1, max(len(sound), len(notes))):
        pages += [*sound[i : i + 1], *notes[i : i + 1]]
    return b"".join(pages)


@dataclass
class Stream:
    """A logical stream: whole packets with the granule position of the page each ended on (-1: not the last of its page)."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    rest: list[bytes] = field(default_factory=list)
    lost: int = 0


def read(data: bytes) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial, and the number of pages dropped for a bad checksum or cut short.

    After a damaged page reading goes on at the next capture pattern; the
    packet that it tears is dropped and counted in ``lost`` of its stream.
    """
    streams: dict[int, Stream] = {}
    next_seq: dict[int, int] = {}
    at, bad = 0, 0
    while True:
        found = data.find(CAPTURE, at)
        if found < 0 or found + HEADER.size > len(data):
            for s in streams.values():  # packets that never ended
                s.rest, s.lost = [], s.lost + bool(s.rest)
            return streams, bad
        _, version, flags, granule, serial, seq, crc, n = HEADER.unpack_from(data, found)
        body_at = found + HEADER.size + n
        lacing = data[found + HEADER.size : body_at]
        end = body_at + sum(lacing)
        if version or end > len(data) or checksum(data[found : found + 22] + b"\0\0\0\0" + data[found + 26 : end]) != crc:
            bad += 1
            at = found + 4
            continue
        s = streams.setdefault(serial, Stream())
        s.pages += 1
        torn = next_seq.get(serial, 0) != seq
        next_seq[serial] = seq + 1
        skip = bool(flags & CONTINUED) and (torn or not s.rest)
        if s.rest and (torn or not flags & CONTINUED):
            s.rest, s.lost = [], s.lost + 1
        ends = [i for i, x in enumerate(lacing) if x < 255]
        for i, size in enumerate(lacing):
            s.rest.append(data[body_at : body_at + size])
            body_at += size
            if size < 255:
                if skip:
                    skip, s.lost = False, s.lost + 1
                else:
                    s.packets.append(b"".join(s.rest))
                    s.granules.append(granule if i == ends[-1] else -1)
                s.rest = []
        if skip:
            s.rest = []
        s.ended |= bool(flags & LAST)
        at = end


def samples(streams: dict[int, Stream]) -> tuple[bytes, dict]:
    """The bytes of the sample stream, and features of the physical stream."""
    payload, found = b"", {"streams": len(streams), "pages": sum(s.pages for s in streams.values()), "packets": sum(len(s.packets) for s in streams.values()), "ms": 0}
    for s in streams.values():
        if s.packets and s.packets[0].startswith(b"\x01pcm8"):
            rate = struct.unpack_from("<I", s.packets[0], 5)[0]
            payload = b"".join(s.packets[1:])
            found["ms"] = max([0, *s.granules]) * 1000 // rate
    return payload, found


def to_media(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``media`` (binary Ogg file) of each whole text's UTF-8 bytes and ``n_bytes`` (long, unpadded).

    Null and empty texts store one unit of padding.  Equal texts give equal
    files; texts of any length are written page by page.  Input columns named
    like an output (in any case) are replaced; an empty table gives an empty one.
    """
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]

    def make():
        def fn(batch: pa.RecordBatch) -> list:
            sizes, files = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                raw = text.encode("utf-8") if isinstance(text, str) else text or b""
                sizes.append(len(raw))
                files.append(write(raw + b" " * (-len(raw) % UNIT if raw else UNIT)))
            return [sizes, files]

        return fn

    return append_columns(df, text_col, fields, make)


def from_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds what reading the Ogg file gives: ``payload`` (binary), ``streams``, ``pages``, ``packets``, ``duration_ms``, ``bad_pages`` and ``peak`` (largest distance of a sample from 128).

    A null or foreign file gives an empty payload and zero counts; damaged
    pages are left out and counted.  Input columns named like an output (in any
    case) are replaced; an empty table gives an empty one.
    """
    names = ["streams", "pages", "packets", "duration_ms", "bad_pages", "peak"]
    fields = [T.StructField("payload", T.BinaryType())] + [T.StructField(n, T.LongType()) for n in names]

    def make():
        def fn(batch: pa.RecordBatch) -> list:
            out: list[list] = [[] for _ in fields]
            for data in batch.column(batch.num_columns - 1).to_pylist():
                streams, bad = read(data or b"")
                payload, f = samples(streams)
                peak = max(abs(max(payload) - 128), abs(128 - min(payload))) if payload else 0
                for column, x in zip(out, (payload, f["streams"], f["pages"], f["packets"], f["ms"], bad, peak), strict=True):
                    column.append(x)
            return out

        return fn

    return append_columns(df, media_col, fields, make)
