"""Ogg files of the operator, read by a plain reader of the test's own: pages front to back, checksums bit by bit."""

import random

import pytest

from condmon.llm import common, ogg


def _table():
    for i in range(256):
        x = i << 24
        for _ in range(8):
            x = (x << 1 ^ 0x04C11DB7 if x >> 31 else x << 1) & 0xFFFFFFFF
        yield x


TABLE = list(_table())


def crc(page):
    x = 0
    for b in page:
        x = (x << 8 & 0xFFFFFFFF) ^ TABLE[x >> 24 ^ b]
    return x


def plain_reader(data):
    """Packets, last granule and pages of each serial, in the order of their first pages."""
    found, at = {}, 0
    while at < len(data):
        assert data[at : at + 5] == b"OggS\0"
        number = lambda a, b: int.from_bytes(data[at + a : at + b], "little")  # noqa: E731, B023
        flags, granule, serial, seq, n = data[at + 5], number(6, 14), number(14, 18), number(18, 22), data[at + 26]
        lacing = data[at + 27 : at + 27 + n]
        body = at + 27 + n
        end = body + sum(lacing)
        assert crc(data[at : at + 22] + bytes(4) + data[at + 26 : end]) == number(22, 26)
        s = found.setdefault(serial, {"packets": [], "granule": 0, "pages": 0, "open": b"", "ended": False, "going": False})
        assert not s["ended"] and seq == s["pages"] and bool(flags & 2) == (seq == 0) and bool(flags & 1) == s["going"]
        for size in lacing:
            s["open"] += data[body : body + size]
            body += size
            s["going"] = size == 255
            if size < 255:
                s["packets"].append(s["open"])
                s["open"] = b""
        if granule != (1 << 64) - 1:
            s["granule"] = granule
        s["pages"], s["ended"], at = s["pages"] + 1, bool(flags & 4), end
    assert all(s["ended"] and not s["going"] for s in found.values())
    return found


@pytest.mark.parametrize("text", [None, "", "a", "é" * 95 + "xx", "x" * 192, "words of it " * 3000, "long " * 60_000])
def test_files_by_a_plain_reader(spark, text):
    rows = spark.createDataFrame([(text, "old", "old")], "text string, Media string, PAYLOAD string")
    made = ogg.to_media(rows)
    back = ogg.from_media(made).first()
    raw = (text or "").encode()
    payload = raw + b" " * (-len(raw) % 192 if raw else 192)
    streams = list(plain_reader(bytes(back.media)).values())
    sound = streams[0]
    assert b"".join(sound["packets"][1:]) == payload == bytes(back.payload) and back.n_bytes == len(raw)
    assert sound["granule"] == len(payload) and sound["packets"][0][:5] == b"\x01pcm8" and int.from_bytes(sound["packets"][0][5:9], "little") == 8000
    assert (back.streams, back.pages, back.packets) == (2, sum(s["pages"] for s in streams), sum(len(s["packets"]) for s in streams))
    assert (back.duration_ms, back.bad_pages, back.peak) == (len(payload) * 1000 // 8000, 0, max(abs(b - 128) for b in payload))
    assert [c.lower() for c in ogg.from_media(made).columns].count("payload") == 1  # a clashing column is replaced


def test_a_changed_byte_is_found_by_both():
    rng = random.Random(6)
    data = bytearray(ogg.write(bytes(rng.randrange(256) for _ in range(9000))))
    assert ogg.read(bytes(data))[1] == 0
    data[len(data) // 2] ^= 1
    assert ogg.read(bytes(data))[1] == 1
    with pytest.raises(AssertionError):
        plain_reader(bytes(data))


@pytest.mark.parametrize("master, known", [("local", True), ("local[4]", True), ("local[2,3]", True), ("local-cluster[2,1,1024]", False), ("spark://h:7077", False)])
def test_folder_of_a_local_master(master, known):
    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            pass

    Session.sparkContext.master = master
    if known:
        assert common.shared_dir(Session).startswith("file://") and "spark.checkpoint.dir" in Session.conf
    else:
        with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
            common.shared_dir(Session)
