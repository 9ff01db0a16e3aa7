"""The queries without SQL, called by name on the small tables: every column of their contracts against plain Python."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from condmon.llm import ogg, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: (r.text or "").encode() for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()}


def rows_of(spark, name, kinds):
    out = queries.QUERIES[name](spark, SF)
    assert dict(out.dtypes) == kinds
    return {r.doc_id: r for r in out.collect()}


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def test_op2(spark, texts):
    got = rows_of(spark, "op2_suffix_dedup", {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"})
    least: dict[bytes, int] = {}
    for i, t in texts.items():
        for k in range(len(t) - 49):
            g = t[k : k + 50]
            least[g] = min(i, least.get(g, i))
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if least[t[k : k + 50]] < i:
                gone[k : k + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(t), int(gone.sum()), spans, sha(kept))


def test_op3(spark, texts):
    got = rows_of(spark, "op3_bpe", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"})
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = known.encode_ordinary(t.decode())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t))


@pytest.mark.parametrize("name, parts, rest", [("op5_toxicity", 5, 0), ("op8_quality", 3, 1)])
def test_classifiers(spark, texts, name, parts, rest):
    got = rows_of(spark, name, {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % parts == rest)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    same: dict[bytes, set] = {}
    for i, t in texts.items():
        same.setdefault(t, set()).add(got[i].score)
    assert all(len(s) == 1 for s in same.values())


def test_op7(spark, texts):
    names = {"n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}
    got = rows_of(spark, "op7_ogg", {"doc_id": "bigint"} | names)
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        payload = t + b" " * (-len(t) % 192 if t else 192)
        media = ogg.write(payload)
        streams, bad = ogg.read(media)
        peak = max(abs(b - 128) for b in payload)
        feature = f"streams=2;pages={sum(s.pages for s in streams.values())};packets={sum(len(s.packets) for s in streams.values())};duration_ms={len(payload) // 8};bad_pages={bad};peak={peak}"
        want = (len(t), len(payload), sha(payload), zlib.crc32(payload[-16:]), len(media), sha(media), feature)
        assert tuple(got[i][n] for n in names) == want


def test_op10(spark, texts):
    got = rows_of(spark, "op10_minhash", {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"})
    sets = {}
    for i, t in texts.items():
        w = regex.findall(rb"[^\x20\x09-\x0D]+", t.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in texts}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), top(i), top(i) == i) for i in texts}


def test_op1_op4_op6_op9_have_sql():
    assert {"op1_topk", "op4_mixing", "op6_sharding", "op9_urls"} <= queries.ORACLES.keys() <= queries.QUERIES.keys()
