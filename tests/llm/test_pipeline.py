"""The corpus pipeline on the small tables: every stage's decisions take effect."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F
from test_llm_operators import components_by_hand, dedup_by_hand, tokenizer

from condmon.llm import labelled, quality, queries, stages
from condmon.llm.common import text_bytes

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in stages.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], SF).cache())
        assert kept[-1].columns == docs.columns
    n = [k.count() for k in kept]
    assert n[0] > n[1] >= n[2] == n[3] and n[4] > 0  # the mixing stage drops rows and repeats others
    # near copies: no two documents left share three quarters of their shingles
    sets = []
    for r in kept[2].collect():
        w = regex.findall(r"\S+", r.text.lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    assert all(100 * len(a & b) < 75 * len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a and b)
    # repeats: no string of 50 bytes left whole in two documents that the stage before had in a smaller one
    seen = {}
    for r in kept[2].orderBy("doc_id").collect():
        raw = r.text.encode()
        for g in {raw[i : i + 50] for i in range(len(raw) - 49)}:
            seen.setdefault(g, r.doc_id)
    shorter = kept[2].select("doc_id", F.col("text").alias("before")).join(kept[3], "doc_id").where("length(text) < length(before)")
    doubled = {d for d in (r.doc_id for r in kept[2].collect())} & {r.doc_id for r in shorter.collect()}
    assert shorter.count() == len(doubled)
    last = stages.STAGES[-1][1](spark, kept[-1], SF)
    assert last.where("not round_trip").count() == 0 and last.count() == n[4]
    rejected = kept[0].join(kept[1], "doc_id", "left_anti").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    assert rejected.where("quality = 1").count() <= 0.1 * max(1, rejected.count())


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in stages.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs


@pytest.mark.parametrize("name", ["op6_sharding", "op9_urls", "op4_mixing", "op1_topk"])
def test_queries_have_sql(name):
    assert name in queries.QUERIES and name in queries.ORACLES


def mixed_by_hand(rows, targets, share, seed, rounds=20):
    """(doc_id, copies) by iterative proportional fitting in plain Python."""

    def topic(t):
        n = len(t.encode())
        return "list" if " | " in t else "brief" if n < 1000 else "article" if n < 6000 else "long"

    keyed = [(r.doc_id, {"source": r.source, "lang": r.lang, "topic": topic(r.text or "")}, -(-len((r.text or "").encode()) // 4)) for r in rows]
    cells = {}
    for _, k, n in keyed:
        if n:
            cells[tuple(k.values())] = cells.get(tuple(k.values()), 0) + n
    total = sum(cells.values())
    w = {c: t / total for c, t in cells.items()}
    for _ in range(rounds):
        for at, m in enumerate(("source", "lang", "topic")):
            sums, tokens = {}, {}
            for c in cells:
                sums[c[at]] = sums.get(c[at], 0) + w[c]
                tokens[c[at]] = tokens.get(c[at], 0) + cells[c]
            power = {v: (t / total) ** targets[m] for v, t in tokens.items()}
            for c in cells:
                w[c] *= power[c[at]] / sum(power.values()) / sums[c[at]]
    out = []
    for i, k, n in keyed:
        rate = share * w[tuple(k.values())] * total / cells[tuple(k.values())] if n else share
        u = int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:8], 16) / 2**32
        out.append((i, int(rate) + (u < rate - int(rate))))
    return out


def test_stages_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(stages.STAGES)
    texts = lambda d: {r.doc_id: r.text or "" for r in d.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(labelled.chosen(docs, labels, "quality", F.lit(False), stages.FIT_ROWS))
    one = lambda t: quality._raw(model, *quality.describe(*text_bytes(pa.array([t]))))[0][0]
    good = steps["quality classifier"](spark, docs, SF).cache()
    assert texts(good) == {i: t for i, t in texts(docs).items() if one(t) >= 0}
    single = steps["MinHash near-dedup"](spark, good, SF).cache()
    before = texts(good)
    assert texts(single) == {i: before[i] for i, _, c in components_by_hand(list(before.items())) if i == c}
    cut = steps["suffix-array dedup"](spark, single, SF).cache()
    by_id = sorted(texts(single).items())
    kept = dedup_by_hand([(i, t.encode()) for i, t in by_id])
    assert texts(cut) == {i: kept[n][0].decode("utf-8", "ignore") for n, (i, _) in enumerate(by_id)}
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    mixed = steps["mixing sources to target weights"](spark, cut, SF).cache()
    want = [i for i, n in mixed_by_hand(cut.collect(), stages.TARGETS, stages.SHARE, stages.SEED) for _ in range(n)]
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(want)
    known, left = tokenizer(), texts(cut)
    coded = steps["byte-level BPE encoding and decoding"](spark, mixed, SF).collect()
    assert len(coded) == len(want)
    for r in coded:
        ids = known.encode_ordinary(left[r.doc_id])
        assert np.frombuffer(r.token_ids, "<u4").tolist() == ids and r.n_tokens == len(ids) and r.round_trip
