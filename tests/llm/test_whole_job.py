"""The whole job where a shorter one was done before: long labelled texts, drawn copies, bytes behind fingerprints."""

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from condmon.llm import labelled, mixing, pfp, quality, stages

SF = "/root/testdata/sf0.001"


# Classifiers ---------------------------------------------------------------------


def tables(spark, path, texts, marks):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = docs.drop("doc_id", "text").join(rows, F.lit(True), "right").select(docs.columns)
    spark.createDataFrame([(i, m) for i, m in enumerate(marks)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return docs


def test_long_labelled_texts_are_learnt_from(spark, tmp_path):
    long = [f"clear sentence number {i} about rivers. " * 1200 for i in range(12)]
    short = [f"BUY!!! $$$ {i} ###" for i in range(12)]
    docs = tables(spark, str(tmp_path), long + short, [1] * 12 + [0] * 12)
    assert min(map(len, long)) > 32 << 10
    kept = stages.quality_stage(spark, docs, str(tmp_path)).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == list(range(12))


def test_nothing_goes_where_a_class_is_missing(spark, tmp_path):
    docs = tables(spark, str(tmp_path), ["a good text", "another", "", None], [0, 0, 0, 0])
    assert stages.quality_stage(spark, docs, str(tmp_path)).count() == 4


def test_ids_without_a_text_are_replaced(spark):
    docs = spark.createDataFrame([(i, None if i % 2 else f"text {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 4 // 2) for i in range(80)], "doc_id long, quality int")
    assert labelled.chosen(docs, labels, "quality", F.lit(False), 10).count() == 20


def test_ids_and_labels_that_repeat(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "c"), (2, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, None), (None, 1)], "doc_id long, quality int")
    assert sorted((r.id, r.y, r.t) for r in labelled.chosen(docs, labels, "quality", F.lit(False), 10).collect()) == [(1, 1, "a"), (2, 0, "x")]


def test_fit_on_executors_equals_train(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    sample = labelled.chosen(docs, labels, "quality", F.lit(False), 5000)
    found = {}
    for r in sorted(sample.collect(), key=lambda r: (r.y, r.place, r.id)):
        found.setdefault(r.t, r.y)
    a, b = quality.fit(sample), quality.train(list(found), list(found.values()))
    for n in a.__dataclass_fields__:
        assert np.allclose(getattr(a, n), getattr(b, n), atol=1e-6), n


# Mixing ----------------------------------------------------------------------------


def test_the_stage_meets_its_targets(spark):
    rows = [(i, "large" if i % 3 == 0 else f"small{i % 7}", "en" if i % 5 else "de", "word " * (20 + i % 300)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    tokens = F.sum(mixing.tokens(F.col("text"))).alias("t")
    total = docs.agg(tokens).first().t
    out = stages.mixing_stage(spark, docs, SF)
    assert out.columns == docs.columns
    assert out.agg(tokens).first().t == pytest.approx(stages.SHARE * total, rel=0.03)
    for margin in ("source", "lang"):
        before = {r[0]: r.t / total for r in docs.groupBy(margin).agg(tokens).collect()}
        power = {k: v ** stages.TARGETS[margin] for k, v in before.items()}
        for r in out.groupBy(margin).agg(tokens).collect():
            assert r.t / total == pytest.approx(stages.SHARE * power[r[0]] / sum(power.values()), rel=0.06)


# Dedup -----------------------------------------------------------------------------


def test_strings_are_told_apart_by_bytes():
    """Where every context counts as shared the bytes alone decide."""
    rng = np.random.default_rng(1)
    word = lambda: bytes(rng.integers(97, 123, 45).astype(np.uint8))
    middle, shared = b"0123456789abcdef", word()
    texts = [word() + middle + word() for _ in range(60)]
    texts += [word()[:5] + shared + middle + word(), word()[:9] + shared + middle + word()]
    offsets = np.cumsum([0, *map(len, texts)]).astype("<i8")
    row = {"bid": 0, "n_bytes": int(offsets[-1]), "offsets": offsets.tobytes(), "ids": np.arange(len(texts), dtype="<i8").tobytes(), "blob": zstandard.ZstdCompressor().compress(b"".join(texts))}

    def round_trip(ask, answer):
        asked = sorted((r for b in pfp._asking(ask(1))(iter([pa.RecordBatch.from_pylist([row])])) for r in b.to_pylist()), key=lambda r: r["bucket"])
        assert asked
        return [{"bucket": r["bucket"], "codes": r["codes"]} for b in pfp._answering(answer)(iter([pa.RecordBatch.from_pylist(asked)])) for r in b.to_pylist()]

    row["a1"] = round_trip(pfp._ask_phrases, pfp._first_owners)
    row["a2"] = round_trip(pfp._ask_contexts, lambda entries: [c | 1 for c in pfp._shared_contexts(entries)])
    row["a3"] = round_trip(pfp._ask_strings, pfp._smaller_owners)
    gone = pfp._removed(pfp._Batch(row), row, 1)
    want = np.zeros(len(gone), dtype=bool)
    end = int(offsets[-2]) + 9
    want[end : end + len(shared) + len(middle)] = True  # what the last text has from the one before
    assert (gone == want).all()


#: Texts of 50 bytes around one trigger of 16 whose 48-bit hashes were once equal; only the trigger is common.
COLLIDED = [
    ("byrgblwmwvmyemtdmpxttjqpyjktuaohhaqwwrjfslgbswfnlg", "wmlfxcezmwomfazbzpxttjqpyjktuaohhqhpmwrgexusaozdsi"),
    ("ywpxkybbohxyqsjggpxttjqpyjktuaohhvelewwjdgawlwkfxt", "eoiivvxmzydcuyztmpxttjqpyjktuaohhnzbihjwqbfszgakec"),
    ("mpeoytpndropczguspxttjqpyjktuaohhxfvuctcyffuyjlcix", "tmfttdqsafsyzjjkspxttjqpyjktuaohhyytlrvwubljiwpyiq"),
]


def test_phrases_of_one_trigger_are_told_apart(spark):
    rows = [(2 * k + i, t) for k, pair in enumerate(COLLIDED) for i, t in enumerate(pair)]
    out = pfp.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 6 and all(r.n_removed == 0 for r in out)


def test_phrase_hashes_follow_the_key():
    texts = [b"".join(bytes([97 + (i * k) % 7]) for i in range(200)) for k in range(1, 7)]
    text, offsets = np.frombuffer(b"".join(texts), np.uint8), np.arange(0, 1201, 200)
    one, two = pfp.Phrases(text, offsets, 1), pfp.Phrases(text, offsets, 2)
    assert (one.lo == two.lo).all() and (one.hi == two.hi).all() and not (one.phrase == two.phrase).any()
    for p in (one, two):
        seen = {}
        for k in range(len(p.lo)):
            key = text[p.lo[k] : p.hi[k] + pfp.LENGTH].tobytes(), int(p.at[k] - p.lo[k])
            assert seen.setdefault(key, (int(p.phrase[k]), int(p.check[k]))) == (int(p.phrase[k]), int(p.check[k]))
        assert len(set(seen.values())) == len(seen)
