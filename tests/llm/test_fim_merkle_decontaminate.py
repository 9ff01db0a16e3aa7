"""Fill-in-the-middle, Merkle manifest and decontamination against plain Python, and their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from condmon.llm import decontaminate, fim, merkle, queries
from condmon.llm.common import text_bytes

SF = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


# 11 ------------------------------------------------------------------------------


def fim_by_hand(i, text, units=r"[^\n]*\n|[^\n]+"):
    h = [int(sha(f"7:{'' if i is None else i}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    u = re.findall(units, text)
    n = len(u)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_op11(spark, documents):
    got = {r.doc_id: r for r in queries.op11_fim(spark, SF).collect()}
    assert len(got) == len(documents)
    for d in documents:
        n, form, a, b, out = fim_by_hand(d.doc_id, d.text or "")
        r = got[d.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, a, b, sha(out), sha(d.text or ""))


ODD = [None, "", "\n", "\n\n", "a", "a\n", "\na", "x<S>y\nz", "<M", "a<\n<P\nq", "𝔘ñ\né\r\n中文\n", "퟿\n\U0010ffff", "no end", "long\n" * 200_000, "é" * 1_000_000]


def test_fim_edges(spark):
    rows = [(i, t, "clash", k) for k, (i, t) in enumerate([*enumerate(ODD), (None, "a\nb\nc\n"), (None, "a\nb\nc\n"), (3, "a\nb\nc\n"), (3, "a\nb\nc\n")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, Output string, extra int")
    out = fim.transform(df)
    assert out.columns == ["doc_id", "extra", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = {r.extra: r for r in out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()}
    assert len(back) == len(rows)
    for i, t, _, k in rows:
        assert (back[k].n, back[k].form, back[k].prefix_chars, back[k].middle_chars, back[k].output) == fim_by_hand(i, t or "")
        assert back[k].back == (t or "")
    assert fim.transform(df.limit(0)).count() == 0
    named = fim.transform(spark.createDataFrame([(1, "a\nb")], "form long, output string"), id_col="form", text_col="output")
    assert named.columns == ["n", "form", "prefix_chars", "middle_chars", "output"] and named.count() == 1


def test_fim_units_rates_and_bytes(spark):
    s = fim.Settings(units="words", rate=60, spm=0, seed=3)
    texts = [(i, f" two  words {i}\tand more ") for i in range(300)]
    out = fim.transform(spark.createDataFrame(texts, "doc_id long, text string"), s).withColumn("back", fim.restored(F.col("output"), F.col("form"), s)).collect()
    assert all(r.back == dict(texts)[r.doc_id] for r in out) and {r.form for r in out} == {"plain", "psm"}
    assert 100 < sum(r.form == "psm" for r in out) < 250 and {r.n for r in out} == {6}
    n, a, b, c, na, nb = fim.pieces(b"ab\xff\ncd", "chars", 3, 5)
    assert (n, a, b, c, na, nb) == (6, b"ab\xff", b"\nc", b"d", 3, 2)
    broken = spark.range(1).select("id", F.expr("cast(X'61FF0A62' as string)").alias("text"))
    kept = fim.transform(broken, id_col="id").select(F.hex(fim.restored(F.col("output"), F.col("form"))).alias("h")).first().h
    assert kept == "61FF0A62"
    with pytest.raises(ValueError):
        fim.Settings(prefix="<<P>")
    with pytest.raises(ValueError):
        fim.Settings(units="pages")


# 12 ------------------------------------------------------------------------------


def run_up(x, fanout=3):
    """Levels of a tree, leaves first."""
    out = [x]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def path(levels, at, own, fanout=3):
    """Siblings on the way up, and the digest that ``own`` leads to."""
    held = ""
    for tier in levels[:-1]:
        first = at - at % fanout
        run = tier[first : first + fanout]
        k = at - first
        held += "".join(run[:k] + run[k + 1 :])
        own = sha("".join([*run[:k], own, *run[k + 1 :]]))
        at //= fanout
    return held, own


def merkle_by_hand(leaves, shown=None, fanout=3):
    """key -> (subroot, root, siblings, folded) of (key, group, order, leaf) rows."""
    shown, by = shown or {}, {}
    for key, group, order, leaf in leaves:
        by.setdefault(group, []).append(((order is not None, order or 0), leaf, key))
    groups = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: run_up([leaf for _, leaf, _ in sorted(by[g])], fanout) for g in groups}
    top = run_up([trees[g][-1][0] for g in groups], fanout)
    out = {}
    for n, g in enumerate(groups):
        for at, (_, leaf, key) in enumerate(sorted(by[g])):
            low, own = path(trees[g], at, shown.get(key, leaf), fanout)
            high, own = path(top, n, own, fanout)
            out[key] = (trees[g][-1][0], top[-1][0], low + high, own)
    return out


def test_op12(spark, documents):
    def leaf(d, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d.doc_id, d.source, d.lang, d.n_chars, text)))

    leaves = [(d.doc_id, d.source, d.doc_id, leaf(d, d.text)) for d in documents]
    shown = {d.doc_id: leaf(d, d.text.replace("\n", "")) for d in documents if d.text is not None and zlib.crc32(str(d.doc_id).encode()) % 2 == 0}
    want = merkle_by_hand(leaves, shown)
    got = queries.op12_merkle(spark, SF).collect()
    assert len(got) == len(documents) and {r.verified for r in got} == {True, False}
    for r in got:
        sub, root, held, own = want[r.doc_id]
        assert (r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) == (sub, root, sha(held), own, own == root)


@pytest.mark.parametrize("fanout, levels, groups", [(3, 1, 5), (3, 2, 1), (2, 3, 40), (5, 7, 3)])
def test_manifest_over_rounds(spark, monkeypatch, fanout, levels, groups):
    monkeypatch.setattr(merkle, "LOT", 50)
    rng = random.Random(fanout)
    leaves = [(k, rng.choice(["", None, "/1", "é", *map(str, range(groups))]) if k % 3 else "hot", rng.choice([None, *range(300)]), sha(str(k % 290))) for k in range(300)]
    df = spark.createDataFrame(leaves, "key long, source string, doc_id long, leaf string").withColumn("Proof", F.lit("clash"))
    got = merkle.manifest(df, "leaf", fanout=fanout, levels=levels).withColumn("own", merkle.folded(F.col("leaf"), F.col("proof"))).withColumn("held", merkle.siblings(F.col("proof"))).collect()
    want = merkle_by_hand(leaves, fanout=fanout)
    assert len(got) == 300
    # rows that tie whole may change places, so their proofs are compared as a set
    tied = lambda rows: sorted((g or "~", str(o), leaf, *rest) for g, o, leaf, *rest in rows)
    assert tied((r.source, r.doc_id, r.leaf, r.subroot, r.root, r.held, r.own) for r in got) == tied((g, o, leaf, *want[k]) for k, g, o, leaf in leaves)


def test_manifest_edges(spark):
    one = spark.createDataFrame([(None, None, sha("x"))], "doc_id long, source string, leaf string")
    r = merkle.manifest(one, "leaf").first()
    assert (r.doc_id, r.subroot, r.root, r.proof) == (None, sha("x"), sha("x"), [])
    assert merkle.manifest(one.limit(0), "leaf").count() == 0
    big = (1 << 60) + 1
    r = merkle.manifest(spark.createDataFrame([(big, "a", sha("x")), (None, "a", sha("y"))], "doc_id long, source string, leaf string"), "leaf").where("doc_id is not null").first()
    assert r.doc_id == big and r.proof == [sha("y") + "_"]
    with pytest.raises(Exception, match="digest"):
        merkle.manifest(one.withColumn("leaf", F.lit(None).cast("string")), "leaf").count()
    long = spark.createDataFrame([(1, "x" * 3_000_000)], "doc_id long, text string").select(merkle.leaf(F.col("doc_id"), F.col("text"), F.lit(None)).alias("h")).first().h
    assert long == sha("1:1" + "7:".replace("7", "3000000") + "x" * 3_000_000 + "-")


# 13 ------------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return WORD.findall(low)


def leaks_by_hand(docs, items):
    """row -> (n_words, n_hit, names) of (row, text) and (name, text)."""
    windows: dict[tuple, set] = {}
    for name, text in items:
        w = words_of(text)
        for s in range(max(1, len(w) - 9) if w and name is not None else 0):
            windows.setdefault(tuple(w[s : s + 10]), set()).add(str(name))
    widths = {len(w) for w in windows}
    out = {}
    for row, text in docs:
        w, hit, names = words_of(text), set(), set()
        for k in widths:
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in windows:
                    hit.update(range(s, s + k))
                    names |= windows[tuple(w[s : s + k])]
        out[row] = (len(w), len(hit), sorted(names))
    return out


def test_op13(spark, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = leaks_by_hand([(d.doc_id, d.text) for d in documents], items)
    got = queries.op13_decontaminate(spark, SF).collect()
    assert len(got) == len(documents) and any(r.contaminated for r in got)
    for r in got:
        n, hit, names = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(names), sha(",".join(names)), hit > 0)


@pytest.mark.parametrize("block", [decontaminate.BLOCK, 300])
def test_decontaminate_edges(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    rng = random.Random(5)
    vocabulary = ["the", "of", "THE", "é1", "中文", "ß", "a", "x9"]
    phrase = lambda n: rng.choice([" ", ", ", "\n", "--", "\x00"]).join(rng.choices(vocabulary, k=n))
    items = [(k, phrase(rng.choice([4, 7, 9, 10, 11, 14, 40]))) for k in range(40)] + [(100, "rare"), (101, "the of"), (7, "another text of seven"), (102, None), (103, " .,"), (None, "unnamed item"), (104, "Rare"), (105, "a b c d e f g h i j")]
    texts = [None, "", " ...", "rare", "a b c d e f g h i", "a b c d e f g h i j", "A-b c.d e f g h i j k", "x" * 50_000, "rare " * 30_000]
    texts += [phrase(rng.choice([3, 12, 60, 300])) + " " + rng.choice(items)[1] + " " + phrase(3) if k % 2 else phrase(80) for k in range(60) for _ in (0,) if True] if all(t for _, t in items[:40]) else []
    texts = [t for t in texts if t is None or "None" not in t] + ["rare", "rare"]
    rows = [(None if k % 5 == 0 else k % 7, t, k, "clash") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, Items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.decontaminate(df, bench)
    assert out.columns == ["doc_id", "text", "row", "n_words", "n_hit", "items", "spans"]
    got = {r.row: r for r in out.collect()}
    want = leaks_by_hand([(r[2], r[1]) for r in rows], items)
    assert {k: (r.n_words, r.n_hit, r["items"]) for k, r in got.items()} == want
    for r in got.values():
        raw = (r.text or "").encode()
        assert sum(len(words_of(raw[a:b].decode())) for a, b in r.spans) == r.n_hit
        assert all(x[1] < y[0] for x, y in zip(r.spans, r.spans[1:], strict=False))
    assert decontaminate.decontaminate(df.limit(0), bench).count() == 0
    assert decontaminate.decontaminate(df, bench.limit(0)).where("n_hit > 0 or size(items) > 0").count() == 0


def test_windows_that_collide_are_told_apart_by_bytes(monkeypatch):
    """With hashes of two bits nearly everything is a candidate; the bytes decide."""
    whole = decontaminate.words

    def weak(text, offsets):
        h, row, a, b = whole(text, offsets)
        return h & np.uint64(1), row, a, b

    monkeypatch.setattr(decontaminate, "words", weak)
    rng = random.Random(1)
    texts = [" ".join(rng.choices("abcd", k=rng.choice([5, 12, 30]))) for _ in range(40)]
    items = [" ".join(rng.choices("abcd", k=k)) for k in (3, 5, 10, 12)]
    raw = [t.encode() + b" " for t in items]
    w = decontaminate.Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    rows = []
    for i, (a, b) in enumerate(zip(w.begin[:-1], w.begin[1:], strict=True)):
        size = min(5, b - a)
        at, token = w.shingles(int(size))
        for s in range(max(1, b - a - 9)):
            rows.append((int(token[at == a + s][0]), int(size), i, s, s, s))
    rows.sort()
    token, rest = np.array([r[0] for r in rows], np.uint64), np.array([r[1:] for r in rows], np.int64)
    index = decontaminate.Index(rest[:, 0], token, *(rest[:, k] for k in range(1, 5)), raw, [[str(i)] for i in range(4)]).ready()
    docs = decontaminate.Words(*text_bytes(pa.array(texts)))
    begin, end, item = index.search(docs)
    hits = {(int(docs.row[i]), int(i - docs.begin[docs.row[i]]) + k, int(t)) for i, j, t in zip(begin, end, item, strict=True) for k in range(j - i)}
    want = set()
    for row, t in enumerate(texts):
        for i, item_text in enumerate(items):
            v, u = t.split(), item_text.split()
            k = min(10, len(u))
            for s in range(max(1, len(u) - 9)):
                want |= {(row, p + q, i) for p in range(len(v) - k + 1) if v[p : p + k] == u[s : s + k] for q in range(k)}
    assert hits == want and want
