"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condmon.llm import bpe, decontaminate, fim, labelled, merkle, minhash, mixing, ogg, pfp, pivots, quality, sharding, stages, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every twentieth vector of ``embeddings`` with all others."""
    return pivots.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0)


#: Fixed values of the mixture: exponents of token shares, share of tokens sampled, seed, raking rounds.
MIX_TARGETS, MIX_SHARE, MIX_SEED, MIX_ROUNDS = {"source": 0.5, "lang": 0.3, "topic": 0.7}, 0.5, 23, 20


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrates ``documents`` to target shares of source, language and topic, and draws copies."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", mixing.topic(F.col("text")).alias("topic"), mixing.tokens(F.col("text")).alias("tokens"))
    out = mixing.mix(docs, {c: F.col(c) for c in MIX_TARGETS}, MIX_TARGETS, "tokens", share=MIX_SHARE, seed=MIX_SEED, rounds=MIX_ROUNDS)
    return out.select("doc_id", "topic", "tokens", F.round("expected", 6).alias("expected"), "copies")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes from every whole text of ``documents`` the bytes that a smaller document has in a string of 50."""
    out = pfp.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text of ``documents``; digests of the ids and of the decoded bytes."""
    import public_tokenizers

    vocab = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode(docs, vocab, public_tokenizers.PATTERN, back="bytes", keep_text=False)
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: Labelled rows of each class at most that a classifier is fitted on, whole texts of any length.
FIT_ROWS = 2000


def _classified(spark: SparkSession, sf_dir: str, label: str, parts: int, rest: int, method) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(labelled.fold("doc_id", parts) == rest, F.lit(False))
    model = method.fit(labelled.chosen(docs, labels, label, held_out, FIT_ROWS))
    out = method.score(docs, model, keep_text=False)
    return out.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``; fitted on labelled rows outside the held-out fold."""
    return _classified(spark, sf_dir, "toxic", 5, 0, toxicity)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of ``documents``; fitted on labelled rows outside the held-out fold."""
    return _classified(spark, sf_dir, "quality", 3, 1, quality)


#: Shards, and the seed of the order within a source.
SHARDS, SHARD_SEED = 8, 17


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deals all ``documents`` into eight shards by fractional rank within their source; shard sizes in rows differ by one at most."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.interleave(docs, SHARDS, seed=SHARD_SEED)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every whole text of ``documents`` as an Ogg file, reads it back and reports what was read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = ogg.from_media(ogg.to_media(docs).select("doc_id", "n_bytes", "media"))
    feature = F.concat_ws(";", *[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in ("streams", "pages", "packets", "duration_ms", "bad_pages", "peak")])
    return back.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )


#: The rules that every url is judged by.
URL_RULES = [
    urls.Rule("org", "/", "allow"),
    urls.Rule("example.org", "/es/", "block"),
    urls.Rule("example.org", "/en/1", "block"),
    urls.Rule("com", "/fr/", "allow"),
    urls.Rule("com", "/de/", "block"),
]


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every url of ``pages`` by the rules; urls that no rule fits are allowed."""
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all ``documents`` over sets of five-word shingles, similarity 0.75 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


#: Units, seed, per cent transformed, per cent of those in suffix-prefix-middle order, and the marks.
FIM = fim.Settings("lines", 7, 100, 50, "<P>", "<S>", "<M>")


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts every whole text of ``documents`` into lines and moves its middle to the end; the text is rebuilt from output and form."""
    out = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"), FIM)
    back = fim.restored(F.col("output"), F.col("form"), FIM)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


#: Fixed value: the columns of a leaf.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of ``documents`` by source; every row whose id's CRC is even is checked with its newlines deleted."""
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    shorter = F.replace("text", F.lit("\n"), F.lit(""))
    cut = (F.crc32(id_text.cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    tampered = F.when(cut, merkle.leaf(*[shorter if c == "text" else F.col(c) for c in LEAF]))
    leaves = table(spark, sf_dir, "documents").select("doc_id", "source", merkle.leaf(*[F.col(c) for c in LEAF]).alias("leaf"), tampered.alias("tampered"))
    out = merkle.manifest(leaves, "leaf").withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole text of ``documents`` that lie in windows of ten words of ``benchmark`` items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.contaminated(F.col("n_hit")).alias("contaminated"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over ``documents``."""
    return stages.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_topk": op1_topk,
    "op4_mixing": op4_mixing,
    "op10_minhash": op10_minhash,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op5_toxicity": op5_toxicity,
    "op8_quality": op8_quality,
    "op6_sharding": op6_sharding,
    "op7_ogg": op7_ogg,
    "op9_urls": op9_urls,
    "op3_bpe": op3_bpe,
    "op11_fim": op11_fim,
    "op12_merkle": op12_merkle,
    "op13_decontaminate": op13_decontaminate,
}

ORACLES: dict[str, str] = {}

ORACLES["op6_sharding"] = f"""
WITH RECURSIVE bits AS (SELECT i, 0 AS k, i AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
d AS (SELECT doc_id, source, coalesce(text, '') AS text, md5(concat_ws(':', '{SHARD_SEED}', coalesce(CAST(doc_id AS VARCHAR), ''))) AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY CAST(2 * r + 1 AS DOUBLE) / CAST(2 * n AS DOUBLE), coalesce(source, ''), source IS NULL, r) - 1 AS pos, count(*) OVER () AS total FROM r),
s AS (SELECT *, total // {SHARDS} AS base, total % {SHARDS} AS extra FROM p),
t AS (SELECT *, CAST(CASE WHEN pos < extra * (base + 1) THEN pos // (base + 1) ELSE extra + (pos - extra * (base + 1)) // greatest(base, 1) END AS INTEGER) AS shard FROM s)
SELECT doc_id, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS size,
  CAST(xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, x: xor(c >> 8, tab[xor(c, x) % 256 + 1]), 4294967295), 4294967295) AS BIGINT) AS text_crc32,
  'rows' AS law, shard, CAST(pos - CASE WHEN shard < extra THEN shard * (base + 1) ELSE extra * (base + 1) + (shard - extra) * base END AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM t, crc"""

ORACLES["op9_urls"] = """
WITH p AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (SELECT p.page_id, max_by(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host || r.path)) AS best
  FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM p LEFT JOIN fits USING (page_id)"""

ORACLES["op1_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""


def _mixing_sql() -> str:
    names = list(MIX_TARGETS)
    goals = ",\n".join(
        f"goal_{m} AS (SELECT {m}, p / sum(p) OVER () AS goal FROM (SELECT {m}, pow(sum(t) / (SELECT sum(t) FROM cells), CAST({MIX_TARGETS[m]} AS DOUBLE)) AS p FROM cells GROUP BY {m}))"
        for m in names
    )
    steps, last = [], "start"
    for i in range(MIX_ROUNDS):
        for m in names:
            steps.append(f"r{i}_{m} AS MATERIALIZED (SELECT c.* EXCLUDE (w), w * goal / sum(w) OVER (PARTITION BY c.{m}) AS w FROM {last} c JOIN goal_{m} g ON c.{m} = g.{m})")
            last = f"r{i}_{m}"
    steps = ",\n".join(steps)
    return f"""
WITH d AS (SELECT doc_id, coalesce('=' || source, 'null') AS source, coalesce('=' || lang, 'null') AS lang,
    CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'list' WHEN octet_length(encode(coalesce(text, ''))) < 1000 THEN 'brief' WHEN octet_length(encode(coalesce(text, ''))) < 6000 THEN 'article' ELSE 'long' END AS topic,
    CAST(ceil(octet_length(encode(coalesce(text, ''))) / 4.0) AS BIGINT) AS tokens FROM documents),
cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS t FROM d GROUP BY ALL HAVING sum(tokens) > 0),
start AS (SELECT *, t / sum(t) OVER () AS w FROM cells),
{goals},
{steps},
e AS (SELECT d.doc_id, d.topic, d.tokens, CASE WHEN d.tokens > 0 THEN {MIX_SHARE} * c.w * (SELECT sum(t) FROM cells) / c.t ELSE {MIX_SHARE} END AS expected,
    CAST('0x' || substr(md5(concat_ws(':', '{MIX_SEED}', coalesce(CAST(d.doc_id AS VARCHAR), ''))), 1, 8) AS BIGINT) / 4294967296.0 AS u
  FROM d LEFT JOIN {last} c ON d.source = c.source AND d.lang = c.lang AND d.topic = c.topic)
SELECT doc_id, topic, tokens, round(expected, 6) AS expected, CAST(floor(expected) + CASE WHEN u < expected - floor(expected) THEN 1 ELSE 0 END AS INTEGER) AS copies FROM e"""


ORACLES["op4_mixing"] = _mixing_sql()

ORACLES["op11_fim"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u FROM documents),
r AS (SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
    text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 100 AS plain,
    CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 AS spm FROM d),
c AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:n], '') AS s FROM r)
SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN NOT plain THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(CASE WHEN plain THEN text ELSE p || m || s END) AS restored_sha256
FROM c"""

#: Trees as lists of nodes by level, in list arithmetic; the path of every leaf is walked up level by level.
ORACLES["op12_merkle"] = """
WITH RECURSIVE bits AS (SELECT i, 0 AS k, i AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
d AS (SELECT doc_id, source, coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || CAST(n_chars AS VARCHAR), '-') AS head, text,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, x: xor(c >> 8, tab[xor(c, x) % 256 + 1]), 4294967295), 4294967295) % 2 = 0 AS cut FROM documents, crc),
l AS MATERIALIZED (SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf, CASE WHEN cut THEN replace(text, chr(10), '') ELSE text END AS t, head FROM d),
n AS MATERIALIZED (SELECT doc_id, source, leaf, sha256(head || coalesce(octet_length(encode(t)) || ':' || t, '-')) AS shown,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx FROM l),
tree AS (SELECT source, 0 AS level, list(leaf ORDER BY idx) AS nodes FROM n GROUP BY source
  UNION ALL SELECT source, level + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1:i + 3], ''))) FROM tree WHERE len(nodes) > 1),
subs AS MATERIALIZED (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS place FROM tree WHERE len(nodes) = 1),
top AS (SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subs
  UNION ALL SELECT level + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1:i + 3], ''))) FROM top WHERE len(nodes) > 1),
low AS (SELECT n.doc_id, n.source, n.idx, 0 AS level, '' AS proof, n.shown AS own FROM n
  UNION ALL SELECT w.doc_id, w.source, w.idx // 3, w.level + 1,
    w.proof || array_to_string(t.nodes[w.idx - w.idx % 3 + 1:w.idx], '') || array_to_string(t.nodes[w.idx + 2:w.idx - w.idx % 3 + 3], ''),
    sha256(array_to_string(t.nodes[w.idx - w.idx % 3 + 1:w.idx], '') || w.own || array_to_string(t.nodes[w.idx + 2:w.idx - w.idx % 3 + 3], ''))
  FROM low w JOIN tree t ON t.source IS NOT DISTINCT FROM w.source AND t.level = w.level WHERE len(t.nodes) > 1),
high AS (SELECT w.doc_id, s.place AS idx, 0 AS level, w.proof, w.own FROM low w JOIN (SELECT source, max(level) AS level FROM tree GROUP BY source) e ON e.source IS NOT DISTINCT FROM w.source AND e.level = w.level
    JOIN subs s ON s.source IS NOT DISTINCT FROM w.source
  UNION ALL SELECT w.doc_id, w.idx // 3, w.level + 1,
    w.proof || array_to_string(t.nodes[w.idx - w.idx % 3 + 1:w.idx], '') || array_to_string(t.nodes[w.idx + 2:w.idx - w.idx % 3 + 3], ''),
    sha256(array_to_string(t.nodes[w.idx - w.idx % 3 + 1:w.idx], '') || w.own || array_to_string(t.nodes[w.idx + 2:w.idx - w.idx % 3 + 3], ''))
  FROM high w JOIN top t ON t.level = w.level WHERE len(t.nodes) > 1)
SELECT n.doc_id, n.leaf, s.subroot, r.root, sha256(h.proof) AS proof_sha256, h.own AS folded_root, h.own = r.root AS verified
FROM n JOIN subs s ON s.source IS NOT DISTINCT FROM n.source JOIN high h ON h.doc_id = n.doc_id JOIN (SELECT nodes[1] AS root, level FROM top WHERE len(nodes) = 1) r ON h.level = r.level"""

ORACLES["op13_decontaminate"] = r"""
WITH dw AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item_id, array_to_string(w[s + 1:s + least(10, len(w))], ' ') AS g, least(10, len(w)) AS k
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 10, 0) + 1)) AS s FROM iw WHERE len(w) > 0)),
docwin AS (SELECT doc_id, k, s, array_to_string(w[s + 1:s + k], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS s FROM dw, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
found AS MATERIALIZED (SELECT doc_id, s, k, item_id FROM docwin JOIN win USING (g, k)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS i FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(i, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)"""
