"""From raw documents to token ids: five stages over the whole corpus.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``.  All but the last
return the columns of ``documents``, the last a fixed set.

In every stage a null text counts as empty; rows with a null doc_id take no part
in near duplicates and dedup, and pass unchanged.  Nulls in source and language
are values of their own.  Texts of any length are worked on whole.  Repeated
rows are treated alike: equal ids are one document, so neither a copy of a row
nor its text goes on account of the other.  Ties go to the smaller id.  An empty
table gives an empty one.  Further columns ride along up to the last stage;
their names may be those of an operator's figures, which are dropped, but two
columns whose names differ in case only are not supported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condmon.llm import bpe, labelled, minhash, mixing, pfp, quality
from condmon.llm.common import written

#: Labelled rows of each class at most that the quality classifier is fitted on, whole texts of any length.
FIT_ROWS = 2000
#: Ids of removed documents up to which they are broadcast; beyond that both sides are dealt by id.
BROADCAST_IDS = 1_000_000
#: Exponents of token shares that the mixture aims at, tokens wanted for those at hand, seed.
TARGETS, SHARE, SEED = {"source": 0.8, "lang": 0.8, "topic": 0.9}, 1.0, 23


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (a factorisation machine) rejects, score under 0.5, go; none where the labels lack a class."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(labelled.chosen(docs, labels, "quality", F.lit(False), FIT_ROWS))
    if not model.trained:
        return docs
    return quality.score(docs, model).where("score >= 0.5").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id, with all rows of that id."""
    gone = written(minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct(), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti")


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a document with a smaller id has are cut out; characters cut in two go as a whole."""
    out = pfp.dedup(docs, as_text=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn, some several times (a row for each copy), so that token shares of source, language and topic move to the targets."""
    sized = docs.withColumn("__tokens", mixing.tokens(F.col("text")))
    margins = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic(F.col("text"))}
    drawn = mixing.mix(sized, margins, TARGETS, "__tokens", share=SHARE, seed=SEED).where("copies >= 1")
    return drawn.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (little-endian unsigned 32-bit), and whether they decode to the text."""
    import public_tokenizers

    vocab = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(docs.select("doc_id", "source", "lang", "text"), vocab, public_tokenizers.PATTERN, back="check", keep_text=False)
    return coded.select("doc_id", "source", "lang", "n_tokens", "token_ids", "round_trip")


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", suffix_dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", bpe_stage),
]

#: SQL can't express the classifier, the dedup stages on whole tables or BPE; every stage is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
