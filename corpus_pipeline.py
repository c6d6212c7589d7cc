"""From raw documents to token ids: five stages, each an operator of ``leafpress.llm``.

A stage takes the session, the documents that its predecessor left and the folder
of the tables, and gives a DataFrame, which is written as Parquet and read back
for the next.  All but the last give the columns of ``documents``, with ``n_chars``
as the text then is.

1. ``quality``: documents that the classifier rejects go.
2. ``simhash``: one document of each group of near duplicates stays.  SimHash prints
   within ``BITS`` bits, found by vantage-point trees as in ``op1_vantage_prints``, propose
   near duplicates, MinHash bands those beyond that radius; the rule that decides is a
   Jaccard similarity of ``SIMILARITY`` or more between shingles of ``WORDS`` words.
3. ``substrings``: passages that also stand in a document with a smaller id go;
   documents of which nothing is left go with them.
4. ``mixing``: sources are brought to their target weights; a document stands as
   often as it is taken, and one without words is not taken.
5. ``bpe``: token ids of every text, and the byte at which each token begins; both
   are decoded again, and a row has the digests of the text and of the decoded bytes.

Tables of a run lie in the shared folder that the cluster names in
``spark.checkpoint.dir``; a stage's table goes when the next one is written, the
last one stays, as the result reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafpress.llm import bpe, mixing, quality, simhash, substrings
from leafpress.llm.common import Scratch

#: Rank file of the last stage.
RANKS = "byte_bpe_50k.tiktoken"
#: Near duplicates of the second stage: bits between near prints, words in a shingle, least similarity.
BITS = 4
WORDS = 5
SIMILARITY = 0.8


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.without_rejects(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, bits=BITS, words=WORDS, similarity=SIMILARITY)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(substrings.without_repeats(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(mixing.mixed_documents(docs))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    digested = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    encoded = bpe.encode(digested, public_tokenizers.path(RANKS), digest=True)
    return encoded.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("quality classifier", quality_stage),
    ("near-dedup by similarity", simhash_stage),
    ("substring dedup", substring_stage),
    ("mixing sources", mixing_stage),
    ("byte-level BPE", bpe_stage),
]

#: SQL cannot express the classifier, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents`` of the folder; the result reads the last stage's table."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), str(k))
        if k:
            scratch.drop(str(k - 1))
    return docs
