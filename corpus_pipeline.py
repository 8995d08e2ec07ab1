"""The corpus pipeline: documents from raw to token ids.

Stages, each a function of (spark, docs, sf_dir) that works on all that the one before has
kept; docs are read from what that one has written:

1. toxicity: documents that score 0.7 or more go; labels of the corpus teach the scores.
2. near_dedup: one document of each SimHash component stays, that with the smallest id.
3. secrets: secrets in texts are replaced by their kind, and n_chars follows.
4. mixing: documents are taken as often as the mix of their sources says.
5. bpe: texts become token ids, given by number and digest, and are decoded again.

All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import bpe, common, mixing, secrets, simhash, toxicity


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    redacted = secrets.redact_secrets(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        redacted = redacted.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))
    return redacted


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.bpe_encode(docs, ranks, public_tokenizers.PATTERN, decoded="decoded")
    return coded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [("toxicity", clean), ("near_dedup", near_dedup), ("secrets", redact), ("mixing", mixed), ("bpe", encoded)]

#: Scores, hashes of shingles and token ids aren't SQL; tests hold each stage against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.written(docs, f"pipeline-{name}")
    return docs
