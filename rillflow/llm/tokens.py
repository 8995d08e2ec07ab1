"""Token counts with a digest cache.

The cache is a Parquet table of content digests, tokenizer-version digests and counts.
Texts whose digest isn't in it for this tokenizer are shuffled by digest, one copy of each
from every task, encoded once and appended; then every document joins its count.

The content digest is the SHA-256 of the normalised content: the text with null as empty.
(Anything that would normalise further has to leave the count as it is; the tokenizer's
own normaliser is part of the tokenizer version, which is the SHA-256 of its file and of
the name of the library.)

Cases: a null text counts as empty; an empty text has no tokens; repeated rows and null
ids are kept, one result for each input row; other columns are ignored, whatever their
names; an empty table gives an empty table and appends nothing; a digest that two runs
have appended at once counts once.
"""

from __future__ import annotations

import functools
import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

CACHE = "content_digest binary, tokenizer_digest string, n_tokens long"
#: Entries of a worker's memory of words.
WORDS = 400_000


@functools.lru_cache(maxsize=4)
def tokenizer_digest(path: str) -> str:
    h = hashlib.sha256(b"sentencepiece\0" if path.endswith(".model") else b"tokenizers\0")
    with open(path, "rb") as f:
        h.update(f.read())
    return h.hexdigest()


class Counter:
    """Counts tokens as the library does.

    A ``.json`` vocabulary whose parts show that nothing crosses ASCII white space (the
    white space is dropped by the pre-tokenizer, normalising is by NFC, lower case and
    white space alone, added tokens hold no white space and don't strip it) is counted word
    by word, and the counts of words are remembered; any other goes to the library whole.
    """

    def __init__(self, path: str, most: int = WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.most, self.known = most, {}
        if path.endswith(".model"):
            import sentencepiece

            lib = sentencepiece.SentencePieceProcessor(model_file=path)
            self.library = lambda texts: [len(x) for x in lib.encode(texts, num_threads=1)]
            self.by_word = False
        else:
            from tokenizers import Tokenizer

            lib = Tokenizer.from_file(path)
            lib.no_truncation()
            lib.no_padding()
            self.library = lambda texts: [len(x) for x in lib.encode_batch_fast(texts, add_special_tokens=False)]
            self.by_word = _word_local(path)

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return self.library(texts)
        known = self.known
        if len(known) > self.most:
            known.clear()
        words = [t.encode().split() for t in texts]
        new = list({w for ws in words for w in ws if w not in known})
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            known.update(zip(part, self.library([w.decode() for w in part]), strict=True))
        return [sum(map(known.__getitem__, ws)) for ws in words]


def _word_local(path: str) -> bool:
    import json

    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    flat = lambda x, key: [z for y in x[key] for z in flat(y, key)] if x and key in x else [x] if x else []
    norm, pre = flat(t.get("normalizer"), "normalizers"), flat(t.get("pre_tokenizer"), "pretokenizers")
    return (
        t["model"]["type"] == "BPE"
        and not t.get("post_processor")
        and all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in norm)
        and bool(pre)
        and pre[0]["type"] == "Split"
        and pre[0]["behavior"] == "Removed"
        and pre[0]["invert"]
        and pre[0]["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        and all(p["type"] == "ByteLevel" and not p["add_prefix_space"] and not p["use_regex"] for p in pre[1:])
        and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or any(c.isspace() for c in a["content"]) for a in t["added_tokens"])
    )


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def _first_of_task(batches):
    """Each digest's first row on this task."""
    seen: set[bytes] = set()
    for b in batches:
        new = []
        for i, d in enumerate(b.column("content_digest").to_pylist()):
            if d not in seen:
                seen.add(d)
                new.append(i)
        if new:
            yield b.take(pa.array(new)) if len(new) < b.num_rows else b


def _count(batches, path: str, version: str):
    if tokenizer_digest(path) != version:
        raise ValueError(f"{path} on this executor isn't the tokenizer of the driver")
    count, seen = _counter(path), set()
    for b in common.slices(batches, rows=2048):
        new = {d: i for i, d in reversed(list(enumerate(b.column("content_digest").to_pylist()))) if d not in seen}
        if not new:
            continue
        seen |= new.keys()
        texts = b.column("text").take(pa.array(list(new.values()))).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), pa.array([version] * len(new)), pa.array(count(texts), pa.int64())], ["content_digest", "tokenizer_digest", "n_tokens"])


def read_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """(content_digest, n_tokens) of one tokenizer version."""
    if common.path_exists(spark, cache_path):
        cache = spark.read.schema(CACHE).parquet(cache_path)
    else:
        cache = spark.createDataFrame([], CACHE)
    return cache.where(F.col("tokenizer_digest") == version).select("content_digest", "n_tokens")


def token_counts(docs: DataFrame, vocabulary: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", hot: int = 1_000, hot_rows: int = 100) -> DataFrame:
    """(id, n_bytes, n_tokens) of each row; encodes the distinct misses and appends them to
    the cache before it returns.  A digest of more than ``hot_rows`` rows, and more than a
    ``hot``-th of all, is joined by broadcast: there are fewer than ``hot``."""
    spark = docs.sparkSession
    version = tokenizer_digest(vocabulary)
    slim = docs.select(docs[id_col].alias("id"), common.text_of(docs, text_col).alias("text"))
    keyed = slim.withColumn("content_digest", F.unhex(F.sha2("text", 256)))
    n = common.partitions_for(slim)
    texts = keyed.select("content_digest", "text")
    once = texts.mapInArrow(_first_of_task, texts.schema).repartition(n, "content_digest")
    misses = once.join(read_cache(spark, cache_path, version).hint("shuffle_hash"), "content_digest", "left_anti")
    misses.mapInArrow(lambda it: _count(it, vocabulary, version), CACHE).write.mode("append").parquet(cache_path)
    cached = read_cache(spark, cache_path, version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    sized = keyed.select("id", "content_digest", F.octet_length("text").cast("long").alias("n_bytes"))
    # digests of many rows, at most ``hot`` of them, go to the rows; the others' rows go to the digests
    least = max(hot_rows, keyed.count() // hot)
    often = keyed.groupBy("content_digest").agg(F.count("*").alias("__rf_n")).where(F.col("__rf_n") > least).select("content_digest")
    known = cached.join(F.broadcast(often), "content_digest", "left_semi").withColumnRenamed("n_tokens", "__rf_hot")
    marked = sized.join(F.broadcast(known), "content_digest", "left")
    alone = F.encode(F.monotonically_increasing_id().cast("string"), "UTF-8")  # too short for a digest, and nowhere gathered
    marked = marked.withColumn("content_digest", F.when(F.col("__rf_hot").isNull(), F.col("content_digest")).otherwise(alone))
    counted = marked.join(cached, "content_digest", "left")
    return counted.select(F.col("id").alias(id_col), "n_bytes", F.coalesce("__rf_hot", "n_tokens").alias("n_tokens"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every whole text of documents, with a cache that begins empty, so that the
    query does the same work whenever it runs."""
    import public_tokenizers

    counts = token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), common.fresh_path(spark, "token-cache"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def queries() -> dict:
    return {"op7_token_counts": op7_token_counts}
