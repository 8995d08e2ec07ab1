"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio between a trusted
target and the raw corpus.  DataFrame functions only.

Words and pairs of neighbouring words are hashed to ``buckets`` numbers.  The raw
multinomial counts them over all documents, the target multinomial over all trusted
documents, smoothed by the raw one.  A document's verdict is its mean log-ratio over all its
words and pairs against a threshold: the same document always gets the same verdict, none is
drawn at random.

Base counts are made within the row: repeated three-word windows are found by sorting the
windows' hashes, so that texts are never shuffled.

Cases: a null text counts as empty: no words, base_failed and not kept; repeated rows and
null ids are kept, one result for each input row; without trusted documents both
multinomials are equal and the ratio is 0; other columns are ignored, whatever their names;
an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50


def words_of(text: Column) -> Column:
    """The words of a text, as an array."""
    return F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " ", -1), lambda w: w != "")


def with_windows(df: DataFrame) -> DataFrame:
    """words -> windows: hashes of the three-word windows, in order."""
    return df.withColumn(
        "windows",
        F.expr("CASE WHEN size(words) < 3 THEN cast(array() AS array<bigint>) ELSE transform(slice(words, 1, size(words) - 2), (w, i) -> xxhash64(w, words[i + 1], words[i + 2])) END"),
    )


def repeat_words(df: DataFrame) -> DataFrame:
    """windows -> n_repeat_words.  Rows whose windows all differ (most) are done then; the
    others sort (hash, place) and add up what places cover."""
    df = df.withColumn("has", F.size(F.array_distinct("windows")) < F.size("windows"))
    pairs = "sort_array(transform(windows, (h, i) -> named_struct('h', h, 'i', i)))"
    df = df.withColumn("pairs", F.expr(f"CASE WHEN has THEN {pairs} END"))
    places = "sort_array(filter(transform(pairs, (p, i) -> CASE WHEN p.h = get(pairs, i + 1).h OR p.h = get(pairs, i - 1).h THEN p.i END), x -> x IS NOT NULL))"
    df = df.withColumn("places", F.expr(f"CASE WHEN has THEN {places} END"))
    # a place covers three words, fewer if the next place comes first
    covered = "aggregate(transform(places, (p, i) -> least(3, coalesce(get(places, i + 1) - p, 3))), 0L, (s, x) -> s + x)"
    return df.withColumn("n_repeat_words", F.expr(f"CASE WHEN has THEN {covered} ELSE 0L END"))


def bucket(*words: str, buckets: int) -> str:
    return f"cast(pmod(xxhash64({', '.join(words)}), {buckets}) AS int)"


def buckets_of(buckets: int) -> Column:
    """The buckets of all words and neighbouring pairs."""
    one = f"transform(words, w -> {bucket('w', buckets=buckets)})"
    two = f"CASE WHEN size(words) < 2 THEN cast(array() AS array<int>) ELSE transform(slice(words, 1, size(words) - 1), (w, i) -> {bucket('w', 'words[i + 1]', buckets=buckets)}) END"
    return F.expr(f"concat({one}, {two})")


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, buckets: int, smooth: float) -> np.ndarray:
    """The log-ratio of each bucket: an array of fixed size."""
    rows = docs.select(docs[id_col].alias("id"), common.text_of(docs, text_col).alias("text"))
    ids = trusted.select(trusted[id_col].cast(docs.schema[id_col].dataType).alias("id")).where("id IS NOT NULL").distinct().withColumn("in", F.lit(1))
    # ids grow with the corpus: both sides are shuffled at any size, ids are hashed and texts not sorted.
    # Rows without an id are dealt by their text, not all to one task
    rows = rows.withColumn("key", F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id")))
    rows = rows.join(ids.withColumn("key", F.xxhash64("id")).hint("shuffle_hash"), ["key", "id"], "left")
    # a bucket's counts are summed in each task before they are shuffled
    grams = rows.select("in", words_of(F.col("text")).alias("words")).select("in", F.explode(buckets_of(buckets)).alias("b"))
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.count("in").alias("target")).collect()
    raw, target = np.ones(buckets), np.zeros(buckets)
    for r in counts:
        raw[r.b] += r.raw
        target[r.b] += r.target
    raw /= raw.sum()
    return np.log((target + smooth * buckets * raw) / (target.sum() + smooth * buckets)) - np.log(raw)


def quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = -0.05, buckets: int = 1 << 14, smooth: float = 1.0) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio,
    kept) of each row; trusted: ids of trusted documents."""
    ratios = log_ratios(docs, trusted, id_col, text_col, buckets, smooth)
    df = common.spread(docs.select(docs[id_col].alias("id"), common.text_of(docs, text_col).alias("text")))
    df = df.withColumn("words", words_of(F.col("text")))
    df = repeat_words(with_windows(df))
    df = df.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != ""))
    n_words = F.size("words").cast("long")
    grams = F.greatest(F.lit(1), F.lit(2) * n_words - 1)
    table = F.lit(ratios)
    total = F.aggregate(buckets_of(buckets), F.lit(0.0), lambda s, b: s + F.get(table, b))
    df = df.select(
        "id",
        n_words.alias("n_words"),
        F.char_length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        (total / grams).alias("ratio"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    return df.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", (~F.col("base_failed") & (F.col("ratio") >= threshold)).alias("kept"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents; trusted are documents that labels call good."""
    docs = common.table(spark, sf_dir, "documents")
    trusted = common.table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return quality(docs, trusted)


def queries() -> dict:
    return {"op4_quality": op4_quality}
