"""Small document tables with the hard cases."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def hard_rows(seed: int = 7) -> list[tuple]:
    """Nulls in every column, empty and long texts, repeated rows, odd characters."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "don't", "naïve", "日本語", "x" * 40, "3.14", "a b", "İ", "é", "!!", "|", "idiot"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", "\t", "\r\n", "\x0b"]) for _ in range(n))
    base = text(60)
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "   \n\t ", None, None, None), (None, "lonely words here", "en", "b", 5),
        (4, base, "en", "a", 1), (5, base, "de", "b", 1), (5, base, "de", "b", 1), (6, base + "tail", "en", "a", 2),
        (7, text(3000), "en", "c", 3), (8, "word", "en", "c", 4), (9, "two words", None, "c", 4), (10, "\x00\x01 \x1c\x1d \x85  x", "en", None, 1),
        (11, "<|endoftext|> <|startoftext|>a", "en", "a", 1), (12, "\U0001f600" * 9 + " 'S 'll İstanbul ΑΣ", "en", "a", 1),
    ]
    return rows + [(100 + i, text(rng.randrange(1, 200)), "en", rng.choice("abc"), i) for i in range(20)]


def frame(spark, rows=None, parts: int = 3):
    return spark.createDataFrame(hard_rows() if rows is None else rows, SCHEMA).repartition(parts)


def clashing(df):
    """df with columns named like those that operators use inside."""
    from pyspark.sql import functions as F

    for c in ("id", "chunk", "shard", "ids", "key", "size", "fingerprint", "component_id", "n_tokens", "score", "words", "media", "digest", "taken", "kept", "rid", "target"):
        df = df.withColumn(c, F.lit("clash"))
    return df
