import random

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rillflow.llm import tokens
from tests.conftest import SF
from tests.llm.samples import SCHEMA, clashing, frame, hard_rows

VOCABULARY = P.path("word_bpe_49k.json")


def library(texts):
    t = Tokenizer.from_file(VOCABULARY)
    return [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]


def test_counter_is_the_library():
    rng = random.Random(5)
    alphabet = list("abzAZ019 '.,!|<>\n\t\r\x0b\x0c\x1c\x85  　́éÉßİΣςſKﬁ日本한가👍🏽\x00_") + ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", "  "]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(20_000)] + ["", " "]
    count = tokens.Counter(VOCABULARY, most=500)
    assert count.by_word
    got = [n for i in range(0, len(texts), 100) for n in count(texts[i : i + 100])]
    assert got == library(texts)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_vocabularies_go_whole(name):
    count = tokens.Counter(P.path(name))
    texts = ["Hello  world", "a\nb c", ""]
    assert not count.by_word
    if name.endswith(".model"):
        assert count(texts) == [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=P.path(name)).encode(texts)]
    else:
        assert count(texts) == [len(x.ids) for x in Tokenizer.from_file(P.path(name)).encode_batch(texts, add_special_tokens=False)]


def test_hard_cases_and_cache(spark, tmp_path):
    rows, cache = hard_rows(), str(tmp_path / "cache")
    want = sorted((str(r[0]), len((r[1] or "").encode()), n) for r, n in zip(rows, library([r[1] or "" for r in rows]), strict=True))
    run = lambda df: sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in tokens.token_counts(df, VOCABULARY, cache).collect())
    assert run(clashing(frame(spark, rows[:9]))) == sorted(w for w in want if w[0] in {str(r[0]) for r in rows[:9]})
    first = spark.read.parquet(cache).count()
    assert first == len({r[1] or "" for r in rows[:9]})
    assert run(frame(spark, rows)) == want
    assert spark.read.parquet(cache).count() == len({r[1] or "" for r in rows})
    assert run(frame(spark, rows)) == want
    assert spark.read.parquet(cache).count() == len({r[1] or "" for r in rows})


def test_counts_of_another_tokenizer_are_not_taken(spark, tmp_path):
    cache = str(tmp_path / "cache")
    df = frame(spark)
    tokens.token_counts(df, VOCABULARY, cache)
    other = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(other)
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(df, other, cache).collect()}
    assert got[7] == len(t.encode(next(r[1] for r in hard_rows() if r[0] == 7), add_special_tokens=False).ids)


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = dict(zip(texts, library(list(texts.values())), strict=True))
    got = tokens.op7_token_counts(spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {d: (len(texts[d].encode()), n, n > 2048) for d, n in want.items()} and len(got) == len(texts)


def test_a_digest_of_a_third_of_all_rows(spark, tmp_path):
    rows = [(i if i % 5 else None, ("one text" if i % 3 == 0 else None if i % 3 == 1 else f"text {i}"), "en", "a", 0) for i in range(900)]
    got = tokens.token_counts(frame(spark, rows), VOCABULARY, str(tmp_path / "c"), hot_rows=20)
    want = sorted((str(r[0]), len((r[1] or "").encode()), n) for r, n in zip(rows, library([r[1] or "" for r in rows]), strict=True))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got.collect()) == want


def test_empty_table(spark, tmp_path):
    assert tokens.token_counts(spark.createDataFrame([], SCHEMA), VOCABULARY, str(tmp_path / "c")).count() == 0
