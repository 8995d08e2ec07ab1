import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

import corpus_pipeline
from rillflow.llm import mixing, secrets, toxicity
from tests.conftest import SF
from tests.llm.samples import SCHEMA, clashing, frame, hard_rows
from tests.llm.test_bpe import library
from tests.llm.test_mixing import size, targets
from tests.llm.test_simhash import brute, plain


def kept_ids(rows):
    """Of (id, text) rows the ids that are the smallest of their component."""
    return sorted({c for _, _, c in brute([(d, plain(t)) for d, t in rows])}, key=str)


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, schema = docs.columns, docs.dtypes
    enc = library()
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        got = stage(spark, docs, SF)
        if name != "bpe":
            assert got.columns == columns and got.dtypes == schema
        got = got.cache() if name == "bpe" else spark.createDataFrame(got.collect(), docs.schema)
        after = got.collect()
        texts = {r.doc_id: r for r in before}
        if name == "toxicity":
            index = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            want = [r for r, t in zip(before, index.terms.read(pa.array([r.text or "" for r in before])), strict=True) if index.score(t)[0] < 0.7]
            assert Counter(after) == Counter(want) and len(want) > 0.8 * len(before)
        elif name == "near_dedup":
            assert sorted((r.doc_id for r in after), key=str) == kept_ids([(r.doc_id, r.text) for r in before])
            assert all(r == texts[r.doc_id] for r in after) and len(after) < len(before)
        elif name == "secrets":
            words = secrets.ranked(secrets.corpus_words(docs))
            assert {r.doc_id: (r.text, r.n_chars) for r in after} == {d: (t := secrets.redacted(r.text, secrets.spans_of(r.text, words=words)), len(t)) for d, r in texts.items()}
        elif name == "mixing":
            sizes, taken, copies = defaultdict(int), defaultdict(int), Counter(r.doc_id for r in after)
            for r in before:
                sizes[r.source] += size(r.text)
                taken[r.source] += size(r.text) * copies[r.doc_id]
            assert max(copies.values()) <= 3 and all(r == texts[r.doc_id] for r in after)
            goal = targets(sizes)
            assert abs(sum(taken.values()) / sum(goal.values()) - 1) < 0.1
            assert all(abs(taken[s] - goal[s]) <= 2 * max(size(r.text) for r in before if r.source == s) for s in sizes)
        else:
            want = Counter((r.doc_id, len(i := enc.encode_ordinary(r.text)), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()) for r in before)
            assert Counter(map(tuple, after)) == want
        docs = got


def test_hard_cases(spark):
    labels = "/root/testdata/sf0.001"
    for rows in (hard_rows(), []):
        docs = clashing(frame(spark, rows)) if rows else spark.createDataFrame([], SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, labels)
            if name == "bpe":
                assert got.count() == docs.count()
                break
            assert got.columns == docs.columns
            docs = spark.createDataFrame(got.collect(), got.schema)


def test_one_row_of_each_group_stays(spark):
    from rillflow.llm import simhash

    rows = hard_rows() + [(None, "only null ids", "en", "a", 1), (None, "only null ids", "en", "a", 1), (None, "other words then", None, None, None)]
    got = simhash.keep_one(frame(spark, rows)).collect()
    assert sorted((r.doc_id for r in got if r.doc_id is not None), key=str) == [x for x in kept_ids([(r[0], r[1]) for r in rows]) if x is not None]
    assert sorted(r.text for r in got if r.doc_id is None) == ["lonely words here", "only null ids", "other words then"]


def test_equal_rows_are_taken_together(spark):
    rows = [(1, "a b c", "en", "s", 1)] * 5 + [(None, None, None, None, None), (2, "d e", "en", None, 1)]
    got = mixing.take(frame(spark, rows)).collect()
    assert all(tuple(r) in rows for r in got) and len(got) <= 21


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 0


def test_kept_rows_are_the_same_on_any_partitioning(spark):
    """Rows that stages can't tell apart by id and text, or by id and fingerprint: one defined row."""
    from rillflow.llm import mixing, simhash
    from tests.llm.samples import SCHEMA

    rows = [(7, "A b c d", "en", "s", i) for i in range(15)] + [(7, "a B c d", "de", "s", 1), (7, "a  b c d", None, "s", 2), (None, "x y z w", "en", "s", 1), (None, "X y z w", "en", "s", 2)]
    rows += [(9, f"only {i % 3} one", "en", "t", i) for i in range(9)]
    kept, taken = set(), set()
    for n in (1, 3, 7):
        df = spark.createDataFrame(rows[n:] + rows[:n], SCHEMA).repartition(n)
        kept.add(tuple(sorted(map(tuple, simhash.keep_one(df).collect()), key=str)))
        taken.add(tuple(sorted(map(tuple, mixing.take(df).collect()), key=str)))
    assert len(kept) == len(taken) == 1 and next(iter(kept)) and next(iter(taken))
