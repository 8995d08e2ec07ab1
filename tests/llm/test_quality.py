import re
from collections import Counter

import pytest

from rillflow.llm import quality
from tests.conftest import SF
from tests.llm.samples import SCHEMA, clashing, frame, hard_rows


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def rows_():
    return hard_rows() + [
        (500, "a b c a b c x\n\nx y\nx y\n \nx y", None, None, None), (501, "a a a a a a", None, None, None), (502, "line one\r\nline one\r\nline one", None, None, None),
        (503, "#*$%&|<> # é|", None, None, None), (504, " ".join(["again and again"] * 40), None, None, None), (505, "a b", None, None, None), (506, "a b c", None, None, None),
    ]


def test_base_counts(spark):
    rows = rows_()
    trusted = spark.createDataFrame([(7,), (None,), (7,), (99999,)], "doc_id long")
    got = quality.quality(clashing(frame(spark, rows)), trusted).collect()
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((str(r.doc_id), *(r[c] for c in cols)) for r in got) == sorted((str(r[0]), *base(r[1])) for r in rows)
    assert not any(r.kept and r.base_failed for r in got)


def test_ratio_is_the_mean_log_ratio(spark):
    import math

    good = [(i, " ".join(f"good{(i * 7 + k * (1 + i % 9)) % 199}" for k in range(60)), "en", "a", 1) for i in range(20)]
    bad = [(100 + i, " ".join(f"bad{(i * 7 + k * (1 + i % 9)) % 199}" for k in range(60)), "en", "a", 1) for i in range(20)]
    trusted = spark.createDataFrame([(i,) for i in range(10)], "doc_id long")
    got = {r.doc_id: r for r in quality.quality(frame(spark, good + bad), trusted).collect()}
    grams = lambda t: t.split() + list(zip(t.split(), t.split()[1:]))
    target, raw = Counter(), Counter()
    for d, t, *_ in good + bad:
        raw.update(grams(t))
        if d < 10:
            target.update(grams(t))
    b = 1 << 14
    p = lambda g: (raw[g] + 1) / (sum(raw.values()) + b)
    lr = lambda g: math.log((target[g] + b * p(g)) / (sum(target.values()) + b) / p(g))
    for d, t, *_ in good + bad:  # few grams: nearly no two share a bucket
        assert got[d].ratio == pytest.approx(sum(map(lr, grams(t))) / len(grams(t)), abs=0.02)
        assert (got[d].ratio > -0.03) == (d < 100)
        assert got[d].kept == (not got[d].base_failed and got[d].ratio >= -0.05)


def test_target_counts_all_trusted_documents(spark):
    from pyspark.sql import functions as F

    n = 10_050  # the target was once counted over the first 10,000 ids by this hash
    ids = [r.id for r in spark.range(n).orderBy(F.xxhash64(F.col("id").cast("string")), "id").collect()]
    late = set(ids[10_000:])
    rows = [(i, "rare text" if i in late else "plain words", "en", "a", 1) for i in ids] + [(n + i, "plain words", "en", "a", 1) for i in range(n)]
    got = quality.quality(frame(spark, rows), spark.createDataFrame([(i,) for i in ids], "doc_id long")).collect()
    assert len(got) == len(rows)
    ratios = {r.ratio for r in got if r.doc_id in late}
    assert len(ratios) == 1 and ratios.pop() > 0


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = quality.op4_quality(spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == {d: base(t) for d, t in docs.items()}
    assert len(got) == len(docs)


def test_no_python_in_the_plan(spark):
    plan = quality.op4_quality(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    ids = spark.createDataFrame([], "doc_id long")
    assert quality.quality(none, ids).count() == 0
    assert {r.ratio for r in quality.quality(frame(spark), ids).collect()} == {0.0}
