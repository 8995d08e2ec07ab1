import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.llm import mixing
from tests.conftest import SF
from tests.llm.samples import SCHEMA, clashing, frame, hard_rows


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=(5, 2, 1), most=3):
    """Share, stop, reshare, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(w[s] for s in free)
        above = [s for s in free if left * w[s] / total > most * sizes[s] + 1e-12]
        if not above:
            return out | {s: left * w[s] / total for s in free}
        for s in above:
            out[s] = most * sizes[s]
        free -= set(above)
        left -= sum(out[s] for s in above)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 10, 1000, 50_000]) for s in rng.sample(["a", "B", "é", "z", "\U0001f600", "", "aa", None], rng.randrange(1, 9))}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got.keys() == sizes.keys()
    for s, t in targets(sizes).items():
        assert got[s] == pytest.approx(t, rel=1e-9, abs=1e-9)


def test_pivot_keeps_the_sum_and_is_unbiased():
    p = np.array([0.3, 0.9, 0.5, 0.1, 0.45, 0.6, 0.25])
    total = np.zeros(len(p))
    for k in range(4000):
        out = mixing.pivot(p, mixing.draws(1, np.full(7, k), np.arange(7)))
        assert ((out < 1e-9) | (out > 1 - 1e-9)).sum() >= 6
        assert out.sum() == pytest.approx(p.sum())
        total += out
    assert np.abs(total / 4000 - p).max() < 0.04


def test_hard_cases(spark):
    rows = hard_rows()
    run = lambda: sorted(map(tuple, mixing.mix(clashing(frame(spark)), leaf=4, fan=2).collect()), key=str)
    got = run()
    assert [(r[0], r[2]) for r in got] == sorted(((r[0], size(r[1])) for r in rows), key=str) or sorted((str(r[0]), r[2]) for r in got) == sorted((str(r[0]), size(r[1])) for r in rows)
    assert all(0 <= r[5] <= 3 and (r[2] or not r[5]) for r in got)


def test_tree_comes_near_the_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * int(rng.lognormvariate(3, 1))), None, rng.choice(["hot"] * 8 + ["b", "c", None]), None) for i in range(4000)]
    got = mixing.mix(frame(spark, rows), leaf=64, fan=4).collect()
    taken, copies, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        taken[r.source] += r.copies * r.size
        copies[r.source] += r.copies if r.size else 0
        count[r.source] += r.size > 0
    for r in {(r.source, r.source_size, r.target) for r in got}:
        assert abs(copies[r[0]] - r[2] / r[1] * count[r[0]]) <= 1 + 1e-6
        assert abs(taken[r[0]] / r[2] - 1) < 0.05


@pytest.mark.parametrize("leaf", [16, 4096])
def test_reruns_agree_on_any_partitioning(spark, leaf, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * int(rng.lognormvariate(3, 1))), None, rng.choice(["hot"] * 4 + ["b", None]), i) for i in range(1500)]
    rows += [(7, "same text here", "en", "hot", 1)] * 150 + [(None, "same text here", "en", None, 1)] * 70 + hard_rows()
    found = []
    for n in (1, 3, 7):
        rng.shuffle(rows)
        frame(spark, rows, n).write.parquet(f"{tmp_path}/{n}")
        for docs in (frame(spark, rows, n), spark.read.parquet(f"{tmp_path}/{n}")):
            found.append(Counter(map(tuple, mixing.mix(docs, leaf=leaf, fan=4).collect())))
    assert all(f == found[0] for f in found) and sum(found[0].values()) == len(rows)
    assert {c for (d, *_, c, _), k in found[0].items() if d == 7 for _ in range(k)} <= {0, 1, 2, 3}


def test_equal_rows_are_told_apart(spark):
    rows = [(1, "a", 3, 9)] * 2500 + [(2, None, 0, 9), (None, "a", 3, 9)]
    got = mixing._numbered(spark.createDataFrame(rows, "id long, source string, size long, tie long"), step=16).collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter(rows) and len({r.own for r in got}) == len(rows)


def test_query_reruns_agree(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    a = sorted(map(tuple, mixing.op10_mixing(spark, SF).collect()))
    assert a == sorted(map(tuple, mixing.op10_mixing(spark, SF).collect()))
    sizes = defaultdict(int)
    for r in docs.values():
        sizes[r.source] += size(r.text)
    want = targets(sizes)
    for doc_id, n, whole, target, taken, copies in a:
        r = docs[doc_id]
        assert (n, whole) == (size(r.text), sizes[r.source]) and target == pytest.approx(want[r.source]) and taken == copies * n <= 3 * n
    assert len(a) == len(docs)


def test_empty_tables(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    none = spark.createDataFrame([(1, None, None, None, None)], SCHEMA)
    assert [tuple(r)[:6] for r in mixing.mix(none).collect()] == [(1, None, 0, 0, 0.0, 0)]
    assert none.select(mixing.n_words(F.lit(" a\t\nb  c ")).alias("n")).first().n == 3
