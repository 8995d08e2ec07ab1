import math
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.llm import vectors
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, rounds=vectors.ROUNDS):
    """(code, error) by row and the codebooks, every distance computed, in Python's integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return [], [], []
    d = -(-max(len(r[1]) for r in kept) // 8)
    whole = [[math.floor(Fraction(x) * 4096) for x in r[1]] + [0] * (8 * d - len(r[1])) for r in kept]
    cut = [[v[p * d : p * d + d] for p in range(8)] for v in whole]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:16]
    books = [[cut[i][p] for i in order] for p in range(8)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, x: min((dist(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        at = [[near(p, v[p])[1] for p in range(8)] for v in cut]
        for p in range(8):
            for k in range(len(books[p])):
                mine = [v[p] for v, a in zip(cut, at, strict=True) if a[p] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [[near(p, v[p]) for p in range(8)] for v in cut]
    return kept, [("".join(f"{k:02x}" for _, k in f), min(vectors.MOST, sum(e for e, _ in f))) for f in found], books


def results(df):
    books = vectors.fit(df)
    coded = vectors.common.written(vectors.encode(df, books), "test-codes")
    out = vectors.with_label_error(coded).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label", "label_error")
    return books, sorted(map(tuple, out.collect()), key=str)


def expected(rows):
    kept, found, books = plain(rows)
    sums = {}
    for r, (_, e) in zip(kept, found, strict=True):
        sums[r[2]] = sums.get(r[2], 0) + e
    return books, sorted(((r[0], c, e, r[2], min(vectors.MOST, sums[r[2]])) for r, (c, e) in zip(kept, found, strict=True)), key=str)


def rows_of(n, d, seed, scale=1.0):
    rng = random.Random(seed)
    return [(i * 3, [rng.gauss(0, scale) for _ in range(d)], rng.choice([1, 2, None])) for i in range(n)]


HARD = [
    (1, None, 1), (2, [0.5, None] * 8, 1), (3, [float("nan")] + [0.0] * 15, 1), (4, [float("inf")] * 16, None), (5, [-0.3] * 16, None), (5, [-0.3] * 16, None),
    (5, [0.3] * 16, 2), (None, [0.1] * 16, 2), (6, [], 3), (7, [1.0] * 5, 3), (8, [0.25] * 16, None), (9, [0.25] * 16, None),
]


@pytest.mark.parametrize(
    "rows",
    [rows_of(300, 16, 1), rows_of(40, 64, 2), rows_of(7, 8, 3), rows_of(60, 17, 4), HARD, HARD[:4], [], [(i, [0.5] * 8, 0) for i in range(40)], rows_of(50, 8, 5, 1e6) + rows_of(20, 8, 6, 1e30) + [(1000, [1.7e308, -1.7e308] * 4, 9)], [(i, [float(i % 5)] * 8, i % 2) for i in range(60)]],
    ids=["many", "wide", "few", "padded", "hard", "none whole", "empty", "equal", "huge", "ties"],
)
def test_is_the_plain_version(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in ("id", "code", "error", "part", "entry", "n", "label_error"):
        df = df.withColumn(c, F.lit("clash"))
    books, got = results(df)
    want_books, want = expected(rows)
    assert got == want
    if rows and want:
        assert [list(map(list, p)) for p in books.entries] == want_books


@pytest.mark.parametrize("scale", [1, 50, 1 << 20, 1 << 40])
def test_filter_bounds_hold_and_spare_distances(scale):
    rng = np.random.default_rng(scale % 97)
    entries = rng.integers(-4 * scale, 4 * scale + 1, (16, 8)).tolist()
    x = rng.integers(-5 * scale, 5 * scale + 1, (500, 8))
    f = vectors.Filter(entries)
    exact = np.array([[sum((int(a) - b) ** 2 for a, b in zip(row, e, strict=True)) for e in entries] for row in x], object)
    lower, upper = f.bounds(x.astype(object))
    assert (lower <= exact).all() and (exact <= upper).all()
    best, error, computed = f.nearest(x)
    assert best.tolist() == exact.argmin(axis=1).tolist() and error.tolist() == exact.min(axis=1).tolist()
    assert 500 <= computed < 500 * 8


def test_hot_labels_and_any_partitioning(spark):
    rows = [(i, [i % 7 / 7, i % 11 / 11] * 4, 1 if i % 3 else i) for i in range(700)]
    want = expected(rows)[1]
    for n in (1, 5):
        assert results(spark.createDataFrame(rows, SCHEMA).repartition(n))[1] == want


def test_decoded_vectors_are_near(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    books = vectors.fit(df)
    got = vectors.decode(vectors.encode(df, books), books).join(df.select("vec_id", "embedding"), "vec_id").collect()
    for r in got:
        ints = [math.floor(4096 * x) for x in r.embedding]
        assert r.error == sum((a - round(b * 4096)) ** 2 for a, b in zip(ints, r.decoded, strict=True))


def test_query_is_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    df = vectors.op12_vector_codes(spark, SF)
    found = con.sql(vectors.oracle_sql()["op12_vector_codes"])
    assert sorted(map(tuple, df.select(*found.columns).collect())) == sorted(found.fetchall())
