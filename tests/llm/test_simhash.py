import numpy as np
import xxhash
from pyspark.sql import functions as F

from rillflow.llm import components, simhash
from tests.conftest import SF
from tests.llm.samples import SCHEMA, clashing, frame, hard_rows


def plain(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, radius=3):
    """rows (id, fingerprint) -> id: smallest id reachable"""
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                ra, rb = find(a), find(b)
                up[max(ra, rb)] = min(ra, rb)
    low = {}
    for d, f in rows:
        if d is not None:
            r = find(f)
            low[r] = min(low.get(r, d), d)
    return [(d, f"{f:016x}", low.get(find(f))) for d, f in rows]


def key(r):
    return str(r)


def test_hard_cases(spark):
    rows = hard_rows()
    got = simhash.near_duplicates(clashing(frame(spark))).select("doc_id", simhash.hex64(F.col("fp")), "component_id")
    want = brute([(r[0], plain(r[1])) for r in rows])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = simhash.op2_simhash(spark, SF).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute([(r.doc_id, plain(r.text)) for r in docs]), key=key)
    assert any(r.doc_id != r.component_id for r in got)


def test_large_groups_are_tiled(spark):
    rng = np.random.default_rng(3)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 40)}
    base = 0x0123456789ABCDEF
    for _ in range(300):  # chains of near fingerprints around a few centres
        f = base ^ (int(rng.integers(0, 6)) << 58)
        for b in rng.integers(0, 64, 5):
            f ^= 1 << int(b)
        fps.add(f)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    roots = {r.u: r.root for r in components.components(simhash.links(df, tile=16)).collect()}
    sign = lambda f: f - (1 << 64) if f >> 63 else f
    parts = lambda label: sorted(sorted(x for x in fps if label(x) == k) for k in {label(x) for x in fps})
    want = {f: c for f, (_, _, c) in zip(sorted(fps), brute([(f, f) for f in sorted(fps)]), strict=True)}
    assert parts(lambda f: roots.get(sign(f), sign(f))) == parts(lambda f: want[f])


def test_hubs(spark):
    rng = np.random.default_rng(5)
    star = [(500, int(x)) for x in range(1, 900) if x != 500]  # a hub among others' ids
    twin = [(5000 + i, 9000) for i in range(300)] + [(9000, 9001), (9001, 4000)]  # a hub above all
    chain = [(2000 + i, 2001 + i) for i in range(40)]
    edges = star + twin + chain + [(7, 7)]
    rng.shuffle(edges)
    df = spark.createDataFrame([(int(u), int(v)) for u, v in edges], "u long, v long")
    got = {r.u: r.root for r in components.components(df.repartition(5)).collect()}
    want = {x: 1 for x in range(2, 900)} | {2001 + i: 2000 for i in range(40)} | {x: 4000 for x in (*range(5000, 5300), 9000, 9001)}
    assert got == want


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 16, 500).astype(np.uint64)
    for radius in range(4):
        got = {(int(i), int(j)) for a, b in simhash.within(fps, np.zeros(500, int), np.full(500, 8), radius) for i, j in zip(a, b)}
        assert got == {(i, j) for i in range(500) for j in range(i + 1, 500) if int(fps[i] ^ fps[j]).bit_count() <= radius}


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
