import hashlib
import itertools
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from rillflow.llm import sketches
from tests.conftest import SF
from tests.llm.samples import SCHEMA, clashing, frame, hard_rows

signed = lambda x: x - 2**64 if x >= 2**63 else x
xx = lambda data, seed=42: xxhash.xxh64_intdigest(data, seed)
long = lambda x: (x % 2**64).to_bytes(8, "little")
whole = lambda x: (x % 2**32).to_bytes(4, "little")


def keys_of(text):
    """The set of (paragraph, how often) as keys."""
    parts = []
    for line in text.split("\n"):
        parts += re.split(r"(?<=[.!?])\x20+", line) if len(line) > sketches.LONG_LINE else [line]
    counts = {}
    for p in parts:
        if p.strip(" \t\x0b\x0c\r"):
            h = xx(p.encode())
            counts[h] = counts.get(h, 0) + 1
    return {signed(xx(whole(n), xx(long(h)))) for h, n in counts.items()}


def fingerprint(keys):
    cells = {}
    for k in keys:
        check = xx(long(k), xx(b"check"))
        h = xx(long(k))
        for t, part in enumerate((signed(h), h >> 20, h >> 40)):
            at = t * sketches.CELLS + part % sketches.CELLS
            n, a, b = cells.get(at, (0, 0, 0))
            cells[at] = n + 1, a ^ (k % 2**64), b ^ check
    return "".join(f"{at:02x}{n:08x}{a:016x}{b:016x}" for at, (n, a, b) in sorted(cells.items()))


def expected(rows):
    """(n_chars, edited_sha256, fingerprints, likenesses) of each row, sets in place of sketches."""
    rows = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).digest()))
    out = []
    near = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = keys_of(t), keys_of(edited), keys_of(after)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(a), fingerprint(b), near(a, b), near(a, c)))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def results(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def lines(rng, n):
    return "\n".join(rng.choice(["Une phrase.", "", " ", "alpha beta. Gamma! " * rng.randrange(1, 20), f"{rng.random()}", f"{rng.randrange(30)} é"]) for _ in range(n))


MANY = [(i, lines(random.Random(i), random.Random(-i).randrange(1, 40)), "en", "a", 0) for i in range(80)]
LONG = [(1, lines(random.Random(1), 6000), "en", "a", 1), (2, "x" * 200_000, "en", "a", 1), (3, None, None, None, None), (4, "\n".join(str(i) for i in range(3000)), "en", "a", 0)]


@pytest.mark.parametrize("rows", [hard_rows(), MANY, LONG, [], [(7, "only\none", "en", "a", 1)], [(1, "same text.\nof all", "en", "a", 1)] * 9 + [(2, "same text.\nof all", "en", "b", 1)]], ids=["hard", "many", "long", "empty", "one", "repeated"])
def test_is_the_plain_version(spark, rows):
    assert results(sketches.edits(clashing(frame(spark, rows)))) == expected(rows)


def test_recovered_digests_are_those_of_the_changed_paragraphs(spark):
    r = {r.doc_id: r for r in sketches.edits(frame(spark, [(1, "one\ntwo\nthree\nfour", "en", "a", 1), (2, "one\nzwei\nthree", "en", "a", 1)])).collect()}
    a, b = keys_of("one\ntwo\nthree\nfour"), keys_of("one\nzwei\nthree")
    assert {(x.key, x.n) for x in r[1].next_found} == {(k, 1) for k in a - b} | {(k, -1) for k in b - a}


@pytest.mark.parametrize("n", [0, 1, 5, 60, 900])
def test_peeling_any_difference(spark, n):
    """Sets that differ in n keys: all are recovered, by larger sketches where it takes them."""
    rng = random.Random(n)
    draw = lambda k: {rng.randrange(-(2**63), 2**63) for _ in range(k)}
    both, only, other = draw(50), draw(n - n // 3), draw(n // 3)
    df = spark.createDataFrame([(list(both | only), list(both | other))], "a array<long>, b array<long>")
    got = df.select(sketches.difference(F.col("a"), F.col("b")).alias("d")).first().d
    assert {(x.key, x.n) for x in got.found} == {(k, 1) for k in only} | {(k, -1) for k in other}
    assert got.size == sketches.CELLS or n > sketches.CELLS


def test_any_partitioning(spark):
    want = expected(MANY[:30])
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 5, 23):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert results(sketches.edits(frame(spark, MANY[:30], n))) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_query(spark):
    df = sketches.op11_sketches(spark, SF)
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", df._jdf.queryExecution().executedPlan().toString().replace("Scan ExistingRDD[range", ""))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = results(df)
    assert got == expected(rows)
    near = [(a[5], a[6]) for a in got]
    assert sum(x >= y for x, y in near) > 0.9 * len(near) and all(0 <= v <= 1 for v in itertools.chain(*near))
