"""Totals of points in intervals and rectangles against plain loops."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rillflow.operators import spans

NAN, INF = float("nan"), float("inf")


def above(a, b):
    """a >= b where NaN is above all."""
    return a != a or (b == b and a >= b)


def inside(v, lo, hi):
    return None not in (v, lo, hi) and above(v, lo) and not above(v, hi)


def some(rng, n, wide):
    odd = [(None, 1.0), (1.0, None), (NAN, 5.0), (3.0, NAN), (-INF, INF), (INF, INF), (2.0, 2.0), (4.0, 1.0), (0.0, 10.0), (-0.0, 0.5), (-5.0, -1.0), (9.5, 99.0)]
    return odd + [(a := float(rng.randrange(wide)), a + rng.choice([0.5, 3.0, wide / 2])) for _ in range(n)]


@pytest.mark.parametrize("wide", [8, 300])
def test_intervals_are_the_plain_version(spark, wide):
    rng = random.Random(wide)
    points = [(k, x) for k, x in enumerate([None, NAN, INF, -INF, 0.0, -0.0] + [7.0] * 50 + [float(rng.randrange(wide)) for _ in range(400)])]
    cells = [(i % 60, lo, hi) for i, (lo, hi) in enumerate(some(rng, 90, wide))]
    want = {}
    for g, lo, hi in cells:
        for k, x in points:
            if inside(x, lo, hi):
                n, s, m = want.get(g, (0, 0, k))
                want[g] = n + 1, s + k, min(m, k)
    ps = spark.createDataFrame(points, "k long, x double").repartition(4)
    cs = spark.createDataFrame(cells, "g int, lo double, hi double").repartition(3)
    one = lambda p, c: spans.in_intervals(p, c, "x", "lo", "hi", ["g"], {"s": F.col("k")}, {"m": F.col("k")})
    assert {r.g: (r.n, r.s, r.m) for r in one(ps, cs).collect()} == want
    assert one(ps.limit(0), cs).count() == one(ps, cs.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [12, 2])
def test_rectangles_are_the_plain_version(spark, bits, monkeypatch):
    """One chunk of y, and many; many points of one place; repeated rectangles."""
    monkeypatch.setattr(spans, "CHUNK_BITS", bits)
    rng = random.Random(bits)
    points = [(3.0, 4.0, Decimal("0.25"))] * 60 + [(float(rng.randrange(90)), float(rng.randrange(70)), rng.choice([None, Decimal(rng.randrange(900)) / 4])) for _ in range(400)]
    points += [(x, y, Decimal(1)) for x in (None, NAN, 1.0) for y in (None, INF, 2.0)]
    rects = [(i % 100, *a, *b) for i, (a, b) in enumerate(zip(some(rng, 100, 90), reversed(some(rng, 100, 70)), strict=True))]
    rects += [(i, *r[1:]) for i, r in enumerate(rects[-5:])] * 2
    want = {}
    for g, x0, x1, y0, y1 in rects:
        for x, y, v in points:
            if inside(x, x0, x1) and inside(y, y0, y1):
                n, s, m = want.get(g, (0, 0, y))
                want[g] = n + 1, s + (v or 0), max(m, y)
    ps = spark.createDataFrame(points, "x double, y double, v decimal(18,2)").repartition(4)
    rs = spark.createDataFrame(rects, "g int, x0 double, x1 double, y0 double, y1 double").repartition(3)
    one = lambda p, r: spans.in_rects(p, r, "x", "y", ["g"], "v")
    assert {r.g: (r.n, r.total or 0, r.latest) for r in one(ps, rs).collect()} == want
    assert one(ps.limit(0), rs).count() == one(ps, rs.limit(0)).count() == 0


def test_covers_are_few_and_whole(spark):
    """A wide interval is some six nodes a level, not its points; so is every one of 40 ranks exactly."""
    wide = spans.covered(spark.createDataFrame([(1, (1 << 40) - 1)], "a long, b long"), "a", "b", 1 << 40)
    assert wide.count() <= 6 * 21
    every = spark.range(41).toDF("a").crossJoin(spark.range(41).toDF("b"))
    got = spans.covered(every, "a", "b", 40).selectExpr("a", "b", "explode(sequence(shiftleft(node, 2 * level), shiftleft(node + 1, 2 * level) - 1)) AS r")
    assert got.groupBy("a", "b").agg(F.sort_array(F.collect_list("r")).alias("r")).where("r != sequence(a, b - 1)").isEmpty()
    assert got.select("a", "b").distinct().count() == 41 * 40 // 2
