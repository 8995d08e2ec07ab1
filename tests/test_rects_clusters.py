"""Points in rectangles, and clusters within groups, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from rillflow.operators import clustering, rects

NAN, INF = float("nan"), float("inf")


def test_rect_join_of_any_sizes(spark):
    """Sides over nine magnitudes, thin ones, hot cell, edges, empty and broken ones."""
    rng = random.Random(1)
    boxes = []
    for _ in range(150):
        w, h = 10 ** rng.uniform(-4, 5), 10 ** rng.uniform(-4, 5)
        x, y = rng.choice([0.0, 5.0, rng.uniform(-1e5, 1e5)]), rng.choice([0.0, rng.uniform(-1e5, 1e5)])
        boxes.append((x, x + w, y, y + h))
    boxes += [(0.0, 1.0, 0.0, 1.0), (1.0, 2.0, 0.0, 1.0), (0.0, 1e6, 0.0, 1e-9), (3.0, 3.0, 0.0, 1.0), (2.0, 1.0, 0.0, 1.0), (NAN, 1.0, 0.0, 1.0), (0.0, INF, 0.0, 1.0), (None, 1.0, 0.0, 1.0), (1e15, 1e15 + 0.5, 0.0, 1.0)]
    places = [(0.5, 0.5)] * 300 + [(1.0, 0.0), (0.0, 0.0), (2.0, 1.0), (-0.0, 0.99), (NAN, 0.0), (None, 0.0), (INF, 0.0), (1e15, 0.5)] + [(rng.uniform(-1e5, 1e5), rng.uniform(-1e5, 1e5)) for _ in range(300)] + [(rng.uniform(-3, 9), rng.uniform(-3, 9)) for _ in range(200)]
    b = [(i, *x) for i, x in enumerate(boxes)]
    p = [(i, *x) for i, x in enumerate(places)]
    ok = lambda v: v is not None and v == v and abs(v) != INF
    want = sorted((i, r) for i, x, y in p if ok(x) and ok(y) for r, x0, x1, y0, y1 in b if all(map(ok, (x0, x1, y0, y1))) and x0 <= x < x1 and y0 <= y < y1)
    bs = spark.createDataFrame(b, "rect long, x0 double, x1 double, y0 double, y1 double")
    ps = spark.createDataFrame(p, "id long, x double, y double").repartition(4)
    assert sorted(map(tuple, rects.rect_join(ps, bs, "x", "y").select("id", "rect").collect())) == want
    assert rects.cover(bs, ("x0", "x1", "y0", "y1")).groupBy("rect").count().agg(F.max("count")).first()[0] <= 2 * 18
    assert rects.rect_join(ps, bs.limit(0), "x", "y").count() == rects.rect_join(ps.limit(0), bs, "x", "y").count() == 0


def plain_lloyd(rows, k, rounds):
    """{id: cluster} of rows (id, group, x, y) by loops."""
    out = {}
    for g in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == g and all(v is not None and v == v for v in r[2:])]
        out |= {r[0]: None for r in rows if r[1] == g}
        if not mine:
            continue
        ends = [(min(r[c] for r in mine), max(r[c] for r in mine)) for c in (2, 3)]
        at = {r[0]: tuple(int((r[c] - lo) / (hi - lo) * (1 << 20) // 1) if hi > lo else 0 for c, (lo, hi) in zip((2, 3), ends, strict=True)) for r in mine}
        d = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
        m = [min(at.values())]
        while len(m) < k and (far := max((min(d(v, c) for c in m), v) for v in at.values()))[0] > 0:
            m.append(far[1])
        near = lambda v: min((d(v, c), i) for i, c in enumerate(m))[1]
        for _ in range(rounds):
            groups = {}
            for v in at.values():
                groups.setdefault(near(v), []).append(v)
            new = [tuple(sum(c) // len(c) for c in zip(*groups[i], strict=True)) if i in groups else c for i, c in enumerate(m)]
            if new == m:
                break
            m = new
        order = sorted(range(len(m)), key=lambda i: (m[i], i))
        out |= {i: order.index(near(v)) for i, v in at.items()}
    return out


@pytest.mark.parametrize("few", [10_000, 0])
def test_lloyd_is_the_plain_version(spark, few, monkeypatch):
    """One group has nine tenths of the rows; centres by broadcast and by shuffle."""
    monkeypatch.setattr(clustering, "FEW_GROUPS", few)
    rng = random.Random(2)
    rows = [(i, None if i % 97 == 0 else 0 if i % 10 else i % 7 + 1, rng.choice([0.0, 10.0, 20.0]) + rng.random(), rng.random() * 3) for i in range(700)]
    rows += [(1000, 50, 1.0, 2.0), (1001, 51, None, 1.0), (1002, 0, NAN, 1.0), (1003, 52, 4.0, 4.0), (1004, 52, 4.0, 4.0)]
    df = spark.createDataFrame(rows, "id long, g int, x double, y double").repartition(5)
    got = {r.id: r.cluster for r in clustering.lloyd(df, ["g"], ["x", "y"], 3, rounds=8).collect()}
    assert got == plain_lloyd(rows, 3, 8)
