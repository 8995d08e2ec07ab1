"""River networks against plain walks: stars, paths, random forests, ids and rows in any order."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rillflow.operators import graph, rivers

SCHEMA = "r long, down long, len decimal(10,2)"


def forest(n, seed, near=None, roots=3):
    """Nodes that drain to one of the ``near`` before them (all, if None), with shuffled ids."""
    rng = random.Random(seed)
    ids = rng.sample(range(-5, 10 * n), n)
    rows = [(ids[i], None if i < roots else ids[rng.randrange(max(0, i - near) if near else 0, i)], Decimal(rng.randrange(0, 500)) / 4) for i in range(n)]
    rng.shuffle(rows)
    return rows


def comb(n):
    """A path with a source beside each node: every confluence has one long and one short arm."""
    return [(2 * i, 2 * (i - 1) if i else None, Decimal(1)) for i in range(n)] + [(2 * i + 1, 2 * i, Decimal(2)) for i in range(n)]


CASES = {
    "forest": forest(400, 1), "deep": forest(300, 2, 3), "path": [(i, i - 1 if i else None, Decimal(i)) for i in range(300)], "star": [(i, 0 if i else None, Decimal(1)) for i in range(200)],
    "comb": comb(100), "one": [(5, None, Decimal(3))], "out of the table": [(1, 99, Decimal(1)), (2, 1, Decimal(2)), (3, 1, None)], "binary": [(i, i // 2 or None, Decimal(i)) for i in range(1, 256)],
}


def together(names):
    """Networks side by side in one table, so that a test runs once over all of them."""
    out = []
    for k, name in enumerate(names):
        out += [(r + 100_000 * k, None if d is None else d + 100_000 * k, x) for r, d, x in CASES[name]]
    random.Random(0).shuffle(out)
    return out


EVERY = together(CASES)


def inflows(rows):
    ids, ups = {r for r, *_ in rows}, {}
    for r, d, _ in rows:
        if d in ids:
            ups.setdefault(d, []).append(r)
    return {r: (d if d in ids else None) for r, d, _ in rows}, ups


def plain_reaches(rows):
    down, ups = inflows(rows)
    member, last = {}, {}
    for r in down:
        if len(ups.get(r, [])) != 1:
            at, k = r, 0
            while True:
                member[at], last[r] = (r, k), (at, k)
                at, k = down[at], k + 1
                if at is None or len(ups[at]) != 1:
                    break
    order = {}
    for r in sorted(down, key=lambda r: -depth(r, down)):
        got = sorted((order[u] for u in ups.get(r, [])), reverse=True)
        order[r] = 1 if not got else got[0] + (len(got) > 1 and got[0] == got[1])
    return member, last, order


def depth(r, down):
    k = 0
    while (r := down[r]) is not None:
        k += 1
    return k


def test_reach_topology(spark):
    rows = EVERY
    member, last, order = plain_reaches(rows)
    down, _ = inflows(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert {r.r: (r.reach, r.position) for r in rivers.reach_members(df, "r", "down").collect()} == member
    got = {r.reach: (r["last"], r.n, r.length, r.down_reach, r.strahler) for r in rivers.reach_topology(df, "r", "down", "len").collect()}
    length = {}
    for r, _, x in rows:
        length.setdefault(member[r][0], []).extend([x] if x is not None else [])
    want = {r: (at, k + 1, sum(length[r]) if length[r] else None, down[at] and member[down[at]][0] if down[at] is not None else None, order[at]) for r, (at, k) in last.items()}
    assert got == want


def test_nested_sums(spark):
    rows = EVERY
    down, ups = inflows(rows)
    own = {r: x or Decimal(0) for r, _, x in rows}
    n, total = {}, {}
    for r in sorted(down, key=lambda r: -depth(r, down)):
        n[r] = 1 + sum(n[u] for u in ups.get(r, []))
        total[r] = own[r] + sum(total[u] for u in ups.get(r, []))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = rivers.nested_sums(df, "r", "down", {"area": F.col("len"), "id": F.col("r")}).collect()
    assert {r.r: (r.n, r.area) for r in got} == {r: (n[r], total[r]) for r in down}


@pytest.mark.parametrize(("most_reaches", "most_time"), [(0, 0.0), (0, 200.0), (4, 150.0), (10**6, 0.0)])
def test_upstream_travel(spark, most_reaches, most_time):
    rows = together(["forest", "deep", "path", "comb"])
    _, ups = inflows(rows)
    own = {r: x for r, _, x in rows}
    roots = [r for i, (r, *_) in enumerate(sorted(rows)) if i % 7 == 0]
    want, stack = set(), [(r, r, 0, Decimal(0)) for r in roots]
    while stack:
        root, at, k, x = stack.pop()
        stop = k > 0 and k >= most_reaches and x / 2 >= most_time
        want.add((root, at, k, x, stop))
        stack += [] if stop else [(root, u, k + 1, x + own[u]) for u in ups.get(at, [])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = rivers.upstream_travel(df, "r", "down", "len", spark.createDataFrame([(r,) for r in roots], "r long"), most_reaches, most_time, 2.0)
    assert {tuple(r) for r in got.select("root", "r", "reaches", "length", "stopped").collect()} == want


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert rivers.reach_topology(none, "r", "down").count() == rivers.nested_sums(none, "r", "down", {}).count() == 0
    assert rivers.upstream_travel(none, "r", "down", "len", none.select("r")).count() == 0


def test_a_cycle_raises(spark, monkeypatch):
    monkeypatch.setattr(rivers, "ROUNDS", 3)
    df = spark.createDataFrame([(1, 2, None), (2, 3, None), (3, 1, None), (4, 1, None)], SCHEMA)
    with pytest.raises(ValueError, match="cycle"):
        rivers.ways(df, "r", "down")
    with pytest.raises(ValueError, match="cycle"):
        rivers.strahler(df, "r", "down")


def test_a_long_path_takes_few_joins(spark):
    """10,000 steps: as many rounds as the logarithm says, no level by level."""
    df = spark.range(10_000).selectExpr("id AS r", "CASE WHEN id > 0 THEN id - 1 END AS down", "cast(1 AS decimal(10,2)) AS len")
    roots = df.where("r % 2500 = 0").select("r")
    got = rivers.upstream_travel(df, "r", "down", "len", roots, most_reaches=4000).groupBy("root").agg(F.count("*").alias("n"), F.sum(F.col("stopped").cast("int")).alias("stopped")).collect()
    assert {r.root: (r.n, r.stopped) for r in got} == {0: (4001, 1), 2500: (4001, 1), 5000: (4001, 1), 7500: (2500, 0)}


def test_levels_of_deep_wide_and_broken_trees(spark):
    """A chain of 300, a star, a way out of the table, a cycle and what runs into it; no level is broadcast."""
    rows = [(i, i - 1 if i else None) for i in range(300)] + [(1000 + i, 7) for i in range(50)] + [(2000, None), (2001, 9999), (2002, 2001), (3000, 3001), (3001, 3000), (3002, 3001)]
    df = spark.createDataFrame(rows, "n long, d long").repartition(4)
    got = graph.levels(df, "n", "d")
    want = {(0, i, i) for i in range(300)} | {(0, 1000 + i, 8) for i in range(50)} | {(2000, 2000, 0)}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert graph.levels(df.limit(0), "n", "d").count() == 0
