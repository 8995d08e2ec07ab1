"""Solvers and flow against plain NumPy, and what they have to conserve."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rillflow.operators import clustering, column, flow, routing, sequence, wateruse

RNG = np.random.default_rng(42)


def test_moisture_potential(spark):
    n = 100
    t = pd.DataFrame({"u": range(n), "theta": RNG.uniform(0.05, 0.5, n), "r": 0.1, "s": 0.5001, "b": RNG.uniform(3, 8, n), "p": 0.1})
    got = spark.createDataFrame(t).select("u", flow.moisture_potential(*map(F.col, ("theta", "r", "s", "b", "p"))).alias("x")).toPandas().sort_values("u").x.to_numpy()
    th = np.maximum(t.theta, 1.01 * 0.1)
    assert np.allclose(got, 0.1 * ((th - 0.1) / (0.5001 - 0.1)) ** -t.b, rtol=1e-10)


def test_conductivity(spark):
    n = 100
    t = pd.DataFrame({"u": range(n), "k": 1e-3 * RNG.uniform(1e-6, 1, n), "p": RNG.uniform(0.01, 1, n), "b": RNG.uniform(3, 8, n), "psi": RNG.uniform(0.001, 1e4, n)})
    got = spark.createDataFrame(t).select("u", flow.conductivity(*map(F.col, ("psi", "k", "p", "b"))).alias("x")).toPandas().sort_values("u").x.to_numpy()
    assert np.allclose(got, t.k * (t.psi / t.p) ** (-2 - 3 / t.b), rtol=1e-10)


def test_divergence_is_the_dense_one_and_conserves_water(spark):
    n = 60
    w = RNG.uniform(0, 1, (n, n)) * (RNG.random((n, n)) < 0.2)
    w = 15 * (w + w.T)
    np.fill_diagonal(w, 0)
    area, h, t = RNG.uniform(900, 90000, n), RNG.uniform(0, 1000, n), RNG.uniform(0, 1e-3, n)
    t[3] = t[5] = 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        dx = (area[None, :] / w + area[:, None] / w.T) / 2
        that = np.where(t[:, None] + t > 0, 2 * t[:, None] * t / (t[:, None] + t), 0)
        flux = np.where(w > 0, -1000 * that * (h[:, None] - h) / dx * w / area, 0)
    units = spark.createDataFrame(pd.DataFrame({"g": 1, "u": range(n), "layer": 0, "head": h, "trans": t, "area": area}))
    edges = spark.createDataFrame([(1, int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w))], "g long, src long, dst long, w double")
    e = flow.interface_width(edges, units, ["g"], "u", "area")
    got = flow.divergence(units, e, ["g"], "u", "layer", "head", "trans", "area").toPandas().set_index("u").hdiv
    assert np.allclose(got.reindex(range(n)).fillna(0), flux.sum(0), rtol=1e-9, atol=1e-12)
    assert abs((got * area[got.index]).sum()) < 1e-6 * np.abs(got * area[got.index]).sum()


def test_convolution_keeps_water_and_shifts(spark):
    runoff = spark.createDataFrame([("a", 0, 1.0), ("a", 4, 2.0), ("b", 1, 3.0)], "k string, t long, v double")
    kernel = spark.createDataFrame([(k, i, w) for k in "ab" for i, w in enumerate((0.1, 0.2, 0.3, 0.25, 0.15))], "k string, lag long, w double")
    got = {(r.k, r.t): r.routed for r in sequence.convolve(runoff, kernel, ["k"], "t", "v", "lag", "w").collect()}
    assert sum(got.values()) == pytest.approx(6.0) and got["a", 4] == pytest.approx(0.15 + 0.2) and got["b", 2] == pytest.approx(0.6)
    old = {r.t: r.routed for r in sequence.convolve(runoff.where("k = 'b'"), kernel, ["k"], "t", "v", "lag", "w", legacy_queue=True).collect()}
    assert [round(old[t] / 3, 6) for t in sorted(old)] == [0.1, 0.3, 0.25, 0.15]


def network(n=40):
    return np.array([-1] + [int(RNG.integers(0, i)) for i in range(1, n)])


@pytest.mark.parametrize("implicit", [False, True])
def test_kinematic_wave_keeps_water(implicit):
    down = network()
    n = len(down)
    area, length, q = RNG.uniform(1, 5, n), RNG.uniform(800, 1500, n), RNG.uniform(0, 1e-3, n)
    u = RNG.uniform(0.2, 1.5, n)
    now, mean = routing.kinematic(area, down, length, q, np.zeros(n), 100.0, 36, lambda a: u, implicit)
    out = mean[0] * 3600 if implicit else None
    gained = (now * length).sum() - (area * length).sum()
    if implicit:
        assert gained == pytest.approx((q * length).sum() * 3600 - out)
    else:  # the explicit scheme's outflow of a step is that of its beginning
        a, lost = area.copy(), 0.0
        for _ in range(36):
            lost += a[0] * u[0] * 100
            a, _ = routing.kinematic(a, down, length, q, np.zeros(n), 100.0, 1, lambda x: u)
        assert np.allclose(a, now) and gained == pytest.approx((q * length).sum() * 3600 - lost)


def test_cycles_raise():
    with pytest.raises(ValueError):
        routing._heads_first(np.array([1, 0, -1]))


def test_conveyance_levels():
    s = routing.Sections([[0, 10, 20]], [[5, 9, 9]], [[0, 0, 15]], [[0, 0, 8]], [[10, 20, 30]], [[1, 2, 3]], [0.03], [0.05])
    for a in (0.5, 9.9, 10.0, 22.0, 60.0):
        j = int(s.level(np.array([a]))[0])
        h = s.rise(np.array([a]), np.array([j]))[0]
        width = 10 if j == 0 else s.below[0, j]
        assert s.total[0, j] + width * h + (0 if j == 0 else h * h / s.m[0, j]) == pytest.approx(a)
    kc, kf = (np.array([s.conveyance(np.array([a]))[i][0] for a in (1.0, 5.0, 20.0, 60.0)]) for i in (0, 1))
    assert (np.diff(kc) > 0).all() and kf[0] == kf[1] == 0 and kf[3] > 0
    assert (s.velocity(np.array([0.0]), np.array([0.0])) == routing.U_LOW).all()


def test_compound_sections_route(spark):
    rows = [(1, i, i // 2 if i > 1 else None, 1000.0, 0.002, 5.0, 1e-4, 0.0, [0.0, 10.0, 20.0], [5.0, 9.0, 9.0], [0.0, 0.0, 15.0], [0.0, 0.0, 8.0], [10.0, 20.0, 30.0], [1.0, 2.0, 3.0], 0.03, 0.05) for i in range(1, 20)]
    df = spark.createDataFrame(rows, "comp long, r long, down long, length double, slope double, area double, q_lat double, boundary double, Ac array<double>, Pc array<double>, Af array<double>, Pf array<double>, W array<double>, M array<double>, manning double, manning_floodplain double")
    got = routing.route(df, "comp", "r", "down", 100.0, 36).toPandas()
    assert len(got) == 19 and (got.area >= 0).all() and (got.q >= 0).all()


def test_tridiagonal():
    low, mid, up, rhs = RNG.random((7, 9)), RNG.random((7, 9)) + 3, RNG.random((7, 9)), RNG.random((7, 9))
    got = column.tridiagonal(low, mid, up, rhs)
    for i in range(7):
        m = np.diag(mid[i]) + np.diag(low[i, 1:], -1) + np.diag(up[i, :-1], 1)
        assert np.allclose(got[i], np.linalg.solve(m, rhs[i]))


def test_columns_keep_water_and_heat(spark):
    n, k = 50, 10
    dz = np.tile(np.linspace(0.05, 0.5, k), (n, 1))
    theta = RNG.uniform(0.1, 0.44, (n, k))
    one = lambda lo, hi: RNG.uniform(lo, hi, (n, 1))
    smax, tr, hd = np.full((n, k), 0.45), np.full((n, k), 1e-9), RNG.uniform(-1e-9, 1e-9, (n, k))
    infil, evap = RNG.uniform(0, 5e-6, n), np.full(n, 1e-8)
    b, dsat, ksat = one(3, 8), one(1e-6, 1e-5), one(1e-7, 3e-6)
    new, drained, excess = column.soil_water(theta, dz, b, dsat, ksat, smax, infil, evap, tr, hd, 3600.0)
    change = ((new - theta) * dz).sum(1)
    assert np.allclose(change, 3600 * (infil - evap - tr.sum(1) - hd.sum(1) - drained - excess), atol=1e-12)
    assert (new <= 0.45 + 1e-12).all()
    temp, cap, cond = RNG.uniform(270, 300, (n, k)), np.full((n, k), 2e6), RNG.uniform(0.3, 2, (n, k))
    t2, out = column.soil_heat(temp, dz, cap, cond, RNG.uniform(-50, 50, n) * 0 + 20.0, 285.0, 8.0, 3600.0)
    assert np.allclose(((t2 - temp) * dz * cap).sum(1), 3600 * (20.0 - out), rtol=1e-6)
    pdf = pd.DataFrame({"u": range(n), "theta": theta.tolist(), "dz": dz.tolist(), "smax": smax.tolist(), "transp": tr.tolist(), "hdiv": hd.tolist(), "b": b[:, 0], "dsat": dsat[:, 0], "ksat": ksat[:, 0], "infil": infil, "evap": evap})
    got = column.step_columns(spark.createDataFrame(pdf), ["u"], 3600.0).toPandas().sort_values("u")
    assert np.allclose(np.stack(got.theta), new) and np.abs(got.water_error).max() < 1e-12


def test_clusters_are_stable(spark):
    pts = [(g, float(x + RNG.normal(0, 0.01)), float(y)) for g in (1, 2) for x, y in itertools.product((0, 5, 10), (0, 1)) for _ in range(5)]
    df = spark.createDataFrame(pts, "g long, x double, y double")
    got = clustering.grouped_kmeans(df, ["g"], ["x"], 3).toPandas()
    assert all(got[(got.g == g) & (got.x.round() == x)].cluster.nunique() == 1 for g in (1, 2) for x in (0, 5, 10))
    scaled = clustering.min_max(df.withColumn("c", F.lit(3.0)), ["x", "c"]).toPandas()
    assert scaled.scaled_x.min() == 0 and scaled.scaled_x.max() == 1 and (scaled.scaled_c == 0).all()


def test_allocation_is_the_cheapest(spark):
    links = [(1, "s1", "d1", 5.0, 4.0, -10.0), (1, "s1", "d2", 5.0, 4.0, -9.0), (1, "s2", "d1", 3.0, 4.0, -8.0), (2, "s9", "d9", 1.0, 7.0, 1.0)]
    got = {(r.s, r.d): r.flow for r in wateruse.allocate(spark.createDataFrame(links, "c long, s string, d string, a double, n double, k double"), "c", "s", "d", "a", "n", "k").collect()}
    best = max(((x + y + z, 10 * x + 9 * y + 8 * z, (x, y, z)) for x in np.arange(0, 4.5, 0.5) for y in np.arange(0, 4.5, 0.5) for z in np.arange(0, 3.5, 0.5) if x + y <= 5 and x + z <= 4))
    assert (got.get(("s1", "d1"), 0), got.get(("s1", "d2"), 0), got.get(("s2", "d1"), 0)) == best[2] and got["s9", "d9"] == 1.0


def test_large_allocation_is_the_cheapest_in_any_order(spark):
    """No way is left from a supply with something left to a demand that wants more, and no cycle saves cost."""
    rng = np.random.default_rng(4)
    kind, links = "c long, s long, d long, a double, n double, k double", []
    for c, costs in ((1, lambda n: rng.integers(0, 50, n).astype(float)), (2, lambda n: rng.normal(size=n) * 1e4)):
        give, need = rng.uniform(-1, 40, 60).round(2), rng.uniform(-1, 8, 700).round(3)
        pairs = [(s, d) for s in range(60) for d in range(700) if abs(s / 60 - d / 700) < 0.05]
        links += [(c, s, d, float(give[s]), float(need[d]), float(k)) for (s, d), k in zip(pairs, costs(len(pairs)), strict=True)]
    got = sorted(map(tuple, wateruse.allocate(spark.createDataFrame(links, kind), "c", "s", "d", "a", "n", "k").collect()))
    assert got == sorted(map(tuple, wateruse.allocate(spark.createDataFrame(links[::-1], kind).repartition(7), "c", "s", "d", "a", "n", "k").collect()))
    for c in (1, 2):
        flow = {(s, d): f for g, s, d, f in got if g == c}
        own = [x[1:] for x in links if x[0] == c]
        left, want = {s: max(a, 0) for s, _, a, _, _ in own}, {d: max(n, 0) for _, d, _, n, _ in own}
        for (s, d), f in flow.items():
            left[s], want[d] = left[s] - f, want[d] - f
        assert min(*left.values(), *want.values()) > -1e-9 and min(flow.values()) > 0
        # nodes 0-59 supplies, 60-759 demands, 760 whatever has something left, 761 whatever lacks something
        arcs = [(s, 60 + d, k) for s, d, _, _, k in own] + [(60 + d, s, -k) for s, d, _, _, k in own if (s, d) in flow]
        arcs += [(760, s, 0.0) for s, v in left.items() if v > 1e-9] + [(60 + d, 761, 0.0) for d, v in want.items() if v > 1e-9]
        used = {d for _, d in flow}
        arcs += [(s, 760, 0.0) for s in {s for s, _ in flow}] + [(761, 60 + d, 0.0) for d in used]
        x, y, k = (np.array(v) for v in zip(*arcs, strict=True))
        dist = np.zeros(762)
        for _ in range(762):
            was = dist.copy()
            np.minimum.at(dist, y, dist[x] + k)
            if (dist >= was - 1e-6).all():
                break
        assert (dist >= was - 1e-6).all()
        reached = {760}
        while more := set(y[np.isin(x, list(reached))].tolist()) - reached:
            reached |= more
        assert 761 not in reached and any(v > 1e-9 for v in want.values())


@pytest.mark.parametrize("most", [9.0, 60.0])
def test_allocation_over_few_links_is_that_over_all(spark, monkeypatch, most):
    """Prices bring back the links that are missing; all pairs are never stored, so that no task holds them."""
    rng = np.random.default_rng(6)
    give, need = rng.uniform(1, 40, 40).round(2), rng.uniform(0.1, most, 300).round(3)
    supplies = spark.createDataFrame([(1, s, float(give[s])) for s in range(40)] + [(2, 7, 5.0), (3, 7, float("nan"))], "c long, s long, a double")
    demands = spark.createDataFrame([(1, d, float(need[d])) for d in range(300)] + [(2, 7, 3.0), (3, 7, 3.0), (4, 7, 3.0)], "c long, d long, n double")
    # dear where supplies are near, so that the cheapest links of a demand often don't have its own
    cost = F.abs(F.xxhash64("s", "d") % 100_003) / 100.0 + F.when(F.abs(F.col("s") * 7.5 - F.col("d")) < 60, 500.0).otherwise(0.0)
    reach = lambda s, d: s.join(d, "c").where("abs(s * 7.5 - d) < 110").withColumn("k", cost)
    names, sizes, plain = ("c", "s", "d", "a", "n", "k"), [], wateruse.stored
    links = reach(supplies, demands)

    def stored(df):
        sizes.append((out := plain(df)).count())
        return out

    costs = {tuple(r[:3]): r.k for r in links.select("c", "s", "d", "k").collect()}
    monkeypatch.setattr(wateruse, "stored", stored)
    found = []
    for few in (2, 64):
        sizes.clear()
        found.append({tuple(r[:3]): r.flow for r in wateruse.allocate_between(supplies, demands, reach, *names, few=few).collect()})
        assert few > 2 or max(sizes) < len(costs) / 4
    few, every = ((sum(f.values()), sum(f[k] * costs[k] for k in f)) for f in found)
    assert few == pytest.approx(every, rel=1e-9) and {k[0] for k in found[0]} == {1, 2}
    monkeypatch.undo()
    same = {tuple(r[:3]): r.flow for r in wateruse.allocate(links, *names).collect()}
    assert sum(f * costs[k] for k, f in same.items()) == pytest.approx(every[1], rel=1e-9)


def test_abstraction_takes_the_well_first(spark):
    df = spark.createDataFrame([(5.0, [1.0, 2.0, 1.5, 4.0], 2), (99.0, [1.0, 2.0, 1.5, 4.0], 1), (0.0, [1.0], 0)], "a double, v array<double>, w int")
    got = [r.x for r in df.select(wateruse.abstract_layers(F.col("a"), F.col("v"), F.col("w")).alias("x")).collect()]
    assert got == [[1.0, 2.0, 1.5, 0.5], [1.0, 2.0, 1.5, 4.0], [0.0]]


def test_nearest_value_against_numpy(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    from rillflow.operators import joins

    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(size=4000).round(2), np.full(3000, 0.5), np.nan]
    y = np.r_[rng.normal(size=1500).round(2), np.full(500, 7.0)]
    left = spark.createDataFrame(pd.DataFrame({"g": np.arange(len(x)) % 3, "a": np.arange(len(x)), "x": x})).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    right = spark.createDataFrame(pd.DataFrame({"g": np.arange(len(y)) % 2, "b": np.arange(len(y)), "y": y}))
    for keys in ((), ("g",)):
        got = {r.a: (r.b, r.distance) for r in joins.nearest_value(left, right, "a", "b", "x", "y", keys).collect()}
        assert len(got) == len(x)
        for a, v in enumerate(x):
            own = np.flatnonzero(np.arange(len(y)) % 2 == a % 3) if keys else np.arange(len(y))
            if np.isnan(v) or not len(own):
                assert got[a] == (None, None)
            else:
                d = np.abs(y[own] - v)
                assert got[a] == (own[d == d.min()].min(), pytest.approx(d.min()))


def test_near_pairs_at_poles_and_the_date_line(spark):
    import itertools

    from rillflow.operators import joins

    rng = np.random.default_rng(4)
    rows = [(i, 0, float(a), float(o)) for i, (a, o) in enumerate(zip(rng.choice([-89.9, 89.8, 0.0, 45.0], 120) + rng.normal(0, 0.3, 120).clip(-0.1, 0.1), rng.choice([-179.9, 179.9, 0.0, 30.0], 120) + rng.normal(0, 0.3, 120).clip(-0.1, 0.1), strict=True))]
    units = spark.createDataFrame(rows, "u long, g int, lat double, lon double")
    got = {(r.a, r.b): r.km for r in joins.near_pairs(units, "u", "lat", "lon", ["g"], 25.0).collect()}
    xyz = [(np.cos(np.radians(a)) * np.cos(np.radians(o)), np.cos(np.radians(a)) * np.sin(np.radians(o)), np.sin(np.radians(a))) for *_, a, o in rows]
    km = {(i, j): 2 * 6371 * np.arcsin(min(1, np.linalg.norm(np.subtract(xyz[i], xyz[j])) / 2)) for i, j in itertools.combinations(range(120), 2)}
    assert got.keys() == {k for k, d in km.items() if d <= 25.0} and len(got) > 50
    assert all(got[k] == pytest.approx(km[k], abs=1e-5) for k in got)


def test_terminals_of_long_ways_and_hot_ends(spark):
    from rillflow.operators import graph

    rng = np.random.default_rng(5)
    down = {0: None, 1: None, 2: 99_999}
    for i in range(3, 700):
        down[i] = i - 1 if i < 300 else int(rng.integers(0, i))
    want = {}
    for i in down:
        at, n = i, 0
        while down.get(at) is not None:
            at, n = down[at], n + 1
        want[i] = (at, float(n))
    nodes = spark.createDataFrame(list(down.items()), "n long, d long")
    assert {r.n: (r.terminal, r.length) for r in graph.terminals(nodes, "n", "d").collect()} == want


def test_long_rivers_go_one_reach_after_another(monkeypatch):
    """As by arrays, to the last bit, with side streams, losses and a given order; a chain of 20,000 is quick."""
    import time

    n = 500
    down = np.array([i - 1 if i % 7 else max(-1, i - 7) for i in range(n)])
    area, length, q, b = RNG.uniform(0, 3, n), RNG.uniform(50, 500, n), RNG.uniform(-2e-2, 1e-2, n), RNG.uniform(0, 0.1, n)
    run = lambda **k: routing.kinematic(area, down, length, q, b, 100.0, 12, lambda a: np.clip(a ** (2 / 3), 0.1, 2.0), True, **k)
    one = run(order=routing._heads_first(down))
    monkeypatch.setattr(routing, "FEW_AT_ONCE", 0)
    many = run()
    assert all((x == y).all() for x, y in zip(one, many, strict=True)) and (one[0] == 0).any() and (one[0] > 0).any()
    monkeypatch.undo()
    m = 20_000
    chain = np.arange(m) - 1
    order, began = routing._heads_first(chain), time.process_time()
    routing.kinematic(np.ones(m), chain, np.full(m, 90.0), np.full(m, 1e-6), np.zeros(m), 100.0, 20, lambda a: np.full(m, 1.0), True, order=order)
    assert time.process_time() - began < 3  # some 6 s by arrays
