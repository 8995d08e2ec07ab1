"""The synthetic catchment, end to end."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.plans import catchment

DZ = [0.05 * (k + 1) for k in range(10)]
SOILS = {0: (2.79, 0.069, 1e-5, 4.7e-5, 0.339, 0.010), 1: (4.74, 0.141, 5.1e-6, 5.2e-6, 0.434, 0.047), 2: (8.17, 0.263, 1.1e-5, 2.5e-6, 0.404, 0.067)}


@pytest.fixture(scope="module")
def tables(spark):
    """12 x 12 pixels, two catchments side by side, a channel along row 6 that runs from the
    left one into the right one, missing values and sentinels."""
    rows = []
    for i in range(12):
        for j in range(12):
            dem = 100.0 - 2 * j + 6 * abs(i - 6) + 15 * np.exp(-((i - 2) ** 2 + (j - 3) ** 2) / 6)
            fdir = 1 if i == 6 else 4 if i < 6 else 64
            acc = 8100.0 * (12 * (j + 1) if i == 6 else (i + 1 if i < 6 else 12 - i))
            soil = list(SOILS[(i // 4 + j // 6) % 3])
            if (i, j) == (1, 1):
                soil[4] = float("nan")
            lc = -9999 if (i, j) in ((0, 0), (3, 3)) else (4, 10, 13, 17)[(i + j) % 4]
            rows.append((1 if j < 6 else 2, i, j, 40.0 + i / 100, -100.0 + j / 100, -9999.0 if (i, j) == (11, 11) else float(dem), fdir, float(acc), lc, *soil))
    df = spark.createDataFrame(rows, "cid long, i long, j long, lat double, lon double, dem double, fdir int, acc double, lc long, BB double, SATPSI double, SATDW double, SATDK double, MAXSMC double, DRYSMC double")
    return catchment.prepare(df, band_height=12.0, threshold=8100.0 * 11)


def forcing(spark, tables, hours=48):
    u = tables["units"].select("cid", "hru").join(tables["components"], "cid")
    s = F.col("step")
    f = u.crossJoin(spark.range(hours).withColumnRenamed("id", "step"))
    sun = F.greatest(F.lit(0.0), F.sin((s % 24 - 6) * np.pi / 12)) * 600
    cold = F.when((s >= 24) & (s < 34), 265.0).otherwise(288.0)
    rain = F.when((s >= 4) & (s < 10), 5.0 / 3600).when((s >= 26) & (s < 30), 1.0 / 3600).otherwise(0.0)
    return f.select("component", "cid", "hru", "step", F.lit(300.0).alias("lwdown"), sun.alias("swdown"), cold.alias("tair"), rain.alias("precip"), F.lit(95000.0).alias("psurf"), F.lit(2.0).alias("wind"), F.lit(0.002).alias("spfh"))


def test_preparation(spark, tables):
    u = tables["units"].toPandas()
    assert u.area.sum() == pytest.approx(144 * 8100) and (u.groupby("cid").area_pct.sum().round(6) == 100).all()
    assert u[["dem", "hand", "MAXSMC", "SATDK", "lc"]].notna().all().all() and (u.hand >= 0).all()
    r = tables["reaches"].toPandas()
    assert len(r) == 12 and r.down.notna().sum() == 11
    assert {x.component for x in tables["components"].collect()} == {1}
    e = {(x.cid, x.src, x.dst): x.w for x in tables["edges"].collect()}
    assert e and all(e[c, b, a] == w for (c, a, b), w in e.items())
    assert tables["uh"].groupBy("cid", "hru").agg(F.sum("density").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    rb = tables["reach_band"].toPandas()
    assert rb.area.sum() == pytest.approx(144 * 8100)


def test_a_storm_and_a_frost(spark, tables):
    names = ("theta", "swe", "runoff", "routed", "evaporation", "hdiv", "q", "section", "water_error", "energy_error")
    out = catchment.simulate(forcing(spark, tables), catchment.structure(tables, DZ), outputs=names).toPandas()
    v = {n: out[out.name == n].pivot_table(index="step", columns=["cid", "id"], values="value") for n in names}
    assert v["water_error"].abs().max().max() < 1e-8 and v["energy_error"].abs().max().max() < 1e-3
    assert v["swe"].loc[29].min() > 0 and v["swe"].loc[20].max() == 0
    assert (v["theta"] > 0).all().all() and v["runoff"].loc[9].max() > v["runoff"].loc[3].max() and v["q"].loc[10].max() > v["q"].loc[3].max()
    area = tables["units"].toPandas().set_index(["cid", "hru"]).area
    assert abs((v["hdiv"] * area).sum(axis=1)).max() < 1e-6
    # the channel takes what the hillslopes give
    assert v["q"].min().min() >= 0


def test_segments_are_the_whole(spark, tables):
    f = forcing(spark, tables, 12).cache()
    whole = catchment.simulate(f, catchment.structure(tables, DZ)).where("kind != 'state'").drop("state")
    parts = list(catchment.run_segments(f, tables, DZ, [(0, 6), (6, 12)]))
    key = lambda r: (r.kind, r.cid, r.id, r.step, r.name)
    a, b = ({key(r): r.value for r in rows} for rows in (whole.collect(), [r for p in parts for r in p.collect()]))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-12, abs=1e-15) for k in a)


def test_maps_and_balances(spark, tables):
    out = catchment.simulate(forcing(spark, tables, 6), catchment.structure(tables, DZ), outputs=("theta",))
    m = catchment.regrid(tables["pixels"], out, 40.0, -100.0, 0.04).toPandas()
    assert len(m) == 9 * 6 and m.value.between(0.1, 0.45).all()
    b = catchment.balances(out, tables["units"]).toPandas()
    assert len(b) == 12 and b.running.max() > b.value.max()


def test_missing_forcing_raises(spark, tables):
    f = forcing(spark, tables, 2).where("NOT (step = 1 AND hru = 0)")
    with pytest.raises(Exception, match="has forcing for"):
        catchment.simulate(f, catchment.structure(tables, DZ)).collect()
