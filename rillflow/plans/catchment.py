"""Preparation, simulation and regridding of catchments, end to end.

``prepare`` is one declarative plan from pixels to unit, edge, band and reach tables;
``simulate`` runs the hourly loop of a river component in one group (lateral flow, column,
unit hydrograph, routing, balances) over a segment, and gives its state to the next;
``regrid`` brings unit series to a coarse grid by areal weights.

The order within a step is that of an explicitly coupled model: ponded water, lateral flow
from the soil moisture before, column, routing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import surface
from ..operators import banding, clustering, column, graph, impute, joins, routing, zonal

SOIL = ("BB", "SATPSI", "SATDW", "SATDK", "MAXSMC", "DRYSMC")
FORCING = ("lwdown", "swdown", "tair", "precip", "psurf", "wind", "spfh")


def prepare(pixels: DataFrame, band_height: float = 20.0, clusters: int = 2, size: float = 90.0, threshold: float = 0.0) -> dict[str, DataFrame]:
    """Tables of a set of pixels: cid, i, j (on one grid for all catchments, which may drain into
    each other), dem, fdir (D8), acc (m2), lc, and soil columns
    (nulls are filled with means, or modes for classes)."""
    c = F.col
    continuous = ["dem", "acc", *SOIL]
    px = impute.sentinel_to_null(pixels, [x for x in (*continuous, "lc") if x in pixels.columns])
    px = impute.mode_impute(impute.mean_impute(px, ["cid"], continuous), ["cid"], ["lc"])
    px = graph.receivers(px, ["cid"], "fdir").withColumn("pid", c("i") * 1_000_000 + c("j")).withColumn("to", c("to_i") * 1_000_000 + c("to_j"))
    px = px.join(px.select(c("pid").alias("to"), F.lit(True).alias("__in")), "to", "left").withColumn("to", F.when(c("__in"), c("to"))).drop("__in")
    # channels: pixels end at the first channel pixel on their way
    px = px.withColumn("channel", impute.initiate(c("acc"), threshold))
    ends = graph.terminals(px.withColumn("stop", F.when(~c("channel"), c("to"))).withColumn("step", F.lit(size)), "pid", "stop", "step")
    px = px.join(ends.withColumnRenamed("length", "distance"), "pid")
    base = px.select(c("pid").alias("terminal"), c("dem").alias("__base"))
    px = px.join(base, "terminal").withColumn("hand", F.greatest(c("dem") - c("__base"), F.lit(0.0))).drop("__base")
    px = banding.height_bands(px, ["cid"], "hand", band_height, name="band")
    px = clustering.lloyd(graph.stored(px), ["cid", "band"], ["acc", "MAXSMC"], clusters)
    from pyspark.sql import Window

    px = graph.settled(px.withColumn("hru", F.dense_rank().over(Window.partitionBy("cid").orderBy("band", "cluster")) - 1))
    area = size * size
    stats = {"area": F.count("*") * area, "dem": F.avg("dem"), "hand": F.avg("hand"), "band": F.first("band"), "lc": zonal.smallest_mode(c("lc"), 1, 17), **{s: F.avg(s) for s in SOIL if s != "SATDK"}, "SATDK": zonal.harmonic_mean(c("SATDK"), 1.0, zonal.DEFAULT_KSAT)}
    units = zonal.share(zonal.zonal(px, ["cid", "hru"], stats), ["cid"], "area", "area_pct")
    edges = graph.adjacency(px, ["cid"], "hru", edge_length=size)
    # a reach for each channel pixel: where a channel drains over the border it goes on there
    reaches = px.where("channel").select("cid", c("pid").alias("reach"), c("to").alias("down"), F.lit(size).alias("length"), "dem", "acc")
    low = reaches.select(c("reach").alias("down"), c("dem").alias("__d"))
    reaches = reaches.join(low, "down", "left").withColumn("slope", F.greatest(F.coalesce((c("dem") - c("__d")) / size, F.lit(routing.SLOPE_LOW)), F.lit(routing.SLOPE_LOW))).drop("__d")
    reaches = graph.channel_properties(reaches, "acc").withColumn("width", F.greatest("channel_width", F.lit(0.5)))
    reach_band = px.groupBy("cid", c("terminal").alias("reach"), "hru").agg((F.count("*") * area).alias("area"))
    # hours to the channel at 0.1 m/s, as a density over 100 hours
    uh = banding.hist_density(px.withColumn("hours", c("distance") / 0.1 / 3600), ["cid", "hru"], "hours", 0.0, 100.0, 100)
    links = reaches.join(reaches.select(c("reach").alias("down"), c("cid").alias("to_cid")), "down").where("cid != to_cid").select("cid", "to_cid").distinct()
    alone = units.select("cid").distinct()
    comp = alone.join(graph.river_components(links, "cid", "to_cid"), c("cid") == c("node"), "left").select("cid", F.coalesce("component", "cid").alias("component"))
    return {"pixels": px, "units": units, "edges": edges, "reaches": reaches, "reach_band": reach_band, "uh": uh, "components": comp}


def structure(tables: dict[str, DataFrame], dz: list[float], state: DataFrame | None = None) -> DataFrame:
    """A row for each component with its units, edges, reaches and weights as arrays, and its
    state (null: a cold start)."""
    comp = tables["components"]

    def pack(name: str, cols: list[str]) -> DataFrame:
        return tables[name].join(comp, "cid").groupBy("component").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))

    out = pack("units", ["cid", "hru", "area", "hand", "band", *SOIL])
    for name, cols in (("edges", ["cid", "src", "dst", "w"]), ("reaches", ["cid", "reach", "down", "length", "slope", "width"]), ("reach_band", ["cid", "reach", "hru", "area"]), ("uh", ["cid", "hru", "bin", "density"])):
        out = out.join(pack(name, cols), "component", "left")
    out = out.withColumn("dz", F.array(*[F.lit(float(x)) for x in dz]))
    return out.withColumn("state", F.lit(None).cast("binary")) if state is None else out.join(state.select("component", "state"), "component", "left")


OUT = "component long, kind string, cid long, id long, step long, name string, value double, state binary"


class Component:
    """A river component's arrays and its step."""

    def __init__(self, row: pd.Series, dt: float, substep: float = 100.0):
        self.dt, self.substep = dt, substep
        u = pd.DataFrame([r.asDict() if hasattr(r, "asDict") else dict(r) for r in row.units])
        self.u, self.at = u, {(a, b): i for i, (a, b) in enumerate(zip(u.cid, u.hru, strict=True))}
        self.area, self.hand = u.area.to_numpy(float), u.hand.to_numpy(float)
        self.soil = {s: u[s].to_numpy(float) for s in SOIL}
        self.dz = np.tile(np.asarray(row.dz, float), (len(u), 1))
        rows = lambda x: [] if x is None else [r.asDict() if hasattr(r, "asDict") else dict(r) for r in x]
        e = [(self.at[r["cid"], r["src"]], self.at[r["cid"], r["dst"]], r["w"]) for r in rows(row.edges)]
        self.src, self.dst = (np.array([x[k] for x in e], int) for k in (0, 1))
        self.w = np.array([x[2] for x in e], float)
        back = {(a, b): w for a, b, w in e}
        wb = np.array([back.get((b, a), w) for a, b, w in e], float)
        self.dx = (self.area[self.dst] / self.w + self.area[self.src] / wb) / 2 if len(e) else self.w
        r = rows(row.reaches)
        self.reach_ids = [(x["cid"], x["reach"]) for x in r]
        place = {x["reach"]: i for i, x in enumerate(r)}
        self.down = np.array([place.get(x["down"], -1) if x["down"] is not None else -1 for x in r], int)
        self.length, self.slope, self.width = (np.array([x[k] for x in r], float) for k in ("length", "slope", "width"))
        self.order = routing._heads_first(self.down)
        rb = [(place[x["reach"]], self.at[x["cid"], x["hru"]], x["area"]) for x in rows(row.reach_band) if x["reach"] in place]
        self.rb_reach, self.rb_unit = (np.array([x[k] for x in rb], int) for k in (0, 1))
        self.rb_area = np.array([x[2] for x in rb], float)
        self.kernel = np.zeros((len(u), 100))
        for x in rows(row.uh):
            self.kernel[self.at[x["cid"], x["hru"]], x["bin"]] = x["density"]
        total = self.kernel.sum(1, keepdims=True)
        self.kernel = np.where(total > 0, self.kernel / np.where(total > 0, total, 1), np.eye(1, 100))
        if row.state is not None and not (isinstance(row.state, float) and np.isnan(row.state)):
            import io

            z = np.load(io.BytesIO(bytes(row.state)))
            self.s = {k: z[k] for k in z.files}
        else:
            n, k = self.dz.shape
            self.s = {"theta": np.tile(0.6 * self.soil["MAXSMC"][:, None], (1, k)), "temp": np.full((n, k), 283.0), "skin": np.full(n, 278.0), "swe": np.zeros(n), "albedo": np.full(n, 0.55), "queue": np.zeros((n, 100)), "section": np.full(len(r), 1e-3)}

    def packed(self) -> bytes:
        import io

        b = io.BytesIO()
        np.savez(b, **self.s)
        return b.getvalue()

    def lateral(self) -> np.ndarray:
        """What leaves each unit's layers sideways, m/s."""
        theta, s = self.s["theta"], self.soil
        out = np.zeros_like(theta)
        bottom = np.cumsum(self.dz, 1)
        for k in range(theta.shape[1]):
            th = np.maximum(theta[:, k], 1.01 * s["DRYSMC"])
            psi = s["SATPSI"] * ((th - s["DRYSMC"]) / (s["MAXSMC"] - s["DRYSMC"])) ** -s["BB"]
            top = bottom[:, k] - self.dz[:, k]
            t = 2.0 * s["SATDK"] * (psi / s["SATPSI"]) ** (-2 - 3 / s["BB"]) * (np.exp(-top / 2.0) - np.exp(-bottom[:, k] / 2.0))
            h = self.hand - top - psi
            a, b = self.src, self.dst
            both = t[a] + t[b]
            that = np.where(both > 0, 2 * t[a] * t[b] / np.where(both > 0, both, 1), 0.0)
            flux = that * (h[b] - h[a]) / self.dx * self.w  # m3/s out of b
            # no more than a tenth of what a unit has above its residual goes in a step
            most = 0.1 * np.maximum(0.0, theta[:, k] - 1.02 * s["DRYSMC"]) * self.dz[:, k] * self.area / self.dt
            asked = np.bincount(b, np.maximum(flux, 0.0), len(self.area))
            cut = np.where(asked > most, most / np.where(asked > 0, asked, 1), 1.0)
            flux = np.where(flux > 0, flux * cut[b], flux * cut[a])
            out[:, k] = np.bincount(b, flux, len(self.area)) / self.area
        return out

    def step(self, f: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        s, dt, soil = self.s, self.dt, self.soil
        before = (s["theta"] * self.dz).sum(1) * 1000 + s["swe"]
        hdiv = self.lateral()
        snowing = np.clip((275.16 - f["tair"]) / 2.0, 0.0, 1.0)
        snow, rain = f["precip"] * snowing, f["precip"] * (1 - snowing)
        faded = 0.55 + (s["albedo"] - 0.55) * np.exp(-0.01 * dt / 3600)
        s["albedo"] = faded + np.minimum(snow, 1 / dt) * (0.84 - faded) * dt
        cover = s["swe"] / (s["swe"] + 10.0)
        sat = np.clip(s["theta"][:, 0] / soil["MAXSMC"], 0.01, 1.0)
        cond, cap = surface.thermal(s["theta"], soil["MAXSMC"][:, None])
        resist = np.where(s["swe"] > 0, 1.0, np.exp(8.25 - 4.225 * sat))
        albedo = cover * s["albedo"] + (1 - cover) * 0.2
        skin, flux = surface.skin(f["swdown"], f["lwdown"], f["tair"], f["spfh"], f["psurf"], f["wind"], albedo, 0.97, resist, s["temp"][:, 0], 2 * cond[:, 0] / self.dz[:, 0], t0=s["skin"])
        excess = np.where((s["swe"] > 0) & (skin > surface.FREEZE), flux["ground"], 0.0)
        energy = flux["absorbed"] - flux["longwave"] - flux["sensible"] - flux["latent"] - flux["ground"]
        evap = flux["latent"] / surface.LV
        from_snow = np.where(s["swe"] > 0, evap, 0.0)
        s["swe"], melt, short = surface.snow_step(s["swe"], snow, excess, from_snow, dt)
        # soil gives no more than a fifth of what its top has above the residual
        most = 0.2 * np.maximum(0.0, s["theta"][:, 0] - soil["DRYSMC"]) * self.dz[:, 0] * 1000 / dt
        from_soil = np.minimum(np.where(from_snow != 0, short, evap), most)
        water = rain + melt
        deficit = np.maximum(0.0, (soil["MAXSMC"][:, None] - s["theta"]) * self.dz).sum(1)
        px = np.maximum(0.0, water / 1000 * dt)
        dd = deficit * (1 - np.exp(-3.0 * soil["SATDK"] / 2e-6 * dt / 86400))
        infil = np.where(px + dd > 0, np.minimum(px * dd / np.where(px + dd > 0, px + dd, 1) / dt, px / dt), 0.0)
        col = lambda x: x[:, None]
        theta, drained, over = column.soil_water(s["theta"], self.dz, col(soil["BB"]), col(soil["SATDW"]), col(soil["SATDK"]), np.tile(col(soil["MAXSMC"]), (1, self.dz.shape[1])), infil, from_soil / 1000, np.zeros_like(self.dz), hdiv, dt)
        s["theta"] = theta
        s["temp"], _ = column.soil_heat(s["temp"], self.dz, cap, cond, flux["ground"] - excess, 285.0, 8.0, dt)
        s["skin"] = skin
        runoff = (water - infil * 1000) + (over + drained) * 1000
        s["queue"] += runoff[:, None] * self.kernel
        routed = s["queue"][:, 0].copy()
        s["queue"] = np.concatenate([s["queue"][:, 1:], np.zeros((len(routed), 1))], 1)
        q_lat = np.zeros(len(self.length))
        np.add.at(q_lat, self.rb_reach, self.rb_area * routed[self.rb_unit] / 1000)
        steps = max(1, int(dt / self.substep))
        velocity = lambda a: np.clip((a / (self.width + 2 * a / self.width)) ** (2 / 3) * np.sqrt(np.maximum(self.slope, routing.SLOPE_LOW)) / 0.035, routing.U_LOW, routing.U_HIGH)
        s["section"], q = routing.kinematic(s["section"], self.down, self.length, q_lat / self.length, np.zeros_like(q_lat), dt / steps, steps, velocity, implicit=True, order=self.order)
        after = (s["theta"] * self.dz).sum(1) * 1000 + s["swe"]
        gone = np.where(from_snow != 0, from_snow - short, 0.0) + from_soil
        error = after - before - (f["precip"] - gone - runoff - hdiv.sum(1) * 1000) * dt
        return {"theta": s["theta"].mean(1), "swe": s["swe"].copy(), "skin": skin, "runoff": runoff, "routed": routed, "evaporation": gone, "hdiv": hdiv.sum(1) * 1000, "water_error": error, "energy_error": energy, "q": q, "section": s["section"].copy()}


REACH = ("q", "section")


def simulate(forcing: DataFrame, packed: DataFrame, dt: float = 3600.0, outputs: tuple[str, ...] = ("theta", "swe", "runoff", "evaporation", "q", "water_error")) -> DataFrame:
    """Rows of OUT: a value for each unit (kind ``unit``) or reach (``reach``), step and name,
    and each component's state at the end (``state``).

    forcing: component, cid, hru, step and the seven variables, of one segment; a missing
    unit's step raises."""

    def run(key: tuple, f: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(f):
            return pd.DataFrame(columns=["component", "kind", "cid", "id", "step", "name", "value", "state"])
        m = Component(p.iloc[0], dt)
        f = f.assign(at=[m.at[a, b] for a, b in zip(f.cid, f.hru, strict=True)]).sort_values(["step", "at"])
        parts, n = [], len(m.area)
        ids = {"unit": (m.u.cid.to_numpy(), m.u.hru.to_numpy()), "reach": tuple(np.array(x) for x in zip(*m.reach_ids, strict=True)) if m.reach_ids else (np.zeros(0, int),) * 2}
        for step, g in f.groupby("step", sort=True):
            if len(g) != n:
                raise ValueError(f"component {key[0]}: step {step} has forcing for {len(g)} of {n} units")
            got = m.step({v: g[v].to_numpy(float) for v in FORCING})
            for name in outputs:
                kind = "reach" if name in REACH else "unit"
                cid, own = ids[kind]
                parts.append(pd.DataFrame({"component": key[0], "kind": kind, "cid": cid, "id": own, "step": step, "name": name, "value": got[name]}))
        parts.append(pd.DataFrame({"component": [key[0]], "kind": ["state"], "cid": [-1], "id": [-1], "step": [int(f.step.max())], "name": [""], "value": [0.0]}))
        return pd.concat(parts, ignore_index=True).assign(state=[None] * sum(map(len, parts[:-1])) + [m.packed()])

    # new names for both sides: they may come from one table
    forcing, packed = (t.select(*[F.col(c).alias(c) for c in t.columns]) for t in (forcing, packed))
    return forcing.groupBy("component").cogroup(packed.groupBy("component")).applyInPandas(run, OUT)


def unit_forcing(cells: DataFrame, weights: DataFrame, components: DataFrame) -> DataFrame:
    """Forcing of units from coarse cells (cell, step, the variables) by areal weights
    (cell, cid, hru, weight)."""
    met = cells.join(weights, "cell").groupBy("cid", "hru", "step").agg(*[(F.sum(F.col(v) * F.col("weight")) / F.sum("weight")).alias(v) for v in FORCING])
    return met.join(components, "cid")


def regrid(pixels: DataFrame, values: DataFrame, lat0: float, lon0: float, size: float) -> DataFrame:
    """(ilat, ilon, step, name, value): unit values on a coarse grid.  Weights are shares of
    the cell's pixels that have a unit."""
    cells = joins.with_cells(pixels, "lat", "lon", lat0, lon0, size)
    w = zonal.fractions(cells, ["ilat", "ilon"], ["cid", "hru"], "pct").withColumnRenamed("hru", "id")
    return joins.regrid(values.where("kind = 'unit'"), w, ["cid", "id"], ["ilat", "ilon"], ["step", "name"], "value", "pct", renormalise=True)


def balances(values: DataFrame, units: DataFrame) -> DataFrame:
    """Area-weighted sums of each catchment and step, and their running totals."""
    w = values.where("kind = 'unit'").join(units.select("cid", F.col("hru").alias("id"), "area"), ["cid", "id"])
    by = w.groupBy("cid", "step", "name").agg((F.sum(F.col("value") * F.col("area")) / F.sum("area")).alias("value"))
    return zonal.running_total(by, ["cid", "name"], ["step"], F.col("value"), "running")


def run_segments(forcing: DataFrame, tables: dict[str, DataFrame], dz: list[float], edges_of: list[tuple[int, int]], dt: float = 3600.0) -> Iterator[DataFrame]:
    """Segments [a, b) of steps one after another, each from the state of the one before,
    which is kept in the folder for checkpoints."""
    state = None
    for a, b in edges_of:
        part = forcing.where((F.col("step") >= a) & (F.col("step") < b))
        out = graph.settled(simulate(part, structure(tables, dz, state), dt))
        state = out.where("kind = 'state'").select("component", "state")
        yield out.where("kind != 'state'").drop("state")
