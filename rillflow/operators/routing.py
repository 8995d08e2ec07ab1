"""River routing: lateral inflow, conveyance by stage, kinematic wave and inundation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import settled

U_LOW, U_HIGH, U_HIGH_IMPLICIT, SLOPE_LOW = 0.1, 10.0, 2.0, 1e-3
#: Reaches at one distance from the heads, on average, below which they are solved one by one.
FEW_AT_ONCE = 32


def lateral_inflow(runoff: DataFrame, reach_band: DataFrame, lengths: DataFrame, keys: Sequence[str], reach: str, band: str, value: str, area: str, length: str) -> DataFrame:
    """(keys, reach, qss): sum of area * mm/s over bands, as m2/s along the reach."""
    q = reach_band.join(runoff, [*keys, band]).groupBy(*keys, reach).agg(F.sum(F.col(area) * F.col(value) / 1000.0).alias("__q"))
    return lengths.select(*keys, reach, length).join(q, [*keys, reach], "left").select(*keys, reach, (F.coalesce("__q", F.lit(0.0)) / F.col(length)).alias("qss"))


def upstream_inflow(reaches: DataFrame, keys: Sequence[str], reach: str, down: str, q: str) -> DataFrame:
    """(keys, reach, q_in): what the reaches above give."""
    ups = reaches.where(F.col(down).isNotNull()).groupBy(*keys, F.col(down).alias(reach)).agg(F.sum(q).alias("q_in"))
    return reaches.select(*keys, reach).join(ups, [*keys, reach], "left").select(*keys, reach, F.coalesce("q_in", F.lit(0.0)).alias("q_in"))


def hydraulic_radius(area: Column, perimeter: Column) -> Column:
    return area / F.when(perimeter > 0, perimeter)


def manning_velocity(radius: Column, slope: Column, n: Column) -> Column:
    """Velocity within its bounds; the slope has a floor."""
    return F.least(F.greatest(F.pow(radius, 2.0 / 3.0) * F.sqrt(F.greatest(slope, F.lit(SLOPE_LOW))) / n, F.lit(U_LOW)), F.lit(U_HIGH))


def split_flow(q: Column, channel: Column, total: Column) -> tuple[Column, Column]:
    """Flow of the channel and of the floodplain, by their conveyance."""
    part = F.when(total > 0, channel / total).otherwise(1.0)
    return q * part, q * (1.0 - part)


def runoff_feedback(runoff: Column, inundation: Column, dt: float) -> tuple[Column, Column]:
    """New runoff, less what stood already (m), and its ratio to the old (1 where none)."""
    r = F.greatest(runoff, F.lit(0.0))
    new = F.greatest(F.lit(0.0), r - inundation * 1000.0 / dt)
    return new, F.when(r > 0, new / r).otherwise(1.0)


class Sections:
    """Cross-sections of reaches as arrays (reach, level), with the conveyance of a section
    area by level lookup."""

    def __init__(self, ac, pc, af, pf, width, slope, n_channel, n_floodplain, legacy_widths: bool = False):
        self.ac, self.pc, self.af, self.pf, self.w, self.m = (np.asarray(x, float) for x in (ac, pc, af, pf, width, slope))
        self.nc, self.nf = np.asarray(n_channel, float), np.asarray(n_floodplain, float)
        self.total = self.ac + self.af
        self.below = np.cumsum(self.w, 1) - self.w  # widths of the levels below
        self.legacy = legacy_widths

    def level(self, area: np.ndarray) -> np.ndarray:
        """The last level whose area isn't above."""
        return np.maximum((self.total <= area[:, None]).sum(1) - 1, 0)

    def rise(self, area: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Depth above a level: a h^2 + b h = area left, a = 1 / slope, b = widths below."""
        i = np.arange(len(area))
        left = np.maximum(area - self.total[i, level], 0.0)
        flat = level == 0
        a = np.where(flat, 0.0, 1.0 / np.where(flat, 1.0, self.m[i, level]))
        b = np.where(flat, self.w[i, 0], self.below[i, level])
        with np.errstate(divide="ignore", invalid="ignore"):
            h = np.where(a > 0, 2.0 * left / (b + np.sqrt(b * b + 4.0 * a * left)), left / b)
        return np.nan_to_num(h, nan=0.0, posinf=0.0)

    def conveyance(self, area: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of channel and floodplain."""
        i, j = np.arange(len(area)), self.level(area)
        h = self.rise(area, j)
        m = np.where(j == 0, 1.0, self.m[i, j])
        w0 = self.w[:, 0]
        over = np.where(j == 0, 0.0, h * h / m + (self.below[i, j] - w0) * h)
        a_c = np.where(j == 0, area, self.ac[i, j] + w0 * h)
        p_c = np.where(j == 0, self.pc[:, 0] + 2.0 * h + w0, self.pc[i, j])
        a_f = np.where(j == 0, 0.0, self.af[i, j] + over)
        p_f = np.where(j == 0, 0.0, self.pf[i, j] + 2.0 * np.sqrt(h * h + (h / m) ** 2))
        with np.errstate(divide="ignore", invalid="ignore"):
            k = lambda a, p, n: np.nan_to_num(np.where(p > 0, a ** (5 / 3) / p ** (2 / 3) / n, 0.0))
            return k(a_c, p_c, self.nc), k(a_f, p_f, self.nf)

    def velocity(self, area: np.ndarray, slope: np.ndarray, high: float = U_HIGH) -> np.ndarray:
        kc, kf = self.conveyance(area)
        with np.errstate(divide="ignore", invalid="ignore"):
            u = np.where(area > 0, (kc + kf) * np.sqrt(np.maximum(slope, SLOPE_LOW)) / area, 0.0)
        return np.clip(u, U_LOW, high)


def kinematic(area: np.ndarray, down: np.ndarray, length: np.ndarray, q_lat: np.ndarray, boundary: np.ndarray, dt: float, steps: int, velocity, implicit: bool = False, order: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Section areas after so many sub-steps and the mean outflow, of reaches that drain to
    reach number ``down`` (-1: nowhere).

    Explicit: what flows in and out is that of the step before.  Implicit: reaches are solved
    from the heads down, each with the new inflow of those above.  order: what ``_heads_first`` gives for
    ``down``, to be made once where it is used often."""
    area, has = area.astype(float), down >= 0
    total = np.zeros(len(area))
    order = [] if not implicit else _heads_first(down) if order is None else order
    # long rivers have few reaches at a distance from the heads: one after another costs less than an array each
    chain = np.concatenate(order) if len(order) * FEW_AT_ONCE > len(area) and (length > 0).all() else None
    for _ in range(steps):
        u = velocity(area)
        if implicit and chain is not None and (u >= 0).all():
            new = _down_the_chain(chain.tolist(), area, down, length, q_lat, boundary, dt, u)
            area, q = new, new * u
        elif implicit:
            new = np.zeros(len(area))
            inflow = np.zeros(len(area))
            for group in order:
                new[group] = np.maximum(0.0, (area[group] + dt * (q_lat[group] + (boundary[group] + inflow[group]) / length[group])) / (1.0 + dt * u[group] / length[group]))
                g = group[has[group]]
                np.add.at(inflow, down[g], new[g] * u[g])
            area, q = new, new * u
        else:
            q = area * u
            inflow = np.zeros(len(area))
            np.add.at(inflow, down[has], q[has])
            area = np.maximum(0.0, area + dt * (q_lat + (boundary + inflow - q) / length))
            q = area * u
        total += q
    return area, total / max(1, steps)


def _down_the_chain(chain: list[int], area: np.ndarray, down: np.ndarray, length: np.ndarray, q_lat: np.ndarray, boundary: np.ndarray, dt: float, u: np.ndarray) -> np.ndarray:
    """New areas of reaches in the order of ``chain``, by the same operations as those of whole arrays."""
    new, inflow = [0.0] * len(chain), [0.0] * len(chain)
    a, to, far, q, b, v, below = (x.tolist() for x in (area, down, length, q_lat, boundary, u, 1.0 + dt * u / length))
    for i in chain:
        x = (a[i] + dt * (q[i] + (b[i] + inflow[i]) / far[i])) / below[i]
        new[i] = x = 0.0 if x < 0.0 else x
        if to[i] >= 0:
            inflow[to[i]] += x * v[i]
    return np.array(new)


def _heads_first(down: np.ndarray) -> list[np.ndarray]:
    """Reaches by their distance from the heads, so that all above come first."""
    n = len(down)
    waiting = np.bincount(down[down >= 0], minlength=n)
    ready, out = np.flatnonzero(waiting == 0), []
    while len(ready):
        out.append(ready)
        to = down[ready]
        to = to[to >= 0]
        np.subtract.at(waiting, to, 1)
        ready = np.unique(to[waiting[to] == 0])
    if sum(map(len, out)) != n:
        raise ValueError("the network has a cycle")
    return out


def route(reaches: DataFrame, component: str, reach: str, down: str, dt: float, steps: int, implicit: bool = False) -> DataFrame:
    """Kinematic wave of all reaches, a river component a group: within it no exchange
    between catchments is left.

    reaches: component, reach, down (null: nowhere), length, slope, area (of the section),
    q_lat (m2/s), boundary (m3/s), and either width and manning (rectangular sections) or the
    arrays Ac, Pc, Af, Pf, W, M with manning and manning_floodplain.  Gives (component, reach,
    area, q)."""
    kinds = reaches.schema
    compound = "Ac" in reaches.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(reach).reset_index(drop=True)
        at = {r: i for i, r in enumerate(pdf[reach])}
        to = np.array([at.get(d, -1) if pd.notna(d) else -1 for d in pdf[down]])
        slope = pdf["slope"].to_numpy(float)
        if compound:
            s = Sections(*[np.stack(pdf[c]) for c in ("Ac", "Pc", "Af", "Pf", "W", "M")], pdf["manning"], pdf["manning_floodplain"])
            velocity = lambda a: s.velocity(a, slope, U_HIGH_IMPLICIT if implicit else U_HIGH)
        else:
            w, n = pdf["width"].to_numpy(float), pdf["manning"].to_numpy(float)
            velocity = lambda a: np.clip((a / (w + 2.0 * a / w)) ** (2 / 3) * np.sqrt(np.maximum(slope, SLOPE_LOW)) / n, U_LOW, U_HIGH_IMPLICIT if implicit else U_HIGH)
        get = lambda c: pdf[c].fillna(0.0).to_numpy(float)
        area, q = kinematic(get("area"), to, get("length"), get("q_lat"), get("boundary"), dt, steps, velocity, implicit)
        return pd.DataFrame({component: pdf[component], reach: pdf[reach], "area": area, "q": q})

    from pyspark.sql import types as T

    schema = T.StructType([kinds[component], kinds[reach]]).add("area", "double").add("q", "double")
    return reaches.groupBy(component).applyInPandas(run, schema)


def route_by_joins(reaches: DataFrame, reach: str, down: str, dt: float, steps: int, every: int = 6) -> DataFrame:
    """The explicit scheme for a river too large for one worker, rectangular sections: a step
    is one join of reaches with the sum of what comes from above; lineage is cut now and
    then."""
    at = reaches
    for i in range(steps):
        a, w = F.col("area"), F.col("width")
        u = F.least(F.greatest(F.pow(a / (w + 2.0 * a / w), 2.0 / 3.0) * F.sqrt(F.greatest(F.col("slope"), F.lit(SLOPE_LOW))) / F.col("manning"), F.lit(U_LOW)), F.lit(U_HIGH))
        at = at.withColumn("__u", u).withColumn("__q", F.col("area") * F.col("__u"))
        into = at.where(F.col(down).isNotNull()).groupBy(F.col(down).alias(reach)).agg(F.sum("__q").alias("__in"))
        at = at.join(into, reach, "left")
        new = F.greatest(F.lit(0.0), F.col("area") + dt * (F.coalesce("q_lat", F.lit(0.0)) + (F.coalesce("boundary", F.lit(0.0)) + F.coalesce("__in", F.lit(0.0)) - F.col("__q")) / F.col("length")))
        at = at.withColumn("area", new).withColumn("q", F.col("area") * F.col("__u")).drop("__u", "__q", "__in")
        if i % every == every - 1:
            at = settled(at)
    return at


def inundation_of(hands: Column, area: Column, totals: Column, widths: Column, slopes: Column) -> Column:
    """Mean depth of water at each level of a section (arrays of levels): the level's top is
    found by its area; levels below stand under the whole rise."""
    n = F.size(F.filter(totals, lambda t: t <= area))
    k = F.greatest(n - 1, F.lit(0))
    below = F.aggregate(F.slice(widths, F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0), lambda s, x: s + x)
    left = F.greatest(area - F.get(totals, k), F.lit(0.0))
    a = F.when(k > 0, 1.0 / F.get(slopes, k)).otherwise(0.0)
    rise = F.coalesce(2.0 * left / F.nullif(below + F.sqrt(below * below + 4.0 * a * left), F.lit(0.0)), F.lit(0.0))
    top = F.get(hands, k) + rise
    return F.transform(hands, lambda h, i: F.when(i < k, top - h).when((i == k) & (k > 0), rise * rise * a / F.nullif(F.get(widths, i), F.lit(0.0))).when(i == k, rise).otherwise(0.0))


def band_inundation(depths: DataFrame, keys: Sequence[str], band: str, depth: str, area: str) -> DataFrame:
    """Area-weighted depth of each band over all reaches."""
    w = F.sum(area)
    return depths.groupBy(*keys, band).agg((F.sum(F.col(area) * F.col(depth)) / F.when(w != 0, w)).alias(depth))
