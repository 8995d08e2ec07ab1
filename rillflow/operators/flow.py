"""Lateral flow on an edge table: Darcy flow between units, layer by layer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moisture_potential(theta: Column, thetar: Column, thetas: Column, b: Column, satpsi: Column) -> Column:
    """Matric potential, m; theta is kept above 1.01 of the residual."""
    th = F.greatest(theta, 1.01 * thetar)
    return satpsi * F.pow((th - thetar) / (thetas - thetar), -b)


def conductivity(psi: Column, ksat: Column, satpsi: Column, b: Column, anisotropy: float = 1.0) -> Column:
    return anisotropy * ksat * F.pow(psi / satpsi, -2.0 - 3.0 / b)


def transmissivity(psi: Column, ztop: Column, zbot: Column, m: Column, ksat: Column, satpsi: Column, b: Column, anisotropy: float = 1.0) -> Column:
    return m * conductivity(psi, ksat, satpsi, b, anisotropy) * (F.exp(-ztop / m) - F.exp(-zbot / m))


def hydraulic_head(hand: Column, ztop: Column, psi: Column) -> Column:
    return hand - ztop - psi


def unit_layers(units: DataFrame, keys: Sequence[str], theta: str, dz: str, soil: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Units to layers: theta and dz are arrays; a soil column may be an array of layers or
    one number for all."""
    from pyspark.sql import types as T

    cut = units.select(*keys, *keep, theta, dz, *soil, F.posexplode(theta).alias("layer", "__th"))
    tops = F.aggregate(F.slice(F.col(dz), F.lit(1), F.col("layer")), F.lit(0.0), lambda s, x: s + x)
    pick = {c: F.get(F.col(c), F.col("layer")) if isinstance(units.schema[c].dataType, T.ArrayType) else F.col(c) for c in soil}
    return cut.select(*keys, *keep, "layer", F.col("__th").alias("theta"), tops.alias("ztop"), (tops + F.get(F.col(dz), F.col("layer"))).alias("zbot"), *[v.alias(k) for k, v in pick.items()])


def node_state(layers: DataFrame, hand: str, m: str) -> DataFrame:
    """Head and transmissivity of each unit and layer."""
    c = F.col
    psi = moisture_potential(c("theta"), c("thetar"), c("thetas"), c("b"), c("satpsi"))
    out = layers.withColumn("psi", psi)
    return out.withColumns({"head": hydraulic_head(c(hand), c("ztop"), c("psi")), "trans": transmissivity(c("psi"), c("ztop"), c("zbot"), c(m), c("ksat"), c("satpsi"), c("b"))})


def interface_width(edges: DataFrame, units: DataFrame, keys: Sequence[str], unit: str, area: str) -> DataFrame:
    """Distance of two units, dx = (area_dst / w + area_src / w of the way back) / 2."""
    back = edges.select(*keys, F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("__w"))
    a = lambda name, col: units.select(*keys, F.col(unit).alias(name), F.col(area).alias(col))
    met = edges.join(back, [*keys, "src", "dst"], "left").join(a("src", "__as"), [*keys, "src"]).join(a("dst", "__ad"), [*keys, "dst"])
    return met.withColumn("dx", (F.col("__ad") / F.col("w") + F.col("__as") / F.coalesce("__w", "w")) / 2).drop("__w", "__as", "__ad")


def divergence(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], unit: str, layer: str, head: str, trans: str, area: str) -> DataFrame:
    """(keys, unit, layer, hdiv): what leaves each unit, mm/s.

    Each edge (src, dst, w, dx) joins the state of both ends; two units without
    transmissivity exchange nothing."""
    state = [*keys, unit, layer, head, trans, area]
    a = nodes.select(*keys, layer, F.col(unit).alias("src"), F.col(head).alias("__hs"), F.col(trans).alias("__ts"))
    b = nodes.select(*state).withColumnsRenamed({unit: "dst", head: "__hd", trans: "__td", area: "__ad"})
    met = edges.where("w != 0").join(a, [*keys, "src"]).join(b, [*keys, "dst", layer])
    both = F.col("__ts") + F.col("__td")
    t = 2.0 * F.col("__ts") * F.col("__td") / F.when(both != 0, both)
    flux = -1000.0 * t * (F.col("__hs") - F.col("__hd")) / F.col("dx") * F.col("w") / F.col("__ad")
    return met.groupBy(*keys, F.col("dst").alias(unit), layer).agg(F.coalesce(F.sum(flux), F.lit(0.0)).alias("hdiv"))


def band_state(units: DataFrame, keys: Sequence[str], band: str, area: str, cols: Sequence[str]) -> DataFrame:
    """Area-weighted means of units by band, and the bands' areas."""
    w = F.sum(area)
    return units.groupBy(*keys, band).agg(*[(F.sum(F.col(c) * F.col(area)) / F.when(w != 0, w)).alias(c) for c in cols], w.alias(area))


def to_units(units: DataFrame, bands: DataFrame, keys: Sequence[str], band: str, cols: Sequence[str]) -> DataFrame:
    """Values of bands, to the units in them."""
    return units.join(bands.select(*keys, band, *cols), [*keys, band], "left")
