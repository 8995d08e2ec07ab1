"""A land column's step: soil water and heat by implicit solves of all columns of a batch.

What is closed-form is in ``functions.physics``; here are the two recurrences over layers.
Rows carry layers as arrays; batches of rows become matrices (column, layer), and one
tridiagonal elimination runs over layers for all of them at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def tridiagonal(low: np.ndarray, mid: np.ndarray, up: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solves (columns, layers) systems; low[:, 0] and up[:, -1] aren't read."""
    n = mid.shape[1]
    c, d = np.zeros_like(mid), np.zeros_like(mid)
    c[:, 0], d[:, 0] = up[:, 0] / mid[:, 0], rhs[:, 0] / mid[:, 0]
    for k in range(1, n):
        m = mid[:, k] - low[:, k] * c[:, k - 1]
        c[:, k] = up[:, k] / m
        d[:, k] = (rhs[:, k] - low[:, k] * d[:, k - 1]) / m
    for k in range(n - 2, -1, -1):
        d[:, k] -= c[:, k] * d[:, k + 1]
    return d


def soil_water(theta, dz, b, dsat, ksat, smax, infil, evap, transp, hdiv, dt: float, substeps: int = 3):
    """Water contents after a step, drainage at the bottom and excess at the top (m/s).

    Fluxes between layers are diffusion and gravity at the layers' mean; the bottom drains
    freely; what saturates a layer goes up layer by layer, and leaves at the top."""
    theta = theta.copy()
    n = theta.shape[1]
    h = dt / substeps
    drained, excess = np.zeros(len(theta)), np.zeros(len(theta))
    mids = (dz[:, 1:] + dz[:, :-1]) / 2
    for _ in range(substeps):
        f = np.maximum(0.01, theta / smax)
        d, k = dsat * f ** (b + 2), ksat * f ** (2 * b + 3)
        dm, km = np.sqrt(d[:, 1:] * d[:, :-1]), np.sqrt(k[:, 1:] * k[:, :-1])
        low, mid, up = np.zeros_like(theta), np.ones_like(theta), np.zeros_like(theta)
        up[:, :-1] = -h * dm / (mids * dz[:, :-1])
        low[:, 1:] = -h * dm / (mids * dz[:, 1:])
        mid -= low + up
        rhs = theta - h * (transp + hdiv) / dz
        rhs[:, 0] += h * (infil - evap) / dz[:, 0]
        rhs[:, :-1] -= h * km / dz[:, :-1]
        rhs[:, 1:] += h * km / dz[:, 1:]
        rhs[:, -1] -= h * k[:, -1] / dz[:, -1]
        theta = tridiagonal(low, mid, up, rhs)
        drained += k[:, -1] / substeps
        for j in range(n - 1, 0, -1):
            over = np.maximum(0.0, theta[:, j] - smax[:, j]) * dz[:, j]
            theta[:, j] -= over / dz[:, j]
            theta[:, j - 1] += over / dz[:, j - 1]
        over = np.maximum(0.0, theta[:, 0] - smax[:, 0]) * dz[:, 0]
        theta[:, 0] -= over / dz[:, 0]
        excess += over / dt
    return theta, drained, excess


def soil_heat(temp, dz, capacity, conductivity, ground_flux, t_bottom, z_bottom: float, dt: float):
    """Temperatures after a step, and the flux out of the bottom (W/m2)."""
    n = temp.shape[1]
    mids = (dz[:, 1:] + dz[:, :-1]) / 2
    km = 2 * conductivity[:, 1:] * conductivity[:, :-1] / (conductivity[:, 1:] + conductivity[:, :-1])
    low, mid, up = np.zeros_like(temp), np.ones_like(temp), np.zeros_like(temp)
    up[:, :-1] = -dt * km / (mids * dz[:, :-1] * capacity[:, :-1])
    low[:, 1:] = -dt * km / (mids * dz[:, 1:] * capacity[:, 1:])
    mid -= low + up
    rhs = temp.copy()
    rhs[:, 0] += dt * ground_flux / (dz[:, 0] * capacity[:, 0])
    deep = np.maximum(z_bottom - dz.sum(1) + dz[:, -1] / 2, dz[:, -1] / 2)
    g = conductivity[:, n - 1] / deep
    mid[:, -1] += dt * g / (dz[:, -1] * capacity[:, -1])
    rhs[:, -1] += dt * g * t_bottom / (dz[:, -1] * capacity[:, -1])
    out = tridiagonal(low, mid, up, rhs)
    return out, g * (out[:, -1] - t_bottom)


STATE = T.StructType().add("theta", T.ArrayType(T.DoubleType())).add("drainage", "double").add("excess", "double").add("water_error", "double")


def step_columns(df: DataFrame, keys: list[str], dt: float, substeps: int = 3) -> DataFrame:
    """(keys, theta, drainage, excess, water_error) of each row.  Arrays: theta, dz, smax,
    transp and hdiv (m/s); numbers: b, dsat, ksat, infil, evap.  Rows of a batch have one
    number of layers."""
    schema = T.StructType([*[df.schema[k] for k in keys], *STATE.fields])

    def run(batches):
        for pdf in batches:
            for _, part in pdf.groupby(pdf["dz"].map(len), sort=True):
                a = lambda c, p=part: np.stack(p[c].to_numpy()).astype(float)
                s = lambda c, p=part: p[c].to_numpy(float)[:, None]
                theta, dz = a("theta"), a("dz")
                t, hd, infil, evap = a("transp"), a("hdiv"), part["infil"].to_numpy(float), part["evap"].to_numpy(float)
                new, drained, excess = soil_water(theta, dz, s("b"), s("dsat"), s("ksat"), a("smax"), infil, evap, t, hd, dt, substeps)
                error = ((new - theta) * dz).sum(1) - dt * (infil - evap - t.sum(1) - hd.sum(1) - drained - excess)
                yield pd.DataFrame({**{k: part[k].to_numpy() for k in keys}, "theta": list(new), "drainage": drained, "excess": excess, "water_error": error})

    return df.mapInPandas(run, schema)
