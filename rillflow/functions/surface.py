"""Surface energy and snow as NumPy kernels over all units of a batch."""

from __future__ import annotations

import numpy as np

SIGMA, CP, LV, LF, RHO_W, FREEZE = 5.67e-8, 1004.64, 2.5104e6, 3.34e5, 1000.0, 273.16


def saturation(t):
    """Saturation vapour pressure, Pa, over water or ice, and its slope."""
    a, b = np.where(t >= FREEZE, 17.67, 21.8746), np.where(t >= FREEZE, 243.5, 265.5)
    c = t - 273.15
    e = 611.2 * np.exp(a * c / (c + b))
    return e, e * a * b / (c + b) ** 2


def skin(sw, lw, tair, q, p, wind, albedo, emissivity, resistance, ground_t, ground_g, rounds: int = 20, t0=None, rough: float = 0.05, height: float = 10.0):
    """Skin temperature by Newton's method, and the fluxes that it closes, W/m2: absorbed,
    net longwave, sensible, latent and into the ground."""
    drag = (0.4 / np.log(height / rough)) ** 2
    rho = p / (287.04 * tair)
    ch = rho * CP * drag * np.maximum(wind, 0.5)
    ra = 1.0 / (drag * np.maximum(wind, 0.5))
    ea = q * p / (0.622 + 0.378 * q)
    cw = rho * CP / (CP * p / (0.622 * LV)) / (ra + resistance)
    t = np.array(tair if t0 is None else t0, float)
    absorbed = sw * (1.0 - albedo)
    for _ in range(rounds):
        es, ds = saturation(t)
        f = absorbed + emissivity * (lw - SIGMA * t**4) - ch * (t - tair) - cw * (es - ea) - ground_g * (t - ground_t)
        step = f / (4 * emissivity * SIGMA * t**3 + ch + cw * ds + ground_g)
        t = t + np.clip(step, -5.0, 5.0)
        if np.abs(step).max(initial=0) < 1e-6:
            break
    es, _ = saturation(t)
    return t, {"absorbed": absorbed, "longwave": emissivity * (SIGMA * t**4 - lw), "sensible": ch * (t - tair), "latent": cw * (es - ea), "ground": ground_g * (t - ground_t)}


def thermal(theta, smax, quartz: float = 0.6):
    """Conductivity (W/m/K) and heat capacity (J/m3/K) of soil layers."""
    sat = np.clip(theta / smax, 0.0, 1.0)
    solids = 7.7**quartz * 2.0 ** (1 - quartz)
    wet = solids ** (1 - smax) * 0.57**smax
    gamma = (1 - smax) * 2700.0
    dry = (0.135 * gamma + 64.7) / (2700.0 - 0.947 * gamma)
    kersten = np.where(sat > 0.1, np.log10(np.maximum(sat, 1e-6)) + 1.0, 0.0)
    return kersten * (wet - dry) + dry, theta * 4.188e6 + (1 - smax) * 2.0e6


def snow_step(swe, snowfall, melt_energy, sublimation, dt):
    """Snow water (mm) after a step, and melt (mm/s); what evaporates beyond the pack is
    given back as mm/s."""
    have = np.maximum(0.0, swe + snowfall * dt - sublimation * dt)
    short = np.maximum(0.0, sublimation - (swe + snowfall * dt) / dt)
    melt = np.minimum(have / dt, np.maximum(0.0, melt_energy) / LF)
    return have - melt * dt, melt, short
