"""Closed-form physics of a land column as expressions of columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FREEZE, SIGMA, R_AIR = 273.16, 5.67e-8, 287.04


# Meteorology

def magnus(t_celsius: Column) -> Column:
    """Saturation vapour pressure, kPa."""
    return 0.6112 * F.exp(17.67 * t_celsius / (t_celsius + 243.5))


def downscale(tair: Column, lwdown: Column, psurf: Column, spfh: Column, dz: Column) -> dict[str, Column]:
    """Meteorology at a height dz (m) above its cell's: a lapse of 6 K/km, longwave by the
    radiative temperature, pressure by scale height, humidity at constant relative
    humidity."""
    t = tair - 0.006 * dz
    p = psurf * F.exp(-dz / 7200.0)
    lw = SIGMA * F.pow(F.pow(lwdown / SIGMA, 0.25) - 0.006 * dz, 4)
    e = spfh * (psurf / 1000.0) / (0.622 + 0.378 * spfh)
    e2 = e / magnus(tair - 273.15) * magnus(t - 273.15)
    q = 0.622 * e2 / (p / 1000.0 - 0.378 * e2)
    return {"tair": t, "lwdown": lw, "psurf": p, "spfh": q}


def vapour_pressure(q: Column, p: Column) -> Column:
    return q * p / (0.622 + 0.378 * q)


def air_density(p: Column, e: Column, t: Column) -> Column:
    return (p - 0.378 * e) / (R_AIR * t)


def shortwave_parts(sw: Column, cosz: Column) -> dict[str, Column]:
    """Direct and diffuse, visible and near infrared; none at night."""
    day = F.when(cosz > 0, sw).otherwise(0.0)
    return {"direct_vis": 0.35 * day, "direct_nir": 0.35 * day, "diffuse_vis": 0.15 * day, "diffuse_nir": 0.15 * day}


def solar(day: Column, hour_utc: Column, lat: Column, lon: Column, year_days: float = 365.0) -> dict[str, Column]:
    """Declination and cosine of the zenith angle; degrees and hours in, radians out."""
    lon_sun = F.radians((F.when(day >= 80, day - 80).otherwise(day + 285)) * (360.0 / year_days))
    declination = F.asin(math.sin(math.radians(23.5)) * F.sin(lon_sun))
    da = 6.2831853071796 * ((day - 1) / year_days)
    equation = (0.000075 + 0.001868 * F.cos(da) - 0.032077 * F.sin(da) - 0.014615 * F.cos(2 * da) - 0.04089 * F.sin(2 * da)) * 229.18
    angle = F.radians(15.0 * (hour_utc + equation / 60.0 + lon / 15.0 - 12.0))
    cosz = F.sin(F.radians(lat)) * F.sin(declination) + F.cos(F.radians(lat)) * F.cos(declination) * F.cos(angle)
    return {"declination": declination, "cosz": cosz}


def snow_fraction(t: Column, option: int = 1) -> Column:
    """Share of precipitation that falls as snow, by temperature."""
    if option == 1:
        ramp = F.when(t <= FREEZE + 2.0, 1.0 - (-54.632 + 0.2 * t)).otherwise(0.6)
        return F.when(t > FREEZE + 2.5, 0.0).when(t <= FREEZE + 0.5, 1.0).otherwise(ramp)
    limit = {2: FREEZE + 2.2, 3: FREEZE}
    if option not in limit:
        raise ValueError("snow option 1, 2 or 3; 4 takes the fraction of the forcing")
    return F.when(t < limit[option], 1.0).otherwise(0.0)


def fresh_density(t: Column) -> Column:
    return F.least(F.lit(120.0), 67.92 + 51.25 * F.exp((t - FREEZE) / 2.59))


def convective_share(convective: Column, large: Column) -> Column:
    """Share of a cell that rain reaches."""
    total = 10.0 * convective + large
    return F.when(total > 0, (convective + large) / total).otherwise(0.0)


# Vegetation

def vegetation_fraction(fveg: Column, lai: Column, sai: Column, annual_max: Column, option: int, bare: Column | None = None) -> Column:
    if option in (1, 6, 7):
        f = fveg
    elif option in (2, 3, 8):
        f = 1.0 - F.exp(-0.52 * (lai + sai))
    elif option in (4, 5, 9, 10):
        f = annual_max
    else:
        raise ValueError("vegetation option 1 to 10")
    f = F.greatest(f, F.lit(0.05))
    none = (lai + sai) <= 0
    return F.when(none if bare is None else none | bare, 0.0).otherwise(f)


def interception(rain: Column, share: Column, fveg: Column, lai_sai: Column, stored: Column, dt: float, per_leaf: float) -> Column:
    """Rain that leaves hold, mm/s."""
    cap = per_leaf * lai_sai
    room = (cap - stored) / dt * (1.0 - F.exp(-rain * dt / F.when(cap > 0, cap)))
    return F.when(cap > 0, F.greatest(F.lit(0.0), F.least(fveg * rain * share, room))).otherwise(0.0)


def wetted_fraction(stored: Column, cap: Column) -> Column:
    return F.when(cap > 0, F.pow(F.least(F.lit(1.0), F.greatest(F.lit(0.0), stored) / F.when(cap > 0, cap)), 0.667)).otherwise(0.0)


def soil_factor(theta: Column, dry: Column, wet: Column) -> Column:
    """Stress of a root layer, 0 dry to 1 wet."""
    return F.when(wet != dry, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (theta - dry) / F.when(wet != dry, wet - dry))))


def jarvis(par: Column, t: Column, deficit: Column, rgl: float, hs: float, topt: float, rs_min: float, rs_max: float) -> Column:
    """Stomatal resistance, s/m, as a product of factors with floors."""
    ff = 2.0 * par / rgl
    light = F.greatest((ff + rs_min / rs_max) / (1.0 + ff), F.lit(0.0001))
    heat = F.greatest(1.0 - 0.0016 * F.pow(F.lit(topt) - t, 2), F.lit(0.0001))
    dry = F.greatest(1.0 / (1.0 + hs * F.greatest(F.lit(0.0), deficit)), F.lit(0.01))
    return rs_min / (light * heat * dry)


# Snow

def snow_age(tau: Column, t: Column, swe: Column, swe_old: Column, dt: float, full: float = 1.0) -> Column:
    """Ageing of the surface by grain growth, melt and soot, renewed by new snow."""
    grow = F.exp(5000.0 * (1.0 / FREEZE - 1.0 / t))
    age = tau + dt / 1e6 * (grow + F.exp(F.least(F.lit(0.0), 10.0 * F.log(grow))) + 0.3)
    fresh = F.greatest(F.lit(0.0), swe - swe_old) / full
    return F.when(swe <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), age * F.greatest(F.lit(0.0), 1.0 - fresh)))


def snow_albedo_class(old: Column, snowfall: Column, dt: float, full: float = 1.0) -> Column:
    """Albedo that fades towards 0.55 and is renewed towards 0.84 by snowfall, mm/s."""
    faded = 0.55 + (old - 0.55) * math.exp(-0.01 * dt / 3600.0)
    return F.when(snowfall > 0, faded + F.least(snowfall, F.lit(full / dt)) * (0.84 - faded) / (full / dt)).otherwise(faded)


def snow_albedo_bats(age: Column, cosz: Column, vis: float = 0.95, nir: float = 0.65) -> dict[str, Column]:
    fz = F.greatest(F.lit(0.0), 3.0 / (1.0 + 4.0 * cosz) - 1.0) / 2.0
    faded = age / (1.0 + age)
    dif_vis, dif_nir = vis * (1.0 - 0.2 * faded), nir * (1.0 - 0.5 * faded)
    return {"diffuse_vis": dif_vis, "diffuse_nir": dif_nir, "direct_vis": dif_vis + 0.4 * fz * (1.0 - dif_vis), "direct_nir": dif_nir + 0.4 * fz * (1.0 - dif_nir)}


# Soil

def soil_hydraulics(theta: Column, thetas: Column, b: Column, dsat: Column, ksat: Column, frozen: Column | None = None) -> dict[str, Column]:
    """Diffusivity and conductivity; the frozen share of the surface passes nothing."""
    f = F.greatest(F.lit(0.01), theta / thetas)
    open_ = 1.0 - (frozen if frozen is not None else F.lit(0.0))
    return {"diffusivity": dsat * F.pow(f, b + 2.0) * open_, "conductivity": ksat * F.pow(f, 2.0 * b + 3.0) * open_}


def soil_hydraulics_ice(liquid: Column, thetas: Column, b: Column, dsat: Column, ksat: Column, ice_max: Column) -> dict[str, Column]:
    f = F.greatest(F.lit(0.01), liquid / thetas)
    v = 1.0 / (1.0 + F.pow(500.0 * ice_max, 3))
    d = dsat * F.pow(f, b + 2.0)
    mixed = v * d + (1.0 - v) * dsat * F.pow(F.least(0.05 / thetas, f), b + 2.0)
    return {"diffusivity": F.when(ice_max > 0, mixed).otherwise(d), "conductivity": ksat * F.pow(f, 2.0 * b + 3.0)}


def impermeable(ice: Column, smax: Column) -> Column:
    """Share of a layer closed by ice."""
    fice = F.least(F.lit(1.0), ice / smax)
    return F.greatest(F.lit(0.0), F.exp(-4.0 * (1.0 - fice)) - math.exp(-4.0)) / (1.0 - math.exp(-4.0))


def surface_runoff(qin: Column, zwt: Column, fcr: Column, fsatmx: float = 0.38, f: float = 2.0, shift: float = 0.0) -> Column:
    """Saturation excess by the depth of the water table."""
    fsat = fsatmx * F.exp(-0.5 * f * (zwt - shift))
    return qin * ((1.0 - fcr) * fsat + fcr)


def base_runoff(zwt: Column, fcr_max: Column, timean: float = 10.5, f: float = 2.0, rate: float = 4.0) -> Column:
    """Groundwater discharge, mm/s."""
    return (1.0 - fcr_max) * rate * math.exp(-timean) * F.exp(-f * zwt)


def infiltration(qin: Column, deficit: Column, kdt: Column, dt: float, impervious: Column | None = None) -> Column:
    """Infiltration of a rate (m/s) into soil that has so much room (m) left."""
    px = F.greatest(F.lit(0.0), qin * dt)
    dd = deficit * (1.0 - F.exp(-kdt * dt / 86400.0))
    rate = px * dd / F.when(px + dd > 0, px + dd) / dt
    if impervious is not None:
        rate = rate * impervious
    return F.when(px + dd > 0, F.least(F.greatest(rate, F.lit(0.0)), qin)).otherwise(0.0)


def thermal_conductivity(theta: Column, liquid: Column, smax: Column, quartz: Column) -> Column:
    """Soil conductivity: a geometric mean of minerals, water and ice, by saturation."""
    sat = theta / smax
    other = F.when(quartz > 0.2, 2.0).otherwise(3.0)
    solids = F.pow(F.lit(7.7), quartz) * F.pow(other, 1.0 - quartz)
    unfrozen = F.when(theta > 0, liquid / theta).otherwise(1.0) * smax
    wet = F.pow(solids, 1.0 - smax) * F.pow(F.lit(2.2), smax - unfrozen) * F.pow(F.lit(0.57), unfrozen)
    gamma = (1.0 - smax) * 2700.0
    dry = (0.135 * gamma + 64.7) / (2700.0 - 0.947 * gamma)
    kersten = F.when(liquid + 0.0005 < theta, sat).when(sat > 0.1, F.log10(F.greatest(sat, F.lit(1e-6))) + 1.0).otherwise(0.0)
    return kersten * (wet - dry) + dry


def evaporation_resistance(sat: Column, option: int = 1, t: Column | None = None) -> Column:
    """Soil's resistance to evaporation, s/m, by saturation of the top layer."""
    if option in (1, 4):
        return F.exp(8.25 - 4.225 * sat)
    if option == 2:
        return F.exp(8.25 - 6.0 * sat)
    return F.lit(0.0)


def supercooled(t: Column, smax: Column, satpsi: Column, b: Column) -> Column:
    """Water that stays liquid below freezing, by the freezing-point depression of the
    retention curve."""
    head = 3.34e5 * (FREEZE - t) / (9.80616 * t * satpsi)
    return F.when(t < FREEZE, F.least(smax, smax * F.pow(F.greatest(head, F.lit(1.0)), -1.0 / b))).otherwise(smax)


def freeze_melt(t: Column, ice: Column, liquid: Column, hold: Column, capacity: Column, dz: Column) -> dict[str, Column]:
    """Ice and liquid of a layer (kg/m2) after freezing or melting as its heat allows, and the
    temperature that is left.  capacity: J/m3/K; hold: liquid that doesn't freeze."""
    heat = capacity * dz * (t - FREEZE)
    melt = F.when(t > FREEZE, F.least(ice, heat / 3.34e5)).when(t < FREEZE, -F.least(F.greatest(liquid - hold, F.lit(0.0)), -heat / 3.34e5)).otherwise(0.0)
    return {"ice": ice - melt, "liquid": liquid + melt, "t": t - melt * 3.34e5 / (capacity * dz)}


def compaction(ice: Column, liquid: Column, depth: Column, t: Column, burden: Column, melted: Column, dt: float) -> Column:
    """Depth of a snow layer after a step: by metamorphism, by what lies on it and by melt, at
    most half."""
    density = ice / F.when(depth > 0, depth)
    cold = FREEZE - t
    grain = -2.777e-6 * F.exp(-0.04 * cold) * F.when(density > 100.0, F.exp(-0.046 * (density - 100.0))).otherwise(1.0) * F.when(liquid > 0.01 * depth, 2.0).otherwise(1.0)
    load = -(burden + 0.5 * (ice + liquid)) * F.exp(-0.08 * cold - 0.021 * density) / 0.8e6
    rate = (grain + load) * dt - melted
    return F.when(depth > 0, depth * (1.0 + F.greatest(F.lit(-0.5), rate))).otherwise(depth)


def merge_layers(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """Two snow layers (depth, ice, liquid, t) as one, of the same enthalpy."""
    heat = lambda x: (2094.0 * x["ice"] + 4188.0 * x["liquid"]) * (x["t"] - FREEZE) + 3.34e5 * x["liquid"]
    ice, liquid = a["ice"] + b["ice"], a["liquid"] + b["liquid"]
    h, cap = heat(a) + heat(b), 2094.0 * ice + 4188.0 * liquid
    t = F.when(h < 0, FREEZE + h / cap).when(h <= 3.34e5 * liquid, F.lit(FREEZE)).otherwise(FREEZE + (h - 3.34e5 * liquid) / cap)
    return {"depth": a["depth"] + b["depth"], "ice": ice, "liquid": liquid, "t": t}


def aquifer(zwt: Column, fcr_max: Column, timean: float = 10.5) -> Column:
    """Discharge of an aquifer below the soil, mm/s, by the depth of its table."""
    return (1.0 - fcr_max) * 5.0 * math.exp(-timean) * F.exp(-6.0 * (zwt - 2.0))


def aquifer_store(store: Column, recharge: Column, discharge: Column, dt: float, most: float = 5000.0) -> dict[str, Column]:
    """Storage (mm) after a step of recharge (at most 10 mm either way), and what is above."""
    r = F.least(F.lit(10.0 / dt), F.greatest(F.lit(-10.0 / dt), recharge))
    new = store + (r - discharge) * dt
    return {"store": F.least(new, F.lit(most)), "excess": F.greatest(new - most, F.lit(0.0))}


def ground_albedo(theta: Column, saturated: Column, dry: Column, snow: Column, cover: Column) -> Column:
    """Of soil by its wetness, mixed with snow by its cover."""
    soil = F.least(saturated + F.greatest(F.lit(0.0), 0.11 - 0.40 * theta), dry)
    return soil * (1.0 - cover) + snow * cover


def canopy_water(liquid: Column, ice: Column, evaporation: Column, t: Column, dt: float) -> dict[str, Column]:
    """Stores of the leaves (mm) after evaporation or dew (mm/s, of ice below freezing); no
    more goes than is there."""
    cold = t <= FREEZE
    take = lambda x, on: F.when(on, F.greatest(F.lit(0.0), x - evaporation * dt)).otherwise(x)
    new_l, new_i = take(liquid, ~cold), take(ice, cold)
    return {"liquid": new_l, "ice": new_i, "evaporated": (liquid + ice - new_l - new_i) / dt}


# Balances

def shortwave_error(sw: Column, absorbed: Column, reflected: Column) -> Column:
    return sw - (absorbed + reflected)


def energy_error(sav: Column, sag: Column, fira: Column, fsh: Column, fcev: Column, fgev: Column, fctr: Column, ssoil: Column, pah: Column) -> Column:
    return sav + sag - (fira + fsh + fcev + fgev + fctr + ssoil) + pah


def water_error(end: Column, begin: Column, rain: Column, ecan: Column, etran: Column, edir: Column, rs: Column, rb: Column, hdiv: Column, dt: float) -> Column:
    return end - begin - (rain - ecan - etran - edir - rs - rb - hdiv) * dt
