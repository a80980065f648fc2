"""FAO-56 reference evapotranspiration, term by term, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import at_least, clip, col

SOLAR, STEFAN, ALBEDO = 0.0820, 4.903e-9, 0.23


def saturation_pressure(t) -> Column:
    return 0.6108 * F.exp(17.27 * col(t) / (col(t) + 237.3))


def saturation_slope(t) -> Column:
    return 4098.0 * saturation_pressure(t) / ((col(t) + 237.3) * (col(t) + 237.3))


def mean_saturation_pressure(tmin, tmax) -> Column:
    return (saturation_pressure(tmin) + saturation_pressure(tmax)) / 2.0


def actual_pressure(tmin, tmax, rh_min=None, rh_max=None, rh_mean=None, tdew=None) -> Column:
    """From what is given, in order: dew point, both humidities, the maximum, the mean; per row, NULLs fall through."""
    low, high = saturation_pressure(tmin), saturation_pressure(tmax)
    ways = []
    if tdew is not None:
        ways.append(saturation_pressure(tdew))
    if rh_min is not None and rh_max is not None:
        ways.append((low * col(rh_max) / 100.0 + high * col(rh_min) / 100.0) / 2.0)
    if rh_max is not None:
        ways.append(low * col(rh_max) / 100.0)
    if rh_mean is not None:
        ways.append(col(rh_mean) / 100.0 * ((low + high) / 2.0))
    if not ways:
        raise ValueError("a dew point or a humidity is needed")
    return F.coalesce(*ways)


def pressure(elevation) -> Column:
    return 101.3 * F.pow((293.0 - 0.0065 * col(elevation)) / 293.0, F.lit(5.26))


def psychrometric(p) -> Column:
    return 0.000665 * col(p)


def sun_distance(doy) -> Column:
    return 1.0 + 0.033 * F.cos(2.0 * math.pi * col(doy) / 365.0)


def declination(doy) -> Column:
    return 0.409 * F.sin(2.0 * math.pi * col(doy) / 365.0 - 1.39)


def sunset_angle(lat_rad, decl) -> Column:
    return F.acos(clip(-F.tan(col(lat_rad)) * F.tan(col(decl)), -1.0, 1.0))


def extraterrestrial(lat, doy) -> Column:
    phi, delta = F.radians(col(lat)), declination(doy)
    w = sunset_angle(phi, delta)
    return 24.0 * 60.0 / math.pi * SOLAR * sun_distance(doy) * (w * F.sin(phi) * F.sin(delta) + F.cos(phi) * F.cos(delta) * F.sin(w))


def clear_sky(ra, elevation) -> Column:
    return (0.75 + 2e-5 * col(elevation)) * col(ra)


def net_shortwave(rs, albedo: float = ALBEDO) -> Column:
    return (1.0 - albedo) * col(rs)


def net_longwave(tmin, tmax, ea, rs, rso) -> Column:
    fourth = lambda t: F.pow(col(t) + 273.16, F.lit(4.0))
    ratio = F.when(col(rso) > 0, clip(col(rs) / F.when(col(rso) > 0, col(rso)), 0.3, 1.0)).otherwise(F.lit(1.0))
    return STEFAN * ((fourth(tmax) + fourth(tmin)) / 2.0) * (0.34 - 0.14 * F.sqrt(at_least(ea, 0.0))) * (1.35 * ratio - 0.35)


def net_radiation(rns, rnl) -> Column:
    return col(rns) - col(rnl)


def components(tmin, tmax, rs, elevation, lat, doy, u2=2.0, rh_min=None, rh_max=None, rh_mean=None, tdew=None, g=0.0, tmean=None) -> dict[str, Column]:
    """All terms of the Penman-Monteith equation and ``et0`` (mm/day, not below 0)."""
    t = col(tmean) if tmean is not None else (col(tmin) + col(tmax)) / 2.0
    out = {"delta": saturation_slope(t), "gamma": psychrometric(pressure(elevation)), "es": mean_saturation_pressure(tmin, tmax)}
    out["ea"] = actual_pressure(tmin, tmax, rh_min, rh_max, rh_mean, tdew)
    out["ra"] = extraterrestrial(lat, doy)
    out["rso"] = clear_sky(out["ra"], elevation)
    out["rns"] = net_shortwave(rs)
    out["rnl"] = net_longwave(tmin, tmax, out["ea"], rs, out["rso"])
    out["rn"] = net_radiation(out["rns"], out["rnl"])
    u = col(u2)
    top = 0.408 * out["delta"] * (out["rn"] - col(g)) + out["gamma"] * (900.0 / (t + 273.0)) * u * (out["es"] - out["ea"])
    out["et0"] = at_least(top / (out["delta"] + out["gamma"] * (1.0 + 0.34 * u)), 0.0)
    return out


def penman_monteith(*args, **kwargs) -> Column:
    return components(*args, **kwargs)["et0"]


def hargreaves(tmin, tmax, ra) -> Column:
    mean = (col(tmin) + col(tmax)) / 2.0
    return at_least(0.0023 * (mean + 17.8) * F.sqrt(at_least(col(tmax) - col(tmin), 0.0)) * col(ra) * 0.408, 0.0)


def reanalysis(temp_k, dew_k, u10, v10, solar_j, pressure_pa, days: int = 8) -> Column:
    """The scene-server twin: mean temperature only, net solar radiation for Rn, times the days of a window."""
    t, td = col(temp_k) - 273.15, col(dew_k) - 273.15
    u = F.hypot(col(u10), col(v10)) * 0.748
    rn = at_least(col(solar_j) / 1e6, 0.0)
    d, g = saturation_slope(t), col(pressure_pa) / 1000.0 * 0.000665
    day = (0.408 * d * rn + g * (900.0 / (t + 273.0)) * u * (saturation_pressure(t) - saturation_pressure(td))) / (d + g * (1.0 + 0.34 * u))
    return at_least(day, 0.0) * float(days)
