"""Outdoor wet-bulb globe temperature after Liljegren et al. (2008), from the equations of the paper.

Globe and wick temperatures are roots of their energy balances, found by bisection over whole batches of rows at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the paper: SI units, but hPa for pressures.
STEFAN, CP, AIR, WATER, GAS = 5.6696e-8, 1003.5, 28.97, 18.015, 8314.34
R_AIR = GAS / AIR
PRANDTL = CP / (CP + 1.25 * R_AIR)
GROUND_EMISSIVITY, GROUND_ALBEDO = 0.999, 0.45
GLOBE_EMISSIVITY, GLOBE_ALBEDO, GLOBE_WIDTH = 0.95, 0.05, 0.0508
WICK_EMISSIVITY, WICK_ALBEDO, WICK_WIDTH, WICK_LENGTH = 0.95, 0.4, 0.007, 0.0254
LEAST_WIND = 0.13


def saturation(t):
    """hPa over water, from kelvin."""
    return 1.004 * 6.1121 * np.exp(17.502 * (t - 273.15) / (t - 32.18))


def viscosity(t):
    omega = 1.048 - 0.034 * (t / 97.0 - 2.9) / 0.4
    return 2.6693e-6 * np.sqrt(AIR * t) / (3.617**2 * omega)


def diffusivity(t, p):
    critical_t, critical_p = 132.0 * 647.3, 36.4 * 218.0
    return 3.640e-4 * (t / critical_t**0.5) ** 2.334 * critical_p ** (1 / 3) * critical_t ** (5 / 12) * (1 / AIR + 1 / WATER) ** 0.5 / (p / 1013.25) * 1e-4


def transfer(t, p, wind, width, sphere: bool):
    """Heat transfer of a sphere or a cylinder in the wind, W/m2/K."""
    reynolds = np.maximum(wind, LEAST_WIND) * p * 100 / (R_AIR * t) * width / viscosity(t)
    nusselt = 2 + 0.6 * np.sqrt(reynolds) * PRANDTL**0.3333 if sphere else 0.281 * reynolds**0.6 * PRANDTL**0.44
    return nusselt * (CP + 1.25 * R_AIR) * viscosity(t) / width


def bisect(balance, low, high, rounds: int = 48):
    """The root of a falling function, for all rows at once; NaN where the ends have the same sign."""
    good = (balance(low) >= 0) & (balance(high) <= 0)
    for _ in range(rounds):
        middle = (low + high) / 2
        above = balance(middle) > 0
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return np.where(good, (low + high) / 2, np.nan)


def solve(air, rh, p, wind, solar, direct, cosine):
    """(globe, natural wet bulb, psychrometric wet bulb, WBGT), degrees C, from arrays of air temperature C, humidity %, hPa, m/s, W/m2,
    the direct share of the light and the cosine of the sun's zenith angle."""
    t = air + 273.15
    share = np.clip(rh, 0, 100) / 100
    vapour = share * saturation(t)
    sky = 0.575 * np.maximum(vapour, 1e-12) ** 0.143
    long_wave = 0.5 * (sky + GROUND_EMISSIVITY) * t**4
    up = np.where(cosine > 0, np.clip(cosine, 1e-6, 1), 1.0)
    direct = np.where(cosine > 0, direct, 0.0)

    def globe(x):
        light = solar / (2 * STEFAN * GLOBE_EMISSIVITY) * (1 - GLOBE_ALBEDO) * (direct * (1 / (2 * up) - 1) + 1 + GROUND_ALBEDO)
        return long_wave - transfer((x + t) / 2, p, wind, GLOBE_WIDTH, True) / (STEFAN * GLOBE_EMISSIVITY) * (x - t) + light - x**4

    slim = 0.25 * WICK_WIDTH / WICK_LENGTH
    lit = (1 - WICK_ALBEDO) * solar * ((1 - direct) * (1 + slim) + direct * (np.tan(np.arccos(up)) / np.pi + slim) + GROUND_ALBEDO)

    def wick(x, radiant):
        film = (x + t) / 2
        schmidt = viscosity(film) / (p * 100 / (R_AIR * film) * diffusivity(film, p))
        latent = 2.4073e6 - 71100.0 * (313.15 - film) / 30.0
        dried = latent / (CP * AIR / WATER) * (saturation(x) - vapour) / (p - saturation(x)) * (PRANDTL / schmidt) ** 0.56
        gained = (STEFAN * WICK_EMISSIVITY * (long_wave - x**4) + lit) / transfer(film, p, wind, WICK_WIDTH, False)
        return t - dried + radiant * gained - x

    tg = bisect(globe, t - 60, t + 100) - 273.15
    nwb = bisect(lambda x: wick(x, 1.0), t - 60, t + 40) - 273.15
    pwb = bisect(lambda x: wick(x, 0.0), t - 60, t + 40) - 273.15
    return tg, nwb, pwb, 0.1 * air + 0.2 * tg + 0.7 * nwb


def direct_share(solar, cosine, distance_au=1.0):
    """The direct share of the light, from how clear the sky is."""
    most = 1367.0 * np.maximum(cosine, 0) / distance_au**2
    clear = np.minimum(np.divide(solar, most, out=np.zeros_like(np.asarray(solar, dtype=float)), where=most > 0), 0.85)
    return np.where(clear > 0, np.clip(np.exp(3 - 1.34 * clear - 1.65 / np.maximum(clear, 1e-9)), 0, 0.9), 0.0)


def _batch(air: pd.Series, rh: pd.Series, p: pd.Series, wind: pd.Series, solar: pd.Series, direct: pd.Series, cosine: pd.Series) -> pd.DataFrame:
    with np.errstate(all="ignore"):
        found = solve(*(x.to_numpy(dtype=float) for x in (air, rh, p, wind, solar, direct, cosine)))
    return pd.DataFrame(dict(zip(("globe", "nwb", "pwb", "wbgt"), found, strict=True)))


def wbgt_outdoor(*inputs: Column | str) -> Column:
    """Struct of globe, nwb, pwb, wbgt from the columns that ``solve`` takes; null where an input is, or a balance has no root
    between its bounds."""
    return F.pandas_udf(_batch, "globe double, nwb double, pwb double, wbgt double")(*inputs)
