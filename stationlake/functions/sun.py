"""Where the sun stands, after the NOAA solar calculator's published series (Meeus), as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .agro import LATITUDE, LONGITUDE

#: Coefficients by powers of Julian centuries since J2000, in degrees but for the eccentricity.
MEAN_LONGITUDE = (280.46646, 36000.76983, 0.0003032)
MEAN_ANOMALY = (357.52911, 35999.05029, -0.0001537)
ECCENTRICITY = (0.016708634, -0.000042037, -0.0000001267)
NODE = (125.04, -1934.136)
#: The equation of the centre, by multiples of the anomaly.
CENTRE = ((1.914602, -0.004817, -0.000014), (0.019993, -0.000101), (0.000289,))
#: Mean obliquity, arc seconds.
OBLIQUITY = (84381.448, -46.815, -0.00059, 0.001813)


def _series(coefficients: tuple[float, ...], t: Column) -> Column:
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * t + c
    return out


def position(epoch: Column, latitude: float = LATITUDE, longitude: float = LONGITUDE) -> tuple[Column, Column]:
    """(cosine of the zenith angle, distance in astronomical units) at an instant in epoch seconds."""
    t = (epoch / 86400.0 + 2440587.5 - 2451545.0) / 36525.0
    mean, anomaly, e = F.radians(_series(MEAN_LONGITUDE, t)), F.radians(_series(MEAN_ANOMALY, t)), _series(ECCENTRICITY, t)
    centre = sum((_series(c, t) * F.sin(anomaly * (k + 1)) for k, c in enumerate(CENTRE)), F.lit(0.0))
    node = F.radians(_series(NODE, t))
    apparent = mean + F.radians(centre - 0.00569 - 0.00478 * F.sin(node))
    tilt = F.radians(_series(OBLIQUITY, t) / 3600.0 + 0.00256 * F.cos(node))
    declination = F.asin(F.sin(tilt) * F.sin(apparent))
    half = F.pow(F.tan(tilt / 2), F.lit(2.0))
    equation = (
        half * F.sin(2 * mean)
        - 2 * e * F.sin(anomaly)
        + 4 * e * half * F.sin(anomaly) * F.cos(2 * mean)
        - 0.5 * half * half * F.sin(4 * mean)
        - 1.25 * e * e * F.sin(2 * anomaly)
    )
    turned = F.radians(F.pmod(epoch, F.lit(86400)) / 240.0) + equation + math.radians(longitude - 180)
    lat = math.radians(latitude)
    cosine = math.sin(lat) * F.sin(declination) + math.cos(lat) * F.cos(declination) * F.cos(turned)
    return cosine, 1.000001018 * (1 - e * e) / (1 + e * F.cos(anomaly + F.radians(centre)))


def hourly_mean(hour_start: Column, slices: int = 12, **place: float) -> Column:
    """Mean over the hour of the cosine while the sun is up, by the middles of equal slices."""
    middles = F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda k: hour_start + (2 * k + 1) * (1800 // slices))
    total = F.aggregate(middles, F.lit(0.0), lambda a, x: a + F.greatest(F.lit(0.0), position(x, **place)[0]))
    return total / slices


def hourly(hour_start: Column, slices: int = 60, **place: float) -> tuple[Column, Column, Column]:
    """(mean of the cosine while the sun is up, over the whole hour; over the hour's sunlit part, 0 where it has none; distance at half past)."""
    cosines = F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda k: position(hour_start + (2 * k + 1) * 1800.0 / slices, **place)[0])
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("lit"))
    add = lambda a, x: F.struct((a["total"] + F.greatest(F.lit(0.0), x)).alias("total"), (a["lit"] + (x > 0).cast("int")).alias("lit"))
    sums = F.aggregate(cosines, start, add)
    sunlit = F.when(sums["lit"] > 0, sums["total"] / sums["lit"]).otherwise(0.0)
    return sums["total"] / slices, sunlit, position(hour_start + 1800, **place)[1]


#: Upper edges of colour scales, and the colours, one more.
SCALES = {
    "temperature": ((14, 18, 22, 26, 30), ("#ECA47F", "#E28755", "#D56927", "#C15000", "#A53E00", "#822F00")),
    "rain": ((0.5, 2, 6, 12), ("#EAF4FA", "#93C5FD", "#3786B5", "#1E5A8A", "#0F3A5C")),
    "greenness": ((0.2, 0.35, 0.5, 0.65), ("#D4B896", "#A8C686", "#5B9E6B", "#1A6B3C", "#0D4625")),
}


def colour(value: Column, scale: str, unknown: str | None = None) -> Column:
    edges, colours = SCALES[scale]
    chain = F.when(value.isNull() | F.isnan(value), unknown)
    for edge, name in zip(edges, colours, strict=False):
        chain = chain.when(value < edge, name)
    return chain.otherwise(colours[-1])
