"""Crop water expressions after FAO-56, and the sun's times."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import half_up

#: The station's place, degrees north and east.
LATITUDE, LONGITUDE = -1.099736, 37.014528


def extraterrestrial_radiation_mm(day_of_year: Column, latitude: float = LATITUDE) -> Column:
    """Equations 21 and 23 to 25, as evaporation in mm a day."""
    phi = math.radians(latitude)
    angle = day_of_year * (2 * math.pi / 365)
    distance = 1.0 + 0.033 * F.cos(angle)
    declination = 0.409 * F.sin(angle - 1.39)
    sunset = F.acos(-math.tan(phi) * F.tan(declination))
    mj = (24 * 60 / math.pi * 0.082) * distance * (
        sunset * math.sin(phi) * F.sin(declination) + math.cos(phi) * F.cos(declination) * F.sin(sunset)
    )
    return 0.408 * mj


def et0_hargreaves(t_max: Column, t_min: Column, day_of_year: Column, latitude: float = LATITUDE) -> Column:
    """Equation 52, to two decimals, never negative."""
    swing = F.greatest(F.lit(0.0), t_max - t_min)
    et0 = 0.0023 * ((t_max + t_min) / 2 + 17.8) * F.sqrt(swing) * extraterrestrial_radiation_mm(day_of_year, latitude)
    return F.greatest(F.lit(0.0), half_up(et0, 2))


def effective_rain(mm: Column) -> Column:
    """80 % of a day's rain above 2 mm."""
    return F.when(mm > 2, 0.8 * mm).when(mm.isNotNull(), 0.0)


def depletion_fraction(p: Column, etc: Column) -> Column:
    return F.least(F.lit(0.8), F.greatest(F.lit(0.1), half_up(p + 0.04 * (5.0 - etc), 2)))


def root_depth(full: Column, stage: Column) -> Column:
    """Establishment has 30 % of the full depth, 0.2 m at least; the vegetative stage is halfway."""
    first = F.greatest(F.lit(0.2), 0.3 * full)
    return half_up(F.when(stage == "establishment", first).when(stage == "vegetative", (first + full) / 2).otherwise(full), 2)


def floor_to_five(mm: Column) -> Column:
    return F.floor(mm / 5) * 5.0


def sun_minutes(day_of_year: Column, latitude: float = LATITUDE, longitude: float = LONGITUDE) -> dict[str, Column]:
    """Sunrise, noon and sunset in minutes after 00:00 UTC, after NOAA's general approximation (zenith 90.833)."""
    g = (day_of_year - 1) * (2 * math.pi / 365)
    equation = 229.18 * (
        0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g)
    )
    declination = (
        0.006918
        - 0.399912 * F.cos(g)
        + 0.070257 * F.sin(g)
        - 0.006758 * F.cos(2 * g)
        + 0.000907 * F.sin(2 * g)
        - 0.002697 * F.cos(3 * g)
        + 0.00148 * F.sin(3 * g)
    )
    lat = math.radians(latitude)
    ratio = math.cos(math.radians(90.833)) / (math.cos(lat) * F.cos(declination)) - math.tan(lat) * F.tan(declination)
    hour_angle = F.degrees(F.acos(ratio))
    noon = 720.0 - 4 * longitude - equation
    return {"sunrise": noon - 4 * hour_angle, "noon": noon, "sunset": noon + 4 * hour_angle}


def is_daylight(epoch: Column, offset: int = 10800, **place: float) -> Column:
    """Whether an instant (epoch seconds) lies between sunrise and sunset of its local day, ``offset`` seconds ahead of UTC."""
    day = F.floor((epoch + offset) / 86400)
    sun = sun_minutes(F.dayofyear(F.date_from_unix_date(day.cast("int"))), **place)
    return ((epoch - day * 86400) / 60).between(sun["sunrise"], sun["sunset"])


def solar_irradiance(counts: Column, cos_zenith: Column, dark: float, a: float, b: float) -> Column:
    """W/m2 from infrared counts; zero with the sun down, null without counts."""
    net = F.greatest(counts - dark, F.lit(0.0))
    return F.when(counts.isNull() | cos_zenith.isNull(), None).when(cos_zenith <= 0, 0.0).otherwise(
        F.greatest(net * (a + b * (1.0 - cos_zenith)), F.lit(0.0))
    )
