"""Heat expressions: wet bulb, heat index, shade WBGT, dew point, risk bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower edges of the bands above LOW, degrees C.
BANDS = (("ELEVATED", 18.0), ("HIGH", 21.0), ("VERY_HIGH", 24.0))
LEVELS = ("LOW", "ELEVATED", "HIGH", "VERY_HIGH")
#: Rothfusz's regression in degrees F, as (coefficient, power of t, power of humidity).
ROTHFUSZ = (
    (-42.379, 0, 0),
    (2.04901523, 1, 0),
    (10.14333127, 0, 1),
    (-0.22475541, 1, 1),
    (-6.83783e-3, 2, 0),
    (-5.481717e-2, 0, 2),
    (1.22874e-3, 2, 1),
    (8.5282e-4, 1, 2),
    (-1.99e-6, 2, 2),
)


def stull_wet_bulb(temp: Column, rh: Column) -> Column:
    """Stull (2011), from air temperature in C and relative humidity in %."""
    return (
        temp * F.atan(0.151977 * F.sqrt(rh + 8.313659))
        + F.atan(temp + rh)
        - F.atan(rh - 1.676331)
        + 0.00391838 * F.pow(rh, 1.5) * F.atan(0.023101 * rh)
        - 4.686035
    )


def heat_index(temp: Column, rh: Column) -> Column:
    """The US National Weather Service's algorithm, in C: the simple form, or from a mean of 80 F on the regression with its
    corrections for dry and humid air."""
    t = temp * 1.8 + 32.0
    simple = 0.5 * (t + 61.0 + (t - 68.0) * 1.2 + rh * 0.094)
    regression = reduce(lambda a, b: a + b, (F.lit(c) * F.pow(t, F.lit(float(i))) * F.pow(rh, F.lit(float(j))) for c, i, j in ROTHFUSZ))
    dry = F.when((rh < 13) & t.between(80, 112), (13.0 - rh) / 4 * F.sqrt(F.greatest(17.0 - F.abs(t - 95), F.lit(0.0)) / 17))
    humid = F.when((rh > 85) & t.between(80, 87), (rh - 85.0) / 10 * ((87.0 - t) / 5))
    regression = regression - F.coalesce(dry, F.lit(0.0)) + F.coalesce(humid, F.lit(0.0))
    return (F.when((simple + t) / 2 >= 80, regression).otherwise(simple) - 32.0) / 1.8


def shade_wbgt(temp: Column, wet_bulb: Column) -> Column:
    return 0.7 * wet_bulb + 0.3 * temp


def dew_point(temp: Column, rh: Column) -> Column:
    """Magnus form; humidity counts as 1 % at least."""
    alpha = F.log(F.greatest(rh, F.lit(1.0)) / 100.0) + 17.625 * temp / (243.04 + temp)
    return 243.04 * alpha / (17.625 - alpha)


def risk_band(wbgt: Column, offset: Column | float = 0.0) -> Column:
    """The band of wbgt - offset; an activity that bears more heat has a positive offset. Null stays null."""
    over = wbgt - offset
    chain = F.when(over < BANDS[0][1], LEVELS[0])
    for (level, _), (_, upper) in zip(BANDS, BANDS[1:], strict=False):
        chain = chain.when(over < upper, level)
    return F.when(over.isNotNull(), chain.otherwise(BANDS[-1][0]))


def risk_rank(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level).cast("int") - 1


def uncertainty(width: Column) -> Column:
    return F.when(width <= 1.5, "LOW").when(width <= 3.0, "MODERATE").when(width.isNotNull(), "HIGH")


def flood_risk(rain: Column, soil: Column, wet_soil: float = 0.25, high: float = 30.0, elevated: float = 15.0, on_wet: float = 5.0) -> Column:
    """Three-valued: null where the answer turns on a missing value."""
    wet = soil >= wet_soil
    return (
        F.when(rain.isNull(), None)
        .when(rain >= high, F.when(wet, "HIGH").when(~wet, "ELEVATED"))
        .when(rain >= elevated, "ELEVATED")
        .when(rain >= on_wet, F.when(wet, "ELEVATED").when(~wet, "LOW"))
        .otherwise("LOW")
    )
