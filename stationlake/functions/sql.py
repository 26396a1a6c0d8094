"""The expressions as SQL functions, so that ``spark.sql`` can say ``SELECT stull_wet_bulb(t, rh)``.

They are SQL functions of the session: the analyzer puts their bodies in place of the call, so plans are those of the same Columns and run no Python.
Constants come from the modules that have the Columns.
"""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

from .agro import LATITUDE
from .heat import BANDS, LEVELS, ROTHFUSZ


def _half_up(x: str, digits: int) -> str:
    return f"floor(({x}) * {10.0**digits}D + 0.5D) / {10.0**digits}D"


def _band(x: str) -> str:
    edges = " ".join(f"WHEN {x} < {upper}D THEN '{level}'" for level, (_, upper) in zip(LEVELS, BANDS, strict=False))
    return f"CASE {edges} WHEN {x} IS NOT NULL THEN '{LEVELS[-1]}' END"


def _regression() -> str:
    return " + ".join(f"({c!r}D) * pow(f, {i}) * pow(rh, {j})" for c, i, j in ROTHFUSZ)


def _radiation(doy: str) -> str:
    phi, angle = math.radians(LATITUDE), f"({doy} * {2 * math.pi / 365!r}D)"
    declination = f"(0.409D * sin({angle} - 1.39D))"
    sunset = f"acos({-math.tan(phi)!r}D * tan({declination}))"
    mj = f"({24 * 60 / math.pi * 0.082!r}D) * (1.0D + 0.033D * cos({angle})) * ({sunset} * {math.sin(phi)!r}D * sin({declination}) + {math.cos(phi)!r}D * cos({declination}) * sin({sunset}))"
    return f"0.408D * ({mj})"


_SIMPLE = "(0.5D * (f + 61.0D + (f - 68.0D) * 1.2D + rh * 0.094D))"
_DRY = "CASE WHEN rh < 13 AND f BETWEEN 80 AND 112 THEN (13.0D - rh) / 4 * sqrt(greatest(17.0D - abs(f - 95), 0.0D) / 17) ELSE 0.0D END"
_HUMID = "CASE WHEN rh > 85 AND f BETWEEN 80 AND 87 THEN (rh - 85.0D) / 10 * ((87.0D - f) / 5) ELSE 0.0D END"
_ALPHA = "(ln(greatest(rh, 1.0D) / 100.0D) + 17.625D * t / (243.04D + t))"

#: name -> (parameters, type, body)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "stull_wet_bulb": ("t DOUBLE, rh DOUBLE", "DOUBLE", "t * atan(0.151977D * sqrt(rh + 8.313659D)) + atan(t + rh) - atan(rh - 1.676331D) + 0.00391838D * pow(rh, 1.5D) * atan(0.023101D * rh) - 4.686035D"),
    "shade_wbgt": ("t DOUBLE, wet_bulb DOUBLE", "DOUBLE", "0.7D * wet_bulb + 0.3D * t"),
    "shade_wbgt_rh": ("t DOUBLE, rh DOUBLE", "DOUBLE", "shade_wbgt(t, stull_wet_bulb(t, rh))"),
    "dew_point": ("t DOUBLE, rh DOUBLE", "DOUBLE", f"243.04D * {_ALPHA} / (17.625D - {_ALPHA})"),
    "heat_index_f": ("f DOUBLE, rh DOUBLE", "DOUBLE", f"CASE WHEN ({_SIMPLE} + f) / 2 >= 80 THEN {_regression()} - {_DRY} + {_HUMID} ELSE {_SIMPLE} END"),
    "heat_index": ("t DOUBLE, rh DOUBLE", "DOUBLE", "(heat_index_f(t * 1.8D + 32.0D, rh) - 32.0D) / 1.8D"),
    "risk_band": ("wbgt DOUBLE, offset_c DOUBLE DEFAULT 0.0D", "STRING", _band("(wbgt - offset_c)")),
    "risk_rank": ("level STRING", "INT", f"array_position(array({', '.join(map(repr, LEVELS))}), level) - 1"),
    "uncertainty": ("width DOUBLE", "STRING", "CASE WHEN width <= 1.5 THEN 'LOW' WHEN width <= 3.0 THEN 'MODERATE' WHEN width IS NOT NULL THEN 'HIGH' END"),
    "extraterrestrial_radiation_mm": ("doy INT", "DOUBLE", _radiation("doy")),
    "et0_hargreaves": ("t_max DOUBLE, t_min DOUBLE, doy INT", "DOUBLE", f"greatest(0.0D, {_half_up('0.0023D * ((t_max + t_min) / 2 + 17.8D) * sqrt(greatest(0.0D, t_max - t_min)) * extraterrestrial_radiation_mm(doy)', 2)})"),
    "effective_rain": ("mm DOUBLE", "DOUBLE", "CASE WHEN mm > 2 THEN 0.8D * mm WHEN mm IS NOT NULL THEN 0.0D END"),
    "depletion_fraction": ("p DOUBLE, etc DOUBLE", "DOUBLE", f"least(0.8D, greatest(0.1D, {_half_up('p + 0.04D * (5.0D - etc)', 2)}))"),
    "floor_to_five": ("mm DOUBLE", "DOUBLE", "floor(mm / 5) * 5.0D"),
    "flood_risk": ("rain DOUBLE, soil DOUBLE", "STRING", "CASE WHEN rain IS NULL THEN NULL WHEN rain >= 30 THEN CASE WHEN soil >= 0.25D THEN 'HIGH' WHEN NOT soil >= 0.25D THEN 'ELEVATED' END WHEN rain >= 15 THEN 'ELEVATED' WHEN rain >= 5 THEN CASE WHEN soil >= 0.25D THEN 'ELEVATED' WHEN NOT soil >= 0.25D THEN 'LOW' END ELSE 'LOW' END"),
    "business_day": ("t BIGINT", "BIGINT", "floor((t + 10800) / 86400)"),
    "slot_of": ("t BIGINT", "BIGINT", "t - pmod(t, 900)"),
    "format_clock": ("t BIGINT", "STRING", "date_format(timestamp_seconds(t + 10800), 'HH:mm')"),
    "format_day": ("t BIGINT", "STRING", "date_format(timestamp_seconds(t + 10800), 'EEE d MMM')"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
