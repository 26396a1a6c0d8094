"""The expression library over the readings: heat, evaporation, sun, risk and flood bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import agro, heat, sql
from ..functions.rounding import half_up
from ..sources.testdata import table
from .registry import ORACLES, query, r4

AIR_SQL = """air AS (SELECT event_id, 10 + least(value, 200.0) / 8 AS temp, least(99.0, 5 + value / 3) AS rh, event_id % 366 + 1 AS doy FROM events)"""
STULL_SQL = "temp * atan(0.151977::double * sqrt(rh + 8.313659::double)) + atan(temp + rh) - atan(rh - 1.676331::double) + 0.00391838::double * pow(rh, 1.5::double) * atan(0.023101::double * rh) - 4.686035::double"


def band_sql(x: str) -> str:
    return f"CASE WHEN {x} < 18 THEN 'LOW' WHEN {x} < 21 THEN 'ELEVATED' WHEN {x} < 24 THEN 'HIGH' WHEN {x} IS NOT NULL THEN 'VERY_HIGH' END"


def air(spark, sf_dir):
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id",
        (10 + F.least(value, F.lit(200.0)) / 8).alias("temp"),
        F.least(F.lit(99.0), 5 + value / 3).alias("rh"),
        (F.col("event_id") % 366 + 1).alias("doy"),
    )


@query(f"""WITH {AIR_SQL}, w AS (SELECT *, {STULL_SQL} AS wb FROM air), d AS (SELECT *, 0.7::double * wb + 0.3::double * temp AS wbgt,
        ln(greatest(rh, 1.0::double) / 100) + 17.625::double * temp / (243.04::double + temp) AS alpha FROM w)
    SELECT event_id, {r4('wb')} AS wet_bulb, {r4('wbgt')} AS wbgt, {r4('243.04::double * alpha / (17.625::double - alpha)')} AS dew_point, {band_sql('wbgt + 1.5')} AS band FROM d""")
def heat_expressions(spark, sf_dir):
    """wet bulb, shade WBGT, dew point and the band of an activity that bears less heat."""
    rows = air(spark, sf_dir).withColumn("wb", heat.stull_wet_bulb(F.col("temp"), F.col("rh")))
    rows = rows.withColumn("w", heat.shade_wbgt(F.col("temp"), F.col("wb")))
    return rows.select(
        "event_id",
        half_up(F.col("wb"), 4).alias("wet_bulb"),
        half_up(F.col("w"), 4).alias("wbgt"),
        half_up(heat.dew_point(F.col("temp"), F.col("rh")), 4).alias("dew_point"),
        heat.risk_band(F.col("w"), -1.5).alias("band"),
    )


@query(f"""WITH {AIR_SQL}, f AS (SELECT *, temp * 1.8::double + 32 AS t, 0.5::double * (temp * 1.8::double + 32 + 61 + (temp * 1.8::double + 32 - 68) * 1.2::double + rh * 0.094::double) AS simple FROM air),
    r AS (SELECT *, -42.379::double + 2.04901523::double * t + 10.14333127::double * rh - 0.22475541::double * t * rh - 6.83783e-3 * t * t - 5.481717e-2 * rh * rh
        + 1.22874e-3 * t * t * rh + 8.5282e-4 * t * rh * rh - 1.99e-6 * t * t * rh * rh AS full_form FROM f),
    c AS (SELECT *, full_form - CASE WHEN rh < 13 AND t BETWEEN 80 AND 112 THEN (13 - rh) / 4 * sqrt(greatest(17 - abs(t - 95), 0) / 17) ELSE 0 END
        + CASE WHEN rh > 85 AND t BETWEEN 80 AND 87 THEN (rh - 85) / 10 * ((87 - t) / 5) ELSE 0 END AS adjusted FROM r)
    SELECT event_id, {r4('(CASE WHEN (simple + t) / 2 >= 80 THEN adjusted ELSE simple END - 32) / 1.8::double')} AS heat_index FROM c""")
def heat_index_expr(spark, sf_dir):
    """the heat index, simple or by regression."""
    return air(spark, sf_dir).select("event_id", half_up(heat.heat_index(F.col("temp"), F.col("rh")), 4).alias("heat_index"))


RA_SQL = """ra AS (SELECT *, radians(-1.099736::double) AS phi, doy * (2 * pi() / 365) AS j FROM air),
    rb AS (SELECT *, 1 + 0.033::double * cos(j) AS dr, 0.409::double * sin(j - 1.39::double) AS decl FROM ra),
    rc AS (SELECT *, acos(-tan(phi) * tan(decl)) AS ws FROM rb),
    rd AS (SELECT *, 0.408::double * (24 * 60 / pi() * 0.082::double) * dr * (ws * sin(phi) * sin(decl) + cos(phi) * cos(decl) * sin(ws)) AS mm FROM rc)"""


@query(f"""WITH {AIR_SQL}, {RA_SQL} SELECT event_id, {r4('mm')} AS radiation_mm,
    greatest(0, floor(0.0023::double * ((temp + 6 + temp - 6) / 2 + 17.8::double) * sqrt(12.0::double) * mm * 100 + 0.5) / 100) AS et0 FROM rd""")
def et0_expr(spark, sf_dir):
    """radiation above the atmosphere and evaporation after Hargreaves, for a swing of 12 degrees."""
    rows, t = air(spark, sf_dir), F.col("temp")
    return rows.select(
        "event_id",
        half_up(agro.extraterrestrial_radiation_mm(F.col("doy")), 4).alias("radiation_mm"),
        agro.et0_hargreaves(t + 6, t - 6, F.col("doy")).alias("et0"),
    )


SUN_SQL = """g AS (SELECT event_id, (doy - 1) * (2 * pi() / 365) AS g, radians(-1.099736::double) AS lat FROM air),
    e AS (SELECT *, 229.18::double * (0.000075::double + 0.001868::double * cos(g) - 0.032077::double * sin(g) - 0.014615::double * cos(2 * g) - 0.040849::double * sin(2 * g)) AS eq,
        0.006918::double - 0.399912::double * cos(g) + 0.070257::double * sin(g) - 0.006758::double * cos(2 * g) + 0.000907::double * sin(2 * g)
        - 0.002697::double * cos(3 * g) + 0.00148::double * sin(3 * g) AS decl FROM g),
    h AS (SELECT *, degrees(acos(cos(radians(90.833::double)) / (cos(lat) * cos(decl)) - tan(lat) * tan(decl))) AS ha, 720 - 4 * 37.014528::double - eq AS noon FROM e)"""


@query(f"WITH {AIR_SQL}, {SUN_SQL} SELECT event_id, {r4('noon - 4 * ha')} AS sunrise, {r4('noon')} AS noon, {r4('noon + 4 * ha')} AS sunset FROM h")
def sun_times(spark, sf_dir):
    """sunrise, noon and sunset, minutes after 00:00 UTC."""
    return air(spark, sf_dir).select("event_id", *(half_up(c, 4).alias(n) for n, c in agro.sun_minutes(F.col("doy")).items()))


AIR_DAYS_SQL = "air AS (SELECT event_id, dayofyear(ts + INTERVAL 3 HOUR) AS doy, (epoch_us(ts) // 1000000 + 10800) % 86400 / 60.0::double - 180 AS minute FROM events)"


@query(f"WITH {AIR_DAYS_SQL}, {SUN_SQL} SELECT h.event_id AS event_id, minute BETWEEN noon - 4 * ha AND noon + 4 * ha AS daylight FROM h JOIN air USING (event_id)")
def daylight(spark, sf_dir):
    """Whether a reading falls between sunrise and sunset of its day."""
    t = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", agro.is_daylight(t).alias("daylight"))


@query("""WITH s AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value / 5 END AS rain, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 50) / 100.0::double END AS soil FROM events)
    SELECT event_id, CASE WHEN rain IS NULL THEN NULL WHEN rain >= 30 THEN CASE WHEN soil >= 0.25 THEN 'HIGH' WHEN soil < 0.25 THEN 'ELEVATED' END WHEN rain >= 15 THEN 'ELEVATED'
        WHEN rain >= 5 THEN CASE WHEN soil >= 0.25 THEN 'ELEVATED' WHEN soil < 0.25 THEN 'LOW' END ELSE 'LOW' END AS flood FROM s""")
def flood_3vl(spark, sf_dir):
    """the flood band, unknown where it turns on a missing value."""
    e = table(spark, sf_dir, "events")
    rain = F.when(F.col("event_id") % 13 != 0, F.col("value") / 5)
    soil = F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 50) / 100)
    return e.select("event_id", heat.flood_risk(rain, soil).alias("flood"))


@query("""WITH f AS (SELECT event_id, value AS mm, CASE event_id % 3 WHEN 0 THEN 'establishment' WHEN 1 THEN 'vegetative' ELSE 'flowering' END AS stage, 0.4::double + (event_id % 10) / 10.0::double AS zmax FROM events)
    SELECT event_id, CASE WHEN mm > 2 THEN 0.8::double * mm WHEN mm IS NOT NULL THEN 0 END::DOUBLE AS effective,
        floor((CASE stage WHEN 'establishment' THEN greatest(0.2::double, 0.3::double * zmax) WHEN 'vegetative' THEN (greatest(0.2::double, 0.3::double * zmax) + zmax) / 2 ELSE zmax END) * 100 + 0.5) / 100 AS root_m,
        least(0.8::double, greatest(0.1::double, floor((0.5::double + 0.04::double * (5 - mm / 10)) * 100 + 0.5) / 100)) AS depletion, floor(mm / 5) * 5.0::double AS steps,
        CASE WHEN mm / 50 <= 1.5 THEN 'LOW' WHEN mm / 50 <= 3 THEN 'MODERATE' WHEN mm IS NOT NULL THEN 'HIGH' END AS uncertainty FROM f""")
def farm_expressions(spark, sf_dir):
    """Rain that counts, root depth, depletion fraction, steps of five, width of a band."""
    stage = F.when(F.col("event_id") % 3 == 0, "establishment").when(F.col("event_id") % 3 == 1, "vegetative").otherwise("flowering")
    zmax, mm = 0.4 + (F.col("event_id") % 10) / 10.0, F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id",
        agro.effective_rain(mm).alias("effective"),
        agro.root_depth(zmax, stage).alias("root_m"),
        agro.depletion_fraction(F.lit(0.5), mm / 10).alias("depletion"),
        agro.floor_to_five(mm).alias("steps"),
        heat.uncertainty(mm / 50).alias("uncertainty"),
    )


@query(ORACLES["heat_expressions"])
def heat_sql(spark, sf_dir):
    """``heat_expressions`` once more, by SQL functions of the session; the SQL is that of the Columns."""
    sql.register(spark)
    four = "floor(({}) * 10000 + 0.500001D) / 10000"
    return spark.sql(
        f"SELECT event_id, {four.format('stull_wet_bulb(temp, rh)')} AS wet_bulb, {four.format('shade_wbgt_rh(temp, rh)')} AS wbgt, {four.format('dew_point(temp, rh)')} AS dew_point, "
        "risk_band(shade_wbgt_rh(temp, rh), -1.5D) AS band FROM {air}",
        air=air(spark, sf_dir),
    )
