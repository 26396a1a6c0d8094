"""Water balance, irrigation, spraying, planting, heat stress of crops."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.agro import depletion_fraction, effective_rain
from ..functions.rounding import half_up
from ..operators import farm
from ..sources.testdata import table
from .registry import query, r4
from .windows import DAY_SQL, days

TAW, KC = 96.0, 1.05
NET_SQL = f"""{DAY_SQL}, net AS (SELECT station_id, day, 5.5::double * 1.05::double - CASE WHEN mm > 2 THEN 0.8::double * mm ELSE 0 END AS net, mm FROM days),
    folded AS (SELECT station_id, list_reduce(list(net ORDER BY day), lambda a, x: least(96::double, greatest(0::double, a + x)), 0::double) AS depletion, count(*) AS n FROM net GROUP BY 1)"""


def balance(spark, sf_dir):
    rain = F.coalesce(effective_rain(F.col("mm")), F.lit(0.0))
    net = days(spark, sf_dir).select("station_id", "day", (F.lit(5.5 * KC) - rain).alias("net"))
    return farm.clamped_balance(net, ["station_id"], "net", F.lit(TAW))


@query(f"WITH {NET_SQL} SELECT station_id, {r4('depletion')} AS depletion FROM folded")
def water_balance(spark, sf_dir):
    """Depletion of the root zone after the season's days, never below zero or above what it holds."""
    return balance(spark, sf_dir).withColumn("depletion", half_up(F.col("depletion"), 4))


CROP_ROWS = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::double" for v in c) + ")" for c in farm.CROPS)
CROPS_SQL = f"crops(crop, kc_est, kc_veg, kc_flo, kc_mat, root_m, p, planting_mm, mild, moderate, severe, sensitive) AS (VALUES {CROP_ROWS})"


def crops(spark):
    return spark.createDataFrame(list(farm.CROPS), farm.CROP_FIELDS)


@query(f"""WITH {NET_SQL}, {CROPS_SQL}, x AS (SELECT station_id, crop, depletion, 160 * root_m AS taw, 5.5::double * kc_mat AS etc, kc_mat,
        least(0.8::double, greatest(0.1::double, floor((p + 0.04::double * (5 - 5.5::double * kc_mat)) * 100 + 0.5) / 100)) AS f, (station_id * 7)::double AS ahead FROM folded CROSS JOIN crops),
    y AS (SELECT *, f * taw AS raw, CASE WHEN ahead > 2 THEN 0.8::double * ahead ELSE 0::double END AS covered FROM x),
    z AS (SELECT *, greatest(0, floor((depletion - covered) / 5) * 5) AS depth, greatest(0, floor(raw / 5) * 5) AS most FROM y),
    a AS (SELECT *, CASE WHEN kc_mat < 0.45 THEN 'NO_IRRIGATION' WHEN depletion < raw THEN 'NO_IRRIGATION' WHEN covered > 0 AND (covered >= 0.8 * depletion OR depth < 5) THEN 'HOLD_RAIN_EXPECTED'
        WHEN depth < 5 THEN 'NO_IRRIGATION' ELSE 'IRRIGATE_NOW' END AS action FROM z)
    SELECT station_id, crop, action, CASE WHEN action = 'IRRIGATE_NOW' THEN least(depth, most) ELSE 0 END::DOUBLE AS depth_mm, CASE WHEN action = 'IRRIGATE_NOW' THEN depth - least(depth, most) ELSE 0 END::DOUBLE AS remaining_mm,
        CASE WHEN kc_mat >= 0.45 AND depletion < raw THEN greatest(1, floor((raw - depletion) / etc + 0.5)) END::DOUBLE AS days FROM a""")
def irrigation_advice(spark, sf_dir):
    """For each crop at maturity, whether to water, how much, and when."""
    etc = 5.5 * F.col("kc_maturity")
    rows = balance(spark, sf_dir).crossJoin(F.broadcast(crops(spark)))  # seven crops
    raw = depletion_fraction(F.col("p"), etc) * farm.AVAILABLE_MM_PER_M * F.col("root_m")
    ahead = (F.col("station_id") * 7).cast("double")
    advice = farm.irrigation_advice(F.col("depletion"), raw, etc, ahead, F.col("kc_maturity") < 0.45, F.lit(True))
    return rows.withColumn("a", advice).select("station_id", "crop", "a.*")


@query("""WITH s AS (SELECT event_id, (extract(hour FROM ts) * 60 + extract(minute FROM ts)) BETWEEN 210 AND 935 AS daylight, value / 40 AS wind, (event_id % 10) / 12.0::double AS p, 15 + value / 12 AS temp,
        event_id % 4 = 0 AS filled, event_id % 7 = 0 AS poor FROM events),
    r AS (SELECT event_id, CASE WHEN NOT daylight OR wind > 4 OR p >= 0.5 THEN 'AVOID' WHEN wind < 0.4 OR p >= 0.25 OR temp > 28 OR filled OR poor THEN 'MARGINAL' ELSE 'GOOD' END AS quality,
        list_filter([CASE WHEN NOT daylight THEN 'outside_daylight' END, CASE WHEN wind > 4 THEN 'wind_drift' END, CASE WHEN wind < 0.4 THEN 'wind_too_calm' END, CASE WHEN p >= 0.5 THEN 'washoff' END,
        CASE WHEN p >= 0.25 AND p < 0.5 THEN 'rain_possible' END, CASE WHEN temp > 28 THEN 'evaporation' END, CASE WHEN filled THEN 'inputs_filled' END, CASE WHEN poor THEN 'data_limited' END,
        CASE WHEN wind BETWEEN 0.4 AND 4 THEN 'wind_suitable' END, CASE WHEN p < 0.25 THEN 'low_rain_risk' END], lambda x: x IS NOT NULL)[1:5] AS reasons FROM s)
    SELECT event_id, quality, array_to_string(reasons, ',') AS reasons FROM r""")
def spray_window(spark, sf_dir):
    """Q20: whether to spray now, and why."""
    e = table(spark, sf_dir, "events")
    minute = F.hour("ts") * 60 + F.minute("ts")
    verdict = farm.spray_window(minute.between(210, 935), F.col("value") / 40, (F.col("event_id") % 10) / 12, 15 + F.col("value") / 12, F.col("event_id") % 4 == 0, F.col("event_id") % 7 == 0)
    return e.withColumn("v", verdict).select("event_id", "v.quality", F.array_join("v.reasons", ",").alias("reasons"))


@query(f"""WITH {DAY_SQL}, {CROPS_SQL}, t AS (SELECT station_id, max(day) AS today, max(day) FILTER (mm IS NULL OR mm >= 1) AS wet, min(day) AS first FROM days GROUP BY 1),
    w AS (SELECT station_id, day, sum(coalesce(mm, 0)) OVER (PARTITION BY station_id ORDER BY day ROWS 2 PRECEDING) AS three, count(*) OVER (PARTITION BY station_id ORDER BY day ROWS 2 PRECEDING) AS k FROM days),
    s AS (SELECT station_id, sum(mm) FILTER (day > today - 30) AS rain, today - coalesce(wet, first - 1) AS dry FROM days JOIN t USING (station_id) GROUP BY station_id, today, wet, first),
    b AS (SELECT station_id, floor(max(three) * 10 + 0.5) / 10 AS wetting FROM w JOIN t USING (station_id) WHERE k = 3 AND day > today - 8 GROUP BY 1),
    j AS (SELECT station_id, crop, floor(rain * 10 + 0.5) / 10 AS rain, dry, wetting, planting_mm FROM s JOIN b USING (station_id) CROSS JOIN crops)
    SELECT station_id, crop, CASE WHEN rain >= planting_mm AND wetting >= 20 AND dry <= 7 THEN 'favourable' WHEN rain < planting_mm AND dry > 7 THEN 'dry' WHEN rain < planting_mm THEN 'insufficient'
        WHEN dry > 7 THEN 'dryspell' ELSE 'no_wetting' END AS outlook FROM j""")
def planting_outlook(spark, sf_dir):
    """Q21: rain of the month, the wettest three days of the last ten, the dry spell, each against what a crop needs."""
    from pyspark.sql import Window

    d = days(spark, sf_dir)
    w = Window.partitionBy("station_id").orderBy("day").rowsBetween(-2, 0)
    d = d.withColumns({"three": F.sum(F.coalesce("mm", F.lit(0.0))).over(w), "k": F.count(F.lit(1)).over(w)})
    t = d.groupBy("station_id").agg(
        F.max("day").alias("today"), F.coalesce(F.max(F.when(F.col("mm").isNull() | (F.col("mm") >= 1), F.col("day"))), F.min("day") - 1).alias("wet")
    )
    s = d.join(F.broadcast(t), "station_id").groupBy("station_id").agg(
        half_up(F.sum(F.when(F.col("day") > F.col("today") - 30, F.col("mm"))), 1).alias("rain"),
        F.max(F.col("today") - F.col("wet")).alias("dry"),
        half_up(F.max(F.when((F.col("k") == 3) & (F.col("day") > F.col("today") - 8), F.col("three"))), 1).alias("wetting"),
    )
    s = s.crossJoin(F.broadcast(crops(spark)))  # seven crops
    outlook = farm.planting(F.col("rain"), F.col("wetting"), F.col("dry"), F.lit(False), F.col("planting_mm"))
    return s.select("station_id", "crop", outlook.alias("outlook"))


@query(f"""WITH {DAY_SQL}, {CROPS_SQL}, x AS (SELECT station_id, day, crop, t_max, mild, moderate, severe, CASE WHEN sensitive = 'flowering' THEN 3 ELSE 0 END AS s FROM days CROSS JOIN crops WHERE t_max IS NOT NULL)
    SELECT crop, CASE WHEN t_max >= severe - s THEN 'SEVERE' WHEN t_max >= moderate - s THEN 'MODERATE' WHEN t_max >= mild - s THEN 'MILD' ELSE 'NONE' END AS level, count(*) AS n FROM x GROUP BY 1, 2""")
def crop_heat_stress(spark, sf_dir):
    """Q22: days by heat stress of each crop at flowering."""
    rows = days(spark, sf_dir).filter("t_max is not null").crossJoin(F.broadcast(crops(spark)))  # seven crops
    level = farm.heat_stress(F.col("t_max"), F.lit("flowering"))
    return rows.groupBy("crop", level.alias("level")).agg(F.count(F.lit(1)).alias("n"))
