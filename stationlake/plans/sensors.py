"""The remaining sensor rules, the sun's place, light and colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import agro, sun
from ..functions.rounding import half_up
from ..operators import quality
from ..sources.testdata import GRID_SQL, table
from .registry import query, r4
from .windows import DAY_SQL, days, grid

KEYS = ["station_id"]
WIDE_SQL = f"""{GRID_SQL}, wide AS (SELECT station_id, slot, (slot + 10800) // 86400 AS day, temp, temp + (slot // 900 % 9 - 4) / 3.0::double AS temp_b, temp - 0.2::double AS temp_c, rh * 5 AS light, gust,
        CASE WHEN (slot + 10800) // 86400 % 3 = 0 THEN gust ELSE rh END AS gust_dir, slot // 900 % 5 AS code, temp - slot // 900 % 4 AS firmware, temp AS wet_bulb FROM dense)"""


def wide(spark, sf_dir):
    k = F.floor(F.col("slot") / 900)
    day = F.floor((F.col("slot") + 10800) / 86400)
    g = grid(spark, sf_dir).withColumn("day", day)
    return g.withColumns(
        {
            "temp_b": F.col("temp") + (k % 9 - 4) / 3,
            "temp_c": F.col("temp") - 0.2,
            "light": F.col("rh") * 5,
            "gust_dir": F.when(day % 3 == 0, F.col("gust")).otherwise(F.col("rh")),
            "code": k % 5,
            "firmware": F.col("temp") - k % 4,
            "wet_bulb": F.col("temp"),
        }
    )


@query(f"""WITH {WIDE_SQL}, d AS (SELECT *, sum((gust_dir IS NOT NULL AND gust > 0)::INTEGER) OVER w AS gusts, sum((gust > 0 AND abs(gust_dir - gust) < 0.05)::INTEGER) OVER w AS copies, count(*) OVER w AS slots
        FROM wide WINDOW w AS (PARTITION BY station_id, day))
    SELECT station_id, slot, 'R06' AS rule, 'light' AS channel, 'suspect' AS flag FROM d WHERE light < 240
    UNION ALL SELECT station_id, slot, 'R09', c, 'suspect' FROM d CROSS JOIN (VALUES ('temp'), ('temp_b'), ('temp_c')) t(c) WHERE greatest(temp, temp_b, temp_c) - least(temp, temp_b, temp_c) > 2
    UNION ALL SELECT station_id, slot, 'R13', 'gust_dir', 'bad' FROM d WHERE gust_dir IS NOT NULL AND gusts > 0.05 * slots AND copies >= 0.99 * gusts
    UNION ALL SELECT station_id, slot, 'R15', 'code', 'info' FROM d WHERE code <> 0 UNION ALL SELECT station_id, slot, 'R16', 'firmware', 'suspect' FROM d WHERE firmware < wet_bulb - 1.5""")
def sensor_hits(spark, sf_dir):
    """R06, R09, R13, R15, R16 as long rows."""
    return quality.sensor_hits(wide(spark, sf_dir), KEYS, F.col("day"))


@query(f"""WITH {DAY_SQL}, p AS (SELECT station_id, day, mm, lead(mm, 2) OVER (PARTITION BY station_id ORDER BY day) - 10 AS other FROM days), g AS (SELECT station_id, day, mm AS a, CASE WHEN other < 0 THEN 0 ELSE other END AS b FROM p)
    SELECT station_id, day, 'gauge_2' AS gauge FROM g WHERE a >= 0.4 AND b = 0 UNION ALL SELECT station_id, day, 'gauge_1' FROM g WHERE b >= 0.4 AND a = 0""")
def silent_gauges(spark, sf_dir):
    """Days on which one gauge was silent."""
    from pyspark.sql import Window

    other = F.lead("mm", 2).over(Window.partitionBy("station_id").orderBy("day")) - 10
    d = days(spark, sf_dir).withColumn("b", F.when(other < 0, 0.0).otherwise(other))
    return d.select("station_id", "day", quality.silent_gauge(F.col("mm"), F.col("b")).alias("gauge")).filter("gauge is not null")


@query(f"""WITH {WIDE_SQL}, c AS (UNPIVOT (SELECT station_id, day, count(temp) AS temp, count(rh) AS rh, count(press) AS press, count(rain) AS rain FROM (SELECT w.*, d.rh, d.press, d.rain FROM wide w JOIN dense d USING (station_id, slot)) GROUP BY 1, 2)
        ON temp, rh, press, rain INTO NAME channel VALUE readings) SELECT station_id, day, channel FROM c WHERE readings = 0""")
def empty_channels(spark, sf_dir):
    """Channels silent for a day."""
    return quality.empty_channels(wide(spark, sf_dir), KEYS, ["temp", "rh", "press", "rain"], F.col("day"))


SUN_SQL = """at AS (SELECT event_id, epoch_us(ts) // 1000000 AS s FROM events), c AS (SELECT *, (s / 86400.0::double + 2440587.5::double - 2451545) / 36525 AS t FROM instants),
    m AS (SELECT *, radians(280.46646::double + t * (36000.76983::double + t * 0.0003032::double)) AS l, radians(357.52911::double + t * (35999.05029::double - t * 0.0001537::double)) AS m,
        0.016708634::double - t * (0.000042037::double + t * 0.0000001267::double) AS e, radians(125.04::double - 1934.136::double * t) AS o FROM c),
    q AS (SELECT *, (1.914602::double - t * (0.004817::double + 0.000014::double * t)) * sin(m) + (0.019993::double - 0.000101::double * t) * sin(2 * m) + 0.000289::double * sin(3 * m) AS centre FROM m),
    p AS (SELECT *, l + radians(centre - 0.00569::double - 0.00478::double * sin(o)) AS a, radians((84381.448::double - t * (46.815::double + t * (0.00059::double - t * 0.001813::double))) / 3600 + 0.00256::double * cos(o)) AS tilt FROM q),
    d AS (SELECT *, asin(sin(tilt) * sin(a)) AS decl, pow(tan(tilt / 2), 2) AS y FROM p),
    h AS (SELECT *, radians(s % 86400 / 240.0::double) + y * sin(2 * l) - 2 * e * sin(m) + 4 * e * y * sin(m) * cos(2 * l) - 0.5::double * y * y * sin(4 * l) - 1.25::double * e * e * sin(2 * m) + radians(37.014528::double - 180) AS turned FROM d),
    z AS (SELECT event_id, sin(radians(-1.099736::double)) * sin(decl) + cos(radians(-1.099736::double)) * cos(decl) * cos(turned) AS cosine, 1.000001018::double * (1 - e * e) / (1 + e * cos(m + radians(centre))) AS au FROM h)""".replace("at AS (", "instants AS (", 1)


@query(f"WITH {SUN_SQL} SELECT z.event_id AS event_id, {r4('cosine')} AS cosine, {r4('au')} AS au, {r4('CASE WHEN value IS NULL THEN NULL WHEN cosine <= 0 THEN 0 ELSE greatest(greatest(value * 4 - 253, 0) * (0.135251::double + 0.098669::double * (1 - cosine)), 0) END')} AS light FROM z JOIN events USING (event_id)")
def solar_position(spark, sf_dir):
    """the sun's height and distance, and the light that infrared counts stand for."""
    e = table(spark, sf_dir, "events").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    cosine, au = sun.position(F.col("s"))
    rows = e.withColumns({"cosine": cosine, "au": au})
    light = agro.solar_irradiance(F.col("value") * 4, F.col("cosine"), 253.0, 0.135251, 0.098669)
    return rows.select("event_id", half_up(F.col("cosine"), 4).alias("cosine"), half_up(F.col("au"), 4).alias("au"), half_up(light, 4).alias("light"))


SLICES_SQL = """instants AS (SELECT h * 100 + k AS event_id, h + (2 * k + 1) * 30 AS s FROM (SELECT DISTINCT epoch_us(ts) // 3600000000 * 3600 AS h FROM events) CROSS JOIN (SELECT unnest(range(60)) AS k)
    UNION ALL SELECT DISTINCT epoch_us(ts) // 3600000000 * 360000 + 60, epoch_us(ts) // 3600000000 * 3600 + 1800 FROM events), c AS"""


@query(f"""WITH {SLICES_SQL}{SUN_SQL[SUN_SQL.index(", c AS") + len(", c AS"):]},
    g AS (SELECT event_id // 100 AS hour, sum(greatest(cosine, 0)) FILTER (event_id % 100 < 60) AS total, count(*) FILTER (event_id % 100 < 60 AND cosine > 0) AS lit, max(au) FILTER (event_id % 100 = 60) AS au FROM z GROUP BY 1)
    SELECT hour, {r4('total / 60')} AS cosine, {r4('CASE WHEN lit > 0 THEN total / lit ELSE 0 END')} AS sunlit, {r4('au')} AS au FROM g""")
def hourly_sun(spark, sf_dir):
    """the sun over each hour that has readings, over the whole of it and over its sunlit part."""
    hours = table(spark, sf_dir, "events").select((F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) * 3600).alias("hour")).distinct()
    mean, sunlit, au = sun.hourly(F.col("hour"))
    return hours.select("hour", half_up(mean, 4).alias("cosine"), half_up(sunlit, 4).alias("sunlit"), half_up(au, 4).alias("au"))


@query("""SELECT event_id, CASE WHEN value IS NULL THEN 'grey' WHEN value / 10 < 14 THEN '#ECA47F' WHEN value / 10 < 18 THEN '#E28755' WHEN value / 10 < 22 THEN '#D56927' WHEN value / 10 < 26 THEN '#C15000' WHEN value / 10 < 30 THEN '#A53E00' ELSE '#822F00' END AS thermal,
    CASE WHEN value IS NULL THEN 'grey' WHEN value / 20 < 0.5 THEN '#EAF4FA' WHEN value / 20 < 2 THEN '#93C5FD' WHEN value / 20 < 6 THEN '#3786B5' WHEN value / 20 < 12 THEN '#1E5A8A' ELSE '#0F3A5C' END AS wet FROM events""")
def scale_colours(spark, sf_dir):
    """values to the colours of a map."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", sun.colour(v / 10, "temperature", "grey").alias("thermal"), sun.colour(v / 20, "rain", "grey").alias("wet"))
