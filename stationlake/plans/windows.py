"""Features, climatology, completeness-gated sums, spells: what runs over the grid."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.rounding import half_up, upper_median
from ..operators import daily, series
from ..sources.testdata import GRID_SQL, READINGS_SQL, readings
from .registry import query, r4

KEYS = ["station_id"]
W = "PARTITION BY station_id ORDER BY slot"
DAY_SQL = f"""{READINGS_SQL},
    hours AS (SELECT station_id, (t + 10800) // 86400 AS day, (t + 10800) // 3600 AS hour, rain, temp FROM readings),
    days AS (
    SELECT station_id, day, sum(rain) AS mm, count(DISTINCT CASE WHEN rain IS NOT NULL THEN hour END) AS rain_hours,
        max(temp) AS t_max, min(temp) AS t_min, count(DISTINCT CASE WHEN temp IS NOT NULL THEN hour END) AS temp_hours
    FROM hours GROUP BY 1, 2)"""


def grid(spark, sf_dir):
    return series.dense(series.slot_grid(readings(spark, sf_dir), KEYS), KEYS)


def days(spark, sf_dir):
    return daily.business_days(readings(spark, sf_dir), KEYS)


@query(f"""WITH {GRID_SQL} SELECT station_id, slot, {r4(f'lag(temp, 4) OVER ({W})')} AS temp_1h, {r4(f'temp - lag(temp, 4) OVER ({W})')} AS temp_d1h,
    {r4(f'temp - lag(temp, 12) OVER ({W})')} AS temp_d3h, {r4(f'avg(temp) OVER ({W} ROWS 3 PRECEDING)')} AS temp_mean,
    {r4(f'coalesce(stddev_samp(temp) OVER ({W} ROWS 3 PRECEDING), 0)')} AS temp_std, {r4(f'ln(1 + coalesce(sum(rain) OVER ({W} ROWS 3 PRECEDING), 0))')} AS rain_1h,
    {r4(f'ln(1 + coalesce(sum(rain) OVER ({W} ROWS 11 PRECEDING), 0))')} AS rain_3h, {r4('sin(2 * pi() * (slot % 86400) / 86400.0)')} AS hour_sin,
    {r4('cos(2 * pi() * (slot % 86400) / 86400.0)')} AS hour_cos FROM dense""")
def features_lag_roll(spark, sf_dir):
    """Lags, differences, rolling mean and sample deviation, log of rolling rain, the clock as a circle."""
    w = series.over(KEYS)
    back = lambda n: w.rowsBetween(-n + 1, 0)
    rain = lambda n: F.log1p(F.coalesce(F.sum("rain").over(back(n)), F.lit(0.0)))
    clock = F.col("slot") % 86400 * (2 * 3.141592653589793 / 86400)
    columns = {
        "temp_1h": F.lag("temp", 4).over(w),
        "temp_d1h": F.col("temp") - F.lag("temp", 4).over(w),
        "temp_d3h": F.col("temp") - F.lag("temp", 12).over(w),
        "temp_mean": F.avg("temp").over(back(4)),
        "temp_std": F.coalesce(F.stddev_samp("temp").over(back(4)), F.lit(0.0)),
        "rain_1h": rain(4),
        "rain_3h": rain(12),
        "hour_sin": F.sin(clock),
        "hour_cos": F.cos(clock),
    }
    return grid(spark, sf_dir).select("station_id", "slot", *(half_up(c, 4).alias(n) for n, c in columns.items()))


@query(f"""WITH {GRID_SQL}, s AS (SELECT station_id, slot, sum(rain) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS ahead,
        count(n) OVER ({W} ROWS BETWEEN 11 PRECEDING AND 12 FOLLOWING) AS known FROM dense)
    SELECT station_id, slot, (coalesce(ahead, 0) >= 0.1)::INTEGER AS wet FROM s WHERE known >= 12""")
def rain_label_lookahead(spark, sf_dir):
    """Whether the next three hours are wet, where enough slots around are known."""
    w = series.over(KEYS)
    g = grid(spark, sf_dir).withColumns({"ahead": F.sum("rain").over(w.rowsBetween(1, 12)), "known": F.count("n").over(w.rowsBetween(-11, 12))})
    return g.filter("known >= 12").select("station_id", "slot", (F.coalesce("ahead", F.lit(0.0)) >= 0.1).cast("int").alias("wet"))


@query(f"""WITH {GRID_SQL}, m AS (SELECT station_id, slot, (n IS NOT NULL)::INTEGER AS ok FROM dense),
    u AS (SELECT station_id, slot, min(ok) OVER ({W} ROWS 4 PRECEDING) AS origin, count(*) OVER ({W} ROWS 4 PRECEDING) AS behind, lead(ok, 4) OVER ({W}) AS target FROM m)
    SELECT station_id, slot, slot + 3600 AS target FROM u WHERE origin = 1 AND behind = 5 AND u.target = 1""")
def usable_origins(spark, sf_dir):
    """Forecast origins whose last five slots and target were measured."""
    w = series.over(KEYS)
    ok = F.col("n").isNotNull().cast("int")
    g = grid(spark, sf_dir).withColumns({"ok": ok}).withColumns(
        {"origin": F.min("ok").over(w.rowsBetween(-4, 0)), "behind": F.count("ok").over(w.rowsBetween(-4, 0)), "reached": F.lead("ok", 4).over(w)}
    )
    return g.filter("origin = 1 and behind = 5 and reached = 1").select("station_id", "slot", (F.col("slot") + 3600).alias("target"))


@query(f"""WITH {GRID_SQL}, u AS (SELECT station_id, slot, count(temp) OVER b AS n, avg(temp) OVER b AS usual FROM dense
        WINDOW b AS (PARTITION BY station_id, slot % 86400 ORDER BY slot RANGE BETWEEN 2592000 PRECEDING AND 86400 PRECEDING))
    SELECT station_id, slot, {r4('usual')} AS usual FROM u WHERE n >= 5""")
def rolling_climatology(spark, sf_dir):
    """What is usual at this time of day, from the 30 days before; a forecast for a later slot reads the usual of its target."""
    g = series.rolling_usual(grid(spark, sf_dir), KEYS, "temp", least=5)
    return g.filter("usual is not null").select("station_id", "slot", half_up(F.col("usual"), 4).alias("usual"))


@query(f"""WITH {GRID_SQL}, c AS (SELECT station_id, slot % 86400 // 900 AS slot_of_day, avg(temp) AS mean, count(temp) AS n FROM dense
        WHERE (slot >= 1704067200 AND slot < 1705276800) OR (slot >= 1705881600 AND slot < 1707000000) GROUP BY 1, 2)
    SELECT station_id, slot_of_day, {r4('mean')} AS mean, n, (min(n) OVER (PARTITION BY station_id) >= 2 AND count(*) OVER (PARTITION BY station_id) = 96) AS complete FROM c""")
def climatology_slot(spark, sf_dir):
    """Mean and count by slot of day over several ranges; complete if each slot has enough."""
    return daily.climatology(grid(spark, sf_dir), KEYS, "temp", [(1704067200, 1705276800), (1705881600, 1707000000)], least=2).withColumn("mean", half_up(F.col("mean"), 4))


@query(f"""WITH {DAY_SQL}, spine AS (SELECT station_id, unnest(generate_series(min(day), max(day))) AS day FROM days GROUP BY 1)
    SELECT station_id, day, {r4('CASE WHEN rain_hours >= 12 THEN mm END')} AS mm FROM spine LEFT JOIN days USING (station_id, day)""")
def daily_gated_sum(spark, sf_dir):
    """A3: rain of a business day, unknown unless enough of its hours were read; every day is there."""
    d = daily.gated(days(spark, sf_dir), KEYS, least_hours=12)
    return d.select("station_id", "day", half_up(F.col("mm"), 4).alias("mm"))


@query(f"""WITH {READINGS_SQL} SELECT station_id, t // 3600 AS hour, floor(avg(temp) * 10 + 0.5) / 10 AS temp, floor(avg(rh) * 10 + 0.5) / 10 AS rh,
    {r4('sum(rain)')} AS rain FROM readings GROUP BY 1, 2""")
def hourly_history(spark, sf_dir):
    """A4: hourly means of what was measured, to one decimal; rain summed."""
    r = readings(spark, sf_dir)
    return r.groupBy("station_id", F.floor(F.col("t") / 3600).alias("hour")).agg(
        half_up(F.avg("temp"), 1).alias("temp"), half_up(F.avg("rh"), 1).alias("rh"), half_up(F.sum("rain"), 4).alias("rain")
    )


@query(f"WITH {DAY_SQL} SELECT station_id, day, t_max, t_min, temp_hours FROM days")
def tmax_tmin_daily(spark, sf_dir):
    """Extremes of a business day and its measured hours."""
    return days(spark, sf_dir).select("station_id", "day", "t_max", "t_min", "temp_hours")


@query(f"""WITH {GRID_SQL}, last AS (SELECT station_id, max(slot) AS anchor FROM grid GROUP BY 1)
    SELECT station_id, max(temp) AS t_max, min(temp) AS t_min, count(DISTINCT ceil((slot - (anchor - 86400)) / 3600.0)) AS hours
    FROM grid JOIN last USING (station_id) WHERE slot > anchor - 86400 AND temp IS NOT NULL GROUP BY 1""")
def trailing_day(spark, sf_dir):
    """Extremes of the last 24 hours, the start left out, and its measured hours."""
    g = series.slot_grid(readings(spark, sf_dir), KEYS)
    anchor = g.groupBy("station_id").agg(F.max("slot").alias("anchor"))
    since = g.join(F.broadcast(anchor), "station_id").filter("slot > anchor - 86400 and temp is not null")
    hours = F.count_distinct(F.ceil((F.col("slot") - F.col("anchor") + 86400) / 3600)).alias("hours")
    return since.groupBy("station_id").agg(F.max("temp").alias("t_max"), F.min("temp").alias("t_min"), hours)


@query(f"""WITH {GRID_SQL}, e AS (SELECT station_id, max(slot) AS last FROM grid GROUP BY 1),
    m AS (SELECT station_id, slot, temp, slot - lag(slot) OVER ({W}) AS d FROM grid JOIN e USING (station_id) WHERE slot > last - 259200 AND temp IS NOT NULL)
    SELECT station_id, floor(count(*) FILTER (temp >= 20) * min(d) FILTER (d > 0) / 3600.0 * 10 + 0.5) / 10 AS hours FROM m GROUP BY 1""")
def hours_above(spark, sf_dir):
    """Measured hours of the last three days at a threshold or above, each slot worth the least spacing."""
    return daily.hours_above(series.slot_grid(readings(spark, sf_dir), KEYS), KEYS, "temp", 20.0, hours=72)


@query(f"""WITH {DAY_SQL}, l AS (SELECT station_id, max_by(mm, day) FILTER (mm IS NOT NULL) AS x FROM days GROUP BY 1)
    SELECT station_id, floor((count(*) FILTER (mm < x) + count(*) FILTER (mm = x) / 2.0) / count(mm) * 100 + 0.5)::BIGINT AS percentile
    FROM days JOIN l USING (station_id) GROUP BY 1""")
def midrank_pct(spark, sf_dir):
    """Mid-rank percentile of the latest day among all."""
    d = days(spark, sf_dir)
    latest = d.filter("mm is not null").groupBy("station_id").agg(F.max_by("mm", "day").alias("x"))
    share = (F.count_if(F.col("mm") < F.col("x")) + F.count_if(F.col("mm") == F.col("x")) / 2) / F.count("mm")
    return d.join(F.broadcast(latest), "station_id").groupBy("station_id").agg(F.floor(share * 100 + 0.5).alias("percentile"))


@query(f"""WITH {READINGS_SQL}, r AS (SELECT station_id, (t - 21600) // 86400 AS rain_day, t, rain FROM readings),
    prior AS (SELECT station_id, rain_day - 1 AS rain_day, list_sort(list(rain) FILTER (rain IS NOT NULL)) AS p FROM r GROUP BY 1, 2),
    own AS (SELECT station_id, rain_day, sum(rain) AS total, count(DISTINCT t // 900) AS slots FROM r GROUP BY 1, 2)
    SELECT station_id, rain_day, {r4('coalesce(p[len(p) // 2 + 1], CASE WHEN slots >= 77 THEN total END)')} AS mm FROM own LEFT JOIN prior USING (station_id, rain_day)""")
def rain_day_totals(spark, sf_dir):
    """A rain day's total as the next day reports it, by upper median; else its own sum if enough slots were read."""
    r = readings(spark, sf_dir).withColumn("rain_day", F.floor((F.col("t") - 21600) / 86400))
    prior = r.groupBy("station_id", (F.col("rain_day") - 1).alias("rain_day")).agg(upper_median(F.collect_list("rain")).alias("told"))
    own = r.groupBy("station_id", "rain_day").agg(F.sum("rain").alias("total"), F.count_distinct(F.floor(F.col("t") / 900)).alias("slots"))
    mm = F.coalesce("told", F.when(F.col("slots") >= 77, F.col("total")))
    return own.join(prior, ["station_id", "rain_day"], "left").select("station_id", "rain_day", half_up(mm, 4).alias("mm"))


@query(f"""WITH {DAY_SQL}, a AS (SELECT station_id, max(day) AS today FROM days GROUP BY 1)
    SELECT station_id, {r4('sum(mm) FILTER (day > today - 7)')} AS rain_7d, {r4('sum(mm) FILTER (day > today - 30)')} AS rain_30d,
        {r4('sum(CASE WHEN mm > 2 THEN 0.8 * mm ELSE 0 END) FILTER (day > today - 7)')} AS effective_7d, count(mm) FILTER (day > today - 7) AS reported_7d
    FROM days JOIN a USING (station_id) GROUP BY 1""")
def rain_totals(spark, sf_dir):
    """Rain of the last days, what of it counts, and the days reported."""
    from ..functions.agro import effective_rain

    d = days(spark, sf_dir)
    d = d.join(F.broadcast(d.groupBy("station_id").agg(F.max("day").alias("today"))), "station_id")
    since = lambda n, x: F.when(F.col("day") > F.col("today") - n, x)
    return d.groupBy("station_id").agg(
        half_up(F.sum(since(7, F.col("mm"))), 4).alias("rain_7d"),
        half_up(F.sum(since(30, F.col("mm"))), 4).alias("rain_30d"),
        half_up(F.sum(since(7, F.coalesce(effective_rain(F.col("mm")), F.lit(0.0)))), 4).alias("effective_7d"),
        F.count(since(7, F.col("mm"))).alias("reported_7d"),
    )


GATED_SQL = f"""{DAY_SQL}, spine AS (SELECT station_id, unnest(generate_series(min(day), max(day))) AS day FROM days GROUP BY 1),
    gated AS (SELECT station_id, day, CASE WHEN rain_hours >= 10 THEN mm END AS mm FROM spine LEFT JOIN days USING (station_id, day))"""


def gated(spark, sf_dir):
    return daily.gated(days(spark, sf_dir), KEYS, least_hours=10)


@query(f"""WITH {GATED_SQL}, l AS (SELECT station_id, max(day) FILTER (mm IS NOT NULL) AS latest, min(day) AS first FROM gated GROUP BY 1),
    s AS (SELECT station_id, any_value(latest) AS latest, any_value(first) AS first, max(day) FILTER (mm IS NULL OR mm < 30) AS stop_wet, max(day) FILTER (mm IS NULL OR mm >= 30) AS stop_dry
        FROM gated JOIN l USING (station_id) WHERE latest IS NULL OR day <= latest GROUP BY 1)
    SELECT station_id, coalesce(latest - coalesce(stop_wet, first - 1), 0) AS wet_days, coalesce(latest - coalesce(stop_dry, first - 1), 0) AS dry_days FROM s""")
def spell_length(spark, sf_dir):
    """Days in a row up to the latest read one that were wet, or dry; an unread day in between ends both."""
    return daily.spells(gated(spark, sf_dir), KEYS, threshold=30.0)


@query(f"""WITH {GATED_SQL}, s AS (SELECT station_id, day, sum(coalesce(mm, 0)) OVER w AS mm3, day - min(day) OVER (PARTITION BY station_id) >= 2 AS whole, max(day) OVER (PARTITION BY station_id) AS today
        FROM gated WINDOW w AS (PARTITION BY station_id ORDER BY day ROWS 2 PRECEDING))
    SELECT station_id, floor(greatest(0, coalesce(max(mm3) FILTER (whole AND day > today - 8), 0)) * 10 + 0.500001) / 10 AS mm FROM s GROUP BY 1""")
def best_3day(spark, sf_dir):
    """The wettest three days in a row among the last ten; an unread day counts as none."""
    return daily.best_wetting(gated(spark, sf_dir), KEYS)


@query(f"""WITH {DAY_SQL}, e AS (SELECT station_id, day, least(150, greatest(0, mm)) AS mm FROM (SELECT station_id, (t + 10800) // 86400 AS day, rain * 60 AS mm FROM readings WHERE rain > 0))
    SELECT station_id, day, floor(least(150, sum(mm)) * 10 + 0.5) / 10 AS mm FROM e GROUP BY 1, 2""")
def irrigation_daily(spark, sf_dir):
    """Applied water a day; entries and days are capped."""
    r = readings(spark, sf_dir).filter("rain > 0").select("station_id", F.floor((F.col("t") + 10800) / 86400).alias("day"), (F.col("rain") * 60).alias("mm"))
    return daily.irrigation(r, ["station_id", "day"], cap=150.0)


@query(f"""WITH {DAY_SQL}, s AS (SELECT station_id, day, count(*) OVER (PARTITION BY station_id ORDER BY day DESC) AS back, mm FROM days)
    SELECT station_id, {r4('CASE WHEN count(mm) = 5 THEN sum(mm) END')} AS ahead_mm FROM s WHERE back <= 5 GROUP BY 1""")
def complete_ahead(spark, sf_dir):
    """Q43, Q44: a sum over a fixed number of rows, unknown if one is."""
    d = days(spark, sf_dir)
    w = Window.partitionBy("station_id").orderBy(F.desc("day"))
    last = d.withColumn("back", F.row_number().over(w)).filter("back <= 5")
    return last.groupBy("station_id").agg(half_up(F.when(F.count("mm") == 5, F.sum("mm")), 4).alias("ahead_mm"))


@query(f"""WITH {DAY_SQL} SELECT station_id, day, t_max, t_min FROM days QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY day DESC) <= 21""")
def recent_tail(spark, sf_dir):
    """The last rows of each series."""
    w = Window.partitionBy("station_id").orderBy(F.desc("day"))
    return days(spark, sf_dir).withColumn("k", F.row_number().over(w)).filter("k <= 21").select("station_id", "day", "t_max", "t_min")


@query(f"""WITH {READINGS_SQL}, r AS (SELECT station_id, (t + 10800) // 86400 AS day, value AS total, t FROM readings JOIN (SELECT event_id, value FROM events) USING (event_id)),
    g AS (SELECT station_id, t, rain FROM readings WHERE rain IS NOT NULL)
    SELECT station_id, t - t % 900 AS slot, max(n_before) AS n FROM (SELECT station_id, t, count(*) OVER (PARTITION BY station_id ORDER BY t RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n_before FROM g) GROUP BY 1, 2""")
def sliding_count(spark, sf_dir):
    """Sliding windows: the most readings in any hour that ends in a slot."""
    g = readings(spark, sf_dir).filter("rain is not null")
    hour = Window.partitionBy("station_id").orderBy("t").rangeBetween(-3600, 0)
    return g.withColumn("k", F.count(F.lit(1)).over(hour)).groupBy("station_id", (F.col("t") - F.col("t") % 900).alias("slot")).agg(F.max("k").alias("n"))
