"""Ingest: cleaning, limits, deduplication, unions, the slot grid and its gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rounding import half_up, upper_median
from ..operators import clean, series
from ..sources.testdata import GRID_SQL, READINGS_SQL, readings, table
from .registry import query, r4

KEYS = ["station_id"]


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, ts AS observed FROM events WHERE event_id % 11 <> 0""")
def clean_numeric(spark, sf_dir):
    """Values and timestamps from text; -999.9, empty and unreadable mean missing, rows without a time go."""
    e = table(spark, sf_dir, "events")
    raw = e.select(
        "event_id",
        F.when(F.col("event_id") % 7 == 0, F.element_at(F.array(*map(F.lit, ("-999.9", "", "n/a", "NaN"))), (F.col("event_id") % 4 + 1).cast("int")))
        .otherwise(F.col("value").cast("string"))
        .alias("value"),
        F.when(F.col("event_id") % 11 == 0, "not a time").otherwise(F.col("ts").cast("string")).alias("ts"),
    )
    cleaned = raw.select("event_id", clean.numeric(F.col("value")).alias("value"), clean.parse_utc(F.col("ts")).alias("at"))
    return cleaned.filter("at is not null").select("event_id", "value", F.col("at").cast("timestamp_ntz").alias("observed"))


@query("""WITH raw AS (
    SELECT event_id, value / 5 - 5 AS temp, value / 2 - 10 AS rh, 790 + value / 2 AS press, value / 4 AS wind, value / 5 AS gust, value / 20 AS rain, 20.0::DOUBLE AS wet_bulb
    FROM events), judged AS (
    SELECT *, temp < -5 OR temp > 45 AS bt, rh <= 0 OR rh > 100 AS bh, press < 800 OR press > 900 AS bp, wind < 0 OR wind > 60 AS bw,
        gust < 0 OR gust > 75 AS bg, rain < 0 OR rain > 10 AS br FROM raw)
    SELECT event_id, CASE WHEN NOT bt THEN temp END AS temp, CASE WHEN NOT bh THEN rh END AS rh, CASE WHEN NOT bp THEN press END AS press,
        CASE WHEN NOT bw THEN wind END AS wind, CASE WHEN NOT bg THEN gust END AS gust, CASE WHEN NOT br THEN rain END AS rain,
        CASE WHEN NOT (bt OR bh) THEN wet_bulb END AS wet_bulb,
        array_to_string(list_filter([CASE WHEN bt THEN 'temp' END, CASE WHEN bh THEN 'rh' END, CASE WHEN bp THEN 'press' END,
            CASE WHEN bw THEN 'wind' END, CASE WHEN bg THEN 'gust' END, CASE WHEN br THEN 'rain' END], lambda x: x IS NOT NULL), ',') AS rejected,
        CASE WHEN NOT bg AND NOT bw AND gust < wind THEN 'wind_gust' ELSE '' END AS faults
    FROM judged""")
def hard_limits(spark, sf_dir):
    """Impossible values become null and are named; what depends on them goes too."""
    v = F.col("value")
    raw = table(spark, sf_dir, "events").select(
        "event_id",
        (v / 5 - 5).alias("temp"),
        (v / 2 - 10).alias("rh"),
        (790 + v / 2).alias("press"),
        (v / 4).alias("wind"),
        (v / 5).alias("gust"),
        (v / 20).alias("rain"),
        F.lit(20.0).alias("wet_bulb"),
    )
    checked = clean.tag_gust_fault(clean.hard_limits(raw, dependent={"wet_bulb": ["temp", "rh"]}))
    return checked.withColumns({c: F.array_join(c, ",") for c in ("rejected", "faults")})


@query(f"""WITH {READINGS_SQL}, m AS (SELECT *, t - t % 3600 AS hour FROM readings)
    SELECT station_id, hour, max(event_id) AS event_id, count(*) - 1 AS duplicates FROM m GROUP BY 1, 2""")
def dedup_last_wins(spark, sf_dir):
    """Of rows with the same key and time the last one stays; how many went is kept."""
    r = readings(spark, sf_dir).withColumn("hour", F.col("t") - F.col("t") % 3600)
    return clean.last_wins(r, ["station_id", "hour"], "event_id").select("station_id", "hour", "event_id", "duplicates")


@query(f"""WITH {READINGS_SQL}, m AS (SELECT station_id, t - t % 1800 AS half_hour, event_id, event_id % 3 AS feed FROM readings)
    SELECT station_id, half_hour, event_id, feed FROM m QUALIFY row_number() OVER (PARTITION BY station_id, half_hour ORDER BY feed, event_id) = 1""")
def precedence_union(spark, sf_dir):
    """Several feeds; at a shared time the first feed wins."""
    r = readings(spark, sf_dir).select("station_id", (F.col("t") - F.col("t") % 1800).alias("half_hour"), "event_id", (F.col("event_id") % 3).alias("feed"))
    feeds = [r.filter(F.col("feed") == k).drop("feed") for k in range(3)]
    return clean.precedence(feeds, ["station_id", "half_hour"], tie="event_id").withColumnRenamed("source_rank", "feed")


@query(f"""WITH {READINGS_SQL}, anchored AS (
    SELECT station_id, event_id % 3 AS source, max(t) AS anchor, count(*) AS n FROM readings WHERE event_id % 5 < 3 OR event_id % 3 <> station_id % 3 GROUP BY 1, 2)
    SELECT station_id, arg_max(source, anchor * 10 - source) AS source, max(anchor) AS anchor FROM anchored WHERE n >= 20 GROUP BY 1""")
def source_failover(spark, sf_dir):
    """Of the sources with enough rows, the one with the freshest anchor, the first of equals."""
    r = readings(spark, sf_dir).withColumn("source", F.col("event_id") % 3)
    r = r.filter((F.col("event_id") % 5 < 3) | (F.col("source") != F.col("station_id") % 3))
    return clean.failover(r, ["station_id"], "source", "t", least_rows=20)


@query(f"WITH {READINGS_SQL} SELECT station_id, min(t) AS first, max(t) AS last, count(*) AS n FROM readings GROUP BY 1")
def coverage(spark, sf_dir):
    """First and last reading."""
    return readings(spark, sf_dir).groupBy("station_id").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {READINGS_SQL}, b AS (SELECT 1704672000 AS lo, 1704758400 AS hi)
    SELECT station_id, event_id, t FROM readings, b WHERE t BETWEEN lo AND hi
    UNION ALL SELECT station_id, max_by(event_id, (t, event_id)), max(t) FROM readings, b WHERE t < lo GROUP BY station_id""")
def range_scan_prior(spark, sf_dir):
    """S3: the rows of a range and, for differences, the one just before it."""
    return clean.range_with_prior(readings(spark, sf_dir), ["station_id"], "t", 1704672000, 1704758400, tie="event_id").select("station_id", "event_id", "t")


@query("""SELECT event_id,
        CASE WHEN ts >= TIMESTAMP '2024-01-10' AND NOT (ts >= TIMESTAMP '2024-01-12' AND ts < TIMESTAMP '2024-01-15') THEN value ELSE 0.5 END AS uv,
        CASE WHEN ts >= TIMESTAMP '2024-01-10' AND NOT (ts >= TIMESTAMP '2024-01-12' AND ts < TIMESTAMP '2024-01-15') THEN NULL ELSE value END AS rain_total
    FROM events""")
def column_repair(spark, sf_dir):
    """From a date on, but for some days, one column holds another's values."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.lit(0.5).alias("uv"), F.col("value").alias("rain_total"))
    wrong = (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & ~(
        (F.col("ts") >= F.lit("2024-01-12").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))
    )
    return clean.move_column(e, "rain_total", "uv", wrong).select("event_id", "uv", "rain_total")


@query(f"""WITH {READINGS_SQL} SELECT station_id, t - t % 10800 AS window_start, {r4('avg(temp)')} AS temp, {r4('avg(rh)')} AS rh, {r4('avg(press)')} AS press,
    {r4('avg(wind)')} AS wind, {r4('sum(rain)')} AS rain FROM readings GROUP BY 1, 2""")
def pivot_feed(spark, sf_dir):
    """A long feed of (time, channel, value) to one row a time."""
    channels = ("temp", "rh", "press", "wind", "rain")
    r = readings(spark, sf_dir).select("station_id", (F.col("t") - F.col("t") % 10800).alias("window_start"), *channels)
    long = r.unpivot(["station_id", "window_start"], list(channels), "channel", "value").filter("value is not null")
    wide = long.groupBy("station_id", "window_start").pivot("channel", list(channels)).agg(F.avg("value").alias("mean"), F.sum("value").alias("sum"))
    return wide.select("station_id", "window_start", *(half_up(F.col(f"{c}_mean"), 4).alias(c) for c in channels[:-1]), half_up(F.col("rain_sum"), 4).alias("rain"))


@query(f"""WITH {READINGS_SQL}, d AS (SELECT station_id, t // 86400 AS day, t % 86400 // 3600 AS hour, avg(temp) AS temp, max(wind) AS wind FROM readings GROUP BY 1, 2, 3),
    tail AS (SELECT station_id, day, max(hour) FILTER (temp IS NOT NULL OR wind IS NOT NULL) AS last FROM d GROUP BY 1, 2)
    SELECT station_id, day, hour, {r4('temp')} AS temp, {r4('wind / 3.6')} AS wind_ms FROM d JOIN tail USING (station_id, day) WHERE hour <= last""")
def zip_arrays(spark, sf_dir):
    """Parallel arrays zipped by index, units converted, the unpublished tail cut off."""
    r = readings(spark, sf_dir)
    hourly = r.groupBy("station_id", F.floor(F.col("t") / 86400).alias("day"), F.floor(F.col("t") % 86400 / 3600).alias("hour")).agg(F.avg("temp").alias("temp"), F.max("wind").alias("wind"))
    document = hourly.groupBy("station_id", "day").agg(F.array_sort(F.collect_list(F.struct("hour", "temp", "wind"))).alias("h"))
    document = document.select("station_id", "day", F.col("h.hour").alias("hour"), F.col("h.temp").alias("temp"), F.col("h.wind").alias("wind"))
    rows = clean.zip_arrays(document, ["station_id", "day"], "hour", ["temp", "wind"])
    return rows.select("station_id", "day", "hour", half_up(F.col("temp"), 4).alias("temp"), half_up(F.col("wind") / 3.6, 4).alias("wind_ms"))


@query(f"""WITH {GRID_SQL} SELECT station_id, slot, {r4('temp')} AS temp, {r4('rh')} AS rh, {r4('press')} AS press, {r4('wind')} AS wind, {r4('gust')} AS gust,
    {r4('rain')} AS rain, n FROM grid""")
def grid_15m(spark, sf_dir):
    """A1: readings to 15-minute slots."""
    g = series.slot_grid(readings(spark, sf_dir), KEYS)
    return g.select("station_id", "slot", *(half_up(F.col(c), 4).alias(c) for c in ("temp", "rh", "press", "wind", "gust", "rain")), "n")


@query("""SELECT user_id % 4 AS station_id, epoch_us(ts) // 3600000000 AS hour, floor(d * 10000 + 0.500001) / 10000 AS direction
    FROM (SELECT *, atan2(s, c) * 180 / pi() + CASE WHEN atan2(s, c) < -1e-9 THEN 360 ELSE 0 END AS d FROM (
        SELECT any_value(user_id % 4) AS user_id, min(ts) AS ts, sum(sin(radians(value))) AS s, sum(cos(radians(value))) AS c
        FROM events GROUP BY user_id % 4, epoch_us(ts) // 3600000000))""")
def circular_mean(spark, sf_dir):
    """A2: the mean of angles, here to four decimals."""
    e = table(spark, sf_dir, "events")
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    return e.groupBy((F.col("user_id") % 4).alias("station_id"), hour.alias("hour")).agg(clean.circular_mean("value", digits=4).alias("direction"))


@query(f"""WITH {READINGS_SQL} SELECT station_id, t - t % 900 AS slot, max_by(event_id, (t, event_id)) AS last_event,
    {r4('max_by(rain, (t, event_id)) FILTER (rain IS NOT NULL)')} AS last_rain FROM readings GROUP BY 1, 2""")
def last_in_slot(spark, sf_dir):
    """A1: the last non-null value of a slot, as counters need it."""
    r = readings(spark, sf_dir).withColumn("slot", F.col("t") - F.col("t") % 900)
    order = F.struct("t", "event_id")
    return r.groupBy("station_id", "slot").agg(
        F.max_by("event_id", order).alias("last_event"), half_up(F.max_by("rain", F.when(F.col("rain").isNotNull(), order)), 4).alias("last_rain")
    )


@query(f"WITH {GRID_SQL} SELECT station_id, slot, {r4('temp')} AS temp, coalesce(n, 0) AS n FROM dense")
def spine_left_join(spark, sf_dir):
    """Every slot of the calendar, with or without readings."""
    g = series.dense(series.slot_grid(readings(spark, sf_dir), KEYS), KEYS)
    return g.select("station_id", "slot", half_up(F.col("temp"), 4).alias("temp"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {GRID_SQL} SELECT station_id, slot, {r4("coalesce(last_value(temp IGNORE NULLS) OVER w, 20)")} AS temp, {r4("coalesce(last_value(rh IGNORE NULLS) OVER w, 60)")} AS rh,
    {r4("coalesce(last_value(press IGNORE NULLS) OVER w, 848)")} AS press, {r4("coalesce(last_value(wind IGNORE NULLS) OVER w, 1)")} AS wind,
    concat_ws(',', CASE WHEN temp IS NULL THEN 'temp' END, CASE WHEN rh IS NULL THEN 'rh' END, CASE WHEN press IS NULL THEN 'press' END, CASE WHEN wind IS NULL THEN 'wind' END) AS imputed
    FROM dense WINDOW w AS (PARTITION BY station_id ORDER BY slot)""")
def locf_with_flags(spark, sf_dir):
    """Last value carried forward with a default and a mark."""
    g = series.dense(series.slot_grid(readings(spark, sf_dir), KEYS), KEYS)
    filled = series.carry(g, KEYS, {"temp": 20.0, "rh": 60.0, "press": 848.0, "wind": 1.0})
    return filled.select("station_id", "slot", *(half_up(F.col(c), 4).alias(c) for c in ("temp", "rh", "press", "wind")), F.array_join("imputed", ",").alias("imputed"))


@query(f"""WITH {GRID_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY slot) AS k FROM dense), p AS (
    SELECT *, last_value(temp IGNORE NULLS) OVER b AS p, last_value(CASE WHEN temp IS NOT NULL THEN k END IGNORE NULLS) OVER b AS pk,
        first_value(temp IGNORE NULLS) OVER a AS q, first_value(CASE WHEN temp IS NOT NULL THEN k END IGNORE NULLS) OVER a AS qk
    FROM s WINDOW b AS (PARTITION BY station_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        a AS (PARTITION BY station_id ORDER BY slot ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
    SELECT station_id, slot, {r4('coalesce(temp, CASE WHEN qk - pk - 1 <= 2 THEN p + (q - p) * (k - pk) / (qk - pk) END)')} AS temp,
        coalesce(temp IS NULL AND qk - pk - 1 <= 2, false) AS interpolated FROM p""")
def interp_short_gaps(spark, sf_dir):
    """Gaps of one or two slots filled linearly."""
    g = series.dense(series.slot_grid(readings(spark, sf_dir), KEYS), KEYS)
    done = series.interpolate(g, KEYS, "temp")
    return done.select("station_id", "slot", half_up(F.col("temp"), 4).alias("temp"), "interpolated")


@query(f"""WITH {READINGS_SQL}, s AS (SELECT station_id, t - lag(t) OVER (PARTITION BY station_id ORDER BY t) AS d FROM readings)
    SELECT station_id, list_sort(list(d) FILTER (d IS NOT NULL))[count(d) // 2 + 1] AS cadence FROM s GROUP BY 1""")
def cadence_upper_median(spark, sf_dir):
    """The usual spacing of readings."""
    return series.cadence(readings(spark, sf_dir), KEYS)


@query(f"""WITH {READINGS_SQL}, s AS (SELECT station_id, t AS "end", lag(t) OVER (PARTITION BY station_id ORDER BY t) AS start FROM readings)
    SELECT station_id, start, "end", "end" - start AS seconds FROM s WHERE "end" - start > 3600""")
def gap_intervals(spark, sf_dir):
    """Silences of more than an hour."""
    return series.gaps(readings(spark, sf_dir), KEYS, F.lit(3600)).select("station_id", "start", "end", "seconds")


@query(f"""WITH {READINGS_SQL}, s AS (SELECT station_id, t AS e, lag(t) OVER (PARTITION BY station_id ORDER BY t) AS b FROM readings),
    g AS (SELECT station_id, b, e, unnest(generate_series(b - b % 900, e - e % 900, 900)) AS slot FROM s WHERE e - b > 3600)
    SELECT station_id, slot, sum(least(e, slot + 900) - greatest(b, slot))::BIGINT AS gap_seconds FROM g WHERE least(e, slot + 900) > greatest(b, slot) GROUP BY 1, 2""")
def gap_minutes_by_slot(spark, sf_dir):
    """Each silence charged to the slots it covers."""
    return series.charge_gaps(series.gaps(readings(spark, sf_dir), KEYS, F.lit(3600)), KEYS)
