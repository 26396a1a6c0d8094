"""What pages show, station reports and audits, catalogues of other sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import agro, heat
from ..functions.rounding import half_up
from ..operators import alerts, display, quality, series
from ..sources import synthetic
from ..sources.testdata import GRID_SQL, READINGS_SQL, readings, table
from .decisions import FILLED_SQL, wbgt
from .expressions import STULL_SQL, SUN_SQL
from .forecasts import BASE_SQL, scored
from .health import CENTROIDS, QUALITY_SQL, RAW_SQL, SMOOTH_SQL, business_day, latest_quality, raw, state_parts
from .outlook import EXACT_FIT_SQL, NOW, final_fit
from .registry import query, r4
from .windows import DAY_SQL, days, grid

KEYS = ["station_id"]


@query(f"""SELECT state, floor(max_value * 10 + 0.5) / 10 AS value FROM (SELECT arg_max(k, level * 4 + 14) AS state, max(level * 4 + 14) AS max_value FROM (VALUES {', '.join(f"({k}, {c['level']}::double)" for k, c in enumerate(CENTROIDS))}) t(k, level))""")
def hot_state(spark, sf_dir):
    """Q35: the warmest state and the value that it is centred on."""
    return spark.createDataFrame([alerts.hot_state(CENTROIDS, "level", 14.0, 4.0)], "state int, value double")


@query(f"""WITH {EXACT_FIT_SQL}, b AS (SELECT step, band AS pooled_band FROM pooled), t AS (SELECT step, avg(abs(e)) AS mae, any_value(pooled_band) AS band FROM held JOIN b USING (step) WHERE slot >= 1706100000 GROUP BY 1),
    pairs AS ({BASE_SQL.split("pairs AS (", 1)[1].replace("fits AS (SELECT step, week", "weekly_fits AS (SELECT step, week").replace("JOIN fits USING", "JOIN weekly_fits USING")},
    w AS (SELECT step, count(DISTINCT week) AS weeks, avg(abs(e)) AS weekly FROM scored GROUP BY 1)
    SELECT 'forecast_' || step || '_steps' AS name, step, {r4('mae')} AS test_mae, {r4('band')} AS band80, weeks, {r4('weekly')} AS weekly_mae FROM t JOIN w USING (step)""")
def model_registry(spark, sf_dir):
    """Q28: a row for each model horizon, from its final fit and its weekly back-test."""
    fits = final_fit(spark, sf_dir).select("step", "test_mae", "band80")
    weekly = scored(spark, sf_dir).groupBy("step").agg(F.count_distinct("week").alias("weeks"), half_up(F.avg(F.abs("e")), 4).alias("weekly_mae"))
    return weekly.join(fits, "step").select(F.concat(F.lit("forecast_"), "step", F.lit("_steps")).alias("name"), "step", "test_mae", "band80", "weeks", "weekly_mae")


@query(f"WITH {FILLED_SQL} SELECT station_id, slot, CASE WHEN imputed = 0 THEN floor(wbgt * 10 + 0.5) / 10 END AS line FROM wbgt WHERE slot >= {NOW} - 43200 AND slot <= {NOW} AND station_id <> 3")
def measured_wbgt(spark, sf_dir):
    """Q31: twelve hours of measured WBGT with breaks where an input was filled, for stations whose series is the one told of."""
    w = wbgt(spark, sf_dir)
    return display.measured_line(w, F.col("wbgt"), F.size("imputed") > 0, F.col("station_id") != 3, F.lit(NOW)).select("station_id", "slot", "line")


@query(f"""WITH {GRID_SQL}, i AS (SELECT station_id, slot, temp IS NULL AS t, rh IS NULL AS h, wind IS NULL AS w, press IS NULL AS p, rain IS NULL AS r FROM dense)
    SELECT station_id, slot, array_to_string(list_filter([CASE WHEN t THEN 'temperature' END, CASE WHEN h THEN 'humidity' END, CASE WHEN w THEN 'wind' END, CASE WHEN p THEN 'pressure' END, CASE WHEN t THEN 'wbgt' END,
        CASE WHEN r AND station_id <> 1 THEN 'rain' END], lambda x: x IS NOT NULL), ',') AS filled FROM i""")
def filled_readings(spark, sf_dir):
    """Q32: the displayed readings that were filled in; station 1 has a feed that tells rain only when it falls."""
    channels = ("temp", "rh", "wind", "press", "rain")
    g = grid(spark, sf_dir).withColumn("imputed", F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in channels))))
    return g.select("station_id", "slot", F.array_join(display.filled_readings(F.col("imputed"), F.col("station_id") == 1), ",").alias("filled"))


@query(f"""WITH {QUALITY_SQL}, d AS (SELECT station_id, sum(rain) AS rain FROM dense WHERE (slot + 10800) // 86400 = 19752 GROUP BY 1),
    s AS (SELECT station_id, CASE WHEN station_id = 2 THEN 'demo' ELSE 'station' END AS source, fresh_minutes, rain FROM quality LEFT JOIN d USING (station_id))
    SELECT station_id, source <> 'demo' AND fresh_minutes <= 180 AS real, CASE WHEN source <> 'demo' AND fresh_minutes <= 180 THEN {r4('rain')} END AS rain_today FROM s""")
def station_override(spark, sf_dir):
    """Q38: whether a station may stand for its area, and its rain of the day."""
    rain = grid(spark, sf_dir).filter(business_day() == 19752).groupBy("station_id").agg(half_up(F.sum("rain"), 4).alias("rain_today"))
    rows = latest_quality(spark, sf_dir).join(rain, KEYS, "left").withColumn("source", F.when(F.col("station_id") == 2, "demo").otherwise("station"))
    return display.overrides(rows).select("station_id", "real", "rain_today")


@query(f"""WITH {READINGS_SQL}, s AS (SELECT station_id, t AS "end", lag(t) OVER (PARTITION BY station_id ORDER BY t) AS start FROM readings), g AS (SELECT *, "end" - start AS seconds FROM s WHERE "end" - start > 3600)
    SELECT station_id, start, "end", seconds FROM g QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY seconds DESC, start) = 1""")
def longest_gap(spark, sf_dir):
    """Each station's longest silence."""
    return display.longest_gap(series.gaps(readings(spark, sf_dir), KEYS, F.lit(3600)), KEYS).select("station_id", "start", "end", "seconds")


@query("""WITH a AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS had FROM events GROUP BY 1)
    SELECT user_id, array_to_string(list_filter(['click', 'purchase', 'refund'], lambda x: list_contains(had, x)), ',') AS shared, array_to_string(list_filter(['click', 'error', 'purchase', 'refund'], lambda x: NOT list_contains(had, x)), ',') AS missing FROM a""")
def channel_sets(spark, sf_dir):
    """U4: channels that a list and a station share, and groups that the station lacks."""
    had = F.collect_set("event_type")
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(had.alias("had"))
    wanted, groups = (F.array(*map(F.lit, x)) for x in (("click", "purchase", "refund"), ("click", "error", "purchase", "refund")))
    return rows.select("user_id", F.array_join(F.array_intersect(wanted, "had"), ",").alias("shared"), F.array_join(F.array_except(groups, "had"), ",").alias("missing"))


PLACES = [("east", 5.1, 2.2), ("north", 3.3, 4.1), ("south", 2.9, 0.4), ("west", 0.7, 2.6)]


@query(f"""WITH p AS (SELECT c_custkey, (c_custkey * 37 % 700) / 100.0::double AS lng, (c_custkey * 53 % 450) / 100.0::double AS lat FROM customer), q(place, lng, lat) AS (VALUES {', '.join(f"('{n}', {x}::double, {y}::double)" for n, x, y in PLACES)}),
    d AS (SELECT c_custkey, place, sqrt((p.lng - q.lng) ** 2 + (p.lat - q.lat) ** 2) AS distance FROM p CROSS JOIN q)
    SELECT c_custkey, place, {r4('distance')} AS distance FROM d QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY round(distance, 9), place) = 1""")
def nearest_place(spark, sf_dir):
    """the nearest of a few points."""
    k = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select(k, (k * 37 % 700 / 100).alias("lng"), (k * 53 % 450 / 100).alias("lat"))
    places = spark.createDataFrame(PLACES, "place string, place_lng double, place_lat double")
    return display.nearest_point(points, places, ["c_custkey"]).withColumn("distance", half_up(F.col("distance"), 4))


@query(f"""WITH {FILLED_SQL}, d AS (SELECT station_id, (slot + 10800) // 86400 AS day, min(wbgt) AS low, max(wbgt) AS high, min(slot) AS start, max(slot) AS stop FROM wbgt GROUP BY 1, 2),
    h AS (SELECT *, (start + 10800 + 10799) // 10800 * 10800 - 10800 AS first, (stop + 10800) // 10800 * 10800 - 10800 AS last FROM d)
    SELECT station_id, day, array_to_string(generate_series((floor(low / 2) * 2)::BIGINT, (ceil(high / 2) * 2)::BIGINT, 2), ',') AS degrees,
        CASE WHEN first <= stop THEN array_to_string(generate_series(first, last, 10800), ',') ELSE '' END AS hours FROM h""")
def axis_ticks(spark, sf_dir):
    """degrees and local hours that a day's chart marks."""
    d = wbgt(spark, sf_dir).groupBy("station_id", business_day().alias("day")).agg(F.min("wbgt").alias("low"), F.max("wbgt").alias("high"), F.min("slot").alias("start"), F.max("slot").alias("stop"))
    text = lambda a: F.array_join(a.cast("array<string>"), ",")
    return d.select("station_id", "day", text(display.degree_ticks(F.col("low"), F.col("high"))).alias("degrees"), text(display.hour_ticks(F.col("start"), F.col("stop"))).alias("hours"))


@query("""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '2024-0' || (1 + o_orderkey % 3) || '-' || lpad((o_orderkey % 35)::VARCHAR, 2, '0') WHEN 1 THEN '2024-1-5' WHEN 2 THEN '2023-12-' || (10 + o_orderkey % 20) ELSE 'today' END AS raw FROM orders),
    d AS (SELECT o_orderkey, CASE WHEN regexp_matches(raw, '^\\d{4}-\\d{2}-\\d{2}$') THEN try_cast(raw AS DATE) END AS date FROM r)
    SELECT o_orderkey, CASE WHEN date >= DATE '2023-12-15' AND date < DATE '2024-02-20' THEN date::VARCHAR END AS date, coalesce(date BETWEEN DATE '2023-12-15' AND DATE '2024-01-10', false) AS trained FROM d""")
def replay_dates(spark, sf_dir):
    """Dates that can be replayed, and whether models were trained on them."""
    k = F.col("o_orderkey")
    made = F.concat(F.lit("2024-0"), 1 + k % 3, F.lit("-"), F.lpad((k % 35).cast("string"), 2, "0"))
    text = F.when(k % 4 == 0, made).when(k % 4 == 1, "2024-1-5").when(k % 4 == 2, F.concat(F.lit("2023-12-"), 10 + k % 20)).otherwise("today")
    date = display.replay_date(text, "2023-12-15", F.lit("2024-02-20").cast("date"))
    trained = F.coalesce(date.between(F.lit("2023-12-15").cast("date"), F.lit("2024-01-10").cast("date")), F.lit(False))
    return table(spark, sf_dir, "orders").select(k, date.cast("string").alias("date"), trained.alias("trained"))


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN (SELECT n_name FROM nation WHERE n_nationkey % 5 = 2)")
def allowed_stations(spark, sf_dir):
    """Rows whose exact id is on an allow-list."""
    nation = table(spark, sf_dir, "nation")
    listed = nation.filter("n_nationkey % 5 = 2").select("n_name")
    known = nation.join(F.broadcast(listed), "n_name", "left_semi")
    return table(spark, sf_dir, "customer").join(F.broadcast(known), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")


@query(f"""WITH {GRID_SQL}, air AS (SELECT DISTINCT dayofyear(make_timestamp((slot + 10800) * 1000000)) AS event_id, dayofyear(make_timestamp((slot + 10800) * 1000000)) AS doy FROM dense), {SUN_SQL}
    SELECT station_id, slot FROM dense JOIN h ON event_id = dayofyear(make_timestamp((slot + 10800) * 1000000)) WHERE (slot + 10800) % 86400 / 60.0 - 180 BETWEEN noon - 4 * ha AND noon + 4 * ha""")
def daylight_slots(spark, sf_dir):
    """Slots between sunrise and sunset of their own day."""
    sun = agro.sun_minutes(F.dayofyear(F.timestamp_seconds(F.col("slot") + 10800)))
    minute = (F.col("slot") + 10800) % 86400 / 60 - 180
    return grid(spark, sf_dir).filter(minute.between(sun["sunrise"], sun["sunset"])).select("station_id", "slot")


_MIX = "(({a}::HUGEINT * ({b})::HUGEINT) % 4294967296)::BIGINT"


def _uniform_sql(seed: str, n: str) -> str:
    """SQL: the n-th number of a seed."""
    t = f"(({seed} + ({n}) * 1831565813) % 4294967296)"
    a = _MIX.format(a=f"xor({t}, {t} >> 15)", b=f"({t} | 1)")
    return f"(SELECT xor(c, c >> 14) / 4294967296.0::DOUBLE FROM (SELECT xor(a, (a + {_MIX.format(a='xor(a, a >> 7)', b='(a | 61)')}) % 4294967296) AS c FROM (SELECT {a} AS a)))"


@query(f"""WITH k AS (SELECT station_id, k, 20260901 + station_id * 7919 AS seed, 1706486400 - (3999 - k) * 900 AS t FROM generate_series(0, 3) s(station_id) CROSS JOIN generate_series(0, 3999) r(k)),
    n AS (SELECT station_id, t, {_uniform_sql("seed", "k * 8 + 1")} AS u1, {_uniform_sql("seed", "k * 8 + 2")} AS u2, {_uniform_sql("seed", "k * 8 + 7")} AS u7, {_uniform_sql("seed", "k * 8 + 8")} AS u8, (t + 10800) % 86400 / 3600.0::DOUBLE AS hour FROM k),
    w AS (SELECT *, ((hour - 14.5::DOUBLE) % 24 + 24) % 24 AS away FROM n), b AS (SELECT *, exp(-least(away, 24 - away) * least(away, 24 - away) / 50) AS warm FROM w)
    SELECT station_id, t, floor((14 + 11 * warm + 0.3::DOUBLE * sqrt(-2 * ln(greatest(u1, 1 / 4294967296.0::DOUBLE))) * cos(2 * pi() * u2)) * 10 + 0.5) / 10 AS temp, CASE WHEN u7 < 0.02 THEN floor(2.5::DOUBLE * u8 * 10 + 0.5) / 10 ELSE 0 END AS rain FROM b""")
def synthetic_series(spark, sf_dir):
    """Made-up series by a seeded generator, each number by its place."""
    return synthetic.series(spark, 4, 1706486400, 1000, 20260901).select("station_id", "t", "temp", "rain")


@query("""WITH s AS (SELECT o_orderkey AS scene_id, o_custkey % 6 AS area, CASE o_orderkey % 2 WHEN 0 THEN 'a' ELSE 'b' END AS sensor, epoch_us(o_orderdate) // 86400000000 AS taken, o_orderkey * 37 % 100 AS cloud FROM orders)
    SELECT area, scene_id, sensor, taken, row_number() OVER (PARTITION BY area ORDER BY taken DESC, scene_id) AS place FROM s WHERE cloud < 80 QUALIFY place <= 6""")
def scene_search(spark, sf_dir):
    """The newest scenes of each area without much cloud, over all sensors."""
    k = F.col("o_orderkey")
    scenes = table(spark, sf_dir, "orders").select(
        k.alias("scene_id"), (F.col("o_custkey") % 6).alias("area"), F.when(k % 2 == 0, "a").otherwise("b").alias("sensor"), F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400).alias("taken"), (k * 37 % 100).alias("cloud")
    )
    return display.cloudless(scenes, ["area"], most_cloud=80, limit=6).select("area", "scene_id", "sensor", "taken", "place")


@query(f"""WITH {DAY_SQL}, v AS (SELECT station_id, day, t_max / 40 AS mean, temp_hours / 24.0::double AS coverage, (t_max - t_min) / 1000 AS spread FROM days)
    SELECT station_id, max(day) AS day, {r4('max_by(mean, day)')} AS mean FROM v WHERE coverage >= 0.5 AND spread >= 0.02 GROUP BY 1""")
def vegetation_latest(spark, sf_dir):
    """The index of the latest day with enough coverage and spread."""
    v = days(spark, sf_dir).select("station_id", "day", (F.col("t_max") / 40).alias("mean"), (F.col("temp_hours") / 24).alias("coverage"), ((F.col("t_max") - F.col("t_min")) / 1000).alias("spread"))
    found = display.latest_index(v, KEYS)
    return found.select("station_id", "day", half_up(F.col("mean"), 4).alias("mean"))


@query(f"""WITH {DAY_SQL}, m AS (SELECT station_id, day, CASE WHEN (day + station_id) % (station_id + 3) <> 0 THEN mm END AS soil FROM days), b AS (SELECT *, max(day) OVER (PARTITION BY station_id) - day AS back, max_by(soil, day) FILTER (soil IS NOT NULL) OVER (PARTITION BY station_id) AS now FROM m),
    c AS (SELECT station_id, count(soil) AS "values", avg(soil) AS mean, (count(*) FILTER (soil < now) + count(*) FILTER (soil = now) / 2.0) / count(soil) AS share FROM b WHERE back < 28 GROUP BY 1)
    SELECT station_id, "values", CASE WHEN "values" >= 21 THEN {r4('mean')} END AS mean, CASE WHEN "values" >= 21 THEN floor(share * 100 + 0.5)::BIGINT END AS percentile FROM c""")
def soil_year(spark, sf_dir):
    """A long record's mean and the rank of its latest value, told only if enough of it is there."""
    d = days(spark, sf_dir)
    m = d.select("station_id", "day", F.when((F.col("day") + F.col("station_id")) % (F.col("station_id") + 3) != 0, F.col("mm")).alias("soil"))
    return display.complete_year(m, KEYS, "soil", span=28, least=21)


@query("""WITH e AS (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) SELECT event_id, k FROM e WHERE k BETWEEN 10 AND 60""")
def stored_entries(spark, sf_dir):
    """Entries of a JSON store that fit the schema; the rest are dropped."""
    k = F.col("entry.k")
    return display.stored_entries(table(spark, sf_dir, "events"), "props", "k int", k.between(10, 60)).select("event_id", k.alias("k"))


AUDIT_SQL = f"""{FILLED_SQL}, a AS (SELECT station_id, slot, temp, rh, {STULL_SQL} AS stull, (slot + 10800) % 86400 BETWEEN 23400 AND 66600 AS daylight FROM filled WHERE imputed = 0),
    v AS (SELECT *, stull + (slot // 900 % 5 - 2) / 20.0::double AS wet_bulb, temp + rh / 50 + (slot // 900 % 3) / 10.0::double AS index, temp + rh / 50 AS formula, stull + (slot // 900 % 7 - 4) / 2.0::double AS firmware FROM a)"""


@query(f"""WITH {AUDIT_SQL} SELECT station_id, {r4('avg(abs(wet_bulb - stull))')} AS wet_bulb_mae, {r4('max(abs(wet_bulb - stull))')} AS wet_bulb_max, {r4('avg(abs(index - formula))')} AS heat_index_mae, {r4('avg(abs(index - formula)) FILTER (formula >= 27)')} AS heat_index_hot_mae,
    floor(avg((firmware < wet_bulb)::INTEGER) * 1000 + 0.5) / 10 AS below_pct, floor(avg((firmware < wet_bulb - 1.5)::INTEGER) * 1000 + 0.5) / 10 AS far_below_pct,
    floor(avg((firmware < wet_bulb)::INTEGER) FILTER (NOT daylight) * 1000 + 0.5) / 10 AS below_night_pct, floor(avg((firmware < wet_bulb)::INTEGER) FILTER (daylight) * 1000 + 0.5) / 10 AS below_day_pct FROM v GROUP BY 1""")
def heat_audits(spark, sf_dir):
    """The device's wet bulb, heat index and WBGT held against the formulas."""
    w = wbgt(spark, sf_dir).filter(F.size("imputed") == 0)
    k, t, rh = F.floor(F.col("slot") / 900), F.col("temp"), F.col("rh")
    stull = heat.stull_wet_bulb(t, rh)
    formula = t + rh / 50
    rows = w.select(
        "station_id",
        stull.alias("stull"),
        (stull + (k % 5 - 2) / 20).alias("wet_bulb"),
        formula.alias("formula"),
        (formula + k % 3 / 10).alias("index"),
        (stull + (k % 7 - 4) / 2).alias("firmware"),
        ((F.col("slot") + 10800) % 86400).between(23400, 66600).alias("daylight"),
    )
    return display.heat_audit(rows, KEYS)


@query(f"""WITH {READINGS_SQL}, h AS (SELECT station_id, t // 3600 AS hour, avg(temp) AS temp, avg(rh) AS rh, avg(wind) AS wind FROM readings GROUP BY 1, 2), m AS (SELECT *, 0.7::double * ({STULL_SQL}) + 0.3::double * temp AS model, (hour + 3) % 24 AS hour_of_day FROM h WHERE temp IS NOT NULL AND rh IS NOT NULL AND wind IS NOT NULL)
    SELECT hour_of_day, count(*) AS hours, {r4('avg(model - wind / 10 - (temp - 1))')} AS bias, {r4('avg(abs(model - wind / 10 - (temp - 1)))')} AS mae FROM m GROUP BY 1""")
def audit_by_hour(spark, sf_dir):
    """A10: hours whose inputs are all there, the model held against the device by local hour of day."""
    h = display.complete_hours(readings(spark, sf_dir), KEYS, ["temp", "rh", "wind"])
    model = heat.shade_wbgt(F.col("temp"), heat.stull_wet_bulb(F.col("temp"), F.col("rh")))
    d = model - F.col("wind") / 10 - (F.col("temp") - 1)
    return h.groupBy("hour_of_day").agg(F.count(F.lit(1)).alias("hours"), half_up(F.avg(d), 4).alias("bias"), half_up(F.avg(F.abs(d)), 4).alias("mae"))


@query(f"""WITH {RAW_SQL}, d AS (SELECT *, CASE WHEN (slot + 10800) // 86400 % 3 = 0 THEN gust ELSE rh END AS gust_dir FROM raw), h AS (SELECT station_id, count(DISTINCT (slot + 10800) // 86400) AS days_with_hits FROM long GROUP BY 1),
    c AS (SELECT station_id, count(*) AS slots, count(n) AS read, sum(n)::BIGINT AS readings, count(DISTINCT (slot + 10800) // 86400) AS days, {r4('count(*) FILTER (gust > 0 AND abs(gust_dir - gust) < 0.05) / nullif(count(*) FILTER (gust_dir IS NOT NULL AND gust > 0), 0)')} AS copy_share FROM d GROUP BY 1)
    SELECT station_id, slots, read, readings, days, copy_share, coalesce(days_with_hits, 0) AS days_with_hits FROM c LEFT JOIN h USING (station_id)""")
def station_report(spark, sf_dir):
    """What a station's report counts."""
    r = raw(spark, sf_dir)
    hits = quality.rule_hits(r, KEYS)
    turned = r.withColumn("gust_dir", F.when(business_day() % 3 == 0, F.col("gust")).otherwise(F.col("rh")))
    return display.report(turned, hits, KEYS, business_day()).select("station_id", "slots", "read", "readings", "days", "copy_share", "days_with_hits")


@query(f"""WITH {SMOOTH_SQL}, w AS (SELECT state, (lead(start) OVER (PARTITION BY station_id ORDER BY start) - start) / 3600.0::double AS h FROM segs)
    SELECT state, count(*) AS stays, {r4('avg(h)')} AS mean_hours, {r4('quantile_cont(h, 0.5)')} AS median_hours, {r4('avg((h <= 3)::INTEGER)')} AS short_share FROM w WHERE h IS NOT NULL GROUP BY 1""")
def state_waits(spark, sf_dir):
    """M9: how long states last until the next."""
    return display.waits(state_parts(spark, sf_dir), KEYS)


@query(f"""WITH {SMOOTH_SQL} SELECT state, count(*) AS slots, {r4('avg(level * 4 + 14)')} AS temp, {r4('avg(change * 3)')} AS change_1h FROM smooth JOIN features USING (station_id, slot) GROUP BY 1""")
def state_centres(spark, sf_dir):
    """The means of what a state's slots measured, in the units of the readings."""
    from .health import smoothed

    g = series.carry(grid(spark, sf_dir), KEYS, {"temp": 20.0})
    g = g.withColumn("change", F.col("temp") - F.lag("temp", 4).over(series.over(KEYS)))
    s = smoothed(spark, sf_dir).join(g.select("station_id", "slot", "temp", "change"), ["station_id", "slot"])
    return s.groupBy("state").agg(F.count(F.lit(1)).alias("slots"), half_up(F.avg("temp"), 4).alias("temp"), half_up(F.avg("change"), 4).alias("change_1h"))
