"""Sensor rules, health scores, states and transitions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.heat import stull_wet_bulb
from ..functions.rounding import half_up
from ..operators import quality, series, states
from ..sources.testdata import GRID_SQL, READINGS_SQL, readings
from .expressions import STULL_SQL
from .registry import query, r4

KEYS = ["station_id"]
CHANNELS = ["temp", "rh", "press", "wind", "gust", "rain"]
FLAT_AIR = ["temp", "temp_b", "temp_c"]


def flat_sql(source: str, lengths: dict, air: list) -> str:
    """R08 over a table with station_id and slot."""
    parts = []
    for channel, least in lengths.items():
        others = [t for t in air if t != channel] if channel in air else []
        spread = "greatest(0, " + ", ".join(f"max({t}) OVER r - min({t}) OVER r" for t in others) + ") > 0.5" if others else ("false" if channel in air else "true")
        calm = " AND wind <> 0" if channel == "wind" else ""
        parts.append(f"""SELECT station_id, slot, 'R08' AS rule, '{channel}' AS channel, 'suspect' AS flag FROM (
            SELECT station_id, slot, count(*) OVER r AS slots, {spread} AS moved FROM (SELECT *, sum(b) OVER (PARTITION BY station_id ORDER BY slot) AS run FROM (
                SELECT *, CASE WHEN {channel} = lag({channel}) OVER (PARTITION BY station_id ORDER BY slot){calm} THEN 0 ELSE 1 END AS b FROM {source}))
            WINDOW r AS (PARTITION BY station_id, run)) WHERE slots >= {least} AND moved""")
    return " UNION ALL ".join(parts)


#: Stretched, so that the hard limits have something to find; in the first hours of each day one station's thermometer is stuck, and its second one isn't.
_STUCK_SQL = "station_id = 3 AND slot % 86400 < 14400"
RAW_SQL = f"""{GRID_SQL},
    raw AS (SELECT station_id, slot, CASE WHEN {_STUCK_SQL} THEN 21.5::DOUBLE ELSE temp * 1.5 END AS temp, CASE WHEN {_STUCK_SQL} THEN 21 + 0.3::DOUBLE * (slot // 900 % 4) END AS temp_b, rh * 1.2 AS rh, 850 + (press - 850) * 20 AS press, wind * 6 AS wind, gust * 5.5 AS gust, rain * 4 AS rain, n FROM dense),
    hits AS (
    SELECT station_id, slot, unnest([
        CASE WHEN temp < -5 OR temp > 45 THEN 'R01/temp/bad' END, CASE WHEN rh <= 0 OR rh > 100 THEN 'R02/rh/bad' END,
        CASE WHEN press < 800 OR press > 900 THEN 'R03/press/bad' END, CASE WHEN wind < 0 OR wind > 60 THEN 'R04/wind/bad' END,
        CASE WHEN gust < 0 OR gust > 75 THEN 'R04/gust/bad' END, CASE WHEN rain < 0 OR rain > 10 THEN 'R05/rain/bad' END,
        CASE WHEN abs(temp - lag(temp) OVER (PARTITION BY station_id ORDER BY slot)) > 5 THEN 'R07/temp/suspect' END,
        CASE WHEN gust < wind THEN 'R10/gust/suspect' END, CASE WHEN n IS NULL THEN 'R14/all/info' END]) AS hit FROM raw),
    long AS (SELECT station_id, slot, split_part(hit, '/', 1) AS rule, split_part(hit, '/', 2) AS channel, split_part(hit, '/', 3) AS flag FROM hits WHERE hit IS NOT NULL
        UNION ALL {flat_sql("raw", {c: n for c, n in quality.FLAT_SLOTS.items() if c != "temp_c"}, ["temp", "temp_b"])})"""
DAYS_SQL = f"""{RAW_SQL},
    measured AS (UNPIVOT (SELECT station_id, (slot + 10800) // 86400 AS day, count(*) AS slots, count(temp) AS temp, count(rh) AS rh, count(press) AS press,
        count(wind) AS wind, count(gust) AS gust, count(rain) AS rain FROM raw GROUP BY 1, 2) ON temp, rh, press, wind, gust, rain INTO NAME channel VALUE measured),
    flagged AS (SELECT station_id, (slot + 10800) // 86400 AS day, channel, count(DISTINCT slot) FILTER (flag = 'bad') AS bad, count(DISTINCT slot) FILTER (flag = 'suspect') AS suspect FROM long GROUP BY 1, 2, 3),
    judged AS (SELECT station_id, day, channel, slots, measured, coalesce(bad, 0) AS bad, coalesce(suspect, 0) AS suspect,
        CASE WHEN measured = 0 OR coalesce(bad, 0) > 0.05 * slots OR coalesce(suspect, 0) = slots THEN 'bad' WHEN coalesce(suspect, 0) > 0.05 * slots THEN 'suspect' ELSE 'good' END AS verdict
        FROM measured LEFT JOIN flagged USING (station_id, day, channel))"""


def business_day():
    return F.floor((F.col("slot") + 10800) / 86400)


def raw(spark, sf_dir):
    g = series.dense(series.slot_grid(readings(spark, sf_dir), KEYS), KEYS)
    stuck = (F.col("station_id") == 3) & (F.col("slot") % 86400 < 14400)
    thermometers = {"temp": F.when(stuck, 21.5).otherwise(F.col("temp") * 1.5), "temp_b": F.when(stuck, 21 + 0.3 * (F.floor(F.col("slot") / 900) % 4))}
    scaled = thermometers | {"rh": F.col("rh") * 1.2, "press": 850 + (F.col("press") - 850) * 20, "wind": F.col("wind") * 6, "gust": F.col("gust") * 5.5, "rain": F.col("rain") * 4}
    return g.withColumns(scaled)


@query(f"WITH {RAW_SQL} SELECT * FROM long")
def rule_hits_long(spark, sf_dir):
    """Each rule a slot breaks, with the channel and how bad it is."""
    return quality.rule_hits(raw(spark, sf_dir), KEYS)


#: Three-hour slots of coarse values, so that some don't move.
COARSE_SQL = f"""{READINGS_SQL}, coarse AS (SELECT station_id, t - t % 10800 AS slot, floor(avg(temp) / 15) AS temp, floor(max(temp) / 15) AS temp_b, floor(avg(temp) / 2) AS temp_c, floor(avg(rh) / 60) AS rh,
        floor(avg(press) / 851.5) AS press, floor(avg(wind) / 6) AS wind FROM readings GROUP BY 1, 2)"""
FLAT = {"temp": 8, "temp_b": 8, "temp_c": 8, "rh": 8, "press": 12, "wind": 12}


@query(f"WITH {COARSE_SQL} {flat_sql('coarse', FLAT, FLAT_AIR)}")
def stuck_runs(spark, sf_dir):
    """Values that don't move, thermometers only while another one does."""
    whole = lambda x, by: F.floor(x / by).cast("double")
    g = readings(spark, sf_dir).groupBy("station_id", (F.col("t") - F.col("t") % 10800).alias("slot")).agg(
        whole(F.avg("temp"), 15).alias("temp"),
        whole(F.max("temp"), 15).alias("temp_b"),
        whole(F.avg("temp"), 2).alias("temp_c"),
        whole(F.avg("rh"), 60).alias("rh"),
        whole(F.avg("press"), 851.5).alias("press"),
        whole(F.avg("wind"), 6).alias("wind"),
    )
    return quality.stuck_hits(g, KEYS, FLAT, FLAT_AIR)


@query(f"""WITH {DAYS_SQL}, s AS (SELECT station_id, t AS e, lag(t) OVER (PARTITION BY station_id ORDER BY t) AS b FROM readings),
    g AS (SELECT station_id, b, e, unnest(generate_series(b - b % 900, e - e % 900, 900)) AS slot FROM s WHERE e - b > 3600),
    silent AS (SELECT station_id, (slot + 10800) // 86400 AS day, sum(least(e, slot + 900) - greatest(b, slot)) AS gap FROM g WHERE least(e, slot + 900) > greatest(b, slot) GROUP BY 1, 2),
    c AS (SELECT station_id, day, count(*) FILTER (verdict = 'bad') AS bad, count(*) FILTER (verdict = 'suspect') AS suspect FROM judged GROUP BY 1, 2)
    SELECT station_id, day, bad, suspect, floor(greatest(0.0, 100.0 - 10 * bad - 2 * suspect - coalesce(gap, 0) / 60.0 / 14.4) * 10 + 0.5) / 10 AS score
    FROM c LEFT JOIN silent USING (station_id, day)""")
def daily_health(spark, sf_dir):
    """A day's score from its channels and its silence."""
    r = raw(spark, sf_dir)
    judged = quality.channel_days(r, quality.rule_hits(r, KEYS), KEYS, CHANNELS, business_day()).withColumn("verdict", quality.verdict())
    silent = series.charge_gaps(series.gaps(readings(spark, sf_dir), KEYS, F.lit(3600)), KEYS)
    silent = silent.groupBy("station_id", business_day().alias("day")).agg(F.sum("gap_seconds").alias("gap_seconds"))
    return quality.day_scores(judged, silent, KEYS)


@query(f"WITH {DAYS_SQL} SELECT station_id, day, channel, slots, measured, bad, suspect, verdict FROM judged")
def group_status(spark, sf_dir):
    """Each channel's verdict over a window, here a day."""
    r = raw(spark, sf_dir)
    return quality.channel_days(r, quality.rule_hits(r, KEYS), KEYS, CHANNELS, business_day()).withColumn("verdict", quality.verdict())


@query(f"WITH {RAW_SQL} SELECT rule, count(DISTINCT (station_id, slot)) AS slots, count(DISTINCT (station_id, (slot + 10800) // 86400)) AS days FROM long GROUP BY 1")
def rule_counts(spark, sf_dir):
    """Slots and days on which a rule was broken."""
    return quality.rule_hits(raw(spark, sf_dir), KEYS).groupBy("rule").agg(
        F.count_distinct("station_id", "slot").alias("slots"), F.count_distinct("station_id", business_day()).alias("days")
    )


QUALITY_SQL = f"""{GRID_SQL}, kept AS (SELECT station_id, slot, temp IS NULL AS no_temp, rh IS NULL AS no_rh, wind IS NULL AS no_wind, coalesce(last_value(temp IGNORE NULLS) OVER w, 20) AS temp, coalesce(last_value(rh IGNORE NULLS) OVER w, 60) AS rh,
        row_number() OVER (PARTITION BY station_id ORDER BY slot DESC) AS back, max(slot) OVER () + 1800 AS now FROM dense WINDOW w AS (PARTITION BY station_id ORDER BY slot)),
    latest AS (SELECT station_id, max(floor((now - slot) / 60 + 0.5)::BIGINT) FILTER (back = 1) AS fresh_minutes, max(no_temp::BIGINT + no_rh::BIGINT + no_wind::BIGINT) FILTER (back = 1) AS critical,
        avg((no_temp OR no_rh OR no_wind)::BIGINT) FILTER (back <= 24) AS filled_share, max(temp * 1.4) FILTER (back = 1) AS temp, max(rh * 1.1) FILTER (back = 1) AS rh,
        max(greatest(temp, temp + (station_id - 1) * 1.1::double, temp - 0.2::double) - least(temp, temp + (station_id - 1) * 1.1::double, temp - 0.2::double)) FILTER (back = 1) AS spread FROM kept GROUP BY 1),
    quality AS (SELECT *, CASE WHEN fresh_minutes > 180 OR spread > 3 OR critical >= 3 THEN 'POOR' WHEN fresh_minutes > 60 OR spread > 2 OR critical >= 1 OR filled_share > 0.25 THEN 'DEGRADED' ELSE 'GOOD' END AS quality,
        list_filter([CASE WHEN fresh_minutes > 180 THEN 'stale_data' END, CASE WHEN fresh_minutes > 60 AND fresh_minutes <= 180 THEN 'observation_age_elevated' END, CASE WHEN critical > 0 THEN 'missing_fields' END,
            CASE WHEN filled_share > 0.25 THEN 'gaps_filled_recently' END, CASE WHEN spread > 2 THEN 'temp_sensor_disagreement' END, CASE WHEN NOT rh BETWEEN 0 AND 100 THEN 'humidity_out_of_range' END,
            CASE WHEN NOT temp BETWEEN -10 AND 50 THEN 'temp_out_of_range' END, CASE WHEN 0.7::double * temp + 2 < {STULL_SQL} THEN 'firmware_wbgt_below_wet_bulb' END], lambda x: x IS NOT NULL) AS flags FROM latest)"""


def latest_quality(spark, sf_dir):
    g = series.dense(series.slot_grid(readings(spark, sf_dir), KEYS), KEYS)
    g = series.carry(g, KEYS, {"temp": 20.0, "rh": 60.0, "wind": 1.0})
    back = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("slot")))
    now = g.agg((F.max("slot") + 1800).alias("now"))
    recent = g.withColumn("back", back).filter("back <= 24").crossJoin(F.broadcast(now))  # one row
    latest = lambda x: F.max(F.when(F.col("back") == 1, x))
    t = F.col("temp")
    air = [t, t + (F.col("station_id") - 1) * 1.1, t - 0.2]
    s = recent.groupBy("station_id").agg(
        latest(F.floor((F.col("now") - F.col("slot")) / 60 + 0.5)).alias("fresh_minutes"),
        latest(F.size("imputed").cast("long")).alias("critical"),
        F.avg((F.size("imputed") > 0).cast("int")).alias("filled_share"),
        latest(t * 1.4).alias("temp"),
        latest(F.col("rh") * 1.1).alias("rh"),
        latest(F.greatest(*air) - F.least(*air)).alias("spread"),
    )
    # a firmware's WBGT that doesn't know the humidity
    s = s.withColumns({"firmware": 0.7 * F.col("temp") + 2, "wet_bulb": stull_wet_bulb(F.col("temp"), F.col("rh"))})
    return quality.freshness_quality(s)


@query(f"WITH {QUALITY_SQL} SELECT station_id, fresh_minutes, critical, {r4('filled_share')} AS filled_share, {r4('spread')} AS spread, quality, array_to_string(flags, ',') AS flags FROM quality")
def data_quality(spark, sf_dir):
    """Q3, P10: how good the latest data are, and why."""
    rounded = [half_up(F.col(c), 4).alias(c) for c in ("filled_share", "spread")]
    return latest_quality(spark, sf_dir).select("station_id", "fresh_minutes", "critical", *rounded, "quality", F.array_join("flags", ",").alias("flags"))


@query(f"""WITH {READINGS_SQL}, g AS (SELECT station_id, t // 10800 AS w, avg(temp) AS a, min(temp) AS b, max(temp) AS c FROM readings GROUP BY 1, 2),
    p AS (SELECT station_id, unnest([{{'pair': 'a-b', 'd': a - b}}, {{'pair': 'a-c', 'd': a - c}}, {{'pair': 'b-c', 'd': b - c}}]) AS x FROM g)
    SELECT station_id, x.pair AS pair, count(*) AS n, {r4('avg(x.d)')} AS bias, {r4('avg(abs(x.d))')} AS mean_abs, {r4('max(abs(x.d))')} AS largest FROM p WHERE x.d IS NOT NULL GROUP BY 1, 2""")
def sensor_pair_audit(spark, sf_dir):
    """Pairs of sensors held against each other."""
    r = readings(spark, sf_dir)
    g = r.groupBy("station_id", F.floor(F.col("t") / 10800).alias("w")).agg(F.avg("temp").alias("a"), F.min("temp").alias("b"), F.max("temp").alias("c"))
    return quality.pair_audit(g, [("a", "b"), ("a", "c"), ("b", "c")], KEYS)


@query("SELECT (json_extract_string(props, '$.k')::INTEGER % 17)::INTEGER AS code, count(*) AS n FROM events GROUP BY 1 HAVING code <> 0")
def code_histogram(spark, sf_dir):
    """How often each device code other than zero was sent."""
    from ..sources.testdata import table

    code = (F.get_json_object("props", "$.k").cast("int") % 17).alias("code")
    return table(spark, sf_dir, "events").groupBy(code).agg(F.count(F.lit(1)).alias("n")).filter("code <> 0")


CENTROIDS = [{"level": -1.0, "change": 0.0}, {"level": 0.3, "change": 1.0}, {"level": 1.2, "change": 0.0}, {"level": 0.0, "change": -1.0}]
LABEL_SQL = f"""{GRID_SQL},
    filled AS (SELECT station_id, slot, coalesce(last_value(temp IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY slot), 20) AS temp FROM dense),
    features AS (SELECT station_id, slot, (temp - 14) / 4 AS level, (temp - lag(temp, 4) OVER (PARTITION BY station_id ORDER BY slot)) / 3 AS change FROM filled),
    labels AS (SELECT station_id, slot, CASE WHEN change IS NOT NULL THEN list_min([
        {', '.join(f"{{'d': round((level - {c['level']}) * (level - {c['level']}) + (change - {c['change']}) * (change - {c['change']}), 9), 'k': {k}}}" for k, c in enumerate(CENTROIDS))}]).k END AS label FROM features)"""
SMOOTH_SQL = f"""{LABEL_SQL},
    known AS (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY station_id ORDER BY slot) THEN 0 ELSE 1 END AS b FROM labels WHERE label IS NOT NULL),
    numbered AS (SELECT *, sum(b) OVER (PARTITION BY station_id ORDER BY slot) AS run FROM known),
    long_runs AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY station_id, run) >= 4 THEN label END AS settled FROM numbered),
    smooth AS (SELECT station_id, slot, coalesce(last_value(settled IGNORE NULLS) OVER b, first_value(settled IGNORE NULLS) OVER e, last_value(label IGNORE NULLS) OVER e) AS state FROM long_runs
        WINDOW b AS (PARTITION BY station_id ORDER BY slot), e AS (PARTITION BY station_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    marked AS (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY station_id ORDER BY slot) THEN 0 ELSE 1 END AS nb FROM smooth),
    parts AS (SELECT *, sum(nb) OVER (PARTITION BY station_id ORDER BY slot) AS part FROM marked),
    ends AS (SELECT station_id, part, any_value(state) AS state, min(slot) AS start, max(slot) AS last, count(*) AS slots FROM parts GROUP BY 1, 2),
    segs AS (SELECT station_id, state, start, coalesce(lead(start) OVER (PARTITION BY station_id ORDER BY start), last + 900) AS "end", slots FROM ends)"""


def labelled(spark, sf_dir):
    g = series.dense(series.slot_grid(readings(spark, sf_dir), KEYS), KEYS)
    g = series.carry(g, KEYS, {"temp": 20.0})
    change = (F.col("temp") - F.lag("temp", 4).over(series.over(KEYS))) / 3
    features = g.select("station_id", "slot", ((F.col("temp") - 14) / 4).alias("level"), change.alias("change"))
    return features.select("station_id", "slot", states.nearest_centroid({"level": F.col("level"), "change": F.col("change")}, CENTROIDS).alias("label"))


def smoothed(spark, sf_dir):
    return series.smooth(labelled(spark, sf_dir), KEYS, "label").filter("state is not null").select("station_id", "slot", "state")


def state_parts(spark, sf_dir):
    return series.segments(smoothed(spark, sf_dir), KEYS, "state")


@query(f"WITH {LABEL_SQL} SELECT station_id, slot, label FROM labels")
def state_classify(spark, sf_dir):
    """L4: nearest centroid."""
    return labelled(spark, sf_dir)


@query(f"WITH {SMOOTH_SQL} SELECT * FROM smooth")
def state_smooth(spark, sf_dir):
    """A state counts once it has lasted."""
    return smoothed(spark, sf_dir)


@query(f"WITH {SMOOTH_SQL} SELECT * FROM segs")
def state_segments(spark, sf_dir):
    """Intervals of equal state."""
    return state_parts(spark, sf_dir).select("station_id", "state", "start", "end", "slots")


@query(f"""WITH {SMOOTH_SQL}, p AS (SELECT state, lead(state) OVER (PARTITION BY station_id ORDER BY start) AS next FROM segs),
    c AS (SELECT state, next, count(*) AS n FROM p WHERE next IS NOT NULL GROUP BY 1, 2)
    SELECT state, next, n, {r4('n / sum(n) OVER (PARTITION BY state)')} AS share, row_number() OVER (PARTITION BY state ORDER BY n DESC, next) = 1 AS modal FROM c""")
def next_state_matrix(spark, sf_dir):
    """What follows a state."""
    return states.transitions(state_parts(spark, sf_dir), KEYS).withColumn("share", half_up(F.col("share"), 4))


@query(f"""WITH {SMOOTH_SQL}, p AS (SELECT station_id, start, start % 86400 // 10800 AS block, state, lead(state) OVER (PARTITION BY station_id ORDER BY start) AS next FROM segs),
    f AS (SELECT state, block, next, count(*) AS n FROM p WHERE next IS NOT NULL GROUP BY 1, 2, 3), s AS (SELECT state, next, count(*) AS n FROM p WHERE next IS NOT NULL GROUP BY 1, 2),
    fm AS (SELECT state, block, max_by(next, (n, -next)) AS k FROM f GROUP BY 1, 2), sm AS (SELECT state, max_by(next, (n, -next)) AS k FROM s GROUP BY 1),
    now AS (SELECT station_id, max_by(state, start) AS state, max(start) AS since FROM segs GROUP BY 1)
    SELECT station_id, state, since, coalesce(fm.k, sm.k) AS next FROM now LEFT JOIN fm ON now.state = fm.state AND since % 86400 // 10800 = block LEFT JOIN sm ON now.state = sm.state""".replace("SELECT station_id, state, since, coalesce", "SELECT station_id, now.state AS state, since, coalesce"))
def next_state(spark, sf_dir):
    """The state now, since when, and what usually follows at this time of day, or at all."""
    parts = state_parts(spark, sf_dir).withColumn("block", F.floor(F.col("start") % 86400 / 10800))
    pairs = parts.withColumn("next", F.lead("state").over(series.over(KEYS, "start"))).filter("next is not null")
    now = parts.groupBy("station_id").agg(F.max_by("state", "start").alias("state"), F.max("start").alias("since"))
    now = now.withColumn("block", F.floor(F.col("since") % 86400 / 10800))
    return states.next_state(now, pairs, ["state", "block"], ["state"]).select("station_id", "state", "since", "next")


@query(f"""WITH {SMOOTH_SQL}, p AS (SELECT state, start, lead(start) OVER w AS until, lead(state) OVER w AS next FROM segs WINDOW w AS (PARTITION BY station_id ORDER BY start)),
    x AS (SELECT state, next, until, unnest(generate_series(start, until - 900, 900)) AS slot FROM p WHERE next IS NOT NULL),
    c AS (SELECT state, slot % 86400 // 10800 AS block, next, count(*) AS n, quantile_cont((until - slot) / 3600.0::double, 0.5) AS hours FROM x GROUP BY 1, 2, 3)
    SELECT state, block, max_by(next, (n, -next)) AS next, sum(n)::BIGINT AS n, {r4('max(n) / sum(n)')} AS share, {r4('max_by(hours, (n, -next))')} AS hours FROM c GROUP BY 1, 2 HAVING sum(n) >= 20""")
def waits_by_block(spark, sf_dir):
    """M9: what mostly follows a state at a time of day, and after how long."""
    return states.waits(state_parts(spark, sf_dir), KEYS).withColumns({"share": half_up(F.col("share"), 4), "hours": half_up(F.col("hours"), 4)})


def _waits_sql(block: str, least: int) -> str:
    return f"""SELECT state, {block} AS block, max_by(next, (n, -next)) AS next, max(n) / sum(n) AS share, max_by(hours, (n, -next)) AS hours FROM (
        SELECT state, {block} AS block, next, count(*) AS n, quantile_cont((until - slot) / 3600.0::double, 0.5) AS hours FROM x GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING sum(n) >= {least}"""


@query(f"""WITH {SMOOTH_SQL}, p AS (SELECT state, start, lead(start) OVER w AS until, lead(state) OVER w AS next FROM segs WINDOW w AS (PARTITION BY station_id ORDER BY start)),
    x AS (SELECT state, next, until, slot, slot % 86400 // 10800 AS block FROM (SELECT state, next, until, unnest(generate_series(start, until - 900, 900)) AS slot FROM p WHERE next IS NOT NULL)),
    h AS ({_waits_sql('block', 20)}), a AS ({_waits_sql('0', 1)}),
    now AS (SELECT station_id, max_by(state, start) AS state, max(start) AS since FROM segs GROUP BY 1), l AS (SELECT station_id, max(slot) AS slot FROM smooth GROUP BY 1)
    SELECT now.station_id, l.slot, now.state, since, CASE WHEN h.state IS NULL THEN a.next ELSE h.next END AS next, {r4('CASE WHEN h.state IS NULL THEN a.share ELSE h.share END')} AS share, {r4('CASE WHEN h.state IS NULL THEN a.hours ELSE h.hours END')} AS hours
    FROM now JOIN l USING (station_id) LEFT JOIN h ON h.state = now.state AND h.block = l.slot % 86400 // 10800 LEFT JOIN a ON a.state = now.state""")
def state_standing(spark, sf_dir):
    """Q6: classified, smoothed and cut into runs, the state of each station now, since when it holds, what follows and when."""
    found = states.standing(labelled(spark, sf_dir), KEYS)
    return found.withColumns({c: half_up(F.col(c), 4) for c in ("share", "hours")})


@query(f"""WITH {SMOOTH_SQL} SELECT state, count(*) AS slots, {r4('count(*) / sum(count(*)) OVER ()')} AS share, {r4('quantile_cont((slot + 10800) % 86400 / 3600.0, 0.5)')} AS median_hour FROM smooth GROUP BY 1""")
def state_summary(spark, sf_dir):
    """Share and median local hour of each state."""
    from pyspark.sql import Window

    s = smoothed(spark, sf_dir).groupBy("state").agg(
        F.count(F.lit(1)).alias("slots"), half_up(F.percentile((F.col("slot") + 10800) % 86400 / 3600, F.lit(0.5)), 4).alias("median_hour")
    )
    return s.withColumn("share", half_up(F.col("slots") / F.sum("slots").over(Window.partitionBy()), 4))
