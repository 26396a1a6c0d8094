"""Forecasts of the hours ahead, rain chances, context, history, planning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.heat import risk_band, risk_rank
from ..functions.rounding import half_up
from ..operators import besttime, farm, forecast, outlook, quality, series
from ..sources.testdata import GRID_SQL, READINGS_SQL, readings, table
from .decisions import FILLED_SQL, WINDOWS_SQL, wbgt, windows
from .expressions import band_sql
from .forecasts import BASE_SQL, error_counts, month_hour_table
from .health import QUALITY_SQL, RAW_SQL, latest_quality, raw
from .registry import query, r4
from .windows import DAY_SQL, GATED_SQL, days, grid

KEYS = ["station_id"]
NOW = 1706486400
CALIBRATION, TEST = 1705500000, 1706100000
STEPS = 36


def r1(column: str) -> str:
    """SQL: one decimal, halves up."""
    return f"floor(({column}) * 10 + 0.5) / 10"


#: The series and what is usual, up to a comma.
USUAL_SQL = BASE_SQL.split("pairs AS (")[0]
EXACT_FIT_SQL = f"""{USUAL_SQL} steps AS (SELECT unnest(generate_series(1, {STEPS})) AS step),
    far AS (SELECT o.station_id, o.slot, step, o.temp AS x0, o.usual AS u0, t.temp AS x1, t.usual AS u1 FROM usual o CROSS JOIN steps JOIN usual t ON t.station_id = o.station_id AND t.slot = o.slot + step * 900
        WHERE o.temp IS NOT NULL AND o.usual IS NOT NULL AND t.usual IS NOT NULL),
    fits AS (SELECT step, sum((x0 - u0) * (x1 - u1)) / sum((x0 - u0) * (x0 - u0)) AS a, count(*) AS n_train FROM far WHERE slot < {CALIBRATION} GROUP BY 1),
    held AS (SELECT f.*, u1 + a * (x0 - u0) AS f, u1 + a * (x0 - u0) - x1 AS e, (slot + step * 900) % 86400 // 10800 AS block FROM far f JOIN fits USING (step) WHERE slot >= {CALIBRATION}),
    pooled AS (SELECT step, quantile_cont(abs(e), 0.8) AS band, quantile_cont(abs(x0 - x1), 0.8) AS persistence FROM held WHERE slot < {TEST} GROUP BY 1),
    blocks AS (SELECT step, block, quantile_cont(abs(e), 0.8) AS band FROM held WHERE slot < {TEST} GROUP BY 1, 2),
    bands AS (SELECT step, block, coalesce(blocks.band, pooled.band) AS band, persistence FROM pooled CROSS JOIN generate_series(0, 7) b(block) LEFT JOIN blocks USING (step, block))"""
#: The same with bands of errors that are counted by hundredths.
FIT_SQL = EXACT_FIT_SQL.replace("quantile_cont(abs(e), 0.8)", "quantile_cont(floor(abs(e) * 100 + 0.5) / 100, 0.8)").replace("quantile_cont(abs(x0 - x1), 0.8)", "quantile_cont(floor(abs(x0 - x1) * 100 + 0.5) / 100, 0.8)")


def far_pairs(spark, sf_dir):
    g = series.carry(grid(spark, sf_dir), KEYS, {"temp": 20.0})
    return g, forecast.pairs(series.rolling_usual(g, KEYS, "temp", least=5), KEYS, list(range(1, STEPS + 1)))


def fitted(spark, sf_dir):
    """The series, the fits, and held-out errors with their bands: training, calibration and test are apart in time."""
    g, far = far_pairs(spark, sf_dir)
    fits = far.filter(F.col("slot") < CALIBRATION).groupBy("step").agg(forecast.slope().alias("a"), F.count(F.lit(1)).alias("n_train"))
    held = far.filter(F.col("slot") >= CALIBRATION).join(F.broadcast(fits), "step").withColumn("f", forecast.seasonal(F.col("a")))
    held = held.withColumns({"e": F.col("f") - F.col("x1"), "block": F.floor((F.col("slot") + F.col("step") * 900) % 86400 / 10800)})
    calm = held.filter(F.col("slot") < TEST)
    band = F.percentile("size", F.lit(0.8), F.col("n"))
    counts = error_counts(calm, "step", "block")
    still = error_counts(calm.withColumn("e", F.col("x0") - F.col("x1")), "step").groupBy("step").agg(band.alias("persistence"))
    pooled = counts.groupBy("step").agg(band.alias("all")).join(still, "step")
    blocks = counts.groupBy("step", "block").agg(band.alias("band"))
    every = pooled.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    bands = every.join(F.broadcast(blocks), ["step", "block"], "left").select("step", "block", F.coalesce("band", "all").alias("band"), "persistence")
    return g, fits, held, bands


@query(f"""WITH {EXACT_FIT_SQL}, p AS (SELECT step, band AS pooled_band FROM pooled), t AS (SELECT h.*, pooled_band FROM held h JOIN p USING (step) WHERE slot >= {TEST}),
    k AS (SELECT *, CASE WHEN f < 18 THEN 0 WHEN f < 21 THEN 1 WHEN f < 24 THEN 2 ELSE 3 END AS said, CASE WHEN x1 < 18 THEN 0 WHEN x1 < 21 THEN 1 WHEN x1 < 24 THEN 2 ELSE 3 END AS was FROM t)
    SELECT step, {r4('any_value(fit_a)')} AS a, any_value(n_train) AS n_train, count(*) AS n_test, {r4('avg(abs(e))')} AS test_mae, {r4('sqrt(avg(e * e))')} AS test_rmse, {r4('avg(abs(x0 - x1))')} AS persistence_mae,
        {r4('any_value(k.pooled_band)')} AS band80, {r4('avg((abs(e) <= pooled_band)::INTEGER)')} AS coverage80, {r1('avg((said = was)::INTEGER) * 100')} AS band_same_pct, {r1('avg((said < was)::INTEGER) * 100')} AS band_lower_pct
    FROM k JOIN (SELECT step, a AS fit_a, n_train FROM fits) n USING (step) GROUP BY 1""")
def final_fit(spark, sf_dir):
    """One fit for each of 36 steps before the test dates, bands from held-out weeks, scores on the test dates, and how often the
    risk band was the same, or told too low."""
    _, fits, held, bands = fitted(spark, sf_dir)
    pooled = forecast.percentile(held.filter(F.col("slot") < TEST), ["step"], F.abs("e"), 0.8, "pooled")
    test = held.filter(F.col("slot") >= TEST).join(F.broadcast(pooled), "step")
    said, was = risk_rank(risk_band(F.col("f"))), risk_rank(risk_band(F.col("x1")))
    share = lambda c: F.avg(c.cast("int"))
    return test.groupBy("step").agg(
        half_up(F.max("a"), 4).alias("a"),
        F.max("n_train").alias("n_train"),
        F.count(F.lit(1)).alias("n_test"),
        half_up(F.avg(F.abs("e")), 4).alias("test_mae"),
        half_up(F.sqrt(F.avg(F.col("e") * F.col("e"))), 4).alias("test_rmse"),
        half_up(F.avg(F.abs(F.col("x0") - F.col("x1"))), 4).alias("persistence_mae"),
        half_up(F.max("pooled"), 4).alias("band80"),
        half_up(share(F.abs("e") <= F.col("pooled")), 4).alias("coverage80"),
        half_up(share(said == was) * 100, 1).alias("band_same_pct"),
        half_up(share(said < was) * 100, 1).alias("band_lower_pct"),
    )


HEALTH_SQL = f"""WITH {QUALITY_SQL}, {RAW_SQL[len(GRID_SQL) :].lstrip(", ")},
    ends AS (SELECT station_id, max(slot) AS last FROM raw GROUP BY 1),
    m AS (UNPIVOT (SELECT station_id, count(*) AS slots, count(temp) AS temp, count(rh) AS rh, count(press) AS press, count(wind) AS wind, count(gust) AS gust, count(rain) AS rain FROM raw JOIN ends USING (station_id) WHERE slot > last - 86400 GROUP BY 1)
        ON temp, rh, press, wind, gust, rain INTO NAME channel VALUE measured),
    g AS (SELECT station_id, channel, count(DISTINCT slot) FILTER (flag = 'bad') AS bad, count(DISTINCT slot) FILTER (flag = 'suspect') AS suspect FROM long JOIN ends USING (station_id) WHERE slot > last - 86400 GROUP BY 1, 2),
    f AS (SELECT m.station_id, list_sort(list(m.channel)) AS failing FROM m LEFT JOIN g ON g.station_id = m.station_id AND g.channel = m.channel
        WHERE m.channel <> 'rain' AND (measured = 0 OR coalesce(bad, 0) > 0.05 * slots OR coalesce(suspect, 0) = slots) GROUP BY 1),
    e AS (SELECT q.station_id, fresh_minutes, CASE WHEN quality = 'GOOD' AND failing IS NOT NULL THEN 'DEGRADED' ELSE quality END AS quality, failing FROM quality q LEFT JOIN f USING (station_id))
    SELECT station_id, CASE WHEN fresh_minutes >= 540 THEN 'POOR' ELSE quality END AS quality,
        array_to_string(list_concat(list_transform(coalesce(failing, []), lambda c: 'station_health_bad:' || c), CASE WHEN fresh_minutes >= 540 AND quality <> 'POOR' THEN ['forecast_horizon_elapsed'] ELSE [] END), ',') AS health_flags,
        CASE WHEN fresh_minutes < 540 AND quality = 'DEGRADED' THEN 1.5 ELSE 1 END::DOUBLE AS band_factor FROM e"""


@query(HEALTH_SQL)
def health_escalation(spark, sf_dir):
    """Sensors that failed over the last day lower the data's quality, and with it widen the bands."""
    r = raw(spark, sf_dir)
    ends = F.broadcast(r.groupBy("station_id").agg(F.max("slot").alias("last")))
    recent = lambda df: df.join(ends, KEYS).filter("slot > last - 86400").drop("last")
    judged = quality.channel_days(recent(r), recent(quality.rule_hits(r, KEYS)), KEYS, ["temp", "rh", "press", "wind", "gust", "rain"], F.lit(0)).withColumn("verdict", quality.verdict())
    found = outlook.escalate(latest_quality(spark, sf_dir), judged, KEYS)
    return found.select("station_id", "quality", F.array_join("health_flags", ",").alias("health_flags"), "band_factor")


AHEAD_SQL = f"""{FIT_SQL}, latest AS (SELECT station_id, max_by(temp, slot) AS x0, max(slot) AS now FROM filled GROUP BY 1),
    clock AS (SELECT f.station_id, slot % 86400 AS tod, CASE WHEN count(temp) >= 20 THEN avg(temp) END AS usual FROM filled f JOIN latest l ON l.station_id = f.station_id WHERE slot > now - 2592000 GROUP BY 1, 2),
    row AS (SELECT l.*, step, now + step * 900 AS target FROM latest l CROSS JOIN generate_series(0, {STEPS}) s(step)),
    run AS (SELECT row.*, c.usual AS u0, d.usual AS u1, a, band, persistence, c.usual IS NOT NULL AND d.usual IS NOT NULL AS ok FROM row LEFT JOIN clock c ON c.station_id = row.station_id AND c.tod = now % 86400
        LEFT JOIN clock d ON d.station_id = row.station_id AND d.tod = target % 86400 LEFT JOIN fits USING (step) LEFT JOIN bands b ON b.step = row.step AND b.block = target % 86400 // 10800),
    point AS (SELECT *, CASE WHEN step = 0 THEN x0 WHEN ok THEN {r1('u1 + a * (x0 - u0)')} ELSE {r1('x0')} END AS value, CASE WHEN step = 0 THEN 0 WHEN ok THEN band ELSE persistence END AS w FROM run),
    ahead AS (SELECT station_id, step, target, CASE WHEN ok THEN 'seasonal' ELSE 'no_change' END AS kind, value, CASE WHEN step = 0 THEN value ELSE {r1('value - w')} END AS lower, CASE WHEN step = 0 THEN value ELSE {r1('value + w')} END AS upper FROM point),
    health AS ({HEALTH_SQL}),
    wide AS (SELECT station_id, step, target, kind, value, CASE WHEN band_factor > 1 THEN {r1('value - (value - lower) * 1.5')} ELSE lower END AS lower, CASE WHEN band_factor > 1 THEN {r1('value + (upper - value) * 1.5')} ELSE upper END AS upper FROM ahead LEFT JOIN health USING (station_id))"""


def hours_ahead(spark, sf_dir):
    g, fits, _, bands = fitted(spark, sf_dir)
    usual = outlook.usual_by_slot(g, KEYS, "temp", least=20)
    judged = health_escalation(spark, sf_dir).select("station_id", "band_factor")  # a row a station
    said = outlook.ahead(g, KEYS, usual, fits, bands, steps=STEPS).join(judged, "station_id", "left")
    return outlook.widen(said, F.coalesce(F.col("band_factor") > 1, F.lit(False))).drop("band_factor")


@query(f"WITH {AHEAD_SQL} SELECT station_id, step, target, kind, {r4('value')} AS value, {r4('lower')} AS lower, {r4('upper')} AS upper FROM wide")
def forecast_ahead(spark, sf_dir):
    """From each station's latest slot, 36 steps with bands by block of the target, wider where data are degraded; nothing
    changes where what is usual isn't known."""
    found = hours_ahead(spark, sf_dir)
    return found.withColumns({c: half_up(F.col(c), 4) for c in ("value", "lower", "upper")})


@query(f"WITH {AHEAD_SQL} SELECT station_id, {r4('max(value)')} AS peak, min_by(target, (-value, target)) AS peak_at FROM wide GROUP BY 1")
def peak_point(spark, sf_dir):
    """L3: the highest point of each forecast, the first of equals."""
    best = F.max_by("target", F.struct("value", -F.col("target")))
    return hours_ahead(spark, sf_dir).groupBy("station_id").agg(half_up(F.max("value"), 4).alias("peak"), best.alias("peak_at"))


@query(f"""WITH {GRID_SQL}, c AS (SELECT station_id, slot, rh, rh - lag(rh, 4) OVER (PARTITION BY station_id ORDER BY slot) AS change FROM dense),
    m AS (SELECT month(make_timestamp(slot * 1000000)) AS month, slot % 86400 // 3600 AS hour, avg((coalesce(rain, 0) > 0.1)::INTEGER) AS rate FROM dense GROUP BY 1, 2),
    base AS (SELECT avg((coalesce(rain, 0) > 0.1)::INTEGER) AS b FROM dense),
    p AS (SELECT station_id, slot, change IS NOT NULL AS modelled, {r4('coalesce(1 / (1 + exp(-(-3 + 0.03::double * rh + 0.02::double * change))), floor(coalesce(rate, b) * 10000 + 0.500001) / 10000)')} AS p
        FROM c CROSS JOIN base LEFT JOIN m ON month = month(make_timestamp(slot * 1000000)) AND hour = slot % 86400 // 3600 WHERE slot % 3600 = 0)
    SELECT station_id, slot, modelled, p AS now, p AS in_3h, NULL::DOUBLE AS in_6h FROM p""")
def rain_probability(spark, sf_dir):
    """Q10, F16: the chance of rain, by the month and hour where an input is missing; it speaks for three hours."""
    g = grid(spark, sf_dir).withColumn("change", F.col("rh") - outlook.lag_over(KEYS, "rh", 4)).filter("slot % 3600 = 0")
    g = g.withColumns({"month": F.month(F.timestamp_seconds("slot")), "hour": F.floor(F.col("slot") % 86400 / 3600)})
    g = g.join(F.broadcast(month_hour_table(spark, sf_dir)), ["month", "hour"], "left")
    p = half_up(outlook.rain_chance(["rh", "change"], -3.0, [0.03, 0.02], F.col("rate")), 4)
    at = lambda h: outlook.valid_for(F.col("p"), F.col("slot"), F.col("slot") + h * 3600)
    rows = g.withColumns({"p": p, "modelled": (F.col("rh") + F.col("change")).isNotNull()})
    return rows.select("station_id", "slot", "modelled", at(0).alias("now"), at(3).alias("in_3h"), at(6).alias("in_6h"))


@query(f"""WITH {GRID_SQL}, s AS (SELECT station_id, slot, rh, sum(rain) OVER (PARTITION BY station_id ORDER BY slot ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS ahead FROM dense),
    y AS (SELECT slot // 604800 AS week, slot % 86400 // 3600 AS hour, rh, (coalesce(ahead, 0) >= 1.5)::INTEGER AS wet FROM s),
    c AS (SELECT w.week, h.hour, count(wet) AS n, coalesce(sum(wet), 0) AS k FROM (SELECT DISTINCT week FROM y) w CROSS JOIN (SELECT DISTINCT hour FROM y) h LEFT JOIN y USING (week, hour) GROUP BY 1, 2),
    b AS (SELECT week, hour, sum(n) OVER w AS n, sum(k) OVER w AS k FROM c WINDOW w AS (PARTITION BY hour ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    r AS (SELECT week, hour, k / nullif(n, 0) AS rate, sum(k) OVER (PARTITION BY week) / sum(n) OVER (PARTITION BY week) AS base FROM b),
    p AS (SELECT week, wet, base, coalesce(rate, base) AS hourly, CASE WHEN rh >= 80 THEN 0.7 WHEN rh >= 60 THEN 0.4 ELSE 0.1 END::DOUBLE AS legacy FROM y JOIN r USING (week, hour) WHERE base IS NOT NULL),
    e AS (SELECT week, wet, unnest([{{'model': 'base', 'p': base}}, {{'model': 'hourly', 'p': hourly}}, {{'model': 'legacy', 'p': legacy}}]) AS m, base FROM p)
    SELECT week, m.model AS model, count(*) AS n, {r4('avg((m.p - wet) * (m.p - wet))')} AS brier, {r4('1 - avg((m.p - wet) * (m.p - wet)) / avg((base - wet) * (base - wet))')} AS skill,
        count(*) FILTER (m.p >= 0.5 AND wet = 1) AS hits, count(*) FILTER (m.p >= 0.5 AND wet = 0) AS false_alarms, count(*) FILTER (m.p < 0.5 AND wet = 1) AS misses FROM e GROUP BY 1, 2""")
def rain_backtest(spark, sf_dir):
    """Each week's chances of rain by what the weeks before taught, the old rule among them: Brier score, skill over the base
    rate, and what a threshold of one half gives."""
    ahead = F.sum("rain").over(series.over(KEYS).rowsBetween(1, 12))
    g = grid(spark, sf_dir).withColumn("wet", (F.coalesce(ahead, F.lit(0.0)) >= 1.5).cast("int"))
    g = g.select("rh", "wet", F.floor(F.col("slot") / 604800).alias("week"), F.floor(F.col("slot") % 86400 / 3600).alias("hour"))
    rates = outlook.rain_rates(g, "week", "hour", "wet")
    legacy = F.when(F.col("rh") >= 80, 0.7).when(F.col("rh") >= 60, 0.4).otherwise(0.1)
    models = {"base": F.col("base"), "hourly": F.coalesce("rate", "base"), "legacy": legacy}
    each = F.array(*(F.struct(F.lit(m).alias("model"), p.alias("p")) for m, p in models.items()))
    rows = g.join(F.broadcast(rates), ["week", "hour"]).select("week", "wet", "base", F.inline(each))
    brier, by_base = forecast.brier(F.col("p"), F.col("wet")), forecast.brier(F.col("base"), F.col("wet"))
    half = F.col("p") >= 0.5
    return rows.groupBy("week", "model").agg(
        F.count(F.lit(1)).alias("n"),
        half_up(brier, 4).alias("brier"),
        forecast.skill(brier, by_base).alias("skill"),
        F.count_if(half & (F.col("wet") == 1)).alias("hits"),
        F.count_if(half & (F.col("wet") == 0)).alias("false_alarms"),
        F.count_if(~half & (F.col("wet") == 1)).alias("misses"),
    )


@query(f"""WITH {READINGS_SQL}, h AS (SELECT station_id, t // 3600 * 3600 AS t, avg(temp) AS temp, avg(rh) AS rh, avg(press) AS press FROM readings GROUP BY 1, 2),
    a AS (SELECT station_id, max(t) AS t, max_by(temp, (t, event_id)) FILTER (temp IS NOT NULL) AS local FROM readings GROUP BY station_id, (t + 10800) // 86400),
    w AS (SELECT *, t // 3600 % 24 AS hour FROM h WHERE temp IS NOT NULL AND rh IS NOT NULL AND press IS NOT NULL), q AS (SELECT *, (t + 1800) // 3600 % 24 AS hour FROM a)
    SELECT q.station_id, q.t AS t, w.t AS valid, {r1('w.temp')} AS temp, {r1('w.rh')} AS rh, {r1('q.local - w.temp')} AS anomaly FROM q ASOF LEFT JOIN w ON q.station_id = w.station_id AND q.hour = w.hour AND q.t >= w.t""")
def context_as_of(spark, sf_dir):
    """The latest complete model row of the same hour of day, not after the reading, and how the reading departs from it."""
    r = readings(spark, sf_dir)
    hours = r.groupBy("station_id", (F.col("t") - F.col("t") % 3600).alias("t")).agg(F.avg("temp").alias("temp"), F.avg("rh").alias("rh"), F.avg("press").alias("press"))
    day = F.floor((F.col("t") + 10800) / 86400)
    local = F.max_by("temp", F.when(F.col("temp").isNotNull(), F.struct("t", "event_id")))
    anchors = r.groupBy("station_id", day).agg(F.max("t").alias("t"), local.alias("local")).select("station_id", "t", "local")
    found = outlook.as_of_same_hour(anchors, hours, KEYS, ["temp", "rh", "press"]).join(anchors, ["station_id", "t"])
    return found.select("station_id", "t", "valid", half_up(F.col("temp"), 1).alias("temp"), half_up(F.col("rh"), 1).alias("rh"), half_up(F.col("local") - F.col("temp"), 1).alias("anomaly"))


@query(f"WITH {READINGS_SQL} SELECT station_id, t // 86400 AS day, {r1('sum(greatest(0, rain - 1))')} AS mm FROM readings WHERE rain IS NOT NULL GROUP BY 1, 2")
def daily_rain_clipped(spark, sf_dir):
    """A5: rain of UTC days, negatives taken for none."""
    r = readings(spark, sf_dir).filter("rain is not null")
    return r.groupBy("station_id", F.floor(F.col("t") / 86400).alias("day")).agg(half_up(F.sum(F.greatest(F.lit(0.0), F.col("rain") - 1)), 1).alias("mm"))


def _context_sql(least_hours: int) -> str:
    source = GATED_SQL.replace("rain_hours >= 10", f"rain_hours >= {least_hours}")
    return f"""WITH {source}, b AS (SELECT *, max(day) OVER (PARTITION BY station_id) - day AS back FROM gated), x AS (SELECT *, max(mm) FILTER (back = 0) OVER (PARTITION BY station_id) AS today FROM b WHERE back < 14),
    c AS (SELECT station_id, count(mm) = 14 AS available, max(today) AS mm, sum(mm) FILTER (back < 7) AS mm_7d, sum(mm) AS mm_span, floor((count(*) FILTER (mm < today) + count(*) FILTER (mm = today) / 2.0) / count(mm) * 100 + 0.5)::BIGINT AS percentile,
        coalesce(min(back) FILTER (mm < 30), 14) AS wet_days, coalesce(min(back) FILTER (mm >= 30), 14) AS dry_days FROM x GROUP BY 1)
    SELECT station_id, available, CASE WHEN available THEN {r1('mm')} END AS mm, CASE WHEN available THEN {r1('mm_7d')} END AS mm_7d, CASE WHEN available THEN {r1('mm_span')} END AS mm_span,
        CASE WHEN available THEN percentile END AS percentile, CASE WHEN available THEN wet_days END AS wet_days, CASE WHEN available THEN dry_days END AS dry_days FROM c"""


@query(_context_sql(1))
def rainfall_context(spark, sf_dir):
    """Q23: rain of today, a week and two, its rank, and spells; told only if every day is known."""
    from ..operators import daily

    return outlook.rainfall_context(daily.gated(days(spark, sf_dir), KEYS, least_hours=1), KEYS, span=14, dry=30.0)


@query(f"""WITH {GRID_SQL}, a AS (SELECT o_orderkey AS anchor_id, o_custkey % 4 AS station_id, 1703800000 + o_orderkey * 7919 % 3000000 AS anchor FROM orders),
    b AS (SELECT station_id, min(slot) AS lo, max(slot) AS hi FROM grid GROUP BY 1), e AS (SELECT anchor_id, station_id, least(anchor - anchor % 900, hi) AS "end", anchor > hi AS realtime FROM a JOIN b USING (station_id) WHERE anchor >= lo - 172800),
    c AS (SELECT *, count(*) OVER (PARTITION BY station_id ORDER BY slot) AS k FROM grid),
    x AS (SELECT e.*, c.k AS upto FROM e ASOF LEFT JOIN c ON e.station_id = c.station_id AND e."end" >= c.slot), y AS (SELECT x.*, d.k AS before FROM x ASOF LEFT JOIN c d ON x.station_id = d.station_id AND x."end" - 21600 >= d.slot)
    SELECT station_id, anchor_id, "end", realtime, coalesce(upto, 0) - coalesce(before, 0) AS rows FROM y WHERE coalesce(upto, 0) - coalesce(before, 0) >= 16""")
def anchored_lookback(spark, sf_dir):
    """Series that end at given instants, refused too early or with too few rows, cut at the last row."""
    g = series.slot_grid(readings(spark, sf_dir), KEYS)
    k = F.col("o_orderkey")
    anchors = table(spark, sf_dir, "orders").select(k.alias("anchor_id"), (F.col("o_custkey") % 4).alias("station_id"), (1703800000 + k * 7919 % 3000000).alias("anchor"))
    return outlook.lookback(anchors, g, KEYS, hours=6, least_rows=16, reach=172800)


@query(f"""WITH {READINGS_SQL}, f AS (SELECT station_id, t, event_id, temp, CASE WHEN t < 1705500000 THEN 0 WHEN station_id % 2 = 0 OR t < 1706000000 THEN 1 ELSE 2 END AS feed FROM readings WHERE temp IS NOT NULL),
    late AS (SELECT station_id FROM f WHERE feed = 1 GROUP BY 1 HAVING max(t) < 1706400000 - 1800),
    u AS (SELECT * FROM f WHERE feed < 2 UNION ALL SELECT station_id, t + 60, event_id, temp, 1 FROM f WHERE feed = 0 AND event_id % 10 = 0 UNION ALL SELECT * FROM f WHERE feed = 2 AND station_id IN (SELECT station_id FROM late))
    SELECT station_id, t, event_id, temp, feed FROM u QUALIFY row_number() OVER (PARTITION BY station_id, t ORDER BY feed, event_id) = 1""")
def stitched_history(spark, sf_dir):
    """Archive, API and, where that is late, the top-up feed; the first of a shared time stays."""
    r = readings(spark, sf_dir).filter("temp is not null").select("station_id", "t", "event_id", "temp")
    t, even = F.col("t"), F.col("station_id") % 2 == 0
    archive = r.filter(t < 1705500000)
    api = r.filter((t >= 1705500000) & (even | (t < 1706000000))).union(archive.filter("event_id % 10 = 0").withColumn("t", t + 60))
    top_up = r.filter((t >= 1705500000) & ~(even | (t < 1706000000)))
    return outlook.stitched(archive, api, top_up, KEYS, F.lit(1706400000))


@query(f"""WITH {DAY_SQL}, e AS (SELECT station_id, (t + 10800) // 86400 AS day, least(150, rain * 60) AS mm FROM readings WHERE rain > 0), a AS (SELECT station_id, day, floor(least(150, sum(mm)) * 10 + 0.5) / 10 AS applied FROM e GROUP BY 1, 2),
    r AS (SELECT station_id, day, t_max + 1 AS r_max, t_min + 1 AS r_min FROM days WHERE day % 5 <> 0)
    SELECT station_id, day, CASE WHEN temp_hours >= 12 THEN 'station' WHEN r_max IS NOT NULL AND r_min IS NOT NULL THEN 'regional_model' END AS source,
        CASE WHEN temp_hours >= 12 THEN t_max ELSE r_max END AS t_max, CASE WHEN temp_hours >= 12 THEN t_min ELSE r_min END AS t_min, coalesce(applied, 0) AS applied FROM days LEFT JOIN r USING (station_id, day) LEFT JOIN a USING (station_id, day)""")
def farm_inputs(spark, sf_dir):
    """Each day's extremes from the station, where it measured enough hours, else from the regional model, and the water applied."""
    from .windows import irrigation_daily

    d = days(spark, sf_dir)
    regional = d.filter("day % 5 <> 0").select("station_id", "day", (F.col("t_max") + 1).alias("r_max"), (F.col("t_min") + 1).alias("r_min"))
    applied = irrigation_daily(spark, sf_dir).select("station_id", "day", F.col("mm").alias("applied"))
    return farm.day_inputs(d, regional, applied, KEYS, least_hours=12)


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS gauge, o_orderkey % 3 <> 0 AS station, o_orderkey % 5 <> 0 AS whole FROM orders)
    SELECT o_orderkey, CASE WHEN gauge AND station AND whole THEN 'HIGH' WHEN gauge OR station THEN 'MODERATE' ELSE 'LOW' END AS confidence FROM o""")
def advice_confidence(spark, sf_dir):
    """Q19: how far farm advice can be trusted, by where its rain and evaporation come from and whether every day is known."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k, farm.confidence(k % 2 == 0, k % 3 != 0, k % 5 != 0).alias("confidence"))


@query(f"""WITH {FILLED_SQL}, f AS (SELECT station_id, slot, wbgt FROM wbgt WHERE slot >= {NOW} AND slot <= {NOW} + 32400), a AS (SELECT c_custkey, c_custkey % 4 AS station_id, c_custkey % 24 AS start_hour, c_custkey * 7 % 24 AS end_hour, (c_custkey % 5 - 2)::DOUBLE AS offset_c FROM customer),
    h AS (SELECT *, CASE WHEN (end_hour - start_hour + 24) % 24 = 0 THEN 24 ELSE (end_hour - start_hour + 24) % 24 END * 3600 AS len, {NOW} + 10800 - ({NOW} + 10800) % 86400 - 10800 + start_hour * 3600 AS base FROM a),
    s AS (SELECT *, CASE WHEN base - 86400 + len > {NOW} THEN base - 86400 WHEN base + len > {NOW} THEN base ELSE base + 86400 END AS start FROM h),
    p AS (SELECT s.c_custkey, max(wbgt) AS peak, min(slot) AS first, max(slot) + 900 AS reach FROM s JOIN f ON f.station_id = s.station_id AND slot >= greatest(start, {NOW} - 900) AND slot < start + len GROUP BY 1)
    SELECT c_custkey, s.start AS start, s.start + len AS "end", {r4('peak')} AS peak, {band_sql('peak - offset_c')} AS risk, coalesce(peak - offset_c >= 21, false) AS affected,
        greatest(s.start, first) AS judged_from, least(s.start + len, reach) AS judged_to, reach < s.start + len AS partial FROM s LEFT JOIN p USING (c_custkey)""")
def operations(spark, sf_dir):
    """Q13: planned activities against the forecast: the occurrence now or next, its peak and band, and how far the forecast reaches."""
    k = F.col("c_custkey")
    activities = table(spark, sf_dir, "customer").select(k, (k % 4).alias("station_id"), (k % 24).alias("start_hour"), (k * 7 % 24).alias("end_hour"), (k % 5 - 2).cast("double").alias("offset_c"))
    f = wbgt(spark, sf_dir).filter(F.col("slot").between(NOW, NOW + 32400)).select("station_id", "slot", F.col("wbgt").alias("value"))
    found = outlook.assess(activities, f, NOW)
    return found.select("c_custkey", "start", "end", half_up(F.col("peak"), 4).alias("peak"), "risk", "affected", "judged_from", "judged_to", "partial")


@query(f"""WITH {WINDOWS_SQL}, asked AS (SELECT o_orderkey AS request_id, o_custkey % 4 AS station_id, 19724 + o_orderkey % 28 AS day, (19724 + o_orderkey % 28) * 86400 + o_orderkey % 40 * 900 AS window_start, (19724 + o_orderkey % 28) * 86400 + 30000 + o_orderkey % 50 * 900 AS window_end FROM orders),
    ranked AS (SELECT *, (rank, floor(peak / 0.05::double + 1e-6), floor(width / 0.1::double + 1e-6), floor(mean * 1e6 + 0.5), start) AS k FROM cand),
    own AS (SELECT request_id, min_by(start, k) AS best FROM asked JOIN ranked USING (station_id, day) WHERE start >= window_start AND "end" <= window_end AND day % 3 <> 0 GROUP BY 1),
    reg AS (SELECT request_id, min_by(start, k) AS best FROM asked JOIN ranked USING (station_id, day) WHERE start >= window_start AND "end" <= window_end AND day % 2 = 0 GROUP BY 1)
    SELECT request_id, CASE WHEN station_id <> 3 AND own.best IS NOT NULL THEN 'station' WHEN reg.best IS NOT NULL THEN 'regional' WHEN station_id = 3 THEN 'quality_poor' ELSE 'no_window' END AS outcome,
        CASE WHEN station_id <> 3 AND own.best IS NOT NULL THEN own.best ELSE reg.best END AS start FROM asked LEFT JOIN own USING (request_id) LEFT JOIN reg USING (request_id)""")
def activity_plan(spark, sf_dir):
    """Q12: the best window of a request by the station's forecast, else the regional one's, else why there is none."""
    k = F.col("o_orderkey")
    day = 19724 + k % 28
    asked = table(spark, sf_dir, "orders").select(
        k.alias("request_id"), (F.col("o_custkey") % 4).alias("station_id"), day.alias("day"), (day * 86400 + k % 40 * 900).alias("window_start"), (day * 86400 + 30000 + k % 50 * 900).alias("window_end")
    )
    w = windows(spark, sf_dir)
    poor = spark.range(4).select(F.col("id").alias("station_id"), F.when(F.col("id") == 3, "POOR").otherwise("GOOD").alias("quality"))
    return outlook.plan(asked, w.filter("day % 3 <> 0"), w.filter("day % 2 = 0"), poor, ["station_id", "day"], besttime.order())


@query(f"""WITH {WINDOWS_SQL}, asked AS (SELECT o_orderkey AS request_id, o_custkey % 4 AS station_id, 19724 + o_orderkey % 28 AS day, (19724 + o_orderkey % 28) * 86400 + o_orderkey % 40 * 900 AS window_start,
        (19724 + o_orderkey % 28) * 86400 + 30000 + o_orderkey % 50 * 900 AS window_end, (19724 + o_orderkey % 28) * 86400 + o_orderkey % 11 * 5400 AS now FROM orders),
    a AS (SELECT *, ceil(greatest(window_start, now) / 900.0)::BIGINT * 900 AS begin FROM asked),
    ranked AS (SELECT *, (rank, floor(peak / 0.05::double + 1e-6), floor(width / 0.1::double + 1e-6), floor(mean * 1e6 + 0.5), start) AS k,
        (rank, floor(peak / 0.05::double + 1e-6), floor(mean * 1e6 + 0.5), start) AS rk, {{'start': start, 'peak': peak, 'width': width}} AS w FROM cand),
    own AS (SELECT request_id, min_by(w, k) AS w FROM a JOIN ranked USING (station_id, day) WHERE start >= begin AND "end" <= window_end AND day % 3 <> 0 AND station_id <> 3 GROUP BY 1),
    reg AS (SELECT request_id, min_by(w, rk) AS w FROM a JOIN ranked USING (station_id, day) WHERE start >= begin AND "end" <= window_end AND day % 2 = 0 GROUP BY 1),
    known AS (SELECT DISTINCT station_id, day FROM cand WHERE day % 2 = 0),
    met AS (SELECT a.*, own.w AS o, reg.w AS r, known.day IS NOT NULL AS regional, len(list_filter(range(begin, window_end - 7200 + 1, 900), lambda t: t % 86400 BETWEEN 12600 AND 56100 AND (t + 7200) % 86400 BETWEEN 12600 AND 56100)) > 0 AS room
        FROM a LEFT JOIN own USING (request_id) LEFT JOIN reg USING (request_id) LEFT JOIN known ON known.station_id = a.station_id AND known.day = a.day),
    g AS (SELECT *, CASE WHEN o IS NOT NULL THEN o.start ELSE r.start END AS start, CASE WHEN o IS NOT NULL THEN o.peak ELSE r.peak END AS peak, CASE WHEN o IS NOT NULL THEN o.width WHEN r IS NOT NULL THEN 4 END / 2 AS half FROM met)
    SELECT request_id, CASE WHEN o IS NOT NULL THEN 'station' WHEN r IS NOT NULL THEN 'regional' WHEN NOT room THEN 'no_daylight_window' WHEN station_id = 3 AND NOT regional THEN 'quality_poor' ELSE 'no_window' END AS outcome,
        start, {r4('peak')} AS peak, {r4('peak - half')} AS lower, {r4('peak + half')} AS upper, CASE WHEN begin > ceil(window_start / 900.0)::BIGINT * 900 THEN begin END AS searched_from FROM g""")
def activity_plan_reasons(spark, sf_dir):
    """Q12: plans from now on, with the band of what they rest on and why there is none."""
    k = F.col("o_orderkey")
    day = 19724 + k % 28
    asked = table(spark, sf_dir, "orders").select(
        k.alias("request_id"),
        (F.col("o_custkey") % 4).alias("station_id"),
        day.alias("day"),
        (day * 86400 + k % 40 * 900).alias("window_start"),
        (day * 86400 + 30000 + k % 50 * 900).alias("window_end"),
        (day * 86400 + k % 11 * 5400).alias("now"),
    )
    w = windows(spark, sf_dir)
    poor = spark.range(4).select(F.col("id").alias("station_id"), F.when(F.col("id") == 3, "POOR").otherwise("GOOD").alias("quality"))
    found = outlook.plan_with_reasons(asked, w.filter("day % 3 <> 0"), w.filter("day % 2 = 0"), poor, ["station_id", "day"], besttime.order(), 7200, (12600, 56100))
    return found.withColumns({c: half_up(F.col(c), 4) for c in ("peak", "lower", "upper")})


@query(f"""WITH {READINGS_SQL}, d AS (SELECT * FROM readings QUALIFY row_number() OVER (PARTITION BY station_id, t ORDER BY event_id DESC) = 1),
    l AS (SELECT station_id, t, CASE WHEN temp BETWEEN -5 AND 45 THEN temp END AS temp, CASE WHEN rh > 0 AND rh <= 100 THEN rh END AS rh, CASE WHEN press BETWEEN 800 AND 900 THEN press END AS press, CASE WHEN wind BETWEEN 0 AND 60 THEN wind END AS wind, CASE WHEN rain BETWEEN 0 AND 10 THEN rain END AS rain FROM d),
    g AS (SELECT station_id, t - t % 900 AS slot, avg(temp) AS temp, avg(rh) AS rh, avg(press) AS press, avg(wind) AS wind, sum(rain) AS rain FROM l GROUP BY 1, 2),
    s AS (SELECT station_id, unnest(generate_series(lo, hi, 900)) AS slot FROM (SELECT station_id, min(slot) AS lo, max(slot) AS hi FROM g GROUP BY 1)),
    e AS (SELECT station_id, slot, temp, rh, press, wind, CASE WHEN rain IS NOT NULL OR temp IS NOT NULL OR rh IS NOT NULL OR press IS NOT NULL OR wind IS NOT NULL THEN coalesce(rain, 0) END AS rain, row_number() OVER (PARTITION BY station_id ORDER BY slot) AS n FROM s LEFT JOIN g USING (station_id, slot)),
    {', '.join(f'''{c}_f AS (SELECT station_id, slot, coalesce({c}, CASE WHEN qn - pn - 1 <= 2 THEN p + (q - p) * (n - pn) / (qn - pn) END) AS {c} FROM (SELECT *, last_value({c} IGNORE NULLS) OVER b AS p, last_value(CASE WHEN {c} IS NOT NULL THEN n END IGNORE NULLS) OVER b AS pn,
        first_value({c} IGNORE NULLS) OVER a AS q, first_value(CASE WHEN {c} IS NOT NULL THEN n END IGNORE NULLS) OVER a AS qn FROM e
        WINDOW b AS (PARTITION BY station_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY station_id ORDER BY slot ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)))''' for c in ("temp", "rh", "press", "wind"))}
    SELECT e.station_id, e.slot, {r4('coalesce(last_value(temp_f.temp IGNORE NULLS) OVER w, 20)')} AS temp, {r4('coalesce(last_value(rh_f.rh IGNORE NULLS) OVER w, 60)')} AS rh, {r4('coalesce(last_value(press_f.press IGNORE NULLS) OVER w, 848)')} AS press,
        {r4('greatest(0, coalesce(last_value(wind_f.wind IGNORE NULLS) OVER w, 1))')} AS wind, {r4('coalesce(e.rain, 0)')} AS rain,
        array_to_string(list_filter([CASE WHEN e.temp IS NULL THEN 'temp' END, CASE WHEN e.rh IS NULL THEN 'rh' END, CASE WHEN e.press IS NULL THEN 'press' END, CASE WHEN e.wind IS NULL THEN 'wind' END, CASE WHEN e.rain IS NULL THEN 'rain' END], lambda x: x IS NOT NULL), ',') AS imputed,
        e.temp IS NOT NULL AND e.rh IS NOT NULL AS measured
    FROM e JOIN temp_f USING (station_id, slot) JOIN rh_f USING (station_id, slot) JOIN press_f USING (station_id, slot) JOIN wind_f USING (station_id, slot) WINDOW w AS (PARTITION BY e.station_id ORDER BY e.slot)""")
def clean_grid(spark, sf_dir):
    """From raw records to a gridded series without holes that says what wasn't measured."""
    g = outlook.clean_grid(readings(spark, sf_dir), KEYS, {"temp": 20.0, "rh": 60.0, "press": 848.0, "wind": 1.0, "rain": 0.0})
    figures = [half_up(F.col(c), 4).alias(c) for c in ("temp", "rh", "press", "wind", "rain")]
    return g.select("station_id", "slot", *figures, F.array_join("imputed", ",").alias("imputed"), outlook.measured("temp", "rh").alias("measured"))
