"""Forecasts and their scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.rounding import half_up
from ..operators import forecast, series
from ..sources.testdata import GRID_SQL, readings
from .registry import query, r4

KEYS = ["station_id"]
STEPS = [1, 4, 12]
BASE_SQL = f"""{GRID_SQL},
    filled AS (SELECT station_id, slot, coalesce(last_value(temp IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY slot), 20) AS temp FROM dense),
    usual AS (SELECT station_id, slot, temp, CASE WHEN count(temp) OVER b >= 5 THEN avg(temp) OVER b END AS usual FROM filled
        WINDOW b AS (PARTITION BY station_id, slot % 86400 ORDER BY slot RANGE BETWEEN 2592000 PRECEDING AND 86400 PRECEDING)),
    pairs AS ({' UNION ALL '.join(f"SELECT station_id, slot, {s} AS step, temp AS x0, usual AS u0, lead(temp, {s}) OVER w AS x1, lead(usual, {s}) OVER w AS u1 FROM usual WINDOW w AS (PARTITION BY station_id ORDER BY slot)" for s in STEPS)}),
    known AS (SELECT *, slot // 604800 AS week FROM pairs WHERE x0 IS NOT NULL AND u0 IS NOT NULL AND x1 IS NOT NULL AND u1 IS NOT NULL),
    fit AS (SELECT step, sum((x0 - u0) * (x1 - u1)) / sum((x0 - u0) * (x0 - u0)) AS a FROM known GROUP BY 1),
    sums AS (SELECT step, week, sum((x0 - u0) * (x1 - u1)) AS xy, sum((x0 - u0) * (x0 - u0)) AS xx FROM known GROUP BY 1, 2),
    fits AS (SELECT step, week, sum(xy) OVER b / sum(xx) OVER b AS a FROM sums WINDOW b AS (PARTITION BY step ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    scored AS (SELECT k.*, a, u1 + a * (x0 - u0) AS f, u1 + a * (x0 - u0) - x1 AS e FROM known k JOIN fits USING (step, week) WHERE a IS NOT NULL)"""


def pairs(spark, sf_dir):
    g = series.carry(series.dense(series.slot_grid(readings(spark, sf_dir), KEYS), KEYS), KEYS, {"temp": 20.0})
    u = series.rolling_usual(g, KEYS, "temp", least=5)
    return forecast.pairs(u, KEYS, STEPS).withColumn("week", F.floor(F.col("slot") / 604800))


def scored(spark, sf_dir):
    rows = forecast.rolling_origin(pairs(spark, sf_dir), "week")
    rows = rows.withColumn("f", forecast.seasonal(F.col("a")))
    return rows.withColumn("e", F.col("f") - F.col("x1"))


@query(f"WITH {BASE_SQL} SELECT step, {r4('a')} AS a, n FROM fit JOIN (SELECT step, count(*) AS n FROM known GROUP BY 1) USING (step)")
def seasonal_factor_by_step(spark, sf_dir):
    """M1: what is left of an anomaly after so many steps."""
    return pairs(spark, sf_dir).groupBy("step").agg(half_up(forecast.slope(), 4).alias("a"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {BASE_SQL} SELECT station_id, slot, step, slot + step * 900 AS target, floor((u1 + a * (x0 - u0)) * 10 + 0.500001) / 10 AS value FROM known JOIN fit USING (step)
    QUALIFY row_number() OVER (PARTITION BY station_id, step ORDER BY slot DESC) <= 10""".replace("* 10 + 0.500001) / 10 AS value", "* 10000 + 0.500001) / 10000 AS value"))
def seasonal_forecast(spark, sf_dir):
    """Q7: forecasts from the latest origins."""
    p = pairs(spark, sf_dir)
    fit = p.groupBy("step").agg(forecast.slope().alias("a"))
    rows = p.join(F.broadcast(fit), "step").withColumn("value", half_up(forecast.seasonal(F.col("a")), 4))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("station_id", "step").orderBy(F.desc("slot")))).filter("k <= 10")
    return rows.select("station_id", "slot", "step", (F.col("slot") + F.col("step") * 900).alias("target"), "value")


def error_counts(rows, *keys):
    """Errors counted by their size in hundredths: what percentiles are taken of doesn't grow with the rows."""
    return rows.groupBy(*keys, half_up(F.abs("e"), 2).alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {BASE_SQL}, blocks AS (SELECT step, (slot + step * 900) % 86400 // 10800 AS block, quantile_cont(floor(abs(e) * 100 + 0.5) / 100, 0.8) AS band FROM scored GROUP BY 1, 2),
    pooled AS (SELECT step, quantile_cont(floor(abs(e) * 100 + 0.5) / 100, 0.8) AS band FROM scored GROUP BY 1)
    SELECT step, block, {r4('coalesce(blocks.band, pooled.band)')} AS band FROM (SELECT DISTINCT step FROM known) s CROSS JOIN generate_series(0, 7) b(block)
    LEFT JOIN blocks USING (step, block) LEFT JOIN pooled USING (step)""")
def bands_by_block(spark, sf_dir):
    """80 % bands by three-hour block of the target, the pooled one where a block is empty."""
    counts = error_counts(scored(spark, sf_dir), "step", F.floor((F.col("slot") + F.col("step") * 900) % 86400 / 10800).alias("block"))
    band = F.percentile("size", F.lit(0.8), F.col("n"))
    by = counts.groupBy("step", "block").agg(band.alias("band"))
    pooled = counts.groupBy("step").agg(band.alias("pooled"))
    every = pooled.select("step", "pooled", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("block"))
    return every.join(F.broadcast(by), ["step", "block"], "left").select("step", "block", half_up(F.coalesce("band", "pooled"), 4).alias("band"))


@query(f"""WITH {BASE_SQL} SELECT step, week, count(*) AS n, {r4('avg(abs(e))')} AS mae, {r4('sqrt(avg(e * e))')} AS rmse,
    {r4('avg((abs(e) <= 5)::INTEGER)')} AS coverage, {r4('avg(abs(x0 - x1))')} AS mae_no_change FROM scored GROUP BY 1, 2""")
def rolling_origin_scores(spark, sf_dir):
    """Each week forecast with what the weeks before taught."""
    no_change = half_up(F.avg(F.abs(F.col("x0") - F.col("x1"))), 4).alias("mae_no_change")
    return scored(spark, sf_dir).groupBy("step", "week").agg(*forecast.tallies(F.col("e"), F.lit(5.0)), no_change)


@query(f"""WITH {BASE_SQL} SELECT step, week, station_id, count(*) AS n, {r4('avg(abs(e))')} AS mae, {r4('sqrt(avg(e * e))')} AS rmse, {r4('avg((abs(e) <= 5)::INTEGER)')} AS coverage
    FROM scored GROUP BY GROUPING SETS ((step, week, station_id), (step, week), (step))""")
def grouping_sets_scores(spark, sf_dir):
    """Tallies pooled from parts to the whole."""
    sets = [[F.col("step"), F.col("week"), F.col("station_id")], [F.col("step"), F.col("week")], [F.col("step")]]
    return scored(spark, sf_dir).groupingSets(sets, "step", "week", "station_id").agg(*forecast.tallies(F.col("e"), F.lit(5.0)))


@query(f"""WITH {BASE_SQL}, b AS (SELECT step, week, quantile_cont(floor(abs(e) * 100 + 0.5) / 100, 0.8) AS band FROM (SELECT w.week, s.step, s.e FROM scored s JOIN (SELECT DISTINCT week FROM scored) w ON s.week < w.week) GROUP BY 1, 2)
    SELECT step, week, {r4('band')} AS band, {r4('avg((abs(e) <= band)::INTEGER)')} AS covered FROM scored JOIN b USING (step, week) GROUP BY step, week, band""")
def bands_from_earlier(spark, sf_dir):
    """Each week's band from the errors of all weeks before it."""
    s = scored(spark, sf_dir)
    # a histogram a step, summed up from week to week: sizes times weeks, whatever the number of errors
    counts = error_counts(s, "step", "week")
    weeks = s.select("week").distinct()
    every = counts.select("step", "size").distinct().join(F.broadcast(weeks))
    before = Window.partitionBy("step", "size").orderBy("week").rowsBetween(Window.unboundedPreceding, -1)
    upto = every.join(counts, ["step", "size", "week"], "left").withColumn("n", F.sum("n").over(before)).filter("n > 0")
    earlier = upto.groupBy("step", "week").agg(F.percentile("size", F.lit(0.8), F.col("n")).alias("band"))
    inside = F.avg((F.abs("e") <= F.col("band")).cast("double"))
    joined = s.join(F.broadcast(earlier), ["step", "week"])
    return joined.groupBy("step", "week").agg(half_up(F.max("band"), 4).alias("band"), half_up(inside, 4).alias("covered"))


@query(f"""WITH {BASE_SQL}, m AS (SELECT 'no_change' AS model, step, avg(abs(x0 - x1)) AS mae FROM scored GROUP BY 2 UNION ALL SELECT 'seasonal', step, avg(abs(e)) FROM scored GROUP BY 2
    UNION ALL SELECT 'usual', step, avg(abs(u1 - x1)) FROM scored GROUP BY 2), b AS (SELECT step, min(mae) AS best FROM m GROUP BY 1),
    j AS (SELECT model, bool_and(mae <= best + 0.5) AS near, sum(mae) AS total, min(CASE model WHEN 'no_change' THEN 0 WHEN 'usual' THEN 1 ELSE 2 END) AS k FROM m JOIN b USING (step) GROUP BY 1)
    SELECT model FROM j ORDER BY near DESC, CASE WHEN near THEN k ELSE total END LIMIT 1""")
def model_selection(spark, sf_dir):
    """The simplest model that is near the best at every horizon."""
    s = scored(spark, sf_dir)
    errors = F.array(
        *(F.struct(F.lit(m).alias("model"), F.abs(x).alias("d")) for m, x in (("no_change", F.col("x0") - F.col("x1")), ("usual", F.col("u1") - F.col("x1")), ("seasonal", F.col("e"))))
    )
    scores = s.select("step", F.inline(errors)).groupBy("model", "step").agg(F.avg("d").alias("mae"))
    return forecast.select_simplest(scores, ["no_change", "usual", "seasonal"], within=0.5)


@query(f"""WITH {BASE_SQL}, c AS (SELECT station_id, slot, step, x0 AS baseline, f, unnest([{{'part': 'usual_daily_change', 'effect': u1 - u0}}, {{'part': 'departure_from_usual', 'effect': (a - 1) * (x0 - u0)}}]) AS x FROM scored)
    SELECT station_id, slot, step, {r4('baseline')} AS baseline, {r4('f')} AS value, x.part AS part, {r4('x.effect')} AS effect, row_number() OVER (PARTITION BY station_id, slot, step ORDER BY abs(x.effect) DESC, x.part) AS place FROM c QUALIFY place <= 4""")
def topk_contributors(spark, sf_dir):
    """L2, Q8: the terms that move a forecast away from its baseline, four at most; terms and baseline add up to the forecast."""
    terms = forecast.seasonal_terms(F.col("a"))
    s = scored(spark, sf_dir)
    parts = s.select("station_id", "slot", "step", F.col("x0").alias("baseline"), F.col("f").alias("value"), F.inline(F.array(*(F.struct(F.lit(n).alias("part"), x.alias("effect")) for n, x in terms.items()))))
    return forecast.largest_terms(parts, ["station_id", "slot", "step"]).withColumns({c: half_up(F.col(c), 4) for c in ("baseline", "value", "effect")})


@query(f"""WITH {GRID_SQL}, p AS (SELECT station_id, slot, 1 / (1 + exp(-(-2 + 0.03 * (rh - 40)))) AS p, (coalesce(rain, 0) > 0.1)::INTEGER AS y FROM dense WHERE rh IS NOT NULL),
    base AS (SELECT avg(y) AS b FROM p)
    SELECT bin, count(*) AS n, {r4('avg(p)')} AS mean_p, {r4('avg(y)')} AS observed, {r4('avg((p - y) * (p - y))')} AS brier, {r4('avg((b - y) * (b - y))')} AS brier_base
    FROM (SELECT *, CASE WHEN p < 0.05 THEN 0 WHEN p < 0.1 THEN 1 WHEN p < 0.2 THEN 2 WHEN p < 0.3 THEN 3 WHEN p < 0.5 THEN 4 ELSE 5 END AS bin FROM p, base) GROUP BY 1""")
def brier_bins(spark, sf_dir):
    """A logistic chance of rain, its Brier score and calibration by bin."""
    g = series.dense(series.slot_grid(readings(spark, sf_dir), KEYS), KEYS).filter("rh is not null")
    p = 1 / (1 + F.exp(-(-2 + 0.03 * (F.col("rh") - 40))))
    rows = g.select(p.alias("p"), (F.coalesce("rain", F.lit(0.0)) > 0.1).cast("int").alias("y"))
    rows = rows.crossJoin(F.broadcast(rows.agg(F.avg("y").alias("b"))))
    edges = [0.05, 0.1, 0.2, 0.3, 0.5]
    bin_ = F.lit(len(edges))
    for k, edge in reversed(list(enumerate(edges))):
        bin_ = F.when(F.col("p") < edge, k).otherwise(bin_)
    y = F.col("y")
    return rows.groupBy(bin_.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        half_up(F.avg("p"), 4).alias("mean_p"),
        half_up(F.avg("y"), 4).alias("observed"),
        half_up(forecast.brier(F.col("p"), y), 4).alias("brier"),
        half_up(forecast.brier(F.col("b"), y), 4).alias("brier_base"),
    )


@query(f"""WITH {GRID_SQL}, m AS (SELECT month(make_timestamp(slot * 1000000))::INTEGER AS month, (slot % 86400 // 3600) AS hour, avg((coalesce(rain, 0) > 0.1)::INTEGER) AS rate FROM dense GROUP BY 1, 2),
    base AS (SELECT avg((coalesce(rain, 0) > 0.1)::INTEGER) AS b FROM dense)
    SELECT s.month::INTEGER AS month, h.hour, {r4('coalesce(rate, b)')} AS rate FROM generate_series(1, 12) s(month) CROSS JOIN generate_series(0, 23) h(hour) CROSS JOIN base LEFT JOIN m ON s.month = m.month AND h.hour = m.hour""")
def month_hour_table(spark, sf_dir):
    """A rate for every month and hour, the base rate where none was seen."""
    g = series.dense(series.slot_grid(readings(spark, sf_dir), KEYS), KEYS)
    g = g.withColumns({"y": (F.coalesce("rain", F.lit(0.0)) > 0.1).cast("int"), "month": F.month(F.timestamp_seconds("slot")), "hour": F.floor(F.col("slot") % 86400 / 3600)})
    by = g.groupBy("month", "hour").agg(F.avg("y").alias("rate"))
    # the calendar is 288 rows, made from one
    every = g.agg(F.avg("y").alias("b")).select("b", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    every = every.select("b", "month", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("hour"))
    return every.join(F.broadcast(by), ["month", "hour"], "left").select("month", "hour", half_up(F.coalesce("rate", "b"), 4).alias("rate"))


@query(f"""WITH {BASE_SQL}, v AS (SELECT station_id, step, count(*) AS n, {r4('avg(abs(e))')} AS mae, {r4('avg(abs(x0 - x1))')} AS mae_no_change, {r4('avg((abs(e) <= 3)::INTEGER)')} AS within
        FROM scored WHERE (slot + 10800) % 86400 // 3600 BETWEEN 6 AND 18 AND slot % 3600 = 0 GROUP BY 1, 2) SELECT * FROM v""")
def replay_summary(spark, sf_dir):
    """Hourly anchors of the day replayed, each forecast held against what was recorded."""
    s = scored(spark, sf_dir).filter(F.floor((F.col("slot") + 10800) % 86400 / 3600).between(6, 18) & (F.col("slot") % 3600 == 0))
    return s.groupBy("station_id", "step").agg(
        F.count(F.lit(1)).alias("n"),
        half_up(F.avg(F.abs("e")), 4).alias("mae"),
        half_up(F.avg(F.abs(F.col("x0") - F.col("x1"))), 4).alias("mae_no_change"),
        half_up(F.avg((F.abs("e") <= 3).cast("double")), 4).alias("within"),
    )
