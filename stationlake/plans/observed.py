"""The whole way from raw records to gridded observations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.rounding import half_up
from ..operators import observations
from ..sources.testdata import READINGS_SQL, readings
from .refits import _STULL
from .registry import query, r4

KEYS = ["station_id"]
_FILLED = {"temp": 20, "rh": 60, "press": 848, "wind": 1, "vis": 0, "wind_dir": 120}


def raw_records(spark, sf_dir):
    """Rows with gusts, of which some are below the wind, directions, light that dips below 0, and a counter that restarts each rain day, with the total of the day before."""
    r = readings(spark, sf_dir)
    k, day = F.col("event_id"), F.floor((F.col("t") - 21600) / 86400)
    windy = lambda c: F.when(F.col("wind").isNotNull(), c)
    rained = r.filter("rain is not null").select("station_id", "t", day.alias("day"), "rain").groupBy("station_id", "t", "day").agg(F.sum("rain").alias("rain"))
    w = Window.partitionBy("station_id", "day").orderBy("t")
    totals = rained.select("station_id", "t", "day", (F.floor(F.sum("rain").over(w) * 1000 + 0.500001) / 1000 - F.when(F.col("t") % 29 == 0, 0.75).otherwise(0.0)).alias("total"))
    priors = rained.groupBy("station_id", (F.col("day") + 1).alias("day")).agg((F.floor(F.sum("rain") * 1000 + 0.500001) / 1000).alias("prior"))
    totals = totals.join(priors, ["station_id", "day"], "left").drop("day")
    more = {
        "gust": windy(F.col("wind") + k % 4 - 1),
        "wind_dir": windy((k * 37 % 360).cast("double")),
        "vis": F.when(F.col("press").isNotNull(), (k % 500 - 20).cast("double")),
    }
    return r.withColumns(more).join(totals, ["station_id", "t"], "left").withColumns({c: F.when(F.col("rain").isNotNull(), F.col(c)) for c in ("total", "prior")})


_RAW_SQL = f"""{READINGS_SQL},
    rained AS (SELECT station_id, t, (t - 21600) // 86400 AS day, sum(rain) AS rain FROM readings WHERE rain IS NOT NULL GROUP BY 1, 2, 3),
    totals AS (SELECT station_id, t, day, floor(sum(rain) OVER (PARTITION BY station_id, day ORDER BY t) * 1000 + 0.500001) / 1000 - CASE WHEN t % 29 = 0 THEN 0.75 ELSE 0 END AS total FROM rained),
    priors AS (SELECT station_id, day + 1 AS day, floor(sum(rain) * 1000 + 0.500001) / 1000 AS prior FROM rained GROUP BY 1, 2),
    raw AS (SELECT r.*, wind + event_id % 4 - 1 AS gust, CASE WHEN wind IS NOT NULL THEN (event_id * 37 % 360)::DOUBLE END AS wind_dir, CASE WHEN press IS NOT NULL THEN (event_id % 500 - 20)::DOUBLE END AS vis,
            CASE WHEN r.rain IS NOT NULL THEN total END AS total, CASE WHEN r.rain IS NOT NULL THEN prior END AS prior
        FROM readings r LEFT JOIN totals ON totals.station_id = r.station_id AND totals.t = r.t LEFT JOIN priors ON priors.station_id = r.station_id AND priors.day = totals.day),
    one AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY station_id, t ORDER BY event_id DESC) = 1),
    limited AS (
        SELECT station_id, t, CASE WHEN temp BETWEEN -5 AND 45 THEN temp END AS temp, CASE WHEN rh > 0 AND rh <= 100 THEN rh END AS rh, CASE WHEN press BETWEEN 800 AND 900 THEN press END AS press, CASE WHEN wind BETWEEN 0 AND 60 THEN wind END AS wind, CASE WHEN gust BETWEEN 0 AND 75 THEN gust END AS gust,
            vis, wind_dir, total, prior, list_filter([CASE WHEN NOT temp BETWEEN -5 AND 45 THEN 'temp' END, CASE WHEN rh <= 0 OR rh > 100 THEN 'rh' END, CASE WHEN NOT press BETWEEN 800 AND 900 THEN 'press' END, CASE WHEN NOT wind BETWEEN 0 AND 60 THEN 'wind' END, CASE WHEN NOT gust BETWEEN 0 AND 75 THEN 'gust' END SUMS_REJECTED], lambda x: x IS NOT NULL) AS rejected, RAIN_COLUMN
        FROM one)"""
_COUNTER = """,
    numbered AS (SELECT station_id, t, (t - 21600) // 86400 AS day, total, prior, row_number() OVER (PARTITION BY station_id ORDER BY t) AS k FROM limited WHERE total IS NOT NULL),
    fold AS (SELECT station_id, k, t, NULL::DOUBLE AS mm, total::DOUBLE AS peak, day AS restarted, day FROM numbered WHERE k = 1
        UNION ALL SELECT n.station_id, n.k, n.t,
            CASE WHEN n.day - f.day >= 2 THEN n.total WHEN n.total < f.peak - 0.1 AND n.day > f.restarted THEN n.total + greatest(0, coalesce(n.prior, f.peak) - f.peak) ELSE greatest(0, n.total - f.peak) END::DOUBLE,
            CASE WHEN n.day - f.day >= 2 OR (n.total < f.peak - 0.1 AND n.day > f.restarted) THEN n.total ELSE greatest(f.peak, n.total) END::DOUBLE,
            CASE WHEN n.day - f.day >= 2 OR (n.total < f.peak - 0.1 AND n.day > f.restarted) THEN n.day ELSE f.restarted END, n.day
        FROM fold f JOIN numbered n ON n.station_id = f.station_id AND n.k = f.k + 1),
    rainy AS (SELECT l.*, floor(mm * 1000 + 0.5) / 1000 AS fallen FROM limited l LEFT JOIN fold USING (station_id, t))"""


def _grid_sql(counters: bool) -> str:
    """SQL of the whole chain, from raw rows to the output of the queries below."""
    start = _RAW_SQL.replace("RAIN_COLUMN", "rain" if not counters else "NULL AS rain").replace("SUMS_REJECTED", "" if counters else ", CASE WHEN NOT rain BETWEEN 0 AND 10 THEN 'rain' END")
    if counters:
        rainy = _COUNTER
    else:
        rainy = """, rainy AS (SELECT *, coalesce(CASE WHEN rain BETWEEN 0 AND 10 THEN rain END, CASE WHEN coalesce(temp, rh, press, wind, gust, vis, wind_dir) IS NOT NULL OR rain BETWEEN 0 AND 10 THEN 0 END) AS fallen FROM limited)"""
    names = ["temp", "rh", "press", "wind", "vis", "gust", "wind_dir"]
    ends = ", ".join(
        f"last_value({c} IGNORE NULLS) OVER b AS {c}_p, last_value(CASE WHEN {c} IS NOT NULL THEN k END IGNORE NULLS) OVER b AS {c}_pk, first_value({c} IGNORE NULLS) OVER a AS {c}_q, first_value(CASE WHEN {c} IS NOT NULL THEN k END IGNORE NULLS) OVER a AS {c}_qk"
        for c in names
    )
    step = lambda c: f"({c}_q - {c}_p)" if c != "wind_dir" else f"((({c}_q - {c}_p + 540) % 360) - 180)"
    line = lambda c: f"{c}_p + {step(c)} * ({c}_qk - {c}_pk - ({c}_qk - k)) / ({c}_qk - {c}_pk)"
    whole = lambda c: line(c) if c != "wind_dir" else f"((({line(c)}) % 360) + 360) % 360"
    inner = ", ".join(f"coalesce({c}, CASE WHEN {c}_qk - {c}_pk - 1 <= 2 THEN {whole(c)} END) AS {c}, {c} IS NULL AS {c}_gone" for c in names)
    carried = ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER w, {v}) AS {c}" for c, v in _FILLED.items())
    marks = ", ".join(f"CASE WHEN {c}_gone THEN '{c}' END" for c in [*names, "rain"])
    return f"""WITH RECURSIVE {start}{rainy},
    slots AS (SELECT station_id, t - t % 900 AS slot, avg(temp) AS temp, avg(rh) AS rh, avg(press) AS press, avg(wind) AS wind, avg(vis) AS vis, max(gust) AS gust,
            CASE WHEN count(wind_dir) > 0 THEN floor(((atan2(avg(sin(radians(wind_dir))), avg(cos(radians(wind_dir)))) * 180 / pi() + 360) % 360) * 10 + 0.5) / 10 % 360 END AS wind_dir,
            floor(sum(fallen) * 1000 + 0.5) / 1000 AS rain, {'max_by(total, t) FILTER (total IS NOT NULL)' if counters else 'NULL::DOUBLE'} AS total, list_sort(list_distinct(flatten(list(rejected)))) AS rejected, bool_or(gust < wind) AS gusty
        FROM rainy GROUP BY 1, 2),
    spacing AS (SELECT station_id, t AS e, lag(t) OVER (PARTITION BY station_id ORDER BY t) AS b FROM one),
    feed AS (SELECT station_id, list_sort(list(e - b) FILTER (b IS NOT NULL))[count(b) // 2 + 1] AS cadence FROM spacing GROUP BY 1),
    open_gaps AS (SELECT station_id, b, e, b + cadence AS m, unnest(generate_series((b + cadence) - (b + cadence) % 900, e - e % 900, 900)) AS slot FROM spacing JOIN feed USING (station_id) WHERE e - b > cadence + 240),
    charged AS (SELECT station_id, slot, sum(least(e, slot + 900) - greatest(m, slot)) / 60 AS gap_minutes, max({{'a': b, 'b': e}}) AS gap FROM open_gaps WHERE least(e, slot + 900) > greatest(m, slot) GROUP BY 1, 2),
    slipped AS (SELECT station_id, e - e % 900 AS slot, count(*) AS late_intervals FROM spacing JOIN feed USING (station_id) WHERE e - b <= cadence + 240 AND e - b >= 2 * cadence GROUP BY 1, 2),
    spine AS (SELECT station_id, unnest(generate_series(min(slot), max(slot), 900)) AS slot FROM slots GROUP BY 1),
    placed AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY slot) AS k FROM spine LEFT JOIN slots USING (station_id, slot)),
    ends AS (SELECT *, {ends} FROM placed WINDOW b AS (PARTITION BY station_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY station_id ORDER BY slot ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    bridged AS (SELECT station_id, slot, {inner}, rain, rain IS NULL AS rain_gone, total, rejected, gusty FROM ends),
    carried AS (SELECT station_id, slot, {carried}, gust, coalesce(rain, 0) AS rain, coalesce(last_value(total IGNORE NULLS) OVER w, 0) AS total, coalesce(rejected, []) AS rejected, coalesce(gusty, false) AS gusty,
            array_to_string(list_filter([{marks}], lambda x: x IS NOT NULL), ',') AS imputed FROM bridged WINDOW w AS (PARTITION BY station_id ORDER BY slot)),
    bulb AS (SELECT *, {_STULL} AS wet_bulb FROM carried)
    SELECT station_id, slot, {r4('temp')} AS temp, {r4('rh')} AS rh, {r4('press')} AS press, {r4('greatest(0, wind)')} AS wind, {r4('coalesce(gust, greatest(0, wind))')} AS gust, {r4('wind_dir')} AS wind_dir, {r4('greatest(0, vis)')} AS vis, {r4('wet_bulb')} AS wet_bulb,
        {r4('0.7 * wet_bulb + 0.3 * temp')} AS wbgt, {r4('rain')} AS rain, {r4('total') if counters else '0.0::DOUBLE'} AS total, {r4('coalesce(gap_minutes, 0)')} AS gap_minutes, gap.a AS gap_from, gap.b AS gap_to, coalesce(late_intervals, 0) AS late_intervals,
        array_to_string(rejected, ',') AS rejected, CASE WHEN gusty THEN 'wind_gust' ELSE '' END AS raw_faults, imputed
    FROM bulb LEFT JOIN charged USING (station_id, slot) LEFT JOIN slipped USING (station_id, slot)"""


def _told(g):
    figures = ("temp", "rh", "press", "wind", "gust", "wind_dir", "vis", "wet_bulb", "wbgt", "rain", "total", "gap_minutes")
    total = {} if "total" in g.columns else {"total": F.lit(0.0)}
    return g.withColumns(total).select(
        "station_id",
        "slot",
        *(half_up(F.col(c), 4).alias(c) for c in figures),
        F.col("gap.from").alias("gap_from"),
        F.col("gap.to").alias("gap_to"),
        "late_intervals",
        *(F.array_join(c, ",").alias(c) for c in ("rejected", "raw_faults", "imputed")),
    )


@query(_grid_sql(counters=True))
def observation_grid(spark, sf_dir):
    """Raw records to gridded observations, rain by the rise of counters, silences charged to slots, counters carried unmarked, and what was rejected or filled."""
    return _told(observations.observation_grid(raw_records(spark, sf_dir).drop("rain"), KEYS))


@query(_grid_sql(counters=False))
def observation_grid_sums(spark, sf_dir):
    """Q1, Q2: the same of a feed that reports rain itself: none where it reports anything else."""
    return _told(observations.observation_grid(raw_records(spark, sf_dir).drop("total", "prior"), KEYS, rain="sums"))
