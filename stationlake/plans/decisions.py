"""Where a station stands, best windows, alerts, areas, counters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import api
from ..functions.heat import risk_band, risk_rank
from ..functions.rounding import half_up
from ..operators import alerts, besttime, counters, spatial
from ..sources.testdata import GRID_SQL, READINGS_SQL, readings, table
from .expressions import STULL_SQL, band_sql
from .health import CENTROIDS
from .registry import query, r4

KEYS = ["station_id"]
FILLED_SQL = f"""{GRID_SQL}, filled AS (SELECT station_id, slot, n, coalesce(last_value(temp IGNORE NULLS) OVER w, 20) AS temp, coalesce(last_value(rh IGNORE NULLS) OVER w, 60) AS rh,
        (temp IS NULL OR rh IS NULL)::INTEGER AS imputed FROM dense WINDOW w AS (PARTITION BY station_id ORDER BY slot)),
    wbgt AS (SELECT *, 0.7::double * ({STULL_SQL}) + 0.3::double * temp AS wbgt FROM filled)"""


def wbgt(spark, sf_dir):
    return api.exposure(readings(spark, sf_dir))


@query(f"""WITH {FILLED_SQL}, l AS (SELECT station_id, slot, wbgt, wbgt - lag(wbgt, 4) OVER w AS change_1h, avg(imputed) OVER (w ROWS 95 PRECEDING) AS filled_share,
        row_number() OVER (PARTITION BY station_id ORDER BY slot DESC) AS k FROM wbgt WINDOW w AS (PARTITION BY station_id ORDER BY slot))
    SELECT station_id, slot, {r4('wbgt')} AS wbgt, {band_sql('floor(wbgt * 10 + 0.5) / 10')} AS band, {r4('change_1h')} AS change_1h, {r4('filled_share')} AS filled_share FROM l WHERE k = 1""")
def situation(spark, sf_dir):
    """The flagship: each station's latest slot, its WBGT and band, the change in an hour, and how much was filled in a day."""
    return api.situation(readings(spark, sf_dir))


WINDOWS_SQL = f"""{FILLED_SQL}, f AS (SELECT station_id, slot, slot // 86400 AS day, wbgt AS value, 1 + (slot // 900 % 7) / 10.0::double AS width FROM wbgt),
    dealt AS (SELECT station_id, value, width, slot - k * 900 AS start FROM f CROSS JOIN generate_series(0, 7) s(k)),
    c AS (SELECT station_id, start, max(value) AS peak, avg(value) AS mean, avg(width) AS width FROM dealt GROUP BY 1, 2 HAVING count(*) = 8),
    cand AS (SELECT station_id, start // 86400 AS day, start, start + 7200 AS "end", peak, mean, width,
        CASE WHEN peak < 18 THEN 0 WHEN peak < 21 THEN 1 WHEN peak < 24 THEN 2 ELSE 3 END AS rank FROM c
        WHERE start % 86400 BETWEEN 12600 AND 56100 AND (start + 7200) % 86400 BETWEEN 12600 AND 56100)"""


def windows(spark, sf_dir):
    f = wbgt(spark, sf_dir).select("station_id", "slot", F.col("wbgt").alias("value"), (1 + F.floor(F.col("slot") / 900) % 7 / 10).alias("width"))
    return besttime.candidates(f, KEYS, 7200, daylight=(12600, 56100)).withColumn("day", F.floor(F.col("start") / 86400))


@query(f"""WITH {WINDOWS_SQL} SELECT station_id, day, start, "end", rank, {r4('peak')} AS peak FROM cand QUALIFY row_number() OVER (PARTITION BY station_id, day
    ORDER BY rank, floor(peak / 0.05::double + 1e-6), floor(width / 0.1::double + 1e-6), floor(mean * 1e6 + 0.5), start) = 1""")
def best_window(spark, sf_dir):
    """Q11, L1 in its transitive form: the best two hours of each day."""
    return besttime.best_quantised(windows(spark, sf_dir), ["station_id", "day"]).withColumn("peak", half_up(F.col("peak"), 4))


@query()
def best_window_tolerant(spark, sf_dir):
    """Q11, L1 with tolerances, which are no order; tests compare it with a plain sort. With the best alternative."""
    return besttime.best_with_tolerances(windows(spark, sf_dir), ["station_id", "day"])


RULES_SQL = """rules AS (SELECT o_orderkey AS rule_id, o_custkey % 4 AS station_id, CASE o_orderkey % 5 WHEN 0 THEN 'exposure_tier' WHEN 1 THEN 'state_transition' WHEN 2 THEN 'rain' WHEN 3 THEN 'data_quality' ELSE 'best_time' END AS kind, o_custkey AS owner, CASE o_orderkey % 3 WHEN 0 THEN 'general' WHEN 1 THEN 'sport' ELSE 'farm' END AS activity,
        (o_custkey % 5 - 2)::double AS offset_c, CASE WHEN o_orderkey % 3 = 0 THEN 1706486400 - (o_orderkey % 40) * 3600 END AS last FROM orders)"""


@query(f"""WITH {FILLED_SQL}, {RULES_SQL},
    day AS (SELECT station_id, max(wbgt) FILTER ((slot + 10800) // 86400 = 19751 AND slot >= 1706485500) AS peak, max(wbgt) FILTER ((slot + 10800) // 86400 = 19750 AND slot >= 1706399100) AS peak_before,
        avg(imputed) > 0.9 AS poor FROM wbgt GROUP BY 1),
    x AS (SELECT rule_id, kind, offset_c, last, peak, peak_before, poor, owner, activity, station_id = 2 AS is_hot, station_id / 4.0::double AS rain_p, coalesce((last + 10800) // 86400 = 19750, false) AS before,
        coalesce((last + 10800) // 86400 = 19751, false) AS already FROM rules JOIN day USING (station_id)),
    b AS (SELECT *, CASE WHEN peak - offset_c < 18 THEN 0 WHEN peak - offset_c < 21 THEN 1 WHEN peak - offset_c < 24 THEN 2 WHEN peak IS NOT NULL THEN 3 END AS now_rank,
        CASE WHEN peak_before - offset_c < 18 THEN 0 WHEN peak_before - offset_c < 21 THEN 1 WHEN peak_before - offset_c < 24 THEN 2 WHEN peak_before IS NOT NULL THEN 3 END AS old_rank FROM x),
    plans AS (SELECT owner, CASE rule_id % 2 WHEN 0 THEN 'sport' ELSE 'farm' END AS activity, now_rank > rule_id % 4 AS risen FROM b),
    i AS (SELECT owner, activity, count(*) AS n FROM plans WHERE risen GROUP BY 1, 2)
    SELECT rule_id, kind, CASE WHEN already THEN false WHEN kind = 'exposure_tier' THEN coalesce(NOT poor AND now_rank >= 2 AND CASE WHEN old_rank IS NOT NULL THEN now_rank > old_rank ELSE NOT before END, false)
        WHEN kind = 'state_transition' THEN coalesce(NOT poor AND NOT is_hot AND peak >= 18.8 AND CASE WHEN peak_before IS NOT NULL THEN peak_before < 18.8 ELSE NOT before END, false)
        WHEN kind = 'best_time' THEN NOT poor AND coalesce((SELECT sum(n) FROM i WHERE i.owner = b.owner AND (b.activity = 'general' OR i.activity = b.activity)), 0) > 0
        WHEN kind = 'rain' THEN rain_p >= 0.5 WHEN kind = 'data_quality' THEN poor ELSE false END AS fired FROM b""")
def alert_rules(spark, sf_dir):
    """Q14, Q15, Q37: alert rules of all owners judged at one instant, with the day before and once-a-day suppression."""
    now = F.lit(1706486400)
    f = wbgt(spark, sf_dir).withColumn("value", F.col("wbgt"))
    light = F.lit(True)
    status = f.groupBy("station_id").agg(F.when(F.avg((F.size("imputed") > 0).cast("int")) > 0.9, "POOR").otherwise("GOOD").alias("status"))
    today = alerts.day_peaks(f, KEYS, now, light).drop("peak_at")
    before = alerts.day_peaks(f, KEYS, now - 86400, light).select("station_id", F.col("peak").alias("peak_before"))
    stations = status.join(today, KEYS, "left").join(before, KEYS, "left").withColumns({"is_hot": F.col("station_id") == 2, "rain_p": F.col("station_id") / 4})
    kinds = F.array(*map(F.lit, ("exposure_tier", "state_transition", "rain", "data_quality", "best_time")))
    rules = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("rule_id"),
        (F.col("o_custkey") % 4).alias("station_id"),
        F.get(kinds, (F.col("o_orderkey") % 5).cast("int")).alias("kind"),
        (F.col("o_custkey") % 5 - 2).cast("double").alias("offset_c"),
        F.when(F.col("o_orderkey") % 3 == 0, 1706486400 - F.col("o_orderkey") % 40 * 3600).alias("last"),
        F.col("o_custkey").alias("owner"),
        F.get(F.array(*map(F.lit, ("general", "sport", "farm"))), (F.col("o_orderkey") % 3).cast("int")).alias("activity"),
    )
    # every order is a saved plan, too, made for one of four bands
    plans = rules.join(F.broadcast(today), KEYS)
    risen = plans.filter(risk_rank(risk_band(F.col("peak"), F.col("offset_c"))) > F.col("rule_id") % 4)
    impacts = risen.select("owner", F.when(F.col("rule_id") % 2 == 0, "sport").otherwise("farm").alias("activity"))
    _, hot = alerts.hot_state(CENTROIDS, "level", 14.0, 4.0)
    watched = alerts.watched_impacts(rules, impacts)
    return alerts.evaluate(watched, F.broadcast(stations), now, hot).select("rule_id", "kind", "fired")


def areas(spark):
    """A square with a hole and a second part, and a triangle."""
    square, hole, part = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]], [[1.0, 1.0], [3.0, 1.0], [3.0, 3.0], [1.0, 3.0]], [[5.0, 0.0], [6.0, 0.0], [6.0, 1.0], [5.0, 1.0]]
    rows = [("county", [[square, hole], [part]]), ("corner", [[[[0.0, 0.0], [2.0, 0.0], [0.0, 2.0]]]])]
    return spark.createDataFrame(rows, "area string, polygons array<array<array<array<double>>>>")


@query("""WITH p AS (SELECT c_custkey, (c_custkey * 37 % 700) / 100.0::double + 0.003::double AS lng, (c_custkey * 53 % 450) / 100.0::double + 0.003::double AS lat FROM customer)
    SELECT c_custkey, 'county' AS area FROM p WHERE (lng BETWEEN 0 AND 4 AND lat BETWEEN 0 AND 4 AND NOT (lng BETWEEN 1 AND 3 AND lat BETWEEN 1 AND 3)) OR (lng BETWEEN 5 AND 6 AND lat BETWEEN 0 AND 1)
    UNION ALL SELECT c_custkey, 'corner' FROM p WHERE lng >= 0 AND lat >= 0 AND lng + lat < 2""")
def point_in_polygon(spark, sf_dir):
    """The areas that hold each point, through grid cells."""
    key = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(key, (key * 37 % 700 / 100 + 0.003).alias("lng"), (key * 53 % 450 / 100 + 0.003).alias("lat"))
    return spatial.locate(p, areas(spark)).select("c_custkey", "area")


@query("""WITH s AS (SELECT c_nationkey, CASE WHEN c_custkey % 7 = 0 OR (c_nationkey % 4 = 0 AND c_custkey % 3 = 0) THEN NULL ELSE c_acctbal / 400 END AS value, cos(radians((c_custkey % 90)::double)) AS w FROM customer),
    a AS (SELECT c_nationkey, sum(w) AS total, coalesce(sum(w) FILTER (value IS NOT NULL), 0) AS have, sum(value * w) AS vw, min(value) AS lo, max(value) AS hi, coalesce(sum(w) FILTER (value >= 21), 0) AS hot,
        count(value) AS valid, count(*) AS samples FROM s GROUP BY 1), e AS (SELECT *, 100 * have / total >= 80 AND valid >= 2 AS enough FROM a)
    SELECT c_nationkey, floor((CASE WHEN enough THEN vw / have END) * 10000 + 0.500001) / 10000 AS mean, CASE WHEN enough THEN lo END AS min, CASE WHEN enough THEN hi END AS max,
        floor((CASE WHEN enough THEN 100 * hot / have END) * 10000 + 0.500001) / 10000 AS above_pct, floor((100 * have / total) * 10000 + 0.500001) / 10000 AS coverage_pct, valid, samples FROM e""")
def weighted_spatial_summary(spark, sf_dir):
    """Area-weighted figures, kept back below 80 % coverage."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    missing = (key % 7 == 0) | ((nation % 4 == 0) & (key % 3 == 0))
    s = table(spark, sf_dir, "customer").select(nation, F.when(~missing, F.col("c_acctbal") / 400).alias("value"), F.cos(F.radians((key % 90).cast("double"))).alias("weight"))
    out = spatial.summary(s, ["c_nationkey"])
    return out.withColumns({c: half_up(F.col(c), 4) for c in ("mean", "above_pct", "coverage_pct")})


@query(f"""WITH RECURSIVE {READINGS_SQL}, r AS (SELECT station_id, t, (t - 21600) // 86400 AS day, sum(rain) AS rain FROM readings WHERE rain IS NOT NULL GROUP BY 1, 2),
    c AS (SELECT station_id, t, day, floor(sum(rain) OVER (PARTITION BY station_id, day ORDER BY t) * 1000 + 0.500001) / 1000 - CASE WHEN t % 29 = 0 THEN 0.75 ELSE 0 END AS total FROM r),
    p AS (SELECT station_id, day + 1 AS day, floor(sum(rain) * 1000 + 0.500001) / 1000 AS prior FROM r GROUP BY 1, 2),
    n AS (SELECT c.*, prior, row_number() OVER (PARTITION BY station_id ORDER BY t) AS k FROM c LEFT JOIN p USING (station_id, day)),
    f AS (SELECT station_id, k, t, NULL::DOUBLE AS mm, total::DOUBLE AS peak, day AS restarted, day FROM n WHERE k = 1
        UNION ALL SELECT n.station_id, n.k, n.t,
            CASE WHEN n.day - f.day >= 2 THEN n.total WHEN n.total < f.peak - 0.1 AND n.day > f.restarted THEN n.total + greatest(0, coalesce(n.prior, f.peak) - f.peak) ELSE greatest(0, n.total - f.peak) END::DOUBLE,
            CASE WHEN n.day - f.day >= 2 OR (n.total < f.peak - 0.1 AND n.day > f.restarted) THEN n.total ELSE greatest(f.peak, n.total) END::DOUBLE,
            CASE WHEN n.day - f.day >= 2 OR (n.total < f.peak - 0.1 AND n.day > f.restarted) THEN n.day ELSE f.restarted END, n.day
        FROM f JOIN n ON n.station_id = f.station_id AND n.k = f.k + 1)
    SELECT station_id, t, {r4('floor(mm * 1000 + 0.5) / 1000')} AS mm FROM f""")
def counter_rain(spark, sf_dir):
    """Rain from a counter that restarts each rain day, with dips and a day's total told the day after."""
    r = readings(spark, sf_dir).filter("rain is not null").groupBy("station_id", "t").agg(F.sum("rain").alias("rain"))
    r = r.withColumn("day", F.floor((F.col("t") - 21600) / 86400))
    dip = F.when(F.col("t") % 29 == 0, 0.75).otherwise(0.0)
    w = Window.partitionBy("station_id", "day").orderBy("t")
    c = r.withColumn("total", F.floor(F.sum("rain").over(w) * 1000 + 0.500001) / 1000 - dip)
    p = r.groupBy("station_id", (F.col("day") + 1).alias("day")).agg((F.floor(F.sum("rain") * 1000 + 0.500001) / 1000).alias("prior"))
    out = counters.counter_rain(c.join(p, ["station_id", "day"], "left").select("station_id", "t", "total", "prior"), KEYS)
    return out.withColumn("mm", half_up(F.col("mm"), 4))
