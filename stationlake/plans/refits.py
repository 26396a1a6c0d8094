"""Forecast and rain models refitted by period, with what they score on periods they haven't seen."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.heat import shade_wbgt, stull_wet_bulb
from ..functions.rounding import half_up
from ..operators import outlook, rainfit, regression, series
from ..sources.testdata import GRID_SQL
from .forecasts import error_counts
from .registry import query, r4
from .windows import grid

KEYS = ["station_id"]
STEPS = 36
WEEK = 604800
DEFAULTS = {"temp": 20.0, "rh": 60.0, "press": 848.0, "wind": 1.0, "gust": 2.0}
INPUTS = list(regression.INPUTS)
#: Taken off the inputs before they are multiplied.
CENTRE = [{"temp": 20.0, "rh": 60.0, "press": 848.0, "vis": 300.0, "ir": 800.0, "wet_bulb": 15.0, "wbgt": 16.0}.get(c.removesuffix("_1h").removesuffix("_mean"), 0.0) for c in INPUTS]


def full_series(spark, sf_dir):
    """The grid with all channels of the forecast; the test tables have no light, so that follows the clock and the number of readings."""
    g = series.carry(grid(spark, sf_dir), KEYS, DEFAULTS)
    place = F.floor(F.col("slot") / 900) % 96
    g = g.withColumns({"vis": (300 + place).cast("double"), "ir": 400 + 10.0 * place + 5.0 * F.coalesce("n", F.lit(0))})
    g = g.withColumn("wet_bulb", stull_wet_bulb(F.col("temp"), F.col("rh")))
    g = g.withColumn("wbgt", shade_wbgt(F.col("temp"), F.col("wet_bulb")))
    return series.rolling_usual(g, KEYS, "wbgt", least=5)


def origins(spark, sf_dir):
    week = F.floor(F.col("slot") / WEEK)
    return regression.origins(full_series(spark, sf_dir), KEYS, regression.feature_columns(KEYS), "wbgt", "usual", F.col("n").isNotNull(), STEPS, week)


def models(rows):
    return regression.models(regression.period_sums(rows, CENTRE), CENTRE, STEPS)


def _filled(c: str) -> str:
    return f"coalesce(last_value({c} IGNORE NULLS) OVER w, {DEFAULTS[c]}) AS {c}"


_STULL = "temp * atan(0.151977 * sqrt(rh + 8.313659)) + atan(temp + rh) - atan(rh - 1.676331) + 0.00391838 * pow(rh, 1.5) * atan(0.023101 * rh) - 4.686035"
_LAG = {"temp_1h": "lag(temp, 4) OVER w", "rh_1h": "lag(rh, 4) OVER w", "wbgt_1h": "lag(wbgt, 4) OVER w"}
_SQL_INPUTS = [
    *("temp", "rh", "press", "wind", "gust", "vis", "ir", "wet_bulb", "wbgt"),
    *(f"lag({c}, 4) OVER w" for c in ("temp", "rh", "wbgt")),
    *(f"{c} - lag({c}, 4) OVER w" for c in ("temp", "rh", "press", "ir")),
    "avg(temp) OVER h", "coalesce(stddev_samp(temp) OVER h, 0)", "avg(wbgt) OVER h", "coalesce(stddev_samp(wbgt) OVER h, 0)", "avg(rh) OVER h",
    *(f"{f}(2 * pi() * ((slot + 10800) % 86400) / 86400.0)" for f in ("sin", "cos")),
    *(f"{f}(2 * pi() * dayofyear(make_timestamp(slot * 1000000)) / 365.25)" for f in ("sin", "cos")),
]
_K = len(INPUTS)
#: Models of all periods: products by period of the target, sums over the periods before, and Gauss-Jordan steps on each system.
MODEL_SQL = f"""WITH RECURSIVE {GRID_SQL},
    carried AS (SELECT station_id, slot, n, {', '.join(map(_filled, DEFAULTS))}, 300 + slot // 900 % 96 AS vis, 400 + 10.0::DOUBLE * (slot // 900 % 96) + 5 * coalesce(n, 0) AS ir
        FROM dense WINDOW w AS (PARTITION BY station_id ORDER BY slot)),
    wet AS (SELECT *, {_STULL} AS wet_bulb FROM carried),
    full_rows AS (SELECT *, 0.7 * wet_bulb + 0.3 * temp AS wbgt FROM wet),
    feat AS (SELECT station_id, slot, n, slot // {WEEK} AS week, wbgt AS v0,
            CASE WHEN count(wbgt) OVER b >= 5 THEN avg(wbgt) OVER b END AS u, [{', '.join(f'({c})::DOUBLE' for c in _SQL_INPUTS)}] AS x, count(n) OVER (w ROWS 4 PRECEDING) = 5 AS usable
        FROM full_rows WINDOW w AS (PARTITION BY station_id ORDER BY slot), h AS (PARTITION BY station_id ORDER BY slot ROWS 3 PRECEDING),
            b AS (PARTITION BY station_id, slot % 86400 ORDER BY slot RANGE BETWEEN 2592000 PRECEDING AND 86400 PRECEDING)),
    far AS (SELECT o.station_id, o.slot, o.week, step, t.week AS target_week, o.x, o.v0, o.u AS u0, t.v0 AS y, t.u AS u1
        FROM feat o CROSS JOIN (SELECT unnest(range(1, {STEPS + 1})) AS step) JOIN feat t ON t.station_id = o.station_id AND t.slot = o.slot + step * 900 WHERE o.usable AND t.n IS NOT NULL),
    weeks AS (SELECT week FROM feat WHERE usable UNION SELECT max(week) + 1 FROM feat WHERE usable),
    scale AS (SELECT weeks.week, j, avg(x[j]) AS mu, CASE WHEN stddev_pop(x[j]) < 1e-9 THEN 1 ELSE stddev_pop(x[j]) END AS sd FROM weeks JOIN feat ON feat.usable AND feat.week < weeks.week, (SELECT unnest(range(1, {_K + 1})) AS j) GROUP BY 1, 2),
    vec AS (SELECT 'ridge' AS kind, step, target_week, list_concat([1.0::DOUBLE], x, [y]) AS v FROM far
        UNION ALL SELECT 'ridge_seasonal', step, target_week, list_concat([1.0::DOUBLE], x, [u0, u1, v0 - u0, y]) FROM far WHERE u0 IS NOT NULL AND u1 IS NOT NULL),
    products AS (SELECT kind, step, target_week, i, j, sum(v[i] * v[j]) AS s FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM vec), (SELECT unnest(range(1, {_K + 6})) AS j) WHERE j <= len(v) GROUP BY ALL),
    upto AS (SELECT weeks.week, kind, step, i, j, sum(s) AS s FROM weeks JOIN products ON target_week < weeks.week GROUP BY ALL),
    width(kind, w) AS (VALUES ('ridge', {_K + 2}), ('ridge_seasonal', {_K + 5})),
    one AS (SELECT week, kind, step, j, s FROM upto WHERE i = 1),
    inputs AS (SELECT o.week, o.kind, o.step, o.j, o.s, coalesce(mu, o.s / c.s) AS mu, coalesce(sd, sqrt(d.s / c.s - pow(o.s / c.s, 2))) AS sd
        FROM one o JOIN one c ON c.week = o.week AND c.kind = o.kind AND c.step = o.step AND c.j = 1 JOIN width ON width.kind = o.kind JOIN upto d ON d.week = o.week AND d.kind = o.kind AND d.step = o.step AND d.i = o.j AND d.j = o.j
        LEFT JOIN scale ON scale.week = o.week AND scale.j = o.j - 1 AND o.j <= {_K + 1} WHERE o.j > 1 AND o.j < w),
    system AS (
        SELECT u.week, u.kind, u.step, c.s AS n, t.s / c.s AS level, a.j AS row, list((u.s - a.mu * b.s - b.mu * a.s + c.s * a.mu * b.mu) / (a.sd * b.sd) + (a.j = b.j)::INTEGER ORDER BY b.j) || [any_value((r.s - t.s / c.s * a.s) / a.sd)] AS line
        FROM upto u JOIN width ON width.kind = u.kind JOIN inputs a ON a.week = u.week AND a.kind = u.kind AND a.step = u.step AND a.j = u.i JOIN inputs b ON b.week = u.week AND b.kind = u.kind AND b.step = u.step AND b.j = u.j
        JOIN one c ON c.week = u.week AND c.kind = u.kind AND c.step = u.step AND c.j = 1 JOIN one t ON t.week = u.week AND t.kind = u.kind AND t.step = u.step AND t.j = w
        JOIN upto r ON r.week = u.week AND r.kind = u.kind AND r.step = u.step AND r.i = a.j AND r.j = w GROUP BY ALL),
    jordan AS (
        SELECT week, kind, step, n, level, 1::BIGINT AS k, list(line ORDER BY row) AS m FROM system GROUP BY ALL
        UNION ALL
        SELECT week, kind, step, n, level, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / r[k]) ELSE list_transform(r, lambda v, c: v - r[k] * m[k][c] / m[k][k]) END) FROM jordan WHERE k <= len(m)),
    solved AS (SELECT week, kind, step, n::BIGINT AS n, level, list_transform(m, lambda r: r[len(m) + 1]) AS coef FROM jordan WHERE k = len(m) + 1),
    scales AS (SELECT week, kind, step, list(mu ORDER BY j) AS mus, list(sd ORDER BY j) AS sds FROM inputs GROUP BY 1, 2, 3),
    left_over AS (SELECT weeks.week, step, count(*) AS n, sum((v0 - u0) * (y - u1)) / sum((v0 - u0) * (v0 - u0)) AS a FROM weeks JOIN far ON target_week < weeks.week WHERE u0 IS NOT NULL AND u1 IS NOT NULL GROUP BY 1, 2),
    said AS (
        SELECT far.week, far.step, far.station_id, far.slot, y, solved.kind, n AS n_train, level + list_sum(list_transform(CASE WHEN solved.kind = 'ridge' THEN x ELSE list_concat(x, [u0, u1, v0 - u0]) END, lambda v, i: coef[i] * (v - mus[i]) / sds[i])) AS value
        FROM far JOIN solved ON solved.week = far.week AND solved.step = far.step JOIN scales ON scales.week = far.week AND scales.step = far.step AND scales.kind = solved.kind WHERE solved.kind = 'ridge' OR (u0 IS NOT NULL AND u1 IS NOT NULL)
        UNION ALL SELECT far.week, far.step, station_id, slot, y, 'seasonal', n, u1 + a * (v0 - u0) FROM far JOIN left_over USING (week, step) WHERE u0 IS NOT NULL AND u1 IS NOT NULL
        UNION ALL SELECT far.week, far.step, station_id, slot, y, 'no_change', 0, v0 FROM far JOIN (SELECT DISTINCT week, step FROM solved) USING (week, step))"""


@query(f"""{MODEL_SQL} SELECT kind, step, week, max(n_train) AS n_train, count(*) AS n, {r4('avg(abs(value - y))')} AS mae, {r4('sqrt(avg((value - y) * (value - y)))')} AS rmse FROM said GROUP BY 1, 2, 3""")
def ridge_rolling(spark, sf_dir):
    """M2, M3, M6, M7: four kinds of model at 36 steps, each week forecast by models of the weeks before, ridge regression of 25 inputs and of 28 among them."""
    rows = origins(spark, sf_dir)
    found = regression.predicted(rows, models(rows), ["period"])
    e = F.col("value") - F.col("y")
    return found.groupBy("kind", "step", F.col("period").alias("week")).agg(
        F.max("n_train").alias("n_train"), F.count(F.lit(1)).alias("n"), half_up(F.avg(F.abs(e)), 4).alias("mae"), half_up(F.sqrt(F.avg(e * e)), 4).alias("rmse")
    )


@query(f"""{MODEL_SQL}, names AS (SELECT unnest({INPUTS + list(regression.SEASONAL)!r}) AS input, unnest(range(1, {_K + 4})) AS j)
    SELECT solved.kind, solved.step, solved.week, input, {r4('level')} AS level, {r4('coef[j]')} AS coef, {r4('mus[j]')} AS mean, {r4('sds[j]')} AS std
    FROM solved JOIN scales ON scales.week = solved.week AND scales.step = solved.step AND scales.kind = solved.kind JOIN names ON j <= len(coef)""")
def ridge_coefficients(spark, sf_dir):
    """M2, M3: the coefficients behind ``ridge_rolling`` on standardised inputs, with the scale of each; the last week's are for the week to come."""
    rows = origins(spark, sf_dir)
    names = F.array(*map(F.lit, INPUTS + list(regression.SEASONAL)))
    fitted = models(rows).filter("kind <> 'seasonal'")
    each = F.inline(F.transform("coef", lambda c, i: F.struct(F.element_at(names, i + 1).alias("input"), c.alias("coef"), F.col("mean")[i].alias("mean"), F.col("std")[i].alias("std"))))
    figures = [half_up(F.col(c), 4).alias(c) for c in ("level", "coef", "mean", "std")]
    return fitted.select("kind", "step", F.col("period").alias("week"), F.col("intercept").alias("level"), each).select("kind", "step", "week", "input", *figures)


KINDS = ("no_change", "seasonal", "ridge", "ridge_seasonal")
AHEAD = (4, 12, 24, 36)


def production_models(rows, fitted):
    """A row a kind and step: the model of all weeks, and the bands that hold four fifths of the errors which models of earlier weeks made."""
    near = rows.withColumn("ahead", F.filter("ahead", lambda a: a["step"].isin(*AHEAD)))
    errors = regression.predicted(near, fitted.filter(F.col("step").isin(*AHEAD)), []).withColumn("e", F.col("value") - F.col("y"))
    bands = error_counts(errors, "kind", "step").groupBy("kind", "step").agg(F.percentile("size", F.lit(0.8), F.col("n")).alias("band"))
    still = bands.filter("kind = 'no_change'").select("step", F.col("band").alias("persistence"))
    last = rows.agg((F.max("period") + 1).alias("period"))
    final = fitted.join(F.broadcast(last), "period").select("kind", "step", F.col("coef")[0].alias("a"), "intercept", "coef", "mean", "std")
    place = F.array_position(F.array(*map(F.lit, AHEAD)), F.col("step")).cast("int") - 1
    return bands.join(still, "step").join(final, ["kind", "step"], "left").withColumn("place", place)


@query(f"""{MODEL_SQL}, errors AS (SELECT kind, step, quantile_cont(floor(abs(value - y) * 100 + 0.5) / 100, 0.8) AS band FROM said WHERE step IN {AHEAD} GROUP BY 1, 2),
    final AS (SELECT * FROM solved JOIN scales USING (week, kind, step) WHERE week = (SELECT max(week) FROM weeks)), rest AS (SELECT * FROM left_over WHERE week = (SELECT max(week) FROM weeks)),
    asked AS (SELECT *, {', '.join(f'lead(u, {s}) OVER w AS u_{s}' for s in AHEAD)} FROM feat WINDOW w AS (PARTITION BY station_id ORDER BY slot)),
    row AS (SELECT station_id, slot, x, v0, u AS u0, unnest([{', '.join(f"{{'step': {s}, 'u1': u_{s}}}" for s in AHEAD)}]) AS t FROM asked WHERE slot % 7200 = 0),
    both_ AS (SELECT row.*, e.kind, e.step, e.band, p.band AS persistence, a, level, coef, mus, sds, CASE e.kind WHEN 'ridge' THEN x ELSE list_concat(x, [u0, t.u1, v0 - u0]) END AS z
        FROM row JOIN errors e ON e.step = t.step JOIN errors p ON p.step = e.step AND p.kind = 'no_change' LEFT JOIN final ON final.kind = e.kind AND final.step = e.step LEFT JOIN rest ON rest.step = e.step),
    v AS (SELECT *, CASE WHEN kind = 'seasonal' THEN t.u1 + a * (v0 - u0) WHEN kind <> 'no_change' AND len(list_filter(z, lambda q: q IS NULL)) = 0 THEN level + list_sum(list_transform(z, lambda q, i: coef[i] * (q - mus[i]) / sds[i])) END AS said_value FROM both_)
    SELECT station_id, slot, kind, step, said_value IS NOT NULL AS ran, {r4('coalesce(said_value, v0)')} AS value, {r4('CASE WHEN said_value IS NULL THEN persistence ELSE band END')} AS width FROM v""")
def forecast_kinds(spark, sf_dir):
    """The four kinds of model, as fitted, side by side; one whose inputs are missing tells no change, with the band of that."""
    rows = origins(spark, sf_dir)
    w = series.over(KEYS)
    g = full_series(spark, sf_dir)
    usual = F.array(*(F.lead("usual", s).over(w) for s in AHEAD))
    inputs = {f"x_{c}": e for c, e in regression.feature_columns(KEYS).items()}
    asked = g.select("station_id", "slot", F.col("wbgt").alias("x0"), F.col("usual").alias("u0"), usual.alias("u1_by_step"), *(e.alias(c) for c, e in inputs.items()))
    found = outlook.predict(asked.filter("slot % 7200 = 0"), production_models(rows, models(rows)), list(inputs))
    return found.select("station_id", "slot", "kind", "step", "ran", half_up(F.col("value"), 4).alias("value"), half_up(F.col("width"), 4).alias("width"))


WET = 1.5
LEAST_KNOWN = 12


def rain_samples(spark, sf_dir):
    """Origins of the rain model: five slots read in a row, and half of the slots around known. Test series have rain in few slots, so more than a tip has to fall."""
    g = series.carry(grid(spark, sf_dir), KEYS, {c: DEFAULTS[c] for c in ("temp", "rh", "press")}).withColumn("rain", F.coalesce("rain", F.lit(0.0)))
    read = F.col("n").isNotNull()
    usable = F.count("n").over(series.over(KEYS).rowsBetween(-4, 0)) == 5
    return rainfit.samples(g, KEYS, usable, read, LEAST_KNOWN, WET, lambda t: F.floor(t / WEEK))


_RAIN_INPUTS = [
    "rh", "rh - lag(rh, 4) OVER w", "press - lag(press, 4) OVER w", "press - lag(press, 12) OVER w", "temp - lag(temp, 4) OVER w", "temp - lag(temp, 12) OVER w",
    *(f"{f}(2 * pi() * ((slot + 10800) % 86400) / 86400.0)" for f in ("sin", "cos")),
    *(f"{f}(2 * pi() * dayofyear(make_timestamp(slot * 1000000)) / 365.25)" for f in ("sin", "cos")),
    *(f"ln(1 + sum(rain) OVER (w ROWS {n - 1} PRECEDING))" for n in (4, 12)),
]
_PICK = {"weather": "list_concat(x[1:8], x[11:12])", "weather_and_season": "x"}
#: Newton's steps on every candidate and week; a step's system is solved by eliminating one column after the other.
RAIN_SQL = f"""WITH RECURSIVE {GRID_SQL},
    carried AS (SELECT station_id, slot, n, coalesce(rain, 0) AS rain, {', '.join(_filled(c) for c in ('temp', 'rh', 'press'))} FROM dense WINDOW w AS (PARTITION BY station_id ORDER BY slot)),
    asked AS (SELECT station_id, slot, slot // {WEEK} AS week, (slot + 10800) // {WEEK} AS ends, rain, [{', '.join(f'({c})::DOUBLE' for c in _RAIN_INPUTS)}] AS x, count(n) OVER (w ROWS 4 PRECEDING) = 5 AS usable,
            count(n) OVER (w ROWS BETWEEN 11 PRECEDING AND 12 FOLLOWING) AS known, sum(rain) OVER f AS ahead, count(*) OVER f AS coming, count(*) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS gone
        FROM carried WINDOW w AS (PARTITION BY station_id ORDER BY slot), f AS (PARTITION BY station_id ORDER BY slot ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING)),
    s AS (SELECT *, (ahead >= {WET})::INTEGER AS y FROM asked WHERE usable AND known >= {LEAST_KNOWN} AND coming = 12 AND gone = 12),
    weeks AS (SELECT week FROM s UNION SELECT max(week) + 1 FROM s),
    picked AS (SELECT 'weather' AS candidate, ends, {_PICK['weather']} AS x, y FROM s UNION ALL SELECT 'weather_and_season', ends, {_PICK['weather_and_season']}, y FROM s),
    train AS (SELECT week, candidate, x, y, row_number() OVER () AS r FROM weeks JOIN picked ON ends < week),
    rates AS (SELECT week, candidate, count(*) AS n, avg(y) AS rate FROM train GROUP BY 1, 2 HAVING sum(y) BETWEEN 1 AND count(*) - 1),
    scale AS (SELECT week, candidate, list(mu ORDER BY j) AS mu, list(sd ORDER BY j) AS sd FROM (
        SELECT week, candidate, j, avg(v) AS mu, CASE WHEN stddev_pop(v) < 1e-9 THEN 1 ELSE stddev_pop(v) END AS sd FROM (SELECT week, candidate, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS j FROM train) GROUP BY 1, 2, 3) GROUP BY 1, 2),
    design AS (SELECT week, candidate, list_concat([1.0::DOUBLE], list_transform(x, lambda v, i: (v - mu[i]) / sd[i])) AS z, y FROM train JOIN scale USING (week, candidate) JOIN rates USING (week, candidate)),
    newton AS (
        SELECT week, candidate, 0 AS it, list_transform(range(len(any_value(z))), lambda i: 0.0::DOUBLE) AS w FROM design GROUP BY 1, 2
        UNION ALL
        SELECT week, candidate, it + 1, list_transform(w, lambda v, i: v + solved[i][len(w) + 1]) FROM (
            SELECT week, candidate, it, w, list_reduce(list_prepend(m, list_transform(m, lambda q: m)), lambda a, b, k: list_transform(a, lambda r, i: CASE WHEN i = k - 1 THEN list_transform(r, lambda v: v / a[k - 1][k - 1]) ELSE list_transform(r, lambda v, c: v - r[k - 1] * a[k - 1][c] / a[k - 1][k - 1]) END)) AS solved FROM (
                SELECT week, candidate, it, any_value(w) AS w, list(list_concat(line, [g - CASE WHEN i > 1 THEN w[i] ELSE 0 END]) ORDER BY i) AS m FROM (
                    SELECT week, candidate, it, i, any_value(w) AS w, list(h ORDER BY j) AS line, any_value(g) AS g FROM (
                        SELECT week, candidate, it, i, j, any_value(w) AS w, sum(p * (1 - p) * z[i] * z[j]) + CASE WHEN i = j AND i > 1 THEN 1 ELSE 0 END AS h, sum((y - p) * z[i]) AS g FROM (
                            SELECT d.week, d.candidate, it, w, z, y, 1 / (1 + exp(-list_dot_product(z, w))) AS p, unnest(range(1, len(z) + 1)) AS i FROM newton n JOIN design d ON d.week = n.week AND d.candidate = n.candidate WHERE it < 12),
                        (SELECT unnest(range(1, 14)) AS j) WHERE j <= len(z) GROUP BY week, candidate, it, i, j)
                    GROUP BY week, candidate, it, i)
                GROUP BY week, candidate, it))),
    fitted AS (SELECT week, candidate, n, rate, mu, sd, w FROM newton JOIN scale USING (week, candidate) JOIN rates USING (week, candidate) WHERE it = 12),
    said AS (SELECT s.week, s.station_id, s.slot, candidate, s.y, rate, 1 / (1 + exp(-(w[1] + list_sum(list_transform(CASE candidate WHEN 'weather' THEN {_PICK['weather']} ELSE x END, lambda v, i: (v - mu[i]) / sd[i] * w[i + 1]))))) AS p FROM s JOIN fitted USING (week)),
    judged AS (SELECT s.week, s.slot, y, CASE WHEN rain > 0 THEN 0.85::DOUBLE ELSE least(0.92::DOUBLE, 0.05::DOUBLE + CASE WHEN x[3] < -0.5 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN x[3] < -1.2 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN x[1] > 80 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN x[1] > 90 THEN 0.1::DOUBLE ELSE 0 END) END AS old,
        avg(y) OVER (PARTITION BY s.week) AS own, rate FROM s JOIN (SELECT DISTINCT week, rate FROM fitted) USING (week))"""


def _rain(spark, sf_dir):
    rows = rain_samples(spark, sf_dir)
    return rows, rainfit.fit_by_period(rows)


@query(f"""{RAIN_SQL} SELECT candidate, week, n, {r4('rate')} AS rate, j::INTEGER AS place, {r4('w[j + 1]')} AS coef FROM fitted, (SELECT unnest(range(0, 13)) AS j) WHERE j < len(w)""")
def rain_models(spark, sf_dir):
    """M4: logistic regressions of both sets of inputs for each week, on all weeks before it; place 0 is the intercept."""
    _, fitted = _rain(spark, sf_dir)
    each = F.posexplode(F.concat(F.array("intercept"), "coef")).alias("place", "coef")
    return fitted.select("candidate", F.col("period").alias("week"), "n", half_up(F.col("rate"), 4).alias("rate"), each).withColumn("coef", half_up(F.col("coef"), 4))


_SQ = "avg(pow({p} - y, 2))"


@query(f"""{RAIN_SQL}, models AS (SELECT week, candidate AS model, p, y FROM said UNION ALL SELECT week, unnest(['old_rule', 'own_rate', 'base_rate']), unnest([old, own, rate]), y FROM judged)
    SELECT model, week, count(*) AS n, {r4(_SQ.format(p='p'))} AS brier, {r4('1 - ' + _SQ.format(p='p') + ' / nullif(any_value(ref), 0)')} AS skill, count(*) FILTER (p >= 0.5 AND y = 1) AS hits, count(*) FILTER (p >= 0.5 AND y = 0) AS false_alarms
    FROM models JOIN (SELECT week, {_SQ.format(p='own')} AS ref FROM judged GROUP BY 1) USING (week) GROUP BY 1, 2""")
def rain_refit_scores(spark, sf_dir):
    """M8: each week forecast by models of the weeks before, by the old rule, by its own frequency and by that of the weeks before: Brier score, skill over the week's own
    frequency, and what a threshold of one half gives."""
    rows, fitted = _rain(spark, sf_dir)
    found = rain_forecasts(rows, fitted)
    error = F.avg(F.pow(F.col("p") - F.col("y"), 2))
    by = found.groupBy("model", "week").agg(
        F.count(F.lit(1)).alias("n"), error.alias("b"), F.count_if((F.col("p") >= 0.5) & (F.col("y") == 1)).alias("hits"), F.count_if((F.col("p") >= 0.5) & (F.col("y") == 0)).alias("false_alarms")
    )
    ref = by.filter("model = 'own_rate'").select("week", F.col("b").alias("ref"))
    skill = 1 - F.col("b") / F.nullif(F.col("ref"), F.lit(0.0))
    return by.join(ref, "week").select("model", "week", "n", half_up(F.col("b"), 4).alias("brier"), half_up(skill, 4).alias("skill"), "hits", "false_alarms")


def rain_forecasts(rows, fitted):
    """(model, week, p, y) of both candidates and of what they have to beat."""
    own = Window.partitionBy("period")
    known = fitted.groupBy("period").agg(F.first("rate").alias("rate"))
    judged = rows.withColumns({"own": F.avg("y").over(own), "old": rainfit.old_rule()}).join(known, "period")
    others = F.inline(F.array(*(F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("p")) for m, c in (("old_rule", "old"), ("own_rate", "own"), ("base_rate", "rate")))))
    models_ = rainfit.chances(rows, fitted, ["period", "y"]).select(F.col("candidate").alias("model"), F.col("period").alias("week"), "p", "y")
    return models_.unionByName(judged.select(F.col("period").alias("week"), "y", others))


@query(f"""{RAIN_SQL}, b AS (SELECT candidate, {_SQ.format(p='p')} AS brier FROM said GROUP BY 1), r AS (SELECT *, floor(brier * 100000 + 0.5) / 100000 AS rounded FROM b),
    c AS (SELECT candidate, brier FROM r WHERE rounded <= (SELECT min(rounded) FROM r) + 0.0001 ORDER BY candidate LIMIT 1), o AS (SELECT {_SQ.format(p='own')} AS own, {_SQ.format(p='rate')} AS base, {_SQ.format(p='old')} AS old FROM judged)
    SELECT candidate AS chosen, CASE WHEN brier < own THEN 'logistic' ELSE 'climatology' END AS kind, {r4('brier')} AS brier, {r4('own')} AS brier_own_rate, {r4('base')} AS brier_base_rate, {r4('old')} AS brier_old_rule, {r4('1 - brier / own')} AS skill_own, {r4('1 - brier / base')} AS skill_base FROM c, o""")
def rain_model_choice(spark, sf_dir):
    """M7, M8: the candidate of the lowest pooled Brier score, the simpler of two that are near, and whether it beats each week's own frequency."""
    rows, fitted = _rain(spark, sf_dir)
    pooled = rain_forecasts(rows, fitted).groupBy("model").agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))
    chosen = rainfit.choose(pooled.filter(F.col("model").isin(*rainfit.CANDIDATES)).withColumnRenamed("model", "candidate"), list(rainfit.CANDIDATES))
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("brier")))
    others = pooled.agg(of("own_rate").alias("own"), of("base_rate").alias("base"), of("old_rule").alias("old"))
    b = F.col("chosen_brier")
    figures = {"brier": b, "brier_own_rate": F.col("own"), "brier_base_rate": F.col("base"), "brier_old_rule": F.col("old"), "skill_own": 1 - b / F.col("own"), "skill_base": 1 - b / F.col("base")}
    kind = F.when(b < F.col("own"), "logistic").otherwise("climatology").alias("kind")
    return chosen.filter("chosen is not null").crossJoin(F.broadcast(others)).select("chosen", kind, *(half_up(c, 4).alias(n) for n, c in figures.items()))
