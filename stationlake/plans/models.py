"""Model fits, the outdoor heat model, and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import liljegren, statements, text
from ..functions.heat import risk_band
from ..functions.rounding import half_up
from ..operators import fitting
from ..sources.testdata import GRID_SQL, table
from .expressions import air
from .forecasts import BASE_SQL, pairs
from .registry import query, r4
from .windows import grid


@query(f"""WITH {BASE_SQL}, r AS (SELECT x0, u0, x1 AS y FROM known WHERE step = 4), m AS (SELECT avg(x0) AS m1, stddev_pop(x0) AS s1, avg(u0) AS m2, stddev_pop(u0) AS s2, avg(y) AS my FROM r),
    z AS (SELECT (x0 - m1) / s1 AS a, (u0 - m2) / s2 AS b, y - my AS y, my FROM r, m), g AS (SELECT sum(a * a) + 1 AS aa, sum(a * b) AS ab, sum(b * b) + 1 AS bb, sum(a * y) AS ay, sum(b * y) AS cy, any_value(my) AS my FROM z)
    SELECT {r4('my')} AS intercept, {r4('(ay * bb - cy * ab) / (aa * bb - ab * ab)')} AS anomaly, {r4('(cy * aa - ay * ab) / (aa * bb - ab * ab)')} AS usual FROM g""")
def ridge_fit(spark, sf_dir):
    """M2, M3: ridge regression on two scaled inputs; SQL solves the same system by Cramer's rule."""
    rows = pairs(spark, sf_dir).filter("step = 4").select("x0", "u0", F.col("x1").alias("y"))
    rows = fitting.scaled(rows, fitting.scaling(rows, ["x0", "u0"]))
    intercept, (a, b) = fitting.ridge(rows, ["x0", "u0"], "y")
    return spark.createDataFrame([(intercept, a, b)], "intercept double, anomaly double, usual double").select(
        *(half_up(F.col(c), 4).alias(c) for c in ("intercept", "anomaly", "usual"))
    )


def rain_rows(spark, sf_dir):
    g = grid(spark, sf_dir).filter("rh is not null")
    rows = g.select("rh", F.cos(F.col("slot") % 86400 / 86400 * 6.283185307179586).alias("clock"), (F.coalesce("rain", F.lit(0.0)) > 0.1).cast("int").alias("wet"))
    return fitting.scaled(rows, fitting.scaling(rows, ["rh", "clock"]))


@query()
def logistic_rain(spark, sf_dir):
    """M4: the chance of rain by logistic regression; tests hold it against Newton's method."""
    intercept, (rh, clock) = fitting.logistic(rain_rows(spark, sf_dir), ["rh", "clock"], "wet")
    return spark.createDataFrame([(intercept, rh, clock)], "intercept double, rh double, clock double")


@query()
def kmeans_states(spark, sf_dir):
    """M5: four states of temperature and humidity, the best of three runs; tests hold it against plain Lloyd steps."""
    rows = air(spark, sf_dir).select("temp", "rh").dropna()
    centres = fitting.clusters(rows, ["temp", "rh"])
    return spark.createDataFrame([(k, *c) for k, c in enumerate(centres)], "state int, temp double, rh double")


@query()
def outdoor_wbgt(spark, sf_dir):
    """F8, A10: outdoor WBGT by energy balance; tests hold it against published figures."""
    rows = air(spark, sf_dir)
    cosine = F.sin(F.col("event_id") / 100)
    light = F.greatest(F.lit(0.0), cosine * 900)
    found = liljegren.wbgt_outdoor("temp", "rh", F.lit(852.0), (F.col("event_id") % 6).cast("double"), light, F.when(cosine > 0, 0.6).otherwise(0.0), cosine)
    return rows.withColumn("w", found).select("event_id", "w.*")


INTENT_SQL = "CASE WHEN text IS NULL THEN 'overview' " + " ".join(f"WHEN regexp_matches(text, '{p}', 'i') THEN '{n}'" for n, p in text.INTENTS) + " ELSE 'overview' END"


@query(f"SELECT conv_id, turn, {INTENT_SQL} AS intent, coalesce(regexp_matches(text, '{text.MEDICAL}', 'i'), false) AS medical FROM conversations")
def text_intent(spark, sf_dir):
    """What each turn asks for, by the first pattern found, and whether it speaks of medical matters."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", text.intent(F.col("text")).alias("intent"), text.is_medical(F.col("text")).alias("medical"))


@query("""WITH n AS (SELECT doc_id, regexp_extract_all(regexp_replace(coalesce(text, ''), '\\b\\d{1,2}:\\d{2}\\b', ' ', 'g'), '(\\d+(?:\\.\\d+)?)', 1) AS found FROM documents)
    SELECT doc_id, len(found)::INTEGER AS n, array_to_string(found, ' ') AS numbers,
        len(list_filter(found, lambda x: len(list_filter([12.34::double, -7.0::double, 2024.0::double], lambda f: abs(x::double - abs(f)) <= 0.5 * pow(10.0::double, -len(regexp_extract(x, '\\.(\\d+)', 1))) + 1e-9)) > 0))::INTEGER AS grounded FROM n""")
def number_extraction(spark, sf_dir):
    """The figures that each text states, and how many of them some fact bears out."""
    facts = F.array(F.lit(12.34), F.lit(-7.0), F.lit(2024.0))
    found = table(spark, sf_dir, "documents").select("doc_id", text.numbers(F.col("text")).alias("found"))
    good = F.filter("found", lambda x: text.grounded(x, facts))
    return found.select("doc_id", F.size("found").alias("n"), F.array_join("found", " ").alias("numbers"), F.size(good).alias("grounded"))


BAND_SQL = "CASE WHEN temp >= 24 THEN 'VERY_HIGH' WHEN temp >= 21 THEN 'HIGH' WHEN temp >= 18 THEN 'ELEVATED' ELSE 'LOW' END"


@query(f"""WITH {GRID_SQL} SELECT station_id, slot, CASE slot // 900 % 5 WHEN 1 THEN 'number' WHEN 2 THEN 'time' WHEN 3 THEN CASE WHEN {BAND_SQL} = 'LOW' THEN NULL ELSE 'band' END END AS objection
    FROM grid WHERE temp IS NOT NULL AND rh IS NOT NULL""")
def statement_check(spark, sf_dir):
    """Sentences on slots, of which some misstate the temperature, the time or the band, held against the readings."""
    rows = grid(spark, sf_dir).filter("temp is not null and rh is not null").withColumn("k", F.floor(F.col("slot") / 900) % 5)
    at = F.col("slot") + F.when(F.col("k") == 2, 3600).otherwise(0)
    clock = F.when(F.col("k") == 4, F.date_format(F.timestamp_seconds(at), "h:mm a")).otherwise(F.date_format(F.timestamp_seconds(at), "HH:mm"))
    temp = F.format_string("%.1f", half_up(F.col("temp"), 1) + F.when(F.col("k") == 1, 2.0).otherwise(0.0))
    band = risk_band(F.col("temp"))
    claimed = F.when(F.col("k") == 3, F.lit("low")).otherwise(F.replace(band, F.lit("_"), F.lit(" ")))
    sentence = F.concat(F.lit("At "), clock, F.lit(" it was "), temp, F.lit("°C with "), F.format_string("%.0f", half_up(F.col("rh"), 0)), F.lit("% humidity; the heat risk is "), claimed)
    none = F.array().cast("array<double>")
    minute = (F.col("slot") % 86400 / 60).cast("int")
    why = statements.objection(sentence, F.array("temp"), F.array("rh"), none, none, F.array(minute), F.array(band), F.lit("GOOD"))
    return rows.select("station_id", "slot", why.alias("objection"))
