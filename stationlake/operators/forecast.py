"""Seasonal-anomaly forecasts, their error bands and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import half_up
from .series import over


def pairs(series: DataFrame, keys: list[str], steps: list[int], value: str = "temp", usual: str = "usual", time: str = "slot") -> DataFrame:
    """For each origin and step: value and usual at both ends (x0, u0, x1, u1) where all are known. The usual of a later slot is
    that slot's own, so a lead finds it, and nothing grows with the number of days behind it."""
    w = over(keys, time)
    each = F.array(*(F.struct(F.lit(s).alias("step"), F.lead(value, s).over(w).alias("x1"), F.lead(usual, s).over(w).alias("u1")) for s in steps))
    rows = series.withColumn("_each", each).select(*keys, time, F.col(value).alias("x0"), F.col(usual).alias("u0"), F.inline("_each"))
    return rows.dropna(subset=["x0", "u0", "x1", "u1"])


def slope() -> Column:
    """No-intercept slope of the later anomaly on the present one."""
    x, y = F.col("x0") - F.col("u0"), F.col("x1") - F.col("u1")
    return F.sum(x * y) / F.sum(x * x)


def seasonal(a: Column) -> Column:
    """Usual value at the target plus what is left of today's anomaly."""
    return F.col("u1") + a * (F.col("x0") - F.col("u0"))


def seasonal_terms(a: Column) -> dict[str, Column]:
    """What moves a seasonal forecast away from the present value: the usual change by the target's time of day, and how much of
    today's departure goes."""
    return {"usual_daily_change": F.col("u1") - F.col("u0"), "departure_from_usual": (a - 1) * (F.col("x0") - F.col("u0"))}


def largest_terms(parts: DataFrame, keys: list[str], most: int = 4) -> DataFrame:
    """Of rows (keys, part, effect) the ``most`` of largest effect, with their ``place``."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.abs("effect")), "part"))
    return parts.withColumn("place", place.cast("long")).filter(F.col("place") <= most)


def rolling_origin(rows: DataFrame, period: str, steps: str = "step") -> DataFrame:
    """Adds ``a``, the slope over all earlier periods: sums by period, then sums over the periods before, so that history
    isn't read again for each period."""
    from pyspark.sql import Window

    x, y = F.col("x0") - F.col("u0"), F.col("x1") - F.col("u1")
    sums = rows.groupBy(steps, period).agg(F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"))
    before = Window.partitionBy(steps).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    fits = sums.select(steps, period, (F.sum("xy").over(before) / F.sum("xx").over(before)).alias("a")).filter("a is not null")
    return rows.join(F.broadcast(fits), [steps, period])


def tallies(error: Column, band: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        half_up(F.avg(F.abs(error)), 4).alias("mae"),
        half_up(F.sqrt(F.avg(error * error)), 4).alias("rmse"),
        half_up(F.avg((F.abs(error) <= band).cast("double")), 4).alias("coverage"),
    ]


def percentile(rows: DataFrame, keys: list[str], value: Column, share: float, name: str, width: float = 0.01) -> DataFrame:
    """(keys, name): the exact percentile of ``value``, interpolated between neighbours. Counts by bins of ``width`` tell in which bins the two neighbours
    lie; the values of these alone are ranked, each once, so that no task holds the values of a key."""
    from pyspark.sql import Window

    v = F.col("_v")
    sized = rows.select(*keys, value.alias("_v")).filter(v.isNotNull()).withColumn("_bin", F.when(F.isnan(v), 2**63 - 1).otherwise(F.floor(v / width)))
    every = Window.partitionBy(*keys)
    upto = lambda n, *by: F.sum(n).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, 0))
    bins = sized.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n")).withColumns({"_upto": upto("_n", *keys, "_bin"), "_at": share * (F.sum("_n").over(every) - 1)})
    low, high = F.floor("_at"), F.ceil("_at")
    holds = lambda rank: (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))
    near = bins.filter(holds(low) | holds(high)).select(*keys, "_bin", (F.col("_upto") - F.col("_n")).alias("_before"), "_at")
    each = sized.join(F.broadcast(near), [*keys, "_bin"]).groupBy(*keys, "_bin", "_v", "_before", "_at").agg(F.count(F.lit(1)).alias("_n"))  # two bins a key at most
    ranked = each.withColumn("_upto", F.col("_before") + upto("_n", *keys, "_bin", "_v"))
    found = ranked.groupBy(*keys, "_at").agg(F.max(F.when(holds(low), v)).alias("_low"), F.max(F.when(holds(high), v)).alias("_high"))
    return found.select(*keys, (F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - low)).alias(name))


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def skill(score: Column, reference: Column, digits: int = 4) -> Column:
    """How much lower a score is than the reference's, as a share of that. A reference without error leaves nothing to share: minus infinity, or NaN
    where the score has no error either, as division of doubles gives."""
    of = half_up(1 - F.try_divide(score, reference), digits)
    return F.when(reference > 0, of).when(score > 0, float("-inf")).when(reference.isNotNull(), float("nan"))


def select_simplest(scores: DataFrame, order: list[str], within: float = 0.005) -> DataFrame:
    """The first model in ``order`` that is within ``within`` of the best at every horizon, else the one of lowest total."""
    best = scores.groupBy("step").agg(F.min("mae").alias("best"))
    rank = reduce(lambda c, k: c.when(F.col("model") == order[k], k), range(1, len(order)), F.when(F.col("model") == order[0], 0))
    judged = scores.join(F.broadcast(best), "step").groupBy("model").agg(
        F.bool_and(F.col("mae") <= F.col("best") + within).alias("near"), F.sum("mae").alias("total")
    )
    key = F.struct(~F.col("near"), F.when(F.col("near"), rank.cast("double")).otherwise(F.col("total")))
    return judged.agg(F.min_by("model", key).alias("model"))
