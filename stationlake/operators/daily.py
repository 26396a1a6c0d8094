"""Days: the business day is three hours ahead of UTC. Sums are known only where enough hours were read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import half_up

OFFSET = 10800


def business_days(readings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, day, mm, rain_hours, t_max, t_min, temp_hours); day counts from 1970."""
    hour = F.floor((F.col("t") + OFFSET) / 3600)
    # hours first: their number a day is bounded, so the distinct counts below stay small
    hourly = readings.groupBy(*keys, hour.alias("hour")).agg(
        F.sum("rain").alias("rain"), F.count("rain").alias("rains"), F.max("temp").alias("hi"), F.min("temp").alias("lo")
    )
    return hourly.groupBy(*keys, F.floor(F.col("hour") / 24).alias("day")).agg(
        F.sum("rain").alias("mm"),
        F.count_if(F.col("rains") > 0).alias("rain_hours"),
        F.max("hi").alias("t_max"),
        F.min("lo").alias("t_min"),
        F.count("hi").alias("temp_hours"),
    )


def gated(days: DataFrame, keys: list[str], least_hours: int) -> DataFrame:
    bounds = days.groupBy(*keys).agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    spine = bounds.select(*keys, F.explode(F.sequence("lo", "hi")).alias("day"))
    return spine.join(days, [*keys, "day"], "left").withColumn("mm", F.when(F.col("rain_hours") >= least_hours, F.col("mm")))


def climatology(series: DataFrame, keys: list[str], value: str, ranges: list[tuple[int, int]], least: int, time: str = "slot") -> DataFrame:
    """(keys, slot_of_day, mean, n, complete) over half-open ranges."""
    inside = reduce(lambda a, b: a | b, ((F.col(time) >= a) & (F.col(time) < b) for a, b in ranges))
    by = series.filter(inside).groupBy(*keys, F.floor(F.col(time) % 86400 / 900).alias("slot_of_day")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    whole = by.groupBy(*keys).agg(((F.min("n") >= least) & (F.count(F.lit(1)) == 96)).alias("complete"))
    return by.join(whole, keys)


def spells(days: DataFrame, keys: list[str], threshold: float = 1.0) -> DataFrame:
    """Days in a row, up to the latest read one, that were wet, or dry. ``days`` are dense; a day that wasn't read ends a spell, but unread
    days after the latest read one don't count."""
    last = days.filter("mm is not null").groupBy(*keys).agg(F.max("day").alias("_last"))
    seen = days.join(last, keys, "left").filter(F.col("_last").isNull() | (F.col("day") <= F.col("_last")))
    length = lambda stop: F.coalesce(F.max("_last") - F.coalesce(F.max(F.when(F.col("mm").isNull() | stop, F.col("day"))), F.min("day") - 1), F.lit(0))
    return seen.groupBy(*keys).agg(length(F.col("mm") < threshold).alias("wet_days"), length(F.col("mm") >= threshold).alias("dry_days"))


def best_wetting(days: DataFrame, keys: list[str], span: int = 3, within: int = 10) -> DataFrame:
    """The wettest ``span`` days in a row among the last ``within`` of dense days; an unread day counts as none."""
    order = Window.partitionBy(*keys).orderBy("day")
    whole = Window.partitionBy(*keys)
    sums = F.sum(F.coalesce("mm", F.lit(0.0))).over(order.rowsBetween(1 - span, 0))
    full = F.col("day") - F.min("day").over(whole) >= span - 1
    last = F.col("day") > F.max("day").over(whole) - (within - span + 1)
    rows = days.select(*keys, F.when(full & last, sums).alias("mm"))
    return rows.groupBy(*keys).agg(half_up(F.greatest(F.lit(0.0), F.max("mm")), 1).alias("mm"))


def hours_above(series: DataFrame, keys: list[str], value: str, threshold: float, hours: int = 24, time: str = "slot") -> DataFrame:
    """Measured hours of the last ``hours`` at ``threshold`` or above, each slot worth the least spacing; null with less than two slots."""
    anchor = series.groupBy(*keys).agg(F.max(time).alias("_end"))
    window = series.join(F.broadcast(anchor), keys).filter((F.col(time) > F.col("_end") - hours * 3600) & F.col(value).isNotNull())
    spaced = window.withColumn("_d", F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy(time)))
    least = F.min(F.when(F.col("_d") > 0, F.col("_d")))
    return spaced.groupBy(*keys).agg(half_up(F.count_if(F.col(value) >= threshold) * least / 3600.0, 1).alias("hours"))


def irrigation(entries: DataFrame, keys: list[str], cap: float) -> DataFrame:
    return entries.groupBy(*keys).agg(half_up(F.least(F.lit(cap), F.sum(F.least(F.lit(cap), F.col("mm")))), 1).alias("mm"))
