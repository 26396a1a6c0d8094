"""Cleaning and combining raw records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import half_up

MISSING = -999.9
#: The limits beyond which a reading can't be right, (lowest, highest); humidity of 0 can't either.
LIMITS = {"temp": (-5.0, 45.0), "rh": (0.0, 100.0), "press": (800.0, 900.0), "wind": (0.0, 60.0), "gust": (0.0, 75.0), "rain": (0.0, 10.0)}


def numeric(raw: Column) -> Column:
    """A finite double, or null; the station writes -999.9 for missing."""
    x = raw.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")) | (x == MISSING), None).otherwise(x)


def parse_utc(raw: Column) -> Column:
    """A time without a zone is UTC; a date alone is its midnight."""
    return F.regexp_replace(F.trim(raw), "T", " ").try_cast("timestamp")


def beyond(channel: str) -> Column:
    low, high = LIMITS[channel]
    x = F.col(channel)
    return (x <= low if channel == "rh" else x < low) | (x > high)


def hard_limits(rows: DataFrame, dependent: dict[str, list[str]]) -> DataFrame:
    """Channels beyond their limits become null and are listed in ``rejected``; so does a ``dependent`` column, unlisted, if a
    channel that it is made from was rejected."""
    channels = [c for c in LIMITS if c in rows.columns]
    rejected = F.array_compact(F.array(*(F.when(beyond(c), F.lit(c)) for c in channels)))
    values = {c: F.when(~beyond(c), F.col(c)) for c in channels}
    values |= {d: F.when(~F.arrays_overlap(F.col("rejected"), F.array(*map(F.lit, of))) , F.col(d)) for d, of in dependent.items()}
    return rows.withColumn("rejected", rejected).withColumns(values)


def tag_gust_fault(rows: DataFrame) -> DataFrame:
    low = F.col("gust") < F.col("wind")
    return rows.withColumn("faults", F.when(low, F.array(F.lit("wind_gust"))).otherwise(F.array().cast("array<string>")))


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``, and how many others it had in ``duplicates``: one aggregation with partial results."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.col(order)).alias("last")
    return rows.groupBy(*keys).agg(last, (F.count(F.lit(1)) - 1).alias("duplicates")).select(*keys, "last.*", "duplicates")


def precedence(feeds: list[DataFrame], keys: list[str], tie: str) -> DataFrame:
    """The union of feeds; of rows with equal keys the one of the first feed stays. Adds ``source_rank``."""
    ranked = [f.withColumn("source_rank", F.lit(k).cast("long")) for k, f in enumerate(feeds)]
    both = reduce(DataFrame.unionByName, ranked)
    rest = [c for c in both.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct("source_rank", tie)).alias("best")
    return both.groupBy(*keys).agg(best).select(*keys, "best.*")


def failover(rows: DataFrame, keys: list[str], source: str, time: str, least_rows: int) -> DataFrame:
    anchors = rows.groupBy(*keys, source).agg(F.max(time).alias("anchor"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_rows)
    return anchors.groupBy(*keys).agg(F.max_by(source, F.struct("anchor", -F.col(source))).alias(source), F.max("anchor").alias("anchor"))


def range_with_prior(rows: DataFrame, keys: list[str], time: str, low: int, high: int, tie: str) -> DataFrame:
    inside = rows.filter(F.col(time).between(low, high))
    rest = [c for c in rows.columns if c not in keys]
    prior = rows.filter(F.col(time) < low).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("r"))
    return inside.unionByName(prior.select(*keys, "r.*"))


def move_column(rows: DataFrame, source: str, target: str, where: Column) -> DataFrame:
    return rows.withColumns({target: F.when(where, F.col(source)).otherwise(F.col(target)), source: F.when(~where, F.col(source))})


def zip_arrays(document: DataFrame, keys: list[str], time: str, channels: list[str]) -> DataFrame:
    """Parallel arrays to rows; rows after the last one with any value go."""
    rows = document.select(*keys, F.inline(F.arrays_zip(time, *channels)))
    some = reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in channels))
    last = rows.groupBy(*keys).agg(F.max(F.when(some, F.col(time))).alias("_last"))
    return rows.join(last, keys).filter(F.col(time) <= F.col("_last")).drop("_last")


def circular_mean(angle: str, digits: int = 1) -> Column:
    """Of degrees, rounded, from 0 up to 360."""
    a = F.radians(angle)
    mean = F.degrees(F.atan2(F.sum(F.sin(a)), F.sum(F.cos(a))))
    mean = half_up(F.when(mean < -1e-7, mean + 360).otherwise(mean), digits)
    return F.when((mean >= 360) | (mean <= 0), 0.0).otherwise(mean)
