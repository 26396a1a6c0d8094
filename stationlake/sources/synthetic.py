"""Made-up station series with a daily course, for trying things out: the same rows for the same seed, whatever the partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import random
from ..functions.rounding import half_up

#: Numbers that one row draws.
DRAWS = 8


def _bell(hour: Column, peak: float, width: float) -> Column:
    """1 at the peak hour, falling to both sides around the clock."""
    away = F.pmod(hour - peak, F.lit(24.0))
    near = F.least(away, 24 - away)
    return F.exp(-near * near / (2 * width * width))


def series(spark: SparkSession, stations: int, end: int, hours: int, seed: int, step: int = 900, offset: int = 10800) -> DataFrame:
    """(station_id, t, temp, rh, press, wind, rain) for each quarter hour of the ``hours`` up to ``end``, local time ``offset`` seconds ahead."""
    rows = hours * 3600 // step
    ids = spark.range(stations * rows).select(F.floor(F.col("id") / rows).alias("station_id"), (F.col("id") % rows).alias("k"))
    t = F.lit(end) - (rows - 1 - F.col("k")) * step
    own = F.lit(seed) + F.col("station_id") * 7919
    hour = (F.col("t") + offset) % 86400 / 3600
    noise = lambda j: random.gaussian(own, F.col("k") * DRAWS + j)
    chance = lambda j: random.uniform(own, F.col("k") * DRAWS + j)
    warm = _bell(hour, 14.5, 5.0)
    shower = chance(7) < 0.02
    return ids.withColumn("t", t).select(
        "station_id",
        "t",
        half_up(14 + 11 * warm + 0.3 * noise(1), 1).alias("temp"),
        half_up(F.least(F.lit(98.0), F.greatest(F.lit(20.0), 84 - 46 * warm + 1.5 * noise(3))), 1).alias("rh"),
        half_up(848.5 + 0.8 * F.sin((hour - 10) / 12 * 6.283185307179586), 1).alias("press"),
        half_up(F.greatest(F.lit(0.1), 0.8 + warm + 0.2 * noise(5)), 1).alias("wind"),
        F.when(shower, half_up(2.5 * chance(8), 1)).otherwise(0.0).alias("rain"),
    )


def replay_day(spark: SparkSession, date: str, end_hour: int, seed: int = 1) -> DataFrame:
    """26 hours of one station up to a local hour of a date, always the same."""
    from datetime import datetime, timezone

    midnight = int(datetime.fromisoformat(date).replace(tzinfo=timezone.utc).timestamp())
    return series(spark, 1, midnight + (end_hour - 3) * 3600, 26, seed)
