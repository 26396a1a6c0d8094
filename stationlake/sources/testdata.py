"""The shared test tables as station data: readings of four stations from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import utc

SLOT = 900


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, station_id, t (epoch seconds) and one channel of temp, rh, press, wind, rain for each event."""
    return station_rows(table(spark, sf_dir, "events"))


def station_rows(events: DataFrame) -> DataFrame:
    of = lambda kind, x: F.when(F.col("event_type") == kind, x)
    value = F.col("value")
    return events.select(
        "event_id",
        (F.col("user_id") % 4).alias("station_id"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"),
        of("click", 10 + F.least(value, F.lit(200.0)) / 8).alias("temp"),
        of("view", F.least(F.lit(99.0), 30 + value / 4)).alias("rh"),
        of("signup", 850 + value / 100).alias("press"),
        of("error", F.least(value, F.lit(300.0)) / 30).alias("wind"),
        of("purchase", value / 100).alias("rain"),
    )


READINGS_SQL = """readings AS (
    SELECT event_id, user_id % 4 AS station_id, epoch_us(ts) // 1000000 AS t,
        CASE WHEN event_type = 'click' THEN 10 + least(value, 200.0) / 8 END AS temp,
        CASE WHEN event_type = 'view' THEN least(99.0, 30 + value / 4) END AS rh,
        CASE WHEN event_type = 'signup' THEN 850 + value / 100 END AS press,
        CASE WHEN event_type = 'error' THEN least(value, 300.0) / 30 END AS wind,
        CASE WHEN event_type = 'purchase' THEN value / 100 END AS rain
    FROM events)"""

GRID_SQL = f"""{READINGS_SQL},
    grid AS (
    SELECT station_id, t - t % 900 AS slot, avg(temp) AS temp, avg(rh) AS rh, avg(press) AS press, avg(wind) AS wind,
        max(wind) AS gust, sum(rain) AS rain, count(*) AS n
    FROM readings GROUP BY 1, 2),
    spine AS (
    SELECT station_id, unnest(generate_series(lo, hi, 900)) AS slot
    FROM (SELECT station_id, min(slot) AS lo, max(slot) AS hi FROM grid GROUP BY 1)),
    dense AS (
    SELECT spine.station_id, spine.slot, temp, rh, press, wind, gust, rain, n
    FROM spine LEFT JOIN grid ON spine.station_id = grid.station_id AND spine.slot = grid.slot)"""
