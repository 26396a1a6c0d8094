"""Session settings that the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def utc(spark: SparkSession) -> SparkSession:
    """Timestamps are UTC throughout; the business day is a fixed three hours ahead."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
