"""Alert rules over where the stations stand: which fire, and what is suppressed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.heat import risk_band, risk_rank

DAY = 86400


def day_peaks(forecast: DataFrame, keys: list[str], now: Column, daylight: Column) -> DataFrame:
    """(keys, peak, peak_at): the highest forecast of what is left of the day's light, the earliest of equals."""
    left = forecast.filter((F.col("slot") >= now - 900) & (F.floor((F.col("slot") + 10800) / DAY) == F.floor((now + 10800) / DAY)) & daylight)
    return left.groupBy(*keys).agg(F.max("value").alias("peak"), F.max_by("slot", F.struct("value", -F.col("slot"))).alias("peak_at"))


def fired_on_day(last: Column, at: Column) -> Column:
    return F.coalesce(F.floor((last + 10800) / DAY) == F.floor((at + 10800) / DAY), F.lit(False))


def heat_fires(peak: Column, before: Column, offset: Column, last: Column, now: Column) -> Column:
    """From HIGH on, and higher than the band of the day before; where that is unknown, not if it fired the day before."""
    band = risk_rank(risk_band(peak, offset))
    risen = F.when(before.isNotNull(), band > risk_rank(risk_band(before, offset))).otherwise(~fired_on_day(last, now - DAY))
    return F.coalesce((band >= 2) & risen, F.lit(False))


def hot_state_fires(peak: Column, before: Column, hot: float, is_hot: Column, last: Column, now: Column) -> Column:
    fresh = F.when(before.isNotNull(), before < hot).otherwise(~fired_on_day(last, now - DAY))
    return F.coalesce(~is_hot & (peak >= hot) & fresh, F.lit(False))


def evaluate(rules: DataFrame, stations: DataFrame, now: Column, hot: float = 27.0) -> DataFrame:
    """``rules`` (rule_id, station_id, kind, offset_c, last, impacted: saved plans that it watches and whose band has risen) with
    ``fired``. A rule that fired today already, one of a disabled or unknown kind, and heat and plan rules on poor data don't fire."""
    r = rules.join(stations, "station_id")
    poor = F.col("status") == "POOR"
    fires = (
        F.when(fired_on_day(F.col("last"), now), False)
        .when(F.col("kind") == "exposure_tier", ~poor & heat_fires(F.col("peak"), F.col("peak_before"), F.col("offset_c"), F.col("last"), now))
        .when(F.col("kind") == "state_transition", ~poor & hot_state_fires(F.col("peak"), F.col("peak_before"), hot, F.col("is_hot"), F.col("last"), now))
        .when(F.col("kind") == "best_time", ~poor & (F.coalesce("impacted", F.lit(0)) > 0))
        .when(F.col("kind") == "rain", F.coalesce(F.col("rain_p") >= 0.5, F.lit(False)))
        .when(F.col("kind") == "data_quality", poor)
        .otherwise(False)
    )
    return r.withColumn("fired", fires)


def watched_impacts(rules: DataFrame, impacts: DataFrame) -> DataFrame:
    """``rules`` (owner, activity) with ``impacted``: how many of ``impacts`` (owner, activity) it watches, all of its owner's for a
    general rule, else those of its own activity. Impacts are counted first, so an owner's are as many rows as there are activities."""
    own = impacts.groupBy("owner", "activity").agg(F.count(F.lit(1)).alias("_own"))
    every = own.groupBy("owner").agg(F.sum("_own").alias("_all"))
    joined = rules.join(own, ["owner", "activity"], "left").join(every, "owner", "left")
    return joined.withColumn("impacted", F.when(F.col("activity") == "general", F.col("_all")).otherwise(F.col("_own"))).drop("_own", "_all")


def hot_state(centroids: list[dict[str, float]], feature: str, mean: float, std: float) -> tuple[int, float]:
    """The warmest state and the value at its centre, to one decimal: what "entering the hot state" means for a forecast."""
    centres = [c[feature] * std + mean for c in centroids]
    warmest = centres.index(max(centres))
    return warmest, int(centres[warmest] * 10 + 0.5) / 10
