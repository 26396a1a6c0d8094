"""Days of the record replayed: what was said at each hour of a day, held against what was recorded after it.

All days and hours are one plan. A day's hours see nothing but the record from three hours before the first to nine hours after the last of them, which is a day of UTC and
the midnight after it; slots are dealt to the days that see them, and windows run within a day of a key. A frame isn't searched for: every measured slot hands itself to the hours
for which it is the newest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import half_up
from .besttime import best_quantised, candidates
from .outlook import project
from .series import over

DAY, HOUR, SLOT = 86400, 3600, 900
#: The hours replayed, in UTC (06 to 18 in Nairobi); how old a frame's newest slot may be (s); the hours ahead that are checked.
HOURS = (3, 15)
MAX_AGE = 10800
CHECKED = (1, 3, 6, 9)
NOON = 9 * HOUR


def frames(series: DataFrame, keys: list[str], value: str, measured: Column) -> DataFrame:
    """(keys, day, anchor, available, observed_at, held): a row for each hour replayed of each day of the record. ``observed_at`` is the newest measured slot, not after the hour
    and not too old, and ``held`` its value; hours without one aren't available."""
    rows = series.filter(measured).select(*keys, "slot", F.col(value).alias("held"), F.floor(F.col("slot") / DAY).alias("day"))
    following = F.lead("slot").over(over([*keys, "day"]))
    rows = rows.withColumn("_until", F.least(F.coalesce(following - 1, (F.col("day") + 1) * DAY - 1), F.col("slot") + MAX_AGE))
    first = F.ceil(F.col("slot") / HOUR) * HOUR
    seen = rows.filter(first <= F.col("_until")).withColumn("anchor", F.explode(F.sequence(first, F.col("_until"), F.lit(HOUR).cast("long"))))
    seen = seen.select(*keys, "anchor", F.col("slot").alias("observed_at"), "held")
    bounds = series.groupBy(*keys).agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    days = bounds.select(*keys, F.explode(F.sequence(F.floor(F.col("lo") / DAY), F.floor(F.col("hi") / DAY))).alias("day"))
    hours = F.explode(F.sequence(*(F.col("day") * DAY + h * HOUR for h in HOURS), F.lit(HOUR).cast("long")))
    spine = days.withColumn("anchor", hours)
    return spine.join(seen, [*keys, "anchor"], "left").withColumn("available", F.col("observed_at").isNotNull())


def forecasts(shown: DataFrame, series: DataFrame, keys: list[str], usual: str, fits: DataFrame, bands: DataFrame, steps: int = 36) -> DataFrame:
    """What each available frame said: (keys, day, anchor, observed_at, held, step, target, value, lower, upper)."""
    known = series.select(*keys, F.col("slot"), F.col(usual).alias("_u"))
    rows = shown.filter("available").join(known.withColumnsRenamed({"slot": "observed_at", "_u": "u0"}), [*keys, "observed_at"], "left")
    rows = rows.withColumns({"x0": F.col("held"), "step": F.explode(F.sequence(F.lit(0), F.lit(steps)))})
    rows = rows.withColumn("target", F.col("observed_at") + F.col("step") * SLOT).withColumn("block", F.floor(F.col("target") % DAY / 10800))
    rows = rows.join(known.withColumnsRenamed({"slot": "target", "_u": "u1"}), [*keys, "target"], "left")
    return project(rows, fits, bands).select(*keys, "day", "anchor", "observed_at", "held", "step", "target", "value", "lower", "upper")


def checks(said: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """Each forecast of the checked hours with what was recorded then (keys, slot, recorded), its error, and the error of holding the reading it was made from."""
    due = said.filter((F.col("step") * SLOT).isin(*(h * HOUR for h in CHECKED)))
    found = due.join(recorded.withColumnRenamed("slot", "target"), [*keys, "target"], "left").withColumn("recorded", half_up(F.col("recorded"), 1))
    error = lambda x: half_up(F.col(x) - F.col("recorded"), 1)
    hours = (F.col("step") * SLOT / HOUR).cast("int")
    return found.select(*keys, "day", "anchor", hours.alias("hours"), "target", "value", "lower", "upper", "recorded", error("value").alias("error"), error("held").alias("held_error"))


def window_records(said: DataFrame, recorded: DataFrame, keys: list[str], seconds: int = HOUR, daylight: tuple[int, int] | None = (12600, 56100)) -> DataFrame:
    """(keys, anchor, best_start, best_peak, noon_start, noon_peak): the window that each frame would have chosen and the one of equal length from noon of its day, by the highest value recorded in
    them; a window of which a slot wasn't recorded has no peak."""
    at = [*keys, "anchor"]
    path = said.select(*at, F.col("target").alias("slot"), "value", (F.col("upper") - F.col("lower")).alias("width"))
    best = best_quantised(candidates(path, at, seconds, daylight=daylight), at).select(*at, F.col("start").alias("best_start"))
    noon = F.floor((F.col("best_start") + 10800) / DAY) * DAY + NOON
    best = best.withColumn("noon_start", noon)
    n = -(-seconds // SLOT)
    both = F.array(*(F.struct(F.lit(w).alias("which"), F.col(f"{w}_start").alias("start")) for w in ("best", "noon")))
    slots = best.select(*at, F.inline(both)).withColumn("slot", F.explode(F.sequence("start", F.col("start") + (n - 1) * SLOT, F.lit(SLOT).cast("long"))))
    met = slots.join(recorded, [*keys, "slot"])
    peak = lambda w: F.max(F.when(F.col("which") == w, F.col("recorded")))
    whole = lambda w: F.count_if(F.col("which") == w) == n
    peaks = met.groupBy(*at).agg(*(half_up(F.when(whole(w), peak(w)), 1).alias(f"{w}_peak") for w in ("best", "noon")))
    return best.join(peaks, at, "left")


def summary(checked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, day, hours, n, mae, held_mae, within): a day's errors by hours ahead, beside those of holding each frame's reading."""
    inside = F.col("recorded").between(F.col("lower"), F.col("upper")).cast("int")
    known = checked.filter("error is not null")
    # means of tenths are often exactly halfway: the nudge makes them go up whatever order they were added in
    two = lambda x: F.floor(x * 100 + 0.500001) / 100
    return known.groupBy(*keys, "day", "hours").agg(
        F.count(F.lit(1)).alias("n"),
        two(F.avg(F.abs("error"))).alias("mae"),
        two(F.avg(F.abs("held_error"))).alias("held_mae"),
        two(F.avg(inside)).alias("within"),
    )
