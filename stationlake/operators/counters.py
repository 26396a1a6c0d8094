"""Rain from a counter that restarts each rain day (06:00 UTC), perhaps late, and sometimes dips."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY, START = 86400, 21600
#: Fixed value: half a tip; a counter that falls by less hasn't restarted.
DIP = 0.1


def rain_day(t: int) -> int:
    return (t - START) // DAY


def fold(rows: Iterable[tuple[int, float | None, float | None]], state: tuple | None = None) -> Iterator[tuple[float | None, tuple | None]]:
    """(mm, state) for each (t, total, prior). The state is (t, peak, restart day): after a day without a reading all of the total is
    new; once a day the counter may fall back, and then what the day before ended with beyond the peak is new, too; else only
    what exceeds the peak is. A null total gives null and keeps the state; the first total gives null."""
    for t, total, prior in rows:
        if total is None or total != total:
            yield None, state
            continue
        day = rain_day(t)
        if state is None:
            state = (t, total, day)
            yield None, state
            continue
        last, peak, restarted = state
        if day - rain_day(last) >= 2:
            mm, peak, restarted = total, total, day
        elif total < peak - DIP and day > restarted:
            known = peak if prior is None or prior != prior else prior
            mm, peak, restarted = total + max(0.0, known - peak), total, day
        else:
            mm, peak = max(0.0, total - peak), max(peak, total)
        state = (t, peak, restarted)
        yield math.floor(mm * 1000 + 0.5) / 1000, state


def counter_rain(readings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, mm) of readings (keys, t, total, prior), as ``fold`` has it, in two levels. Of the state, a rain day depends on the peak that the days before left and on nothing else, and what it does to
    the peak is a function of a few numbers: with an incoming peak P the counter falls back at the first reading below P, of which only the day's successive lowest readings can be
    one, or at the first that is below the day's own peak; the outgoing peak is the highest from there on, or with no fall the highest of the day and P. So each day is
    summed up on its own, a fold over a row a day gives every day its incoming peak, and the days then emit their rain, again each on its own. No task holds more of a counter than a day's readings or its list of days."""
    day_keys = [*keys, "_day"]
    rows = readings.select(*keys, "t", F.when(F.isnan(F.col("total").cast("double")), None).otherwise(F.col("total").cast("double")).alias("total"), F.nanvl(F.col("prior").cast("double"), F.lit(None)).alias("prior"))
    silent = rows.filter("total is null").select(*keys, "t", F.lit(None).cast("double").alias("mm"))
    rows = rows.filter("total is not null").withColumn("_day", F.floor((F.col("t") - START) / DAY))
    w = Window.partitionBy(*day_keys).orderBy("t")
    ahead_of = w.rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("total")
    rows = rows.withColumns({"_top": F.max("total").over(ahead_of), "_low": F.min("total").over(ahead_of)})

    # what each day does to the peak
    on = w.rowsBetween(0, Window.unboundedFollowing)
    fell = F.coalesce(total < F.col("_top") - DIP, F.lit(False))
    marked = rows.withColumns({"_rest": F.max("total").over(on), "_fell": fell})
    marked = marked.withColumn("_falls", F.sum(F.col("_fell").cast("int")).over(w))
    lowest = F.when((F.col("_falls") == 0) & F.coalesce(total < F.col("_low"), F.lit(True)), F.struct("t", total.alias("low"), F.col("_rest").alias("rest")))
    days = marked.groupBy(*day_keys).agg(
        F.max("total").alias("top"),
        F.sort_array(F.collect_list(lowest)).alias("lows"),
        F.min_by("_rest", F.when(F.col("_fell"), F.col("t"))).alias("after_fall"),
    )
    listed = days.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_day", "top", "lows", "after_fall"))).alias("days"))  # a row a day

    def after(peak, day):
        hit = F.get(F.filter(day["lows"], lambda r: r["low"] < peak - DIP), F.lit(0))
        return F.coalesce(hit["rest"], day["after_fall"], F.greatest(peak, day["top"]))

    none = F.lit(None).cast("double")
    start = F.struct(none.alias("peak"), F.lit(None).cast("long").alias("last"), F.array().cast("array<struct<_day:bigint,_peak:double,_fresh:int>>").alias("out"))

    def step(state, day):
        """Fresh days start from their own first reading: the first of all (2), or one after a day without a reading (1)."""
        fresh = F.when(state["last"].isNull(), 2).when(day["_day"] - state["last"] >= 2, 1).otherwise(0)
        peak = F.when(fresh > 0, day["top"]).otherwise(after(state["peak"], day))
        told = F.struct(day["_day"].alias("_day"), state["peak"].alias("_peak"), fresh.alias("_fresh"))
        return F.struct(peak.alias("peak"), day["_day"].alias("last"), F.concat(state["out"], F.array(told)).alias("out"))

    incoming = listed.select(*keys, F.inline(F.aggregate("days", start, step, lambda s: s["out"])))

    # the rain of each day
    rows = rows.join(incoming, day_keys)
    peak = F.when(F.col("_fresh") == 0, F.greatest(F.col("_peak"), F.col("_top")))
    falls = F.when(F.col("_fresh") > 0, F.col("_top").isNull()).otherwise(total < peak - DIP)
    rows = rows.withColumns({"_before": peak, "_restart": F.coalesce(falls, F.lit(False))})
    rows = rows.withColumn("_part", F.sum(F.col("_restart").cast("int")).over(w) > 0)
    within = Window.partitionBy(*day_keys, "_part").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    own = F.max("total").over(within)  # the peak since the restart; null in the row that restarts
    floor0 = lambda c: F.greatest(F.lit(0.0), c)
    restart = F.when(F.col("_fresh") == 2, none).when(F.col("_fresh") == 1, total).otherwise(total + floor0(F.coalesce("prior", "_before") - F.col("_before")))
    mm = F.when(~F.col("_part"), floor0(total - F.col("_before"))).when(F.col("_own").isNull(), restart).otherwise(floor0(total - F.col("_own")))
    told = rows.withColumn("_own", own).select(*keys, "t", (F.floor(mm * 1000 + 0.5) / 1000).alias("mm"))
    return told.unionByName(silent)
