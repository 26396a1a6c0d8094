"""Operators on series: rows with a key, and a place in time on a grid of equal steps.

Windows are partitioned by the key and run over the grid, so the readings are aggregated to slots before any window
sees them. A series of one key is one window partition; to go beyond what a task should sort, add a period to the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = list[str]


def slot_grid(readings: DataFrame, keys: Keys, step: int = 900, time: str = "t") -> DataFrame:
    """Readings to slots: means, the highest gust, the sum of rain, the number of readings."""
    slot = (F.col(time) - F.col(time) % step).alias("slot")
    means = [F.avg(c).alias(c) for c in ("temp", "rh", "press", "wind")]
    return readings.groupBy(*keys, slot).agg(
        *means, F.max("wind").alias("gust"), F.sum("rain").alias("rain"), F.count(F.lit(1)).alias("n")
    )


def dense(grid: DataFrame, keys: Keys, step: int = 900, time: str = "slot") -> DataFrame:
    """Every slot from a key's first to its last; slots without a row have nulls."""
    bounds = grid.groupBy(*keys).agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    spine = bounds.select(*keys, F.explode(F.sequence("lo", "hi", F.lit(step))).alias(time))
    return spine.join(grid, [*keys, time], "left")


def over(keys: Keys, time: str = "slot") -> Window:
    return Window.partitionBy(*keys).orderBy(time)


def carry(series: DataFrame, keys: Keys, defaults: dict[str, float], time: str = "slot") -> DataFrame:
    """Last value carried forward, with a default ahead of the first; ``imputed`` lists the channels filled."""
    before = over(keys, time).rowsBetween(Window.unboundedPreceding, 0)
    marks = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in defaults)))
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(before), F.lit(d)) for c, d in defaults.items()}
    return series.withColumn("imputed", marks).withColumns(filled)


def interpolate(series: DataFrame, keys: Keys, channel: str, longest: int = 2, time: str = "slot", circular: bool = False) -> DataFrame:
    """Gaps of at most ``longest`` rows between two values filled linearly; angles go the short way round."""
    w = over(keys, time)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    x, place = F.col(channel), F.row_number().over(w)
    s = series.withColumn("_n", place).withColumn("_at", F.when(x.isNotNull(), F.col("_n")))
    s = s.withColumns(
        {
            "_p": F.last(channel, ignorenulls=True).over(back),
            "_pn": F.last("_at", ignorenulls=True).over(back),
            "_q": F.first(channel, ignorenulls=True).over(ahead),
            "_qn": F.first("_at", ignorenulls=True).over(ahead),
        }
    )
    step = F.col("_q") - F.col("_p")
    if circular:
        step = F.pmod(step + 540, F.lit(360.0)) - 180
    value = F.col("_p") + step * (F.col("_n") - F.col("_pn")) / (F.col("_qn") - F.col("_pn"))
    if circular:
        value = F.pmod(value, F.lit(360.0))
    short = F.col("_qn") - F.col("_pn") - 1 <= longest
    filled = F.when(x.isNull() & short, value)
    return s.withColumn("interpolated", filled.isNotNull()).withColumn(channel, F.coalesce(x, filled)).drop("_n", "_at", "_p", "_pn", "_q", "_qn")


def spaced(readings: DataFrame, keys: Keys, time: str = "t", period: int = 86400) -> DataFrame:
    """(keys, start, end) for each two neighbouring readings. Neighbours are found within a period of a key, so that no task sorts a whole series;
    between periods they are the last and the first of each, one row a period."""
    rows = readings.select(*keys, F.col(time).alias("end"), F.floor(F.col(time) / period).alias("_p"))
    inside = rows.withColumn("start", F.lag("end").over(over([*keys, "_p"], "end"))).filter("start is not null")
    ends = rows.groupBy(*keys, "_p").agg(F.min("end").alias("end"), F.max("end").alias("_last"))
    across = ends.withColumn("start", F.lag("_last").over(over(keys, "_p"))).filter("start is not null")
    return inside.select(*keys, "start", "end").union(across.select(*keys, "start", "end"))


def gaps(readings: DataFrame, keys: Keys, longest: Column, time: str = "t") -> DataFrame:
    """Silences longer than ``longest``: (keys, start, end, seconds) between neighbouring readings."""
    return spaced(readings, keys, time).withColumn("seconds", F.col("end") - F.col("start")).filter(F.col("seconds") > longest)


def cadence(readings: DataFrame, keys: Keys, time: str = "t") -> DataFrame:
    """(keys, cadence): the usual spacing of readings, their upper median. Spacings are few different whole seconds, so they are counted first and no list grows with the readings."""
    counted = spaced(readings, keys, time).groupBy(*keys, (F.col("end") - F.col("start")).alias("cadence")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    ahead = F.sum("_n").over(w.orderBy("cadence").rowsBetween(Window.unboundedPreceding, -1))
    ranked = counted.withColumns({"_below": F.coalesce(ahead, F.lit(0)), "_half": F.floor(F.sum("_n").over(w) / 2)})
    return ranked.filter("_below <= _half and _half < _below + _n").select(*keys, "cadence")


def charge_gaps(gap_rows: DataFrame, keys: Keys, step: int = 900) -> DataFrame:
    """Each gap split over the slots it covers: (keys, slot, gap_seconds)."""
    first, last = F.col("start") - F.col("start") % step, F.col("end") - F.pmod(F.col("end"), F.lit(step))
    each = gap_rows.withColumn("slot", F.explode(F.sequence(first, last, F.lit(step))))
    part = F.least("end", F.col("slot") + step) - F.greatest("start", "slot")
    return each.withColumn("part", part).filter("part > 0").groupBy(*keys, "slot").agg(F.sum("part").alias("gap_seconds"))


def runs(series: DataFrame, keys: Keys, same: Column, time: str = "slot") -> DataFrame:
    """Adds ``run``: rows in a row share a number while ``same``, which compares a row with the one ahead, holds."""
    w = over(keys, time)
    breaks = F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    return series.withColumn("_b", breaks).withColumn("run", F.sum("_b").over(w)).drop("_b")


def smooth(series: DataFrame, keys: Keys, label: str, dwell: int = 4, time: str = "slot") -> DataFrame:
    """``state``: a label counts once it lasted for ``dwell`` labelled rows; until then the last one that did stays. The
    head takes the first that did; with none, the label of the last run holds for all. A row without a label has no state."""
    w = over(keys, time)
    known = series.filter(F.col(label).isNotNull())
    known = runs(known, keys, F.col(label) == F.lag(label).over(w), time)
    length = F.count(F.lit(1)).over(Window.partitionBy(*keys, "run"))
    known = known.withColumn("_settled", F.when(length >= dwell, F.col(label)))
    joined = series.join(known.select(*keys, time, "_settled"), [*keys, time], "left")
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    state = F.coalesce(
        F.last("_settled", ignorenulls=True).over(back),
        F.first("_settled", ignorenulls=True).over(every),
        F.last(label, ignorenulls=True).over(every),
    )
    return joined.withColumn("state", F.when(F.col(label).isNotNull(), state)).drop("_settled")


def segments(series: DataFrame, keys: Keys, state: str, time: str = "slot", step: int = 900) -> DataFrame:
    """Intervals of equal state: (keys, state, start, end, slots); an interval ends where the next starts."""
    w = over(keys, time)
    known = runs(series.filter(F.col(state).isNotNull()), keys, F.col(state) == F.lag(state).over(w), time)
    parts = known.groupBy(*keys, "run", state).agg(
        F.min(time).alias("start"), F.max(time).alias("last"), F.count(F.lit(1)).alias("slots")
    )
    nxt = F.lead("start").over(over(keys, "start"))
    return parts.withColumn("end", F.coalesce(nxt, F.col("last") + step)).drop("run", "last")


def rolling_usual(series: DataFrame, keys: Keys, value: str, days: int = 30, least: int = 10, time: str = "slot") -> DataFrame:
    """``usual``: the mean of the same slot on the ``days`` days before; null with fewer than ``least`` of them."""
    same_slot = Window.partitionBy(*keys, F.col(time) % 86400).orderBy(time).rangeBetween(-days * 86400, -86400)
    return series.withColumn("usual", F.when(F.count(value).over(same_slot) >= least, F.avg(value).over(same_slot)))


def live_window(read: DataFrame, keys: list[str], now: Column, hours: int = 24, grace: int = 4, gap: int = 3600, step: int = 900) -> DataFrame:
    """(keys, from, to, hours, silent_minutes, missing_minutes, read_slots, of_slots) of the slots that were read, at the time ``now``. A reading stands for its slot.
    Silence counts from a slot after the last one, once it is longer than ``grace`` minutes; ``missing_minutes`` adds the silences within the
    record that are longer than ``gap`` seconds, less the slot that the reading before them stands for."""
    before = F.lag("slot").over(over(keys))
    hole = F.col("slot") - before
    rows = read.withColumns({"_now": now, "_hole": F.when(hole > gap, hole - step).otherwise(0)})
    begin = F.floor((F.col("_now") - hours * 3600) / step) * step
    out = rows.groupBy(*keys).agg(
        F.min("slot").alias("from"),
        F.max("slot").alias("to"),
        F.max("_now").alias("_now"),
        F.sum("_hole").alias("_holes"),
        F.count(F.when(F.col("slot") >= begin, 1)).alias("read_slots"),
    )
    overdue = (F.col("_now") - F.col("to") - step) / 60
    silent = F.when(overdue > grace, F.floor(overdue + 0.5)).otherwise(0).cast("long")
    return out.select(
        *keys,
        "from",
        "to",
        F.greatest(F.lit(1), F.floor((F.col("to") - F.col("from") + step) / 3600 + 0.5)).cast("long").alias("hours"),
        silent.alias("silent_minutes"),
        (F.floor(F.col("_holes") / 60 + 0.5) + silent).cast("long").alias("missing_minutes"),
        "read_slots",
        F.lit(hours * 3600 // step).cast("long").alias("of_slots"),
    )
