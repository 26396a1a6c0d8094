"""What pages show: filled readings, lines with breaks, axes, gates, and catalogues of other sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import half_up

#: The channels behind each reading of the measurement strip.
READING_FIELDS = {"temperature": ["temp"], "humidity": ["rh"], "wind": ["wind"], "pressure": ["press"], "wet_bulb": ["wet_bulb"], "wbgt": ["wbgt"], "rain": ["rain"]}


def filled_readings(imputed: Column, sparse_rain: Column) -> Column:
    """Readings that were filled in rather than measured. WBGT goes with the temperature and the wet bulb; a feed that tells rain only
    when it falls has no gaps in it."""
    touched = {r: F.arrays_overlap(imputed, F.array(*map(F.lit, names))) for r, names in READING_FIELDS.items()}
    touched["wbgt"] = touched["wbgt"] | touched["temperature"] | touched["wet_bulb"]
    touched["rain"] = touched["rain"] & ~sparse_rain
    return F.array_compact(F.array(*(F.when(x, F.lit(r)) for r, x in touched.items())))


def measured_line(rows: DataFrame, value: Column, filled: Column, own_source: Column, end: Column, hours: int = 12, time: str = "slot") -> DataFrame:
    """The last ``hours`` of a series of the source that the page tells of, with a break where an input was filled."""
    inside = (F.col(time) >= end - hours * 3600) & (F.col(time) <= end) & own_source
    return rows.filter(inside).withColumn("line", F.when(~filled, half_up(value, 1)))


def overrides(rows: DataFrame, fresh_minutes: int = 180) -> DataFrame:
    """Whether a station's state may stand for its area: real data, fresh enough; its rain of the day only then."""
    real = (F.col("source") != "demo") & (F.col("fresh_minutes") <= fresh_minutes)
    return rows.withColumns({"real": real, "rain_today": F.when(real, F.col("rain_today"))})


def longest_gap(gaps: DataFrame, keys: list[str]) -> DataFrame:
    """The longest silence, the first of equals."""
    return gaps.groupBy(*keys).agg(F.max_by(F.struct("start", "end", "seconds"), F.struct("seconds", -F.col("start"))).alias("_g")).select(*keys, "_g.*")


def nearest_point(points: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """The nearest of a few places by straight distance in degrees, the first by name of equals."""
    d = F.hypot(F.col("lng") - F.col("place_lng"), F.col("lat") - F.col("place_lat"))
    both = points.crossJoin(F.broadcast(places)).withColumn("distance", d)  # a constant table
    return both.groupBy(*keys).agg(F.min_by(F.struct("place", "distance"), F.struct(F.round("distance", 9), "place")).alias("_n")).select(*keys, "_n.*")


def degree_ticks(low: Column, high: Column, step: int = 2) -> Column:
    """Even degrees that span the values."""
    return F.sequence(F.floor(low / step) * step, F.ceil(high / step) * step, F.lit(step).cast("long"))


def hour_ticks(start: Column, end: Column, every: int = 3, offset: int = 10800) -> Column:
    """Local full hours, a multiple of ``every``, between two instants."""
    width = every * 3600
    first = F.ceil((start + offset) / width) * width - offset
    return F.when(first <= end, F.sequence(first, F.floor((end + offset) / width) * width - offset, F.lit(width).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def replay_date(raw: Column, first: str, today: Column) -> Column:
    """A real calendar date from the first day of the record to yesterday, else null."""
    date = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), raw.try_cast("date"))
    return F.when((date >= F.lit(first).cast("date")) & (date < today), date)


def cloudless(scenes: DataFrame, keys: list[str], most_cloud: float, limit: int) -> DataFrame:
    """The newest scenes of each key below a share of cloud, over all sensors."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("taken"), "scene_id"))
    return scenes.filter(F.col("cloud") < most_cloud).withColumn("place", place.cast("long")).filter(F.col("place") <= limit)


def latest_index(days: DataFrame, keys: list[str], least_coverage: float = 0.5, least_spread: float = 0.02) -> DataFrame:
    """The vegetation index of the latest day that was covered well enough and isn't one flat value."""
    good = days.filter((F.col("coverage") >= least_coverage) & (F.col("spread") >= least_spread))
    return good.groupBy(*keys).agg(F.max("day").alias("day"), F.max_by("mean", "day").alias("mean"))


def complete_year(days: DataFrame, keys: list[str], value: str, span: int = 365, least: int = 330) -> DataFrame:
    """Mean and rank of the latest of a key's last ``span`` days, unknown with fewer than ``least`` values."""
    w = Window.partitionBy(*keys)
    last = days.withColumns({"_back": F.max("day").over(w) - F.col("day"), "_now": F.max_by(value, F.when(F.col(value).isNotNull(), F.col("day"))).over(w)}).filter(F.col("_back") < span)
    x, now = F.col(value), F.col("_now")
    enough = F.count(value) >= least
    share = (F.count_if(x < now) + F.count_if(x == now) / 2) / F.count(value)
    return last.groupBy(*keys).agg(
        F.count(value).alias("values"), F.when(enough, half_up(F.avg(value), 4)).alias("mean"), F.when(enough, F.floor(share * 100 + 0.5)).alias("percentile")
    )


def stored_entries(raw: DataFrame, column: str, schema: str, valid: Column) -> DataFrame:
    """Rows of a JSON text that fit a schema and a condition; the rest are dropped."""
    return raw.withColumn("entry", F.from_json(column, schema)).filter(F.col("entry").isNotNull() & F.coalesce(valid, F.lit(False)))


def heat_audit(rows: DataFrame, keys: list[str], margin: float = 1.5, hot: float = 27.0) -> DataFrame:
    """The device's derived figures against the formulas': wet bulb (mean and largest error), heat index (all, and hot only), WBGT below the wet
    bulb, far below it, by night and by day. Columns: wet_bulb, stull, index, formula, firmware, daylight."""
    wet, index = F.abs(F.col("wet_bulb") - F.col("stull")), F.abs(F.col("index") - F.col("formula"))
    below, far = F.col("firmware") < F.col("wet_bulb"), F.col("firmware") < F.col("wet_bulb") - margin
    pct = lambda c, where=F.lit(True): half_up(F.avg(F.when(where & c.isNotNull(), c.cast("int"))) * 100, 1)
    return rows.groupBy(*keys).agg(
        half_up(F.avg(wet), 4).alias("wet_bulb_mae"),
        half_up(F.max(wet), 4).alias("wet_bulb_max"),
        half_up(F.avg(index), 4).alias("heat_index_mae"),
        half_up(F.avg(F.when(F.col("formula") >= hot, index)), 4).alias("heat_index_hot_mae"),
        pct(below).alias("below_pct"),
        pct(far).alias("far_below_pct"),
        pct(below, ~F.col("daylight")).alias("below_night_pct"),
        pct(below, F.col("daylight")).alias("below_day_pct"),
    )


def complete_hours(rows: DataFrame, keys: list[str], fields: list[str], time: str = "t", offset: int = 10800) -> DataFrame:
    """Hourly means of hours in which every field was read, with the local ``hour_of_day``."""
    means = rows.groupBy(*keys, F.floor(F.col(time) / 3600).alias("hour")).agg(*(F.avg(f).alias(f) for f in fields))
    whole = reduce(lambda a, b: a & b, (F.col(f).isNotNull() for f in fields))
    return means.filter(whole).withColumn("hour_of_day", F.pmod(F.floor(F.col("hour") + offset / 3600), F.lit(24)))


def report(series: DataFrame, hits: DataFrame, keys: list[str], day: Column) -> DataFrame:
    """Of each key: slots, slots read, days, days with any rule broken, the share of gust directions that copy the gust, and
    readings in all. Columns of the series: n, gust, gust_dir."""
    gusty = F.col("gust_dir").isNotNull() & (F.col("gust") > 0)
    copied = gusty & (F.abs(F.col("gust_dir") - F.col("gust")) < 0.05)
    counts = series.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("slots"),
        F.count("n").alias("read"),
        F.sum("n").alias("readings"),
        F.count_distinct(day).alias("days"),
        half_up(F.count_if(copied) / F.nullif(F.count_if(gusty), F.lit(0)), 4).alias("copy_share"),
    )
    broken = hits.groupBy(*keys).agg(F.count_distinct(day).alias("days_with_hits"))
    return counts.join(broken, keys, "left").fillna(0, ["days_with_hits"])


def waits(segments: DataFrame, keys: list[str], state: str = "state") -> DataFrame:
    """How long each state lasted until the next: mean and median hours, the share of stays of at most three hours."""
    nxt = F.lead("start").over(Window.partitionBy(*keys).orderBy("start"))
    hours = (nxt - F.col("start")) / 3600
    rows = segments.withColumn("_h", hours).filter("_h is not null")
    return rows.groupBy(state).agg(
        F.count(F.lit(1)).alias("stays"),
        half_up(F.avg("_h"), 4).alias("mean_hours"),
        half_up(F.percentile("_h", F.lit(0.5)), 4).alias("median_hours"),
        half_up(F.avg((F.col("_h") <= 3).cast("int")), 4).alias("short_share"),
    )
