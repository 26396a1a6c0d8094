"""Sensor rules as long rows (keys, slot, rule, channel, flag), and the health they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import half_up
from .clean import beyond
from .series import over, runs

#: The slots after which an unmoved value is stuck.
FLAT_SLOTS = {"temp": 8, "temp_b": 8, "temp_c": 8, "rh": 8, "press": 12, "wind": 12}
#: The rule number of each channel's hard limits.
LIMIT_RULES = {"temp": "R01", "rh": "R02", "press": "R03", "wind": "R04", "gust": "R04", "rain": "R05"}


def rule_hits(series: DataFrame, keys: list[str], time: str = "slot", step_limit: float = 5.0) -> DataFrame:
    """Limits (R01 to R05), steps over ``step_limit`` between neighbours (R07), stuck values (R08), gust below wind (R10), no reading
    (R14). A thermometer can only be called stuck where ``series`` has another one. All rules but R08 are judged in one pass over the series; the hits come out of an array."""
    w = over(keys, time)
    series = series.withColumn("_jump", F.abs(F.col("temp") - F.lag("temp").over(w)) > step_limit)
    tests: list[tuple[str, str, str, Column]] = [(r, c, "bad", beyond(c)) for c, r in LIMIT_RULES.items()]
    tests += [("R07", "temp", "suspect", F.col("_jump")), ("R10", "gust", "suspect", F.col("gust") < F.col("wind")), ("R14", "all", "info", F.col("n").isNull())]
    hits = F.array(*(F.when(t, F.struct(F.lit(r).alias("rule"), F.lit(c).alias("channel"), F.lit(f).alias("flag"))) for r, c, f, t in tests))
    flat = stuck_hits(series, keys, {c: n for c, n in FLAT_SLOTS.items() if c in series.columns}, [t for t in THERMOMETERS if t in series.columns], time)
    return series.select(*keys, time, F.inline(F.array_compact(hits))).unionByName(flat)


def stuck_hits(series: DataFrame, keys: list[str], lengths: dict[str, int], thermometers: list[str], time: str = "slot", moved: float = 0.5) -> DataFrame:
    """Each slot of a run of one measured value that is as long as its channel allows. Calm makes zero wind real, so it ends a
    run; a flat thermometer is stuck only while another one moves by more than ``moved``. Channels become rows first, so that
    the windows are split by channel, too."""
    most = max(len(thermometers) - 1, 1)
    nothing = F.lit(None).cast("double")

    def row(channel: str, least: int):
        others = [F.col(t) for t in thermometers if t != channel] if channel in thermometers else []
        others += [nothing] * (most - len(others))
        named = [o.cast("double").alias(f"other_{k}") for k, o in enumerate(others)]
        return F.struct(F.lit(channel).alias("channel"), F.col(channel).cast("double").alias("value"), F.lit(least).alias("least"), F.lit(channel in thermometers).alias("air"), *named)

    long = series.select(*keys, time, F.inline(F.array(*(row(c, n) for c, n in lengths.items()))))
    same = (F.col("value") == F.lag("value").over(over([*keys, "channel"], time))) & ~((F.col("channel") == "wind") & (F.col("value") == 0))
    numbered = runs(long, [*keys, "channel"], same, time)
    run = Window.partitionBy(*keys, "channel", "run")
    spread = F.greatest(F.lit(0.0), *(F.max(f"other_{k}").over(run) - F.min(f"other_{k}").over(run) for k in range(most)))
    judged = numbered.withColumns({"_slots": F.count(F.lit(1)).over(run), "_spread": spread})
    hit = (F.col("_slots") >= F.col("least")) & (~F.col("air") | (F.col("_spread") > moved))
    return judged.filter(hit).select(*keys, time, F.lit("R08").alias("rule"), "channel", F.lit("suspect").alias("flag"))


def channel_days(series: DataFrame, hits: DataFrame, keys: list[str], channels: list[str], day: Column) -> DataFrame:
    """For each day and channel: slots, measured slots, distinct slots flagged bad and suspect."""
    measured = series.groupBy(*keys, day.alias("day")).agg(F.count(F.lit(1)).alias("slots"), *(F.count(c).alias(c) for c in channels))
    measured = measured.unpivot([*keys, "day", "slots"], channels, "channel", "measured")
    flagged = hits.groupBy(*keys, day.alias("day"), "channel").agg(
        F.count_distinct(F.when(F.col("flag") == "bad", F.col("slot"))).alias("bad"),
        F.count_distinct(F.when(F.col("flag") == "suspect", F.col("slot"))).alias("suspect"),
    )
    both = measured.join(flagged, [*keys, "day", "channel"], "left")
    return both.fillna(0, ["bad", "suspect"])


def verdict() -> Column:
    """No reading, over 5 % bad, or suspect all along: bad. Over 5 % suspect: suspect."""
    bad = (F.col("measured") == 0) | (F.col("bad") > 0.05 * F.col("slots")) | (F.col("suspect") == F.col("slots"))
    return F.when(bad, "bad").when(F.col("suspect") > 0.05 * F.col("slots"), "suspect").otherwise("good")


def day_scores(judged: DataFrame, silent: DataFrame, keys: list[str]) -> DataFrame:
    """100, less 10 a bad channel, 2 a suspect one, and a point for 14.4 silent minutes; never below 0."""
    counts = judged.groupBy(*keys, "day").agg(F.count_if(F.col("verdict") == "bad").alias("bad"), F.count_if(F.col("verdict") == "suspect").alias("suspect"))
    both = counts.join(silent, [*keys, "day"], "left")
    minutes = F.coalesce(F.col("gap_seconds"), F.lit(0)) / 60
    score = F.greatest(F.lit(0.0), 100.0 - 10 * F.col("bad") - 2 * F.col("suspect") - minutes / 14.4)
    return both.select(*keys, "day", "bad", "suspect", half_up(score, 1).alias("score"))


def freshness_quality(rows: DataFrame) -> DataFrame:
    """GOOD, DEGRADED or POOR from ``fresh_minutes``, ``spread`` of the thermometers, ``critical`` (fields filled in the latest slot),
    ``filled_share`` (of the last 24 slots), and ``flags`` that say why; ``temp`` and ``rh`` are the latest values. Where ``rows`` have ``firmware`` and ``wet_bulb``, a WBGT of the firmware
    below the wet bulb, which can't be, is told, too; it doesn't count against the data."""
    minutes, spread, critical, share = F.col("fresh_minutes"), F.col("spread"), F.col("critical"), F.col("filled_share")
    poor = (minutes > 180) | (spread > 3) | (critical >= 3)
    worse = (minutes > 60) | (spread > 2) | (critical >= 1) | (share > 0.25)
    flags = {
        "stale_data": minutes > 180,
        "observation_age_elevated": (minutes > 60) & (minutes <= 180),
        "missing_fields": critical > 0,
        "gaps_filled_recently": share > 0.25,
        "temp_sensor_disagreement": spread > 2,
        "humidity_out_of_range": ~F.col("rh").between(0, 100),
        "temp_out_of_range": ~F.col("temp").between(-10, 50),
    }
    if {"firmware", "wet_bulb"} <= set(rows.columns):
        flags["firmware_wbgt_below_wet_bulb"] = F.col("firmware") < F.col("wet_bulb")
    listed = F.array_compact(F.array(*(F.when(held, F.lit(name)) for name, held in flags.items())))
    return rows.withColumns({"quality": F.when(poor, "POOR").when(worse, "DEGRADED").otherwise("GOOD"), "flags": listed})


def pair_audit(rows: DataFrame, pairs: list[tuple[str, str]], keys: list[str]) -> DataFrame:
    """Mean, mean absolute and largest difference of pairs of columns, in one aggregation."""
    each = F.array(*(F.struct(F.lit(f"{a}-{b}").alias("pair"), (F.col(a) - F.col(b)).alias("d")) for a, b in pairs))
    d = rows.select(*keys, F.inline(each)).filter("d is not null")
    return d.groupBy(*keys, "pair").agg(F.count(F.lit(1)).alias("n"), half_up(F.avg("d"), 4).alias("bias"), half_up(F.avg(F.abs("d")), 4).alias("mean_abs"), half_up(F.max(F.abs("d")), 4).alias("largest"))



THERMOMETERS = ("temp", "temp_b", "temp_c")


def sensor_hits(series: DataFrame, keys: list[str], day: Column, time: str = "slot") -> DataFrame:
    """Dark light sensors (R06), thermometers apart (R09, all three are named), a gust direction that copies the gust's speed on a
    gusty day (R13), device codes (R15), a device's WBGT below the wet bulb (R16). Columns: temp, temp_b, temp_c, light, gust,
    gust_dir, code, firmware, wet_bulb."""
    t = [F.col(c) for c in THERMOMETERS]
    apart = (F.greatest(*t) - F.least(*t) > 2) & (F.size(F.array_compact(F.array(*t))) >= 2)
    of_day = Window.partitionBy(*keys, day)
    gusty = F.col("gust_dir").isNotNull() & (F.col("gust") > 0)
    copied = gusty & (F.abs(F.col("gust_dir") - F.col("gust")) < 0.05)
    gusts, copies = F.sum(gusty.cast("int")).over(of_day), F.sum(copied.cast("int")).over(of_day)
    rows = series.withColumn("_copy", F.col("gust_dir").isNotNull() & (gusts > 0.05 * F.count(F.lit(1)).over(of_day)) & (copies >= 0.99 * gusts))
    tests: list[tuple[str, str, str, Column]] = [("R06", "light", "suspect", F.col("light") < 240)]
    tests += [("R09", c, "suspect", apart) for c in THERMOMETERS]
    tests += [("R13", "gust_dir", "bad", F.col("_copy")), ("R15", "code", "info", F.col("code") != 0), ("R16", "firmware", "suspect", F.col("firmware") < F.col("wet_bulb") - 1.5)]
    hits = F.array(*(F.when(x, F.struct(F.lit(r).alias("rule"), F.lit(c).alias("channel"), F.lit(f).alias("flag"))) for r, c, f, x in tests))
    return rows.select(*keys, time, F.inline(F.array_compact(hits)))


def silent_gauge(first: Column, second: Column, least: float = 0.4) -> Column:
    """The gauge that read nothing on a day when the other read rain."""
    return F.when((first >= least) & (second == 0), "gauge_2").when((second >= least) & (first == 0), "gauge_1")


def empty_channels(series: DataFrame, keys: list[str], channels: list[str], day: Column) -> DataFrame:
    """Channels without any reading on a day."""
    counted = series.groupBy(*keys, day.alias("day")).agg(*(F.count(c).alias(c) for c in channels))
    return counted.unpivot([*keys, "day"], channels, "channel", "readings").filter("readings = 0").drop("readings")
