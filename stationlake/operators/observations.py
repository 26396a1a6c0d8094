"""From raw records to gridded observations: cleaned, without holes, with all that is known of how each value came about."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.heat import shade_wbgt, stull_wet_bulb
from .clean import circular_mean, hard_limits, last_wins, tag_gust_fault
from .counters import counter_rain
from .series import cadence, carry, dense, interpolate, over, spaced

SLOT = 900
#: What a channel holds before it was ever read; how long a reading may be overdue before a silence opens (s); after how many intervals one is late.
PLACEHOLDERS = {"temp": 20.0, "rh": 60.0, "press": 848.0, "wind": 1.0, "wind_dir": 120.0, "vis": 0.0, "ir": 0.0}
GRACE, LATE = 240, 2
#: Channels that another stands in for.
STAND_INS = {"temp_2": "temp", "temp_3": "temp", "gust": "wind", "heat_index": "temp"}
MEANS = ("temp", "rh", "press", "wind", "vis", "ir", "temp_2", "temp_3", "heat_index", "wet_bulb", "firmware")
#: rain column -> its counter's total and the total of the day before.
GAUGES = {"rain": ("total", "prior"), "rain_2": ("total_2", "prior_2")}


def silences(readings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, slot, gap_minutes, gap, late_intervals). What is missing of a silence counts from one interval of the feed after the reading before it; the slot that it
    covers names the readings on either side."""
    between = spaced(readings, keys).join(cadence(readings, keys), keys)
    length = F.col("end") - F.col("start")
    open_ = length > F.col("cadence") + GRACE
    begin = F.col("start") + F.col("cadence")
    slots = F.sequence(begin - F.pmod(begin, F.lit(SLOT)), F.col("end") - F.pmod(F.col("end"), F.lit(SLOT)), F.lit(SLOT).cast("long"))
    each = between.filter(open_).withColumns({"_begin": begin, "slot": F.explode(slots)})
    part = F.least("end", F.col("slot") + SLOT) - F.greatest("_begin", "slot")
    charged = each.withColumn("_part", part).filter("_part > 0").groupBy(*keys, "slot").agg(
        (F.sum("_part") / 60).alias("gap_minutes"), F.max(F.struct(F.col("start").alias("from"), F.col("end").alias("to"))).alias("gap")
    )
    late = between.filter(~open_ & (length >= LATE * F.col("cadence"))).groupBy(*keys, (F.col("end") - F.pmod(F.col("end"), F.lit(SLOT))).alias("slot"))
    return charged.join(late.agg(F.count(F.lit(1)).alias("late_intervals")), [*keys, "slot"], "full")


def observation_grid(raw: DataFrame, keys: list[str], rain: str = "counters") -> DataFrame:
    """A row for each quarter hour from a key's first reading to its last, from raw rows (keys, t in epoch seconds, event_id, and channels, of which any may be absent but temp, rh and wind).

    Of rows of one time the last by ``event_id`` stays. Values beyond the hard limits go and are listed in ``rejected``, and with temp or rh what the firmware made of them. Rain is the rise of the gauges'
    counters, given to the later reading, or with ``rain="sums"`` what was reported, which is none in a reading that reports anything else. A slot has the mean of a channel, the highest gust, the mean direction on the circle, the sum of its
    rain, the counters' last totals and the highest device code. Gaps of two slots at most are filled linearly, rain's never; longer ones by the last value, or before any by a placeholder; ``imputed`` lists the channels that were.
    Totals of counters are carried without being listed. Second thermometers, gust and heat index are stood in for by others, and listed. Light and wind aren't negative, and UV isn't trusted. ``raw_faults`` has what single readings
    show and a slot's figures hide; ``gap_minutes``, ``gap`` and ``late_intervals`` tell of silences."""
    have = set(raw.columns)
    gauges = {g: c for g, c in GAUGES.items() if (c[0] if rain == "counters" else g) in have}
    rows = last_wins(raw, [*keys, "t"], "event_id").drop("duplicates")
    rows = hard_limits(rows, {c: ["temp", "rh"] for c in ("wet_bulb", "firmware", "heat_index") if c in have})
    rows = tag_gust_fault(rows) if "gust" in have else rows.withColumn("faults", F.array().cast("array<string>"))
    channels = [c for c in MEANS if c in have]
    if rain == "counters":
        for gauge, (total, prior) in gauges.items():
            counted = rows.select(*keys, "t", F.col(total).alias("total"), (F.col(prior) if prior in have else F.lit(None).cast("double")).alias("prior"))
            rows = rows.drop(gauge).join(counter_rain(counted, keys).withColumnRenamed("mm", gauge), [*keys, "t"], "left")
    else:
        reported = reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in [*channels, *gauges, *({"gust", "wind_dir"} & have)]))
        rows = rows.withColumns({g: F.coalesce(g, F.when(reported, 0.0)) for g in gauges})

    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("t"))).alias(c)
    listed = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)  # noqa: E731  a few different lists
    sums = [*(F.avg(c).alias(c) for c in channels), *((F.floor(F.sum(g) * 1000 + 0.5) / 1000).alias(g) for g in gauges), listed("rejected"), listed("faults")]
    sums += [F.max("gust").alias("gust")] if "gust" in have else []
    sums += [circular_mean("wind_dir").alias("wind_dir")] if "wind_dir" in have else []
    sums += [last(c) for g in gauges for c in GAUGES[g] if c in have and rain == "counters"]
    sums += [F.max(c).alias(c) for c in ("code", "battery") if c in have]
    slots = rows.groupBy(*keys, (F.col("t") - F.pmod(F.col("t"), F.lit(SLOT))).alias("slot")).agg(*sums)
    grid = dense(slots, keys).join(silences(rows, keys), [*keys, "slot"], "left")

    filled = [*channels, *(c for c in ("gust", "wind_dir") if c in have)]
    for c in filled:
        grid = interpolate(grid, keys, c, circular=c == "wind_dir").withColumnRenamed("interpolated", f"_i_{c}")
    # a wet bulb that isn't there is worked out, the firmware's WBGT stays unknown: neither is marked unless it was interpolated
    own = ("wet_bulb", "firmware")
    missing = [F.when(F.col(f"_i_{c}") | (F.lit(c not in own) & F.col(c).isNull()), F.lit(c)) for c in filled] + [F.when(F.col(g).isNull(), F.lit(g)) for g in gauges]
    grid = grid.withColumn("_imputed", F.array_compact(F.array(*missing))).drop(*(f"_i_{c}" for c in filled))
    grid = carry(grid, keys, {c: v for c, v in PLACEHOLDERS.items() if c in have}).drop("imputed").withColumnRenamed("_imputed", "imputed")

    before = over(keys, "slot").rowsBetween(Window.unboundedPreceding, 0)
    totals = [c for g in gauges for c in GAUGES[g][:1] if c in grid.columns]
    grid = grid.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(before), F.lit(0.0)) for c in totals})
    not_negative = {c: F.greatest(F.lit(0.0), c) for c in ("wind", "vis", "ir") if c in have}
    wet_bulb = stull_wet_bulb(F.col("temp"), F.col("rh"))
    grid = grid.withColumns(not_negative | {g: F.coalesce(g, F.lit(0.0)) for g in gauges} | {"wet_bulb": F.coalesce("wet_bulb", wet_bulb) if "wet_bulb" in have else wet_bulb, "uv": F.lit(0.0)})
    grid = grid.withColumns({c: F.coalesce(c, s) for c, s in STAND_INS.items() if c in have} | {"wbgt": shade_wbgt(F.col("temp"), F.col("wet_bulb"))})
    nothing = F.array().cast("array<string>")
    lists = {"rejected": F.coalesce("rejected", nothing), "raw_faults": F.coalesce("faults", nothing)}
    return grid.withColumns(lists | {"gap_minutes": F.coalesce("gap_minutes", F.lit(0.0)), "late_intervals": F.coalesce("late_intervals", F.lit(0))}).drop("faults")
