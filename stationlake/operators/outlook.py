"""Forecasts of the hours ahead, rain chances, and what surrounds a reading: context, sources, plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.heat import risk_band, risk_rank
from ..functions.rounding import half_up
from .series import dense, over


def usual_by_slot(series: DataFrame, keys: list[str], value: str, days: int = 30, least: int = 10, time: str = "slot") -> DataFrame:
    """(keys, time_of_day, usual): means over the ``days`` up to each key's latest slot; null with fewer than ``least``. A forecast
    reads the usual of its target here, as no slot of the future has one of its own."""
    anchor = series.groupBy(*keys).agg(F.max(time).alias("_end"))
    recent = series.join(F.broadcast(anchor), keys).filter(F.col(time) > F.col("_end") - days * 86400)
    by = recent.groupBy(*keys, (F.col(time) % 86400).alias("time_of_day")).agg(F.avg(value).alias("usual"), F.count(value).alias("_n"))
    return by.withColumn("usual", F.when(F.col("_n") >= least, F.col("usual"))).drop("_n")


def ahead(series: DataFrame, keys: list[str], usual: DataFrame, fits: DataFrame, bands: DataFrame, value: str = "temp", time: str = "slot", step: int = 900, steps: int = 36) -> DataFrame:
    """The forecast of each key from its latest slot, at 0 to ``steps`` steps: (keys, step, target, kind, value, lower, upper). ``fits`` has
    (step, a), ``bands`` (step, block, band, persistence). Where the usual of now or of the target isn't known, nothing changes,
    with the band of that."""
    latest = series.groupBy(*keys).agg(F.max_by(value, time).alias("x0"), F.max(time).alias("now"))
    rows = latest.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("target", F.col("now") + F.col("step") * step)
    now_usual = usual.select(*keys, F.col("time_of_day").alias("_now"), F.col("usual").alias("u0"))
    then_usual = usual.select(*keys, F.col("time_of_day").alias("_then"), F.col("usual").alias("u1"))
    rows = rows.withColumns({"_now": F.col("now") % 86400, "_then": F.col("target") % 86400, "block": F.floor(F.col("target") % 86400 / 10800)})
    rows = rows.join(now_usual, [*keys, "_now"], "left").join(then_usual, [*keys, "_then"], "left")
    return project(rows, fits, bands).select(*keys, "step", "target", "kind", "value", "lower", "upper")


def project(rows: DataFrame, fits: DataFrame, bands: DataFrame) -> DataFrame:
    """Adds kind, value, lower and upper to rows with a step, its target's block, and x0, u0 and u1: the value now, what is usual now and at the target. ``fits`` and ``bands`` have a
    row a step, or a step and block."""
    rows = rows.join(F.broadcast(fits), "step", "left").join(F.broadcast(bands), ["step", "block"], "left")
    runs = F.col("u0").isNotNull() & F.col("u1").isNotNull()
    still = F.col("step") == 0
    x0 = F.col("x0")
    point = F.when(still, x0).when(runs, half_up(F.col("u1") + F.col("a") * (x0 - F.col("u0")), 1)).otherwise(half_up(x0, 1))
    width = F.when(still, 0.0).when(runs, F.col("band")).otherwise(F.col("persistence"))
    rows = rows.withColumns({"value": point, "_w": width})
    side = lambda sign: F.when(still, F.col("value")).otherwise(half_up(F.col("value") + sign * F.col("_w"), 1))
    kind = F.when(runs, "seasonal").otherwise("no_change")
    return rows.withColumns({"kind": kind, "lower": side(-1), "upper": side(1)}).drop("_w")


def widen(forecast: DataFrame, degraded: Column, factor: float = 1.5) -> DataFrame:
    """Bands wider by ``factor`` where data are degraded."""
    v = F.col("value")
    low, high = half_up(v - (v - F.col("lower")) * factor, 1), half_up(v + (F.col("upper") - v) * factor, 1)
    return forecast.withColumns({"lower": F.when(degraded, low).otherwise(F.col("lower")), "upper": F.when(degraded, high).otherwise(F.col("upper"))})


def linear_terms(features: list[str], coef: Column, mean: Column, std: Column, first: int = 0) -> list[Column]:
    """Effects of scaled features: coefficient ``first + j`` times the j-th feature's distance from its mean."""
    return [coef[first + j] * (F.col(f) - mean[first + j]) / std[first + j] for j, f in enumerate(features)]


def predict(rows: DataFrame, models: DataFrame, features: list[str]) -> DataFrame:
    """Each row with each of a few models: no_change, seasonal, ridge, ridge_seasonal. ``rows`` has x0, u0, u1 (arrays by step number in the
    models) and the features; ``models`` (kind, step, a, intercept, coef, mean, std, band, persistence), where the last three coefficients of
    ridge_seasonal are for the usual now, the usual then and today's departure. A model whose inputs are missing falls back to no change."""
    both = rows.crossJoin(F.broadcast(models))  # a constant table
    u1 = F.get("u1_by_step", F.col("place"))
    both = both.withColumn("u1", u1).withColumn("departure", F.col("x0") - F.col("u0"))
    kind, coef, mean, std = (F.col(c) for c in ("kind", "coef", "mean", "std"))
    plain = linear_terms(features, coef, mean, std)
    seasonal = linear_terms(["u0", "u1", "departure"], coef, mean, std, first=len(features))
    add = lambda terms: reduce(lambda a, b: a + b, terms)
    value = (
        F.when(kind == "seasonal", F.col("u1") + F.col("a") * F.col("departure"))
        .when(kind == "ridge", F.col("intercept") + add(plain))
        .when(kind == "ridge_seasonal", F.col("intercept") + add(plain + seasonal))
    )
    both = both.withColumn("_v", value)
    ran = F.col("_v").isNotNull()
    return both.withColumns({"ran": ran, "value": F.coalesce("_v", "x0"), "width": F.when(ran, F.col("band")).otherwise(F.col("persistence"))}).drop("_v")


def rain_chance(inputs: list[str], intercept: float, coef: list[float], fallback: Column) -> Column:
    """Logistic chance of rain, or how often it rains in this month and hour where an input is missing."""
    z = reduce(lambda a, b: a + b, (F.col(n) * c for n, c in zip(inputs, coef, strict=True)), F.lit(intercept))
    return F.coalesce(1 / (1 + F.exp(-z)), fallback)


def valid_for(chance: Column, made: Column, at: Column, hours: int = 3) -> Column:
    """A chance speaks for the hours that its model covers, and for no other time."""
    return F.when((at >= made) & (at <= made + hours * 3600), chance)


def as_of_same_hour(anchors: DataFrame, rows: DataFrame, keys: list[str], payload: list[str], time: str = "t") -> DataFrame:
    """For each anchor the latest complete row, not after it, of its hour of day (the anchor rounded to a full hour). Anchors and rows are
    sorted together by key and hour of day, so nothing is compared with all rows of a key."""
    hour = F.pmod(F.floor(F.col(time) / 3600 + 0.5), F.lit(24))
    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in payload))
    left = anchors.select(*keys, time, hour.alias("_h"), F.lit(1).alias("_anchor"), F.lit(None).cast(_struct(rows, payload, time)).alias("_row"))
    right = rows.filter(whole & (F.col(time) % 3600 == 0)).select(*keys, time, hour.alias("_h"), F.lit(0).alias("_anchor"), F.struct(F.col(time).alias("valid"), *payload).alias("_row"))
    w = Window.partitionBy(*keys, "_h").orderBy(time, "_anchor").rowsBetween(Window.unboundedPreceding, 0)
    found = left.union(right).withColumn("_row", F.last("_row", ignorenulls=True).over(w)).filter("_anchor = 1")
    return found.select(*keys, time, "_row.*")


def _struct(rows: DataFrame, payload: list[str], time: str) -> str:
    fields = [("valid", rows.schema[time].dataType), *((c, rows.schema[c].dataType) for c in payload)]
    return "struct<" + ",".join(f"{n}:{t.simpleString()}" for n, t in fields) + ">"


def rainfall_context(days: DataFrame, keys: list[str], span: int = 30, dry: float = 1.0) -> DataFrame:
    """Of dense days: today, 7 and ``span`` days, mid-rank percentile of today, spells; all unknown unless every one of the last ``span`` days is
    known."""
    w = Window.partitionBy(*keys)
    last = days.withColumn("_back", F.max("day").over(w) - F.col("day")).filter(F.col("_back") < span)
    mm, back = F.col("mm"), F.col("_back")
    today = last.filter("_back = 0").select(*keys, mm.alias("_today"))
    rows = last.join(F.broadcast(today), keys)
    share = (F.count_if(mm < F.col("_today")) + F.count_if(mm == F.col("_today")) / 2) / F.count("mm")
    first = lambda stop: F.coalesce(F.min(F.when(stop, back)), F.lit(span).cast("long"))
    found = rows.groupBy(*keys).agg(
        (F.count("mm") == span).alias("available"),
        half_up(F.max("_today"), 1).alias("mm"),
        half_up(F.sum(F.when(back < 7, mm)), 1).alias("mm_7d"),
        half_up(F.sum("mm"), 1).alias("mm_span"),
        F.floor(share * 100 + 0.5).alias("percentile"),
        first(mm < dry).alias("wet_days"),
        first(mm >= dry).alias("dry_days"),
    )
    told = [c for c in found.columns if c not in keys and c != "available"]
    return found.withColumns({c: F.when(F.col("available"), F.col(c)) for c in told})


def assess(activities: DataFrame, forecast: DataFrame, now: int, step: int = 900, day: int = 86400, offset_east: int = 10800) -> DataFrame:
    """Planned activities (station_id, start_hour, end_hour, offset_c) against the forecast (station_id, slot, value): the current or next
    occurrence, the highest value in what is left of it, its band, how far it was judged, and whether the band is high. An
    activity's window is dealt to its slots, so the join is by equality."""
    local = now + offset_east
    midnight = local - local % day - offset_east
    hours = F.when(F.pmod(F.col("end_hour") - F.col("start_hour"), F.lit(24)) == 0, 24).otherwise(F.pmod(F.col("end_hour") - F.col("start_hour"), F.lit(24)))
    base, length = midnight + F.col("start_hour") * 3600, hours * 3600
    start = F.when(base - day + length > now, base - day).when(base + length > now, base).otherwise(base + day)
    timed = activities.withColumn("start", start).withColumn("end", F.col("start") + length)
    first = F.greatest("start", F.lit(now - step))
    slots = F.sequence(F.ceil(first / step) * step, F.col("end") - 1, F.lit(step).cast("long"))
    dealt = timed.withColumn("slot", F.explode(slots)).join(forecast, ["station_id", "slot"])
    keys = activities.columns
    found = dealt.groupBy(*keys, "start", "end").agg(F.max("value").alias("peak"), F.min("slot").alias("_first"), (F.max("slot") + step).alias("_reach"))
    judged = timed.join(found, [*keys, "start", "end"], "left")
    risk = risk_band(F.col("peak"), F.col("offset_c"))
    return judged.select(
        *keys,
        "start",
        "end",
        "peak",
        risk.alias("risk"),
        F.coalesce(risk_rank(risk) >= 2, F.lit(False)).alias("affected"),
        F.greatest("start", "_first").alias("judged_from"),
        F.least("end", "_reach").alias("judged_to"),
        (F.col("_reach") < F.col("end")).alias("partial"),
    )


def _in_order(station: DataFrame, regional: DataFrame, keys: list[str], order: Column, fields: list[str]) -> DataFrame:
    """(keys, _station, _regional): the candidates of each key by ``order``, best first. A key has the windows of one day, so a request looks
    its own up in one row, and no request is paired with candidates."""
    listed = lambda df, name: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order.alias("by"), *fields))).alias(name))
    return listed(station, "_station").join(listed(regional, "_regional"), keys, "full")


def _first(candidates: str, begin: str, end: str) -> Column:
    """Of candidates in order the first that lies between ``begin`` and ``end``."""
    return F.get(F.filter(candidates, lambda c: (c["start"] >= F.col(begin)) & (c["end"] <= F.col(end))), 0)


def plan(requests: DataFrame, station: DataFrame, regional: DataFrame, quality: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """For each request (keys, request_id, window_start, window_end) the best window that fits, from the station's candidates unless its data
    are poor, else from the regional ones, else why there is none. ``quality`` has (keys, quality)."""
    offers = _in_order(station, regional, keys, order, ["start", "end"])
    rows = requests.join(F.broadcast(quality), keys[:1]).join(offers, keys, "left")
    rows = rows.select("request_id", "quality", *(_first(c, "window_start", "window_end")["start"].alias(name) for c, name in (("_station", "_s"), ("_regional", "_r"))))
    poor = F.col("quality") == "POOR"
    own = ~poor & F.col("_s").isNotNull()
    source = F.when(own, "station").when(F.col("_r").isNotNull(), "regional").when(poor, "quality_poor").otherwise("no_window")
    return rows.select("request_id", source.alias("outcome"), F.when(own, F.col("_s")).otherwise(F.col("_r")).alias("start"))


def plan_with_reasons(requests: DataFrame, station: DataFrame, regional: DataFrame, quality: DataFrame, keys: list[str], order: Column, seconds: int, daylight: tuple[int, int], step: int = 900) -> DataFrame:
    """As ``plan``, from the time of the request (now) on: (request_id, outcome, start, peak, lower, upper, searched_from). A window that the station's forecast gives has its band, a regional one 2 degrees on
    either side, as a grid cell stands in for the station. Without a window: ``no_daylight_window`` if none of that length is left between the ends of daylight, ``quality_poor`` if
    the station's data are poor and the region has no forecast at all, else ``no_window``. ``searched_from`` is told where the range had begun already."""
    up = lambda x: F.ceil(x / step) * step
    asked = requests.withColumn("_from", up(F.greatest("window_start", "now")))

    offers = _in_order(station, regional.withColumn("width", F.lit(4.0)), keys, order, ["start", "end", "peak", "width"])
    rows = asked.join(F.broadcast(quality), keys[:1]).join(offers, keys, "left")
    found = {"_s": _first("_station", "_from", "window_end"), "_r": _first("_regional", "_from", "window_end"), "_known": F.col("_regional").isNotNull()}
    rows = rows.withColumns(found).drop("_station", "_regional")
    poor = F.col("quality") == "POOR"
    own = ~poor & F.col("_s").isNotNull()
    last = F.col("window_end") - seconds
    light = lambda t: (t % 86400).between(*daylight)
    starts = F.when(F.col("_from") <= last, F.sequence(F.col("_from"), last, F.lit(step).cast("long"))).otherwise(F.array().cast("array<long>"))
    room = F.exists(starts, lambda t: light(t) & light(t + seconds))
    outcome = F.when(own, "station").when(F.col("_r").isNotNull(), "regional").when(~room, "no_daylight_window").when(poor & ~F.col("_known"), "quality_poor").otherwise("no_window")
    rows = rows.withColumns({"outcome": outcome, "_b": F.when(own, F.col("_s")).otherwise(F.col("_r"))})
    half = F.col("_b.width") / 2
    late = F.when(F.col("_from") > up(F.col("window_start")), F.col("_from"))
    return rows.select("request_id", "outcome", "_b.start", "_b.peak", (F.col("_b.peak") - half).alias("lower"), (F.col("_b.peak") + half).alias("upper"), late.alias("searched_from"))


def escalate(quality: DataFrame, failing: DataFrame, keys: list[str], horizon_minutes: int = 540) -> DataFrame:
    """Quality (keys, quality, fresh_minutes) worsened by sensor groups that fail their rules, rain aside, and to POOR when the whole forecast
    has passed. Adds ``health_flags`` and the factor of the bands."""
    groups = failing.filter((F.col("verdict") == "bad") & (F.col("channel") != "rain")).groupBy(*keys).agg(F.array_sort(F.collect_set("channel")).alias("_bad"))
    rows = quality.join(groups, keys, "left").withColumn("_bad", F.coalesce("_bad", F.array().cast("array<string>")))
    worse = F.when((F.col("quality") == "GOOD") & (F.size("_bad") > 0), "DEGRADED").otherwise(F.col("quality"))
    gone = (F.col("fresh_minutes") >= horizon_minutes) & (worse != "POOR")
    flags = F.concat(F.transform("_bad", lambda c: F.concat(F.lit("station_health_bad:"), c)), F.when(gone, F.array(F.lit("forecast_horizon_elapsed"))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumns({"health_flags": flags, "quality": F.when(gone, "POOR").otherwise(worse)})
    return rows.withColumn("band_factor", F.when(F.col("quality") == "DEGRADED", 1.5).otherwise(1.0)).drop("_bad")


def lookback(anchors: DataFrame, grid: DataFrame, keys: list[str], hours: int, least_rows: int, reach: int, step: int = 900) -> DataFrame:
    """Anchors (keys, anchor_id, anchor) with the end of their series (the anchor, or the last slot if that is earlier), its rows, and whether it is
    real time; refused more than ``reach`` seconds before the first slot, or with too few rows. Rows are counted once for each slot that a series may end at, not for
    each anchor; slots are multiples of ``step``."""
    read = grid.groupBy(*keys, "slot").agg(F.count(F.lit(1)).alias("_n"))
    span = over(keys).rowsBetween(1 - hours * 3600 // step, 0)
    counts = dense(read, keys, step).select(*keys, F.col("slot").alias("end"), F.sum("_n").over(span).alias("rows")).filter(F.col("rows") >= least_rows)
    bounds = grid.groupBy(*keys).agg(F.min("slot").alias("_lo"), F.max("slot").alias("_hi"))
    rows = anchors.join(F.broadcast(bounds), keys).filter(F.col("anchor") >= F.col("_lo") - reach)
    ends = rows.select(*keys, "anchor_id", F.least(F.col("anchor") - F.col("anchor") % step, F.col("_hi")).alias("end"), (F.col("anchor") > F.col("_hi")).alias("realtime"))
    return ends.join(counts, [*keys, "end"]).select(*keys, "anchor_id", "end", "realtime", "rows")


def stitched(archive: DataFrame, api: DataFrame, top_up: DataFrame, keys: list[str], now: Column, time: str = "t", late: int = 1800) -> DataFrame:
    """Archive, then API, then, for keys whose API is more than ``late`` seconds behind, the top-up feed; the first of a shared time stays."""
    behind = api.groupBy(*keys).agg(F.max(time).alias("_last")).filter(F.col("_last") < now - late).select(*keys)
    feeds = [archive, api, top_up.join(F.broadcast(behind), keys, "left_semi")]
    ranked = reduce(DataFrame.unionByName, (f.withColumn("feed", F.lit(k)) for k, f in enumerate(feeds)))
    rest = [c for c in ranked.columns if c not in (*keys, time)]
    best = F.min_by(F.struct(*rest), F.struct("feed", "event_id")).alias("_b")
    return ranked.groupBy(*keys, time).agg(best).select(*keys, time, "_b.*")


def clean_grid(raw: DataFrame, keys: list[str], defaults: dict[str, float]) -> DataFrame:
    """From raw records (keys, t, event_id, temp, rh, press, wind, rain) to a gridded series: the last of equal times wins, values beyond the
    hard limits go, readings are put on the grid, rain of a slot is 0 if anything was read there, gaps of two slots at most are
    filled linearly, longer ones by the last value, wind isn't negative. ``imputed`` names what wasn't measured."""
    from .clean import hard_limits, last_wins
    from .series import carry, dense, interpolate, slot_grid

    channels = [c for c in defaults if c != "rain"]
    rows = last_wins(raw, [*keys, "t"], "event_id")
    rows = hard_limits(rows, {}).drop("rejected", "duplicates")
    grid = dense(slot_grid(rows, keys), keys)
    read = reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in [*channels, "rain"]))
    grid = grid.withColumn("rain", F.when(read, F.coalesce("rain", F.lit(0.0))))
    measured = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in defaults)))
    grid = grid.withColumn("_missing", measured)
    for channel in channels:
        grid = interpolate(grid, keys, channel).drop("interpolated")
    filled = carry(grid, keys, {c: defaults[c] for c in channels}).drop("imputed").withColumnRenamed("_missing", "imputed")
    return filled.withColumns({"wind": F.greatest(F.lit(0.0), "wind"), "rain": F.coalesce("rain", F.lit(0.0))})


def measured(*fields: str) -> Column:
    """Whether none of the fields was filled in."""
    return ~F.arrays_overlap(F.col("imputed"), F.array(*map(F.lit, fields)))


def gauge_rain(first: Column, second: Column) -> Column:
    """A slot's rain: of the first gauge if it was measured, else of the second, else unknown."""
    return F.coalesce(F.when(measured("rain"), first), F.when(measured("rain_2"), second))


def rain_rates(rows: DataFrame, period: str, cell: str, wet: str) -> DataFrame:
    """(period, cell, rate, base): how often it was wet in a cell, and at all, over all earlier periods. Counts a period first, then sums over
    the periods before, so that history isn't read again. A cell that no earlier period has has no rate."""
    counts = rows.groupBy(period, cell).agg(F.sum(wet).alias("_w"), F.count(wet).alias("_n"))
    cells, periods = rows.select(cell).distinct(), rows.select(period).distinct()
    every = periods.crossJoin(F.broadcast(cells))  # periods times 24 hours
    dense = every.join(counts, [period, cell], "left").fillna(0, ["_w", "_n"])
    before = Window.partitionBy(cell).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    sums = dense.withColumns({"_w": F.sum("_w").over(before), "_n": F.sum("_n").over(before)})
    total = Window.partitionBy(period)
    base = F.try_divide(F.sum("_w").over(total), F.sum("_n").over(total))
    return sums.select(period, cell, F.try_divide("_w", "_n").alias("rate"), base.alias("base")).filter("base is not null")


def lag_over(keys: list[str], column: str, n: int) -> Column:
    return F.lag(column, n).over(over(keys))
