"""What a caller asks of station data, each as one function from readings to a DataFrame.

``readings`` has the keys, ``t`` (epoch seconds) and the channels temp, rh, press, wind and rain, one row a reading. All stations are
answered at once; filter the result, or the readings, for one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions.agro import et0_hargreaves
from .functions.heat import risk_band, shade_wbgt, stull_wet_bulb
from .functions.rounding import half_up
from .operators import besttime, daily, display, farm, forecast, outlook, quality, series

KEYS = ["station_id"]
DEFAULTS = {"temp": 20.0, "rh": 60.0}


def grid(readings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Every quarter hour from a station's first reading to its last."""
    return series.dense(series.slot_grid(readings, keys), keys)


def exposure(readings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The grid with ``wbgt``, from values carried forward where none was read; ``imputed`` lists those."""
    g = series.carry(grid(readings, keys), keys, DEFAULTS)
    return g.withColumn("wbgt", shade_wbgt(F.col("temp"), stull_wet_bulb(F.col("temp"), F.col("rh"))))


def situation(readings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Each station's latest slot: WBGT, its band, the change in an hour, and the share filled in a day."""
    w = series.over(keys)
    filled = F.avg((F.size("imputed") > 0).cast("int")).over(w.rowsBetween(-95, 0))
    rows = exposure(readings, keys).withColumns({"change_1h": F.col("wbgt") - F.lag("wbgt", 4).over(w), "filled_share": filled})
    last = rows.groupBy(*keys).agg(F.max_by(F.struct("slot", "wbgt", "change_1h", "filled_share"), "slot").alias("s")).select(*keys, "s.*")
    return last.select(
        *keys,
        "slot",
        half_up(F.col("wbgt"), 4).alias("wbgt"),
        risk_band(half_up(F.col("wbgt"), 1)).alias("band"),
        half_up(F.col("change_1h"), 4).alias("change_1h"),
        half_up(F.col("filled_share"), 4).alias("filled_share"),
    )


def forecasts(readings: DataFrame, keys: list[str] = KEYS, steps: list[int] | None = None, origins: int = 1, least: int = 5) -> DataFrame:
    """Seasonal forecasts of temperature from the latest origins whose targets are known: (keys, slot, step, target, value)."""
    usual = series.rolling_usual(series.carry(grid(readings, keys), keys, {"temp": 20.0}), keys, "temp", least=least)
    rows = forecast.pairs(usual, keys, steps or [4, 12, 24, 36])
    fit = rows.groupBy("step").agg(forecast.slope().alias("a"))
    rows = rows.join(F.broadcast(fit), "step").withColumn("value", half_up(forecast.seasonal(F.col("a")), 4))
    newest = F.row_number().over(Window.partitionBy(*keys, "step").orderBy(F.desc("slot")))
    rows = rows.withColumn("_k", newest).filter(F.col("_k") <= origins)
    return rows.select(*keys, "slot", "step", (F.col("slot") + F.col("step") * 900).alias("target"), "value")


def best_windows(readings: DataFrame, seconds: int, keys: list[str] = KEYS, offset: float = 0.0, daylight: tuple[int, int] | None = (12600, 56100)) -> DataFrame:
    """The best window of each day: (keys, day, start, end, rank, peak)."""
    f = exposure(readings, keys).select(*keys, "slot", F.col("wbgt").alias("value"), F.lit(0.0).alias("width"))
    found = besttime.candidates(f, keys, seconds, offset, daylight=daylight).withColumn("day", F.floor(F.col("start") / 86400))
    return besttime.best_quantised(found, [*keys, "day"])


def history(readings: DataFrame, keys: list[str] = KEYS, least_hours: int = 20) -> DataFrame:
    """Days with their extremes, and rain where enough hours were read."""
    return daily.gated(daily.business_days(readings, keys), keys, least_hours)


def hits(readings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Sensor rules that readings break, one row each."""
    return quality.rule_hits(grid(readings, keys), keys)


def depletion(readings: DataFrame, keys: list[str] = KEYS, coefficient: float = 1.05, capacity: float = 96.0) -> DataFrame:
    """Water that the root zone lacks after the days on record."""
    d = daily.business_days(readings, keys)
    doy = F.dayofyear(F.date_from_unix_date(F.col("day").cast("int")))
    et0 = F.coalesce(et0_hargreaves(F.col("t_max"), F.col("t_min"), doy), F.lit(0.0))
    rain = F.when(F.col("mm") > 2, 0.8 * F.col("mm")).otherwise(0.0)
    return farm.clamped_balance(d.select(*keys, "day", (coefficient * et0 - rain).alias("net")), keys, "net", F.lit(capacity))


def clean(raw: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """From raw records to a series without holes that names what wasn't measured; ``raw`` also has ``event_id``, which orders repeats."""
    return outlook.clean_grid(raw, keys, {"temp": 20.0, "rh": 60.0, "press": 848.0, "wind": 1.0, "rain": 0.0})


def rainfall(readings: DataFrame, keys: list[str] = KEYS, least_hours: int = 20) -> DataFrame:
    """Rain of today, a week and thirty days, its rank and spells; told only if every day is known."""
    return outlook.rainfall_context(daily.gated(daily.business_days(readings, keys), keys, least_hours), keys)


def activities(readings: DataFrame, planned: DataFrame, now: int, hours: int = 9) -> DataFrame:
    """Planned activities held against the exposure of the hours from ``now`` on."""
    ahead = exposure(readings).filter(F.col("slot").between(now, now + hours * 3600))
    return outlook.assess(planned, ahead.select("station_id", "slot", F.col("wbgt").alias("value")), now)


def longest_silence(readings: DataFrame, keys: list[str] = KEYS, seconds: int = 3600) -> DataFrame:
    """Each station's longest silence above ``seconds``."""
    return display.longest_gap(series.gaps(readings, keys, F.lit(seconds)), keys)
