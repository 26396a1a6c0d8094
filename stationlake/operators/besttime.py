"""The best window of a day for an activity, over forecast points of equal steps."""

from __future__ import annotations

from functools import cmp_to_key

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.agro import is_daylight
from ..functions.heat import risk_band, risk_rank

CANDIDATE = "start long, end long, rank int, peak double, mean double, width double"


def candidates(forecast: DataFrame, keys: list[str], duration: int, offset: float = 0.0, step: int = 900, daylight: tuple[int, int] | str | None = None) -> DataFrame:
    """(keys, start, end, rank, peak, mean, width) of each window that forecast points tile without a hole. ``forecast`` has (keys, slot,
    value, width), ``slot`` a multiple of ``step``. A point is dealt to the windows that it belongs to, duration / step of them, so the
    work grows with the points alone. ``daylight``: seconds after midnight that both ends must lie within, or ``sun`` for sunrise to sunset."""
    n = -(-duration // step)
    dealt = forecast.select(*keys, "slot", "value", "width", F.explode(F.sequence(F.col("slot") - (n - 1) * step, F.col("slot"), F.lit(step))).alias("start"))
    windows = dealt.groupBy(*keys, "start").agg(
        F.count("value").alias("points"), F.max("value").alias("peak"), F.avg("value").alias("mean"), F.avg("width").alias("width")
    )
    whole = windows.filter(F.col("points") == n).withColumn("end", F.col("start") + duration)
    if daylight == "sun":
        whole = whole.filter(is_daylight(F.col("start")) & is_daylight(F.col("end")))
    elif daylight:
        whole = whole.filter((F.col("start") % 86400).between(*daylight) & (F.col("end") % 86400).between(*daylight))
    return whole.withColumn("rank", risk_rank(risk_band(F.col("peak"), offset))).drop("points")


def order() -> Column:
    """One order of windows: band, peak in steps of 0.05, width in steps of 0.1, mean, start."""
    return F.struct("rank", F.floor(F.col("peak") / 0.05 + 1e-6), F.floor(F.col("width") / 0.1 + 1e-6), F.floor(F.col("mean") * 1e6 + 0.5), "start")


def best_quantised(found: DataFrame, keys: list[str]) -> DataFrame:
    """The best window of each key by one order: band, peak in steps of 0.05, width in steps of 0.1, mean, start. Unlike tolerances
    this is transitive, so Spark can take it as a minimum with partial results."""
    return found.groupBy(*keys).agg(F.min_by(F.struct("start", "end", "rank", "peak"), order()).alias("_b")).select(*keys, "_b.*")


def _compare(a: dict, b: dict) -> float:
    if a["rank"] != b["rank"]:
        return a["rank"] - b["rank"]
    for field, slack in (("peak", 0.05), ("rain", 0.01), ("width", 0.1)):
        if field in a and abs(a[field] - b[field]) > slack:
            return a[field] - b[field]
    return a["mean"] - b["mean"]


def rank_with_tolerances(rows: list[dict]) -> tuple[dict, dict | None]:
    """(best, alternative): the alternative is the next that doesn't overlap the best, else the next. Rain counts only
    if every window has it. Differences within a tolerance pass to the next criterion, which isn't an order, so the
    result depends on the rows' order; they come by start."""
    if any(r.get("rain") is None for r in rows):
        rows = [{k: v for k, v in r.items() if k != "rain"} for r in rows]
    ranked = sorted(rows, key=cmp_to_key(_compare))
    best, rest = ranked[0], ranked[1:]
    apart = [r for r in rest if r["end"] <= best["start"] or r["start"] >= best["end"]]
    return best, (apart or rest or [None])[0]


def best_with_tolerances(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end, alternative). A key holds the windows of one day, 96 at most for quarter hours."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.select(*keys).schema)

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        best, other = rank_with_tolerances(group.sort_values("start").to_dict("records"))
        row = {k: best[k] for k in keys} | {"start": best["start"], "end": best["end"], "alternative": other and other["start"]}
        return pd.DataFrame([row])

    return found.groupBy(*keys).applyInPandas(pick, f"{fields}, start long, end long, alternative long")


def worse_than_planned(now: Column, planned: Column) -> Column:
    """Whether a saved plan's band has risen."""
    return risk_rank(now) > risk_rank(planned)
