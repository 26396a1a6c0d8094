"""The root zone's water over days, and the advice drawn from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.agro import effective_rain, floor_to_five
from ..functions.rounding import half_up

#: Coefficients est/veg/flow/mat, root depth m, depletion fraction, planting rain mm, heat mild/moderate/severe, sensitive stage.
CROPS = (
    ("maize", 0.30, 0.80, 1.20, 0.35, 1.0, 0.55, 40.0, 32.0, 35.0, 38.0, "flowering"),
    ("beans", 0.40, 0.75, 1.15, 0.35, 0.6, 0.45, 30.0, 28.0, 32.0, 35.0, "flowering"),
    ("kale", 0.70, 0.95, 1.05, 0.95, 0.4, 0.40, 20.0, 28.0, 32.0, 35.0, None),
    ("tomato", 0.60, 0.90, 1.15, 0.80, 0.7, 0.40, 25.0, 30.0, 33.0, 36.0, "flowering"),
    ("potato", 0.50, 0.85, 1.15, 0.75, 0.5, 0.35, 30.0, 26.0, 29.0, 32.0, "flowering"),
    ("coffee", 0.90, 0.95, 0.95, 0.95, 1.3, 0.40, 50.0, 26.0, 30.0, 34.0, None),
    ("napier", 0.90, 1.00, 1.05, 0.95, 1.0, 0.55, 35.0, 35.0, 38.0, 40.0, None),
)
CROP_FIELDS = (
    "crop string, kc_establishment double, kc_vegetative double, kc_flowering double, kc_maturity double, root_m double, p double, "
    "planting_mm double, mild double, moderate double, severe double, sensitive string"
)
#: Fixed value: water that soil holds between field capacity and wilting, mm a metre of depth.
AVAILABLE_MM_PER_M = 160.0


def clamped_balance(days: DataFrame, keys: list[str], net: str, capacity: Column, start: float = 0.0) -> DataFrame:
    """(keys, depletion): the running sum of ``net`` by day, held within 0 and ``capacity`` at each step. A fold over the days of
    one season, whose number is bounded; days are folded in order, whatever order they arrive in."""
    folded = days.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("day", F.col(net).alias("net")))).alias("_days"))
    step = lambda a, x: F.least(capacity, F.greatest(F.lit(0.0), a + x["net"]))
    return folded.select(*keys, F.aggregate("_days", F.lit(start), step).alias("depletion"))


def irrigation_advice(depletion: Column, raw: Column, etc: Column, rain_ahead: Column, dries_down: Column, available: Column) -> Column:
    """(action, depth_mm, remaining_mm, days). Water is due once depletion reaches ``raw``; expected rain that covers most of it
    holds the pass; a pass is no deeper than ``raw``, in steps of five."""
    covered = F.coalesce(effective_rain(rain_ahead), F.lit(0.0))
    depth = F.greatest(F.lit(0.0), floor_to_five(depletion - covered))
    one = F.least(depth, F.greatest(F.lit(0.0), floor_to_five(raw)))
    zero, none = F.lit(0.0), F.lit(None).cast("double")

    def verdict(action, mm=zero, rest=zero, days=none):
        return F.struct(F.lit(action).alias("action"), mm.alias("depth_mm"), rest.alias("remaining_mm"), days.alias("days"))

    wait = F.when(etc > 0, F.greatest(F.lit(1.0), half_up((raw - depletion) / etc)))
    return (
        F.when(~available, verdict("DATA_TOO_THIN"))
        .when(dries_down, verdict("NO_IRRIGATION"))
        .when(depletion < raw, verdict("NO_IRRIGATION", days=wait))
        .when((covered > 0) & ((covered >= 0.8 * depletion) | (depth < 5)), verdict("HOLD_RAIN_EXPECTED"))
        .when(depth < 5, verdict("NO_IRRIGATION"))
        .otherwise(verdict("IRRIGATE_NOW", one, depth - one))
    )


def day_inputs(days: DataFrame, regional: DataFrame, applied: DataFrame, keys: list[str], least_hours: int = 20) -> DataFrame:
    """Each day's extremes and where they come from, the station where it measured enough hours, else the regional model (r_max, r_min), and
    the water applied."""
    rows = days.join(regional, [*keys, "day"], "left").join(applied, [*keys, "day"], "left")
    own = F.col("temp_hours") >= least_hours
    source = F.when(own, "station").when(F.col("r_max").isNotNull() & F.col("r_min").isNotNull(), "regional_model")
    pick = lambda mine, other: F.when(own, F.col(mine)).otherwise(F.col(other)).alias(mine)
    return rows.select(*keys, "day", source.alias("source"), pick("t_max", "r_max"), pick("t_min", "r_min"), F.coalesce("applied", F.lit(0.0)).alias("applied"))


def confidence(station_rain: Column, station_et0: Column, whole: Column) -> Column:
    return F.when(station_rain & station_et0 & whole, "HIGH").when(station_rain | station_et0, "MODERATE").otherwise("LOW")


def spray_window(daylight: Column, wind: Column, rain: Column, temp: Column, filled: Column, poor: Column) -> Column:
    """(quality, reasons): the worst of all rules; limits are told before what was met, five at most."""
    no = F.lit(None).cast("int")
    rules = {
        "outside_daylight": F.when(~daylight, 2),
        "wind_drift": F.when(wind > 4, 2),
        "wind_too_calm": F.when(wind < 0.4, 1),
        "washoff": F.when(rain >= 0.5, 2),
        "rain_possible": F.when((rain >= 0.25) & (rain < 0.5), 1),
        "evaporation": F.when(temp > 28, 1),
        "inputs_filled": F.when(filled, 1),
        "data_limited": F.when(poor, 1),
    }
    worst = F.greatest(F.lit(0), *(F.coalesce(r, no) for r in rules.values()))
    limits = [F.when(r.isNotNull(), F.lit(n)) for n, r in rules.items()]
    met = [F.when(wind.between(0.4, 4.0), F.lit("wind_suitable")), F.when(rain < 0.25, F.lit("low_rain_risk"))]
    reasons = F.slice(F.array_compact(F.array(*limits, *met)), 1, 5)
    return F.struct(F.element_at(F.array(*map(F.lit, ("GOOD", "MARGINAL", "AVOID"))), worst + 1).alias("quality"), reasons.alias("reasons"))


def planting(rain_30d: Column, wetting: Column, dry_days: Column, deficit: Column, required: Column) -> Column:
    """The outlook's message; ``favourable`` only where the seedbed is wet already."""
    short, long_dry = rain_30d < required, dry_days > 7
    return (
        F.when(~short & (wetting >= 20) & ~long_dry & ~deficit, "favourable")
        .when(short & long_dry, "dry")
        .when(short, "insufficient")
        .when(long_dry, "dryspell")
        .when(deficit, "soil_dry")
        .otherwise("no_wetting")
    )


def heat_stress(peak: Column, stage: Column, shift: float = 3.0) -> Column:
    """NONE to SEVERE by the crop's thresholds, which are lower at its sensitive stage."""
    lower = F.when(F.col("sensitive").eqNullSafe(stage), shift).otherwise(0.0)
    return (
        F.when(peak >= F.col("severe") - lower, "SEVERE")
        .when(peak >= F.col("moderate") - lower, "MODERATE")
        .when(peak >= half_up(F.col("mild") - lower, 1), "MILD")
        .when(peak.isNotNull(), "NONE")
    )
