"""Environmental states: nearest centroid, what follows a state, and since when it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import over


def nearest_centroid(features: dict[str, Column], centroids: list[dict[str, float]], digits: int = 9) -> Column:
    """Index of the nearest centroid, the lowest of equals; null where a feature is."""
    pairs = []
    for k, c in enumerate(centroids):
        d = sum(((x - c[n]) * (x - c[n]) for n, x in features.items()), F.lit(0.0))
        pairs.append(F.struct(F.round(d, digits).alias("d"), F.lit(k).alias("k")))
    best = F.array_min(F.array(*pairs))
    return F.when(best["d"].isNotNull(), best["k"])


def transitions(segments: DataFrame, keys: list[str], state: str = "state") -> DataFrame:
    """Counts and shares of what follows each state; ``modal`` marks the most frequent, the lowest of equals."""
    pairs = segments.withColumn("next", F.lead(state).over(over(keys, "start"))).filter("next is not null")
    counted = pairs.groupBy(F.col(state).alias("state"), "next").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("state")
    first = F.row_number().over(by.orderBy(F.desc("n"), "next"))
    return counted.withColumns({"share": F.col("n") / F.sum("n").over(by), "modal": first == 1})


def next_state(now: DataFrame, pairs: DataFrame, by: list[str], fallback: list[str]) -> DataFrame:
    """``next`` from the most frequent pair by the full key, else by the shorter one; ties go to the lower state."""

    def modal(keys: list[str], name: str) -> DataFrame:
        counted = pairs.groupBy(*keys, "next").agg(F.count(F.lit(1)).alias("n"))
        return counted.groupBy(*keys).agg(F.max_by("next", F.struct("n", -F.col("next"))).alias(name))

    joined = now.join(F.broadcast(modal(by, "_full")), by, "left").join(F.broadcast(modal(fallback, "_short")), fallback, "left")
    return joined.withColumn("next", F.coalesce("_full", "_short")).drop("_full", "_short")


def waits(parts: DataFrame, keys: list[str], block: int = 10800, least: int = 20) -> DataFrame:
    """(state, block, next, n, share, hours): for each state and block of the day with ``least`` slots, the state that mostly follows, its share of the
    slots, and the median of the hours until it comes. ``parts`` has (keys, state, start); a run that nothing follows isn't counted."""
    w = Window.partitionBy(*keys).orderBy("start")
    runs = parts.withColumns({"next": F.lead("state").over(w), "until": F.lead("start").over(w)}).filter("next is not null")
    slots = runs.select("state", "next", "until", F.explode(F.sequence(F.col("start"), F.col("until") - 900, F.lit(900))).alias("slot"))
    counts = slots.groupBy("state", F.floor(F.col("slot") % 86400 / block).alias("block"), "next", ((F.col("until") - F.col("slot")) / 3600).alias("hours")).count()
    each = counts.groupBy("state", "block", "next").agg(F.sum("count").alias("n"), F.percentile("hours", F.lit(0.5), F.col("count")).alias("hours"))
    best = F.max_by(F.struct("next", "n", "hours"), F.struct("n", -F.col("next"))).alias("b")
    total = each.groupBy("state", "block").agg(best, F.sum("n").alias("all")).filter(F.col("all") >= least)
    return total.select("state", "block", "b.next", F.col("all").alias("n"), (F.col("b.n") / F.col("all")).alias("share"), "b.hours")


def standing(labels: DataFrame, keys: list[str], dwell: int = 4, least: int = 20) -> DataFrame:
    """(keys, slot, state, since, next, share, hours) of each key's latest labelled slot: the state that has settled, since when it holds, what mostly follows it at this time of day
    and after how many hours; where the time of day has fewer than ``least`` slots, what follows it at any time. ``labels`` has (keys, slot, label)."""
    from .series import segments, smooth

    settled = smooth(labels, keys, "label", dwell).filter("state is not null").select(*keys, "slot", "state")
    parts = segments(settled, keys, "state")
    latest = settled.groupBy(*keys).agg(F.max("slot").alias("slot"))
    now = parts.groupBy(*keys).agg(F.max_by("state", "start").alias("state"), F.max("start").alias("since")).join(latest, keys)
    now = now.withColumn("block", F.floor(F.col("slot") % 86400 / 10800))
    told = lambda name: F.struct("next", "share", "hours").alias(name)
    here = waits(parts, keys, least=least).select("state", "block", told("_here"))
    any_time = waits(parts, keys, block=86400, least=1).select("state", told("_any"))
    met = now.join(F.broadcast(here), ["state", "block"], "left").join(F.broadcast(any_time), "state", "left")  # a row a state and block
    return met.withColumn("_t", F.coalesce("_here", "_any")).select(*keys, "slot", "state", "since", "_t.next", "_t.share", "_t.hours")
