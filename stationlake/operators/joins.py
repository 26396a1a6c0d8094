"""Joins on time: as of, nearest within a tolerance, intervals. The first two are a union sorted within a key and period, the last is an
equality join on time buckets with a condition, so neither side is compared with all of the other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, keys: list[str], tolerance: int, left_time: str, right_time: str, pick: str, period: int = 86400) -> DataFrame:
    """``left`` with ``pick`` of the nearest ``right`` row within ``tolerance``; ties go to the earlier one, none gives null. One union, sorted within a key and ``period`` both
    ways, gives each row its neighbours, so no pairs are made however dense both sides are; rows of ``right`` near the end of a period go to the next one, too."""
    t = F.col(right_time)
    periods = F.sequence(F.floor((t - tolerance) / period), F.floor((t + tolerance) / period))
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in [*keys, right_time]))
    r = right.filter(known).select(*keys, t.alias("_t"), F.lit(0).alias("_side"), F.struct(t.alias("t"), F.col(pick).alias("pick")).alias("_right"), F.explode(periods).alias("_p"))
    l = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.floor(F.col(left_time) / period).alias("_p"))  # noqa: E741
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_p")
    upto = lambda time: F.last("_right", ignorenulls=True).over(w.orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumns({"_before": upto(F.col("_t")), "_after": upto(F.desc("_t"))}).filter("_side = 1")
    back, ahead = F.col("_t") - F.col("_before.t"), F.col("_after.t") - F.col("_t")
    found = F.when((back <= tolerance) & (ahead.isNull() | (back <= ahead)), F.col("_before.pick")).when(ahead <= tolerance, F.col("_after.pick"))
    return met.select("_left.*", found.alias(pick))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, pick: list[str], period: int = 86400) -> DataFrame:
    """``left`` with the latest ``right`` row at or before it: one union and one sort within a key and ``period``, no pairs. What a period starts
    with is the last row of those before it, found among one row a period."""
    a = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(F.struct(*pick).alias("s")).schema["s"].dataType).alias("_right"))
    b = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), F.struct(*pick).alias("_right"))
    both = a.unionByName(b).withColumn("_p", F.floor(F.col("_t") / period))
    ends = both.groupBy(*keys, "_p").agg(F.max_by("_right", F.when(F.col("_right").isNotNull(), F.col("_t"))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "_p", F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    w = Window.partitionBy(*keys, "_p").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_right", F.last("_right", ignorenulls=True).over(w)).filter("_side = 1").join(ends, [*keys, "_p"], "left")
    both = both.withColumn("_right", F.coalesce("_right", "_before"))
    return both.select("_left.*", *(F.col(f"_right.{c}").alias(c) for c in pick))


def overlap(left: DataFrame, right: DataFrame, keys: list[str], left_ends: tuple[str, str], right_ends: tuple[str, str], width: int) -> DataFrame:
    """Pairs of half-open intervals [start, end) that overlap. Both sides are dealt over buckets of ``width``; a pair is
    kept in the first bucket they share only."""
    (ls, le), (rs, re_) = left_ends, right_ends
    deal = lambda df, s, e, name: df.withColumn(
        name, F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
    )
    l, r = deal(left, ls, le, "_b"), deal(right, rs, re_, "_b")  # noqa: E741
    pairs = l.join(r, [*keys, "_b"]).filter((F.col(ls) < F.col(re_)) & (F.col(rs) < F.col(le)))
    return pairs.filter(F.col("_b") == F.floor(F.greatest(ls, rs) / width)).drop("_b")
