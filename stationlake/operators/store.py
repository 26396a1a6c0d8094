"""Keyed tables as DataFrames: what a relational store does by upsert, insert-ignore, delete and copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ids of new rows that are numbered together.
RANGE = 1 << 20


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r")).select(*keys, "r.*")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def delete_listed(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone, keys, "left_anti")


def clear_if(changed: Column, column: str) -> Column:
    return F.when(~changed, F.col(column))


def append_numbered(rows: DataFrame, new: DataFrame, id_col: str) -> DataFrame:
    """``new`` gets ids that follow the highest, in the order of its own. Rows are numbered within ranges of ids; a range starts
    where the counts of those before it end, so only one row a range is in one window."""
    top = rows.agg(F.max(id_col).alias("_top"))
    ranged = new.withColumn("_range", F.floor(F.col(id_col) / RANGE))
    starts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    numbered = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_range").orderBy(id_col)))
    numbered = numbered.join(starts, "_range").crossJoin(F.broadcast(top))
    numbered = numbered.withColumn(id_col, F.col("_top") + F.col("_start") + F.col("_k")).select(*new.columns)
    return rows.unionByName(numbered)
