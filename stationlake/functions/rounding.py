"""Rounding as the station's figures are rounded: halves go up, also below zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """From four digits on, ties get a nudge, so that the order in which a sum was added up doesn't decide them."""
    scale = float(10**digits)
    return F.floor(x * scale + (0.5 if digits < 4 else 0.500001)) / scale


def upper_median(values: Column) -> Column:
    """Element n // 2 of the sorted array, counted from 0; null if it is empty."""
    ordered = F.array_sort(values)
    return F.when(F.size(ordered) > 0, F.get(ordered, F.floor(F.size(ordered) / 2).cast("int")))
