"""Seeded random numbers as column expressions: the n-th number of a seed is computed from n, so a series needs no order of making."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 0xFFFFFFFF
#: Fixed value: the step of the mulberry32 generator.
STEP = 0x6D2B79F5


def _product(a: Column, b: Column) -> Column:
    """Low 32 bits of a product of two 32-bit numbers; halves keep it inside a long."""
    low, high = a.bitwiseAND(0xFFFF), F.shiftright(a, 16)
    return (low * b + F.shiftleft((high * b).bitwiseAND(0xFFFF), 16)).bitwiseAND(WORD)


def uniform(seed: Column, n: Column) -> Column:
    """The n-th number (from 1) of mulberry32, from 0 up to 1."""
    t = (seed.cast("long") + n.cast("long") * STEP).bitwiseAND(WORD)
    t = _product(t.bitwiseXOR(F.shiftright(t, 15)), t.bitwiseOR(1))
    u = _product(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(61))
    t = t.bitwiseXOR((t + u).bitwiseAND(WORD))
    return t.bitwiseXOR(F.shiftright(t, 14)) / float(1 << 32)


def gaussian(seed: Column, n: Column) -> Column:
    """Standard normal from the n-th and the next number (Box and Muller); a zero counts as the least number above it."""
    u = F.greatest(uniform(seed, n), F.lit(2.0**-32))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * uniform(seed, n + 1))
