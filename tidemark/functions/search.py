"""Binary search in a sorted list of constants, as one expression that stays in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def rank_of(value: Column, limits: Sequence) -> Column:
    """How many of the sorted ``limits`` are at most ``value``; null for null."""

    def find(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        half = (lo + hi) // 2
        return F.when(value < F.lit(limits[half]), find(lo, half)).otherwise(find(half + 1, hi))

    return F.when(value.isNotNull(), find(0, len(limits)))
