"""Arithmetic and comparison by IEEE rules, where Spark's own differ: NaN compares false, and x/0 is no error."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F



def divide(a: Column, b: Column) -> Column:
    by_zero = F.when(a > 0, F.when(F.isnan(a), math.nan).otherwise(math.inf)).when(a < 0, -math.inf).otherwise(math.nan)
    return F.when(b != 0, a / b).otherwise(F.when(a.isNull() | b.isNull(), None).otherwise(by_zero))


def compare(op: str, a: Column, b: Column) -> Column:
    """Spark takes NaN for the greatest number and equal to itself."""
    if op == "!=":
        return (a != b) | F.isnan(a) | F.isnan(b)
    number = ~F.isnan(a) & ~F.isnan(b)
    return number & {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b, "==": a == b}[op]


def finite(a: Column) -> Column:
    return ~F.isnan(a) & (F.abs(a) < math.inf)


def root_of_positive(a: Column) -> Column:
    """The square root of max(a, 0), where NaN counts as 0."""
    return F.sqrt(F.when(F.isnan(a) | (a < 0), 0.0).otherwise(a))


def wide(a: Column) -> Column:
    return a.cast("double")


def clip(a: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), a))
