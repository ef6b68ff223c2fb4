"""Exact rationals as pairs of longs; nothing here goes through a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _div(n: Column, d: Column) -> Column:
    return F.call_function("div", n, d)


def floor_div(n: Column, d: Column) -> Column:
    """Floor division (Spark's ``div`` cuts towards zero); ``d`` is positive."""
    return _div(n - F.pmod(n, d), d)


def half_even(n: Column, d: Column) -> Column:
    """``n / d`` rounded half to even, as Python's ``round`` of a fraction."""
    q = floor_div(n, d)
    twice = (n - q * d) * 2
    return F.when(twice < d, q).when(twice > d, q + 1).otherwise(q + F.pmod(q, F.lit(2)))
