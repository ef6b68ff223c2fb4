"""Quantile conventions over arrays; they differ, so each has its own name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(sorted_values: Column, index: Column) -> Column:
    return F.get(sorted_values, index.cast("int"))


def upper_median(values: Column) -> Column:
    """``s[n // 2]``."""
    return _at(F.array_sort(values), F.floor(F.size(values) / 2))


def lower_median(values: Column) -> Column:
    """``s[(n - 1) // 2]``."""
    return _at(F.array_sort(values), F.floor((F.size(values) - 1) / 2))


def averaging_median(values: Column) -> Column:
    return (lower_median(values) + upper_median(values)) / 2


def nearest_lower(values: Column, q: float) -> Column:
    """``s[int(q * (n - 1))]``."""
    return _at(F.array_sort(values), F.floor(F.lit(q) * (F.size(values) - 1)))


def linear(values: Column, q: float) -> Column:
    """Linear interpolation between the two nearest ranks."""
    s, at = F.array_sort(values), F.lit(q) * (F.size(values) - 1)
    low, high = _at(s, F.floor(at)), _at(s, F.ceil(at))
    return low + (high - low) * (at - F.floor(at))


def tail_rms(values: Column, fraction: float = 0.05, normaliser: float = 2.3616) -> Column:
    """Root mean square of the largest values, as a standard deviation of normal noise."""
    n = F.greatest(F.lit(1), F.rint(F.size(values) * fraction)).cast("int")
    top = F.slice(F.sort_array(values, asc=False), F.lit(1), n)
    return F.sqrt(F.aggregate(top, F.lit(0.0), lambda a, x: a + x * x) / F.size(top)) / normaliser
