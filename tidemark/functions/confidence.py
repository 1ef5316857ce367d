"""Confidence curves and tier ladders. The ladders differ on purpose: each stage has its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def evidence(n: Column, scale: float, floor: float = 0.3) -> Column:
    """Saturating curve of the number of observations, at most 0.95."""
    return F.least(F.lit(0.95), floor + (1 - floor) * (1 - F.exp(-n / scale)))


def confidence(n: Column, scale: float, reliability: float = 1.0, age_days: Column | None = None, half_life: float = 30.0) -> Column:
    c = reliability * evidence(n, scale)
    return F.round(c if age_days is None else c * F.pow(F.lit(2.0), -age_days / half_life), 4)


def tier_two(n: Column) -> Column:
    """1 from 50, 2 from 10, else 3."""
    return F.when(n >= 50, 1).when(n >= 10, 2).otherwise(3)


def tier_three(n: Column) -> Column:
    """1 from 50, 2 from 20, 3 from 5, else 4."""
    return F.when(n >= 50, 1).when(n >= 20, 2).when(n >= 5, 3).otherwise(4)


def aggregate(values: Column) -> Column:
    """Best value plus a twentieth of the second and third, at most 0.99; values is an array."""
    s = F.sort_array(values, asc=False)
    return F.least(F.lit(0.99), F.coalesce(F.get(s, F.lit(0)), F.lit(0.0)) + 0.05 * (F.coalesce(F.get(s, F.lit(1)), F.lit(0.0)) + F.coalesce(F.get(s, F.lit(2)), F.lit(0.0))))


def route(score: Column) -> Column:
    return F.when(score < 0.1, "skip").when(score < 0.4, "low_priority").otherwise("full_triage")
