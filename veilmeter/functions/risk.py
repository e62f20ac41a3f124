"""Risk scales, a column function each; the scales differ on purpose and are never merged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def by_auc(auc: Column) -> Column:
    return F.when(auc < 0.55, "low").when(auc < 0.6, "medium").otherwise("high")


def by_ratio(advantage: Column, threshold: Column) -> Column:
    """Advantage over threshold; a threshold that isn't positive raises."""
    ratio = advantage / F.when(threshold > 0, threshold).otherwise(F.raise_error(F.lit("threshold must be positive")).cast("double"))
    return F.when(ratio < 2, "LOW").when(ratio < 3, "MEDIUM").when(ratio < 5, "HIGH").otherwise("CRITICAL")


def by_excess(excess: Column) -> Column:
    return F.when(excess >= 0.30, "CRITICAL").when(excess >= 0.20, "HIGH").when(excess >= 0.10, "MEDIUM").otherwise("LOW")


def by_epsilon(epsilon: Column) -> Column:
    return F.when(epsilon.isNull(), "UNKNOWN").when(epsilon > 10, "CRITICAL").when(epsilon > 3, "HIGH").when(epsilon > 1, "MEDIUM").otherwise("LOW")


def by_budget(epsilon: Column) -> Column:
    return F.when(epsilon <= 1, "LOW").when(epsilon <= 3, "MEDIUM").when(epsilon <= 10, "HIGH").otherwise("CRITICAL")


def by_epsilon_report(epsilon: Column) -> Column:
    return F.when(epsilon <= 1, "LOW").when(epsilon <= 3, "MEDIUM").otherwise("HIGH")


def worse(a: Column, b: Column) -> Column:
    """The higher of two levels; the first where equal; UNKNOWN is below all."""
    rank = lambda x: F.array_position(F.array(*map(F.lit, LEVELS)), x)
    return F.when(rank(b) > rank(a), b).otherwise(a)


def colour(score: Column) -> Column:
    return F.when(score >= 75, "red").when(score >= 58, "amber").otherwise("green")
