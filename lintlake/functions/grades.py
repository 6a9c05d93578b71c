"""Severities, scores and grades as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Order of severities, weights and bounds.
SEVERITIES = ("critical", "high", "medium", "low", "info")
WEIGHTS = {"critical": 25, "high": 15, "medium": 5, "low": 1, "info": 0}


def severity_rank(severity: Column) -> Column:
    """0 for critical to 4 for info, 5 for anything else (unknown last)."""
    out = F
    for rank, name in enumerate(SEVERITIES):
        out = out.when(F.lower(severity) == name, rank)
    return out.otherwise(len(SEVERITIES))


def banded(score: Column, bounds: tuple[int, int, int, int]) -> Column:
    out = F
    for bound, grade in zip(bounds, "ABCD"):
        out = out.when(score >= bound, grade)
    return out.otherwise("F")


def security_score(counts: dict[str, Column]) -> Column:
    lost = sum((counts[s] * WEIGHTS[s] for s in SEVERITIES[1:]), counts["critical"] * WEIGHTS["critical"])
    return F.greatest(F.lit(0), F.lit(100) - lost).cast("int")


def security_grade(score: Column) -> Column:
    return banded(score, (90, 75, 60, 40))


def editor_grade(score: Column) -> Column:
    return banded(score, (90, 80, 70, 60))


def function_risk(cyclomatic: Column, length: Column, nesting: Column) -> Column:
    over = lambda c, n, d: F.coalesce(cyclomatic > c, F.lit(False)) | F.coalesce(length > n, F.lit(False)) | F.coalesce(nesting > d, F.lit(False))
    return F.when(over(20, 100, 6), "high").when(over(10, 50, 4), "medium").otherwise("low")


def complexity_grade(average: Column, high: Column) -> Column:
    return F.when((average <= 5) & (high == 0), "A").when((average <= 10) & (high <= 2), "B").when((average <= 20) & (high <= 5), "C").when(average <= 25, "D").otherwise("F")


def complexity_score(average: Column, high: Column) -> Column:
    base = F.greatest(F.lit(0.0), F.lit(100.0) - average * 4) - high * 5
    return F.greatest(F.lit(0), F.least(F.lit(100), base.cast("int")))


def developer_score(reviews: Column, fixes: Column, security: Column, violations: Column, average: Column) -> Column:
    """average is the rounded one; the result is not rounded."""
    return reviews * 10 + fixes * 5 - security * 8 - violations * 3 - F.greatest(F.lit(0.0), average - 10) * 4


def half_even_1(value: Column) -> Column:
    """Rounding to one decimal by the exact binary value, ties to even.

    Ten times the value is 8 v + 2 v, both exact; s is their rounded sum and what was lost is known exactly, so the
    distance of ten times the value from the middle between two whole numbers has a sure sign."""
    s = value * 8 + value * 2
    lost = value * 2 - (s - value * 8)
    below = F.floor(s).cast("double")
    over = s - below - 0.5
    up = F.when(over + lost > 0, 1.0).when(over + lost < 0, 0.0).otherwise(F.pmod(below, F.lit(2.0)))
    return F.when(F.isnan(value) | value.isNull() | (F.abs(value) >= 1e15), value).otherwise((below + up) / 10)


def cvss_severity(score: Column) -> Column:
    number = score.try_cast("double")
    return F.when(number.isNull(), "unknown").when(number >= 9, "critical").when(number >= 7, "high").when(number >= 4, "medium").otherwise("low")


def at_least(severity: Column, threshold: str, order: tuple[str, ...] = ("low", "medium", "high", "critical")) -> Column:
    """Severity from the threshold on; an unknown threshold lets nothing through."""
    if threshold not in order:
        return F.lit(False)
    return F.coalesce(F.lower(severity).isin(*order[order.index(threshold) :]), F.lit(False))
