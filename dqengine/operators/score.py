"""Health score (H1), sub-scores (H2), UI fallbacks and bands (H3-H7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.scalar import py_round, safe_div


def _deduct(score: Column, cap_weight: tuple[float, float], x: Column) -> Column:
    cap, weight = cap_weight
    return score - F.least(F.lit(cap), x * F.lit(weight))


def raw_health(missing_pct: Column, duplicate_rows: Column, total_rows: Column,
               outlier_count: Column, dropped_count: Column, flag_count: Column) -> Column:
    """H1 before rounding: 100 minus five capped deductions, in order."""
    s = F.lit(100.0)
    s = _deduct(s, C.SCORE_MISSING, missing_pct)
    s = _deduct(s, C.SCORE_DUPLICATES, safe_div(duplicate_rows, total_rows) * F.lit(100.0))
    s = _deduct(s, C.SCORE_OUTLIERS, safe_div(outlier_count, total_rows) * F.lit(100.0))
    s = _deduct(s, C.SCORE_DROPPED, dropped_count.cast("double"))
    s = _deduct(s, C.SCORE_FLAGS, flag_count.cast("double"))
    return s


def health_score(*args: Column) -> Column:
    """H1: half-even round, floor 10."""
    return F.greatest(F.lit(C.SCORE_FLOOR), F.bround(raw_health(*args), 0).cast("int")).cast("int")


def completeness_score(missing_pct: Column) -> Column:
    """H2."""
    return py_round(F.greatest(F.lit(0.0), F.lit(100.0) - missing_pct * F.lit(2.0)), 1)


def _rate_score(count: Column, total_rows: Column, weight: float) -> Column:
    x = F.lit(100.0) - (safe_div(count, total_rows) * F.lit(100.0) * F.lit(weight))
    return F.when(total_rows > 0, py_round(F.greatest(F.lit(0.0), x), 1)).otherwise(F.lit(100.0))


def consistency_score(duplicate_rows: Column, total_rows: Column) -> Column:
    return _rate_score(duplicate_rows, total_rows, 4.0)


def noise_score(outlier_count: Column, total_rows: Column) -> Column:
    return _rate_score(outlier_count, total_rows, 1.5)


# -- H3: the UI's fallbacks when a stored report lacks a sub-score ----------
def completeness_fallback(stored: Column, missing_pct: Column) -> Column:
    return F.coalesce(stored, F.lit(100.0) - missing_pct)


def consistency_fallback(stored: Column, duplicate_rows: Column) -> Column:
    return F.coalesce(stored, F.greatest(F.lit(0.0), F.lit(100.0) - duplicate_rows.cast("double")))


def noise_fallback(stored: Column, outlier_count: Column, total_rows: Column) -> Column:
    return F.coalesce(stored, F.greatest(F.lit(0.0), F.lit(100.0) - (
        outlier_count.cast("double") / F.greatest(total_rows, F.lit(1)).cast("double") * F.lit(100.0))))


# -- H4-H7: bands ------------------------------------------------------------
def score_band(score: Column) -> Column:
    """H4: >= 80 High, >= 60 Moderate, else Poor."""
    return F.when(score >= 80, "High").when(score >= 60, "Moderate").otherwise("Poor")


def missing_band(missing_pct: Column) -> Column:
    """H5: > 20 high, > 10 medium, else low."""
    m = F.coalesce(missing_pct, F.lit(0.0))
    return F.when(m > 20, "high").when(m > 10, "medium").otherwise("low")


def correlation_band(value: Column) -> Column:
    """H6: |r| > 0.7 strong, > 0.4 moderate, else weak."""
    a = F.abs(value)
    return F.when(a > 0.7, "strong").when(a > 0.4, "moderate").otherwise("weak")


def column_missing_alert(missing_pct: Column) -> Column:
    """H7: a column's missing share is highlighted above 10 %."""
    return F.coalesce(missing_pct, F.lit(0.0)) > 10


def outlier_band(outlier_pct: Column) -> Column:
    """H7: outliers shown when > 0, red when > 5."""
    o = F.coalesce(outlier_pct, F.lit(0.0))
    return F.when(o > 5, "red").when(o > 0, "shown").otherwise("hidden")


def overall_missing_alert(missing_pct: Column) -> Column:
    """H7: the report's missing-cells tile turns red above 10 %."""
    return F.coalesce(missing_pct, F.lit(0.0)) > 10
