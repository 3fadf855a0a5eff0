"""Banding rules and derived measures as reusable column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band edges and labels of the published vocabulary.
AGE_BELOW = ((26, "18-25"), (36, "26-35"), (46, "36-45"), (56, "46-55"), (66, "56-65"))
AGE_TOP = "65+"
SCORE_FROM = ((800, "EXCELLENT"), (750, "GOOD"), (700, "FAIR"), (650, "POOR"))
SCORE_REST = "VERY_POOR"
DPD_UP_TO = ((0, "CURRENT"), (30, "DPD_1_30"), (60, "DPD_31_60"), (90, "DPD_61_90"))
DPD_REST = "DPD_90_PLUS"
LATE_UP_TO = ((0, "ON_TIME"), (30, "LATE_1_30"))
LATE_REST = "LATE_30_PLUS"
VALUE_FROM = ((5_000_000, "Premium"), (1_500_000, "HNI"), (300_000, "Affluent"))
VALUE_REST = "Mass"
RISK_FROM = ((750, "Low"), (650, "Medium"))
RISK_REST = "High"
RISK_MISSING = "Unknown"
RISK_BAND_BELOW = ((25, "LOW"), (50, "MEDIUM"), (75, "HIGH"))
RISK_BAND_REST = "VERY_HIGH"
NPA_FROM_DPD = 90


def _steps(tests: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    chain = F
    for condition, label in tests:
        chain = chain.when(condition, F.lit(label))
    return chain.otherwise(F.lit(otherwise))


def at_least(value: Column, edges: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first edge the value reaches (edges listed from the highest down)."""
    return _steps([(value >= edge, label) for edge, label in edges], otherwise)


def below(value: Column, edges: Sequence[tuple[float, str]], otherwise: str) -> Column:
    return _steps([(value < edge, label) for edge, label in edges], otherwise)


def calendar_years(since: Column, as_of: date) -> Column:
    """Count of year boundaries crossed, not completed years of age."""
    return (F.lit(as_of.year) - F.year(since)).cast("int")


def age_band(age: Column) -> Column:
    """A missing age lands in the top band, as the published product has it."""
    return below(age, AGE_BELOW, AGE_TOP)


def score_band(score: Column) -> Column:
    return at_least(score, SCORE_FROM, SCORE_REST)


def dpd_band(dpd: Column) -> Column:
    first, *rest = DPD_UP_TO
    return _steps([(dpd == first[0], first[1]), *[(dpd <= edge, label) for edge, label in rest]], DPD_REST)


def punctuality_band(dpd: Column) -> Column:
    first, *rest = LATE_UP_TO
    return _steps([(dpd == first[0], first[1]), *[(dpd <= edge, label) for edge, label in rest]], LATE_REST)


def value_segment(balance: Column) -> Column:
    return at_least(balance, VALUE_FROM, VALUE_REST)


def risk_category(score: Column) -> Column:
    return F.when(score.isNull(), F.lit(RISK_MISSING)).otherwise(at_least(score, RISK_FROM, RISK_REST))


def risk_band(points: Column) -> Column:
    return below(points, RISK_BAND_BELOW, RISK_BAND_REST)


def risk_points(score: Column, worst_dpd: Column, burden: Column, has_npa: Column) -> Column:
    """Additive scorecard capped at 100; every term can be explained on its own."""
    bureau = F.greatest(F.lit(0.0), F.lit(750) - F.coalesce(score, F.lit(700))) * 0.25
    arrears = F.least(F.coalesce(worst_dpd, F.lit(0)), F.lit(180)) * 0.25
    affordability = F.greatest(F.lit(0.0), burden - 0.30) * 100
    impaired = F.when(has_npa, F.lit(40)).otherwise(F.lit(0))
    return F.least(F.lit(100.0), bureau + arrears + affordability + impaired)


def flag(condition: Column) -> Column:
    """TRUE when the condition holds, FALSE when it does not or cannot be told."""
    return F.coalesce(condition, F.lit(False))


def ratio(numerator: Column, denominator: Column) -> Column:
    """NULL instead of a division by zero."""
    return numerator / F.nullif(denominator, F.lit(0).cast("double"))


def emi(principal: Column, annual_rate_pct: Column, months: Column) -> Column:
    """Equal monthly instalment of an amortising loan, rounded to the cent.

    Half a cent is common here (a price over a number of months) and a quotient can lie
    just beside it in binary, so the tie is decided on the decimal value.
    """
    rate = annual_rate_pct / 12.0 / 100.0
    growth = F.pow(rate + 1.0, -months)
    exact = F.when(rate > 0, principal * rate / F.nullif(1.0 - growth, F.lit(0.0))).otherwise(principal / months)
    return F.round(exact.cast("decimal(28,10)"), 2).cast("double")


def signed(amount: Column, direction: Column) -> Column:
    return F.when(direction == "DEBIT", -amount).otherwise(amount)


def money(value: Column) -> Column:
    """Whole cents at the product boundary; also hides the order of a parallel sum."""
    return F.round(F.coalesce(value, F.lit(0.0)), 2)


def as_micros(ts: Column) -> Column:
    """Microseconds since the epoch for timestamps with or without a zone."""
    return F.unix_micros(ts.cast("timestamp"))
