"""Loan arithmetic and display scales as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loanloom.functions.nullsafe import is_finite

# Default-probability bands on the unrounded probability.
LOW_BELOW = 0.05
MEDIUM_BELOW = 0.15

# Share of monthly income behind each suggested loan range.
LOAN_RANGES = (
    ("Conservative Loan Range", 0.10, 0.20),
    ("Moderate Loan Range", 0.20, 0.25),
    ("Maximum Suggested Loan Range", 0.25, 0.30),
)

LEVELS = ("Low", "Moderate", "High")


def annuity_payment(principal: Column, months: Column, annual_rate_percent: Column) -> Column:
    """Level monthly payment rounded half-up to cents; straight line (in decimals) at a zero rate."""
    p = principal.cast("double")
    n = months.cast("double")
    monthly = annual_rate_percent.cast("double") / 1200
    level = p * monthly / (1 - F.pow(1 + monthly, -n))
    straight = F.round(principal.cast("decimal(14,2)") / months.cast("decimal(4,0)"), 2).cast("decimal(16,2)")
    return F.when(annual_rate_percent == 0, straight).otherwise(F.round(level, 2).cast("decimal(16,2)"))


def raw_annuity(principal: Column, months: Column, annual_rate: float = 0.12) -> Column:
    """Unrounded monthly payment for display estimates (rate as a fraction)."""
    p = principal.cast("double")
    n = months.cast("double")
    if annual_rate == 0:
        return p / n
    monthly = annual_rate / 12
    return p * F.lit(monthly) / (1 - F.pow(F.lit(1 + monthly), -n))


def valid_probability(p: Column) -> Column:
    return is_finite(p) & p.between(0, 1)


def risk_score(p: Column) -> Column:
    return F.round(100 * p, 2)


def health_index(p: Column) -> Column:
    return F.round(100 * (1 - p), 2)


def risk_band(p: Column) -> Column:
    return F.when(p < LOW_BELOW, "Low").when(p < MEDIUM_BELOW, "Medium").when(p.isNotNull(), "High")


def relative_level(p: Column, low_below: float, high_at: float) -> Column:
    """Relative presentation level against two cut-offs of a reference cohort."""
    return F.when(p < low_below, "Low").when(p < high_at, "Moderate").when(p.isNotNull(), "High")


def affordability_score(burden: Column) -> Column:
    """100 up to a 20% burden, 50 at 40%, falling to 0 at 100% and beyond."""
    return (
        F.when(burden <= 0.2, F.lit(100.0))
        .when(burden <= 0.4, 100 - (burden - 0.2) * 250)
        .when(burden.isNotNull(), F.greatest(F.lit(0.0), 50 - (burden - 0.4) * (50 / 0.6)))
    )


def affordability_level(burden: Column) -> Column:
    return F.when(burden <= 0.2, "Low").when(burden <= 0.4, "Moderate").when(burden.isNotNull(), "High")


def level_rank(level: Column) -> Column:
    """Position of a level on the Low < Moderate < High scale."""
    return F.when(level == "Low", 0).when(level == "Moderate", 1).when(level == "High", 2)


def worse_level(left: Column, right: Column) -> Column:
    """The more severe of two levels; null unless both are known."""
    severity = F.greatest(level_rank(left), level_rank(right))
    known = left.isNotNull() & right.isNotNull()
    return F.when(known, F.element_at(F.array(*[F.lit(v) for v in LEVELS]), severity + 1))
