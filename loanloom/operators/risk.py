"""Risk display, decision policy and affordability."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.errors import ContractError
from loanloom.functions import finance
from loanloom.functions.nullsafe import ratio
from loanloom.operators.application import CATEGORICAL
from loanloom.operators.prefix import quantile_edges

MODES = ("SANDBOX", "SHADOW", "LIVE")
DISPLAY_RATE = 0.12


@dataclass(frozen=True)
class Policy:
    """Versioned thresholds; only a fully evidenced LIVE policy may decide."""

    version: str = "sandbox-v1"
    mode: str = "SANDBOX"
    approve_below: float | None = 0.05
    reject_at: float | None = 0.15
    validation_report: str | None = None
    approved_by: str | None = None
    model_version: str | None = None
    variant: str | None = None

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ContractError("Invalid policy mode")
        low, high = self.approve_below, self.reject_at
        if (low is None) is not (high is None):
            raise ContractError("Both thresholds must be set or unset")
        if low is not None and not 0 < low < high < 1:
            raise ContractError("Require 0 < approve_below < reject_at < 1")
        evidence = (low is not None, self.validation_report, self.approved_by, self.model_version)
        if self.mode == "LIVE" and not (all(evidence) and self.variant == "full"):
            raise ContractError("Live policy requires a bound full release and approval evidence")


def recommendation(p: Column, policy: Policy, usable: Column) -> Column:
    if policy.approve_below is None:
        return F.lit("MANUAL_REVIEW")
    return (
        F.when(usable & (p < policy.approve_below), "APPROVAL_CANDIDATE")
        .when(usable & (p >= policy.reject_at), "REJECTION_CANDIDATE")
        .otherwise("MANUAL_REVIEW")
    )


def apply_policy(df: DataFrame, policy: Policy, score: str = "p") -> DataFrame:
    """Recommendation, final status and display values for scored rows.

    The frame carries the decision context per row: variant, model_version,
    release_ready, data_valid, supported, verified, affordable, product_eligible.
    """
    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    p = F.col(score)
    usable = flag("data_valid") & flag("supported")
    advice = recommendation(p, policy, usable)
    bound = F.coalesce(F.col("model_version") == policy.model_version, F.lit(False)) if policy.model_version else F.lit(False)
    may_decide = (
        F.lit(policy.mode == "LIVE") & (F.col("variant") == "full") & flag("release_ready") & bound & usable
        & flag("verified") & flag("product_eligible")
    )
    final = (
        F.when(may_decide & (advice == "REJECTION_CANDIDATE"), "REJECTED")
        .when(may_decide & (advice == "APPROVAL_CANDIDATE") & flag("affordable"), "APPROVED")
        .otherwise("MANUAL_REVIEW")
    )
    return df.withColumns(
        {
            "recommendation": advice, "decision_status": final, "policy_version": F.lit(policy.version),
            "mode": F.lit(policy.mode), "risk_band": finance.risk_band(p), "risk_score": finance.risk_score(p),
            "credit_health_index": finance.health_index(p),
        }
    )


def support_statistics(df: DataFrame, numeric: Sequence[str]) -> dict:
    """Observed categories, numeric ranges and missing tenure of the development rows.

    Categories come from closed vocabularies, so what reaches the driver is bounded.
    """
    row = df.agg(
        *[F.collect_set(c).alias(f"set_{c}") for c in CATEGORICAL],
        *[F.min(c).cast("double").alias(f"min_{c}") for c in numeric],
        *[F.max(c).cast("double").alias(f"max_{c}") for c in numeric],
        F.bool_or(F.col("years_employed").isNull()).alias("tenure_missing"),
    ).first()
    return {
        "categories": {c: sorted(row[f"set_{c}"]) for c in CATEGORICAL},
        "ranges": {c: (row[f"min_{c}"], row[f"max_{c}"]) for c in numeric if row[f"min_{c}"] is not None},
        "tenure_missing": bool(row["tenure_missing"]),
    }


def support_flags(statistics: Mapping) -> Column:
    """Array of reasons why a row lies outside what the model has seen."""
    flags = []
    for c in CATEGORICAL:
        seen = statistics["categories"].get(c, [])
        unseen = ~F.coalesce(F.col(c).isin(seen), F.lit(False)) if seen else F.lit(True)
        flags.append(F.when((F.col(c) == "OTHER") | unseen, F.lit(f"unsupported_category:{c}")))
    for c, (low, high) in statistics["ranges"].items():
        outside = (F.col(c) < low) | (F.col(c) > high)
        flags.append(F.when(outside, F.lit(f"outside_development_range:{c}")))
    if not statistics["tenure_missing"]:
        flags.append(F.when(F.col("years_employed").isNull(), F.lit("unseen_missing_tenure")))
    return F.array_compact(F.array(*flags))


def relative_cutoffs(reference: DataFrame, score: str = "p") -> tuple[float, float]:
    """33rd and 66th percentile of a reference cohort."""
    low, high = quantile_edges(reference, score, [0.33, 0.66])
    return low, high


def affordability(df: DataFrame) -> DataFrame:
    """Burden, level, score and the largest suggested payment.

    Needs annual_income, principal, months and emi (the quote, or null for a 12% estimate).
    """
    monthly = F.col("annual_income").cast("double") / 12
    estimated = F.coalesce(F.col("emi").cast("double"), finance.raw_annuity(F.col("principal"), F.col("months"), DISPLAY_RATE))
    usable = (F.col("annual_income") > 0) & (F.col("principal") > 0) & (F.col("months") >= 1)
    emi = F.when(usable & (estimated > 0), estimated)
    burden = ratio(emi, monthly)
    return df.withColumns(
        {
            "monthly_income": F.when(emi.isNotNull(), monthly), "emi": emi, "burden": burden,
            "affordability_level": finance.affordability_level(burden),
            "affordability_score": finance.affordability_score(burden),
            "recommended_max_emi": F.when(emi.isNotNull(), monthly * 0.3),
        }
    )


def loan_ranges(df: DataFrame) -> DataFrame:
    """Three suggested principal ranges per row, exploded inside the task.

    Needs annual_income and months; ranges with a bound that rounds to zero are hidden.
    """
    monthly = F.col("annual_income").cast("double") / 12
    per_emi = (1 - F.pow(F.lit(1 + DISPLAY_RATE / 12), -F.col("months").cast("double"))) / (DISPLAY_RATE / 12)
    options = F.array(
        *[
            F.struct(
                F.lit(i).alias("range_no"), F.lit(label).alias("label"),
                (monthly * low * per_emi).alias("range_min"), (monthly * high * per_emi).alias("range_max"),
            )
            for i, (label, low, high) in enumerate(finance.LOAN_RANGES, 1)
        ]
    )
    shown = F.forall(options, lambda r: (F.round(r["range_min"]) > 0) & (F.round(r["range_max"]) > 0))
    kept = df.withColumn("_ranges", options).where((F.col("annual_income") > 0) & shown)
    return kept.select(*df.columns, F.explode("_ranges").alias("_r")).select(*df.columns, "_r.*")


def matching_range(df: DataFrame) -> DataFrame:
    """Where the requested principal falls: first matching range, below, above or none."""
    monthly = F.col("annual_income").cast("double") / 12
    per_emi = (1 - F.pow(F.lit(1 + DISPLAY_RATE / 12), -F.col("months").cast("double"))) / (DISPLAY_RATE / 12)
    p = F.col("principal").cast("double")
    place = F.when(p < monthly * finance.LOAN_RANGES[0][1] * per_emi, F.lit("below"))
    for label, low, high in finance.LOAN_RANGES:
        place = place.when((p >= monthly * low * per_emi) & (p <= monthly * high * per_emi), F.lit(label))
    return df.withColumn("matching_range", F.when(F.col("annual_income") > 0, place.otherwise("above")))


def combined_level(df: DataFrame, low_below: float, high_at: float, score: str = "p") -> DataFrame:
    """Worse of the relative model level and the affordability level, with an override flag."""
    model = finance.relative_level(F.col(score), low_below, high_at)
    burden_level = F.col("affordability_level")
    overridden = F.coalesce(finance.level_rank(burden_level) > finance.level_rank(model), F.lit(False))
    return df.withColumns(
        {"model_level": model, "final_level": finance.worse_level(model, burden_level), "overridden": overridden}
    )
