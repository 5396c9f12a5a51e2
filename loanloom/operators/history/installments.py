"""Installment behaviour from the contractual schedule and payment events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.errors import ContractError
from loanloom.functions.nullsafe import MINOR_SCALE, is_finite, ratio, share, to_minor
from loanloom.operators.application import ID
from loanloom.operators.asof import AVAILABLE, collapse_replays, date_rules, visible
from loanloom.operators.contracts import (
    Rule, conflicting_owners, count_as, duplicate_keys, enforce, union_reports, violation_counts,
)
from loanloom.operators.reconcile import daily_totals, settle

LOAN = "SK_ID_PREV"
KEYS = [ID, LOAN, "NUM_INSTALMENT_NUMBER", "NUM_INSTALMENT_VERSION"]
PAYMENT = "PAYMENT_ID"
PAYMENT_COLUMNS = [*KEYS, "DAYS_ENTRY_PAYMENT", "AMT_PAYMENT", AVAILABLE]


def unique_payments(payments: DataFrame) -> DataFrame:
    """Replayed events reduced to one row; ``conflicting`` marks copies that disagree."""
    repeated = [c for c in ("DAYS_INSTALMENT", "AMT_INSTALMENT") if c in payments.columns]
    return collapse_replays(payments, PAYMENT, PAYMENT_COLUMNS + repeated)


def installment_checks(payments: DataFrame, schedule: DataFrame) -> DataFrame:
    """All schedule and payment rules, in the order in which they stop a build."""
    effective = schedule.where(visible(AVAILABLE, None))
    terms = [
        Rule("Invalid contractual schedule",
             ~is_finite(F.col("DAYS_INSTALMENT")) | ~is_finite(F.col("AMT_INSTALMENT"))
             | (F.col("AMT_INSTALMENT") <= 0)),
    ]
    events = unique_payments(payments)
    past = events.where(visible("DAYS_ENTRY_PAYMENT"))
    amounts = [
        Rule("Unknown/negative payments need reversal reconciliation",
             visible("DAYS_ENTRY_PAYMENT") & (~is_finite(F.col("AMT_PAYMENT")) | (F.col("AMT_PAYMENT") < 0))),
    ]
    identity = [
        Rule("Conflicting duplicate payment identity", F.col("conflicting")),
        Rule("Missing payment event identity", F.col(PAYMENT).isNull()),
    ]
    known = effective.select(*KEYS).distinct()
    reports = [
        count_as(duplicate_keys(schedule, KEYS), "Missing or duplicate schedule key"),
        violation_counts(schedule, date_rules(AVAILABLE, None)),
        count_as(conflicting_owners(effective, LOAN, ID), "Conflicting installment loan owner"),
        count_as(effective.groupBy(*KEYS[:3]).count().where("count > 1"), "Ambiguous effective schedule versions"),
        violation_counts(effective, terms),
        violation_counts(events, identity + date_rules("DAYS_ENTRY_PAYMENT") + amounts),
        count_as(past.select(*KEYS).distinct().join(known, KEYS, "left_anti"),
                 "Payment references unknown effective schedule"),
    ]
    stated = [c for c in ("DAYS_INSTALMENT", "AMT_INSTALMENT") if c in payments.columns]
    if stated:
        claims = past.select(*KEYS, *[F.col(c).alias(f"_said_{c}") for c in stated]).distinct()
        paired = claims.join(effective.select(*KEYS, *stated), KEYS)
        differs = F.lit(False)
        for c in stated:
            differs = differs | ~F.coalesce(F.abs(F.col(f"_said_{c}") - F.col(c)) <= 1e-8, F.lit(False))
        reports.append(count_as(paired.where(differs), "Conflicting installment schedule amounts/dates"))
    return union_reports(reports)


def obligation_outcomes(payments: DataFrame, schedule: DataFrame, *, tolerance: float = 0.01) -> DataFrame:
    """Due obligations (day <= 0) with completion day and exact paid amounts."""
    if not 0 <= tolerance <= 0.01:
        raise ContractError("Invalid minor-unit tolerance")
    effective = schedule.where(visible(AVAILABLE, None)).withColumn("_owed_minor", to_minor(F.col("AMT_INSTALMENT")))
    past = unique_payments(payments).where(visible("DAYS_ENTRY_PAYMENT"))
    daily = daily_totals(
        past.select(*KEYS, "DAYS_ENTRY_PAYMENT", to_minor(F.col("AMT_PAYMENT")).alias("_minor")),
        KEYS, "DAYS_ENTRY_PAYMENT", "_minor",
    )
    settled = settle(
        effective.where(F.col("DAYS_INSTALMENT") <= 0), daily, KEYS, due_day="DAYS_INSTALMENT",
        due_amount="_owed_minor", day="DAYS_ENTRY_PAYMENT", amount="_minor",
        tolerance=round(tolerance * MINOR_SCALE),
    )
    return settled


def behaviour(outcomes: DataFrame, group: list[str], due: str = "DAYS_INSTALMENT", owed: str = "_owed_minor") -> DataFrame:
    """Nine installment features per group from settled obligations."""
    done, due_day = F.col("completion"), F.col(due)
    delay = done - due_day
    open_overdue = done.isNull() & (due_day < 0)
    late = F.coalesce(delay > 0, F.lit(False)) | open_overdue
    overdue = F.greatest(F.coalesce(done, F.lit(0)) - due_day, F.lit(0))
    return outcomes.groupBy(*group).agg(
        F.count(F.lit(1)).alias("installment_due_count"),
        F.count_if(done.isNotNull()).alias("installment_fully_paid_count"),
        F.count_if(late).alias("installment_late_count"),
        F.count_if(open_overdue).alias("installment_unpaid_overdue_count"),
        share(late).alias("installment_late_rate"),
        F.avg(delay).alias("installment_mean_signed_delay"),
        F.avg(overdue).alias("installment_mean_overdue_days"),
        F.max(overdue).alias("installment_max_overdue_days"),
        F.avg(F.least(ratio(F.col("paid"), F.col(owed)), F.lit(1.0))).alias("installment_mean_paid_ratio"),
    )


def installment_features(
    payments: DataFrame, schedule: DataFrame, *, tolerance: float = 0.01, validate: bool = True
) -> DataFrame:
    if validate:
        enforce(installment_checks(payments, schedule))
    return behaviour(obligation_outcomes(payments, schedule, tolerance=tolerance), [ID])
