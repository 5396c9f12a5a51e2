"""Earlier applications with the same lender."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.functions.nullsafe import share
from loanloom.operators.application import ID
from loanloom.operators.asof import date_rules, visible
from loanloom.operators.contracts import Rule, count_as, duplicate_keys, enforce, union_reports, violation_counts

LOAN = "SK_ID_PREV"
# Recognized outcomes of an earlier application.
OUTCOMES = ["Approved", "Refused", "Canceled", "Unused offer"]


def previous_checks(previous: DataFrame) -> DataFrame:
    known = F.coalesce(F.col("NAME_CONTRACT_STATUS").isin(OUTCOMES), F.lit(False))
    rules = date_rules("DAYS_DECISION") + [
        Rule("Unknown previous application status", visible("DAYS_DECISION") & ~known)
    ]
    return union_reports(
        [
            count_as(duplicate_keys(previous, [LOAN]), "Missing or duplicate previous application"),
            violation_counts(previous, rules),
        ]
    )


def previous_features(previous: DataFrame, *, validate: bool = True) -> DataFrame:
    if validate:
        enforce(previous_checks(previous))
    outcome, day = F.col("NAME_CONTRACT_STATUS"), F.col("DAYS_DECISION")
    return (
        previous.where(visible("DAYS_DECISION"))
        .groupBy(ID)
        .agg(
            F.count(LOAN).alias("previous_application_count"),
            F.count_if(outcome == "Approved").alias("previous_approved_count"),
            F.count_if(outcome == "Refused").alias("previous_refused_count"),
            share(outcome == "Refused").alias("previous_refusal_rate"),
            F.count_if(day >= -365).alias("previous_applications_365d"),
            F.min(-day).alias("days_since_previous_application"),
        )
    )
