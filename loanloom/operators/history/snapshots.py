"""Monthly account snapshots: point-of-sale loans and credit cards.

Both sources are first reduced to one row per loan (a combinable aggregate that
also picks the latest snapshot with ``max_by``) and then to one row per
applicant.  No sort, no window, and a loan or applicant with a large part of all
snapshots is combined before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.functions.nullsafe import known_total, ratio
from loanloom.operators.application import ID
from loanloom.operators.asof import date_rules, latest_value, visible
from loanloom.operators.contracts import (
    Rule, conflicting_owners, count_as, duplicate_keys, enforce, union_reports, violation_counts,
)

LOAN = "SK_ID_PREV"
MONTH = "MONTHS_BALANCE"


def snapshot_checks(df: DataFrame, kind: str) -> DataFrame:
    """Key, owner and domain rules of a snapshot table (``kind`` is POS or card)."""
    rules = date_rules(MONTH) + [Rule(f"Negative {kind} DPD", visible(MONTH) & (F.col("SK_DPD") < 0))]
    if "AMT_CREDIT_LIMIT_ACTUAL" in df.columns:
        rules.append(Rule("Negative credit limit", visible(MONTH) & (F.col("AMT_CREDIT_LIMIT_ACTUAL") < 0)))
    last = df.where(visible(MONTH)).groupBy(LOAN).agg(latest_value(["NAME_CONTRACT_STATUS"], MONTH).alias("_last"))
    return union_reports(
        [
            count_as(duplicate_keys(df, [LOAN, MONTH]), f"Missing or duplicate {kind} month"),
            count_as(conflicting_owners(df, LOAN, ID), f"Conflicting {kind} account owner"),
            violation_counts(df, rules),
            count_as(last.where("_last.NAME_CONTRACT_STATUS is null"), f"Unknown {kind} latest status"),
        ]
    )


def _dpd_columns() -> list[Column]:
    dpd = F.col("SK_DPD")
    return [
        F.count(F.lit(1)).alias("months"),
        F.max(dpd).alias("max_dpd"),
        F.sum(dpd).alias("sum_dpd"),
        F.count(dpd).alias("known_dpd"),
        F.count_if(dpd > 0).alias("late_months"),
    ]


def pos_features(pos: DataFrame, *, validate: bool = True) -> DataFrame:
    if validate:
        enforce(snapshot_checks(pos, "POS"))
    per_loan = (
        pos.where(visible(MONTH))
        .groupBy(ID, LOAN)
        .agg(*_dpd_columns(), latest_value(["NAME_CONTRACT_STATUS"], MONTH).alias("last"))
    )
    return per_loan.groupBy(ID).agg(
        F.count(LOAN).alias("pos_loan_count"),
        F.sum("months").alias("pos_observed_months"),
        F.max("max_dpd").alias("pos_max_dpd"),
        ratio(F.sum("sum_dpd"), F.sum("known_dpd")).alias("pos_mean_dpd"),
        ratio(F.sum("late_months"), F.sum("known_dpd")).alias("pos_late_month_ratio"),
        F.count_if(F.col("last.NAME_CONTRACT_STATUS") == "Active").alias("pos_active_loan_count"),
    )


def row_utilization(balance: Column, limit: Column) -> Column:
    """Positive balance over a positive limit; null without a valid limit, may exceed one."""
    return F.when(limit > 0, ratio(F.greatest(balance, F.lit(0.0)), limit)).alias("util")


def card_features(cards: DataFrame, *, validate: bool = True) -> DataFrame:
    if validate:
        enforce(snapshot_checks(cards, "card"))
    balance = F.col("AMT_BALANCE").cast("double")
    limit = F.col("AMT_CREDIT_LIMIT_ACTUAL").cast("double")
    # greatest() ignores nulls, so an unknown balance must be kept unknown explicitly
    util = F.when(balance.isNotNull(), row_utilization(balance, limit))
    per_loan = (
        cards.where(visible(MONTH))
        .withColumn("_util", util)
        .groupBy(ID, LOAN)
        .agg(
            *_dpd_columns(),
            F.sum("_util").alias("sum_util"),
            F.count("_util").alias("known_util"),
            F.max("_util").alias("max_util"),
            latest_value(["NAME_CONTRACT_STATUS", "AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL"], MONTH).alias("last"),
        )
    )
    active = F.coalesce(F.col("last.NAME_CONTRACT_STATUS") == "Active", F.lit(False))
    last_balance = F.col("last.AMT_BALANCE").cast("double")
    last_limit = F.col("last.AMT_CREDIT_LIMIT_ACTUAL").cast("double")
    known = {"balance": last_balance, "limit": last_limit}
    positive = F.when(last_balance.isNotNull(), F.greatest(last_balance, F.lit(0.0)))
    invalid = (last_balance > 0) & (last_limit.isNull() | (last_limit <= 0))
    grouped = per_loan.groupBy(ID).agg(
        F.count(LOAN).alias("card_account_count"),
        ratio(F.sum("sum_util"), F.sum("known_util")).alias("card_historical_mean_utilization"),
        F.max("max_util").alias("card_historical_max_utilization"),
        F.max("max_dpd").alias("card_max_dpd"),
        ratio(F.sum("late_months"), F.sum("known_dpd")).alias("card_late_month_ratio"),
        F.count_if(active).alias("_active"),
        *[F.sum(F.when(active, v)).alias(f"_sum_{k}") for k, v in known.items()],
        *[F.count_if(active & v.isNotNull()).alias(f"_known_{k}") for k, v in known.items()],
        F.sum(F.when(active, positive)).alias("_sum_positive"),
        F.count_if(active & invalid).alias("_invalid"),
    )

    def current(kind: str) -> Column:
        total = F.when(F.col(f"_known_{kind}") == F.col("_active"), F.col(f"_sum_{kind}"))
        return F.when(F.col("_active") == 0, F.lit(0.0)).otherwise(total)

    usable = (F.col("_invalid") == 0) & (F.col("_active") > 0) & (F.col("_known_balance") == F.col("_active"))
    utilization = F.when(
        usable & (F.col("_known_limit") == F.col("_active")), ratio(F.col("_sum_positive"), F.col("_sum_limit"))
    )
    return grouped.select(
        ID, "card_account_count", current("balance").alias("card_current_balance"),
        current("limit").alias("card_current_limit"), utilization.alias("card_current_utilization"),
        "card_historical_mean_utilization", "card_historical_max_utilization", "card_max_dpd",
        "card_late_month_ratio",
    )
