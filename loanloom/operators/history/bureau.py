"""Bureau accounts and their monthly status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.functions.nullsafe import known_total, ratio
from loanloom.operators.application import ID
from loanloom.operators.asof import date_rules, visible
from loanloom.operators.contracts import (
    Rule, count_as, duplicate_keys, enforce, union_reports, violation_counts,
)

ACCOUNT = "SK_ID_BUREAU"
# Account and monthly status vocabularies.
ACCOUNT_STATUS = ["Active", "Closed", "Sold", "Bad debt"]
MONTH_STATUS = ["0", "1", "2", "3", "4", "5", "C", "X"]
OBSERVED, LATE, SEVERE = list("012345"), list("12345"), list("345")


def bureau_checks(bureau: DataFrame, balance: DataFrame) -> DataFrame:
    past = visible("DAYS_CREDIT")
    account_rules = date_rules("DAYS_CREDIT") + [
        Rule("Unknown bureau account status",
             past & ~F.coalesce(F.col("CREDIT_ACTIVE").isin(ACCOUNT_STATUS), F.lit(False))),
        Rule("Negative bureau DPD", past & (F.col("CREDIT_DAY_OVERDUE") < 0)),
    ]
    month_rules = date_rules("MONTHS_BALANCE") + [
        Rule("Unknown bureau monthly status",
             visible("MONTHS_BALANCE") & ~F.coalesce(F.col("STATUS").isin(MONTH_STATUS), F.lit(False))),
    ]
    seen_accounts = bureau.where(past).select(ACCOUNT)
    months = balance.where(visible("MONTHS_BALANCE")).select(ACCOUNT).distinct()
    return union_reports(
        [
            count_as(duplicate_keys(bureau, [ACCOUNT]), "Missing or duplicate bureau account"),
            violation_counts(bureau, account_rules),
            count_as(duplicate_keys(balance, [ACCOUNT, "MONTHS_BALANCE"]), "Missing or duplicate account month"),
            violation_counts(balance, month_rules),
            count_as(months.join(seen_accounts, ACCOUNT, "left_anti"),
                     "Orphan/unavailable bureau balance account"),
        ]
    )


def account_features(bureau: DataFrame) -> DataFrame:
    """Ten account features per applicant; one aggregate, no distinct: the key is unique by contract."""
    age = -F.col("DAYS_CREDIT")
    dpd = F.col("CREDIT_DAY_OVERDUE")
    return (
        bureau.where(visible("DAYS_CREDIT"))
        .groupBy(ID)
        .agg(
            F.count(ACCOUNT).alias("bureau_account_count"),
            F.count_if(F.col("CREDIT_ACTIVE") == "Active").alias("bureau_active_count"),
            F.count_if(F.col("CREDIT_ACTIVE") == "Closed").alias("bureau_closed_count"),
            known_total((dpd > 0).cast("bigint")).alias("bureau_overdue_count"),
            known_total(F.col("AMT_CREDIT_SUM").cast("double")).alias("bureau_total_credit"),
            known_total(F.col("AMT_CREDIT_SUM_DEBT").cast("double")).alias("bureau_total_debt"),
            known_total(F.col("AMT_CREDIT_SUM_OVERDUE").cast("double")).alias("bureau_total_overdue"),
            F.max(dpd).alias("bureau_max_dpd"),
            F.max(age).alias("bureau_oldest_account_age_days"),
            F.min(age).alias("bureau_newest_account_age_days"),
        )
    )


def month_features(bureau: DataFrame, balance: DataFrame) -> DataFrame:
    """Monthly status counts per applicant.

    Months are counted per account before the owner is joined, so the join moves
    one row per account instead of one per month and a huge account cannot skew it.
    """
    status = F.col("STATUS")
    per_account = (
        balance.where(visible("MONTHS_BALANCE"))
        .groupBy(ACCOUNT)
        .agg(
            F.count_if(status.isin(OBSERVED)).alias("known"),
            F.count_if(status.isin(LATE)).alias("late"),
            F.count_if(status.isin(SEVERE)).alias("severe"),
        )
    )
    owners = bureau.where(visible("DAYS_CREDIT")).select(ACCOUNT, ID)
    return (
        per_account.join(owners, ACCOUNT)
        .groupBy(ID)
        .agg(
            F.sum("known").alias("bureau_observed_status_months"),
            F.sum("late").alias("bureau_delinquent_months"),
            F.sum("severe").alias("bureau_severe_months"),
        )
    )


def bureau_features(bureau: DataFrame, balance: DataFrame, *, validate: bool = True) -> DataFrame:
    if validate:
        enforce(bureau_checks(bureau, balance))
    joined = account_features(bureau).join(month_features(bureau, balance), ID, "left")
    counts = ["bureau_observed_status_months", "bureau_delinquent_months", "bureau_severe_months"]
    filled = joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})
    return filled.withColumn("bureau_late_month_ratio", ratio(F.col(counts[1]), F.col(counts[0])))
