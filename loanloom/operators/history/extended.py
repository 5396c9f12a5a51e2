"""Observed-history features: six source flags, external scores and 76 aggregates.

These accept incomplete extracts: ambiguous rows are left out instead of
stopping the build, and every fraction names its own denominator.  Each source
is reduced per account (or per record key) first and per applicant second, both
with combinable aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.functions.nullsafe import is_finite, ratio, share, tally
from loanloom.operators.application import EXTERNAL_SCORES, ID

ACCOUNT = "SK_ID_BUREAU"
LOAN = "SK_ID_PREV"
MONTH = "MONTHS_BALANCE"
RECENT_MONTHS = -12


def _number(name: str) -> Column:
    return F.col(name).cast("double")


def _valid(value: Column) -> Column:
    """The value when it is finite and not negative, else null."""
    return F.when(is_finite(value) & (value >= 0), value)


def _finite(value: Column) -> Column:
    return F.when(is_finite(value), value)


def _sum_if_all(value: Column, scope: Column) -> Column:
    """Sum of ``value`` over rows in ``scope``; null when empty or when one value is unknown."""
    rows = F.count_if(scope)
    known = F.count_if(scope & value.isNotNull())
    return F.when((rows > 0) & (rows == known), F.sum(F.when(scope, value)))


def external_scores(raw: DataFrame) -> DataFrame:
    """External scores accepted only inside [0, 1]."""
    picked = [F.when(_number(s).between(0, 1), _number(s)) for s in EXTERNAL_SCORES]
    return raw.select(ID, *[p.alias(f"external_source_{i}") for i, p in enumerate(picked, 1)])


def retained_accounts(bureau: DataFrame) -> DataFrame:
    """Past bureau accounts whose id occurs once and names an owner."""
    columns = [c for c in bureau.columns if c != ACCOUNT]
    single = bureau.groupBy(ACCOUNT).agg(F.count(F.lit(1)).alias("_n"), *[F.max(c).alias(c) for c in columns])
    explicit = (F.col("_n") == 1) & F.col(ACCOUNT).isNotNull() & F.col(ID).isNotNull()
    return single.where(explicit & (F.col("DAYS_CREDIT") < 0) & (F.col("DAYS_CREDIT_UPDATE") <= 0)).drop("_n")


def bureau_observed(bureau: DataFrame) -> DataFrame:
    dpd = _valid(_number("CREDIT_DAY_OVERDUE"))
    day = F.col("DAYS_CREDIT")
    domestic = F.coalesce(F.col("CREDIT_CURRENCY") == "currency 1", F.lit(False))
    debt = _finite(_number("AMT_CREDIT_SUM_DEBT"))
    credit, overdue = _valid(_number("AMT_CREDIT_SUM")), _valid(_number("AMT_CREDIT_SUM_OVERDUE"))
    positive_debt = F.when(debt.isNotNull(), F.greatest(debt, F.lit(0.0)))
    grouped = (
        retained_accounts(bureau)
        .groupBy(ID)
        .agg(
            F.count(ACCOUNT).alias("bureau_observed_accounts"),
            tally(F.col("CREDIT_ACTIVE") == "Active").alias("bureau_active_accounts"),
            tally(F.col("CREDIT_ACTIVE") == "Closed").alias("bureau_closed_accounts"),
            share(dpd.isNotNull()).alias("bureau_dpd_known_fraction"),
            share(dpd > 0).alias("bureau_overdue_account_fraction"),
            F.when(F.count(dpd) > 0, F.count_if(dpd > 0)).alias("bureau_overdue_account_count"),
            F.max(dpd).alias("bureau_max_dpd"),
            F.max(-day).alias("bureau_oldest_account_days"),
            F.min(-day).alias("bureau_newest_account_days"),
            F.count_if(day >= -365).alias("bureau_openings_365d"),
            F.min(-F.col("DAYS_CREDIT_UPDATE")).alias("bureau_latest_update_age_days"),
            F.count_if(domestic).alias("bureau_currency1_accounts"),
            _sum_if_all(credit, domestic).alias("bureau_currency1_credit_sum"),
            _sum_if_all(positive_debt, domestic).alias("bureau_currency1_positive_debt_sum"),
            _sum_if_all(overdue, domestic).alias("bureau_currency1_overdue_sum"),
            share(F.when(domestic, debt.isNotNull())).alias("bureau_currency1_debt_known_fraction"),
            share(F.when(domestic, debt < 0)).alias("bureau_currency1_negative_debt_fraction"),
        )
    )
    burden = ratio(F.col("bureau_currency1_positive_debt_sum"), F.col("bureau_currency1_credit_sum"))
    return grouped.withColumn("bureau_currency1_debt_credit_ratio", burden)


def balance_observed(balance: DataFrame, bureau: DataFrame) -> DataFrame:
    """Monthly status features; repeated account months are left out, unmapped accounts too."""
    months = (
        balance.where(F.col(MONTH) < 0)
        .groupBy(ACCOUNT, MONTH)
        .agg(F.count(F.lit(1)).alias("_n"), F.max("STATUS").alias("STATUS"))
        .where("_n = 1")
    )
    status = F.col("STATUS")
    known = status.isin(list("012345"))
    late, severe = status.isin(list("12345")), status.isin(list("345"))
    recent = F.col(MONTH) >= RECENT_MONTHS
    per_account = months.groupBy(ACCOUNT).agg(
        F.count(F.lit(1)).alias("rows"),
        tally(known).alias("known"),
        tally(late).alias("late"),
        tally(severe).alias("severe"),
        F.max(F.when(known, status.try_cast("int"))).alias("worst"),
        tally(status == "X").alias("unknown"),
        tally(status == "C").alias("closed"),
        tally(known & recent).alias("recent_known"),
        tally(late & recent).alias("recent_late"),
        F.max_by("STATUS", MONTH).alias("last"),
    )
    owners = retained_accounts(bureau).select(ACCOUNT, ID)
    last = F.col("last")
    return (
        per_account.join(owners, ACCOUNT)
        .groupBy(ID)
        .agg(
            F.sum("rows").alias("bureau_balance_observed_months"),
            F.sum("known").alias("bureau_balance_known_months"),
            ratio(F.sum("late"), F.sum("known")).alias("bureau_balance_late_fraction"),
            ratio(F.sum("severe"), F.sum("known")).alias("bureau_balance_severe_fraction"),
            F.max("worst").alias("bureau_balance_max_status"),
            ratio(F.sum("unknown"), F.sum("rows")).alias("bureau_balance_unknown_fraction"),
            ratio(F.sum("closed"), F.sum("rows")).alias("bureau_balance_closed_fraction"),
            ratio(F.sum("recent_late"), F.sum("recent_known")).alias("bureau_balance_recent12_late_fraction"),
            ratio(tally(last.isin(list("12345"))), tally(last.isin(list("012345")))).alias(
                "bureau_balance_latest_late_fraction"
            ),
        )
    )


def previous_observed(previous: DataFrame) -> DataFrame:
    """Earlier applications before the cut-off; repeated ids are left out."""
    columns = [c for c in previous.columns if c != LOAN]
    single = (
        previous.groupBy(LOAN)
        .agg(F.count(F.lit(1)).alias("_n"), *[F.max(c).alias(c) for c in columns])
        .where((F.col("_n") == 1) & (F.col("DAYS_DECISION") < 0))
    )
    outcome, day = F.col("NAME_CONTRACT_STATUS"), F.col("DAYS_DECISION")
    recognized = F.coalesce(outcome.isin("Approved", "Refused", "Canceled", "Unused offer"), F.lit(False))
    approved = F.coalesce(outcome == "Approved", F.lit(False))
    asked, granted = _valid(_number("AMT_APPLICATION")), _valid(_number("AMT_CREDIT"))

    def fraction(value: str) -> Column:
        return share(F.when(recognized, outcome == value))

    return single.groupBy(ID).agg(
        F.count(LOAN).alias("previous_observed_applications"),
        fraction("Approved").alias("previous_approved_fraction"),
        fraction("Refused").alias("previous_refused_fraction"),
        fraction("Canceled").alias("previous_canceled_fraction"),
        F.count_if(day >= -365).alias("previous_applications_365d"),
        F.count_if(day >= -90).alias("previous_applications_90d"),
        F.min(-day).alias("previous_recency_days"),
        F.avg(asked).alias("previous_requested_amount_mean"),
        F.avg(F.when(approved, granted)).alias("previous_approved_credit_mean"),
        F.avg(F.when(approved & (asked > 0), ratio(granted, asked))).alias("previous_approved_credit_request_ratio"),
    )


def _single_months(df: DataFrame, columns: list[str]) -> DataFrame:
    """Past account months that occur once, for loans with exactly one owner.

    The owner test is aggregated per loan and joined back as one row per loan.
    """
    owners = (
        df.groupBy(LOAN)
        .agg(F.min(ID).alias("_lo"), F.max(ID).alias("_hi"), F.count(ID).alias("_known"), F.count(F.lit(1)).alias("_all"))
        .where((F.col("_lo") == F.col("_hi")) & (F.col("_known") == F.col("_all")))
        .select(LOAN)
    )
    months = (
        df.where(F.col(MONTH) < 0)
        .groupBy(LOAN, MONTH)
        .agg(F.count(F.lit(1)).alias("_n"), F.max(ID).alias(ID), *[F.max(c).alias(c) for c in columns])
        .where("_n = 1")
    )
    return months.join(owners, LOAN, "left_semi")


def _dpd_parts() -> list[Column]:
    dpd = _valid(_number("SK_DPD"))
    recent = F.col(MONTH) >= RECENT_MONTHS
    return [
        F.count(F.lit(1)).alias("rows"),
        F.count(dpd).alias("known"),
        tally(dpd > 0).alias("late"),
        F.max(dpd).alias("max_dpd"),
        F.sum(dpd).alias("sum_dpd"),
        F.count(F.when(recent, dpd)).alias("recent_known"),
        tally(recent & (dpd > 0)).alias("recent_late"),
        F.max(MONTH).alias("last_month"),
    ]


def pos_observed(pos: DataFrame) -> DataFrame:
    tolerant = _valid(_number("SK_DPD_DEF"))
    months = _single_months(pos, ["SK_DPD", "SK_DPD_DEF", "NAME_CONTRACT_STATUS"])
    per_loan = months.groupBy(ID, LOAN).agg(
        *_dpd_parts(), F.max(tolerant).alias("max_tolerant"), F.max_by("NAME_CONTRACT_STATUS", MONTH).alias("last")
    )
    return per_loan.groupBy(ID).agg(
        F.sum("rows").alias("pos_observed_months"),
        F.count(LOAN).alias("pos_observed_accounts"),
        ratio(F.sum("known"), F.sum("rows")).alias("pos_dpd_known_fraction"),
        ratio(F.sum("late"), F.sum("known")).alias("pos_late_fraction"),
        F.max("max_dpd").alias("pos_max_dpd"),
        ratio(F.sum("sum_dpd"), F.sum("known")).alias("pos_mean_dpd"),
        F.max("max_tolerant").alias("pos_max_tolerant_dpd"),
        ratio(F.sum("recent_late"), F.sum("recent_known")).alias("pos_recent12_late_fraction"),
        share(F.col("last") == "Active").alias("pos_latest_active_fraction"),
        F.min(-F.col("last_month")).alias("pos_latest_snapshot_age_months"),
    )


def card_observed(cards: DataFrame) -> DataFrame:
    measures = ["SK_DPD", "NAME_CONTRACT_STATUS", "AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL",
                "AMT_DRAWINGS_ATM_CURRENT", "AMT_DRAWINGS_CURRENT"]
    balance, limit = _finite(_number("AMT_BALANCE")), _finite(_number("AMT_CREDIT_LIMIT_ACTUAL"))
    util = F.when(balance.isNotNull() & (limit > 0), ratio(F.greatest(balance, F.lit(0.0)), limit))
    atm, drawn = _number("AMT_DRAWINGS_ATM_CURRENT"), _number("AMT_DRAWINGS_CURRENT")
    atm_share = F.when((drawn > 0) & atm.between(F.lit(0.0), drawn), ratio(atm, drawn))
    last = F.struct("NAME_CONTRACT_STATUS", balance.alias("balance"), limit.alias("limit"))
    per_loan = (
        _single_months(cards, measures)
        .groupBy(ID, LOAN)
        .agg(
            *_dpd_parts(),
            F.sum(util).alias("sum_util"), F.count(util).alias("known_util"), F.max(util).alias("max_util"),
            tally(util >= 0.9).alias("high_util"),
            F.count(balance).alias("known_balance"), tally(balance < 0).alias("negative_balance"),
            F.sum(atm_share).alias("sum_atm"), F.count(atm_share).alias("known_atm"),
            F.max_by(last, F.col(MONTH)).alias("last"),
        )
    )
    active = F.coalesce(F.col("last.NAME_CONTRACT_STATUS") == "Active", F.lit(False))
    last_balance, last_limit = F.col("last.balance"), F.col("last.limit")
    positive = F.when(last_balance.isNotNull(), F.greatest(last_balance, F.lit(0.0)))
    grouped = per_loan.groupBy(ID).agg(
        F.sum("rows").alias("card_observed_months"),
        F.count(LOAN).alias("card_observed_accounts"),
        ratio(F.sum("sum_util"), F.sum("known_util")).alias("card_historical_utilization_mean"),
        F.max("max_util").alias("card_historical_utilization_max"),
        ratio(F.sum("high_util"), F.sum("known_util")).alias("card_high_utilization_fraction"),
        ratio(F.sum("known_util"), F.sum("rows")).alias("card_utilization_known_fraction"),
        _sum_if_all(positive, active).alias("card_latest_positive_balance"),
        _sum_if_all(F.when(last_limit > 0, last_limit), active).alias("card_latest_positive_limit"),
        F.min(F.when(active, -F.col("last_month"))).alias("card_latest_snapshot_age_months"),
        F.max(F.when(active, -F.col("last_month"))).alias("card_oldest_active_snapshot_age_months"),
        ratio(F.sum("late"), F.sum("known")).alias("card_late_fraction"),
        F.max("max_dpd").alias("card_max_dpd"),
        ratio(F.sum("recent_late"), F.sum("recent_known")).alias("card_recent12_late_fraction"),
        ratio(F.sum("negative_balance"), F.sum("known_balance")).alias("card_negative_balance_fraction"),
        ratio(F.sum("sum_atm"), F.sum("known_atm")).alias("card_atm_drawing_share_mean"),
    )
    burden = ratio(F.col("card_latest_positive_balance"), F.col("card_latest_positive_limit"))
    return grouped.withColumn("card_latest_utilization", burden)


def installment_observed(records: DataFrame) -> DataFrame:
    """Past payment records whose (applicant, loan, number) occurs exactly once.

    ``records`` carry both the scheduled and the paid day and amount.
    """
    keys = [ID, LOAN, "NUM_INSTALMENT_NUMBER"]
    paid, owed = _number("AMT_PAYMENT"), _number("AMT_INSTALMENT")
    due_day, paid_day = F.col("DAYS_INSTALMENT"), F.col("DAYS_ENTRY_PAYMENT")
    usable = (
        (due_day < 0) & (paid_day < 0) & _valid(paid).isNotNull() & is_finite(owed) & (owed > 0)
        & (F.col("NUM_INSTALMENT_VERSION") > 0)
    )
    columns = ["DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT", "AMT_PAYMENT", "AMT_INSTALMENT"]
    single = (
        records.where(usable)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), *[F.max(c).alias(c) for c in columns])
        .where("_n = 1")
    )
    delay = paid_day - due_day
    per_loan = single.groupBy(ID, LOAN).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(delay > 0).alias("late"),
        F.sum(delay).alias("sum_delay"),
        F.sum(delay * delay).alias("sum_delay2"),
        F.sum(F.when(delay > 0, delay)).alias("sum_late"),
        F.max(F.greatest(delay, F.lit(0))).alias("worst"),
        F.sum(F.least(ratio(paid, owed), F.lit(1.0))).alias("sum_ratio"),
        F.count_if(paid >= owed).alias("covered"),
        F.sum(F.least(paid, owed)).alias("sum_paid"),
        F.sum(owed).alias("sum_owed"),
        F.count_if(due_day >= -365).alias("recent"),
        F.count_if((due_day >= -365) & (delay > 0)).alias("recent_late"),
        F.min(-paid_day).alias("recency"),
    )
    rows, total, squares = F.sum("rows"), F.sum("sum_delay"), F.sum("sum_delay2")
    variance = F.greatest(ratio(squares, rows) - ratio(total, rows) * ratio(total, rows), F.lit(0.0))
    return per_loan.groupBy(ID).agg(
        rows.alias("installment_observed_single_records"),
        F.count(LOAN).alias("installment_observed_accounts"),
        ratio(F.sum("late"), rows).alias("installment_observed_record_late_fraction"),
        F.sum("late").alias("installment_observed_late_records"),
        ratio(total, rows).alias("installment_observed_mean_signed_delay"),
        ratio(F.sum("sum_late"), F.sum("late")).alias("installment_observed_mean_late_delay"),
        F.max("worst").alias("installment_observed_max_delay"),
        F.when(rows >= 2, F.sqrt(variance)).alias("installment_observed_timing_std"),
        ratio(F.sum("sum_ratio"), rows).alias("installment_observed_paid_fraction_mean"),
        ratio(F.sum("covered"), rows).alias("installment_observed_amount_covered_fraction"),
        ratio(F.sum("sum_paid"), F.sum("sum_owed")).alias("installment_observed_weighted_paid_fraction"),
        ratio(F.sum("recent_late"), F.sum("recent")).alias("installment_observed_recent365_late_fraction"),
        F.min("recency").alias("installment_observed_payment_recency_days"),
    )


SOURCES = ["bureau", "bureau_balance", "previous_application", "pos", "card", "installment"]


def observed_history(
    applications: DataFrame, tables: dict[str, DataFrame], records: DataFrame
) -> DataFrame:
    """External scores, source-observed flags and all observed-history aggregates per applicant."""
    parts = {
        "bureau": bureau_observed(tables["bureau"]),
        "bureau_balance": balance_observed(tables["bureau_balance"], tables["bureau"]),
        "previous_application": previous_observed(tables["previous_application"]),
        "pos": pos_observed(tables["pos_cash_balance"]),
        "card": card_observed(tables["credit_card_balance"]),
        "installment": installment_observed(records),
    }
    out = external_scores(applications)
    for name, features in parts.items():
        flagged = features.withColumn("_hit", F.lit(1))
        out = out.join(flagged, ID, "left").withColumn(f"{name}_observed", F.coalesce("_hit", F.lit(0))).drop("_hit")
    return out
