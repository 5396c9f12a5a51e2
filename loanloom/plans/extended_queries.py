"""Catalogue: observed-history features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.operators.application import ID
from loanloom.operators.history import extended as X
from loanloom.plans import views
from loanloom.plans.registry import query, rounded
from loanloom.plans.views import with_views

ACCOUNTS = (
    "select * from v_bureau where SK_ID_BUREAU in (select SK_ID_BUREAU from v_bureau group by 1 having count(*) = 1) "
    "and SK_ID_CURR is not null and DAYS_CREDIT < 0 and DAYS_CREDIT_UPDATE <= 0"
)
ONE = "CREDIT_CURRENCY = 'currency 1'"


def _all_known(value: str, scope: str) -> str:
    return (
        f"case when count(*) filter (where {scope}) > 0 and count(*) filter (where {scope}) = count({value}) filter (where {scope}) "
        f"then sum({value}) filter (where {scope}) end"
    )


BUREAU_SQL = (
    "select SK_ID_CURR, count(*) bureau_observed_accounts, count(*) filter (where CREDIT_ACTIVE = 'Active') bureau_active_accounts, "
    "count(*) filter (where CREDIT_ACTIVE = 'Closed') bureau_closed_accounts, "
    "avg(case when CREDIT_DAY_OVERDUE >= 0 then 1.0::double else 0 end) bureau_dpd_known_fraction, "
    "avg(case when CREDIT_DAY_OVERDUE > 0 then 1.0::double when CREDIT_DAY_OVERDUE = 0 then 0 end) bureau_overdue_account_fraction, "
    "case when count(CREDIT_DAY_OVERDUE) > 0 then count(*) filter (where CREDIT_DAY_OVERDUE > 0) end bureau_overdue_account_count, "
    "cast(max(CREDIT_DAY_OVERDUE) as double) bureau_max_dpd, max(-DAYS_CREDIT) bureau_oldest_account_days, "
    "min(-DAYS_CREDIT) bureau_newest_account_days, count(*) filter (where DAYS_CREDIT >= -365) bureau_openings_365d, "
    "min(-DAYS_CREDIT_UPDATE) bureau_latest_update_age_days, count(*) filter (where " + ONE + ") bureau_currency1_accounts, "
    "round(" + _all_known("cast(AMT_CREDIT_SUM as double)", ONE) + ", 4) bureau_currency1_credit_sum, "
    "round(" + _all_known("cast(greatest(AMT_CREDIT_SUM_DEBT, case when AMT_CREDIT_SUM_DEBT is not null then 0 end) as double)", ONE) + ", 4) bureau_currency1_positive_debt_sum, "
    "round(" + _all_known("cast(AMT_CREDIT_SUM_OVERDUE as double)", ONE) + ", 4) bureau_currency1_overdue_sum, "
    "avg(case when AMT_CREDIT_SUM_DEBT is not null then 1.0::double else 0 end) filter (where " + ONE + ") bureau_currency1_debt_known_fraction, "
    "avg(case when AMT_CREDIT_SUM_DEBT < 0 then 1.0::double when AMT_CREDIT_SUM_DEBT >= 0 then 0 end) filter (where " + ONE + ") bureau_currency1_negative_debt_fraction "
    "from accounts group by 1"
)
BUREAU_WRAP = (
    "select *, round(bureau_currency1_positive_debt_sum / nullif(bureau_currency1_credit_sum, 0), 9) bureau_currency1_debt_credit_ratio from b"
)


def _round_bureau(df: DataFrame) -> DataFrame:
    sums = ["bureau_currency1_credit_sum", "bureau_currency1_positive_debt_sum", "bureau_currency1_overdue_sum"]
    return rounded(rounded(df, 4, *sums), 9, "bureau_currency1_debt_credit_ratio")


@query("extended_bureau", with_views(["v_bureau"], BUREAU_WRAP, {"accounts": ACCOUNTS, "b": BUREAU_SQL}))
def _bureau(spark: SparkSession, sf: str) -> DataFrame:
    return _round_bureau(X.bureau_observed(views.bureau(spark, sf)))


MONTHS = (
    "select m.*, a.SK_ID_CURR from (select SK_ID_BUREAU, MONTHS_BALANCE, max(STATUS) STATUS from v_raw_balance where MONTHS_BALANCE < 0 "
    "group by 1, 2 having count(*) = 1) m join accounts a using (SK_ID_BUREAU)"
)
KNOWN, LATE = "STATUS in ('0','1','2','3','4','5')", "STATUS in ('1','2','3','4','5')"
LAST_MONTHS = "select * from (select *, row_number() over (partition by SK_ID_BUREAU order by MONTHS_BALANCE desc) rn from months) where rn = 1"


def _frac(hit: str, base: str) -> str:
    return f"cast(count(*) filter (where {hit}) as double) / nullif(count(*) filter (where {base}), 0)"


BALANCE_SQL = (
    "select m.SK_ID_CURR, count(*) bureau_balance_observed_months, count(*) filter (where " + KNOWN + ") bureau_balance_known_months, "
    + _frac(LATE, KNOWN) + " bureau_balance_late_fraction, "
    + _frac("STATUS in ('3','4','5')", KNOWN) + " bureau_balance_severe_fraction, "
    "max(try_cast(STATUS as integer)) bureau_balance_max_status, "
    + _frac("STATUS = 'X'", "true") + " bureau_balance_unknown_fraction, "
    + _frac("STATUS = 'C'", "true") + " bureau_balance_closed_fraction, "
    + _frac(f"{LATE} and MONTHS_BALANCE >= -12", f"{KNOWN} and MONTHS_BALANCE >= -12") + " bureau_balance_recent12_late_fraction, "
    "max(l.f) bureau_balance_latest_late_fraction from months m join (select SK_ID_CURR, " + _frac(LATE, KNOWN)
    + " f from lasts group by 1) l using (SK_ID_CURR) group by 1"
)


@query("extended_bureau_balance",
       with_views(["v_bureau", "v_raw_balance"], BALANCE_SQL, {"accounts": ACCOUNTS, "months": MONTHS, "lasts": LAST_MONTHS}))
def _balance(spark: SparkSession, sf: str) -> DataFrame:
    return X.balance_observed(views.raw_balance(spark, sf), views.bureau(spark, sf))


PREVIOUS_SQL = (
    "select SK_ID_CURR, count(*) previous_observed_applications, "
    + ", ".join(
        f"avg(case when NAME_CONTRACT_STATUS = '{s}' then 1.0::double else 0 end) previous_{s.lower()}_fraction"
        for s in ("Approved", "Refused", "Canceled"))
    + ", count(*) filter (where DAYS_DECISION >= -365) previous_applications_365d, "
    "count(*) filter (where DAYS_DECISION >= -90) previous_applications_90d, min(-DAYS_DECISION) previous_recency_days, "
    "avg(AMT_APPLICATION) previous_requested_amount_mean, "
    "avg(AMT_CREDIT) filter (where NAME_CONTRACT_STATUS = 'Approved') previous_approved_credit_mean, "
    "round(avg(AMT_CREDIT / AMT_APPLICATION) filter (where NAME_CONTRACT_STATUS = 'Approved' and AMT_APPLICATION > 0), 9) previous_approved_credit_request_ratio "
    "from v_prev where DAYS_DECISION < 0 group by 1"
)


@query("extended_previous", with_views(["v_prev"], PREVIOUS_SQL))
def _previous(spark: SparkSession, sf: str) -> DataFrame:
    out = X.previous_observed(views.previous(spark, sf))
    return rounded(out, 9, "previous_approved_credit_request_ratio")


SEEN = "select * from v_snap where MONTHS_BALANCE < 0"
LASTS = "select * from (select *, row_number() over (partition by SK_ID_PREV order by MONTHS_BALANCE desc) rn from seen) where rn = 1"
POS_SQL = (
    "select s.SK_ID_CURR, count(*) pos_observed_months, count(distinct SK_ID_PREV) pos_observed_accounts, "
    + _frac("SK_DPD >= 0", "true") + " pos_dpd_known_fraction, " + _frac("SK_DPD > 0", "SK_DPD >= 0") + " pos_late_fraction, "
    "cast(max(SK_DPD) as double) pos_max_dpd, avg(SK_DPD) pos_mean_dpd, cast(max(SK_DPD_DEF) as double) pos_max_tolerant_dpd, "
    + _frac("SK_DPD > 0 and MONTHS_BALANCE >= -12", "SK_DPD >= 0 and MONTHS_BALANCE >= -12") + " pos_recent12_late_fraction, "
    "max(l.f) pos_latest_active_fraction, max(l.age) pos_latest_snapshot_age_months from seen s join (select SK_ID_CURR, "
    "avg(case when NAME_CONTRACT_STATUS = 'Active' then 1.0::double when NAME_CONTRACT_STATUS is not null then 0 end) f, "
    "min(-MONTHS_BALANCE) age from lasts group by 1) l using (SK_ID_CURR) group by 1"
)


@query("extended_pos", with_views(["v_snap"], POS_SQL, {"seen": SEEN, "lasts": LASTS}))
def _pos(spark: SparkSession, sf: str) -> DataFrame:
    return X.pos_observed(views.snapshots(spark, sf))


UTIL = ("select *, case when AMT_CREDIT_LIMIT_ACTUAL > 0 and AMT_BALANCE is not null then cast(greatest(AMT_BALANCE, 0) as double) / "
        "AMT_CREDIT_LIMIT_ACTUAL end util from seen")
ACTIVE = (
    "select SK_ID_CURR, case when count(AMT_BALANCE) = count(*) then sum(greatest(AMT_BALANCE, 0)) end pb, "
    "case when count(*) filter (where AMT_CREDIT_LIMIT_ACTUAL > 0) = count(*) then sum(AMT_CREDIT_LIMIT_ACTUAL) end pl, "
    "min(-MONTHS_BALANCE) lo, max(-MONTHS_BALANCE) hi from lasts where NAME_CONTRACT_STATUS = 'Active' group by 1"
)
CARD_SQL = (
    "select u.SK_ID_CURR, count(*) card_observed_months, count(distinct SK_ID_PREV) card_observed_accounts, "
    "round(avg(util), 9) card_historical_utilization_mean, max(util) card_historical_utilization_max, "
    + _frac("util >= 0.9", "util is not null") + " card_high_utilization_fraction, "
    + _frac("util is not null", "true") + " card_utilization_known_fraction, "
    "cast(max(a.pb) as double) card_latest_positive_balance, cast(max(a.pl) as double) card_latest_positive_limit, "
    "max(a.lo) card_latest_snapshot_age_months, max(a.hi) card_oldest_active_snapshot_age_months, "
    + _frac("SK_DPD > 0", "SK_DPD >= 0") + " card_late_fraction, cast(max(SK_DPD) as double) card_max_dpd, "
    + _frac("SK_DPD > 0 and MONTHS_BALANCE >= -12", "SK_DPD >= 0 and MONTHS_BALANCE >= -12") + " card_recent12_late_fraction, "
    + _frac("AMT_BALANCE < 0", "AMT_BALANCE is not null") + " card_negative_balance_fraction, "
    "round(avg(cast(AMT_DRAWINGS_ATM_CURRENT as double) / AMT_DRAWINGS_CURRENT) filter (where AMT_DRAWINGS_CURRENT > 0 and "
    "AMT_DRAWINGS_ATM_CURRENT between 0 and AMT_DRAWINGS_CURRENT), 9) card_atm_drawing_share_mean, "
    "cast(max(a.pb) as double) / nullif(max(a.pl), 0) card_latest_utilization from utils u left join actives a using (SK_ID_CURR) group by 1"
)
CARD_STEPS = {"seen": SEEN, "lasts": LASTS, "utils": UTIL, "actives": ACTIVE}


@query("extended_card", with_views(["v_snap"], CARD_SQL, CARD_STEPS))
def _card(spark: SparkSession, sf: str) -> DataFrame:
    out = X.card_observed(views.snapshots(spark, sf))
    return rounded(out, 9, "card_historical_utilization_mean", "card_atm_drawing_share_mean")


def payment_records(spark: SparkSession, sf: str) -> DataFrame:
    """Payments next to the obligation they refer to."""
    keys = ["SK_ID_CURR", "SK_ID_PREV", "NUM_INSTALMENT_NUMBER", "NUM_INSTALMENT_VERSION"]
    paid, owed, tasks = views.payments(spark, sf), views.schedule(spark, sf).drop("DAYS_AVAILABLE"), views.line_tasks(spark, sf)
    if tasks:
        # without the version, which is one value here and so no key of the join that Spark plans
        paid, owed = paid.repartition(tasks, *keys[:3]), owed.repartition(tasks, *keys[:3])
    return paid.join(owed, keys)


SINGLES = (
    "select SK_ID_CURR, SK_ID_PREV, NUM_INSTALMENT_NUMBER, max(DAYS_INSTALMENT) due, max(DAYS_ENTRY_PAYMENT) paid_day, "
    "max(AMT_PAYMENT) pay, max(AMT_INSTALMENT) owed from v_pay join v_sched using (SK_ID_CURR, SK_ID_PREV, NUM_INSTALMENT_NUMBER) "
    "where DAYS_INSTALMENT < 0 and DAYS_ENTRY_PAYMENT < 0 and AMT_PAYMENT >= 0 and AMT_INSTALMENT > 0 group by 1, 2, 3 having count(*) = 1"
)
SINGLE_SQL = (
    "select SK_ID_CURR, count(*) installment_observed_single_records, count(distinct SK_ID_PREV) installment_observed_accounts, "
    + _frac("paid_day > due", "true") + " installment_observed_record_late_fraction, "
    "count(*) filter (where paid_day > due) installment_observed_late_records, avg(paid_day - due) installment_observed_mean_signed_delay, "
    "avg(paid_day - due) filter (where paid_day > due) installment_observed_mean_late_delay, "
    "max(greatest(paid_day - due, 0)) installment_observed_max_delay, "
    "round(case when count(*) >= 2 then stddev_pop(paid_day - due) end, 6) installment_observed_timing_std, "
    "round(avg(least(pay / owed, 1)), 9) installment_observed_paid_fraction_mean, "
    + _frac("pay >= owed", "true") + " installment_observed_amount_covered_fraction, "
    "round(sum(least(pay, owed)) / sum(owed), 9) installment_observed_weighted_paid_fraction, "
    + _frac("due >= -365 and paid_day > due", "due >= -365") + " installment_observed_recent365_late_fraction, "
    "min(-paid_day) installment_observed_payment_recency_days from singles group by 1"
)


def _round_singles(df: DataFrame) -> DataFrame:
    out = rounded(df, 6, "installment_observed_timing_std")
    return rounded(out, 9, "installment_observed_paid_fraction_mean", "installment_observed_weighted_paid_fraction")


@query("extended_installment", with_views(["v_pay", "v_sched"], SINGLE_SQL, {"singles": SINGLES}))
def _installment(spark: SparkSession, sf: str) -> DataFrame:
    return _round_singles(X.installment_observed(payment_records(spark, sf)))


FLAGS_SQL = (
    "select SK_ID_CURR, case when EXT_SOURCE_1 between 0 and 1 then EXT_SOURCE_1 end external_source_1, "
    "case when EXT_SOURCE_2 between 0 and 1 then EXT_SOURCE_2 end external_source_2, "
    "case when EXT_SOURCE_3 between 0 and 1 then EXT_SOURCE_3 end external_source_3, "
    + ", ".join(
        f"cast(SK_ID_CURR in (select SK_ID_CURR from {src}) as integer) {name}_observed"
        for name, src in [
            ("bureau", "accounts"), ("bureau_balance", "months"),
            ("previous_application", "(select SK_ID_CURR from v_prev where DAYS_DECISION < 0)"),
            ("pos", "seen"), ("card", "seen"), ("installment", "singles")])
    + " from v_raw"
)


@query("extended_observed_flags",
       with_views(["v_raw", "v_bureau", "v_raw_balance", "v_prev", "v_pay", "v_sched", "v_snap"], FLAGS_SQL,
                  {"accounts": ACCOUNTS, "months": MONTHS, "seen": SEEN, "singles": SINGLES}))
def _flags(spark: SparkSession, sf: str) -> DataFrame:
    tables = {**views.history_tables(spark, sf), "bureau_balance": views.raw_balance(spark, sf)}
    out = X.observed_history(views.raw_applications(spark, sf), tables, payment_records(spark, sf))
    names = [f"external_source_{i}" for i in (1, 2, 3)] + [f"{s}_observed" for s in X.SOURCES]
    return out.select(ID, *[F.col(n) for n in names])
