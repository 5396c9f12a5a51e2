"""Catalogue: history features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.operators.application import ID
from loanloom.operators.asof import latest_per, visible
from loanloom.operators.contracts import conflicting_owners, orphans
from loanloom.operators.history.assemble import assemble, history_checks, owner_conflicts
from loanloom.operators.history.bureau import account_features, bureau_checks, bureau_features
from loanloom.operators.history.installments import (
    KEYS, installment_checks, installment_features, obligation_outcomes, unique_payments,
)
from loanloom.operators.history.names import HISTORY, ZERO_SUMS, zero_when_absent
from loanloom.operators.history.previous import previous_checks, previous_features
from loanloom.operators.history.snapshots import card_features, pos_features, snapshot_checks
from loanloom.plans import views
from loanloom.plans.registry import query, rounded
from loanloom.plans.views import with_views

# ---------------------------------------------------------------- installments
PAST_PAYMENTS = (
    "select distinct SK_ID_CURR, SK_ID_PREV, NUM_INSTALMENT_NUMBER, NUM_INSTALMENT_VERSION, PAYMENT_ID, "
    "DAYS_ENTRY_PAYMENT, cast(round(AMT_PAYMENT * 100) as bigint) cents from v_pay "
    "where DAYS_ENTRY_PAYMENT <= 0 and DAYS_AVAILABLE <= 0"
)
CUMULATIVE = (
    "select p.*, s.DAYS_INSTALMENT due, cast(round(s.AMT_INSTALMENT * 100) as bigint) owed, sum(p.cents) over ("
    "partition by p.SK_ID_CURR, p.SK_ID_PREV, p.NUM_INSTALMENT_NUMBER, p.NUM_INSTALMENT_VERSION "
    "order by p.DAYS_ENTRY_PAYMENT, p.PAYMENT_ID rows between unbounded preceding and current row) cum "
    "from past p join v_sched s using (SK_ID_CURR, SK_ID_PREV, NUM_INSTALMENT_NUMBER, NUM_INSTALMENT_VERSION)"
)
SETTLED = (
    "select s.SK_ID_CURR, s.SK_ID_PREV, s.NUM_INSTALMENT_NUMBER, s.DAYS_INSTALMENT due, "
    "cast(round(s.AMT_INSTALMENT * 100) as bigint) owed, o.completion, coalesce(o.paid, 0) paid from v_sched s "
    "left join (select SK_ID_CURR, SK_ID_PREV, NUM_INSTALMENT_NUMBER, "
    "min(case when cum >= owed - 1 then DAYS_ENTRY_PAYMENT end) completion, sum(cents) paid from cumulative "
    "group by 1, 2, 3) o using (SK_ID_CURR, SK_ID_PREV, NUM_INSTALMENT_NUMBER) "
    "where s.DAYS_AVAILABLE <= 0 and s.DAYS_INSTALMENT <= 0"
)
STEPS = {"past": PAST_PAYMENTS, "cumulative": CUMULATIVE, "settled": SETTLED}
LATE = "(completion > due or (completion is null and due < 0))"
INSTALLMENT_SQL = (
    "select SK_ID_CURR, count(*) installment_due_count, count(completion) installment_fully_paid_count, "
    f"cast(sum(case when {LATE} then 1 else 0 end) as bigint) installment_late_count, "
    "cast(sum(case when completion is null and due < 0 then 1 else 0 end) as bigint) installment_unpaid_overdue_count, "
    f"avg(case when {LATE} then 1.0::double else 0 end) installment_late_rate, "
    "avg(completion - due) installment_mean_signed_delay, "
    "avg(greatest(coalesce(completion, 0) - due, 0)) installment_mean_overdue_days, "
    "max(greatest(coalesce(completion, 0) - due, 0)) installment_max_overdue_days, "
    "round(avg(least(cast(paid as double) / owed, 1)), 9) installment_mean_paid_ratio from settled group by 1"
)


@query("installment_features", with_views(["v_pay", "v_sched"], INSTALLMENT_SQL, STEPS))
def _installments(spark: SparkSession, sf: str) -> DataFrame:
    out = installment_features(views.payments(spark, sf), views.schedule(spark, sf), validate=False)
    return rounded(out, 9, "installment_mean_paid_ratio")


@query(
    "obligation_outcomes",
    with_views(
        ["v_pay", "v_sched"],
        "select SK_ID_CURR, SK_ID_PREV, NUM_INSTALMENT_NUMBER, due due_day, owed owed_cents, completion completion_day, "
        "cast(paid as bigint) paid_cents from settled", STEPS),
)
def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    out = obligation_outcomes(views.payments(spark, sf), views.schedule(spark, sf))
    return out.select(
        *KEYS[:3], F.col("DAYS_INSTALMENT").alias("due_day"), (F.col("_owed_minor") / 100).cast("bigint").alias("owed_cents"),
        F.col("completion").alias("completion_day"), (F.col("paid") / 100).cast("bigint").alias("paid_cents"),
    )


REPLAYED = (
    "select PAYMENT_ID, AMT_PAYMENT, SK_ID_PREV from v_pay union all "
    "select PAYMENT_ID, AMT_PAYMENT + case when SK_ID_PREV % 2 = 0 then 1 else 0 end, SK_ID_PREV from v_pay "
    "where SK_ID_PREV % 5 = 0"
)


@query(
    "payment_conflicts",
    with_views(
        ["v_pay"],
        "select PAYMENT_ID, count(*) n_rows, cast(max(AMT_PAYMENT) <> min(AMT_PAYMENT) as integer) conflicting "
        "from replayed group by 1 having count(*) > 1", {"replayed": REPLAYED}),
)
def _conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Replays injected for every fifth loan; half of them with a changed amount."""
    base = views.payments(spark, sf)
    changed = F.when(F.col("SK_ID_PREV") % 2 == 0, 1).otherwise(0)
    copies = base.where(F.col("SK_ID_PREV") % 5 == 0).withColumn("AMT_PAYMENT", F.col("AMT_PAYMENT") + changed)
    seen = unique_payments(base.unionByName(copies)).where("n_rows > 1")
    return seen.select("PAYMENT_ID", "n_rows", F.col("conflicting").cast("int").alias("conflicting"))


@query(
    "payment_orphans",
    with_views(
        ["v_pay", "v_sched"],
        "select SK_ID_CURR, SK_ID_PREV, NUM_INSTALMENT_NUMBER, NUM_INSTALMENT_VERSION, count(*) n_rows from v_pay "
        "left join (select *, true hit from v_sched where SK_ID_PREV % 10 <> 3) "
        "using (SK_ID_CURR, SK_ID_PREV, NUM_INSTALMENT_NUMBER, NUM_INSTALMENT_VERSION) where hit is null group by 1, 2, 3, 4"),
)
def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    known = views.schedule(spark, sf).where(F.col("SK_ID_PREV") % 10 != 3)
    return orphans(views.payments(spark, sf), known, KEYS)


# ---------------------------------------------------------------- bureau
ACCOUNT_SQL = (
    "select SK_ID_CURR, count(SK_ID_BUREAU) bureau_account_count, "
    "count(*) filter (where CREDIT_ACTIVE = 'Active') bureau_active_count, "
    "count(*) filter (where CREDIT_ACTIVE = 'Closed') bureau_closed_count, "
    "case when count(CREDIT_DAY_OVERDUE) = count(*) then count(*) filter (where CREDIT_DAY_OVERDUE > 0) end bureau_overdue_count, "
    "round(case when count(AMT_CREDIT_SUM) = count(*) then sum(AMT_CREDIT_SUM) end, 4) bureau_total_credit, "
    "round(cast(case when count(AMT_CREDIT_SUM_DEBT) = count(*) then sum(AMT_CREDIT_SUM_DEBT) end as double), 4) bureau_total_debt, "
    "round(cast(case when count(AMT_CREDIT_SUM_OVERDUE) = count(*) then sum(AMT_CREDIT_SUM_OVERDUE) end as double), 4) bureau_total_overdue, "
    "max(CREDIT_DAY_OVERDUE) bureau_max_dpd, max(-DAYS_CREDIT) bureau_oldest_account_age_days, "
    "min(-DAYS_CREDIT) bureau_newest_account_age_days from v_bureau where DAYS_CREDIT <= 0 and DAYS_AVAILABLE <= 0 group by 1"
)
MONTH_SQL = (
    "select SK_ID_CURR, count(*) filter (where STATUS in ('0','1','2','3','4','5')) known, "
    "count(*) filter (where STATUS in ('1','2','3','4','5')) late, count(*) filter (where STATUS in ('3','4','5')) severe "
    "from v_balance b join v_bureau u using (SK_ID_BUREAU) where b.MONTHS_BALANCE <= 0 and b.DAYS_AVAILABLE <= 0 "
    "and u.DAYS_CREDIT <= 0 and u.DAYS_AVAILABLE <= 0 group by 1"
)
BUREAU_SQL = (
    "select a.*, coalesce(known, 0) bureau_observed_status_months, coalesce(late, 0) bureau_delinquent_months, "
    "coalesce(severe, 0) bureau_severe_months, cast(late as double) / nullif(known, 0) bureau_late_month_ratio "
    "from accounts a left join months m using (SK_ID_CURR)"
)
BUREAU_STEPS = {"accounts": ACCOUNT_SQL, "months": MONTH_SQL}
TOTALS = ("bureau_total_credit", "bureau_total_debt", "bureau_total_overdue")


@query("bureau_features", with_views(["v_bureau", "v_balance"], BUREAU_SQL, BUREAU_STEPS))
def _bureau(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bureau_features(views.bureau(spark, sf), views.balance(spark, sf), validate=False), 4, *TOTALS)


@query("bureau_account_features", with_views(["v_bureau"], ACCOUNT_SQL))
def _accounts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(account_features(views.bureau(spark, sf)), 4, *TOTALS)


# ---------------------------------------------------------------- previous applications
PREVIOUS_SQL = (
    "select SK_ID_CURR, count(SK_ID_PREV) previous_application_count, "
    "count(*) filter (where NAME_CONTRACT_STATUS = 'Approved') previous_approved_count, "
    "count(*) filter (where NAME_CONTRACT_STATUS = 'Refused') previous_refused_count, "
    "avg(case when NAME_CONTRACT_STATUS = 'Refused' then 1.0::double else 0 end) previous_refusal_rate, "
    "count(*) filter (where DAYS_DECISION >= -365) previous_applications_365d, "
    "min(-DAYS_DECISION) days_since_previous_application from v_prev where DAYS_DECISION <= 0 and DAYS_AVAILABLE <= 0 group by 1"
)


@query("previous_features", with_views(["v_prev"], PREVIOUS_SQL))
def _previous(spark: SparkSession, sf: str) -> DataFrame:
    return previous_features(views.previous(spark, sf), validate=False)


# ---------------------------------------------------------------- snapshots
SEEN = "select * from v_snap where MONTHS_BALANCE <= 0 and DAYS_AVAILABLE <= 0"
LAST = (
    "select SK_ID_CURR, SK_ID_PREV, NAME_CONTRACT_STATUS, AMT_BALANCE, AMT_CREDIT_LIMIT_ACTUAL from ("
    "select *, row_number() over (partition by SK_ID_PREV order by MONTHS_BALANCE desc) rn from seen) where rn = 1"
)
POS_SQL = (
    "select SK_ID_CURR, count(distinct SK_ID_PREV) pos_loan_count, count(*) pos_observed_months, max(SK_DPD) pos_max_dpd, "
    "avg(SK_DPD) pos_mean_dpd, avg(case when SK_DPD > 0 then 1.0::double when SK_DPD is not null then 0 end) pos_late_month_ratio, "
    "max(a.n) pos_active_loan_count from seen join (select SK_ID_CURR, count(*) filter (where NAME_CONTRACT_STATUS = 'Active') n "
    "from latest group by 1) a using (SK_ID_CURR) group by 1"
)
CARD_HISTORY = (
    "select SK_ID_CURR, count(distinct SK_ID_PREV) card_account_count, avg(util) card_historical_mean_utilization, "
    "max(util) card_historical_max_utilization, max(SK_DPD) card_max_dpd, "
    "avg(case when SK_DPD > 0 then 1.0::double when SK_DPD is not null then 0 end) card_late_month_ratio from (select *, "
    "case when AMT_CREDIT_LIMIT_ACTUAL > 0 and AMT_BALANCE is not null then cast(greatest(AMT_BALANCE, 0) as double) / "
    "AMT_CREDIT_LIMIT_ACTUAL end util from seen) group by 1"
)
CARD_ACTIVE = (
    "select SK_ID_CURR, case when count(AMT_BALANCE) = count(*) then sum(AMT_BALANCE) end balance, "
    "case when count(AMT_CREDIT_LIMIT_ACTUAL) = count(*) then sum(AMT_CREDIT_LIMIT_ACTUAL) end lim, "
    "case when count(AMT_BALANCE) = count(*) then sum(greatest(AMT_BALANCE, 0)) end positive, "
    "max(case when AMT_BALANCE > 0 and (AMT_CREDIT_LIMIT_ACTUAL is null or AMT_CREDIT_LIMIT_ACTUAL <= 0) then 1 else 0 end) bad "
    "from latest where NAME_CONTRACT_STATUS = 'Active' group by 1"
)
CARD_SQL = (
    "select h.SK_ID_CURR, card_account_count, cast(case when a.SK_ID_CURR is null then 0 else balance end as double) card_current_balance, "
    "cast(case when a.SK_ID_CURR is null then 0 else lim end as double) card_current_limit, "
    "case when bad = 0 then cast(positive as double) / nullif(lim, 0) end card_current_utilization, "
    "round(card_historical_mean_utilization, 9) card_historical_mean_utilization, card_historical_max_utilization, card_max_dpd, "
    "card_late_month_ratio from history h left join active a using (SK_ID_CURR)"
)
SNAP_STEPS = {"seen": SEEN, "latest": LAST}
CARD_STEPS = {**SNAP_STEPS, "history": CARD_HISTORY, "active": CARD_ACTIVE}


@query("pos_features", with_views(["v_snap"], POS_SQL, SNAP_STEPS))
def _pos(spark: SparkSession, sf: str) -> DataFrame:
    return pos_features(views.snapshots(spark, sf), validate=False)


@query("card_features", with_views(["v_snap"], CARD_SQL, CARD_STEPS))
def _cards(spark: SparkSession, sf: str) -> DataFrame:
    out = card_features(views.snapshots(spark, sf), validate=False)
    return rounded(out, 9, "card_historical_mean_utilization")


@query(
    "latest_snapshot",
    with_views(["v_snap"], "select SK_ID_PREV, MONTHS_BALANCE, NAME_CONTRACT_STATUS, cast(AMT_BALANCE as double) AMT_BALANCE from ("
               "select *, row_number() over (partition by SK_ID_PREV order by MONTHS_BALANCE desc) rn from seen) where rn = 1",
               {"seen": SEEN}),
)
def _latest(spark: SparkSession, sf: str) -> DataFrame:
    seen = views.snapshots(spark, sf).where(visible("MONTHS_BALANCE"))
    out = latest_per(seen, ["SK_ID_PREV"], "MONTHS_BALANCE", ["NAME_CONTRACT_STATUS", "AMT_BALANCE"])
    return out.withColumn("AMT_BALANCE", F.col("AMT_BALANCE").cast("double"))


# ---------------------------------------------------------------- assembly and checks
PARTS = {
    "f_bureau": BUREAU_SQL, "f_prev": PREVIOUS_SQL, "f_inst": INSTALLMENT_SQL, "f_pos": POS_SQL, "f_card": CARD_SQL,
}
SOURCE_OF = {"bureau": "f_bureau", "previous": "f_prev", "days": "f_prev", "installment": "f_inst", "pos": "f_pos", "card": "f_card"}


def _assembled(name: str) -> str:
    part = SOURCE_OF[name.split("_")[0]]
    value = f"case when {part}.SK_ID_CURR is null then 0 else {part}.{name} end" if zero_when_absent(name) else f"{part}.{name}"
    return f"cast({value} as double) as {name}"


ASSEMBLY_SQL = (
    "select r.SK_ID_CURR, " + ", ".join(_assembled(n) for n in HISTORY) + " from v_raw r "
    + " ".join(f"left join {p} on {p}.SK_ID_CURR = r.SK_ID_CURR" for p in PARTS)
)
FLOATING = (*TOTALS, "installment_mean_paid_ratio", "card_historical_mean_utilization")


ASSEMBLY_VIEWS = ["v_raw", "v_bureau", "v_balance", "v_prev", "v_pay", "v_sched", "v_snap"]
ASSEMBLY_STEPS = {**STEPS, **BUREAU_STEPS, **CARD_STEPS, **PARTS}


@query("history_assembly", with_views(ASSEMBLY_VIEWS, ASSEMBLY_SQL, ASSEMBLY_STEPS))
def _assembly(spark: SparkSession, sf: str) -> DataFrame:
    applicants = views.raw_applications(spark, sf).select(ID)
    out = assemble(applicants, views.history_tables(spark, sf), views.schedule(spark, sf))
    return rounded(rounded(out, 4, *TOTALS), 9, *FLOATING[3:])


@query(
    "owner_conflicts",
    with_views(["v_prev", "v_snap"],
               "select distinct s.SK_ID_PREV, s.SK_ID_CURR, p.SK_ID_CURR _declared from v_snap s "
               "left join v_prev p using (SK_ID_PREV) where p.SK_ID_CURR is null or p.SK_ID_CURR <> s.SK_ID_CURR"),
)
def _owners(spark: SparkSession, sf: str) -> DataFrame:
    return owner_conflicts(views.snapshots(spark, sf), views.previous(spark, sf))


@query(
    "account_owner_clash",
    "select l_partkey % 500 account, min(l_suppkey) first_owner, max(l_suppkey) last_owner from lineitem group by 1 "
    "having min(l_suppkey) <> max(l_suppkey)",
)
def _clash(spark: SparkSession, sf: str) -> DataFrame:
    lines = views.table(spark, sf, "lineitem").select((F.col("l_partkey") % 500).alias("account"), "l_suppkey")
    return conflicting_owners(lines, "account", "l_suppkey")


CHECK_SQL = (
    "select 'Missing or duplicate bureau account' as rule, count(*) violations from (select SK_ID_BUREAU from v_bureau group by 1 having count(*) > 1) "
    "union all select 'Unknown event date: DAYS_CREDIT', count(*) from v_bureau where DAYS_CREDIT is null "
    "union all select 'Unknown availability date', count(*) from v_bureau where DAYS_AVAILABLE is null "
    "union all select 'Unknown bureau account status', count(*) from v_bureau where CREDIT_ACTIVE not in ('Active','Closed','Sold','Bad debt') "
    "union all select 'Negative bureau DPD', count(*) from v_bureau where CREDIT_DAY_OVERDUE < 0 "
    "union all select 'Missing or duplicate account month', count(*) from (select SK_ID_BUREAU, MONTHS_BALANCE from v_raw_balance group by 1, 2 having count(*) > 1) "
    "union all select 'Unknown event date: MONTHS_BALANCE', count(*) from v_raw_balance where MONTHS_BALANCE is null "
    "union all select 'Unknown availability date', count(*) from v_raw_balance where DAYS_AVAILABLE is null "
    "union all select 'Unknown bureau monthly status', count(*) from v_raw_balance where STATUS not in ('0','1','2','3','4','5','C','X') "
    "union all select 'Orphan/unavailable bureau balance account', count(*) from (select distinct SK_ID_BUREAU from v_raw_balance "
    "where MONTHS_BALANCE <= 0 and DAYS_AVAILABLE <= 0) where SK_ID_BUREAU not in (select SK_ID_BUREAU from v_bureau where DAYS_CREDIT <= 0 and DAYS_AVAILABLE <= 0)"
)


@query("bureau_checks", with_views(["v_bureau", "v_raw_balance"], CHECK_SQL))
def _bureau_checks(spark: SparkSession, sf: str) -> DataFrame:
    return bureau_checks(views.bureau(spark, sf), views.raw_balance(spark, sf))


SNAP_CHECK_SQL = (
    "select 'Missing or duplicate card month' as rule, count(*) violations from (select SK_ID_PREV, MONTHS_BALANCE from v_snap group by 1, 2 having count(*) > 1) "
    "union all select 'Conflicting card account owner', count(*) from (select SK_ID_PREV from v_snap group by 1 having count(distinct SK_ID_CURR) > 1) "
    "union all select 'Unknown event date: MONTHS_BALANCE', count(*) from v_snap where MONTHS_BALANCE is null "
    "union all select 'Unknown availability date', count(*) from v_snap where DAYS_AVAILABLE is null "
    "union all select 'Negative card DPD', count(*) from v_snap where SK_DPD < 0 and MONTHS_BALANCE <= 0 and DAYS_AVAILABLE <= 0 "
    "union all select 'Negative credit limit', count(*) from v_snap where AMT_CREDIT_LIMIT_ACTUAL < 0 and MONTHS_BALANCE <= 0 and DAYS_AVAILABLE <= 0 "
    "union all select 'Unknown card latest status', count(*) from latest where NAME_CONTRACT_STATUS is null"
)


@query("snapshot_checks", with_views(["v_snap"], SNAP_CHECK_SQL, SNAP_STEPS))
def _snapshot_checks(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot_checks(views.snapshots(spark, sf), "card")


PAY_CHECK_SQL = (
    "select 'Missing or duplicate schedule key' as rule, count(*) violations from (select SK_ID_CURR, SK_ID_PREV, NUM_INSTALMENT_NUMBER from v_sched group by 1, 2, 3 having count(*) > 1) "
    "union all select 'Unknown event date: DAYS_AVAILABLE', count(*) from v_sched where DAYS_AVAILABLE is null "
    "union all select 'Conflicting installment loan owner', count(*) from (select SK_ID_PREV from v_sched where DAYS_AVAILABLE <= 0 group by 1 having count(distinct SK_ID_CURR) > 1) "
    "union all select 'Ambiguous effective schedule versions', 0 "
    "union all select 'Invalid contractual schedule', count(*) from v_sched where DAYS_AVAILABLE <= 0 and (AMT_INSTALMENT is null or AMT_INSTALMENT <= 0) "
    "union all select 'Conflicting duplicate payment identity', count(*) from (select PAYMENT_ID from v_pay group by 1 having count(distinct AMT_PAYMENT) > 1) "
    "union all select 'Missing payment event identity', count(*) from v_pay where PAYMENT_ID is null "
    "union all select 'Unknown event date: DAYS_ENTRY_PAYMENT', count(*) from v_pay where DAYS_ENTRY_PAYMENT is null "
    "union all select 'Unknown availability date', count(*) from v_pay where DAYS_AVAILABLE is null "
    "union all select 'Unknown/negative payments need reversal reconciliation', count(*) from (select distinct PAYMENT_ID from v_pay where AMT_PAYMENT < 0 and DAYS_ENTRY_PAYMENT <= 0) "
    "union all select 'Payment references unknown effective schedule', count(*) from (select distinct SK_ID_CURR, SK_ID_PREV, NUM_INSTALMENT_NUMBER from v_pay "
    "where DAYS_ENTRY_PAYMENT <= 0 and DAYS_AVAILABLE <= 0 except select SK_ID_CURR, SK_ID_PREV, NUM_INSTALMENT_NUMBER from v_sched where DAYS_AVAILABLE <= 0)"
)


@query("installment_checks", with_views(["v_pay", "v_sched"], PAY_CHECK_SQL))
def _installment_checks(spark: SparkSession, sf: str) -> DataFrame:
    return installment_checks(views.payments(spark, sf), views.schedule(spark, sf))


@query(
    "previous_checks",
    with_views(["v_prev"],
               "select 'Missing or duplicate previous application' as rule, count(*) violations from (select SK_ID_PREV from v_prev group by 1 having count(*) > 1) "
               "union all select 'Unknown event date: DAYS_DECISION', count(*) from v_prev where DAYS_DECISION is null "
               "union all select 'Unknown availability date', count(*) from v_prev where DAYS_AVAILABLE is null "
               "union all select 'Unknown previous application status', count(*) from v_prev where NAME_CONTRACT_STATUS not in ('Approved','Refused','Canceled','Unused offer')"),
)
def _previous_checks(spark: SparkSession, sf: str) -> DataFrame:
    return previous_checks(views.previous(spark, sf))
