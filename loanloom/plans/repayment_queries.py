"""Catalogue: repayment intelligence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.operators import repayment as R
from loanloom.plans import views
from loanloom.plans.registry import query, rounded
from loanloom.plans.views import with_views
from loanloom.streaming.payments import settled

AS_OF = "cast('2000-06-30' as date)"
IMPORT_COLUMNS = {
    "import_id": "c_custkey",
    "source_kind": "case when c_custkey % 7 = 3 then 'DEMO' else 'USER_DECLARED' end",
    "currency": "case when c_custkey % 7 = 3 and c_custkey % 3 <> 0 then 'XXX' else 'INR' end",
    "as_of": AS_OF,
    "window_start": "case when c_custkey % 11 = 2 then cast('2000-04-01' as date) else cast('1996-01-01' as date) end",
    "schedule_complete": "c_custkey % 13 <> 4",
    "payments_complete": "c_custkey % 9 <> 5",
}
SCHEDULE_COLUMNS = {
    "import_id": "SK_ID_CURR",
    "account_ref": "concat('A', cast(SK_ID_PREV % 4 as string))",
    "installment_ref": "concat(cast(SK_ID_PREV as string), '-', cast(NUM_INSTALMENT_NUMBER as string))",
    "amount": "AMT_INSTALMENT",
}
PAYMENT_COLUMNS = {
    "import_id": "SK_ID_CURR",
    "event_ref": "PAYMENT_ID",
    "account_ref": "concat('A', cast(SK_ID_PREV % 4 as string))",
    "installment_ref": "concat(cast(SK_ID_PREV as string), '-', cast(NUM_INSTALMENT_NUMBER as string))",
    "amount": "AMT_PAYMENT",
}
# relative days of the shared views are moved onto the calendar around the cut-off
DUE_SPARK, DUE_SQL = "date_add(date '1998-06-30', DAYS_INSTALMENT)", "cast(date '1998-06-30' + cast(DAYS_INSTALMENT as integer) as date)"
PAID_SPARK, PAID_SQL = "date_add(date '1998-06-30', DAYS_ENTRY_PAYMENT)", "cast(date '1998-06-30' + cast(DAYS_ENTRY_PAYMENT as integer) as date)"


def _texts(columns: dict[str, str]) -> list[str]:
    return [f"{v} as {k}" for k, v in columns.items()]


def imports(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "customer").selectExpr(*_texts(IMPORT_COLUMNS))


def schedules(spark: SparkSession, sf: str) -> DataFrame:
    return views.schedule(spark, sf).selectExpr(*_texts(SCHEDULE_COLUMNS), f"{DUE_SPARK} as due_date")


def payments(spark: SparkSession, sf: str) -> DataFrame:
    return views.payments(spark, sf).selectExpr(*_texts(PAYMENT_COLUMNS), f"{PAID_SPARK} as paid_date")


def status(spark: SparkSession, sf: str) -> DataFrame:
    return R.installment_status(imports(spark, sf), schedules(spark, sf), payments(spark, sf), views.line_tasks(spark, sf))


STEPS = {
    "imp": "select " + ", ".join(_texts(IMPORT_COLUMNS)) + " from customer",
    "sch": "select " + ", ".join(_texts(SCHEDULE_COLUMNS)) + f", {DUE_SQL} due_date from v_sched",
    "pmt": "select " + ", ".join(_texts(PAYMENT_COLUMNS)) + f", {PAID_SQL} paid_date from v_pay",
    "cum": "select p.import_id, p.account_ref, p.installment_ref, paid_date, cast(round(p.amount * 100) as bigint) cents, "
           "sum(cast(round(p.amount * 100) as bigint)) over (partition by p.import_id, p.account_ref, p.installment_ref order by paid_date, event_ref "
           "rows between unbounded preceding and current row) cum from (select distinct * from pmt) p join imp i on i.import_id = p.import_id where paid_date <= as_of",
    "oblig": "select s.import_id, s.account_ref, s.installment_ref, s.due_date, cast(round(s.amount * 100) as bigint) owed, i.as_of, i.window_start, "
             "i.payments_complete, i.schedule_complete from sch s join imp i on i.import_id = s.import_id where window_start <= due_date and due_date < as_of",
    "done": "select o.*, c.completion, cast(coalesce(c.paid, 0) as bigint) paid, cast(coalesce(c.by_due, 0) as bigint) by_due from oblig o left join ("
            "select o.import_id, o.account_ref, o.installment_ref, min(case when cum >= owed - 1 then paid_date end) completion, sum(cents) paid, "
            "sum(case when paid_date <= due_date then cents else 0 end) by_due from cum join oblig o using (import_id, account_ref, installment_ref) group by 1, 2, 3) c "
            "using (import_id, account_ref, installment_ref)",
    "stat": "select *, case when not payments_complete then 'UNKNOWN' when completion <= due_date then 'ON_TIME' when completion > due_date then 'LATE' "
            "when paid > 0 then 'PARTIAL' else 'MISSED' end status, case when payments_complete then cast(datediff('day', due_date, completion) as integer) end delay, "
            "case when payments_complete then cast(greatest(coalesce(datediff('day', due_date, completion), datediff('day', due_date, as_of)), 0) as integer) end overdue, "
            "least(owed, by_due) funded from done",
}
BOTH = ["v_pay", "v_sched"]
MATURED = "due_date <= as_of - 30 and status in ('LATE', 'MISSED', 'PARTIAL')"
RECOVERED = "status = 'LATE' and delay <= 30"


@query("installment_status", with_views(
    BOTH, "select import_id, account_ref, installment_ref, cast(due_date as string) due_date, owed owed_cents, paid paid_cents, funded funded_cents, "
    "cast(case when payments_complete then completion end as string) completion_date, delay delay_days, overdue overdue_days, "
    "case when payments_complete then greatest(owed - paid, 0) end shortfall_cents, status from stat", STEPS))
def _status(spark: SparkSession, sf: str) -> DataFrame:
    def cents(name: str):
        return (F.col(name) / 100).cast("bigint")

    return status(spark, sf).select(
        *R.KEYS, F.col("due_date").cast("string").alias("due_date"), cents("_owed").alias("owed_cents"), cents("paid").alias("paid_cents"),
        cents("funded_by_due").alias("funded_cents"), F.col("completion_date").cast("string").alias("completion_date"),
        "delay_days", "overdue_days", cents("shortfall").alias("shortfall_cents"), "status",
    )


def _pct(part: str, whole: str) -> str:
    return f"round(100 * cast({part} as double) / nullif({whole}, 0), 2)"


FOLD = (
    "select import_id, count(*) n, count(*) filter (where status = 'ON_TIME') ont, count(*) filter (where status = 'LATE') lat, "
    "count(*) filter (where status = 'MISSED') mis, count(*) filter (where status = 'PARTIAL') par, sum(funded) fun, sum(owed) owe, "
    "round(avg(delay) filter (where status = 'LATE'), 2) average_delay_days, max(overdue) worst, count(*) filter (where status in ('ON_TIME', 'LATE')) com, "
    "stddev_pop(delay) filter (where status in ('ON_TIME', 'LATE')) sd, "
    f"count(*) filter (where {MATURED}) mat, count(*) filter (where {MATURED} and {RECOVERED}) rec, "
    "count(*) filter (where due_date >= as_of - 90) r, count(*) filter (where due_date >= as_of - 90 and status = 'ON_TIME') ro, "
    "count(*) filter (where due_date >= as_of - 180 and due_date < as_of - 90) q, "
    "count(*) filter (where due_date >= as_of - 180 and due_date < as_of - 90 and status = 'ON_TIME') qo, "
    "datediff('day', min(due_date), max(due_date)) span from stat group by 1"
)
METRICS = (
    "select import_id, case when payments_complete and schedule_complete and n >= 6 and span >= 90 then on_time_percent end discipline_score, on_time_percent, "
    f"case when payments_complete then {_pct('fun', 'owe')} end payment_reliability_percent, average_delay_days, case when payments_complete then worst end worst_delay_days, "
    "case when com >= 2 then round(sd, 2) end payment_consistency_days, coalesce(n, 0) due_count, case when payments_complete then coalesce(ont, 0) end on_time_count, "
    "case when payments_complete then coalesce(lat, 0) end late_payment_count, case when payments_complete then coalesce(mis, 0) end missed_payment_count, "
    "case when payments_complete then coalesce(par, 0) end partial_overdue_count, case when payments_complete then coalesce(mis + par, 0) end outstanding_overdue_count, "
    f"case when payments_complete then {_pct('rec', 'mat')} end recovery_30d_percent, case when payments_complete then coalesce(mat, 0) end recovery_eligible_count, "
    "delta recent_improvement_pp, case when delta > 0 then 'IMPROVING' when delta < 0 then 'DECLINING' when delta = 0 then 'UNCHANGED' else 'INSUFFICIENT_HISTORY' end recent_improvement "
    f"from (select i.*, f.* exclude (import_id), case when payments_complete then {_pct('ont', 'n')} end on_time_percent, "
    "case when payments_complete and schedule_complete and window_start <= as_of - 180 and r >= 3 and q >= 3 then "
    f"round({_pct('ro', 'r')} - {_pct('qo', 'q')}, 2) end delta from imp i left join fold f on f.import_id = i.import_id)"
)
METRIC_STEPS = {**STEPS, "fold": FOLD, "metrics": METRICS}


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    return R.repayment_metrics(imports(spark, sf), status(spark, sf))


HEADLINE = [
    "import_id", "discipline_score", "on_time_percent", "payment_reliability_percent", "average_delay_days", "worst_delay_days",
    "payment_consistency_days", "due_count", "on_time_count", "late_payment_count", "missed_payment_count", "partial_overdue_count",
    "outstanding_overdue_count",
]
RECOVERY = ["import_id", "recovery_30d_percent", "recovery_eligible_count"]
IMPROVEMENT = ["import_id", "recent_improvement_pp", "recent_improvement"]


@query("repayment_metrics", with_views(BOTH, f"select {', '.join(HEADLINE)} from metrics", METRIC_STEPS))
def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics(spark, sf).select(*HEADLINE)


@query("repayment_recovery", with_views(BOTH, f"select {', '.join(RECOVERY)} from metrics", METRIC_STEPS))
def _recovery(spark: SparkSession, sf: str) -> DataFrame:
    return metrics(spark, sf).select(*RECOVERY)


@query("repayment_improvement", with_views(BOTH, f"select {', '.join(IMPROVEMENT)} from metrics", METRIC_STEPS))
def _improvement(spark: SparkSession, sf: str) -> DataFrame:
    return metrics(spark, sf).select(*IMPROVEMENT)


@query("repayment_timeline", with_views(
    BOTH, "select import_id, strftime(due_date, '%Y-%m') as \"month\", count(*) due_count, count(*) filter (where status = 'ON_TIME') on_time, "
    "count(*) filter (where status = 'LATE') late, count(*) filter (where status = 'MISSED') missed, count(*) filter (where status = 'PARTIAL') partial, "
    "count(*) filter (where status = 'UNKNOWN') \"unknown\", "
    f"case when bool_and(payments_complete) then {_pct('''count(*) filter (where status = 'ON_TIME')''', 'count(*)')} end on_time_percent, "
    f"case when bool_and(payments_complete) then {_pct(f'count(*) filter (where {MATURED} and {RECOVERED})', f'count(*) filter (where {MATURED})')} end recovery_30d_percent, "
    f"case when bool_and(payments_complete) then count(*) filter (where {MATURED}) end recovery_eligible_count from stat group by 1, 2", STEPS))
def _timeline(spark: SparkSession, sf: str) -> DataFrame:
    return R.timeline(status(spark, sf))


@query("repayment_coverage", with_views(
    BOTH, "select i.import_id, case when source_kind = 'DEMO' then 'DEMONSTRATION' else 'SELF_REPORTED' end basis, "
    "case when payments_complete and schedule_complete then 'DECLARED_COMPLETE' else 'LIMITED' end coverage_status, coalesce(n, 0) observed_installments, "
    "coalesce(acc, 0) accounts, cast(datediff('day', window_start, as_of) as integer) window_days, cast(coalesce(span, 0) as integer) observed_span_days, "
    "coalesce(tot, 0) - coalesce(n, 0) excluded_schedules, coalesce(fut, 0) excluded_future_payments, "
    "cast(payments_complete and schedule_complete and coalesce(n, 0) >= 6 and coalesce(span, 0) >= 90 as integer) score_available from imp i left join fold f using (import_id) "
    "left join (select import_id, count(distinct account_ref) acc, count(*) tot from sch group by 1) s using (import_id) "
    "left join (select import_id, count(*) fut from (select distinct * from pmt) where paid_date > " + AS_OF + " group by 1) p using (import_id)", METRIC_STEPS))
def _coverage(spark: SparkSession, sf: str) -> DataFrame:
    out = R.coverage_record(imports(spark, sf), schedules(spark, sf), payments(spark, sf), status(spark, sf))
    out = out.withColumn("score_available", F.col("score_available").cast("int"))
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("excluded_schedules", "excluded_future_payments", "accounts")})


LATE = "(completion > due_date or completion is null)"
REL = "coalesce(datediff('day', due_date, completion), datediff('day', due_date, as_of))"


@query("repayment_aggregates", with_views(
    BOTH, "select import_id, count(*) installment_due_count, count(completion) installment_fully_paid_count, "
    f"count(*) filter (where {LATE}) installment_late_count, count(*) filter (where completion is null) installment_unpaid_overdue_count, "
    f"avg(case when {LATE} then 1.0::double else 0 end) installment_late_rate, avg(datediff('day', due_date, completion)) installment_mean_signed_delay, "
    f"avg(greatest({REL}, 0)) installment_mean_overdue_days, cast(max(greatest({REL}, 0)) as integer) installment_max_overdue_days, "
    "round(avg(least(cast(paid as double) / owed, 1)), 9) installment_mean_paid_ratio from stat where payments_complete group by 1", STEPS))
def _aggregates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.relative_aggregates(status(spark, sf)), 9, "installment_mean_paid_ratio")


@query("import_checks", with_views(
    BOTH, "select 'Use an observation window ending on or before today' as rule, 0::bigint violations union all "
    "select 'Demo history uses unspecified currency XXX', count(*) from imp where source_kind = 'DEMO' and currency <> 'XXX' union all "
    "select 'Supply one effective version per account/installment', count(*) from (select import_id, account_ref, installment_ref from sch group by 1, 2, 3 having count(*) > 1) union all "
    "select 'Invalid due date', 0 union all select 'Conflicting duplicate payment event identity', count(*) from (select import_id, event_ref from pmt group by 1, 2 having count(distinct amount) > 1) union all "
    "select 'Invalid payment date', 0 union all select 'Payment references an unknown installment', count(*) from (select distinct import_id, account_ref, installment_ref from pmt "
    "where installment_ref like '%-7')", STEPS))
def _import_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Installments number seven are withheld from the schedule, so their payments are unknown."""
    kept = schedules(spark, sf).where("installment_ref not like '%-7'")
    return R.import_checks(imports(spark, sf), kept, payments(spark, sf))


CHANGED_COPIES = "select * from pmt union all select import_id, event_ref, account_ref, installment_ref, amount + 1, paid_date from pmt where import_id % 5 = 1"


@query("payment_replay_conflicts", with_views(
    BOTH, f"select import_id, event_ref, count(*) n_rows from ({CHANGED_COPIES}) group by 1, 2 having count(distinct amount) > 1", STEPS))
def _replay_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth import sends each event again with another amount."""
    rows = payments(spark, sf)
    again = rows.where("import_id % 5 = 1").withColumn("amount", F.col("amount") + 1)
    return R.replay_conflicts(rows.unionByName(again))


@query("event_settlements",
    "with seen as (select l_orderkey event_ref, cast(l_shipdate as date) d, coalesce(l_returnflag, '~') || coalesce(l_linestatus, '~') payload from lineitem "
    "where l_orderkey is not null and l_shipdate is not null), "
    "gaps as (select *, case when d - lag(d) over (partition by event_ref order by d) <= 10 then 0 else 1 end starts from seen), "
    "bursts as (select *, sum(starts) over (partition by event_ref order by d rows unbounded preceding) burst from gaps) "
    "select event_ref, min(d) first_seen, max(d) last_seen, count(*) copies, count(distinct payload) > 1 conflicting from bursts group by event_ref, burst")
def _settlements(spark: SparkSession, sf: str) -> DataFrame:
    """The verdicts of the payment stream over shipments: lines of an order at most ten days apart are copies of an event."""
    lines = views.table(spark, sf, "lineitem").withColumn("moment", F.col("l_shipdate").cast("timestamp")).withColumnRenamed("l_orderkey", "event_ref")
    rows = settled(lines, "moment", ["l_returnflag", "l_linestatus"], "10 days")
    return rows.select("event_ref", F.to_date("first_seen").alias("first_seen"), F.to_date("last_seen").alias("last_seen"), "copies", "conflicting")


JSON_SPARK = "to_json(named_struct('metrics', named_struct('discipline_score', case when value > 100 then value end, 'kind', event_type)))"
JSON_SQL = "case when value > 100 then value end"


@query("import_statistics",
       "select count(*) total_analyses, count(*) filter (where event_type = 'error') demonstration_analyses, count(*) - count(*) filter (where event_type = 'error') personal_analyses, "
       f"count({JSON_SQL}) filter (where event_type <> 'error') scored_personal_analyses, round(avg({JSON_SQL}) filter (where event_type <> 'error'), 2) average_discipline_score from events")
def _statistics(spark: SparkSession, sf: str) -> DataFrame:
    analyses = views.table(spark, sf, "events").selectExpr(
        "case when event_type = 'error' then 'DEMO' else 'USER_DECLARED' end as source_kind", f"{JSON_SPARK} as result_json"
    )
    return R.portfolio_statistics(analyses)


@query("idempotency_audit",
       "select user_id, request_key, count(*) n_rows, case when count(distinct event_type) > 1 then 'CONFLICT' else 'REPLAY' end outcome "
       "from (select user_id, cast(json_extract(props, '$.k') as bigint) request_key, event_type from events) group by 1, 2 having count(*) > 1")
def _idempotency(spark: SparkSession, sf: str) -> DataFrame:
    requests = views.table(spark, sf, "events").selectExpr(
        "user_id", "cast(get_json_object(props, '$.k') as bigint) as request_key", "event_type"
    )
    return R.idempotency_audit(requests, "user_id", "request_key", "event_type")
