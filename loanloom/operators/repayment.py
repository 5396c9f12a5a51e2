"""Repayment intelligence for imported schedules and payments, one result per import.

``imports``   import_id, source_kind, as_of, window_start, schedule_complete, payments_complete
``schedules`` import_id, account_ref, installment_ref, due_date, amount
``payments``  import_id, event_ref, account_ref, installment_ref, paid_date, amount

All steps aggregate before they join, so one import may hold a large part of all
rows: obligations are partitioned by (import, account, installment), metrics are
combinable aggregates per import, and what is left to join on the import alone is
dealt over parts of a heavy import (``salted``).  Payments never meet the import:
the obligation they belong to carries its cut-off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.functions.nullsafe import MINOR_SCALE, ratio, to_minor
from loanloom.operators.asof import collapse_replays
from loanloom.operators.contracts import (
    Rule, count_as, duplicate_keys, union_reports, violation_counts,
)
from loanloom.operators.history.installments import behaviour
from loanloom.operators.reconcile import daily_totals, settle
from loanloom.operators.salted import header_join

IMPORT = "import_id"
PAYMENT = ["account_ref", "installment_ref", "paid_date", "amount"]
KEYS = [IMPORT, "account_ref", "installment_ref"]
TOLERANCE = MINOR_SCALE // 100
HEADER = ["as_of", "window_start", "payments_complete", "schedule_complete", "source_kind"]
FIRST_DAY, LAST_DAY = "1900-01-01", "2200-01-01"


def percentage(part: Column, whole: Column) -> Column:
    return F.round(ratio(100 * part, whole), 2)


def import_checks(imports: DataFrame, schedules: DataFrame, payments: DataFrame) -> DataFrame:
    """Window order, unique installments, known installments, date bounds and replays."""
    day = F.col
    window = [
        Rule("Use an observation window ending on or before today",
             ~F.coalesce(day("window_start").between(F.lit(FIRST_DAY).cast("date"), day("as_of"))
                         & (day("as_of") <= F.current_date()), F.lit(False))),
        Rule("Demo history uses unspecified currency XXX", (day("source_kind") == "DEMO") & (day("currency") != "XXX")),
    ]
    due = [Rule("Invalid due date",
                ~F.coalesce(day("due_date").between(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date")), F.lit(False)))]
    events = payments.withColumn("_event", F.struct(IMPORT, "event_ref"))
    seen = collapse_replays(events, "_event", ["account_ref", "installment_ref", "paid_date", "amount"])
    paid = [
        Rule("Conflicting duplicate payment event identity", day("conflicting")),
        Rule("Invalid payment date",
             ~F.coalesce(day("paid_date").between(F.lit(FIRST_DAY).cast("date"), F.current_date()), F.lit(False))),
    ]
    unknown = payments.select(*KEYS).distinct().join(schedules.select(*KEYS).distinct(), KEYS, "left_anti")
    return union_reports(
        [
            violation_counts(imports, window),
            count_as(duplicate_keys(schedules, KEYS), "Supply one effective version per account/installment"),
            violation_counts(schedules, due),
            violation_counts(seen, paid),
            count_as(unknown, "Payment references an unknown installment"),
        ]
    )


def _single_events(payments: DataFrame, tasks: int | None = None) -> DataFrame:
    """Identical replays of an event reduced to one payment; events whose copies disagree are set aside."""
    if tasks:
        payments = payments.repartition(tasks, IMPORT, "event_ref")
    single = collapse_replays(payments, [IMPORT, "event_ref"], PAYMENT).where(~F.col("conflicting"))
    return single.drop("n_rows", "conflicting").withColumn("_minor", to_minor(F.col("amount")))


def replay_conflicts(payments: DataFrame) -> DataFrame:
    """Payment events whose copies disagree in any field: ``import_id, event_ref, n_rows``."""
    return collapse_replays(payments, [IMPORT, "event_ref"], PAYMENT).where("conflicting").select(IMPORT, "event_ref", "n_rows")


def installment_status(imports: DataFrame, schedules: DataFrame, payments: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per due obligation with paid amounts, completion, delay and status.

    ``tasks`` deals events and obligations over so many tasks, for payments that are many for the session's shuffles
    and of which no event or obligation has a large part; without it copies and days are summed before they are dealt.
    """
    header = imports.select(IMPORT, F.struct(*HEADER).alias("_header"))
    events = _single_events(payments, tasks)
    if tasks:  # serves the daily totals, the running totals and the join
        events = events.repartition(tasks, *KEYS)
    daily = daily_totals(events, KEYS, "paid_date", "_minor")
    owed = schedules.select(*KEYS, "due_date", to_minor(F.col("amount")).alias("_owed"))
    due = (
        header_join(owed, header, IMPORT, deal=KEYS, tasks=tasks)
        .withColumn("as_of", F.col("_header.as_of"))
        .where((F.col("_header.window_start") <= F.col("due_date")) & (F.col("due_date") < F.col("as_of")))
    )
    if tasks:  # as the events are, so that neither side is dealt again by the session's number
        due = due.repartition(tasks, *KEYS)
    settled = settle(
        due, daily, KEYS, due_day="due_date", due_amount="_owed", day="paid_date", amount="_minor", tolerance=TOLERANCE,
        until="as_of",
    )
    settled = settled.withColumns({c: F.col(f"_header.{c}") for c in HEADER}).drop("_header")
    known = F.col("payments_complete")
    delay = F.date_diff(F.col("completion"), F.col("due_date"))
    status = (
        F.when(~known, "UNKNOWN")
        .when(delay <= 0, "ON_TIME")
        .when(delay > 0, "LATE")
        .when(F.col("paid") > 0, "PARTIAL")
        .otherwise("MISSED")
    )
    open_days = F.date_diff(F.col("as_of"), F.col("due_date"))
    return settled.withColumns(
        {
            "status": status,
            "delay_days": F.when(known, delay),
            "overdue_days": F.when(known, F.greatest(F.coalesce(delay, open_days), F.lit(0))),
            "completion_date": F.when(known, F.col("completion")),
            "funded_by_due": F.least(F.col("_owed"), F.col("paid_by_due")),
            "shortfall": F.when(known, F.greatest(F.col("_owed") - F.col("paid"), F.lit(0))),
        }
    )


def _recovered() -> Column:
    return (F.col("status") == "LATE") & (F.col("delay_days") <= 30)


def _matured() -> Column:
    old = F.col("due_date") <= F.date_sub(F.col("as_of"), 30)
    return old & F.col("status").isin("LATE", "MISSED", "PARTIAL")


def repayment_metrics(imports: DataFrame, status: DataFrame) -> DataFrame:
    """All headline metrics per import; imports without due obligations keep their row."""
    s, delay = F.col("status"), F.col("delay_days")
    completed = s.isin("ON_TIME", "LATE")
    recent = F.col("due_date") >= F.date_sub(F.col("as_of"), 90)
    prior = (F.col("due_date") >= F.date_sub(F.col("as_of"), 180)) & ~recent
    folded = status.groupBy(IMPORT).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(s == "ON_TIME").alias("on_time"),
        F.count_if(s == "LATE").alias("late"),
        F.count_if(s == "MISSED").alias("missed"),
        F.count_if(s == "PARTIAL").alias("partial"),
        F.sum("funded_by_due").alias("funded"),
        F.sum("_owed").alias("owed"),
        F.round(F.avg(F.when(s == "LATE", delay)), 2).alias("average_delay_days"),
        F.max("overdue_days").alias("worst_delay_days"),
        F.count_if(completed).alias("completed"),
        F.stddev_pop(F.when(completed, delay)).alias("timing_std"),
        F.count_if(_matured()).alias("matured"),
        F.count_if(_matured() & _recovered()).alias("recovered"),
        F.count_if(recent).alias("recent"),
        F.count_if(recent & (s == "ON_TIME")).alias("recent_on_time"),
        F.count_if(prior).alias("prior"),
        F.count_if(prior & (s == "ON_TIME")).alias("prior_on_time"),
        F.date_diff(F.max("due_date"), F.min("due_date")).alias("span"),
    )
    joined = imports.select(IMPORT, "as_of", "window_start", "payments_complete", "schedule_complete").join(
        folded, IMPORT, "left"
    )
    zeros = ["n", "on_time", "late", "missed", "partial", "completed", "matured", "recovered", "recent", "prior", "span"]
    joined = joined.withColumns({z: F.coalesce(F.col(z), F.lit(0)) for z in zeros})
    known = F.col("payments_complete")

    def when_known(value: Column) -> Column:
        return F.when(known, value)

    on_time = when_known(percentage(F.col("on_time"), F.col("n")))
    scored = known & F.col("schedule_complete") & (F.col("n") >= 6) & (F.col("span") >= 90)
    comparable = (
        known & F.col("schedule_complete") & (F.col("window_start") <= F.date_sub(F.col("as_of"), 180))
        & (F.col("recent") >= 3) & (F.col("prior") >= 3)
    )
    delta = F.round(
        percentage(F.col("recent_on_time"), F.col("recent")) - percentage(F.col("prior_on_time"), F.col("prior")), 2
    )
    trend = F.when(delta > 0, "IMPROVING").when(delta < 0, "DECLINING").otherwise("UNCHANGED")
    return joined.select(
        IMPORT,
        F.when(scored, on_time).alias("discipline_score"),
        on_time.alias("on_time_percent"),
        when_known(percentage(F.col("funded"), F.col("owed"))).alias("payment_reliability_percent"),
        "average_delay_days",
        when_known(F.col("worst_delay_days")).alias("worst_delay_days"),
        F.when(F.col("completed") >= 2, F.round(F.col("timing_std"), 2)).alias("payment_consistency_days"),
        F.col("n").alias("due_count"),
        when_known(F.col("on_time")).alias("on_time_count"),
        when_known(F.col("late")).alias("late_payment_count"),
        when_known(F.col("missed")).alias("missed_payment_count"),
        when_known(F.col("partial")).alias("partial_overdue_count"),
        when_known(F.col("missed") + F.col("partial")).alias("outstanding_overdue_count"),
        when_known(percentage(F.col("recovered"), F.col("matured"))).alias("recovery_30d_percent"),
        when_known(F.col("matured")).alias("recovery_eligible_count"),
        F.when(comparable, delta).alias("recent_improvement_pp"),
        F.when(comparable, trend).otherwise("INSUFFICIENT_HISTORY").alias("recent_improvement"),
    )


def timeline(status: DataFrame) -> DataFrame:
    """Monthly counts and recovery per import."""
    s = F.col("status")
    known = F.bool_and(F.col("payments_complete"))
    eligible = F.count_if(_matured())
    return status.groupBy(IMPORT, F.date_format("due_date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("due_count"),
        F.count_if(s == "ON_TIME").alias("on_time"),
        F.count_if(s == "LATE").alias("late"),
        F.count_if(s == "MISSED").alias("missed"),
        F.count_if(s == "PARTIAL").alias("partial"),
        F.count_if(s == "UNKNOWN").alias("unknown"),
        F.when(known, percentage(F.count_if(s == "ON_TIME"), F.count(F.lit(1)))).alias("on_time_percent"),
        F.when(known, percentage(F.count_if(_matured() & _recovered()), eligible)).alias("recovery_30d_percent"),
        F.when(known, eligible).alias("recovery_eligible_count"),
    )


def coverage_record(
    imports: DataFrame, schedules: DataFrame, payments: DataFrame, status: DataFrame
) -> DataFrame:
    """What the metrics of an import rest on, and what was left out."""
    observed = status.groupBy(IMPORT).agg(
        F.count(F.lit(1)).alias("observed_installments"),
        F.date_diff(F.max("due_date"), F.min("due_date")).alias("observed_span_days"),
    )
    supplied = schedules.groupBy(IMPORT, "account_ref").agg(F.count(F.lit(1)).alias("n"))
    accounts = supplied.groupBy(IMPORT).agg(F.count(F.lit(1)).alias("accounts"), F.sum("n").alias("schedules"))
    # reduced to (import, day) before they meet the import's as_of, so an import brings at most a row per calendar day
    per_day = _single_events(payments).groupBy(IMPORT, "paid_date").agg(F.count(F.lit(1)).alias("n"))
    later = (
        per_day.join(imports.select(IMPORT, "as_of"), IMPORT)
        .where(F.col("paid_date") > F.col("as_of"))
        .groupBy(IMPORT)
        .agg(F.sum("n").alias("excluded_future_payments"))
    )
    joined = imports.join(observed, IMPORT, "left").join(accounts, IMPORT, "left").join(later, IMPORT, "left")
    count, span = F.coalesce("observed_installments", F.lit(0)), F.coalesce("observed_span_days", F.lit(0))
    complete = F.col("payments_complete") & F.col("schedule_complete")
    return joined.select(
        IMPORT,
        F.when(F.col("source_kind") == "DEMO", "DEMONSTRATION").otherwise("SELF_REPORTED").alias("basis"),
        F.when(complete, "DECLARED_COMPLETE").otherwise("LIMITED").alias("coverage_status"),
        count.alias("observed_installments"),
        F.coalesce("accounts", F.lit(0)).alias("accounts"),
        F.date_diff("as_of", "window_start").alias("window_days"),
        span.alias("observed_span_days"),
        (F.coalesce("schedules", F.lit(0)) - count).alias("excluded_schedules"),
        F.coalesce("excluded_future_payments", F.lit(0)).alias("excluded_future_payments"),
        (complete & (count >= 6) & (span >= 90)).alias("score_available"),
    )


def relative_aggregates(status: DataFrame) -> DataFrame:
    """The nine installment features of an import, on days relative to its as_of.

    The account is used as it is named; numbering accounts would need a ranking
    per import and cannot change any of the nine values.
    """
    days = status.where("payments_complete").withColumns(
        {
            "due": F.date_diff("due_date", "as_of"),
            "completion": F.date_diff("completion", "as_of"),
        }
    )
    return behaviour(days, [IMPORT], "due", "_owed")


def portfolio_statistics(analyses: DataFrame) -> DataFrame:
    """Totals over stored analyses; demonstration scores are never pooled with personal ones.

    ``analyses`` carries source_kind and result_json with metrics.discipline_score.
    """
    score = F.get_json_object("result_json", "$.metrics.discipline_score").try_cast("double")
    personal = F.col("source_kind") == "USER_DECLARED"
    return analyses.agg(
        F.count(F.lit(1)).alias("total_analyses"),
        F.count_if(F.col("source_kind") == "DEMO").alias("demonstration_analyses"),
        (F.count(F.lit(1)) - F.count_if(F.col("source_kind") == "DEMO")).alias("personal_analyses"),
        F.count(F.when(personal, score)).alias("scored_personal_analyses"),
        F.round(F.avg(F.when(personal, score)), 2).alias("average_discipline_score"),
    )


def idempotency_audit(requests: DataFrame, owner: str, key: str, content: str) -> DataFrame:
    """Replays and conflicts of (owner, key): the same content again, or different content."""
    grouped = requests.groupBy(owner, key).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(content).alias("_lo"), F.max(content).alias("_hi"), F.count(content).alias("_known")
    )
    mixed = (F.col("_known") > 0) & (F.col("_known") < F.col("n_rows"))
    outcome = F.when((F.col("_lo") != F.col("_hi")) | mixed, "CONFLICT").otherwise("REPLAY")
    return grouped.where("n_rows > 1").select(owner, key, "n_rows", outcome.alias("outcome"))
