"""Repayment metrics, planner and risk display: hand-computed answers."""

from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from loanloom import ContractError
from loanloom.functions import finance
from loanloom.operators import planner as P
from loanloom.operators import repayment as R
from loanloom.operators import risk as K
from loanloom.operators.contracts import first_reason

HEAD = "import_id long, source_kind string, currency string, as_of date, window_start date, schedule_complete boolean, payments_complete boolean"
SCHED = "import_id long, account_ref string, installment_ref string, due_date date, amount decimal(12,2)"
PAID = "import_id long, event_ref string, account_ref string, installment_ref string, paid_date date, amount decimal(12,2)"


def run(spark, schedules, payments, as_of=date(2025, 10, 1), start=date(2025, 1, 1), complete=True):
    head = spark.createDataFrame([(1, "USER_DECLARED", "INR", as_of, start, True, complete)], HEAD)
    s = spark.createDataFrame([(1, "A", ref, due, Decimal(amount)) for ref, due, amount in schedules], SCHED)
    p = spark.createDataFrame([(1, e, "A", ref, day, Decimal(amount)) for e, ref, day, amount in payments], PAID)
    status = R.installment_status(head, s, p)
    return status, R.repayment_metrics(head, status).first(), R.coverage_record(head, s, p, status).first()


TWO = [("1", date(2025, 8, 1), "100"), ("2", date(2025, 9, 1), "100")]


def test_late_and_missed(spark):
    status, m, _ = run(spark, TWO, [("a", "1", date(2025, 7, 30), "40"), ("b", "1", date(2025, 8, 5), "60")])
    assert (m.late_payment_count, m.missed_payment_count, m.average_delay_days, m.worst_delay_days) == (1, 1, 4, 30)
    assert (m.payment_reliability_percent, m.on_time_percent, m.recovery_30d_percent, m.discipline_score) == (20, 0, 50, None)
    first = status.where("installment_ref = '1'").first()
    assert (first.status, first.delay_days, first.funded_by_due) == ("LATE", 4, 400_000)
    months = {r.month: r for r in R.timeline(status).collect()}
    assert set(months) == {"2025-08", "2025-09"} and months["2025-08"].late == 1
    assert R.relative_aggregates(status).first().installment_max_overdue_days == 30


def test_unknown_payment_coverage(spark):
    status, m, c = run(spark, TWO, [("a", "1", date(2025, 7, 30), "100")], complete=False)
    assert {r.status for r in status.collect()} == {"UNKNOWN"}
    assert m.on_time_percent is None and m.missed_payment_count is None and c.coverage_status == "LIMITED"


def test_partial_outstanding(spark):
    _, m, _ = run(spark, TWO, [("a", "1", date(2025, 7, 1), "100"), ("b", "2", date(2025, 8, 20), "20")])
    assert (m.on_time_percent, m.late_payment_count, m.partial_overdue_count, m.missed_payment_count) == (50, 0, 1, 0)


def test_due_today_is_not_due(spark):
    _, m, c = run(spark, [("1", date(2025, 10, 1), "100")], [("a", "1", date(2025, 10, 2), "100")])
    assert (m.due_count, m.on_time_percent, c.excluded_future_payments, c.excluded_schedules) == (0, None, 1, 1)


def test_long_history(spark):
    due = [(str(i), date(2024, 10, 15) + timedelta(days=30 * i), "100") for i in range(12)]
    paid = [(f"p{i}", str(i), d + timedelta(days=5 if i < 6 else 0), "100") for i, (_, d, _) in enumerate(due)]
    _, m, c = run(spark, due, paid, start=date(2024, 10, 1))
    assert (m.discipline_score, m.payment_consistency_days, m.recent_improvement_pp) == (50, 2.5, 0)
    assert m.recent_improvement == "UNCHANGED" and c.score_available


def test_immature_follow_up(spark):
    _, m, _ = run(spark, [("1", date(2025, 9, 20), "100")], [])
    assert m.recovery_eligible_count == 0 and m.recovery_30d_percent is None


def test_replayed_event_counts_once(spark):
    event = ("a", "1", date(2025, 8, 1), "60")
    _, m, _ = run(spark, TWO, [event, event])
    assert m.partial_overdue_count == 1 and m.on_time_count == 0


def request(spark, **changes):
    base = dict(
        request_id=1, monthly_take_home_income=Decimal("120000"), monthly_gross_income=None, monthly_essential_expenses=Decimal("30000"),
        existing_monthly_debt_payments=Decimal("5000"), liquid_savings=Decimal("90000"), monthly_savings_goal=None,
        requested_amount=Decimal("500000"), annual_rate_percent=Decimal("12"), terms_months=[12, 24, 36], planning_priority="BALANCED",
    )
    schema = (
        "request_id long, monthly_take_home_income decimal(14,2), monthly_gross_income decimal(14,2), monthly_essential_expenses decimal(14,2), "
        "existing_monthly_debt_payments decimal(14,2), liquid_savings decimal(14,2), monthly_savings_goal decimal(14,2), "
        "requested_amount decimal(14,2), annual_rate_percent decimal(8,4), terms_months array<int>, planning_priority string"
    )
    return spark.createDataFrame([tuple({**base, **changes}.values())], schema)


def test_emi(spark):
    row = P.scenario_rows(request(spark, terms_months=[36])).first()
    assert row.emi == Decimal("16607.15")
    flat = P.scenario_rows(request(spark, requested_amount=Decimal("12000"), annual_rate_percent=Decimal("0"), terms_months=[12])).first()
    assert flat.emi == Decimal("1000.00") and flat.total_interest == 0
    tie = P.scenario_rows(request(spark, requested_amount=Decimal("0.06"), annual_rate_percent=Decimal("0"), terms_months=[12])).first()
    assert tie.emi == Decimal("0.01")


def test_stress(spark):
    rows = {r.income_drop_percent: r for r in P.stress_rows(request(spark, terms_months=[36])).collect()}
    assert rows[0].stressed_income == 120000 and rows[20].stressed_income == 96000
    assert rows[0].stressed_residual - rows[20].stressed_residual == 24000


def test_ranking_covers_all_terms_and_prefers_fit(spark):
    rows = P.rank_rows(request(spark, terms_months=[6, 12, 24, 60])).orderBy("rank").collect()
    assert [r.rank for r in rows] == [1, 2, 3, 4]
    fits = [r.fits_budget for r in rows]
    assert fits == sorted(fits, reverse=True)
    assert rows[0].explanation.endswith("It is the highest-ranked scenario.")
    single = P.rank_rows(request(spark, terms_months=[12])).first()
    assert single.rank_score == 100 and single.explanation.endswith("It is the highest-ranked scenario. It is the lowest-ranked scenario.")


def test_planner_plan_is_one_narrow_stage(spark):
    plan = P.rank_rows(request(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Python" not in plan


def test_request_rules(spark):
    def reason(**changes):
        return request(spark, **changes).select(first_reason(P.request_rules())).first()[0]

    assert reason() is None
    assert reason(terms_months=[12, 12]) == "Terms must be unique"
    assert reason(terms_months=[5]) == "Terms must be between 6 and 360 months"
    assert reason(requested_amount=Decimal("0")) == "requested_amount must be positive"


@pytest.mark.parametrize("p, band", [(0.0, "Low"), (0.049999, "Low"), (0.05, "Medium"), (0.149999, "Medium"), (0.15, "High"), (1.0, "High")])
def test_bands(spark, p, band):
    row = spark.range(1).select(finance.risk_band(F.lit(p)).alias("b"), finance.risk_score(F.lit(p)).alias("s")).first()
    assert row.b == band and (p != 0.049999 or row.s == 5.0)


def test_sandbox_never_decides(spark):
    df = spark.createDataFrame([(0.01,), (0.1,), (0.9,)], "p double").withColumns(
        {c: F.lit(True) for c in ("release_ready", "data_valid", "supported", "verified", "affordable", "product_eligible")}
    ).withColumns({"variant": F.lit("full"), "model_version": F.lit("m")})
    rows = K.apply_policy(df, K.Policy()).collect()
    assert [r.recommendation for r in rows] == ["APPROVAL_CANDIDATE", "MANUAL_REVIEW", "REJECTION_CANDIDATE"]
    assert {r.decision_status for r in rows} == {"MANUAL_REVIEW"}


def test_policy_rules():
    with pytest.raises(ContractError):
        K.Policy(approve_below=0.2, reject_at=0.1)
    with pytest.raises(ContractError):
        K.Policy(mode="LIVE")


@pytest.mark.parametrize("burden, score", [(0, 100), (0.2, 100), (0.3, 75), (0.4, 50), (0.7, 25), (1, 0), (3.34, 0)])
def test_affordability_score(spark, burden, score):
    assert spark.range(1).select(finance.affordability_score(F.lit(float(burden)))).first()[0] == pytest.approx(score)


def test_web_estimate(spark):
    df = spark.createDataFrame([(600000.0, 450000.0, 36, None)], "annual_income double, principal double, months int, emi double")
    row = K.affordability(df).first()
    assert round(row.emi, 2) == 14946.44 and round(row.burden, 7) == 0.2989288 and row.recommended_max_emi == 15000
    assert K.loan_ranges(df).count() == 3
