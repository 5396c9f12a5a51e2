"""Catalogue: borrowing planner."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.operators import planner as P
from loanloom.operators.contracts import with_reason
from loanloom.plans import views
from loanloom.plans.registry import query, rounded
from loanloom.plans.views import with_views

REQUEST = {
    "request_id": "SK_ID_CURR",
    "monthly_take_home_income": "cast(round(AMT_INCOME_TOTAL, 2) as decimal(14,2))",
    "monthly_gross_income": "cast(case when SK_ID_CURR % 3 = 0 then null else round(AMT_INCOME_TOTAL * 5 / 4, 2) end as decimal(14,2))",
    "monthly_essential_expenses": "cast(floor(AMT_INCOME_TOTAL / 3) as decimal(14,2))",
    "existing_monthly_debt_payments": "cast(floor(AMT_INCOME_TOTAL / 20) as decimal(14,2))",
    "liquid_savings": "cast(case when SK_ID_CURR % 5 = 0 then null else floor(AMT_INCOME_TOTAL * 2) end as decimal(14,2))",
    "monthly_savings_goal": "cast(case when SK_ID_CURR % 4 = 0 then null else floor(AMT_INCOME_TOTAL / 10) end as decimal(14,2))",
    "requested_amount": "cast(round(AMT_CREDIT, 2) as decimal(14,2))",
    "annual_rate_percent": "cast(case when SK_ID_CURR % 10 = 0 then 0 else 12 end as decimal(8,4))",
    "planning_priority": "case SK_ID_CURR % 3 when 0 then 'LOWER_EMI' when 1 then 'LOWER_TOTAL_INTEREST' else 'BALANCED' end",
}
TERMS_SPARK, TERMS_SQL = "array(12, 24, 36, 48, 60)", "[12, 24, 36, 48, 60]"


def requests(spark: SparkSession, sf: str) -> DataFrame:
    raw = views.raw_applications(spark, sf).where("AMT_INCOME_TOTAL > 0")
    return raw.selectExpr(*[f"{v} as {k}" for k, v in REQUEST.items()], f"{TERMS_SPARK} as terms_months")


SCENARIO = (
    "select *, emi * term total, greatest(0, emi * term - amount) interest, income - expenses - debt - emi residual, debt + emi service from ("
    "select *, case when rate = 0 then cast((cast(amount * 200 as bigint) + term) // (2 * term) as decimal(16,2)) * 0.01 else cast(round(cast(amount as double) * (cast(rate as double) / 1200) / "
    "(1 - pow(1 + cast(rate as double) / 1200, -term::double)), 2) as decimal(16,2)) end emi from ("
    "select request_id, monthly_take_home_income income, monthly_gross_income gross, monthly_essential_expenses expenses, existing_monthly_debt_payments debt, "
    "monthly_savings_goal goal, requested_amount amount, annual_rate_percent rate, planning_priority priority, t.term from req, (values (12), (24), (36), (48), (60)) t(term)))"
)
POINTS = (
    "select *, residual - goal goal_residual, coalesce(residual - goal, residual) budget, case when service <= 0.20 * income then 60::double when service >= 0.40 * income then 0::double "
    "else 60 * (0.40::double - cast(service as double) / cast(income as double)) / 0.20::double end bp, "
    "40 * least(greatest(cast(residual as double) / cast(income as double) / 0.30::double, 0), 1) rp from scen"
)
STEPS = {
    "req": "select " + ", ".join(f"{v} as {k}" for k, v in REQUEST.items()) + " from v_raw where AMT_INCOME_TOTAL > 0",
    "scen": SCENARIO, "pts": POINTS,
}
V = ["v_raw"]


def _doubles(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


@query("planner_scenarios", with_views(
    V, "select request_id, term term_months, cast(emi as double) emi, cast(total as double) total_repayment, cast(interest as double) total_interest, "
    "cast(residual as double) residual, cast(goal_residual as double) goal_residual, cast(round(bp + rp, 0) as integer) planning_fit_score, "
    "round(bp, 2) burden_points, round(rp, 2) residual_points, cast(budget >= 0 as integer) fits_budget, cast(goal_residual >= 0 as integer) goal_fit, "
    "cast(debt as double) / cast(gross as double) current_dti, cast(service as double) / cast(gross as double) proposed_dti, "
    "cast(debt as double) / cast(income as double) current_payment_ratio, cast(service as double) / cast(income as double) proposed_payment_ratio from pts", STEPS))
def _scenarios(spark: SparkSession, sf: str) -> DataFrame:
    out = P.scenario_rows(requests(spark, sf))
    out = _doubles(out, "emi", "total_repayment", "total_interest", "residual", "goal_residual")
    return out.withColumns({c: F.col(c).cast("int") for c in ("fits_budget", "goal_fit")})


@query("planner_stress", with_views(
    V, "select request_id, term term_months, d.pct income_drop_percent, round(cast(income as double) * (100 - pct) / 100, 2) stressed_income, "
    "round(cast(service as double) / (cast(income as double) * (100 - pct) / 100), 9) debt_service_ratio, "
    "cast(round(cast(income * (100 - pct) as decimal(20,4)) * 0.01 - expenses - debt - emi, 2) as double) stressed_residual, "
    "cast(round(cast(income * (100 - pct) as decimal(20,4)) * 0.01 - expenses - debt - emi - goal, 2) as double) stressed_goal_residual "
    "from scen, (values (0), (10), (20), (30)) d(pct)", STEPS))
def _stress(spark: SparkSession, sf: str) -> DataFrame:
    out = _doubles(P.stress_rows(requests(spark, sf)), "stressed_income", "stressed_residual", "stressed_goal_residual")
    return rounded(out, 9, "debt_service_ratio")


RANK = (
    "select *, row_number() over (partition by request_id order by case when budget >= 0 or not any_fit then 0 else 1 end, "
    "case when any_fit then -rank_score else greatest(-cast(budget as double), 0) end, -rank_score, -budget, interest, term) rk from ("
    "select *, round(mr * case priority when 'LOWER_EMI' then 0.7::double when 'LOWER_TOTAL_INTEREST' then 0.3::double else 0.5::double end "
    "+ ir * case priority when 'LOWER_EMI' then 0.3::double when 'LOWER_TOTAL_INTEREST' then 0.7::double else 0.5::double end, 2) rank_score from ("
    "select *, bool_or(budget >= 0) over w any_fit, case when min(emi) over w = max(emi) over w then 100 else (cast(max(emi) over w as double) - cast(emi as double)) * 100 / "
    "(cast(max(emi) over w as double) - cast(min(emi) over w as double)) end mr, case when min(interest) over w = max(interest) over w then 100 else "
    "(cast(max(interest) over w as double) - cast(interest as double)) * 100 / (cast(max(interest) over w as double) - cast(min(interest) over w as double)) end ir "
    "from pts window w as (partition by request_id)))"
)
RANK_STEPS = {**STEPS, "rnk": RANK}


@query("planner_rank", with_views(
    V, "select request_id, cast(rk as integer) rank, term term_months, round(mr, 2) monthly_room_score, round(ir, 2) interest_saving_score, rank_score from rnk", RANK_STEPS))
def _rank(spark: SparkSession, sf: str) -> DataFrame:
    return P.rank_rows(requests(spark, sf)).select(
        "request_id", "rank", "term_months", "monthly_room_score", "interest_saving_score", "rank_score"
    )


def _diff(mine: str, other: str) -> str:
    return (f"case when {mine} = {other} then 'the same' else concat('₹', cast(cast(abs({mine} - {other}) as decimal(20,2)) as string), ' ', "
            f"case when {mine} < {other} then 'lower' else 'higher' end) end")


EXPLAIN = (
    "select request_id, rank, concat('Ranks #', rank, ' for ', case priority when 'LOWER_EMI' then 'lower monthly payments' when 'LOWER_TOTAL_INTEREST' then 'lower total interest' "
    "else 'a balance of monthly payments and total interest' end, ' with a combined rank score of ', format('{:.1f}', round(rank_score, 1)), '/100 (', "
    "case priority when 'LOWER_EMI' then '70% monthly room, 30' when 'LOWER_TOTAL_INTEREST' then '30% monthly room, 70' else '50% monthly room, 50' end, '% interest saving). "
    "It earns a monthly-room score of ', format('{:.1f}', round(round(mr, 2), 1)), ' and an interest-saving score of ', format('{:.1f}', round(round(ir, 2), 1)), '.', "
    "case when budget >= 0 then ' It fits your stated budget.' when any_fit then ' It ranks after scenarios that fit your stated budget.' else '' end, "
    "case when ta is null then '' else concat(' Compared with the ', ta, '-month option ranked above, its monthly EMI is ', " + _diff("emi", "ea")
    + ", ' and its total interest is ', " + _diff("interest", "ia") + ", '.') end, "
    "case when tb is null then '' else concat(' Compared with the ', tb, '-month option ranked below, its monthly EMI is ', " + _diff("emi", "eb")
    + ", ' and its total interest is ', " + _diff("interest", "ib") + ", '.') end, "
    "case when ta is null then ' It is the highest-ranked scenario.' else '' end, case when tb is null then ' It is the lowest-ranked scenario.' else '' end) explanation from ("
    "select *, cast(rk as integer) rank, lag(term) over w ta, lag(emi) over w ea, lag(interest) over w ia, lead(term) over w tb, lead(emi) over w eb, lead(interest) over w ib "
    "from rnk window w as (partition by request_id order by rk))"
)


@query("planner_explanations", with_views(V, EXPLAIN, RANK_STEPS))
def _explanations(spark: SparkSession, sf: str) -> DataFrame:
    return P.rank_rows(requests(spark, sf)).select("request_id", "rank", "explanation")


@query("planner_summary", with_views(
    V, "select request_id, cast(greatest(0, monthly_take_home_income - monthly_essential_expenses - existing_monthly_debt_payments) as double) headroom_before_goal, "
    "cast(case when monthly_savings_goal is not null then greatest(0, greatest(0, monthly_take_home_income - monthly_essential_expenses - existing_monthly_debt_payments) - monthly_savings_goal) end as double) headroom_after_goal, "
    "case when monthly_essential_expenses > 0 then cast(liquid_savings as double) / cast(monthly_essential_expenses as double) end savings_buffer_months, "
    "cast(existing_monthly_debt_payments as double) / cast(monthly_gross_income as double) current_dti, "
    "cast(existing_monthly_debt_payments as double) / cast(monthly_take_home_income as double) current_payment_ratio, "
    "4 + cast(monthly_savings_goal is null as integer) + cast(monthly_gross_income is null as integer) + cast(n.neg as integer) n_warnings "
    "from req join (select request_id, bool_or(residual < 0) neg from scen group by 1) n using (request_id)", STEPS))
def _summary(spark: SparkSession, sf: str) -> DataFrame:
    out = P.request_summary(requests(spark, sf))
    out = _doubles(out, "headroom_before_goal", "headroom_after_goal")
    return out.withColumn("n_warnings", F.size("warnings")).drop("warnings")


@query("planner_request_rules", with_views(
    V, "select SK_ID_CURR request_id, case when AMT_INCOME_TOTAL <= 0 then 'monthly_take_home_income must be positive' when SK_ID_CURR % 17 = 5 then 'Terms must be between 6 and 360 months' "
    "when SK_ID_CURR % 19 = 5 then 'Terms must be unique' when SK_ID_CURR % 23 = 5 then 'Unknown planning priority' "
    "when SK_ID_CURR % 29 = 5 then 'total_outstanding_debt must not be negative' when SK_ID_CURR % 31 = 5 then 'liquid_savings has more than two decimals' "
    "when SK_ID_CURR % 37 = 5 then 'As-of date cannot be in the future' when SK_ID_CURR % 41 = 5 then 'Loan purpose is longer than 120 characters' end reason from v_raw"))
def _rules(spark: SparkSession, sf: str) -> DataFrame:
    expense = {k: f"greatest({v}, cast(0 as decimal(14,2)))" for k, v in REQUEST.items() if k.endswith(("expenses", "payments", "goal", "savings"))}
    texts = {**REQUEST, **expense}
    texts["monthly_savings_goal"] = "cast(null as decimal(14,2))"
    texts["monthly_gross_income"] = "cast(null as decimal(14,2))"
    texts["planning_priority"] = "case when SK_ID_CURR % 23 = 5 then 'FASTEST' else 'BALANCED' end"
    texts["total_outstanding_debt"] = "cast(if(SK_ID_CURR % 29 = 5, -0.01, 0) as decimal(14,2))"
    texts["liquid_savings"] = "if(SK_ID_CURR % 31 = 5, cast(10.005 as double), cast(10.25 as double))"
    texts["as_of"] = "if(SK_ID_CURR % 37 = 5, date_add(current_date(), 2), current_date())"
    texts["loan_purpose"] = "repeat('x', if(SK_ID_CURR % 41 = 5, 121, 120))"
    terms = "case when SK_ID_CURR % 17 = 5 then array(12, 400) when SK_ID_CURR % 19 = 5 then array(12, 12) else array(12, 24) end as terms_months"
    raw = views.raw_applications(spark, sf).selectExpr(*[f"{v} as {k}" for k, v in texts.items()], terms)
    return with_reason(raw, P.request_rules(raw.columns)).select("request_id", "reason")
