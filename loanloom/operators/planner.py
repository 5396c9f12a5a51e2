"""Borrowing scenarios for a whole table of requests.

A request's terms stay an array inside its row: scenarios are computed,
normalized, ranked and explained with array functions in one narrow stage.  The
plan has no shuffle, no join and no window, whatever the number of requests.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.functions.finance import annuity_payment
from loanloom.functions.nullsafe import ratio
from loanloom.operators.contracts import Rule

# Request limits, stress levels and ranking weights.
DEFAULT_TERMS = [12, 24, 36, 48, 60]
MIN_TERM, MAX_TERM, MAX_TERMS = 6, 360, 12
MAX_AMOUNT = 1_000_000_000
MAX_RATE = 1000
STRESS_LEVELS = (0, 10, 20, 30)
WEIGHTS = {
    "LOWER_EMI": (0.70, 0.30),
    "LOWER_TOTAL_INTEREST": (0.30, 0.70),
    "BALANCED": (0.50, 0.50),
}

# Texts of explanations and warnings.
PREFERENCE = {
    "LOWER_EMI": "lower monthly payments",
    "LOWER_TOTAL_INTEREST": "lower total interest",
    "BALANCED": "a balance of monthly payments and total interest",
}
WARNINGS = (
    "Illustrative planning estimate, not a loan offer or eligibility decision.",
    "Inputs are user-declared and unverified; no fees, taxes, insurance, or lender-specific terms are included.",
    "Stress tests reduce take-home income while holding expenses and debt payments fixed.",
    "Planning Fit Score is an unvalidated research heuristic, not a lending score.",
)
NO_GOAL = "Monthly savings goal was not supplied; goal-adjusted residual and goal-based headroom are unavailable."
NO_GROSS = "Gross monthly income was not supplied; conventional debt-to-income ratios are unavailable."
NEGATIVE = "One or more scenarios produce negative residual monthly income."

MONEY = "decimal(14,2)"
INCOME, GROSS = "monthly_take_home_income", "monthly_gross_income"
EXPENSES, DEBT = "monthly_essential_expenses", "existing_monthly_debt_payments"
GOAL, SAVINGS, OUTSTANDING = "monthly_savings_goal", "liquid_savings", "total_outstanding_debt"
MAX_PURPOSE = 120


def request_rules(columns: Sequence[str] = ()) -> list[Rule]:
    """Bounds of a request; ``reason`` of a clean request is null.

    ``columns`` names the optional ones that the requests bring: as_of, total_outstanding_debt and loan_purpose.
    Amounts have two decimals and the rate four, in whatever type they come.
    """
    terms = F.col("terms_months")
    rules = [
        Rule(f"{name} must be positive", ~F.coalesce((F.col(name) > 0) & (F.col(name) <= MAX_AMOUNT), F.lit(False)))
        for name in (INCOME, "requested_amount")
    ]
    rules += [Rule(f"{GROSS} must be positive", ~F.col(GROSS).between(F.lit("0.01").cast(MONEY), F.lit(MAX_AMOUNT)))]
    rules += [
        Rule(f"{name} must not be negative", ~F.coalesce(F.col(name).between(0, MAX_AMOUNT), F.lit(False)))
        for name in (EXPENSES, DEBT)
    ]
    rules += [Rule(f"{name} must not be negative", ~F.col(name).between(0, MAX_AMOUNT)) for name in (GOAL, SAVINGS)]
    rules += [
        Rule("Rate must be between 0 and 1000", ~F.coalesce(F.col("annual_rate_percent").between(0, MAX_RATE), F.lit(False))),
        Rule("One to twelve terms required", ~F.coalesce(F.size(terms).between(1, MAX_TERMS), F.lit(False))),
        Rule("Terms must be between 6 and 360 months",
             ~F.coalesce(F.forall(terms, lambda t: t.between(MIN_TERM, MAX_TERM)), F.lit(False))),
        Rule("Terms must be unique", F.size(F.array_distinct(terms)) != F.size(terms)),
        Rule("Unknown planning priority", ~F.coalesce(F.col("planning_priority").isin(list(WEIGHTS)), F.lit(False))),
    ]
    amounts = [INCOME, "requested_amount", GROSS, EXPENSES, DEBT, GOAL, SAVINGS]
    if OUTSTANDING in columns:
        rules.append(Rule(f"{OUTSTANDING} must not be negative", ~F.col(OUTSTANDING).between(0, MAX_AMOUNT)))
        amounts.append(OUTSTANDING)
    rules += [Rule(f"{name} has more than two decimals", _finer(name, 2)) for name in amounts]
    rules.append(Rule("Rate has more than four decimals", _finer("annual_rate_percent", 4)))
    if "as_of" in columns:
        rules.append(Rule("As-of date cannot be in the future", F.col("as_of") > F.current_date()))
    if "loan_purpose" in columns:
        rules.append(Rule("Loan purpose is longer than 120 characters", F.char_length("loan_purpose") > MAX_PURPOSE))
    return rules


def _finer(name: str, digits: int) -> Column:
    """Whether a number has more decimals than ``digits``; as text, so that doubles are read as they are written."""
    exact = F.col(name).cast("string").cast("decimal(38,12)")
    return exact != F.round(exact, digits)


def fit_points(income: Column, service: Column, residual: Column) -> tuple[Column, Column]:
    """Burden points (60 down to 0 between 20% and 40%) and residual points (up to 40)."""
    burden = ratio(service, income)
    low, high = income * F.lit("0.20").cast("decimal(3,2)"), income * F.lit("0.40").cast("decimal(3,2)")
    sliding = 60 * (0.40 - burden) / 0.20
    burden_points = F.when(service <= low, F.lit(60.0)).when(service >= high, F.lit(0.0)).otherwise(sliding)
    room = ratio(residual, income) / 0.30
    return burden_points, 40 * F.least(F.greatest(room, F.lit(0.0)), F.lit(1.0))


def _extend(array: str, fields: Callable[[Column], dict[str, Column]], kept: Sequence[str]) -> Column:
    """The array with more fields per element; every stage is evaluated once per element."""
    return F.transform(
        array, lambda s: F.struct(*[s[k].alias(k) for k in kept], *[v.alias(k) for k, v in fields(s).items()])
    )


def _price(s: Column) -> dict[str, Column]:
    total = (s["emi"] * s["term_months"]).cast("decimal(20,2)")
    return {
        "total_repayment": total,
        "total_interest": F.greatest(F.lit(0).cast("decimal(20,2)"), (total - F.col("requested_amount")).cast("decimal(20,2)")),
        "debt_service": F.col(DEBT) + s["emi"],
        "residual": (F.col("_free") - s["emi"]).cast("decimal(18,2)"),
    }


def _budget(s: Column) -> dict[str, Column]:
    goal_residual = (s["residual"] - F.col(GOAL)).cast("decimal(18,2)")
    burden_points, residual_points = fit_points(F.col(INCOME), s["debt_service"], s["residual"])
    return {
        "goal_residual": goal_residual, "budget_residual": F.coalesce(goal_residual, s["residual"]),
        "_burden": burden_points, "_room": residual_points,
    }


def _points(s: Column) -> dict[str, Column]:
    return {
        "fits_budget": s["budget_residual"] >= 0, "goal_fit": s["goal_residual"] >= 0,
        "burden_points": F.round(s["_burden"], 2), "residual_points": F.round(s["_room"], 2),
        "planning_fit_score": F.round(s["_burden"] + s["_room"], 0).cast("int"),
    }


_PRICED = ["term_months", "emi"]
_SERVED = [*_PRICED, "total_repayment", "total_interest", "debt_service", "residual"]
_BUDGETED = [*_SERVED, "goal_residual", "budget_residual"]


def scenarios(requests: DataFrame) -> DataFrame:
    """Requests with an array of scenarios, one per term."""
    priced = F.transform(
        "terms_months",
        lambda t: F.struct(
            t.alias("term_months"),
            annuity_payment(F.col("requested_amount"), t, F.col("annual_rate_percent")).alias("emi"),
        ),
    )
    free = (F.col(INCOME) - F.col(EXPENSES) - F.col(DEBT)).cast("decimal(18,2)")
    df = requests.withColumns({"scenarios": priced, "_free": free})
    df = df.withColumn("scenarios", _extend("scenarios", _price, _PRICED))
    df = df.withColumn("scenarios", _extend("scenarios", _budget, _SERVED))
    return df.withColumn("scenarios", _extend("scenarios", _points, _BUDGETED)).drop("_free")


def scenario_rows(requests: DataFrame, key: str = "request_id") -> DataFrame:
    """One row per request and term with ratios against gross and take-home income."""
    flat = scenarios(requests).select(key, INCOME, GROSS, DEBT, F.explode("scenarios").alias("s"))
    return flat.select(
        key,
        *[F.col(f"s.{c}").alias(c) for c in ("term_months", "emi", "total_repayment", "total_interest", "residual",
                                             "goal_residual", "planning_fit_score", "burden_points", "residual_points",
                                             "fits_budget", "goal_fit")],
        ratio(F.col(DEBT), F.col(GROSS)).alias("current_dti"),
        ratio(F.col("s.debt_service"), F.col(GROSS)).alias("proposed_dti"),
        ratio(F.col(DEBT), F.col(INCOME)).alias("current_payment_ratio"),
        ratio(F.col("s.debt_service"), F.col(INCOME)).alias("proposed_payment_ratio"),
    )


def stress_rows(requests: DataFrame, key: str = "request_id") -> DataFrame:
    """Income drops of 0, 10, 20 and 30 percent for every scenario, exploded in place."""
    flat = scenarios(requests).select(key, INCOME, EXPENSES, DEBT, GOAL, F.explode("scenarios").alias("s"))
    drops = F.explode(F.array(*[F.lit(d) for d in STRESS_LEVELS])).alias("income_drop_percent")
    flat = flat.select("*", drops)
    income = (F.col(INCOME) * (100 - F.col("income_drop_percent")) / 100).cast("decimal(18,4)")
    left = income - F.col(EXPENSES) - F.col(DEBT) - F.col("s.emi")
    return flat.select(
        key, F.col("s.term_months").alias("term_months"), "income_drop_percent",
        F.round(income, 2).alias("stressed_income"),
        ratio(F.col("s.debt_service"), income).alias("debt_service_ratio"),
        F.round(left, 2).alias("stressed_residual"), F.round(left - F.col(GOAL), 2).alias("stressed_goal_residual"),
    )


def _doubles_of(field: str) -> Column:
    return F.transform("scenarios", lambda s: s[field].cast("double"))


def _normalized(name: str, value: Column) -> Column:
    """100 for the smallest of a request's values down to 0 for the largest; 100 when all agree."""
    low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
    return F.when(low == high, F.lit(100.0)).otherwise((high - value.cast("double")) * 100 / (high - low))


def _by_priority(index: int) -> Column:
    pairs = [F.lit(x) for name, weights in WEIGHTS.items() for x in (name, weights[index])]
    return F.element_at(F.create_map(*pairs), F.col("planning_priority"))


def ranked_scenarios(requests: DataFrame) -> DataFrame:
    """Requests with ``ranked``: scenarios in rank order.

    Fitting budgets come first; then the weighted preference, or the least
    shortfall when nothing fits; then score, residual, interest and term.
    """
    df = scenarios(requests).withColumns(
        {
            **{
                f"_{side}_{name}": pick(_doubles_of(field))
                for name, field in (("emi", "emi"), ("interest", "total_interest"))
                for side, pick in (("low", F.array_min), ("high", F.array_max))
            },
            "_any_fit": F.exists("scenarios", lambda s: s["fits_budget"]),
            "_monthly_weight": _by_priority(0),
            "_interest_weight": _by_priority(1),
        }
    )

    def scored(s: Column) -> Column:
        monthly, saving = _normalized("emi", s["emi"]), _normalized("interest", s["total_interest"])
        combined = F.round(monthly * F.col("_monthly_weight") + saving * F.col("_interest_weight"), 2)
        return F.struct(
            s.alias("s"), F.round(monthly, 2).alias("monthly_room_score"), F.round(saving, 2).alias("interest_saving_score"),
            combined.alias("rank_score"),
        )

    def keyed(r: Column) -> Column:
        s = r["s"]
        shortfall = F.greatest(-s["budget_residual"], F.lit(0)).cast("double")
        return F.struct(
            F.when(s["fits_budget"] | ~F.col("_any_fit"), 0).otherwise(1).alias("k1"),
            F.when(F.col("_any_fit"), -r["rank_score"]).otherwise(shortfall).alias("k2"),
            (-r["rank_score"]).alias("k3"), (-s["budget_residual"]).alias("k4"),
            s["total_interest"].alias("k5"), s["term_months"].alias("k6"), r.alias("r"),
        )

    df = df.withColumn("_scored", F.transform("scenarios", scored))
    df = df.withColumn("_ordered", F.array_sort(F.transform("_scored", keyed)))
    df = df.withColumn("ranked", F.transform("_ordered", lambda k: k["r"]))
    return df.drop("_scored", "_ordered", "_low_emi", "_high_emi", "_low_interest", "_high_interest")


def _difference(mine: Column, other: Column) -> Column:
    gap = F.abs(mine - other)
    side = F.when(mine < other, "lower").otherwise("higher")
    return F.when(gap == 0, "the same").otherwise(F.concat(F.lit("₹"), gap.cast("decimal(20,2)").cast("string"), F.lit(" "), side))


def _against(r: Column, other: Column, place: str) -> Column:
    text = F.concat(
        F.lit(" Compared with the "), other["s"]["term_months"].cast("string"), F.lit(f"-month option ranked {place}, its monthly EMI is "),
        _difference(r["s"]["emi"], other["s"]["emi"]), F.lit(" and its total interest is "),
        _difference(r["s"]["total_interest"], other["s"]["total_interest"]), F.lit("."),
    )
    return F.when(other.isNotNull(), text).otherwise("")


def rank_rows(requests: DataFrame, key: str = "request_id") -> DataFrame:
    """One row per request and term with rank, scores and an explanation from the neighbours."""
    df = ranked_scenarios(requests)
    preference = F.element_at(F.create_map(*[F.lit(x) for kv in PREFERENCE.items() for x in kv]), F.col("planning_priority"))

    def explained(r: Column, i: Column) -> Column:
        above, below = F.get("ranked", i - 1), F.get("ranked", i + 1)
        fits = r["s"]["fits_budget"]
        text = F.concat(
            F.format_string(
                "Ranks #%d for %s with a combined rank score of %.1f/100 (%d%% monthly room, %d%% interest saving). "
                "It earns a monthly-room score of %.1f and an interest-saving score of %.1f.",
                i + 1, preference, r["rank_score"], F.round(F.col("_monthly_weight") * 100).cast("int"),
                F.round(F.col("_interest_weight") * 100).cast("int"), r["monthly_room_score"], r["interest_saving_score"],
            ),
            F.when(fits, " It fits your stated budget.")
            .when(F.col("_any_fit"), " It ranks after scenarios that fit your stated budget.")
            .otherwise(""),
            _against(r, above, "above"),
            _against(r, below, "below"),
            F.when(above.isNull(), " It is the highest-ranked scenario.").otherwise(""),
            F.when(below.isNull(), " It is the lowest-ranked scenario.").otherwise(""),
        )
        return F.struct(
            (i + 1).alias("rank"), r["s"]["term_months"].alias("term_months"), r["s"]["emi"].alias("emi"),
            r["s"]["total_interest"].alias("total_interest"), fits.alias("fits_budget"),
            r["monthly_room_score"].alias("monthly_room_score"), r["interest_saving_score"].alias("interest_saving_score"),
            r["rank_score"].alias("rank_score"), text.alias("explanation"),
        )

    listed = df.select(key, F.explode(F.transform("ranked", explained)).alias("x"))
    return listed.select(key, "x.*")


def request_summary(requests: DataFrame, key: str = "request_id") -> DataFrame:
    """Headroom, savings buffer, ratios and warnings per request."""
    df = scenarios(requests)
    zero = F.lit(0).cast(MONEY)
    before_goal = F.greatest(zero, (F.col(INCOME) - F.col(EXPENSES) - F.col(DEBT)).cast("decimal(18,2)"))
    negative = F.exists("scenarios", lambda s: s["residual"] < 0)
    warnings = F.array_compact(
        F.array(
            *[F.lit(w) for w in WARNINGS], F.when(F.col(GOAL).isNull(), NO_GOAL), F.when(F.col(GROSS).isNull(), NO_GROSS),
            F.when(negative, NEGATIVE),
        )
    )
    return df.select(
        key,
        before_goal.alias("headroom_before_goal"),
        F.when(F.col(GOAL).isNotNull(), F.greatest(zero, (before_goal - F.col(GOAL)).cast("decimal(18,2)"))).alias("headroom_after_goal"),
        F.when(F.col(EXPENSES) > 0, ratio(F.col(SAVINGS), F.col(EXPENSES))).alias("savings_buffer_months"),
        ratio(F.col(DEBT), F.col(GROSS)).alias("current_dti"),
        ratio(F.col(DEBT), F.col(INCOME)).alias("current_payment_ratio"),
        warnings.alias("warnings"),
    )
