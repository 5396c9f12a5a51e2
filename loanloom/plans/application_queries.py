"""Catalogue: application snapshot, row contracts and data-quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.operators import application as A
from loanloom.operators.contracts import (
    Rule, count_as, duplicate_keys, orphans, union_reports, violation_counts, with_reason,
)
from loanloom.operators.history.assemble import assemble
from loanloom.operators.history.names import HISTORY
from loanloom.plans import history_queries as H
from loanloom.plans import views
from loanloom.plans.registry import query
from loanloom.plans.views import with_views


def _case(column: str, mapping: dict[str, str], null_as: str | None) -> str:
    pairs = " ".join(f"when '{k}' then '{v}'" for k, v in mapping.items())
    null = f"'{null_as}'" if null_as else "null"
    return f"case when {column} is null then {null} else case {column} {pairs} else 'OTHER' end end"


CANONICAL = (
    "select SK_ID_CURR, TARGET, NAME_CONTRACT_TYPE, -DAYS_BIRTH / 365.25::double age_years, "
    "-nullif(DAYS_EMPLOYED, 365243) / 365.25::double years_employed, "
    "AMT_INCOME_TOTAL annual_income, AMT_CREDIT requested_amount, AMT_ANNUITY quoted_monthly_payment, "
    "cast(CNT_FAM_MEMBERS as double) household_size, cast(CNT_CHILDREN as double) dependent_children, "
    + _case("NAME_INCOME_TYPE", A.VOCABULARY["employment_type"], None) + " employment_type, "
    + _case("NAME_EDUCATION_TYPE", A.VOCABULARY["education_level"], None) + " education_level, "
    + _case("OCCUPATION_TYPE", A.VOCABULARY["occupation"], "MISSING") + " occupation, "
    + _case("NAME_HOUSING_TYPE", A.VOCABULARY["housing_status"], "MISSING") + " housing_status from v_raw"
)
REASON = (
    "case when NAME_CONTRACT_TYPE <> 'Cash loans' then 'unsupported_product' when age_years < 18 then 'age_years must be >=18' "
    "when years_employed < 0 or years_employed > age_years then 'Employment tenure must be between zero and age, or null' "
    "when annual_income <= 0 then 'annual_income must be positive' when requested_amount <= 0 then 'requested_amount must be positive' "
    "when quoted_monthly_payment <= 0 then 'quoted_monthly_payment must be positive' "
    "when household_size < 1 then 'household_size must be an integer >= 1' "
    "when dependent_children < 0 then 'dependent_children must be an integer >= 0' "
    "when dependent_children > household_size - 1 then 'dependent_children exceeds household_size-1' end"
)
ADAPTED = f"select *, {REASON} reason from canonical"
DERIVED_SQL = (
    "cast(years_employed is null as integer) employment_tenure_missing, "
    "quoted_monthly_payment / (annual_income / 12) proposed_payment_income_ratio, requested_amount / annual_income principal_income_ratio, "
    "annual_income / household_size income_per_household_member, years_employed / age_years employed_age_ratio, "
    "quoted_monthly_payment / requested_amount payment_principal_ratio"
)
ADAPT_STEPS = {"canonical": CANONICAL, "adapted": ADAPTED}
LITE_SQL = (
    "select SK_ID_CURR, TARGET, " + ", ".join(A.BASE_NUMERIC + A.CATEGORICAL) + f", {DERIVED_SQL} from adapted where reason is null"
)
LITE_STEPS = {**ADAPT_STEPS, "lite": LITE_SQL}


@query("lite_features", with_views(["v_raw"], "select * from lite", LITE_STEPS))
def lite(spark: SparkSession, sf: str) -> DataFrame:
    return A.eligible_features(views.raw_applications(spark, sf))


@query("application_exclusions",
       with_views(["v_raw"], "select SK_ID_CURR id, reason from adapted where reason is not null", ADAPT_STEPS))
def _exclusions(spark: SparkSession, sf: str) -> DataFrame:
    return A.exclusions(views.raw_applications(spark, sf))


@query("exclusion_counts",
       with_views(["v_raw"], "select reason, count(*) n from adapted where reason is not null group by 1", ADAPT_STEPS))
def _exclusion_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.exclusion_counts(views.raw_applications(spark, sf))


@query(
    "lite_rule_counts",
    with_views(
        ["v_raw"],
        "select rule, cast(violations as bigint) violations from (select count(*) filter (where age_years < 18) a, "
        "count(*) filter (where years_employed < 0 or years_employed > age_years) b, count(*) filter (where annual_income <= 0) c, "
        "count(*) filter (where dependent_children > household_size - 1) d from canonical) t, lateral (values "
        "('age_years must be >=18', a), ('Employment tenure must be between zero and age, or null', b), "
        "('annual_income must be positive', c), ('dependent_children exceeds household_size-1', d)) v(rule, violations)",
        {"canonical": CANONICAL}),
)
def _rule_counts(spark: SparkSession, sf: str) -> DataFrame:
    canonical = A.adapt_applications(views.raw_applications(spark, sf))
    return violation_counts(canonical, A.lite_rules()).where("violations > 0")


@query(
    "derived_mismatches",
    with_views(
        ["v_raw"],
        "select SK_ID_CURR, case when years_employed is not null and SK_ID_CURR % 7 = 2 then 'Derived feature mismatch: employed_age_ratio' "
        "when SK_ID_CURR % 7 = 3 then 'Derived feature mismatch: principal_income_ratio' end reason from lite "
        "where (years_employed is not null and SK_ID_CURR % 7 = 2) or SK_ID_CURR % 7 = 3", LITE_STEPS),
)
def _mismatch(spark: SparkSession, sf: str) -> DataFrame:
    """Two derived columns are disturbed; one disturbance is inside the tolerance."""
    base = lite(spark, sf)
    nudged = base.withColumns(
        {
            "employed_age_ratio": F.when(F.col("SK_ID_CURR") % 7 == 2, F.col("employed_age_ratio") + 0.01)
            .otherwise(F.col("employed_age_ratio")),
            "principal_income_ratio": F.when(F.col("SK_ID_CURR") % 7 == 3, F.col("principal_income_ratio") * 1.001)
            .when(F.col("SK_ID_CURR") % 7 == 4, F.col("principal_income_ratio") * (1 + 1e-13))
            .otherwise(F.col("principal_income_ratio")),
        }
    )
    out = nudged.select("SK_ID_CURR", A.derived_mismatch(nudged).alias("reason"))
    return out.where(F.col("reason").isNotNull())


def _history_rules_sql() -> str:
    """One counting branch per generated rule, written out for the oracle."""
    parts = []
    for name in HISTORY:
        checks = {}
        if name not in ("installment_mean_signed_delay", "card_current_balance"):
            checks[f"Negative history: {name}"] = f"{name} < 0"
        if name.endswith(("_count", "_months", "_365d")):
            checks[f"Invalid history count: {name}"] = f"{name} is null or {name} % 1 <> 0"
        if name.endswith(("_rate", "_ratio")):
            checks[f"Invalid history fraction: {name}"] = f"{name} > 1"
        parts += [f"select '{r}' as rule, count(*) filter (where {c}) violations from assembled" for r, c in checks.items()]
    return "select * from (" + " union all ".join(parts) + ") where violations > 0"


@query(
    "full_vector_violations",
    with_views(H.ASSEMBLY_VIEWS, _history_rules_sql(), {**H.ASSEMBLY_STEPS, "assembled": H.ASSEMBLY_SQL}),
)
def _full_vector(spark: SparkSession, sf: str) -> DataFrame:
    """Contract report of the assembled long vector: rules with at least one bad row."""
    applicants = views.raw_applications(spark, sf).select(A.ID)
    full = assemble(applicants, views.history_tables(spark, sf), views.schedule(spark, sf))
    return violation_counts(full, A.history_rules(HISTORY)).where("violations > 0")


EXTRAS_SQL = (
    "select SK_ID_CURR, EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3, cast(EXT_SOURCE_1 is null as integer) ext_source_1_missing, "
    "cast(EXT_SOURCE_2 is null as integer) ext_source_2_missing, cast(EXT_SOURCE_3 is null as integer) ext_source_3_missing, "
    "cast(AMT_REQ_CREDIT_BUREAU_HOUR is null and AMT_REQ_CREDIT_BUREAU_DAY is null and AMT_REQ_CREDIT_BUREAU_WEEK is null and "
    "AMT_REQ_CREDIT_BUREAU_MON is null and AMT_REQ_CREDIT_BUREAU_QRT is null and AMT_REQ_CREDIT_BUREAU_YEAR is null as integer) credit_bureau_inquiry_history_missing, "
    "AMT_REQ_CREDIT_BUREAU_MON credit_bureau_inquiries_1m, AMT_REQ_CREDIT_BUREAU_QRT credit_bureau_inquiries_3m, "
    "AMT_REQ_CREDIT_BUREAU_YEAR credit_bureau_inquiries_12m, AMT_CREDIT / AMT_GOODS_PRICE loan_to_goods_price_ratio from v_raw"
)


@query("snapshot_extras", with_views(["v_raw"], EXTRAS_SQL))
def _extras(spark: SparkSession, sf: str) -> DataFrame:
    return A.snapshot_extras(views.raw_applications(spark, sf))


@query(
    "snapshot_rejections",
    with_views(["v_raw"], "select SK_ID_CURR, 'Goods price must be observed and positive' reason from v_raw "
               "where AMT_GOODS_PRICE is null or AMT_GOODS_PRICE <= 0"),
)
def _snapshot_rejections(spark: SparkSession, sf: str) -> DataFrame:
    checked = with_reason(views.raw_applications(spark, sf), A.snapshot_rules())
    return checked.where(F.col("reason").isNotNull()).select("SK_ID_CURR", "reason")


NULLS = "+".join(f"cast({w} is null as integer)" for w in A.INQUIRY_WINDOWS)


@query(
    "mixed_missingness",
    with_views(["v_raw"], f"select count(*) n_rows, count(*) filter (where {NULLS} = 6) all_missing_rows, "
               f"count(*) filter (where {NULLS} between 1 and 5) mixed_missing_rows from v_raw"),
)
def _mixed(spark: SparkSession, sf: str) -> DataFrame:
    return A.mixed_missingness(views.raw_applications(spark, sf))


# ---------------------------------------------------------------- quotes
UUID_SQL = "concat('00000000-0000-0000-0000-', lpad(cast(o_orderkey as string), 12, '0'))"
DAY_SQL = "concat(cast(cast(o_orderdate as date) as string), 'T12:00:00+00:00')"
REQUEST_COLUMNS = {
    "request_ref": "o_orderkey",
    "application_id": f"case when o_orderkey % 31 = 4 then 'not-a-uuid' else {UUID_SQL} end",
    "application_version": "case when o_orderkey % 37 = 5 then 0 else 1 end",
    "as_of": f"case when o_orderkey % 41 = 6 then null when o_orderkey % 43 = 7 then replace({DAY_SQL}, '+00:00', '+02:00') else {DAY_SQL} end",
    "product_code": "case when o_orderkey % 47 = 8 then 'CARD' else 'CASH_INSTALLMENT_V1' end",
    "currency": "'XXX'",
    "quote_id": UUID_SQL,
    "requested_amount": "cast(round(o_totalprice, 2) as decimal(14,2))",
    "quoted_monthly_payment": "cast(round(o_totalprice / 36, 2) as decimal(14,2))",
}
QUOTE_COLUMNS = {
    "request_ref": "o_orderkey",
    "application_id": UUID_SQL,
    "application_version": "case when o_orderkey % 37 = 5 then 0 else 1 + cast(o_orderkey % 53 = 9 as integer) end",
    "quote_id": UUID_SQL,
    "currency": "'XXX'",
    "requested_amount": "cast(round(o_totalprice, 2) as decimal(16,3))",
    "quoted_monthly_payment": "cast(round(o_totalprice / 36, 2) + case when o_orderkey % 59 = 10 then 1 else 0 end as decimal(14,2))",
    "expires_at": "concat(cast(cast(o_orderdate as date) as string), case when o_orderkey % 61 = 11 then 'T11:00:00+00:00' else 'T13:00:00+00:00' end)",
}
QUOTE_SQL = (
    "select o_orderkey request_ref, case when o_orderkey % 41 = 6 then 'Missing request metadata' "
    "when o_orderkey % 31 = 4 or o_orderkey % 67 = 12 then 'Invalid request identity, timestamp or quote' "
    "when o_orderkey % 43 = 7 then 'as_of must be timezone-aware UTC' when o_orderkey % 37 = 5 then 'application_version must be a positive integer' "
    "when o_orderkey % 47 = 8 then 'Unsupported product/currency' when o_orderkey % 61 = 11 then 'Expired quote at decision time' "
    "when o_orderkey % 53 = 9 then 'Quote mismatch: application_version' when o_orderkey % 59 = 10 then 'Quote mismatch: quoted_monthly_payment' "
    "end reason from orders"
)


@query("quote_mismatches", QUOTE_SQL)
def _quotes(spark: SparkSession, sf: str) -> DataFrame:
    orders = views.table(spark, sf, "orders")
    requests = orders.selectExpr(*[f"{v} as {k}" for k, v in REQUEST_COLUMNS.items()])
    quotes = orders.where("o_orderkey % 67 <> 12").selectExpr(*[f"{v} as {k}" for k, v in QUOTE_COLUMNS.items()])
    return A.quote_reasons(requests, quotes, on="request_ref", currency="XXX", product="CASH_INSTALLMENT_V1")


# ---------------------------------------------------------------- keys, references, rules
@query(
    "key_violations",
    "select 'lineitem (order, line)' as rule, count(*) violations from (select l_orderkey, l_linenumber from lineitem group by 1, 2 having count(*) > 1) "
    "union all select 'orders order', count(*) from (select o_orderkey from orders group by 1 having count(*) > 1) "
    "union all select 'open order per customer', count(*) from (select o_custkey from orders where o_orderstatus = 'O' group by 1 having count(*) > 1) "
    "union all select 'documents doc', count(*) from (select doc_id from documents group by 1 having count(*) > 1)",
)
def _keys(spark: SparkSession, sf: str) -> DataFrame:
    """Unique, composite-unique and partial-unique keys."""
    orders = views.table(spark, sf, "orders")
    return union_reports(
        [
            count_as(duplicate_keys(views.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]), "lineitem (order, line)"),
            count_as(duplicate_keys(orders, ["o_orderkey"]), "orders order"),
            count_as(duplicate_keys(orders.where("o_orderstatus = 'O'"), ["o_custkey"]), "open order per customer"),
            count_as(duplicate_keys(views.table(spark, sf, "documents"), ["doc_id"]), "documents doc"),
        ]
    )


@query(
    "orphan_rows",
    "select l_orderkey, l_linenumber, count(*) n_rows from lineitem where l_orderkey % 9 = 4 or l_linenumber = 7 group by 1, 2",
)
def _orphan_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Composite reference: parents of two kinds are withheld."""
    lines = views.table(spark, sf, "lineitem")
    parents = lines.where("l_orderkey % 9 <> 4 and l_linenumber <> 7").select("l_orderkey", "l_linenumber")
    return orphans(lines, parents, ["l_orderkey", "l_linenumber"])


@query(
    "rule_violations",
    "select * from (select 'price finite and positive' as rule, count(*) filter (where o_totalprice <= 0) violations from orders "
    "union all select 'status in vocabulary', count(*) filter (where o_orderstatus not in ('O','F')) from orders "
    "union all select 'priority format', count(*) filter (where not regexp_matches(o_orderpriority, '^[1-3]-[A-Z ]+$')) from orders "
    "union all select 'price bounds', count(*) filter (where o_totalprice > 400000) from orders "
    "union all select 'status pair', count(*) filter (where (o_orderstatus = 'F') <> (o_orderpriority = '1-URGENT')) from orders "
    "union all select 'date order', count(*) filter (where o_orderdate < timestamp '1996-01-01') from orders)",
)
def _rules(spark: SparkSession, sf: str) -> DataFrame:
    """Finite-positive, enum, format, bounds, pairing and ordering rules in one pass."""
    c = F.col
    rules = [
        Rule("price finite and positive", ~F.coalesce((c("o_totalprice") > 0) & ~F.isnan("o_totalprice"), F.lit(False))),
        Rule("status in vocabulary", ~c("o_orderstatus").isin("O", "F")),
        Rule("priority format", ~c("o_orderpriority").rlike("^[1-3]-[A-Z ]+$")),
        Rule("price bounds", ~c("o_totalprice").between(0, 400000)),
        Rule("status pair", (c("o_orderstatus") == "F") != (c("o_orderpriority") == "1-URGENT")),
        Rule("date order", c("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")),
    ]
    return violation_counts(views.table(spark, sf, "orders"), rules)


@query("label_rules", with_views(
    ["v_raw"], "select 'TARGET must be binary and nonmissing' as rule, count(*) filter (where lab is null or lab not in (0, 1)) violations "
    "from (select case when SK_ID_CURR % 71 = 3 then 2 when SK_ID_CURR % 73 = 3 then null else TARGET end lab from v_raw)"))
def _labels(spark: SparkSession, sf: str) -> DataFrame:
    raw = views.raw_applications(spark, sf)
    spoiled = raw.withColumn(
        "TARGET", F.when(F.col(A.ID) % 71 == 3, 2).when(F.col(A.ID) % 73 != 3, F.col("TARGET"))
    )
    return violation_counts(spoiled, A.label_rules())


@query("snapshot_union", with_views(
    ["v_raw"], "select SK_ID_CURR, case when SK_ID_CURR % 5 <> 0 then TARGET end TARGET, cast(SK_ID_CURR % 5 <> 0 as integer) IS_TRAIN from v_raw"))
def _union(spark: SparkSession, sf: str) -> DataFrame:
    raw = views.raw_applications(spark, sf)
    train, test = raw.where(F.col(A.ID) % 5 != 0), raw.where(F.col(A.ID) % 5 == 0).drop("TARGET")
    return A.union_snapshots(train, test).select("SK_ID_CURR", "TARGET", "IS_TRAIN")


@query("snapshot_overlap", with_views(
    ["v_raw"], "select distinct SK_ID_CURR from v_raw where SK_ID_CURR % 5 = 0 and SK_ID_CURR % 3 = 0"))
def _overlap(spark: SparkSession, sf: str) -> DataFrame:
    raw = views.raw_applications(spark, sf)
    return A.overlap(raw.where(F.col(A.ID) % 5 == 0), raw.where(F.col(A.ID) % 3 == 0))
