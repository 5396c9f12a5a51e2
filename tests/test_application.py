"""Row contract and derived features."""

import pytest
from pyspark.sql import functions as F

from loanloom import ContractError
from loanloom.operators import application as A
from loanloom.operators.gates import manifest_blockers
from loanloom.operators.contracts import first_reason

BASE = {
    "SK_ID_CURR": 1, "NAME_CONTRACT_TYPE": "Cash loans", "DAYS_BIRTH": "-14610", "DAYS_EMPLOYED": "-3653", "AMT_INCOME_TOTAL": "120000",
    "AMT_CREDIT": "240000", "AMT_ANNUITY": "5000", "CNT_FAM_MEMBERS": "3", "CNT_CHILDREN": "1", "NAME_INCOME_TYPE": "Working",
    "NAME_EDUCATION_TYPE": "Higher education", "OCCUPATION_TYPE": None, "NAME_HOUSING_TYPE": "With parents", "TARGET": 0,
}
SCHEMA = ", ".join(f"{k} {'long' if k == 'SK_ID_CURR' else 'int' if k == 'TARGET' else 'string'}" for k in BASE)


def raw(spark, **changes):
    return spark.createDataFrame([tuple({**BASE, **changes}.values())], SCHEMA)


def test_derived_features(spark):
    row = A.eligible_features(raw(spark)).first()
    assert row.age_years == 40.0 and row.proposed_payment_income_ratio == 0.5 and row.principal_income_ratio == 2.0
    assert row.income_per_household_member == 40000.0 and row.employment_tenure_missing == 0
    assert row.occupation == "MISSING" and row.housing_status == "WITH_PARENTS" and row.employment_type == "WORKING"


def test_sentinel_and_unmapped(spark):
    row = A.eligible_features(raw(spark, DAYS_EMPLOYED="365243", NAME_INCOME_TYPE="Astronaut")).first()
    assert row.years_employed is None and row.employment_tenure_missing == 1 and row.employment_type == "OTHER"


@pytest.mark.parametrize(
    "changes, reason",
    [
        ({"AMT_INCOME_TOTAL": "0"}, "annual_income must be positive"),
        ({"AMT_CREDIT": "-1"}, "requested_amount must be positive"),
        ({"DAYS_BIRTH": "-6209"}, "age_years must be >=18"),
        ({"DAYS_EMPLOYED": "-15000"}, "Employment tenure must be between zero and age, or null"),
        ({"DAYS_EMPLOYED": "abc"}, "Employment tenure must be between zero and age, or null"),
        ({"CNT_FAM_MEMBERS": "1.5"}, "household_size must be an integer >= 1"),
        ({"CNT_CHILDREN": "3"}, "dependent_children exceeds household_size-1"),
        ({"AMT_INCOME_TOTAL": "Infinity"}, "Non-finite or missing: annual_income"),
        ({"AMT_INCOME_TOTAL": "much"}, "Invalid numeric field: annual_income"),
        ({"NAME_EDUCATION_TYPE": None}, "Unsupported category in education_level; use canonical vocabulary"),
        ({"NAME_CONTRACT_TYPE": "Revolving loans", "AMT_CREDIT": "-1"}, "unsupported_product"),
        ({"AMT_INCOME_TOTAL": "0", "CNT_CHILDREN": "9"}, "annual_income must be positive"),
    ],
)
def test_rejections(spark, changes, reason):
    assert A.exclusions(raw(spark, **changes)).first().reason == reason
    assert A.eligible_features(raw(spark, **changes)).isEmpty()


def test_raw_text_is_not_canonical(spark):
    df = A.eligible_features(raw(spark)).withColumn("employment_type", F.lit("Working"))
    assert df.select(first_reason(A.lite_rules()).alias("r")).first().r.startswith("Unsupported category")


def test_missing_column_is_found_without_a_job(spark):
    with pytest.raises(ContractError, match="AMT_CREDIT"):
        A.adapt_applications(raw(spark).drop("AMT_CREDIT"))


def test_derived_mismatch(spark):
    df = A.eligible_features(raw(spark))
    assert df.select(A.derived_mismatch(df).alias("r")).first().r is None
    bad = df.withColumn("employed_age_ratio", F.lit(0.9))
    assert bad.select(A.derived_mismatch(bad).alias("r")).first().r == "Derived feature mismatch: employed_age_ratio"


def test_narrower_contract():
    assert A.narrower_contract(["a", "b", "c"], {"b"}) == ["a", "c"]
    with pytest.raises(ContractError):
        A.narrower_contract(["a"], {"z"})


def test_gates():
    good = {"annuity_monthly_verified": True, "category_mapping_verified": True, "cash_product_verified": True, "currency": "XXX", "evidence": "e"}
    assert manifest_blockers(good, "lite") == []
    assert "Full unavailable: schedule_complete" in manifest_blockers(good, "full")
    assert manifest_blockers({**good, "currency": "xx"}, "lite")
    research = {**good, "annuity_monthly_verified": False, "mode": "RESEARCH", "release_ready": False, "research_assumptions": {
        "income_period": "annual", "annuity_period": "monthly", "currency": "unspecified_research_currency", "dataset_source": "d", "authorized_by": "a"}}
    assert manifest_blockers(research, "lite") == []
    assert manifest_blockers(research, "full")[0].startswith("Research override")
