"""Hand-computed history cases."""

import pytest
from pyspark.sql import functions as F

from loanloom import ContractError
from loanloom.operators.history.assemble import history_features
from loanloom.operators.history.bureau import bureau_features
from loanloom.operators.history.installments import installment_features
from loanloom.operators.history.names import GROUPS, HISTORY
from loanloom.operators.history.previous import previous_features
from loanloom.operators.history.snapshots import card_features, pos_features
from loanloom.sources.schemas import SCHEMAS

TERMS = "SK_ID_CURR long, SK_ID_PREV long, NUM_INSTALMENT_NUMBER int, NUM_INSTALMENT_VERSION int, DAYS_INSTALMENT int, AMT_INSTALMENT double"
SCHEDULE = TERMS + ", DAYS_AVAILABLE int"
PAYMENTS = TERMS + ", PAYMENT_ID string, AMT_PAYMENT double, DAYS_ENTRY_PAYMENT int, DAYS_AVAILABLE int"


def schedule(spark, numbers=(1, 2, 3), version=1):
    days = {1: -10, 2: -5, 3: 10}
    return spark.createDataFrame([(1, 10, n, version, days[n], 100.0, -100) for n in numbers], SCHEDULE)


def payments(spark, rows=(("a", 50.0, -12, -12), ("b", 50.0, -8, -8))):
    return spark.createDataFrame([(1, 10, 1, 1, -10, 100.0, *r) for r in rows], PAYMENTS)


def test_partial_payments_and_unpaid_obligation(spark):
    row = installment_features(payments(spark), schedule(spark)).first()
    assert row.installment_due_count == 2
    assert row.installment_fully_paid_count == 1
    assert row.installment_late_count == 2
    assert row.installment_unpaid_overdue_count == 1
    assert row.installment_mean_signed_delay == 2
    assert row.installment_mean_overdue_days == 3.5
    assert row.installment_mean_paid_ratio == 0.5


def test_unavailable_payment_does_not_leak(spark):
    rows = (("a", 50.0, -12, -12), ("b", 50.0, -8, 1))
    row = installment_features(payments(spark, rows), schedule(spark)).first()
    assert row.installment_fully_paid_count == 0
    assert row.installment_mean_paid_ratio == 0.25
    assert row.installment_mean_signed_delay is None


def test_replay_is_harmless_and_conflict_is_not(spark):
    base = payments(spark)
    replay = base.unionByName(base.where("PAYMENT_ID = 'a'"))
    assert installment_features(replay, schedule(spark)).first() == installment_features(base, schedule(spark)).first()
    changed = base.unionByName(base.where("PAYMENT_ID = 'a'").withColumn("AMT_PAYMENT", F.lit(1.0)))
    with pytest.raises(ContractError, match="Conflicting duplicate"):
        installment_features(changed, schedule(spark))
    with pytest.raises(ContractError, match="Ambiguous"):
        installment_features(base, schedule(spark).unionByName(schedule(spark, (1,), 2)))


def test_null_against_value_is_a_conflict(spark):
    base = payments(spark)
    blank = base.where("PAYMENT_ID = 'a'").withColumn("AMT_INSTALMENT", F.lit(None).cast("double"))
    with pytest.raises(ContractError, match="Conflicting duplicate"):
        installment_features(base.unionByName(blank), schedule(spark))


def test_unknown_schedule_is_an_error(spark):
    stray = payments(spark).withColumn("NUM_INSTALMENT_NUMBER", F.lit(9))
    with pytest.raises(ContractError, match="unknown effective schedule"):
        installment_features(stray, schedule(spark))


@pytest.mark.parametrize("days, late, delay", [((-9, -8), 1, 2), ((-13, -12), 0, -2)])
def test_two_parts_count_once(spark, days, late, delay):
    rows = (("a", 50.0, days[0], days[0]), ("b", 50.0, days[1], days[1]))
    row = installment_features(payments(spark, rows), schedule(spark, (1,))).first()
    assert row.installment_late_count == late
    assert row.installment_mean_signed_delay == delay


def test_payment_of_one_cent_less_completes(spark):
    rows = (("a", 33.33, -12, -12), ("b", 33.33, -11, -11), ("c", 33.33, -10, -10))
    row = installment_features(payments(spark, rows), schedule(spark, (1,))).first()
    assert row.installment_fully_paid_count == 1 and row.installment_mean_signed_delay == 0


def test_tolerance_is_bounded(spark):
    with pytest.raises(ContractError):
        installment_features(payments(spark), schedule(spark), tolerance=0.02)


def test_previous_applications(spark):
    rows = [(1, 1, -400, -400, "Approved"), (1, 2, -100, -100, "Refused"), (1, 3, -1, -1, "Canceled"), (1, 4, 1, -1, "Approved")]
    df = spark.createDataFrame(rows, "SK_ID_CURR long, SK_ID_PREV long, DAYS_DECISION int, DAYS_AVAILABLE int, NAME_CONTRACT_STATUS string")
    row = previous_features(df).first()
    assert (row.previous_application_count, row.previous_approved_count, row.previous_refused_count) == (3, 1, 1)
    assert row.previous_applications_365d == 2 and row.days_since_previous_application == 1
    with pytest.raises(ContractError, match="status"):
        previous_features(df.withColumn("NAME_CONTRACT_STATUS", F.lit("Maybe")))


CARD = (
    "SK_ID_CURR long, SK_ID_PREV long, MONTHS_BALANCE int, DAYS_AVAILABLE int, SK_DPD int, NAME_CONTRACT_STATUS string, "
    "AMT_BALANCE double, AMT_CREDIT_LIMIT_ACTUAL double"
)


def cards(spark, limit=900.0, balance=300.0):
    return spark.createDataFrame(
        [(1, 1, -2, -60, 0, "Active", 90.0, 100.0), (1, 1, -1, -30, 0, "Active", 50.0, 100.0), (1, 2, -1, -30, 0, "Active", balance, limit)], CARD
    )


def test_card_utilization(spark):
    row = card_features(cards(spark)).first()
    assert row.card_current_utilization == 0.35
    assert row.card_historical_mean_utilization == pytest.approx((0.9 + 0.5 + 1 / 3) / 3)
    assert card_features(cards(spark, None)).first().card_current_utilization is None
    unknown = card_features(cards(spark, 900.0, None)).first()
    assert unknown.card_current_balance is None and unknown.card_current_limit == 1000.0


def test_card_without_active_account(spark):
    row = card_features(cards(spark).withColumn("NAME_CONTRACT_STATUS", F.lit("Completed"))).first()
    assert (row.card_current_balance, row.card_current_limit, row.card_current_utilization) == (0.0, 0.0, None)


def test_pos_months(spark):
    df = spark.createDataFrame(
        [(1, 1, -3, -90, 4, "Active"), (1, 1, -2, -60, None, "Active"), (1, 2, -1, -30, 0, "Completed")],
        "SK_ID_CURR long, SK_ID_PREV long, MONTHS_BALANCE int, DAYS_AVAILABLE int, SK_DPD int, NAME_CONTRACT_STATUS string",
    )
    row = pos_features(df).first()
    assert (row.pos_loan_count, row.pos_observed_months, row.pos_max_dpd, row.pos_active_loan_count) == (2, 3, 4, 1)
    assert row.pos_mean_dpd == 2 and row.pos_late_month_ratio == 0.5


def test_bureau_unknown_total_stays_unknown(spark):
    accounts = spark.createDataFrame(
        [(1, 1, -10, -10, "Active", 5, 100.0, None, 0.0), (1, 2, -20, -20, "Closed", None, 50.0, 10.0, 0.0)],
        "SK_ID_CURR long, SK_ID_BUREAU long, DAYS_CREDIT int, DAYS_AVAILABLE int, CREDIT_ACTIVE string, CREDIT_DAY_OVERDUE int, "
        "AMT_CREDIT_SUM double, AMT_CREDIT_SUM_DEBT double, AMT_CREDIT_SUM_OVERDUE double",
    )
    months = spark.createDataFrame([(1, -1, -30, "0"), (1, -2, -60, "3"), (1, -3, -90, "C")], "SK_ID_BUREAU long, MONTHS_BALANCE int, DAYS_AVAILABLE int, STATUS string")
    row = bureau_features(accounts, months).first()
    assert row.bureau_total_credit == 150.0 and row.bureau_total_debt is None and row.bureau_overdue_count is None
    assert (row.bureau_observed_status_months, row.bureau_delinquent_months, row.bureau_severe_months) == (2, 1, 1)
    assert row.bureau_late_month_ratio == 0.5
    with pytest.raises(ContractError, match="Orphan"):
        bureau_features(accounts, months.withColumn("SK_ID_BUREAU", F.lit(9).cast("long")))


def context(state="COMPLETE"):
    gates = ("schedule_complete", "schedule_versions_resolved", "payment_identity_verified", "availability_verified")
    return {**dict.fromkeys(gates, True), "sources": {k: {"state": state, "evidence": "audit"} for k in GROUPS}}


def test_confirmed_empty_sources_give_zero_counts(spark):
    tables = {k: spark.createDataFrame([], SCHEMAS[k]) for k in GROUPS}
    empty_schedule = spark.createDataFrame([], SCHEMAS["installment_schedule"])
    people = spark.createDataFrame([(1,), (2,)], "SK_ID_CURR long")
    rows = history_features(people, tables, empty_schedule, context("CONFIRMED_EMPTY")).collect()
    assert len(rows) == 2 and set(HISTORY) < set(rows[0].asDict())
    assert rows[0].bureau_account_count == 0 and rows[0].card_current_balance == 0
    assert rows[0].installment_mean_signed_delay is None and rows[0].previous_refusal_rate is None
    with pytest.raises(ContractError, match="incomplete"):
        history_features(people, tables, empty_schedule, context("UNAVAILABLE"))
    with pytest.raises(ContractError, match="Full unavailable"):
        history_features(people, tables, empty_schedule, {**context(), "availability_verified": False})


def test_nonempty_source_declared_empty(spark):
    tables = {k: spark.createDataFrame([], SCHEMAS[k]) for k in GROUPS}
    tables["bureau_balance"] = spark.createDataFrame([(1, -1, -1, "0")], SCHEMAS["bureau_balance"])
    with pytest.raises(ContractError, match="declared empty"):
        history_features(spark.createDataFrame([(1,)], "SK_ID_CURR long"), tables,
                         spark.createDataFrame([], SCHEMAS["installment_schedule"]), context("CONFIRMED_EMPTY"))
