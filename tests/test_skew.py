"""A third of all rows on one key: results stay whole and hot groups are combined before they meet."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loanloom.operators import asof
from loanloom.operators.history.installments import installment_features
from loanloom.operators.reconcile import daily_totals, settle

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
TERMS = "SK_ID_CURR long, SK_ID_PREV long, NUM_INSTALMENT_NUMBER int, NUM_INSTALMENT_VERSION int"


def brute_completion(payments, owed):
    total = 0
    for day, amount in sorted(payments):
        total += amount
        if total >= owed - 1:
            return day
    return None


@FEW
@given(
    payments=st.lists(st.tuples(st.integers(-30, 0), st.integers(0, 40)), max_size=15), owed=st.integers(1, 120),
    seed=st.integers(0, 9),
)
def test_completion_does_not_depend_on_payment_order(spark, payments, owed, seed):
    shuffled = payments[:]
    random.Random(seed).shuffle(shuffled)
    df = spark.createDataFrame([(1, d, a) for d, a in shuffled], "k long, day int, amount long").repartition(3)
    schedule = spark.createDataFrame([(1, -5, owed)], "k long, due int, owed long")
    row = settle(schedule, daily_totals(df, ["k"], "day", "amount"), ["k"], due_day="due", due_amount="owed", day="day", amount="amount", tolerance=1).first()
    assert row.completion == brute_completion(payments, owed)
    assert row.paid == sum(a for _, a in payments) and row.paid_by_due == sum(a for d, a in payments if d <= -5)


def test_hot_obligation(spark):
    """20,000 of 60,000 payments belong to one obligation; its window still has one row per day."""
    hot = spark.range(20_000).select(
        F.lit(1).cast("long").alias("k"), (-(F.col("id") % 50)).cast("int").alias("day"), F.lit(1).cast("long").alias("amount"))
    cold = spark.range(40_000).select(
        (F.col("id") + 2).alias("k"), F.lit(-3).alias("day"), F.lit(1).cast("long").alias("amount"))
    daily = daily_totals(hot.unionByName(cold), ["k"], "day", "amount")
    assert daily.where("k = 1").count() == 50
    schedule = spark.createDataFrame([(1, -10, 4000), (2, -10, 1)], "k long, due int, owed long")
    rows = {r.k: r for r in settle(schedule, daily, ["k"], due_day="due", due_amount="owed", day="day", amount="amount", tolerance=0).collect()}
    assert rows[1].paid == 20_000 and rows[1].completion == -40
    assert rows[2].completion == -3


def test_hot_replay(spark):
    """One event repeated 30,000 times is one row, combined before the shuffle."""
    df = spark.range(30_000).select(F.lit("a").alias("e"), F.lit(5).alias("v")).unionByName(
        spark.range(100).select(F.concat(F.lit("b"), F.col("id").cast("string")).alias("e"), F.lit(1).alias("v")))
    out = asof.collapse_replays(df, "e", ["v"])
    row = out.where("e = 'a'").first()
    assert (row.n_rows, row.conflicting, row.v) == (30_000, False, 5)
    assert "partial_count" in out._jdf.queryExecution().executedPlan().toString()


def test_replays_and_partitioning_do_not_change_features(spark):
    keys = [(i % 7, i, 1, 1) for i in range(40)]
    schedule = spark.createDataFrame([(*k, -20, 100.0, -90) for k in keys], TERMS + ", DAYS_INSTALMENT int, AMT_INSTALMENT double, DAYS_AVAILABLE int")
    rows = [(*k, f"p{k[1]}-{j}", 50.0, -25 + 3 * j * (k[1] % 3), -19) for k in keys for j in (0, 1)]
    payments = spark.createDataFrame(rows, TERMS + ", PAYMENT_ID string, AMT_PAYMENT double, DAYS_ENTRY_PAYMENT int, DAYS_AVAILABLE int")
    base = sorted(installment_features(payments, schedule).collect())
    many = payments.unionByName(payments).unionByName(payments).repartition(11)
    assert sorted(installment_features(many, schedule.repartition(5)).collect()) == base
    late, due = sum(r.installment_late_count for r in base), sum(r.installment_due_count for r in base)
    assert 0 < late <= due == 40
