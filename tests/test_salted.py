"""Joins where one key owns a third of the facts."""

import statistics

import pytest
from pyspark.sql import functions as F

from loanloom.operators.salted import header_join, heavy_keys

CONF = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "24"}


@pytest.fixture
def merge_joins(spark):
    before = {k: spark.conf.get(k) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def facts_of(spark):
    hot = spark.range(20_000).select(F.lit(7).cast("long").alias("import_id"), F.col("id").alias("item"))
    cold = spark.range(40_000).select((F.col("id") % 997 + 100).alias("import_id"), (F.col("id") + 20_000).alias("item"))
    lost = spark.range(50).select(F.lit(None).cast("long").alias("import_id"), (F.col("id") + 60_000).alias("item"))
    return hot.unionByName(cold).unionByName(lost)


def headers_of(spark):
    return spark.range(0, 1000).select(F.col("id").alias("import_id"), (F.col("id") * 2).alias("as_of"))


def test_only_the_hot_key_is_heavy(spark):
    found = heavy_keys(facts_of(spark), ["import_id"], 0.01)
    assert [(key, 32 <= parts <= 34) for key, parts in found] == [(7, True)]
    assert heavy_keys(facts_of(spark).limit(0), ["import_id"]) == []


@pytest.mark.parametrize("how", ["inner", "left"])
def test_same_rows_as_a_plain_join(spark, how):
    facts, headers = facts_of(spark), headers_of(spark)
    plain, dealt = facts.join(headers, "import_id", how), header_join(facts, headers, "import_id", how)
    assert dealt.columns == plain.columns
    assert dealt.count() == plain.count()
    assert dealt.exceptAll(plain).isEmpty()


def test_no_task_holds_the_hot_key(merge_joins):
    spark = merge_joins
    placed = header_join(facts_of(spark), headers_of(spark), "import_id").groupBy(F.spark_partition_id().alias("task")).count()
    rows = sorted(r["count"] for r in placed.collect())
    assert rows[-1] <= 3 * statistics.median(rows)
    plain = facts_of(spark).join(headers_of(spark), "import_id").groupBy(F.spark_partition_id().alias("task")).count()
    rows = sorted(r["count"] for r in plain.collect())
    assert rows[-1] > 8 * statistics.median(rows)


def test_an_unknown_kind_is_refused(spark):
    with pytest.raises(ValueError, match="Only inner"):
        header_join(facts_of(spark), headers_of(spark), "import_id", "full")


def test_repayment_of_an_import_with_a_third_of_the_rows(spark):
    """The hot import's result does not depend on how its obligations are dealt."""
    from loanloom.operators.repayment import coverage_record, installment_status, repayment_metrics

    imports = spark.sql(
        "select id import_id, 'USER_DECLARED' source_kind, date '2024-06-30' as_of, date '2023-01-01' window_start, "
        "true schedule_complete, true payments_complete from range(40)"
    )
    terms = "concat('A', cast(id % 3 as string)) account_ref, cast(id as string) installment_ref"
    schedules = spark.sql(f"select if(id < 300, 0, id % 40) import_id, {terms}, date_add(date '2023-06-01', cast(id % 500 as int)) due_date, 10.0 amount from range(900)")
    payments = spark.sql(f"select if(id < 300, 0, id % 40) import_id, cast(id as string) event_ref, {terms}, "
                         "date_add(date '2023-06-01', cast(id % 500 + id % 5 as int)) paid_date, if(id % 4 = 0, 5.0, 10.0) amount from range(900)")
    status = installment_status(imports, schedules, payments).cache()
    hot = status.where("import_id = 0")
    # due from the window's start to before the cut-off, paid by it
    want = spark.sql("select count(*) n, count_if(id % 4 <> 0 and id % 5 = 0) on_time, count_if(id % 4 <> 0 and id % 5 > 0 and date_add(date '2023-06-01', cast(id % 500 + id % 5 as int)) <= date '2024-06-30') late "
                     "from range(900) where if(id < 300, 0, id % 40) = 0 and date_add(date '2023-06-01', cast(id % 500 as int)) < date '2024-06-30'").first()
    assert (hot.count(), hot.where("status = 'ON_TIME'").count(), hot.where("status = 'LATE'").count()) == tuple(want)
    row = repayment_metrics(imports, status).where("import_id = 0").first()
    assert row["due_count"] == want["n"] and row["late_payment_count"] == want["late"]
    later = spark.sql("select count(*) n from range(900) where if(id < 300, 0, id % 40) = 0 and date_add(date '2023-06-01', cast(id % 500 + id % 5 as int)) > date '2024-06-30'").first()["n"]
    assert coverage_record(imports, schedules, payments, status).where("import_id = 0").first()["excluded_future_payments"] == later
