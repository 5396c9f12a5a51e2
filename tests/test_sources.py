"""Catalog, sinks, cache, run directory and the readiness build on synthetic CSV files."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from loanloom import ContractError
from loanloom.operators.history.names import GROUPS
from loanloom.plans import readiness
from loanloom.sources import files, sinks
from loanloom.sources.catalog import Catalog
from loanloom.sources.schemas import SCHEMAS

N = 60


def rows():
    """Every applicant: three due obligations of which the first is paid on time."""
    ids = range(1, N + 1)
    app = [
        (i, "Cash loans" if i % 15 else "Revolving loans", -12000.0 - i, -1000.0 if i % 5 else 365243.0, 120000.0 + i, 240000.0, 5000.0, 250000.0, 3.0, 1.0,
         "Working", "Higher education", None, "With parents", 0.5, None, 0.1, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0, int(i % 6 == 0))
        for i in ids
    ]
    return {
        "application_train": app,
        "bureau": [(i, 100 + i, -50, -50, -10, "Active", "currency 1", 0, 10.0, 5.0, 0.0) for i in ids],
        "bureau_balance": [(100 + i, -m, -30 * m, "01C"[m % 3]) for i in ids for m in (1, 2)],
        "previous_application": [(i, 1000 + i, -100, -100, "Approved", 10.0, 10.0) for i in ids],
        "installment_schedule": [(i, 1000 + i, n, 1, -30 * n, 100.0, -200) for i in ids for n in (1, 2, 3)],
        "installments_payments": [(i, 1000 + i, 3, 1, f"pay{i}", -95, 100.0, -95, -90, 100.0) for i in ids],
        "pos_cash_balance": [(i, 1000 + i, -1, -30, 0, 0, "Active") for i in ids],
        "credit_card_balance": [(i, 1000 + i, -1, -30, 0, 0, "Active", 10.0, 100.0, 1.0, 2.0) for i in ids],
    }


NAMES = {"pos_cash_balance": "POS_CASH_balance", "installments_payments": "instalments_payments"}


def write_all(spark, folder, **drop):
    for key, data in rows().items():
        df = spark.createDataFrame(data, SCHEMAS[key])
        if key in drop:
            df = df.drop(*drop[key])
        df.coalesce(1).write.csv(f"{folder}/{NAMES.get(key, key)}.csv", header=True)
    manifest = {
        **dict.fromkeys(("annuity_monthly_verified", "category_mapping_verified", "cash_product_verified", "schedule_complete",
                         "schedule_versions_resolved", "payment_identity_verified", "availability_verified"), True),
        "currency": "XXX", "evidence": "test", "sources": {k: {"state": "COMPLETE", "evidence": "test"} for k in GROUPS},
    }
    (folder / "adapter_manifest.json").write_text(json.dumps(manifest))


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    write_all(spark, folder)
    return folder


def test_catalog(spark, raw):
    c = Catalog(spark, str(raw))
    assert c.locate("pos_cash_balance").endswith("POS_CASH_balance.csv") and c.locate("installments_payments").endswith("instalments_payments.csv")
    assert not c.exists("application_test") and c.missing_columns() == {}
    df = c.load("bureau_balance", ["STATUS", "MONTHS_BALANCE"])
    assert dict(df.dtypes) == {"STATUS": "string", "MONTHS_BALANCE": "int"}
    assert {r.STATUS for r in df.distinct().collect()} == {"1", "C"}
    assert c.load("application_train").where("OCCUPATION_TYPE is null").count() == N
    with pytest.raises(FileNotFoundError):
        c.load("application_test")
    with pytest.raises(ContractError):
        c.locate("nothing")


def test_malformed_csv_fails(spark, tmp_path):
    (tmp_path / "bureau_balance.csv").write_text("SK_ID_BUREAU,MONTHS_BALANCE,DAYS_AVAILABLE,STATUS\n1,-1,-30,0\n2,abc,-30,0\n")
    with pytest.raises(Exception, match="abc|MALFORMED|FAILFAST"):
        Catalog(spark, str(tmp_path)).load("bureau_balance").collect()


def test_one_bad_number_excludes_one_application(spark, tmp_path):
    from loanloom.operators import application as A

    names = ["SK_ID_CURR", "NAME_CONTRACT_TYPE", *A.SOURCE_COLUMNS.values()]
    values = {"SK_ID_CURR": "1", "NAME_CONTRACT_TYPE": "Cash loans"}
    lines = [",".join(names)]
    for key, credit in ((1, "1000"), (2, "12x4")):
        values |= {"SK_ID_CURR": str(key), "AMT_CREDIT": credit}
        lines.append(",".join(values.get(n, "1") for n in names))
    (tmp_path / "application_train.csv").write_text("\n".join(lines) + "\n")
    loaded = Catalog(spark, str(tmp_path)).load("application_train")
    reasons = {r["SK_ID_CURR"]: r["reason"] for r in A.adapt_applications(loaded).collect()}
    assert reasons[2] == "Invalid numeric field: requested_amount" and not (reasons[1] or "").startswith("Invalid numeric")


def test_full_build(spark, raw, tmp_path):
    out = str(tmp_path / "full")
    result = readiness.build(spark, str(raw), out)
    assert result["status"] == "FULL_CONTRACT_VALIDATED" and result["generated_features"] == 60
    assert (result["eligible_rows"], result["excluded_rows"]) == (N - 4, 4)
    full = spark.read.parquet(f"{out}/full_features.parquet")
    r = full.select("installment_due_count", "installment_late_count", "installment_fully_paid_count").distinct().collect()
    assert [tuple(x) for x in r] == [(3.0, 2.0, 1.0)]
    coverage = {x.source: x for x in spark.read.csv(f"{out}/source_coverage", header=True, inferSchema=True).collect()}
    assert coverage["bureau_balance"].raw_rows == 2 * N and coverage["bureau_balance"].rows_p50 == 2.0
    again = readiness.build(spark, str(raw), str(tmp_path / "again"))
    assert again["dataset_digest"] == result["dataset_digest"]
    with pytest.raises(ContractError, match="empty"):
        readiness.build(spark, str(raw), out)
    with pytest.raises(ContractError, match="outside raw"):
        readiness.build(spark, str(raw), str(raw / "inside"))


def test_blocked_build_publishes_applications_only(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    write_all(spark, folder, bureau=["DAYS_AVAILABLE"])
    result = readiness.build(spark, str(folder), str(tmp_path / "out"))
    assert result["status"] == "BLOCKED" and result["generated_features"] == 17
    assert "bureau: missing columns DAYS_AVAILABLE" in result["blockers"]
    quality = spark.read.csv(f"{tmp_path}/out/feature_quality", header=True)
    assert quality.count() == 60 and quality.where("status = 'BLOCKED_NOT_GENERATED'").count() == 43


def test_feature_cache(spark, raw, tmp_path):
    first = readiness.feature_table(spark, str(raw), str(tmp_path))
    assert first.count() == N - 4
    folder = next(p for p in tmp_path.iterdir() if p.suffix == ".parquet")
    stamp = (folder / "_SUCCESS").stat().st_mtime_ns
    readiness.feature_table(spark, str(raw), str(tmp_path))
    assert (folder / "_SUCCESS").stat().st_mtime_ns == stamp
    first.limit(3).write.mode("overwrite").parquet(str(tmp_path / "copy"))
    spark.read.parquet(str(tmp_path / "copy")).write.mode("overwrite").parquet(str(folder))
    assert readiness.feature_table(spark, str(raw), str(tmp_path)).count() == N - 4


def test_run_directory(spark, tmp_path):
    runs = sinks.RunDirectory(spark, str(tmp_path))
    with pytest.raises(ContractError):
        runs.latest()
    run_id = runs.start()
    runs.publish(run_id, {"mode": "RESEARCH_ONLY"}, {"predictions": spark.range(5).withColumn("pd", F.lit(0.5))})
    assert runs.latest() == run_id and runs.read("predictions").count() == 5
    with pytest.raises(Exception):
        runs.publish(run_id, {}, {"predictions": spark.range(5)})
    spark.range(4).withColumn("pd", F.lit(0.5)).write.mode("overwrite").parquet(f"{runs.path(run_id)}/predictions.parquet")
    with pytest.raises(ContractError, match="checksum"):
        runs.read("predictions")
    with pytest.raises(ContractError):
        runs.path("../x")


def test_reports_write_nan_as_null(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.5)], "id int, v double")
    sinks.write_report(df, f"{tmp_path}/j", "json")
    assert spark.read.json(f"{tmp_path}/j").where("v is null").count() == 1
    with pytest.raises(ValueError):
        files.write_json(spark, f"{tmp_path}/x.json", {"v": float("nan")})


PAY = "event_ref string, account_ref string, amount double, paid date"


def test_payment_stream(spark, tmp_path):
    from loanloom.streaming.payments import conflict_sink

    source, accepted, conflicts = (str(tmp_path / n) for n in ("in", "ok", "bad"))
    first = [("a", "A", 10.0, date(2024, 1, 1)), ("b", "A", 5.0, date(2024, 1, 1)), ("b", "A", 5.0, date(2024, 1, 1))]
    second = [("a", "A", 10.0, date(2024, 1, 1)), ("b", "A", 6.0, date(2024, 1, 2)), ("c", "A", 1.0, date(2024, 1, 2))]
    for batch in (first, second):
        spark.createDataFrame(batch, PAY).coalesce(1).write.mode("append").parquet(source)
        query = (
            spark.readStream.schema(PAY).parquet(source).writeStream.trigger(availableNow=True)
            .option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(conflict_sink(accepted, conflicts, ["account_ref", "amount", "paid"])).start()
        )
        query.awaitTermination(120)
    assert {(r.event_ref, r.amount) for r in spark.read.parquet(accepted).collect()} == {("a", 10.0), ("b", 5.0), ("c", 1.0)}
    assert {r.event_ref for r in spark.read.parquet(conflicts).collect()} == {"b"}


def test_stream_drops_replays_and_counts_windows(spark, tmp_path):
    from datetime import datetime, timedelta

    from loanloom.streaming.payments import drop_replays
    from loanloom.streaming.rates import breaches

    start = datetime(2024, 1, 1)
    data = [(f"e{i}", "hot" if i % 2 else "cold", start + timedelta(seconds=20 * i)) for i in range(20)]
    data += data[:5] + [("end", "later", start + timedelta(hours=5))]
    source = str(tmp_path / "in")
    spark.createDataFrame(data, "event_ref string, k string, ts timestamp").coalesce(1).write.parquet(source)

    def drain(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    stream = spark.readStream.schema("event_ref string, k string, ts timestamp").parquet(source)
    assert len(drain(drop_replays(stream, "ts"), "replays")) == 21
    found = drain(breaches(drop_replays(stream, "ts"), "k", "ts", 10, delay=None), "breaches")
    assert found and {r.k for r in found} <= {"hot", "cold"} and max(r.n_events for r in found) == 10
