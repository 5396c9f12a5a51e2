"""Registered queries over rows of their own: whole jobs, and tasks that follow from the rows."""

import datetime as dt

from loanloom.operators import repayment as R
from loanloom.plans import catalogue, views
from loanloom.plans import evaluation_queries  # noqa: F401 - registers


def test_bootstrap_ci_checks_its_intervals_against_all_rows(spark, tmp_path):
    ids = range(60)
    spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in ids], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(i, i * 13 + 5) for i in ids], "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalogue.QUERIES["bootstrap_ci"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == [(m, 60, True) for m in ("average_precision", "brier", "roc_auc")]
    assert "bootstrap_ci" in catalogue.ORACLE


def test_lines_are_dealt_over_tasks_by_their_number(spark, tmp_path, monkeypatch):
    day = dt.date(1995, 1, 1)
    lines = [(o, n, o * 7, o % 5, day, 10.0 + n) for o in range(200) for n in (1, 2)]
    ddl = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date, l_extendedprice double"
    spark.createDataFrame(lines, ddl).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, o % 9, day) for o in range(200)], "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    plain = sorted(map(tuple, views.schedule(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(views, "TASK_LINES", 10)
    spread = views.payments(spark, str(tmp_path))
    assert "l_orderkey#" in (plan := spread._jdf.queryExecution().optimizedPlan().toString()) and "RepartitionByExpression" in plan and ", 40" in plan
    assert spread.count() == 400
    assert sorted(map(tuple, views.schedule(spark, str(tmp_path)).collect())) == plain and len(plain) == 400


def test_coverage_reads_payments_once_for_the_future_ones(spark, monkeypatch):
    """Payments by import and day are few for each import; their heavy keys need no pass of their own."""
    day = dt.date(2000, 1, 1)
    imports = spark.createDataFrame([(1, "DEMO", day, dt.date(1999, 1, 1), True, True), (2, "DEMO", day, dt.date(1999, 1, 1), True, True)],
                                    "import_id long, source_kind string, as_of date, window_start date, schedule_complete boolean, payments_complete boolean")
    schedules = spark.createDataFrame([(1, "a", "i", dt.date(1999, 6, 1), 10.0)], "import_id long, account_ref string, installment_ref string, due_date date, amount double")
    payments = spark.createDataFrame([(1, f"e{i}", "a", "i", day + dt.timedelta(days=i), 1.0) for i in range(-5, 8)] + [(None, "x", "a", "i", day, 1.0)],
                                     "import_id long, event_ref string, account_ref string, installment_ref string, paid_date date, amount double")
    status, joined = R.installment_status(imports, schedules, payments), R.header_join
    seen = []
    monkeypatch.setattr(R, "header_join", lambda facts, *a, **k: seen.append(facts.columns) or joined(facts, *a, **k))
    found = {r["import_id"]: r["excluded_future_payments"] for r in R.coverage_record(imports, schedules, payments, status).collect()}
    assert found == {1: 7, 2: 0} and seen == []


def test_events_and_obligations_are_dealt_by_the_lines(spark, tmp_path, monkeypatch):
    """More lines than the session's shuffles are made for: more tasks, and the same rows."""
    from loanloom.plans import extended_queries as X
    from loanloom.plans import repayment_queries as Q

    day = dt.date(1997, 1, 1)
    lines = [(o, n, o * 7, o % 5, day + dt.timedelta(days=o + n * (o % 3)), 10.0 + n) for o in range(200) for n in (1, 1, 2)]
    ddl = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date, l_extendedprice double"
    spark.createDataFrame(lines, ddl).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, o % 9, day) for o in range(200)], "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(c,) for c in range(9)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    jobs = [lambda: Q.status(spark, str(tmp_path)), lambda: X.payment_records(spark, str(tmp_path))]
    assert views.line_tasks(spark, str(tmp_path)) is None
    plain = [sorted(map(str, job().collect())) for job in jobs]
    monkeypatch.setattr(views, "TASK_LINES", 60)
    for job, rows in zip(jobs, plain, strict=True):
        assert "hashpartitioning" in (plan := job()._jdf.queryExecution().executedPlan().toString()) and plan.count("REPARTITION_BY_NUM") >= 4
        assert sorted(map(str, job().collect())) == rows and len(rows) >= 100


def test_more_shuffle_partitions_leave_the_lines_dealt(spark, tmp_path, monkeypatch):
    """Shuffles that the session sizes are merged into few tasks; obligations and events must not depend on them."""
    import re

    from loanloom.plans import repayment_queries as Q

    day = dt.date(1997, 1, 1)
    lines = [(o, n, o * 7, o % 5, day + dt.timedelta(days=o + n * (o % 3)), 10.0 + n) for o in range(200) for n in (1, 1, 2)]
    ddl = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date, l_extendedprice double"
    spark.createDataFrame(lines, ddl).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, o % 9, day) for o in range(200)], "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(c,) for c in range(9)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    plain = sorted(map(str, Q.metrics(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(views, "TASK_LINES", 60)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert views.line_tasks(spark, str(tmp_path)) == 10
        status = Q.status(spark, str(tmp_path))
        plan = status._jdf.queryExecution().executedPlan().toString()
        own = re.findall(r"hashpartitioning\(([^)]*)\), ENSURE_REQUIREMENTS", plan)
        assert not [keys for keys in own if "import_id" in keys or "account_ref" in keys], own
        assert sorted(map(str, Q.metrics(spark, str(tmp_path)).collect())) == plain and len(plain) == 9
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_headers_meet_facts_in_the_tasks_asked_for(spark):
    from loanloom.operators.salted import header_join

    facts = spark.createDataFrame([(k, i) for i in range(300) for k in (0 if i % 2 else i, None)], "k long, v long")
    headers = spark.createDataFrame([(k, k * 10) for k in range(0, 300, 3)], "k long, h long")
    for share in (0.01, 0.9):  # with a heavy key and without
        for how in ("inner", "left"):
            plain = sorted(map(str, header_join(facts, headers, "k", how, share, deal=["v"]).collect()))
            dealt = header_join(facts, headers, "k", how, share, deal=["v"], tasks=7)
            assert sorted(map(str, dealt.collect())) == plain and len(plain) > 100
            assert dealt._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2
