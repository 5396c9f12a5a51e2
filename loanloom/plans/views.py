"""Credit-shaped views over the generic test tables.

The test tables hold no loans, so each credit source is derived from orders,
line items, customers and events.  Column texts are valid in Spark and in the
oracle dialect alike; only the day difference is spelled differently.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CUTOFF = "1998-06-30"
#: Lines of a task that joins and groups them; larger tables get more tasks than the session's default.
TASK_LINES = 1 << 18
EVENT_CUTOFF = "2024-01-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _days(expr: str, cutoff: str, dialect: str) -> str:
    if dialect == "spark":
        return f"datediff(cast({expr} as date), date '{cutoff}')"
    return f"cast(datediff('day', date '{cutoff}', cast({expr} as date)) as integer)"


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{text} as {name}" for name, text in columns.items())


# ---------------------------------------------------------------- column texts
APPLICATION = {
    "SK_ID_CURR": "c_custkey",
    "NAME_CONTRACT_TYPE": "case when c_custkey % 20 = 19 then 'Revolving loans' else 'Cash loans' end",
    "TARGET": "case when (c_custkey * 7919) % 100 < 8 + 10 * (c_custkey % 3) then 1 else 0 end",
    "DAYS_BIRTH": "cast(-((17 + (c_custkey * 7) % 48) * 366 + c_custkey % 300) as integer)",
    "DAYS_EMPLOYED": "cast(case when c_custkey % 6 = 0 then 365243 else -((c_custkey * 3) % 16) * 365 "
                     "- case when c_custkey % 97 = 5 then 20000 else 0 end end as integer)",
    "AMT_INCOME_TOTAL": "c_acctbal * 12",
    "AMT_CREDIT": "o_totalprice",
    "AMT_ANNUITY": "o_totalprice / 36",
    "AMT_GOODS_PRICE": "case when c_custkey % 83 = 7 then null else floor(o_totalprice * 9 / 10) end",
    "CNT_FAM_MEMBERS": "1 + c_custkey % 5",
    "CNT_CHILDREN": "c_custkey % (1 + c_custkey % 5) + case when c_custkey % 41 = 3 then 5 else 0 end",
    "NAME_INCOME_TYPE": "case c_mktsegment when 'BUILDING' then 'Working' when 'AUTOMOBILE' then 'Commercial associate' "
                        "when 'MACHINERY' then 'State servant' when 'HOUSEHOLD' then 'Pensioner' else 'Freelancer' end",
    "NAME_EDUCATION_TYPE": "case c_custkey % 7 when 0 then 'Lower secondary' when 1 then 'Secondary / secondary special' "
                           "when 2 then 'Incomplete higher' when 3 then 'Higher education' when 4 then 'Academic degree' "
                           "when 5 then 'Unlisted' else 'Higher education' end",
    "OCCUPATION_TYPE": "case c_custkey % 9 when 0 then 'Laborers' when 1 then 'Core staff' when 2 then 'Managers' "
                       "when 3 then 'Drivers' when 4 then 'IT staff' when 5 then 'Astronauts' when 6 then null "
                       "else 'Sales staff' end",
    "NAME_HOUSING_TYPE": "case c_custkey % 8 when 0 then 'House / apartment' when 1 then 'With parents' "
                         "when 2 then 'Rented apartment' when 3 then null else 'Municipal apartment' end",
    "EXT_SOURCE_1": "case when c_custkey % 4 = 0 then null else cast((c_custkey * 31) % 1000 as double) / 1000 end",
    "EXT_SOURCE_2": "case when c_custkey % 9 = 0 then null else cast((c_custkey * 17) % 1000 as double) / 1000 end",
    "EXT_SOURCE_3": "cast((c_custkey * 13) % 1000 as double) / 1000",
    "AMT_REQ_CREDIT_BUREAU_HOUR": "case when c_custkey % 8 = 0 then null else cast(0 as double) end",
    "AMT_REQ_CREDIT_BUREAU_DAY": "case when c_custkey % 8 = 0 then null else cast(c_custkey % 2 as double) end",
    "AMT_REQ_CREDIT_BUREAU_WEEK": "case when c_custkey % 8 = 0 then null else cast(c_custkey % 3 as double) end",
    "AMT_REQ_CREDIT_BUREAU_MON": "case when c_custkey % 8 = 0 then null else cast(c_custkey % 3 as double) end",
    "AMT_REQ_CREDIT_BUREAU_QRT": "case when c_custkey % 16 = 0 then null else cast(c_custkey % 4 as double) end",
    "AMT_REQ_CREDIT_BUREAU_YEAR": "case when c_custkey % 8 = 0 then null else cast(c_custkey % 6 as double) end",
}


def _bureau(d: str) -> dict[str, str]:
    opened = _days("o_orderdate", CUTOFF, d)
    unknown = "o_orderpriority = '4-NOT SPECIFIED'"
    return {
        "SK_ID_CURR": "o_custkey",
        "SK_ID_BUREAU": "o_orderkey",
        "DAYS_CREDIT": opened,
        "DAYS_AVAILABLE": f"{opened} + cast(o_orderkey % 30 as integer)",
        "DAYS_CREDIT_UPDATE": f"{opened} + cast(o_orderkey % 45 as integer)",
        "CREDIT_ACTIVE": "case o_orderstatus when 'F' then 'Closed' when 'O' then 'Active' else 'Sold' end",
        "CREDIT_CURRENCY": "case when o_orderkey % 4 = 0 then 'currency 2' else 'currency 1' end",
        "CREDIT_DAY_OVERDUE": f"case when {unknown} then null else cast((o_orderkey % 7) * 5 as integer) end",
        "AMT_CREDIT_SUM": "o_totalprice",
        "AMT_CREDIT_SUM_DEBT": f"case when {unknown} then null when o_orderkey % 11 = 0 then -100.5 "
                               "else floor(o_totalprice * 4 / 10) end",
        "AMT_CREDIT_SUM_OVERDUE": "case when o_orderkey % 13 = 0 then floor(o_totalprice / 50) else 0 end",
    }


def _previous(d: str) -> dict[str, str]:
    decided = _days("o_orderdate", CUTOFF, d)
    return {
        "SK_ID_CURR": "o_custkey",
        "SK_ID_PREV": "o_orderkey",
        "DAYS_DECISION": decided,
        "DAYS_AVAILABLE": f"{decided} + cast(o_orderkey % 30 as integer)",
        "NAME_CONTRACT_STATUS": "case o_orderstatus when 'F' then 'Approved' when 'O' then 'Refused' else 'Canceled' end",
        "AMT_APPLICATION": "cast(case when o_orderkey % 17 = 0 then 0 else floor(o_totalprice) end as double)",
        "AMT_CREDIT": "cast(floor(o_totalprice * 11 / 10) as double)",
    }


MONTH_STATUS = (
    "case when min(l_returnflag) = 'A' then 'C' when max(l_linestatus) = 'O' and max(l_returnflag) = 'N' then 'X' "
    "else cast(l_linenumber % 6 as string) end"
)
ROW_STATUS = (
    "case when l_returnflag = 'A' then 'C' when l_linestatus = 'O' and l_returnflag = 'N' then 'X' "
    "else cast(l_linenumber % 6 as string) end"
)
BALANCE = {
    "SK_ID_BUREAU": "l_orderkey",
    "MONTHS_BALANCE": "-l_linenumber",
    "DAYS_AVAILABLE": "-l_linenumber * 30 + 10",
}
PAYMENT_ID = (
    "concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', "
    "cast(l_suppkey as string), '-', cast(cast(l_shipdate as date) as string), '-', "
    "cast(cast(floor(l_extendedprice * 100 + 0.5) as bigint) as string))"
)


def _payments(d: str) -> dict[str, str]:
    paid = _days("l_shipdate", CUTOFF, d)
    return {
        "SK_ID_CURR": "o_custkey",
        "SK_ID_PREV": "l_orderkey",
        "NUM_INSTALMENT_NUMBER": "l_linenumber",
        "NUM_INSTALMENT_VERSION": "1",
        "PAYMENT_ID": PAYMENT_ID,
        "DAYS_ENTRY_PAYMENT": paid,
        "AMT_PAYMENT": "l_extendedprice",
        "DAYS_AVAILABLE": f"{paid} + cast(l_partkey % 5 as integer)",
        "_ordered": "cast(o_orderdate as date)",
    }


SCHEDULE_CENTS = "floor(sum(cast(floor(AMT_PAYMENT * 100 + 0.5) as bigint)) * 9 / 10)"


def _schedule(d: str) -> dict[str, str]:
    due = _days("min(_ordered)", CUTOFF, d)
    return {
        "DAYS_INSTALMENT": f"{due} + 400 * NUM_INSTALMENT_NUMBER",
        "AMT_INSTALMENT": f"{SCHEDULE_CENTS} / 100",
        "DAYS_AVAILABLE": "cast(-(SK_ID_PREV % 400) as integer)",
    }


def _snapshots(d: str) -> dict[str, str]:
    return {
        "SK_ID_CURR": "user_id",
        "SK_ID_PREV": "user_id * 100 + cast(floor(value) as bigint) % 3",
        "MONTHS_BALANCE": _days("ts", EVENT_CUTOFF, d),
    }


SNAP_STATUS = {
    "click": "Active", "view": "Active", "signup": "Completed", "purchase": "Active", "error": "Demand",
}


def _status_text(column: str) -> str:
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in SNAP_STATUS.items())
    return f"case {column} {cases} end"


SNAPSHOT_MEASURES = {
    "DAYS_AVAILABLE": "MONTHS_BALANCE + cast(SK_ID_PREV % 3 as integer)",
    "SK_DPD": "case when cast(floor(top_value) as integer) % 11 = 0 then null "
              "else greatest(cast(floor(top_value) as integer) % 9 - 5, 0) end",
    "SK_DPD_DEF": "greatest(cast(floor(top_value) as integer) % 9 - 7, 0)",
    "NAME_CONTRACT_STATUS": _status_text("last_type"),
    "AMT_BALANCE": "case when cast(floor(top_value) as integer) % 13 = 0 then null else floor(top_value) - 20 end",
    "AMT_CREDIT_LIMIT_ACTUAL": "case SK_ID_PREV % 5 when 0 then 0 when 1 then null else 150 + SK_ID_PREV % 7 end",
    "AMT_DRAWINGS_ATM_CURRENT": "floor(top_value / 2)",
    "AMT_DRAWINGS_CURRENT": "floor(top_value)",
}


# ---------------------------------------------------------------- Spark side
def raw_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(F.max_by("o_totalprice", "o_orderkey").alias("o_totalprice"))
    )
    joined = table(spark, sf_dir, "customer").join(latest, F.col("c_custkey") == F.col("o_custkey"))
    return joined.selectExpr(*[f"{v} as {k}" for k, v in APPLICATION.items()])


def bureau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{v} as {k}" for k, v in _bureau("spark").items()])


def previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{v} as {k}" for k, v in _previous("spark").items()])


def balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One status per account and month."""
    grouped = (
        table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.expr(MONTH_STATUS).alias("STATUS"))
    )
    return grouped.selectExpr(*[f"{v} as {k}" for k, v in BALANCE.items()], "STATUS")


def raw_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account months with repeated rows left in."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        *[f"{v} as {k}" for k, v in BALANCE.items()], f"{ROW_STATUS} as STATUS"
    )


def line_tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """Tasks for what holds a row a line, where that is more than the session has cores.

    More shuffle partitions do not do instead: small ones are merged into tasks that hold many times these lines.
    """
    tasks = math.ceil(table(spark, sf_dir, "lineitem").count() / TASK_LINES)  # of the file footers
    return tasks if tasks > spark.sparkContext.defaultParallelism else None


def _payments_with_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    tasks = math.ceil(lines.count() / TASK_LINES)  # of the file footers
    if tasks > spark.sparkContext.defaultParallelism:
        lines = lines.repartition(tasks, "l_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.selectExpr(*[f"{v} as {k}" for k, v in _payments("spark").items()])


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _payments_with_order(spark, sf_dir).drop("_ordered")


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["SK_ID_CURR", "SK_ID_PREV", "NUM_INSTALMENT_NUMBER", "NUM_INSTALMENT_VERSION"]
    return (
        _payments_with_order(spark, sf_dir)
        .groupBy(*keys)
        .agg(*[F.expr(v).alias(k) for k, v in _schedule("spark").items()])
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account-day snapshots with POS and card measures."""
    keyed = table(spark, sf_dir, "events").selectExpr(
        *[f"{v} as {k}" for k, v in _snapshots("spark").items()], "value", "ts", "event_type"
    )
    grouped = keyed.groupBy("SK_ID_CURR", "SK_ID_PREV", "MONTHS_BALANCE").agg(
        F.max("value").alias("top_value"), F.max_by("event_type", "ts").alias("last_type")
    )
    return grouped.selectExpr(
        "SK_ID_CURR", "SK_ID_PREV", "MONTHS_BALANCE", *[f"{v} as {k}" for k, v in SNAPSHOT_MEASURES.items()]
    )


def history_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    snaps = snapshots(spark, sf_dir)
    return {
        "bureau": bureau(spark, sf_dir),
        "bureau_balance": balance(spark, sf_dir),
        "previous_application": previous(spark, sf_dir),
        "installments_payments": payments(spark, sf_dir),
        "pos_cash_balance": snaps,
        "credit_card_balance": snaps,
    }


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, y, p)``: labels with a deterministic score that has many ties."""
    labels, documents = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return labels.join(documents.select("doc_id", "n_chars"), "doc_id").selectExpr(
        "doc_id as id", "toxic as y", f"{SCORE} as p"
    )


SCORE = (
    "least(cast(0.99 as double), greatest(cast(0.01 as double), cast(n_chars % 97 as double) / 97 * cast(0.5 as double) "
    "+ cast(0.3 as double) * toxic))"
)


# ---------------------------------------------------------------- oracle side
VIEWS = {
    "v_raw": "select " + _select(APPLICATION) + " from customer join (select o_custkey, max_by(o_totalprice, o_orderkey) "
             "o_totalprice from orders group by 1) o on c_custkey = o_custkey",
    "v_bureau": "select " + _select(_bureau("oracle")) + " from orders",
    "v_prev": "select " + _select(_previous("oracle")) + " from orders",
    "v_balance": "select " + _select(BALANCE) + f", {MONTH_STATUS} as STATUS from lineitem group by l_orderkey, l_linenumber",
    "v_raw_balance": "select " + _select(BALANCE) + f", {ROW_STATUS} as STATUS from lineitem",
    "v_pay": "select " + _select(_payments("oracle")) + " from lineitem join orders on o_orderkey = l_orderkey",
    "v_sched": "select SK_ID_CURR, SK_ID_PREV, NUM_INSTALMENT_NUMBER, NUM_INSTALMENT_VERSION, "
               + _select(_schedule("oracle")) + " from v_pay group by 1, 2, 3, 4",
    "v_snap": "select SK_ID_CURR, SK_ID_PREV, MONTHS_BALANCE, " + _select(SNAPSHOT_MEASURES)
              + " from (select SK_ID_CURR, SK_ID_PREV, MONTHS_BALANCE, max(value) top_value, max_by(event_type, ts) last_type "
              "from (select " + _select(_snapshots("oracle")) + ", value, ts, event_type from events) group by 1, 2, 3)",
    "v_scored": f"select doc_id as id, toxic as y, {SCORE} as p from labels join documents using (doc_id)",
}
NEEDS = {"v_sched": ["v_pay"]}


def with_views(names: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    """Oracle text: the named views and extra steps as CTEs in front of ``body``."""
    ordered: list[str] = []
    for n in names:
        for d in NEEDS.get(n, []) + [n]:
            if d not in ordered:
                ordered.append(d)
    steps = [f"{n} as materialized ({VIEWS[n]})" for n in ordered]
    steps += [f"{n} as ({text})" for n, text in (extra or {}).items()]
    return (f"with {', '.join(steps)} " if steps else "") + body
