"""One row per applicant with all 43 history features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.operators.application import ID
from loanloom.operators.contracts import count_as, duplicate_keys, enforce, union_reports
from loanloom.operators.gates import HISTORY_GATES, enforce_gates, source_blockers
from loanloom.operators.history.bureau import bureau_checks, bureau_features
from loanloom.operators.history.installments import installment_checks, installment_features
from loanloom.operators.history.names import GROUPS, HISTORY, zero_when_absent
from loanloom.operators.history.previous import previous_checks, previous_features
from loanloom.operators.history.snapshots import card_features, pos_features, snapshot_checks

LOAN = "SK_ID_PREV"


def owner_conflicts(source: DataFrame, previous: DataFrame) -> DataFrame:
    """(loan, owner) pairs of a source that the previous-application table does not confirm."""
    pairs = source.select(LOAN, ID).distinct()
    declared = previous.select(LOAN, F.col(ID).alias("_declared"))
    return pairs.join(declared, LOAN, "left").where(~F.coalesce(F.col(ID) == F.col("_declared"), F.lit(False)))


def history_checks(tables: dict[str, DataFrame], schedule: DataFrame) -> DataFrame:
    """Every key, ownership and domain rule of the six history sources."""
    previous = tables["previous_application"]
    sources = {
        "installment_schedule": schedule,
        "installments_payments": tables["installments_payments"],
        "pos_cash_balance": tables["pos_cash_balance"],
        "credit_card_balance": tables["credit_card_balance"],
    }
    owners = [
        count_as(owner_conflicts(df, previous), f"Owner differs from previous application: {name}")
        for name, df in sources.items()
    ]
    return union_reports(
        [
            previous_checks(previous),
            *owners,
            bureau_checks(tables["bureau"], tables["bureau_balance"]),
            installment_checks(tables["installments_payments"], schedule),
            snapshot_checks(tables["pos_cash_balance"], "POS"),
            snapshot_checks(tables["credit_card_balance"], "card"),
        ]
    )


def attach(base: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """Left join one feature table; absent applicants get zero counts and null measures."""
    hit = features.select(ID, *names, F.lit(True).alias("_hit"))
    joined = base.join(hit, ID, "left")
    filled = {
        n: F.when(F.col("_hit").isNull(), F.lit(0)).otherwise(F.col(n)) for n in names if zero_when_absent(n)
    }
    return joined.withColumns(filled).drop("_hit")


def assemble(applicants: DataFrame, tables: dict[str, DataFrame], schedule: DataFrame) -> DataFrame:
    """History features for every applicant, without running the checks."""
    parts = [
        (("bureau", "bureau_balance"),
         bureau_features(tables["bureau"], tables["bureau_balance"], validate=False)),
        (("previous_application",), previous_features(tables["previous_application"], validate=False)),
        (("installments_payments",),
         installment_features(tables["installments_payments"], schedule, validate=False)),
        (("pos_cash_balance",), pos_features(tables["pos_cash_balance"], validate=False)),
        (("credit_card_balance",), card_features(tables["credit_card_balance"], validate=False)),
    ]
    out = applicants.select(ID)
    for groups, features in parts:
        out = attach(out, features, [n for g in groups for n in GROUPS[g]])
    return out.select(ID, *[F.col(n).cast("double").alias(n) for n in HISTORY])


def history_features(
    applicants: DataFrame, tables: dict[str, DataFrame], schedule: DataFrame, context: dict
) -> DataFrame:
    """Gated build: evidence first, then contracts, then features."""
    enforce_gates([f"Full unavailable: {g}" for g in HISTORY_GATES if context.get(g) is not True])
    enforce_gates(source_blockers(context, tables))
    enforce(count_as(duplicate_keys(applicants, [ID]), "Missing or duplicate applicant"))
    enforce(history_checks(tables, schedule))
    return assemble(applicants, tables, schedule)
