"""Row and key contracts.

A contract is an ordered list of rules.  Every rule is a boolean column that is
true for a *bad* row, so one scan can attach the first failing reason to a row,
count all violations, or stop a job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.errors import ContractError
from loanloom.functions.reshape import long_rows


@dataclass(frozen=True)
class Rule:
    """``broken`` is true for rows that violate the rule called ``name``; null counts as kept."""

    name: str
    broken: Column


def first_reason(rules: Sequence[Rule]) -> Column:
    """Name of the first broken rule in declaration order, null for a clean row."""
    return F.coalesce(*[F.when(r.broken, r.name) for r in rules], F.lit(None).cast("string"))


def with_reason(df: DataFrame, rules: Sequence[Rule], column: str = "reason") -> DataFrame:
    return df.withColumn(column, first_reason(rules))


def violation_counts(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``(rule, violations)`` for every rule from a single pass over the data."""
    totals = df.agg(*[F.count_if(r.broken).alias(f"v{i}") for i, r in enumerate(rules)])
    return long_rows(
        totals, [{"rule": F.lit(r.name), "violations": F.col(f"v{i}")} for i, r in enumerate(rules)]
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are null or occur more than once, with their row counts."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where((F.col("n_rows") > 1) | missing)


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct child keys without a parent row.

    Keys are reduced to one row each before the join, so a key that owns a third
    of the child table costs the join a single row.
    """
    child_keys = child.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return child_keys.join(parent.select(*keys).distinct(), list(keys), "left_anti")


def conflicting_owners(df: DataFrame, account: str, owner: str) -> DataFrame:
    """Accounts that appear under more than one owner, or both with and without one."""
    owners = df.groupBy(account).agg(
        F.min(owner).alias("first_owner"), F.max(owner).alias("last_owner"), F.count(owner).alias("_known"), F.count(F.lit(1)).alias("_all")
    )
    mixed = (F.col("_known") > 0) & (F.col("_known") < F.col("_all"))
    return owners.where((F.col("first_owner") != F.col("last_owner")) | mixed).drop("_known", "_all")


def count_as(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")


def union_reports(reports: Sequence[DataFrame]) -> DataFrame:
    merged = reports[0]
    for r in reports[1:]:
        merged = merged.unionByName(r)
    return merged


def enforce(report: DataFrame) -> None:
    """Raise on the first broken rule of a ``(rule, violations)`` report.

    The report holds one row per declared rule, so what reaches the driver is
    bounded by the contract and not by the data.
    """
    broken = [(r["rule"], r["violations"]) for r in report.where(F.col("violations") > 0).collect()]
    if broken:
        text = "; ".join(f"{name} ({count} rows)" for name, count in broken)
        raise ContractError(text)


def require_columns(df: DataFrame, columns: Sequence[str], source: str = "source") -> None:
    """Schema-only check: no job is started."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ContractError(f"{source}: missing columns {', '.join(missing)}")
