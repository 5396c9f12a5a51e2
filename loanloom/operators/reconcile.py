"""Contractual schedule against payment events.

Completion is the first *day* on which the running total reaches the amount due.
Payments are never negative, so the order inside a day cannot change that day:
payments are first summed per obligation and day (a map-side-combinable
aggregate), and the running total then only sees one row per calendar day.  An
obligation holding a large part of all payments stays a small window group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def daily_totals(payments: DataFrame, keys: Sequence[str], day: str, amount: str) -> DataFrame:
    """``(keys, day, amount)`` with exact integer amounts summed per day."""
    return payments.groupBy(*keys, day).agg(F.sum(amount).alias(amount))


def settle(
    schedule: DataFrame,
    daily: DataFrame,
    keys: Sequence[str],
    *,
    due_day: str,
    due_amount: str,
    day: str,
    amount: str,
    tolerance: int,
    until: str | None = None,
) -> DataFrame:
    """Every obligation with ``completion``, ``paid`` and ``paid_by_due``.

    Obligations without any payment are kept with zero paid and no completion.  ``until`` names the schedule's last
    visible day: payments after it count for nothing, which needs no join of their own with what sets that day.
    The window, the join and the final aggregate share one partitioning on
    ``keys``, which are unique in the schedule.
    """
    running = W.partitionBy(*keys).orderBy(day).rowsBetween(W.unboundedPreceding, W.currentRow)
    progress = daily.select(
        *keys, F.col(day).alias("_day"), F.col(amount).alias("_amount"), F.sum(amount).over(running).alias("_running")
    )
    visible = F.col("_day") <= F.col(until) if until else F.lit(True)
    # later days come last in a running total, so they cannot change an earlier one
    reached = visible & (F.col("_running") >= F.col(due_amount) - tolerance)
    nothing = F.lit(0).cast("bigint")
    payload = [c for c in schedule.columns if c not in keys]
    return (
        schedule.join(progress, list(keys), "left")
        .groupBy(*keys)
        .agg(
            *[F.max(c).alias(c) for c in payload],
            F.min(F.when(reached, F.col("_day"))).alias("completion"),
            F.coalesce(F.sum(F.when(visible, F.col("_amount"))), nothing).alias("paid"),
            F.coalesce(F.sum(F.when(visible & (F.col("_day") <= F.col(due_day)), F.col("_amount"))), nothing).alias("paid_by_due"),
        )
    )
