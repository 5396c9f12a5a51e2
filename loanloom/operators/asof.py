"""Point-in-time filters, replay-safe deduplication and latest snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.functions.nullsafe import is_finite
from loanloom.operators.contracts import Rule

AVAILABLE = "DAYS_AVAILABLE"


def visible(event: str, availability: str | None = AVAILABLE) -> Column:
    """Happened, and could be known, at or before the cut-off (day zero)."""
    seen = F.col(event) <= 0
    return seen & (F.col(availability) <= 0) if availability else seen


def date_rules(event: str, availability: str | None = AVAILABLE) -> list[Rule]:
    rules = [Rule(f"Unknown event date: {event}", ~is_finite(F.col(event)))]
    if availability:
        rules.append(Rule("Unknown availability date", ~is_finite(F.col(availability))))
    return rules


def collapse_replays(df: DataFrame, key: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per event id plus ``n_rows`` and ``conflicting``.

    Equality of all copies is read from min, max and the null count, which
    combine map-side: an id replayed a billion times never meets in one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    aggregates = [F.count(F.lit(1)).alias("n_rows")]
    for c in columns:
        aggregates += [F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"), F.count(c).alias(f"n_{c}")]
    grouped = df.groupBy(*keys).agg(*aggregates)
    conflicting = F.lit(False)
    for c in columns:
        conflicting = (
            conflicting
            | F.coalesce(F.col(f"lo_{c}") != F.col(f"hi_{c}"), F.lit(False))
            | ((F.col(f"n_{c}") > 0) & (F.col(f"n_{c}") < F.col("n_rows")))
        )
    return grouped.select(
        *keys, *[F.col(f"lo_{c}").alias(c) for c in columns], "n_rows", conflicting.alias("conflicting")
    )


def latest_value(payload: Sequence[str], order: str) -> Column:
    """Struct of ``payload`` at the greatest ``order`` (unique inside the group)."""
    return F.max_by(F.struct(*[F.col(c) for c in payload]), F.col(order))


def latest_per(df: DataFrame, keys: Sequence[str], order: str, payload: Sequence[str]) -> DataFrame:
    """Latest row per key by aggregation instead of a sort."""
    picked = df.groupBy(*keys).agg(F.max(order).alias(order), latest_value(payload, order).alias("_p"))
    return picked.select(*keys, order, *[F.col(f"_p.{c}").alias(c) for c in payload])
