"""Wide-to-long helpers for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_rows(df: DataFrame, rows: list[dict[str, Column]], keep: list[str] | None = None) -> DataFrame:
    """Turn each input row into ``len(rows)`` output rows inside the same task."""
    kept = [F.col(c) for c in keep or []]
    packed = F.explode(F.array(*[F.struct(*[v.alias(k) for k, v in r.items()]) for r in rows]))
    return df.select(*kept, packed.alias("_r")).select(*(keep or []), "_r.*")
