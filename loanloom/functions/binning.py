"""Bin expressions from edges that are already known numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def left_closed(value: Column, edges: Sequence[float]) -> Column:
    """Label of the bin [lo, hi) that holds the value; null outside all bins."""
    out = F.lit(None).cast("string")
    for low, high in reversed(list(zip(edges, edges[1:]))):
        out = F.when((value >= low) & (value < high), F.lit(f"[{low}, {high})")).otherwise(out)
    return out


def inner_edges_below(value: Column, edges: Sequence[float]) -> Column:
    """Bin number with left-open, right-closed bins: how many inner edges lie below the value."""
    inner = list(edges)[1:-1]
    steps = [F.when(value > e, 1).otherwise(0) for e in inner]
    total = F.lit(0)
    for s in steps:
        total = total + s
    return F.when(value.isNotNull(), total)


def quantile_bin(value: Column, edges: Sequence[float]) -> Column:
    """Right-closed quantile bin, lowest value included; repeated edges are dropped first."""
    return inner_edges_below(value, unique_edges(edges))


def unique_edges(edges: Sequence[float]) -> list[float]:
    return sorted(set(edges))


def equal_width(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Zero-based equal-width bin with a closed right end; one bin when all values agree."""
    width = (high - low) / bins
    raw = F.floor((value - low) / width).cast("int")
    spread = F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1))
    return F.when(value.isNull(), F.lit(None).cast("int")).when(high == low, F.lit(0)).otherwise(spread)
