"""Isotonic regression from mergeable blocks.

Scores are rounded to one part in ``RESOLUTION`` and their labels counted per distinct score, so whatever the number
of rows at most ``RESOLUTION + 1`` of them go on.  Those are sorted by range; each partition pools its adjacent violators into blocks,
and blocks of neighbouring partitions are pooled again in ever fewer tasks until one list is left.  Pooling is
associative along the order: blocks that violate inside a part also violate in the whole.

A score between two blocks is interpolated, as the curve is read from a table of short lists by score cell: no search
over all blocks and no Python at scoring.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scores in [0, 1] that are told apart, partitions pooled by one task, and cells of the lookup table.
RESOLUTION = 1_000_000
FAN_IN = 16
CELLS = 1024

DDL = "low double, high double, weight double, total double"


def pool(low: np.ndarray, high: np.ndarray, weight: np.ndarray, total: np.ndarray) -> list[np.ndarray]:
    """Pool adjacent violators of blocks sorted by ``low``; a block's value is ``total / weight``."""
    kept: list[list[float]] = []
    for block in zip(low.tolist(), high.tolist(), weight.tolist(), total.tolist(), strict=True):
        now = list(block)
        # equal neighbours are one block; products keep the comparison exact for counts
        while kept and kept[-1][3] * now[2] >= now[3] * kept[-1][2]:
            before = kept.pop()
            now = [before[0], now[1], before[2] + now[2], before[3] + now[3]]
        kept.append(now)
    return [np.array(c, float) for c in zip(*kept, strict=True)] if kept else [np.zeros(0)] * 4


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's blocks, pooled batch by batch."""
    names, held = ["low", "high", "weight", "total"], [np.zeros(0)] * 4
    for batch in batches:
        fresh = [batch[c].to_numpy(zero_copy_only=False) for c in names]
        held = pool(*(np.concatenate(pair) for pair in zip(held, fresh, strict=True)))
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=names)


def blocks(df: DataFrame, score: str, label: str, resolution: int = RESOLUTION) -> np.ndarray:
    """``(low, high, value)`` rows of the fitted steps, ascending; rows without score or label are left out."""
    rounded = F.round(F.col(score).cast("double") * resolution) / resolution
    known = df.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isNotNull())
    counts = known.groupBy(rounded.alias("low")).agg(
        F.count(F.lit(1)).cast("double").alias("weight"), F.sum(F.col(label).cast("double")).alias("total")
    )
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    level = counts.select("low", F.col("low").alias("high"), "weight", "total")
    while True:
        level = level.repartitionByRange(parts, "low").sortWithinPartitions("low").mapInArrow(_pooled, DDL)
        if parts == 1:
            break
        parts = -(-parts // FAN_IN)
    rows = level.collect()  # one list of blocks, at most resolution + 1
    return np.array([(r["low"], r["high"], r["total"] / r["weight"]) for r in rows]).reshape(-1, 3)


@dataclass
class IsotonicCurve:
    """The fitted curve; constant before its first and after its last point, linear between points."""

    points: list[tuple[float, float]]

    def cells(self) -> list[list[tuple[float, float, float, float]]]:
        """Segments ``(x0, y0, x1, y1)`` that meet each of ``CELLS`` equal parts of [0, 1]."""
        ends = [(-np.inf, self.points[0][1]), *self.points, (np.inf, self.points[-1][1])]
        out: list[list] = [[] for _ in range(CELLS)]
        for (x0, y0), (x1, y1) in zip(ends, ends[1:], strict=False):
            first = 0 if x0 == -np.inf else min(max(int(np.floor(x0 * CELLS)) - 1, 0), CELLS - 1)
            last = CELLS - 1 if x1 == np.inf else min(max(int(np.floor(x1 * CELLS)) + 1, 0), CELLS - 1)
            flat = x0 == -np.inf or x1 == np.inf
            segment = {"x1": None if x1 == np.inf else float(x1), "x0": 0.0 if flat else float(x0), "y0": float(y0), "slope": 0.0 if flat else float((y1 - y0) / (x1 - x0))}
            for cell in range(first, last + 1):
                out[cell].append(segment)
        return out

    def apply(self, score: Column) -> Column:
        """The curve at ``score`` as a column expression; null stays null."""
        schema = "array<array<struct<x1:double,x0:double,y0:double,slope:double>>>"
        table = F.from_json(F.lit(json.dumps(self.cells())), schema)
        cell = F.greatest(F.least(F.floor(score * CELLS), F.lit(CELLS - 1)), F.lit(0)).cast("int")
        near = F.filter(F.get(table, cell), lambda s: s["x1"].isNull() | (score <= s["x1"]))
        segment = F.get(near, F.lit(0))
        return segment["y0"] + (score - segment["x0"]) * segment["slope"]


def fit_isotonic(df: DataFrame, score: str, label: str, resolution: int = RESOLUTION) -> IsotonicCurve:
    """Curve through the ends of the pooled blocks; raises where no row has both score and label."""
    found = blocks(df, score, label, resolution)
    if not len(found):
        raise ValueError("Isotonic regression needs labelled scores")
    points: list[tuple[float, float]] = []
    for low, high, value in found.tolist():
        points += [(low, value)] if low == high else [(low, value), (high, value)]
    return IsotonicCurve(points)


def evaluate(points: Sequence[tuple[float, float]], scores: Sequence[float]) -> np.ndarray:
    """The curve on the driver, for a few scores."""
    xs, ys = zip(*points, strict=True)
    return np.interp(scores, xs, ys)
