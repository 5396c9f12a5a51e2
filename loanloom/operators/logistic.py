"""Logistic regressions for many penalties and held-out folds at once.

All fits take Newton steps together: one pass gives the loss, gradient and curvature of every fit that still moves,
added up over tasks.  The objective is that of the library's classifier: weighted mean log loss plus half the penalty
times the squared coefficients of features scaled by their weighted deviation; the intercept is free.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.operators.sums import array_sums

STEPS, GRADIENT = 60, 1e-9
BLOCK = 4096


@dataclass
class Logistic:
    """One fit; ``held_out`` names the fold whose rows it has not seen."""

    penalty: float
    held_out: int | None
    coefficients: np.ndarray
    intercept: float = 0.0
    steps: int = 0

    def probability(self, features: Column) -> Column:
        """As a column expression over an array of features."""
        weights = F.array(*[F.lit(float(c)) for c in self.coefficients])
        margin = F.aggregate(F.zip_with(features, weights, lambda a, b: a * b), F.lit(float(self.intercept)), lambda t, v: t + v)
        return 1 / (1 + F.exp(-margin))


def _rows(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    y, w, fold = (batch[c].to_numpy(zero_copy_only=False) for c in ("y", "w", "fold"))
    for at in range(0, len(x), BLOCK):
        here = slice(at, at + BLOCK)
        yield x[here], y[here], w[here], fold[here]


def _scales(rows: DataFrame, width: int, folds: Sequence[int | None], tasks: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Total weight, weighted means and deviations of the rows that each fold leaves."""

    def work(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for x, _, w, fold in _rows(batch, width):
            for i, out in enumerate(folds):
                v = w if out is None else np.where(fold == out, 0.0, w)
                yield i, np.concatenate([[v.sum(), (v * v).sum()], v @ x, v @ (x * x)])

    found, scales = array_sums(rows, work, tasks), []
    for i in range(len(folds)):
        total, squares, first, second = found[i][0], found[i][1], found[i][2 : 2 + width], found[i][2 + width :]
        mean = first / total
        variance = np.maximum(second - total * mean * mean, 0) / max(total - squares / total, 1e-300)
        variance[variance < 1e-14 * np.maximum(second / total, 1e-300)] = 0  # a constant feature
        scales.append((total, mean, np.sqrt(variance)))
    return scales


def fit_all(ready: DataFrame, specs: Sequence[tuple[float, int | None]], fold: str | None = None) -> list[Logistic]:
    """A fit for each ``(penalty, held-out fold)`` over rows of ``features, y, w`` and, if any is held out, ``fold``.

    Without rows, or without weight beside a fold, it is an error.  A constant feature gets no coefficient.
    """
    x = ready.select(
        vector_to_array("features").alias("x"), F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w"),
        (F.col(fold).cast("int") if fold else F.lit(-1)).alias("fold"),
    ).persist()
    try:
        first = x.first()
        if first is None:
            raise ValueError("Logistic regression needs rows")
        return _newton(x, len(first["x"]), specs, x.rdd.getNumPartitions())
    finally:
        x.unpersist()


def _newton(rows: DataFrame, width: int, specs: Sequence[tuple[float, int | None]], tasks: int) -> list[Logistic]:
    folds = sorted({out for _, out in specs}, key=lambda f: (f is not None, f))
    scales = dict(zip(folds, _scales(rows, width, folds, tasks), strict=True))
    if any(total <= 0 for total, _, _ in scales.values()):
        raise ValueError("Logistic regression needs weight beside every fold")
    beta = {i: np.zeros(width + 1) for i in range(len(specs))}  # the intercept comes last
    kept: dict[int, tuple[float, np.ndarray]] = {}
    moving, steps, stepped = set(beta), 0, dict.fromkeys(beta, 0)
    while moving and steps < STEPS:
        steps += 1
        now = {i: beta[i] for i in sorted(moving)}

        def work(batch: pa.RecordBatch, now=now) -> Iterator[tuple[int, np.ndarray]]:
            for x, y, w, fold in _rows(batch, width):
                for out in folds:
                    here = [i for i in now if specs[i][1] == out]
                    if not here:
                        continue
                    v = w if out is None else np.where(fold == out, 0.0, w)
                    _, mean, deviation = scales[out]
                    z = np.column_stack([np.where(deviation > 0, (x - mean) / np.where(deviation > 0, deviation, 1), 0.0), np.ones(len(x))])
                    for i in here:
                        margin = z @ now[i]
                        p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
                        loss = v @ (np.logaddexp(0, margin) - y * margin)
                        curve = z.T @ (z * (v * p * (1 - p))[:, None])
                        yield i, np.concatenate([[loss], z.T @ (v * (p - y)), curve.ravel()])

        found = array_sums(rows, work, tasks)
        for i, at in now.items():
            penalty, out = specs[i]
            total = scales[out][0]
            shrink = np.append(np.full(width, penalty), 0.0)
            loss = found[i][0] / total + 0.5 * float(shrink @ (at * at))
            gradient = found[i][1 : width + 2] / total + shrink * at
            if i in kept and loss > kept[i][0] + 1e-12:  # too far: half the way
                beta[i] = (at + kept[i][1]) / 2
                continue
            kept[i], stepped[i] = (loss, at), steps
            if np.abs(gradient).max() < GRADIENT:
                moving.discard(i)
                continue
            curve = found[i][width + 2 :].reshape(width + 1, width + 1) / total + np.diag(shrink)
            beta[i] = at - np.linalg.lstsq(curve, gradient, rcond=None)[0]
    out = []
    for i, (penalty, held) in enumerate(specs):
        _, mean, deviation = scales[held]
        at = kept[i][1]
        weights = np.where(deviation > 0, at[:-1] / np.where(deviation > 0, deviation, 1), 0.0)
        out.append(Logistic(penalty, held, weights, float(at[-1] - weights @ mean), stepped[i]))
    return out


def held_out_scores(ready: DataFrame, fits: Sequence[Logistic], options: Sequence[int], fold: str) -> DataFrame:
    """``option, fold, y, p`` for every row and option, scored by the fit that has not seen the row's fold."""
    each = [
        F.struct(F.lit(option).alias("option"), F.when(F.col("_fold") == fit.held_out, fit.probability(F.col("x"))).alias("p"))
        for option, fit in zip(options, fits, strict=True) if fit.held_out is not None
    ]
    rows = ready.select(vector_to_array("features").alias("x"), "y", F.col(fold).alias("_fold"))
    mine = F.filter(F.array(*each), lambda s: s["p"].isNotNull())
    return rows.select("y", F.col("_fold").alias("fold"), F.explode(mine).alias("s")).select("s.option", "fold", "y", "s.p")
