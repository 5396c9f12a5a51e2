"""K-Means for many (k, seed, start) at once: every pass over the rows serves all fits.

Rows are packed into blocks once and kept, in as many partitions as their number asks for, as an RDD: passes are many
and short, and one over a DataFrame costs its plan again.  A pass multiplies a block with the centres of all fits
together, and sends one array of sums a task; so a sweep over k, seeds and starts costs the passes of its slowest fit,
not of all fits after each other.
Fits that have settled leave the passes.  Starting centres are chosen over all rows: each round takes rows with a
probability in proportion to their squared distance to the centres so far, and the driver weighs the few candidates.
Whether a row is taken is a function of its values, the seed and the round, never of its partition.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from loanloom.operators.sums import FAN_IN

#: Rows of a block, and of the slices in which it meets the centres, whose distances stay in a core's cache.
BLOCK, SLICE = 2048, 512
#: Numbers of a partition, from which on there are more partitions than cores.
NUMBERS = 1 << 22
#: Rounds that choose candidates, and candidates a round for each centre wanted.
ROUNDS, OVERSAMPLE = 2, 2
STEPS, TOLERANCE = 150, 1e-4


def _array(vector: str) -> Column:
    # imported here, as tasks read this module and need no ML
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(vector)


@dataclass
class Fit:
    """One fit: its centres, the rows and the squared distances of each."""

    k: int
    seed: int
    start: int
    centers: np.ndarray
    sizes: np.ndarray | None = None
    sums: np.ndarray | None = None
    squares: np.ndarray | None = None
    inertia: float = float("inf")
    steps: int = 0

    def label(self, features: Column) -> Column:
        """Place of the nearest centre, the first among equals, as a column expression over an array."""
        lit = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in self.centers])
        gaps = F.transform(lit, lambda c: F.aggregate(F.zip_with(features, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v))
        return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802 - the name that MLlib's model has
        return list(self.centers)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the ``cluster`` of its ``features`` vector."""
        return df.withColumn("cluster", self.label(_array("features")))


def _blocks(rows: Iterable[tuple[bytes, bytes]], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for x, key in rows:
        yield np.frombuffer(x).reshape(-1, width), np.frombuffer(key, np.uint64)


def _gaps(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1), 0)


def _points(df: DataFrame) -> tuple[DataFrame, int]:
    """Rows as arrays ``x`` and a ``key`` that equal rows share; the number of dimensions."""
    x = df.select(_array("features").alias("x"))
    first = x.first()
    return x.withColumn("key", F.xxhash64("x")), len(first["x"]) if first else 0


def _packed(points: DataFrame, width: int) -> RDD:
    """Blocks of rows and of their keys as bytes."""

    def run(rows: Iterator[Row]) -> Iterator[tuple[bytes, bytes]]:
        while part := list(islice(rows, BLOCK)):
            x, key = np.array([r[0] for r in part], float), np.array([r[1] for r in part], np.int64)
            yield x.reshape(-1, width).tobytes(), key.tobytes()

    return points.rdd.mapPartitions(run)  # one Python worker a task: blocks are made and met by the same


def _tasks(rows: int, width: int, cores: int) -> int:
    """Partitions for stored rows: one a core where each gets a block, more where they would be large."""
    return max(1, min(cores, math.ceil(rows / BLOCK)), math.ceil(rows * width / NUMBERS))


def _added(arrays: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
    total = None
    for value in arrays:
        total = value if total is None else total + value
    if total is not None:
        yield total


def _summed(blocks: RDD, width: int, work: Callable, tasks: int | None = None) -> np.ndarray:
    """The sum of the arrays that ``work(x, key)`` gives for each block; the driver sees at most ``FAN_IN`` of them."""
    sums = blocks.mapPartitions(lambda rows: _added(work(x, key) for x, key in _blocks(rows, width)))
    if (tasks or blocks.getNumPartitions()) > FAN_IN:
        spread = sums.mapPartitionsWithIndex(lambda i, arrays: ((i % FAN_IN, a) for a in arrays))
        sums = spread.reduceByKey(lambda a, b: a + b, FAN_IN).values().mapPartitions(_added)
    return next(_added(sums.collect()))


def _statistics(blocks: RDD, width: int, centers: Sequence[np.ndarray], tasks: int) -> list[np.ndarray]:
    """For each set of centres: rows, squared distance, squared length and coordinate sums of each centre's rows."""
    order = sorted(range(len(centers)), key=lambda i: len(centers[i]))  # sets of one size stand together
    edges = np.cumsum([0, *(len(centers[i]) for i in order)])
    every = np.concatenate([centers[i] for i in order])
    far = np.column_stack([-2 * every, (every * every).sum(1)])
    sizes = [len(centers[i]) for i in order]
    groups = [(edges[sizes.index(k)], edges[sizes.index(k) + sizes.count(k)], k) for k in sorted(set(sizes))]

    def work(x: np.ndarray, _: np.ndarray) -> np.ndarray:
        total = np.zeros((len(every), 3 + width))
        for at in range(0, len(x), SLICE):
            part = x[at : at + SLICE]
            n, lengths, ones = len(part), (part * part).sum(1), np.ones(len(part))
            gaps, taken = far @ np.column_stack([part, ones]).T, np.empty((len(every), n))  # without the rows' lengths
            for a, b, k in groups:
                mine, hit = gaps[a:b].reshape(-1, k, n), taken[a:b].reshape(-1, k, n)
                least = mine.min(1)
                np.equal(mine, least[:, None], out=hit)
                if hit.sum() != least.size:  # the first among equals
                    hit[:] = mine.argmin(1)[:, None] == np.arange(k)[:, None]
                total[a:b, 1] += (hit @ np.maximum(least + lengths, 0)[:, :, None]).ravel()
            found = taken @ np.column_stack([ones, lengths, part])
            total[:, 0] += found[:, 0]
            total[:, 2:] += found[:, 1:]
        return total.ravel()

    table = _summed(blocks, width, work, tasks).reshape(len(every), 3 + width)
    out = dict(zip(order, (table[a:b] for a, b in zip(edges, edges[1:], strict=False)), strict=True))
    return [out[i] for i in range(len(centers))]


def _draw(key: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) for each key."""
    with np.errstate(over="ignore"):
        mixed = key + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)


def _candidates(points: DataFrame, blocks: RDD, width: int, fits: Sequence[Fit], tasks: int) -> list[np.ndarray]:
    """Rows that may become centres, for each fit: the first by hash, then by squared distance over some rounds."""
    seeds = sorted({(f.seed, f.start) for f in fits})
    firsts = points.agg(*[F.min_by("x", F.xxhash64("key", F.lit(f"{seed}/{start}"))).alias(f"f{i}") for i, (seed, start) in enumerate(seeds)]).first()
    sets = [np.array([firsts[f"f{seeds.index((f.seed, f.start))}"]], float) for f in fits]
    for turn in range(ROUNDS):
        costs = [table[:, 1].sum() for table in _statistics(blocks, width, sets, tasks)]

        def taken(rows: Iterable[tuple[bytes, bytes]], sets=sets, costs=costs, turn=turn) -> Iterator[tuple[int, tuple]]:
            for x, key in _blocks(rows, width):
                for i, (fit, centers, cost) in enumerate(zip(fits, sets, costs, strict=True)):
                    if cost <= 0:
                        continue
                    chance = _gaps(x, centers).min(1) * (OVERSAMPLE * fit.k / cost)
                    salt = hash((fit.seed, fit.start, fit.k, turn))
                    hit = np.flatnonzero(_draw(key, salt) < chance)
                    for row in np.unique(x[hit], axis=0).tolist():
                        yield i, tuple(row)

        # about OVERSAMPLE * k rows a fit, each value once
        found = blocks.mapPartitions(taken).distinct(min(tasks, FAN_IN)).collect()
        fresh: dict[int, list] = {}
        for i, x in sorted(found, key=lambda r: r[1]):
            fresh.setdefault(i, []).append(x)
        sets = [np.unique(np.concatenate([s, np.array(fresh[i], float)]), axis=0) if i in fresh else s for i, s in enumerate(sets)]
    return sets


def _weighed(candidates: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Up to ``k`` of the candidates by weight and distance, then moved by a few weighted steps."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.choice(len(candidates), p=weights / weights.sum()))]
    while len(chosen) < k:
        chance = weights * _gaps(candidates, candidates[chosen]).min(1)
        chance[chosen] = 0
        if chance.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(candidates), p=chance / chance.sum())))
    centers = candidates[chosen]
    for _ in range(30):
        nearest = _gaps(candidates, centers).argmin(1)
        moved = np.array([
            np.average(candidates[nearest == j], axis=0, weights=weights[nearest == j]) if weights[nearest == j].sum() > 0 else centers[j]
            for j in range(len(centers))
        ])
        if np.allclose(moved, centers):
            break
        centers = moved
    return centers


def fit_all(df: DataFrame, specs: Sequence[tuple[int, int, int]], steps: int = STEPS, tolerance: float = TOLERANCE) -> list[Fit]:
    """A fit for each ``(k, seed, start)`` over all rows of ``df`` (features).

    A fit has fewer than k centres where there are fewer different rows; an empty table is an error.  A centre that
    loses all rows stays where it is.
    """
    points, width = _points(df)
    if not width:
        raise ValueError("K-Means needs rows")
    fits = [Fit(k, seed, start, np.zeros((0, width))) for k, seed, start in specs]
    points = points.persist()
    tasks = _tasks(points.count(), width, df.sparkSession.sparkContext.defaultParallelism)
    # dealt anew where they come in fewer partitions, as small tables do
    dealt = points.coalesce(tasks) if points.rdd.getNumPartitions() >= tasks else points.repartition(tasks)
    blocks = _packed(dealt, width).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sets = _candidates(points, blocks, width, fits, tasks)
        points.unpersist()  # the blocks are stored by now
        for fit, candidates, table in zip(fits, sets, _statistics(blocks, width, sets, tasks), strict=True):
            fit.centers = _weighed(candidates, table[:, 0], fit.k, fit.seed + 1000 * fit.start)
        moving = list(fits)
        while moving:
            for fit, table in zip(moving, _statistics(blocks, width, [f.centers for f in moving], tasks), strict=True):
                n = table[:, :1]
                moved = np.where(n > 0, table[:, 3:] / np.maximum(n, 1), fit.centers)
                shift = ((moved - fit.centers) ** 2).sum(1).max()
                fit.centers, fit.steps = moved, fit.steps + 1
                if shift <= tolerance**2:
                    fit.steps = -fit.steps
            moving = [f for f in moving if 0 < f.steps < steps]
        for fit, table in zip(fits, _statistics(blocks, width, [f.centers for f in fits], tasks), strict=True):
            fit.steps = abs(fit.steps)
            fit.sizes, fit.squares, fit.sums, fit.inertia = table[:, 0], table[:, 2], table[:, 3:], float(table[:, 1].sum())
    finally:
        blocks.unpersist()
        points.unpersist()
    return fits


@dataclass
class Quality:
    """What one pass measures of a fit's labels."""

    rows: int
    silhouette: float
    scatter: np.ndarray


def quality(df: DataFrame, fits: Sequence[Fit], pairs: Sequence[tuple[int, int]] = ()) -> tuple[list[Quality], list[np.ndarray]]:
    """Silhouette and scatter of all fits, and the contingency table of each pair of them, in one pass.

    The silhouette is the squared Euclidean one: mean distances to a cluster follow from its rows, sums and squares.
    Scatter is the mean distance of a cluster's rows to their mean.
    """
    points, width = _points(df)
    edges = np.cumsum([0, *(len(f.centers) for f in fits)])
    cells = np.cumsum([0, *(len(fits[a].centers) * len(fits[b].centers) for a, b in pairs)])

    def work(x: np.ndarray, _: np.ndarray) -> np.ndarray:
        labels, scores, scatter, lengths, rows = [], [], [], (x * x).sum(1), np.arange(len(x))
        for fit in fits:
            label = _gaps(x, fit.centers).argmin(1)
            labels.append(label)
            n = np.maximum(fit.sizes, 1)
            mean = fit.sums / n[:, None]
            far = np.where(fit.sizes > 0, lengths[:, None] + fit.squares / n - 2 * x @ mean.T, np.inf)
            size = fit.sizes[label]
            own = np.where(size > 1, far[rows, label] * size / np.maximum(size - 1, 1), 0)
            far[rows, label] = np.inf
            other = far.min(1) if len(fit.centers) > 1 else np.full(len(x), np.inf)
            most = np.maximum(own, other)
            score = np.where((size > 1) & np.isfinite(other) & (most > 0), (other - own) / np.where(most > 0, most, 1), 0)
            scores.append(score.sum())
            scatter.append(np.bincount(label, np.sqrt(((x - mean[label]) ** 2).sum(1)), len(fit.centers)))
        joint = [np.bincount(labels[a] * len(fits[b].centers) + labels[b], minlength=len(fits[a].centers) * len(fits[b].centers)) for a, b in pairs]
        return np.concatenate([[len(x)], scores, *scatter, *joint])

    found = _summed(_packed(points, width), width, work)
    n, score, rest = found[0], found[1 : 1 + len(fits)], found[1 + len(fits) :]
    scatter, joint = rest[: edges[-1]], rest[edges[-1] :]
    out, tables = [], []
    for i, fit in enumerate(fits):
        out.append(Quality(int(n), float(score[i] / n), scatter[edges[i] : edges[i + 1]] / np.maximum(fit.sizes, 1)))
    for p, (a, b) in enumerate(pairs):
        tables.append(joint[cells[p] : cells[p + 1]].reshape(len(fits[a].centers), len(fits[b].centers)))
    return out, tables


def davies_bouldin(fit: Fit, scatter: np.ndarray) -> float | None:
    """Mean over clusters with rows of the worst (scatter + scatter) / distance."""
    held = np.flatnonzero(fit.sizes > 0)
    if len(held) < 2:
        return None
    mean, spread = fit.sums[held] / fit.sizes[held, None], scatter[held]
    apart = np.sqrt(((mean[:, None] - mean[None]) ** 2).sum(2))
    np.fill_diagonal(apart, np.inf)
    return float(((spread[:, None] + spread[None]) / apart).max(1).mean())


def rand_index(table: np.ndarray) -> float:
    """Adjusted Rand index of a contingency table."""

    def pairs(n: np.ndarray) -> float:
        return float((n * (n - 1) / 2).sum())

    inner, rows, columns, everything = pairs(table), pairs(table.sum(1)), pairs(table.sum(0)), pairs(np.array([table.sum()]))
    expected, best = rows * columns / everything if everything else 0.0, (rows + columns) / 2
    return 1.0 if best == expected else (inner - expected) / (best - expected)
