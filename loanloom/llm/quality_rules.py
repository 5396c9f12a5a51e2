"""Quality rules: gradient-boosted trees over document statistics.

Every document gives a handful of counts in one pass.  Labelled documents outside the held-out third, at most
``train_rows`` of them in the order of an id hash, train boosted trees on shares of those counts (numpy histograms,
logistic loss); shares of symbols, repeated lines, repeated words, capitals and exclamation marks may only lower a
score.  Trees are flattened into node arrays, which score whole batches at once.  Fixed rules for very short and
very repetitive texts come first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom.llm.common import cut, slices

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_distinct")
FEATURES = ("words", "mean_length", "symbols", "dup_lines", "repeats", "upper", "marks", "distinct")
#: -1: a higher value never raises the score.
MONOTONE = (0, 0, -1, -1, -1, -1, -1, 0)
TRAIN_ROWS = 20_000
BINS = 64


def counts_of(text: str | None) -> tuple[int, ...]:
    """The ``COUNTS`` of one text; words are runs outside ASCII white space."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [line for line in raw.split(b"\n") if line and line.split(None, 1)] if b"\n" in raw else [raw] * (n > 0)
    codes: dict[bytes, int] = {}
    numbers = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
    repeated = 0
    if n > 2:
        size = len(codes)
        pair = np.unique(numbers[:-1] * size + numbers[1:], return_inverse=True)[1]
        _, which, often = np.unique(pair[:-1] * size + numbers[2:], return_inverse=True, return_counts=True)
        twice = np.concatenate([[0], np.cumsum(often[which] > 1), [0, 0]])
        twice[-2:] = twice[-3]
        at = np.arange(n)
        repeated = int((twice[np.minimum(at + 1, n - 2)] > twice[np.maximum(at - 2, 0)]).sum())
    chars = np.frombuffer(raw, np.uint8)
    upper = int(((chars >= 65) & (chars <= 90)).sum())
    letters = upper + int(((chars >= 97) & (chars <= 122)).sum())
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), upper, letters, text.count("!"), len(codes)


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the ``COUNTS`` of every row."""
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = np.array([counts_of(text) for text in part["text"].to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([part["doc_id"], *[pa.array(c) for c in rows.T]], schema=schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{f.name} bigint" for f in schema))


def features(counts: np.ndarray) -> np.ndarray:
    n, chars, symbols, dup, repeat, lines, upper, letters, marks, distinct = (counts[:, k].astype(float) for k in range(len(COUNTS)))
    words = np.maximum(n, 1)
    return np.stack(
        [np.log1p(n), chars / words, symbols / words, dup / np.maximum(lines, 1), repeat / words, upper / np.maximum(letters, 1), marks / words, distinct / words],
        axis=1,
    )


@dataclass
class Trees:
    """Flattened trees: node k sends a row to ``left[k]`` when its feature is at most the threshold; leaves point at themselves."""

    base: float = 0.0
    roots: list[int] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    depth: int = 0

    def leaf(self, value: float) -> int:
        k = len(self.value)
        for column, x in ((self.feature, 0), (self.threshold, np.inf), (self.left, k), (self.right, k), (self.value, value)):
            column.append(x)
        return k

    def margin(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, left, right, value = map(np.array, (self.feature, self.threshold, self.left, self.right, self.value))
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
            total += value[at]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(
    x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...] = MONOTONE, trees: int = 60, depth: int = 4, rate: float = 0.2,
    penalty: float = 1.0, least_rows: int = 10,
) -> Trees:
    """Boosted trees for labels 0/1; with one class or no rows, the constant score of that class or 0.5."""
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    model = Trees(base=float(np.log(share / (1 - share))), depth=depth)
    if len(y) == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T, strict=True)], axis=1)
    margin = np.full(len(y), model.base)

    def grow(rows: np.ndarray, slope: np.ndarray, curve: np.ndarray, low: float, high: float, levels: int) -> int:
        g, h = slope[rows].sum(), curve[rows].sum()
        value = float(np.clip(-g / (h + penalty), low, high))
        node = model.leaf(value * rate)
        best = (1e-6, -1, -1, 0.0, 0.0)
        if levels and len(rows) >= 2 * least_rows:
            for k, e in enumerate(edges):
                if not len(e):
                    continue
                which = binned[rows, k]
                gl = np.cumsum(np.bincount(which, slope[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(which, curve[rows], len(e) + 1))[:-1]
                nl = np.cumsum(np.bincount(which, minlength=len(e) + 1))[:-1]
                vl = np.clip(-gl / (hl + penalty), low, high)
                vr = np.clip(-(g - gl) / (h - hl + penalty), low, high)
                gain = -(gl * vl + 0.5 * (hl + penalty) * vl**2) - ((g - gl) * vr + 0.5 * (h - hl + penalty) * vr**2)
                gain += g * value + 0.5 * (h + penalty) * value**2
                allowed = (nl >= least_rows) & (len(rows) - nl >= least_rows) & (monotone[k] * (vr - vl) >= 0)
                gain = np.where(allowed, gain, -np.inf)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (float(gain[at]), k, at, float(vl[at]), float(vr[at]))
        _, k, at, vl, vr = best
        if k >= 0:
            middle = (vl + vr) / 2
            bounds = {0: ((low, high), (low, high)), -1: ((middle, high), (low, middle)), 1: ((low, middle), (middle, high))}[monotone[k]]
            goes_left = binned[rows, k] <= at
            model.feature[node], model.threshold[node] = k, float(edges[k][at])
            model.left[node] = grow(rows[goes_left], slope, curve, *bounds[0], levels - 1)
            model.right[node] = grow(rows[~goes_left], slope, curve, *bounds[1], levels - 1)
        else:
            leaf_of[rows] = value * rate
        return node

    everyone = np.arange(len(y))
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        leaf_of = np.zeros(len(y))
        model.roots.append(grow(everyone, p - y, p * (1 - p), -np.inf, np.inf, depth))
        margin += leaf_of
    return model


def held_out(doc_id: str = "doc_id"):
    """The third of the ids that no training sees."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(stats: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Trees:
    """Trees for ``labels.quality`` from at most ``train_rows`` labelled rows that are not held out."""
    known = labels.where(F.col("quality").isin(0, 1)).where(~held_out()).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y"))
    joined = stats.join(known, F.col("doc_id") == F.col("_id"))
    joined = joined.withColumn("_h", F.xxhash64("_id"))
    # the rows of the lowest hashes lie below a bound that half as many again do, so that tasks send few others
    bound = int((1 << 64) * min(1.0, 1.5 * train_rows / max(joined.count(), 1))) - (1 << 63)
    low = joined.where(F.col("_h") < bound) if bound < (1 << 63) else joined
    if low.count() < train_rows:
        low = joined
    sample = low.orderBy("_h", "_id", *COUNTS, "_y").limit(train_rows).select(*COUNTS, "_y").collect()
    rows = np.array([tuple(r) for r in sample], np.int64).reshape(-1, len(COUNTS) + 1)
    return fit_trees(features(rows[:, :-1]), rows[:, -1].astype(float))


def judge(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, least_score: float = 0.5) -> DataFrame:
    """``doc_id``, the contract's counts, ``base_failed, kept, score`` for every row of ``docs`` (doc_id, text).

    Null and empty texts have no words and fail the fixed rules.  Null ids are judged but never train; repeated ids
    train once for each row; without labels of both kinds, only the fixed rules reject.  An empty table gives no rows.
    """
    stats = cut(statistics(docs))
    trees = train(stats, labels, train_rows)

    @F.pandas_udf(T.DoubleType())
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(trees.score(features(np.stack([c.to_numpy() for c in columns], axis=1))))

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = stats.withColumn("score", score(*COUNTS)).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & ((F.col("score") >= least_score) if trees.roots else F.lit(True))
    return scored.select("doc_id", *COUNTS[:5], "base_failed", kept.alias("kept"), "score")


def filtered(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Rows of ``docs`` that the rules keep, in the same columns.  Rows are judged one by one, not by id."""
    stats = cut(statistics(docs))
    trees = train(stats, labels, train_rows)

    @F.pandas_udf(T.BooleanType())
    def keeps(texts: pd.Series) -> pd.Series:
        counts = np.array([counts_of(t) for t in texts], np.int64).reshape(-1, len(COUNTS))
        passed = (counts[:, 0] >= 50) & (100 * counts[:, 4] <= 50 * counts[:, 0])
        return pd.Series(passed & (trees.score(features(counts)) >= 0.5) if trees.roots else passed)

    return docs.where(keeps(F.col("text").cast("string")))
