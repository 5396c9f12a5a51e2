"""Quality classifier: supervised subword embeddings.

A document is the mean of the learned vectors of its features - hashed words, character n-grams of ``<word>`` and
word pairs - and a softmax layer turns that mean into a score.  Vectors and layer are trained by minibatch
stochastic gradient descent in numpy on at most ``train_rows`` labelled documents outside the held-out third, taken
in the order of an id hash.  For scoring, each bucket's vector is multiplied with the layer once, so that a word is
worth two numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import slices
from loanloom.llm.quality_rules import held_out

BUCKETS, DIM = 1 << 17, 8
GRAMS = (3, 4)
TRAIN_ROWS, BATCH, RATE = 4_000, 32, 20.0
#: Passes over the sample: as many as make this number of steps, two at least.
STEPS, PASSES = 500, 2
#: No weight moves further in one step, so that features of every document cannot run away.
MOST = 0.2


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of ``words``, and their features as (index of the word, bucket): itself and the n-grams of ``<word>``."""
    hashes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    marked = np.frombuffer(b"".join([b"<" + w + b">" for w in words]), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(marked))
    owners, buckets = [np.arange(len(words))], [_bucket(hashes * np.uint64(0xC2B2AE3D27D4EB4F))]
    for n in GRAMS:
        rolled = np.full(max(0, len(marked) - n + 1), np.uint64(n))
        for k in range(n):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + marked[k : k + len(rolled)] + np.uint64(1)
        inside = left[: len(rolled)] >= n
        owners.append(owner[: len(rolled)][inside])
        buckets.append(_bucket(rolled[inside] * np.uint64(0xD6E8FEB86659FD93)))
    return hashes, np.concatenate(owners), np.concatenate(buckets)


def _bucket(mixed: np.ndarray) -> np.ndarray:
    return ((mixed >> np.uint64(29)) % np.uint64(BUCKETS)).astype(np.int64)


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words from their hashes; a word after itself has one bucket whatever the word."""
    mixed = _bucket((hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)))
    return np.where(hashes[:-1] == hashes[1:], 0, mixed)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


@dataclass
class Model:
    """Scores in [0, 1] from per-bucket margins; ``bias`` alone for texts without words."""

    margins: np.ndarray
    bias: float

    def score(self, total: np.ndarray, count: np.ndarray) -> np.ndarray:
        margin = total / np.maximum(count, 1) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30)))


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a document and how often each occurs."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    distinct: dict[bytes, int] = {}
    codes = np.fromiter((distinct.setdefault(w, len(distinct)) for w in words), np.int64, len(words))
    often = np.bincount(codes)
    hashes, owner, flat = word_features(list(distinct))
    weight, pairs = often[owner], pair_buckets(hashes[codes])
    buckets, inverse = np.unique(np.concatenate([flat, pairs]), return_inverse=True)
    return buckets, np.bincount(inverse, np.concatenate([weight, np.ones(len(pairs))]))


def fit(texts: list[str | None], labels: np.ndarray, seed: int = 5) -> Model:
    """Train on labels 0/1.  Without both labels the model is a constant: the only label's share, or 0.5."""
    share = (labels.sum() + 1.0) / (len(labels) + 2.0)
    prior = float(np.log(share / (1 - share)))
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS, np.float32), prior)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1.0 / DIM, 1.0 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.array([0.0, prior], np.float32)
    found = [document_features(t) for t in texts]
    in_pass = -(-len(texts) // BATCH)
    passes = max(PASSES, -(-STEPS // in_pass))
    steps, step = passes * in_pass, 0
    for _ in range(passes):
        order = rng.permutation(len(texts))
        for start in range(0, len(order), BATCH):
            rows = [k for k in order[start : start + BATCH] if len(found[k][0])]
            step += 1
            if not rows:
                continue
            sizes = [len(found[k][0]) for k in rows]
            buckets = np.concatenate([found[k][0] for k in rows])
            weight = np.concatenate([found[k][1] / found[k][1].sum() for k in rows]).astype(np.float32)
            edges = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mean = np.add.reduceat(vectors[buckets] * weight[:, None], edges, axis=0)
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), labels[rows].astype(int)] -= 1.0
            rate = RATE * (1.0 - step / (steps + 1))
            toward = p @ layer.T
            layer -= np.clip(rate * (mean.T @ p) / len(rows), -MOST, MOST)
            bias -= np.clip(rate * p.mean(axis=0), -MOST, MOST)
            pull = np.repeat(toward, sizes, axis=0) * weight[:, None]
            for d in range(DIM):
                # every document moves its own features, as one example at a time would
                vectors[:, d] -= np.clip(rate * np.bincount(buckets, pull[:, d], BUCKETS), -MOST, MOST).astype(np.float32)
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    """Scores of a slice of texts; each distinct word of the slice is worked out once."""
    split = [words_of(t) for t in texts]
    sizes = [len(words) for words in split]
    distinct: dict[bytes, int] = {}
    codes = np.fromiter((distinct.setdefault(w, len(distinct)) for words in split for w in words), np.int64, sum(sizes))
    if not len(codes):
        return model.score(np.zeros(len(texts)), np.zeros(len(texts)))
    hashes, owner, buckets = word_features(list(distinct))
    sums = np.bincount(owner, model.margins[buckets], len(distinct))
    features = np.bincount(owner, minlength=len(distinct))
    doc = np.repeat(np.arange(len(texts)), sizes)
    inside = doc[:-1] == doc[1:]
    pairs, of = pair_buckets(hashes[codes])[inside], doc[:-1][inside]
    total = np.bincount(doc, sums[codes], len(texts)) + np.bincount(of, model.margins[pairs], len(texts))
    count = np.bincount(doc, features[codes], len(texts)) + np.bincount(of, minlength=len(texts))
    return model.score(total, count)


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int) -> tuple[list, np.ndarray]:
    """Texts and labels of the sample: ``train_rows`` labels at most, so the ids are small enough to send to every task."""
    known = labels.where(F.col("quality").isin(0, 1)).where(F.col("doc_id").isNotNull() & ~held_out())
    chosen = known.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "_y").limit(train_rows)
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = plain.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).orderBy("_id", "text", "_y").limit(train_rows)
    rows = sample.select("text", "_y").collect()
    return [r["text"] for r in rows], np.array([r["_y"] for r in rows], float)


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (doc_id, text).

    Only labels of ids outside the held-out third train; language, source and id are no inputs.  Null, empty and blank
    texts get the score of the bias; a null id is not held out.  Repeated rows get equal scores, an empty table none.
    Without labels of both kinds all scores are one constant.
    """
    model = fit(*training_rows(docs, labels, train_rows))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(scores(model, part["text"].to_pylist()))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
