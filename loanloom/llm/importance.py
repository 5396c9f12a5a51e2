"""Importance resampling towards a target text: hashed n-gram counts of all documents against all target texts.

A document's weight is the sum of its features' gains, the logarithms of how much more often a bucket occurs in the
target than in the corpus; a fixed draw of a Gumbel number for each document turns the highest scores into a sample
drawn in proportion to the weights.  Buckets are the checksums of features, taken with the position table of
``position_crc`` over whole Arrow buffers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import cut, numbered
from loanloom.llm.position_crc import crc32_spans

BUCKETS = 10_000
LONGEST = 1
#: Gains are kept as whole thousandths.
SCALE = 1000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Bytes of text that are looked at together; a longer text is looked at on its own.
TOGETHER = 4 << 20

_CODES = np.arange(256, dtype=np.uint8)
LOWER = np.where((_CODES >= 0x41) & (_CODES <= 0x5A), _CODES + 32, _CODES).astype(np.uint8)
IN_WORD = ((LOWER >= 0x30) & (LOWER <= 0x39)) | ((LOWER >= 0x61) & (LOWER <= 0x7A)) | (LOWER >= 0x80)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of batches with at most ``TOGETHER`` bytes of text, or one row."""
    for batch in batches:
        lengths = pc.binary_length(batch["text"]).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for row, length in enumerate(lengths.tolist()):
            if row > start and held + length > TOGETHER:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += length
        if batch.num_rows > start:
            yield batch.slice(start)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, and each word's start, end and row."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, values = texts.buffers()
    edges = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, np.uint8)[: edges[-1]] if values is not None and values.size else np.zeros(0, np.uint8)
    data = LOWER[data[edges[0] :]]
    edges = edges - edges[0]
    inside = IN_WORD[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[edges[:-1][edges[:-1] < len(data)]] = False
    after[edges[1:][edges[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return data, starts, ends, np.searchsorted(edges, starts, "right") - 1


def features(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every run of 1 to ``longest`` words joined by one space, and the number of words a row."""
    data, starts, ends, rows = words(texts)
    found = [(rows, starts, ends)]
    if longest > 1 and len(starts):
        # the words again, one blank after each
        lengths = ends - starts + 1
        until = np.cumsum(lengths)
        places = np.arange(until[-1]) + np.repeat(starts - (until - lengths), lengths)
        joined = data[np.minimum(places, len(data) - 1)]
        joined[until - 1] = 0x20
        data, starts, ends = joined, until - lengths, until - 1
        found = [(rows, starts, ends)]
        for n in range(2, longest + 1):
            same = np.flatnonzero(rows[n - 1 :] == rows[: len(rows) - n + 1])
            found.append((rows[same], starts[same], ends[same + n - 1]))
    row, start, end = (np.concatenate(part) for part in zip(*found, strict=True))
    return row, crc32_spans(data, start, end) % np.uint32(buckets), np.bincount(rows, minlength=len(texts))


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: how often features of ``text`` fall into each bucket that has any; null texts have none.

    A task sends one row a bucket at most, however much text it reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for group in _groups(batches):
            total += np.bincount(features(group["text"], longest, buckets)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], names=["bucket", "n"])

    counted = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, gain`` for every bucket: the logarithm of its share of the target over its share of the corpus."""
    spark = docs.sparkSession
    corpus = bucket_counts(docs, longest, buckets).withColumnRenamed("n", "s")
    wanted = bucket_counts(target, longest, buckets).withColumnRenamed("n", "t")
    each = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = each.join(corpus, "bucket", "left").join(wanted, "bucket", "left").fillna(0, ["s", "t"])
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    # one row a bucket: a fixed number
    totals = counts.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    share = ((t + 1) * (F.col("all_s") + buckets)) / ((s + 1) * (F.col("all_t") + buckets))
    return counts.join(F.broadcast(totals)).select("bucket", F.floor(F.lit(float(SCALE)) * F.log(share)).alias("gain"))


def weights(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` for every row of ``docs`` (doc_id, text)."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            row, bucket, n_words = features(group["text"], longest, buckets)
            order = np.argsort(row, kind="stable")
            n_features = np.bincount(row, minlength=group.num_rows)
            sums = np.concatenate([[0], np.cumsum(gain[bucket[order]])])
            until = np.cumsum(n_features)
            weight = sums[until] - sums[until - n_features]
            yield pa.RecordBatch.from_arrays(
                [group["doc_id"], *(pa.array(c.astype(np.int64)) for c in (n_words, n_features, weight))],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A fixed draw for each id, in whole thousandths."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT,
    least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every row of ``docs`` (doc_id, text).

    Of the documents with at least ``least_words`` words, the ``percent`` with the highest scores are drawn and
    ranked from 1, ties in order of id; others have a null rank.  Null and empty texts have no features and weight 0.
    A null id draws for the empty name and comes first among equals; rows with one id share its draw and are ranked
    apart, in any order if they are equal.  An empty target gives each feature the gain of its rarity; an empty
    corpus gives no rows.  Other columns of either table are ignored.
    """
    rows = gains(docs, target, longest, buckets).orderBy("bucket").collect()  # one number a bucket
    weighed = weights(docs, np.array([r["gain"] for r in rows], np.int64), longest)
    scored = cut(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    able = scored.where(F.col("n_words") >= least_words)
    placed = numbered(able, [F.col("score").desc(), F.col("doc_id")])
    drawn = F.floor(F.col("rows") * percent / 100)
    rank = F.when(F.col("row") < drawn, F.col("row") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = placed.select(*columns, rank.alias("rank"))
    rest = scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return ranked.unionByName(rest)
