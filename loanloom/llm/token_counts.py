"""Token counts by pre-token frequency.

Texts are cut into pre-tokens that the tokenizer treats on their own.  Slices of documents give, per distinct
pre-token, the documents it occurs in and how often; those rows are dealt out by pre-token, each pre-token is counted
once with the tokenizer library, counts are multiplied by frequencies and the sums go back to the documents.  No ids
are kept.  A pre-token that occurs in more than an eighth of a slice's documents is spread over ``SPREAD`` buckets by
slice, so that frequent words load no task more than others.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import slices
from loanloom.llm.pieces import BLANK, SEGMENT

LIMIT = 4096
SLICE_ROWS, SLICE_CHARS = 4096, 8_000_000
SPREAD = 64

FREQUENCIES = pa.schema(
    [
        ("bucket", pa.int32()),
        ("slice", pa.int64()),
        ("tokens", pa.binary()),
        ("entries", pa.binary()),
        ("doc_ids", pa.list_(pa.int64())),
        ("n_bytes", pa.list_(pa.int64())),
    ]
)
FREQUENCY_DDL = "bucket int, slice bigint, tokens binary, entries binary, doc_ids array<bigint>, n_bytes array<bigint>"


class Vocabulary:
    """The library's view of a model: how texts fall apart, and how many pieces a part has."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.library.get_piece_size()
        self.splits = not any(BLANK in self.library.id_to_piece(i).lstrip(BLANK) for i in range(size))

    def split(self, text: str) -> list[str]:
        """Pre-tokens, each without the blank that it starts with."""
        if not text:
            return []
        text = text.replace(BLANK, " ")
        if not self.splits:
            return [text]
        if "  " not in text and text[0] != " ":
            return text.split(" ")
        return [part[1:].replace(BLANK, " ") for part in SEGMENT.findall(BLANK + text.replace(" ", BLANK))]

    def counts(self, pre_tokens: list[str]) -> list[int]:
        # the library puts a blank before a text unless it is empty
        found = self.library.encode(pre_tokens, num_threads=1)
        return [len(ids) if pre_token else 1 for ids, pre_token in zip(found, pre_tokens, strict=True)]


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


class _Numbers(dict):
    def __missing__(self, key: str) -> int:
        value = self[key] = len(self)
        return value


def _slice_rows(ids: list, texts: list[str], number: int, buckets: int, words: Vocabulary) -> pa.RecordBatch:
    """The frequency rows of one slice: a row for each bucket, and its documents' ids and lengths with the first."""
    names, token, often, width = _Numbers(), array("i"), array("i"), []
    for text in texts:
        counted = Counter(words.split(text))
        token.extend(map(names.__getitem__, counted))
        often.extend(counted.values())
        width.append(len(counted))
    tokens = np.frombuffer(token, np.int32)
    spread = np.bincount(tokens, minlength=len(names))
    home = np.fromiter((xxhash.xxh3_64_intdigest(name) & 0x7FFFFFFF for name in names), np.int64, len(names))
    home = (home + np.where(spread * 8 > len(texts), number % SPREAD, 0)) % buckets
    by_token = np.lexsort((tokens, home[tokens])) if len(tokens) else tokens
    place = np.repeat(np.arange(len(texts), dtype=np.uint16), width)[by_token]
    often_sorted = np.frombuffer(often, np.int32)[by_token]
    ordered = np.lexsort((np.arange(len(names)), home))
    texts_of, squeeze = list(names), zstandard.ZstdCompressor(level=3)
    rows: list[list] = [[] for _ in FREQUENCIES]
    token_edges = np.searchsorted(home[ordered], np.arange(buckets + 1))
    entry_edges = np.concatenate([[0], np.cumsum(spread[ordered])])
    for bucket in np.flatnonzero(np.diff(token_edges)):
        own = ordered[token_edges[bucket] : token_edges[bucket + 1]]
        part = slice(entry_edges[token_edges[bucket]], entry_edges[token_edges[bucket + 1]])
        # pre-tokens hold no NUL that is not theirs: lengths, not separators, tell them apart
        raw = [texts_of[i].encode() for i in own]
        lengths = np.array([len(r) for r in raw], np.uint32)
        blob = squeeze.compress(np.uint32(len(raw)).tobytes() + lengths.tobytes() + b"".join(raw))
        entries = squeeze.compress(
            spread[own].astype(np.uint32).tobytes() + place[part].tobytes() + often_sorted[part].astype(np.uint32).tobytes()
        )
        for column, value in zip(rows, (int(bucket), number, blob, entries, None, None), strict=True):
            column.append(value)
    lengths = [len(text.encode()) for text in texts]
    for column, value in zip(rows, (number % buckets, number, None, None, ids, lengths), strict=True):
        column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, FREQUENCIES, strict=True)], schema=FREQUENCIES)


def frequencies(docs: DataFrame, model: bytes, buckets: int) -> DataFrame:
    """Per-document pre-token frequencies, packed by slice and bucket; each slice is numbered by its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, number = vocabulary(model), TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[str] = []
        chars = 0
        for part in slices(batches):
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text or "")
                chars += len(texts[-1])
                if len(texts) == SLICE_ROWS or chars >= SLICE_CHARS:
                    yield _slice_rows(ids, texts, number, buckets, words)
                    ids, texts, chars, number = [], [], 0, number + 1
        if texts:
            yield _slice_rows(ids, texts, number, buckets, words)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, FREQUENCY_DDL)


def _sums(model: bytes):
    """Rows of one bucket follow each other; its pre-tokens are counted once and forgotten after it.

    Each row gives what its pre-tokens add to the documents of its slice, one number a document.
    """
    schema = pa.schema([("slice", pa.int64()), ("sums", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, open_, squeeze, at = vocabulary(model), zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3), None
        known: dict[str, int] = {}
        for batch in slices(batches, 64):
            out: list[list] = [[] for _ in schema]
            for row in batch.to_pylist():
                if row["tokens"] is None:
                    values = (row["slice"], None, row["doc_ids"], row["n_bytes"])
                else:
                    if row["bucket"] != at:
                        known, at = {}, row["bucket"]
                    blob = open_.decompress(row["tokens"])
                    n = int(np.frombuffer(blob, np.uint32, 1)[0])
                    ends = np.cumsum(np.frombuffer(blob, np.uint32, n, 4)) + 4 + 4 * n
                    starts = [4 + 4 * n, *ends[:-1].tolist()]
                    tokens = [blob[a:b].decode() for a, b in zip(starts, ends.tolist(), strict=True)]
                    fresh = [t for t in tokens if t not in known]
                    known.update(zip(fresh, words.counts(fresh), strict=True))
                    packed = open_.decompress(row["entries"])
                    spread = np.frombuffer(packed, np.uint32, n)
                    m = int(spread.sum())
                    place = np.frombuffer(packed, np.uint16, m, 4 * n)
                    often = np.frombuffer(packed[4 * n + 2 * m :], np.uint32)
                    each = np.repeat(np.fromiter(map(known.__getitem__, tokens), np.int64, n), spread) * often
                    values = (row["slice"], squeeze.compress(np.bincount(place, each).astype(np.uint64).tobytes()), None, None)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one slice follow each other: its sums are added up and given to its documents."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
    open_, at, total, documents = zstandard.ZstdDecompressor(), None, np.zeros(SLICE_ROWS, np.int64), ([], [])

    def done() -> pa.RecordBatch:
        columns = [pa.array(documents[0], pa.int64()), pa.array(documents[1], pa.int64()), pa.array(total[: len(documents[0])])]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for batch in slices(batches, 64):
        for row in batch.to_pylist():
            if row["slice"] != at:
                if at is not None:
                    yield done()
                at, total, documents = row["slice"], np.zeros(SLICE_ROWS, np.int64), ([], [])
            if row["sums"] is None:
                documents = (row["doc_ids"], row["n_bytes"])
            else:
                part = np.frombuffer(open_.decompress(row["sums"]), np.uint64)
                total[: len(part)] += part.astype(np.int64)
    if at is not None:
        yield done()


def token_counts(docs: DataFrame, model: bytes, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs`` (doc_id, text).

    Null and empty texts have no bytes and no tokens.  Rows are told apart by their place in a slice, so null and
    repeated ids keep one result each; other columns are ignored and an empty table gives no rows.
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = frequencies(docs, model, buckets).repartition(buckets, "bucket").sortWithinPartitions("bucket", "slice")
    sums = packed.mapInArrow(_sums(model), "slice bigint, sums binary, doc_ids array<bigint>, n_bytes array<bigint>")
    by_slice = sums.repartition(buckets, "slice").sortWithinPartitions("slice")
    totals = by_slice.mapInArrow(_totals, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return totals.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
