"""Byte-level BPE encoding and decoding over overlapping chunks.

A long text is cut into chunks that reach into the next one.  Chunks are pre-tokenised apart, on any executor; a chunk
starts in the middle of something, but from the first boundary that it shares with its predecessor on, both see the
same pre-tokens, because a match depends only on what follows its start.  Those shared boundaries are the stitches:
each chunk then encodes its pieces from its own stitch to the next one's.  A text with a chunk that shares no boundary
within the overlap (one pre-token that long) is put together again and pre-tokenised as one chunk.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanloom.llm.common import cut, slices

#: Code points between the starts of two chunks, and how far a chunk reaches into the next one.
STRIDE, OVERLAP = 16_384, 1_024
#: A match that ends this close to the end of a chunk might be another one with more text.
MARGIN = 8
#: Pre-tokens that a worker remembers, and bytes of a piece from which on its pairs are queued.
MEMO = 1_000_000
SHORT = 48

PIECES_DDL = "row bigint, part int, last boolean, doc_id bigint, ids binary"


class ByteBPE:
    """Ranks of byte sequences, encoder and decoder."""

    def __init__(self, ranks: bytes, pattern: str):
        pairs = (line.split() for line in ranks.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.raw = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.raw[rank] = token
        #: Ids are kept in 16 bits where every rank fits.
        self.kind = "H" if len(self.raw) <= 1 << 16 else "I"
        self.names = [str(rank) for rank in range(len(self.raw))]
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the lowest rank is joined first, the leftmost among equals."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self._merge_short(piece) if len(piece) <= SHORT else self._merge_long(piece)

    def _merge_short(self, piece: bytes) -> list[int]:
        """A scan over all pairs a step, which costs least for a few bytes."""
        rank, none = self.ranks.get, len(self.raw)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank(left + right, none) for left, right in zip(parts, parts[1:], strict=False)]
        while pairs:
            low = min(pairs)
            if low == none:
                break
            at = pairs.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], none)
        return [self.ranks[part] for part in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """A queue of pairs, so that time grows little faster than the piece."""
        ranks, size = self.ranks, len(piece)
        # a part is known by its start; ``end`` of a start that is no part any more is 0
        end = list(range(1, size + 1)) + [0]
        before = list(range(-1, size))
        queue = [(ranks[pair], i, i + 2) for i in range(size - 1) if (pair := piece[i : i + 2]) in ranks]
        heapq.heapify(queue)
        while queue:
            _, left, until = heapq.heappop(queue)
            right = end[left]
            if not right or right == size or end[right] != until:
                continue
            end[left], end[right] = until, 0
            if until < size:
                before[until] = left
                joined = ranks.get(piece[left : end[until]])
                if joined is not None:
                    heapq.heappush(queue, (joined, left, end[until]))
            if left:
                start = before[left]
                joined = ranks.get(piece[start:until])
                if joined is not None:
                    heapq.heappush(queue, (joined, start, until))
        out, at = [], 0
        while at < size:
            out.append(ranks[piece[at : end[at]]])
            at = end[at]
        return out

    def packed(self, piece: str) -> bytes:
        """Ids of a pre-token as numbers of ``kind``."""
        found = array(self.kind, self.merge(piece.encode())).tobytes()
        if len(piece) <= 64:
            if len(self.known) >= MEMO:
                self.known.clear()
            self.known[piece] = found
        return found

    def joined(self, pieces: Iterable[str]) -> bytes:
        """Ids of pre-tokens after each other."""
        known, fresh = self.known.get, self.packed
        return b"".join([known(piece) or fresh(piece) for piece in pieces])

    def encode(self, text: str) -> bytes:
        return self.joined(self.pattern.findall(text))

    def pre_tokens(self, text: str, start: int = 0) -> tuple[list[str], list[int]]:
        """Pre-tokens of ``text`` from a place on, and where each of them ends."""
        found = self.pattern.findall(text, start)
        ends = list(accumulate(map(len, found), initial=start))[1:]
        if (ends[-1] if ends else start) != len(text):  # the pattern leaves something out
            matches = list(self.pattern.finditer(text, start))
            return [m.group() for m in matches], [m.end() for m in matches]
        return found, ends

    def encode_between(self, text: str, start: int, end: int) -> bytes:
        """Ids of the pre-tokens from one boundary of ``text`` to another."""
        found, ends = self.pre_tokens(text, start)
        return self.joined(found[: bisect_right(ends, end)])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def vocabulary(ranks: bytes, pattern: str) -> ByteBPE:
    """One vocabulary a worker."""
    return ByteBPE(ranks, pattern)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([] for _ in names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _short_pieces(ranks: bytes, pattern: str):
    """Texts of one chunk; the row number is not needed, as no row meets another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        words = vocabulary(ranks, pattern)
        for part in slices(batches):
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                yield 0, 0, True, doc_id, words.encode(text or "")

    return run


def _chunks(stride: int, overlap: int):
    """Texts as rows ``row, part, last, doc_id, text``; the text of a chunk reaches into the next one."""
    names = ["row", "part", "last", "doc_id", "text"]
    types = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            for row, doc_id, text in zip(*(batch[c].to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                starts = range(0, len(text), stride)
                for first in range(0, len(starts), 64):
                    yield _batch(
                        [(row, at // stride, at + stride >= len(text), doc_id, text[at : at + stride + overlap])
                         for at in starts[first : first + 64]], names, types,
                    )

    return run


def _edges(ranks: bytes, pattern: str, stride: int, overlap: int):
    """Boundaries of a chunk near its start and where the next chunk starts, as places in the chunk and in the next."""
    names, types = ["row", "part", "heads", "tails"], [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(ranks, pattern)
        for batch in slices(batches, 64):
            out = []
            for row, part, text in zip(*(batch[c].to_pylist() for c in ("row", "part", "text")), strict=True):
                reach = overlap - MARGIN
                ends = [0, *words.pre_tokens(text)[1]]
                heads = ends[: bisect_left(ends, reach)]
                tails = [at - stride for at in ends[bisect_left(ends, stride) : bisect_left(ends, stride + reach)]]
                out.append((row, part, heads, tails))
            yield _batch(out, names, types)

    return run


def _between(ranks: bytes, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(ranks, pattern)
        for batch in slices(batches, 64):
            columns = [batch[c].to_pylist() for c in ("row", "part", "last", "doc_id", "text", "start", "until")]
            yield _batch(
                [(row, part, last, doc_id, words.encode_between(text, start, until))
                 for row, part, last, doc_id, text, start, until in zip(*columns, strict=True)],
                ["row", "part", "last", "doc_id", "ids"], [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()],
            )

    return run


def long_pieces(docs: DataFrame, ranks: bytes, pattern: str, stride: int = STRIDE, overlap: int = OVERLAP) -> DataFrame:
    """Ids of each chunk of texts (doc_id, text) as ``row, part, last, doc_id, ids``; ``row`` tells texts apart."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    chunk_ddl = "row bigint, part int, last boolean, doc_id bigint, text string"
    dealt = numbered.mapInArrow(_chunks(stride, overlap), chunk_ddl).repartition(parts, "row", "part")
    chunks = cut(dealt)  # also fixes the row numbers
    edges = chunks.select("row", "part", "text").mapInArrow(
        _edges(ranks, pattern, stride, overlap), "row bigint, part int, heads array<int>, tails array<int>"
    )
    # one thin row a chunk; a window holds those of one text
    along = W.partitionBy("row").orderBy("part")
    shared = F.array_min(F.array_intersect(F.lag("tails").over(along), "heads"))
    stitched = edges.withColumn("start", F.when(F.col("part") == 0, 0).otherwise(shared))
    plan = stitched.select(
        "row", "part", "start",
        F.coalesce(F.lead("start").over(along) + stride, F.lit(2**31 - 1)).alias("until"),
        F.max(F.col("start").isNull()).over(W.partitionBy("row")).alias("apart"),
    )
    known = chunks.join(plan, ["row", "part"])
    whole = known.where("apart").groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", F.substring("text", 1, stride).alias("text")))),
                                 lambda c: c["text"]), "").alias("text"),
    )
    columns = ["row", "part", "last", "doc_id", "text", "start", "until"]
    as_one = whole.select(
        "row", F.lit(0).alias("part"), F.lit(True).alias("last"), "doc_id", "text", F.lit(0).alias("start"),
        F.lit(2**31 - 1).alias("until"),
    )
    return known.where("not apart").select(*columns).unionByName(as_one).mapInArrow(_between(ranks, pattern), PIECES_DDL)


def _typed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _is_long(stride: int):
    return F.coalesce(F.length("text") > stride, F.lit(False))


def encoded(docs: DataFrame, ranks: bytes, pattern: str, stride: int = STRIDE, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, ids`` (array<int>) for every row of ``docs``; null and empty texts have no ids."""
    rows, short = _typed(docs), _short_pieces(ranks, pattern)

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = vocabulary(ranks, pattern).kind
        for _, _, _, doc_id, ids in short(batches):
            yield _batch([(doc_id, np.frombuffer(ids, kind).astype(np.int32))], ["doc_id", "ids"], [pa.int64(), pa.list_(pa.int32())])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        kind = vocabulary(ranks, pattern).kind
        for batch in slices(batches, 64):
            for last, doc_id, ids in zip(*(batch[c].to_pylist() for c in ("last", "doc_id", "ids")), strict=True):
                held.append(ids)
                if last:
                    whole = np.frombuffer(b"".join(held), kind).astype(np.int32)
                    yield _batch([(doc_id, whole)], ["doc_id", "ids"], [pa.int64(), pa.list_(pa.int32())])
                    held = []

    ddl = "doc_id bigint, ids array<int>"
    parts = _in_order(long_pieces(rows.where(_is_long(stride)), ranks, pattern, stride, overlap))
    return rows.where(~_is_long(stride)).mapInArrow(at_once, ddl).unionByName(parts.mapInArrow(joined, ddl))


def _in_order(pieces: DataFrame) -> DataFrame:
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(parts, "row").sortWithinPartitions("row", "part")


def _digests(words: ByteBPE, pieces: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Digests of texts whose pieces follow each other; a piece is forgotten once it is read."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    out: list[tuple] = []
    count, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
    for _, _, last, doc_id, packed in pieces:
        ids = np.frombuffer(packed, words.kind)
        if len(ids):
            if count:
                of_ids.update(b",")
            of_ids.update(",".join(map(words.names.__getitem__, ids.tolist())).encode())
            of_bytes.update(words.decode(ids))
            count += len(ids)
        if last:
            out.append((doc_id, count, of_ids.hexdigest(), of_bytes.hexdigest()))
            count, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
            if len(out) == 1024:
                yield _batch(out, names, types)
                out = []
    if out:
        yield _batch(out, names, types)


def encode_report(docs: DataFrame, ranks: bytes, pattern: str, stride: int = STRIDE, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row of ``docs`` (doc_id, text).

    Null and empty texts have no ids and the digests of nothing.  Null ids, repeated rows and repeated ids keep one
    result each, other columns are ignored, an empty table gives no rows.  A very long text is chunked over many
    tasks; its ids meet again in the order of its chunks, one chunk at a time.
    """
    rows, short = _typed(docs), _short_pieces(ranks, pattern)

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _digests(vocabulary(ranks, pattern), short(batches))

    def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("row", "part", "last", "doc_id", "ids")
        pieces = (row for b in slices(batches, 64) for row in zip(*(b[c].to_pylist() for c in columns), strict=True))
        yield from _digests(vocabulary(ranks, pattern), pieces)

    ddl = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    parts = _in_order(long_pieces(rows.where(_is_long(stride)), ranks, pattern, stride, overlap))
    return rows.where(~_is_long(stride)).mapInArrow(at_once, ddl).unionByName(parts.mapInArrow(in_parts, ddl))
