"""MinHash near-duplicate detection with exact confirmation.

Documents with equal shingle sets form one class, represented by its smallest id.  Each class gets ``ROWS * BANDS``
minima of universal hashes (multiply-shift on 64 bits); equal bands make candidates.  A pair with similarity 0.8
shares no band with probability (1 - 0.8**4)**32 < 5e-8.  Candidates are first held against their signatures and
then confirmed on the full shingle sets.  No bucket is expanded into all its pairs:

1. the members of a bucket are tied by their signatures: a forest that reaches whatever a chain of likely pairs reaches.
   A bucket of more than ``COMMON`` members ties all of them to its smallest;
2. every document meets the smallest one it is tied to; components are taken;
3. ties make families; the members of a family that are still in different components meet in
   blocks of ``BLOCK`` documents ordered by component and set size.  Two blocks of one component, or of sizes too far
   apart, are skipped, and a pair of blocks gives one link for each two components it joins.

What shares a family and a component needs no comparison, so a large group of near copies costs one comparison a
member and its stragglers a few matrix products, while no link between different components is left out.  Documents
that share a bucket by chance, of which there are ever more the larger the table, are tied to nothing, and no set of
theirs is made.  What a step has stored is deleted when the last step that reads it has ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom.llm.common import cut, forget, numbered, shuffles_freed, slices
from loanloom.llm.components import components

ROWS, BANDS = 4, 32
#: Signatures that agree in fewer places rule a pair out; for similarity 0.8 that is 7 standard deviations off.
LEAST_AGREEMENT = 0.55
BLOCK = 128
#: Members of a bucket up to which all of them are held against each other by signature.
COMMON = 1024
_draws = np.random.default_rng(7)
MULTIPLIERS = _draws.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _draws.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)


class _WordHashes(dict):
    """64-bit hashes of words; forgets all of them when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, width: int, hashes: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; shorter texts have one, wordless ones none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    span = min(width, len(words))
    mixed = np.full(len(words) - span + 1, np.uint64(span * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    for k in range(span):
        mixed = (mixed ^ each[k : k + len(mixed)]) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def minima(shingles: np.ndarray) -> np.ndarray:
    """Smallest image of the set under each hash."""
    least = np.full(ROWS * BANDS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for start in range(0, len(shingles), 2048):
        images = shingles[start : start + 2048, None] * MULTIPLIERS + OFFSETS
        least = np.minimum(least, images.min(axis=0))
    return least


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """Bucket numbers of the bands of signatures (one a row)."""
    rows = signatures.astype(np.uint64).reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), rows.shape[:2])
    for k in range(ROWS):
        key = (key ^ rows[:, :, k]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


SIGNED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_shingles", pa.int64()),
        ("class_key", pa.binary()),
        ("signature", pa.binary()),
    ]
)


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for part in slices(batches):
            out: list[list] = [[], [], [], []]
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                shingles = shingle_set(text, width, hashes)
                row = [doc_id, len(shingles), None, None]
                if len(shingles):
                    least = minima(shingles)
                    row[2:] = [xxhash.xxh3_128_digest(shingles), (least >> np.uint64(32)).astype(np.uint32).tobytes()]
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, SIGNED, strict=True)], schema=SIGNED)

    return run


def signed(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, class_key, signature``; the last two are null for documents without words."""
    schema = "doc_id bigint, n_shingles bigint, class_key binary, signature binary"
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_signatures(width), schema)


def banded(classes: DataFrame) -> DataFrame:
    """``doc_id, bucket`` for each band of ``doc_id, signature``."""
    schema = pa.schema([("doc_id", pa.int64()), ("bucket", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            numbers = np.frombuffer(b"".join(part["signature"].to_pylist()), np.uint32).reshape(-1, ROWS * BANDS)
            ids = np.repeat(part["doc_id"].to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(band_keys(numbers).ravel())], schema=schema)

    return classes.select("doc_id", "signature").mapInArrow(run, "doc_id bigint, bucket bigint")


SKETCHED = pa.schema([("doc_id", pa.int64()), ("sketch", pa.binary())])
TIES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def sketched(signatures: DataFrame) -> DataFrame:
    """``doc_id, sketch``: the low byte of each place of a signature, by which unlike places agree once in 256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            low = [(np.frombuffer(s, np.uint32) & np.uint32(255)).astype(np.uint8).tobytes() for s in part["signature"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(low, pa.binary())], schema=SKETCHED)

    return signatures.select("doc_id", "signature").mapInArrow(run, "doc_id bigint, sketch binary")


def _forest(sketches: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of rows, each agreeing in enough places, that join what any such pairs join."""
    left = np.arange(len(sketches))
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            row = reached.pop()
            alike = (sketches[left] == sketches[row]).mean(axis=1) >= LEAST_AGREEMENT
            for other in left[alike]:
                yield row, other
            reached.extend(left[alike])
            left = left[~alike]


def _ties(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Ties ``u, v`` (u > v) of whole buckets."""
    buckets, ids = rows["bucket"].to_numpy(), rows["doc_id"].to_numpy()
    sketches = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(-1, ROWS * BANDS)
    starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
    sizes = np.diff(np.r_[starts, len(ids)])
    least = np.repeat(starts, sizes)
    alike = (sketches == sketches[least]).mean(axis=1) >= LEAST_AGREEMENT
    mixed = (np.add.reduceat(~alike, starts) > 0) & (sizes > 2)
    star = np.flatnonzero(alike & ~np.repeat(mixed, sizes) & (least != np.arange(len(ids))))
    one, other = [star], [least[star]]
    for start, size in zip(starts[mixed], sizes[mixed], strict=True):
        found = np.array([*_forest(sketches[start : start + size])], np.int64).reshape(-1, 2) + start
        one.append(found[:, 0])
        other.append(found[:, 1])
    one, other = ids[np.concatenate(one)], ids[np.concatenate(other)]
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(one, other)), pa.array(np.minimum(one, other))], schema=TIES)


def _tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties from rows ``bucket, doc_id, sketch`` in this order of the first two."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        buckets = rows["bucket"].to_numpy()
        whole = int(np.searchsorted(buckets, buckets[-1]))
        if whole:
            yield _ties(rows.slice(0, whole))
        held = rows.slice(whole)  # its bucket may go on
    if held is not None:
        yield _ties(held)


def ties(members: DataFrame, signatures: DataFrame) -> DataFrame:
    """``u, v`` (u > v) that join what shares a bucket of ``members`` (bucket, doc_id, least, n) and is alike by signature."""
    common = members.where(f"n > {COMMON} and doc_id <> least").select(F.col("doc_id").alias("u"), F.col("least").alias("v"))
    rows = members.where(f"n <= {COMMON}").select("bucket", "doc_id").join(sketched(signatures), "doc_id")
    rows = rows.select("bucket", "doc_id", "sketch").repartition("bucket").sortWithinPartitions("bucket", "doc_id")
    return rows.mapInArrow(_tied, "u bigint, v bigint").unionByName(common).distinct()


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, class_key, shingles`` of those rows (doc_id, text, class_key) whose set has that key: the sorted set as
    bytes of 64-bit numbers.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("class_key", pa.binary()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for part in slices(batches):
            out: list[list] = [[], [], []]
            for doc_id, text, key in zip(*(part[c].to_pylist() for c in ("doc_id", "text", "class_key")), strict=True):
                shingles = shingle_set(text, width, hashes)
                if xxhash.xxh3_128_digest(shingles) == key:
                    for column, value in zip(out, (doc_id, key, shingles.tobytes()), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text", "class_key").mapInArrow(run, "doc_id bigint, class_key binary, shingles binary")


@F.pandas_udf(T.BooleanType())
def _plausible(a: pd.Series, b: pd.Series) -> pd.Series:
    agree = [(np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)).mean() >= LEAST_AGREEMENT for x, y in zip(a, b, strict=True)]
    return pd.Series(agree, dtype="bool")


def _linked(numerator: int, denominator: int):
    @F.pandas_udf(T.BooleanType())
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        found = []
        for x, y in zip(a, b, strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            found.append(denominator * both >= numerator * (len(p) + len(q) - both))
        return pd.Series(found, dtype="bool")

    return linked


class _Judge:
    """Confirms pairs ``u, v`` of classes by signature, then by full sets."""

    def __init__(self, signatures: DataFrame, sets: DataFrame, numerator: int, denominator: int):
        self.signatures, self.sets, self.linked = signatures, sets, _linked(numerator, denominator)

    def _with(self, pairs: DataFrame, facts: DataFrame, fact: str) -> DataFrame:
        # v, often one document of many pairs, first: while rows are thin; then u, by which rows are even
        for end in ("v", "u"):
            pairs = pairs.join(facts.select(F.col("doc_id").alias(end), F.col(fact).alias(f"{fact}_{end}")), end)
        return pairs

    def confirm(self, pairs: DataFrame) -> DataFrame:
        likely = self._with(pairs, self.signatures, "signature").where(_plausible("signature_u", "signature_v")).select("u", "v")
        return self._with(likely, self.sets, "shingles").where(self.linked("shingles_u", "shingles_v")).select("u", "v")


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component of ``found``."""
    for end in ("u", "v"):
        known = found.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
        pairs = pairs.join(known, end, "left")
    cu, cv = F.coalesce("c_u", "u"), F.coalesce("c_v", "v")
    return pairs.where(cu != cv).select("u", "v")


def near_duplicates(docs: DataFrame, width: int = 5, numerator: int = 8, denominator: int = 10) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (doc_id, text).

    Words are runs outside ASCII white space after lower-casing A-Z; documents are linked when ``denominator`` *
    intersection >= ``numerator`` * union of their sets of ``width``-word shingles.  ``component_id`` is the smallest
    id that links reach, ``kept`` marks the document that has it.  Null, empty and blank texts have no shingles
    and are linked with nothing; rows without an id are not linked either (component null, kept true).  Rows that repeat
    an id and a text give equal rows; where one id has different texts and is the smallest id of each, one of those
    texts stands for all of them.
    """
    with shuffles_freed(docs.sparkSession):
        stored = _stored(docs, width, numerator, denominator)
    return _labelled(*stored)


def _stored(docs: DataFrame, width: int, numerator: int, denominator: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``doc_id, n_shingles, class_key`` of all rows, ``class_key, doc_id`` of the classes, ``node, component`` of the linked."""
    rows = cut(signed(docs, width))
    usable = rows.where("doc_id is not null and class_key is not null")
    # rows of one class have one signature
    classes = cut(usable.groupBy("class_key").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature")))
    thin = cut(rows.select("doc_id", "n_shingles", "class_key"))
    forget(rows)
    shown, doubled = classes, classes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("class_key").alias("class_key")).where("n > 1")
    if not doubled.isEmpty():
        other = classes.join(doubled.select("doc_id", F.col("class_key").alias("_first")), "doc_id").where("class_key <> _first")
        shown = classes.join(other.select("class_key"), "class_key", "left_anti")
    buckets = banded(shown)
    shared = buckets.groupBy("bucket").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n"))
    members = cut(buckets.join(shared.where("least < most").select("bucket", "least", "n"), "bucket"))
    signatures = cut(shown.join(members.select("doc_id").distinct(), "doc_id", "left_semi"))
    named = cut(classes.select("class_key", "doc_id"))
    forget(classes)
    tied = cut(ties(members, signatures))
    forget(members)
    sets = cut(_sets(docs, tied, signatures, width))

    links = cut(_Judge(signatures, sets, numerator, denominator).confirm(tied.groupBy("u").agg(F.min("v").alias("v"))))
    forget(signatures)
    families, found = cut(components(tied)), cut(components(links))
    forget(tied)
    more = _between_components(families, found, sets, numerator, denominator)
    forget(sets, families, found)
    return thin, named, components(links.unionByName(more))


def _sets(docs: DataFrame, tied: DataFrame, signatures: DataFrame, width: int) -> DataFrame:
    """``shingle_sets`` of the classes in ``tied``."""
    ends = tied.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    keys = signatures.select("doc_id", "class_key").join(ends, "doc_id", "left_semi")
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = plain.join(keys, "doc_id").withColumn("_h", F.xxhash64("text")).dropDuplicates(["doc_id", "_h"])
    return shingle_sets(texts, width)


def _between_components(families: DataFrame, found: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Links ``u, v`` that join components of ``found`` within a family, stored: one at least for each two that are linked."""
    of_node = found.select(F.col("node").alias("doc_id"), "component")
    placed = families.select(F.col("node").alias("doc_id"), F.col("component").alias("family")).join(of_node, "doc_id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "doc_id"))
    mixed = placed.groupBy("family").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("family")
    size = sets.select("doc_id", (F.octet_length("shingles") / 8).cast("bigint").alias("n"))
    rows = numbered(placed.join(mixed, "family").join(size, "doc_id"), ["family", "component", "n", "doc_id"])
    rows = rows.select("doc_id", "family", "component", "n", F.expr(f"row div {BLOCK}").alias("block"))
    spans = rows.groupBy("family").agg(F.min("block").alias("first"), F.max("block").alias("last"))
    pairs = spans.select("last", F.explode(F.sequence("first", "last")).alias("i")).select("i", F.explode(F.sequence("i", "last")).alias("j"))
    about = rows.groupBy("block").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.min("n").alias("low"), F.max("n").alias("high"))
    for end in ("i", "j"):
        pairs = pairs.join(about.select(F.col("block").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("a", "b", "low", "high")]), end)
    one = (F.col("a_i") == F.col("b_i")) & (F.col("a_j") == F.col("b_j")) & (F.col("a_i") == F.col("a_j"))
    far = (denominator * F.col("high_i") < numerator * F.col("low_j")) | (denominator * F.col("high_j") < numerator * F.col("low_i"))
    pairs = cut(pairs.where(~one & ~far).select("i", "j").distinct())
    member = F.struct("doc_id", "family", "component", "shingles")
    blocks = cut(rows.join(sets.select("doc_id", "shingles"), "doc_id").groupBy("block").agg(F.collect_list(member).alias("docs")))
    both = pairs.join(blocks.select(F.col("block").alias("i"), F.col("docs").alias("left")), "i")
    both = both.join(blocks.select(F.col("block").alias("j"), F.col("docs").alias("right")), "j")
    links = cut(both.select("left", "right").mapInArrow(_block_links(numerator, denominator), "u bigint, v bigint"))
    forget(blocks, pairs)
    return links


def _block_links(numerator: int, denominator: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            left, right = batch["left"][0].as_py(), batch["right"][0].as_py()
            docs = left + right
            sets = [np.frombuffer(d["shingles"], np.uint64) for d in docs]
            lengths = np.array([len(s) for s in sets])
            column = np.unique(np.concatenate(sets), return_inverse=True)[1]
            row, k = np.repeat(np.arange(len(docs)), lengths), len(left)
            seen = np.zeros((2, column.max() + 1), bool)
            seen[(row >= k).astype(int), column] = True
            shared = seen.all(axis=0)
            row, column = row[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
            common = np.zeros((k, len(docs) - k), np.int64)
            for start in range(0, int(shared.sum()), 8192):
                part = (column >= start) & (column < start + 8192)
                matrix = np.zeros((len(docs), 8192), np.float32)
                matrix[row[part], column[part] - start] = 1
                common += (matrix[:k] @ matrix[k:].T).astype(np.int64)
            union = lengths[:k, None] + lengths[None, k:] - common
            family, component = (np.array([d[key] for d in docs]) for key in ("family", "component"))
            apart = (component[:k, None] != component[None, k:]) & (family[:k, None] == family[None, k:])
            joined: dict[tuple, tuple] = {}
            for i, j in zip(*np.nonzero((denominator * common >= numerator * union) & apart), strict=True):
                joined.setdefault((component[i], component[k + j]), (docs[i]["doc_id"], docs[k + j]["doc_id"]))
            found = list(joined.values())
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], schema=schema)

    return run


def _labelled(rows: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    named = rows.join(classes.select("class_key", F.col("doc_id").alias("rep")), "class_key", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    out = named.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, width: int = 5, numerator: int = 8, denominator: int = 10) -> DataFrame:
    """Rows of ``docs`` without those whose component has a smaller id; columns as they were."""
    gone = near_duplicates(docs, width, numerator, denominator).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
