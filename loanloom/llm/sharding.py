"""Sharding by a Feistel permutation over global row numbers.

Row numbers 0..n-1 follow ``doc_id``; a keyed balanced Feistel network permutes the smallest even power of two
that holds n, and cycle walking repeats it until the image is below n.  That makes a reproducible shuffle in
which a row's shard (position mod shards) and slot (position div shards) follow from its number, n and the seed
alone.  Shard sizes differ by one row at most, whatever the keys: the law is ``rows``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom.llm.common import numbered, text_or_empty

ROUNDS = 6
MASK = 0xFFFFFFFF


def round_keys(seed: int) -> list[int]:
    return [(seed * 0x9E3779B1 + (r + 1) * 0x85EBCA6B) & MASK for r in range(ROUNDS)]


def half_bits(rows: int) -> int:
    """Bits of one half: the smallest k with rows <= 4 ** k, 1 at least."""
    return max(1, ((rows - 1).bit_length() + 1) // 2)


def feistel(values: np.ndarray, bits: int, seed: int) -> np.ndarray:
    mask = np.uint64((1 << bits) - 1)
    left, right = values >> np.uint64(bits), values & mask
    for key in round_keys(seed):
        mixed = (right * np.uint64(0x2C1B3C6D) + np.uint64(key)) & np.uint64(MASK)
        mixed = ((mixed ^ (mixed >> np.uint64(15))) * np.uint64(0x297A2D39)) & np.uint64(MASK)
        left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(14))) & mask)
    return (left << np.uint64(bits)) | right


def permute(values: np.ndarray, rows: int, seed: int) -> np.ndarray:
    """Images of row numbers below ``rows`` (up to 2**62): all distinct and below ``rows``."""
    bits = half_bits(rows)
    out = feistel(values.astype(np.uint64), bits, seed)
    while (outside := out >= rows).any():
        out[outside] = feistel(out[outside], bits, seed)
    return out.astype(np.int64)


def permuted(seed: int) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(T.LongType())
    def position(number: pd.Series, rows: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), int(rows.iloc[0]), seed) if len(number) else [], dtype="int64")

    return position


def assign_shards(docs: DataFrame, shards: int = 24, seed: int = 20240229) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``.

    Null text counts as empty (size 8, checksum 0); null ids are numbered first; repeated rows each get a slot of
    their own, ties in id are ordered by checksum and size.  An empty table gives no rows; other columns are ignored.
    """
    text = text_or_empty()
    light = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    rows = numbered(light, ["doc_id", "text_crc32", "size"])
    placed = rows.withColumn("position", permuted(seed)("row", "rows"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("position") % shards).cast("int").alias("shard"),
        F.expr(f"position div {shards}").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

