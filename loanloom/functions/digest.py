"""Order-free content digests of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_text(columns: list[Column]) -> Column:
    """Unambiguous text of a row: every value is length-prefixed, null is marked."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat_ws("|", *parts)


def md5_word(text: Column) -> Column:
    """First 60 bits of the md5 as a non-negative bigint."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def table_digest(df: DataFrame, columns: list[Column] | None = None) -> DataFrame:
    """One row ``(row_count, digest_sum, digest_xor)``; independent of row order.

    Sum and xor are both commutative, so the digest is a map-side-combinable
    aggregate: no sort and no shuffle of the table itself.
    """
    text = row_text(columns) if columns else F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]),
                                                        {"ignoreNullFields": "false"})
    word = md5_word(text)
    return df.select(word.alias("w")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(F.col("w").cast("decimal(20,0)")), F.lit(0)).cast("string").alias("digest_sum"),
        F.coalesce(F.bit_xor("w"), F.lit(0)).cast("bigint").alias("digest_xor"),
    )
