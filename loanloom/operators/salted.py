"""Joins of facts to their header rows where a few keys own much of the facts.

The keys that own more than ``share`` of the facts are measured first; there are at most ``1 / share`` of them, which
bounds both what the driver sees and what is broadcast.  Only their header rows are repeated, once per part, and only
their facts are dealt over the parts; all other rows join as they are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is heavy from this share of the facts on; a heavy key is cut into parts of about this share.
SHARE = 0.01
PART, PARTS = "_salt", "_salts"


def heavy_keys(facts: DataFrame, keys: Sequence[str], share: float = SHARE) -> list[tuple]:
    """``(*key, parts)`` of keys with more than ``share`` of the rows; keys with a null join nothing and are left out.

    Counts combine before they are shuffled, so a heavy key costs one row a task.
    """
    sizes = facts.where(_known(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_total"))
    heavy = sizes.join(F.broadcast(total)).where(F.col("_n") > F.col("_total") * share)
    rows = heavy.select(*keys, (F.col("_n") / (F.col("_total") * share)).alias("_parts")).collect()
    return [(*r[:-1], math.ceil(r[-1])) for r in rows]


def _known(keys: Sequence[str]) -> Column:
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    return known


def header_join(
    facts: DataFrame, headers: DataFrame, keys: str | Sequence[str], how: str = "inner", share: float = SHARE,
    deal: Sequence[str] | None = None, tasks: int | None = None,
) -> DataFrame:
    """``facts`` joined to ``headers`` on ``keys``, which are unique in ``headers``; ``how`` is ``inner`` or ``left``.

    A heavy key's facts are dealt by a hash of ``deal`` (all columns by default), so a task that runs again deals
    them alike; facts that are equal in those columns stay together.  Without a heavy key it is a plain join.
    ``tasks`` deals both sides over so many tasks, for facts that are many for the session's shuffles.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"Only inner and left joins: {how}")
    keys = [keys] if isinstance(keys, str) else list(keys)

    def met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        if tasks:  # a number that is asked for is neither lowered nor merged
            left, right = left.repartition(tasks, *on), right.repartition(tasks, *on)
        return left.join(right, on, how)

    heavy = heavy_keys(facts, keys, share)
    if not heavy:
        return met(facts, headers, keys)
    schema = facts.select(*keys).schema.add(PARTS, T.IntegerType())
    parts = F.broadcast(facts.sparkSession.createDataFrame(heavy, schema))  # at most 1 / share rows
    marked, repeated = facts.join(parts, keys, "left"), headers.join(parts, keys, "left")
    part = F.pmod(F.xxhash64(*(deal or facts.columns)), F.coalesce(PARTS, F.lit(1))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(PARTS), F.lit(1)) - 1))
    left = marked.withColumn(PART, part).drop(PARTS)
    right = repeated.withColumn(PART, every).drop(PARTS)
    return met(left, right, [*keys, PART]).drop(PART)
