"""Distributed prefix sums, ranks and exact quantiles.

A global ``orderBy`` window would put every row into one task.  Here rows are
range-partitioned on the sort key and written once (a checkpoint, so that the
partition number of a row is a stored fact); each partition is summed locally
and shifted by the totals of the partitions before it.  Only those totals, one
row per partition and group, are looked at globally.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanloom.session import ensure_checkpoint_dir

PART = "_part"


def range_sorted(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows range-partitioned and sorted on ``order``, with their partition number stored."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return placed.withColumn(PART, F.spark_partition_id()).checkpoint()


def running_sums(
    df: DataFrame, order: Sequence[str], sums: dict[str, str], groups: Sequence[str] = ()
) -> DataFrame:
    """Add the inclusive running sums ``{new: source}`` along ``order`` inside each group.

    ``groups + order`` must be unique.  The result also carries ``<new>_total``,
    the sum over the whole group.
    """
    groups = list(groups)
    placed = range_sorted(df, [*groups, *order])
    totals = placed.groupBy(PART, *groups).agg(*[F.sum(s).alias(f"_sum_{n}") for n, s in sums.items()])
    anchor = [F.col(g) for g in groups] or [F.lit(0)]
    before = W.partitionBy(*anchor).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(*anchor)
    offsets = totals.select(
        PART,
        *groups,
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in sums],
        *[F.sum(f"_sum_{n}").over(everything).alias(f"{n}_total") for n in sums],
    )
    local = W.partitionBy(PART, *groups).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    stepped = placed.withColumns({n: F.sum(s).over(local) for n, s in sums.items()})
    joined = stepped.join(offsets, [PART, *groups])
    shifted = {n: F.col(n) + F.col(f"_off_{n}") for n in sums}
    return joined.withColumns(shifted).drop(PART, *[f"_off_{n}" for n in sums])


def ranked(df: DataFrame, order: Sequence[str], groups: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Zero-based rank along a unique ``order`` inside each group, plus ``<name>_total``."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_sums(one, order, {name: "_one"}, groups).withColumn(name, F.col(name) - 1).drop("_one")


def value_counts(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Distinct known values with their row counts; the input of the quantile search."""
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("weight"))


def quantiles_of_counts(
    counts: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = ()
) -> DataFrame:
    """Exact linear-interpolated quantiles ``q0..qk`` per group from weighted distinct values."""
    groups = list(groups)
    stepped = running_sums(counts, [value], {"upto": "weight"}, groups)
    first, last = F.col("upto") - F.col("weight"), F.col("upto")
    picks: list[Column] = []
    for i, p in enumerate(probs):
        position = F.lit(float(p)) * (F.col("upto_total") - 1)
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            picks.append(F.max(F.when((first <= rank) & (rank < last), F.col(value))).alias(f"_{side}{i}"))
    found = stepped.groupBy(*groups).agg(F.max("upto_total").alias("known_rows"), *picks)
    out = []
    for i, p in enumerate(probs):
        position = F.lit(float(p)) * (F.col("known_rows") - 1)
        low, high = F.col(f"_lo{i}").cast("double"), F.col(f"_hi{i}").cast("double")
        out.append((low + (high - low) * (position - F.floor(position))).alias(f"q{i}"))
    return found.select(*groups, "known_rows", *out)


def quantiles(df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    return quantiles_of_counts(value_counts(df, value, groups), value, probs, groups)


def quantile_edges(df: DataFrame, value: str, probs: Sequence[float]) -> list[float]:
    """Quantiles as numbers on the driver: ``len(probs)`` values, whatever the data size."""
    row = quantiles(df, value, probs).first()
    return [] if row is None else [row[f"q{i}"] for i in range(len(probs))]
