"""Disjoint, stratified cohorts from a stable hash order.

The order inside a class is the md5 of the id: reproducible on any cluster and
in any engine.  Ranks come from distributed prefix counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.errors import ContractError
from loanloom.operators.prefix import ranked

# Shares of the reserved cohorts, in the order in which they are cut.
RESERVED = (("test", 0.15), ("policy", 0.10), ("calibration", 0.15))
MIN_PER_CLASS = 20
FOLDS = 3


def hash_order(key: str) -> Column:
    return F.md5(F.col(key).cast("string"))


def allocate(total: int, sizes: dict[int, int]) -> dict[int, int]:
    """Split ``total`` over classes in proportion to ``sizes`` by largest remainder."""
    whole = sum(sizes.values())
    exact = {c: total * n / whole for c, n in sizes.items()}
    taken = {c: int(v) for c, v in exact.items()}
    left = total - sum(taken.values())
    for c in sorted(exact, key=lambda k: (taken[k] - exact[k], k))[:left]:
        taken[c] += 1
    return taken


def class_ranks(df: DataFrame, key: str, label: str) -> DataFrame:
    keyed = df.select(key, label, hash_order(key).alias("_h"))
    return ranked(keyed, ["_h", key], [label]).drop("_h")


def class_sizes(df: DataFrame, label: str) -> dict[int, int]:
    """Rows of the two classes that occur; any other label is an error. One row reaches the driver."""
    y = F.col(label)
    row = df.agg(F.count_if(y == 0).alias("zero"), F.count_if(y == 1).alias("one"), F.count(F.lit(1)).alias("n")).first()
    if row["zero"] + row["one"] != row["n"]:
        raise ContractError("TARGET must contain only 0 and 1")
    return {c: row[k] for c, k in ((0, "zero"), (1, "one")) if row[k]}


def split_cohorts(df: DataFrame, key: str = "id", label: str = "y") -> DataFrame:
    """``(id, y, cohort)`` with integer sizes 15/10/15/60 percent, stratified and exhaustive."""
    sizes = class_sizes(df, label)
    if set(sizes) != {0, 1} or min(sizes.values()) < MIN_PER_CLASS:
        raise ContractError("Need at least 20 members of each class for disjoint cohorts")
    n = sum(sizes.values())
    cuts: dict[int, int] = dict.fromkeys(sizes, 0)
    left = dict(sizes)
    cohort = F.lit(None).cast("string")
    for name, fraction in RESERVED:
        part = allocate(round(n * fraction), left)
        hit = F.lit(False)
        for c in sizes:
            inside = (F.col("rank") >= cuts[c]) & (F.col("rank") < cuts[c] + part[c])
            hit = hit | ((F.col(label) == c) & inside)
            cuts[c] += part[c]
            left[c] -= part[c]
        cohort = F.coalesce(cohort, F.when(hit, F.lit(name)))
    return class_ranks(df, key, label).select(key, label, F.coalesce(cohort, F.lit("development")).alias("cohort"))


def stratified_cap(df: DataFrame, limit: int, key: str = "id", label: str = "y") -> DataFrame:
    """At most ``limit`` rows with the class mix kept; this sampling is the feature itself."""
    sizes = class_sizes(df, label)
    if sum(sizes.values()) <= limit:
        return df.select(key, label)
    part = allocate(limit, sizes)
    keep = F.lit(False)
    for c, k in part.items():
        keep = keep | ((F.col(label) == c) & (F.col("rank") < k))
    return class_ranks(df, key, label).where(keep).select(key, label)


def nested_folds(df: DataFrame, key: str = "id", label: str = "y", folds: int = FOLDS) -> DataFrame:
    """``(id, y, assess_fold, inner_slot, tune_fold)`` from one ranking.

    The fold that assesses a row, its calibration slot inside the other folds,
    and its fold in the inner search; all three are stratified by class.
    """
    ranks = class_ranks(df, key, label)
    return ranks.select(
        key, label, (F.col("rank") % folds).cast("int").alias("assess_fold"),
        (F.floor(F.col("rank") / folds) % 5).cast("int").alias("inner_slot"),
        (F.floor(F.col("rank") / (5 * folds)) % FOLDS).cast("int").alias("tune_fold"),
    )


def fold_role(fold: int) -> Column:
    """Role of a row in one outer fold: assessment, or 20% calibration and 80% base of the rest."""
    return (
        F.when(F.col("assess_fold") == fold, "assessment")
        .when(F.col("inner_slot") == 0, "calibration")
        .otherwise("base")
    )


def fold_lineage(df: DataFrame, key: str = "id", label: str = "y", folds: int = FOLDS) -> DataFrame:
    """Row counts per fold, role and class."""
    placed = nested_folds(df, key, label, folds)
    roles = F.explode(F.array(*[F.struct(F.lit(f).alias("fold"), fold_role(f).alias("role")) for f in range(folds)]))
    long = placed.select(label, roles.alias("_r")).select(label, "_r.fold", "_r.role")
    return long.groupBy("fold", "role", label).agg(F.count(F.lit(1)).alias("n_rows"))


def partition_problems(cohorts: DataFrame, population: DataFrame, key: str = "id") -> DataFrame:
    """Ids in several cohorts, in none, or unknown to the population."""
    counts = cohorts.groupBy(key).agg(F.count(F.lit(1)).alias("_in"))
    base = population.select(key).distinct().withColumn("_known", F.lit(1))
    both = counts.join(base, key, "full")
    return both.agg(
        F.count_if(F.col("_in") > 1).alias("in_several"),
        F.count_if(F.col("_in").isNull()).alias("unassigned"),
        F.count_if(F.col("_known").isNull()).alias("unknown"),
    )


def set_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that only one of two cohorts holds, tagged with the side."""
    a, b = left.select(*keys), right.select(*keys)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(
        b.exceptAll(a).withColumn("side", F.lit("right"))
    )


def deterministic_sample(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The ``n`` rows with the smallest hash; a top-n per task, merged."""
    return df.orderBy(hash_order(key), key).limit(n)
