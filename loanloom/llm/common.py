"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanloom.session import ensure_checkpoint_dir

#: A word is a run of characters outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Store a frame in the shared checkpoint folder, so that later steps neither recompute nor lose it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Frames made within it lose their shuffle files as soon as an action on them ends, and are for one action each: what
    is read again must be stored by ``cut``.
    """
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def forget(*stored: DataFrame) -> None:
    """Delete the files of frames that ``cut`` has returned and nothing will read again."""
    for df in stored:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._jdf.logicalPlan().rdd().getCheckpointFile().get())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def numbered(df: DataFrame, order: Sequence[str], number: str = "row", total: str = "rows") -> DataFrame:
    """Global row numbers from 0 along ``order`` and the row count, without a sort in one task.

    Rows are range-partitioned, sorted and stored; a row's number is its place in its partition plus the
    sizes of the partitions before it.  Only those sizes, one per partition, meet in one task.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    stored = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_place", place))
    stored = stored.withColumn("_part", F.shiftright("_place", 33))
    sizes = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(W.partitionBy(F.lit(0))).alias(total),
    )
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return stored.join(offsets, "_part").withColumn(number, inside + F.col("_before")).drop("_part", "_place", "_before")


#: A key with more than this share of the rows of ``dealt_join`` is dealt over parts of about this share.
SHARE = 0.01


def heavy_keys(rows: DataFrame, key: str, share: float = SHARE) -> DataFrame:
    """``key, _parts`` of the keys over ``share`` of the rows: fewer than ``1 / share``, whatever the rows."""
    sizes = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    fair = F.col("_total") * share
    heavy = sizes.join(F.broadcast(sizes.agg(F.sum("_n").alias("_total")))).where(F.col("_n") > fair)
    return heavy.select(key, F.ceil(F.col("_n") / fair).cast("int").alias("_parts"))


def dealt_join(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner", heavy: DataFrame | None = None) -> DataFrame:
    """``rows`` joined to ``facts``, unique in ``key``, where a few keys may own much of ``rows``; ``how`` is inner or left.

    The rows of ``heavy_keys`` are dealt over parts by a hash of all their columns, and only their facts are repeated,
    once a part.  Without ``heavy``, which loops work out once, ``rows`` is read twice and should be stored.  Null keys
    meet nothing, and stay in a left join.
    """
    heavy = F.broadcast(heavy_keys(rows, key) if heavy is None else heavy)
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(heavy, key, "left").withColumn("_part", F.pmod(F.xxhash64(*rows.columns), parts).cast("int")).drop("_parts")
    repeated = facts.join(heavy, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(repeated, [key, "_part"], how).drop("_part")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller pieces of Arrow batches, which bound what a Python worker holds besides its input."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
