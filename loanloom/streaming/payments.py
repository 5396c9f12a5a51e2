"""Payment-event stream: replays are dropped, conflicting replays are reported."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom.operators.asof import collapse_replays
from loanloom.sources.files import exists

EVENT = "event_ref"


def drop_replays(events: DataFrame, moment: str, delay: str = "1 hour", key: Sequence[str] = (EVENT,)) -> DataFrame:
    """First copy of every event id; state is kept for ``delay`` past the newest event time."""
    return events.withWatermark(moment, delay).dropDuplicatesWithinWatermark(list(key))


def split_conflicts(batch: DataFrame, known: DataFrame, columns: Sequence[str], key: str = EVENT) -> tuple[DataFrame, DataFrame]:
    """New events of a micro-batch, and ids whose copies disagree in the batch or with stored events.

    Only the stored rows of ids in the batch are read back, by a semi join.
    """
    stored = known.select(key, *columns).join(batch.select(key).distinct(), key, "left_semi")
    seen = collapse_replays(stored.unionByName(batch.select(key, *columns)), key, columns)
    already = stored.select(key).distinct()
    fresh = seen.where("not conflicting").join(already, key, "left_anti").select(key, *columns)
    return fresh, seen.where("conflicting").select(key)


def stored_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch", T.LongType())])


def conflict_sink(accepted: str, conflicts: str, columns: Sequence[str], key: str = EVENT):
    """``foreachBatch`` function: appends new events and writes disagreeing ids per batch.

    Each batch writes its own partition with overwrite, so a batch that is run
    again after a failure replaces what it wrote before.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(key, *columns).persist()
        schema = rows.schema
        if exists(spark, accepted):
            known = spark.read.schema(stored_schema(schema)).parquet(accepted).where(F.col("batch") != batch_id)
        else:
            known = spark.createDataFrame([], stored_schema(schema))
        fresh, bad = split_conflicts(rows, known, columns, key)
        fresh.write.mode("overwrite").parquet(f"{accepted}/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{conflicts}/batch={batch_id}")
        rows.unpersist()

    return handle


def without_identity(events: DataFrame, moment: str, key: str = EVENT) -> DataFrame:
    """Rows that no settlement can hold: without event id or moment."""
    return events.where(F.col(key).isNull() | F.col(moment).isNull())


def settled(events: DataFrame, moment: str, columns: Sequence[str], delay: str = "1 hour", key: str = EVENT) -> DataFrame:
    """One row per event id and burst of copies: ``key``, ``columns``, ``first_seen, last_seen, copies, conflicting``.

    Copies of an id, each at most ``delay`` after the one before it, are one burst.  On a stream its state holds only
    the smallest and greatest payload, and the verdict is given once: when the watermark, ``delay`` behind the newest
    moment, has passed the end of the burst; then the state expires.  No batch reads what earlier batches stored, and
    no copy of a conflicting id is ever let through first.  Later rows of that time are dropped by the watermark; a
    copy more than ``delay`` after its burst is a burst of its own.  Nulls in ``columns`` differ from values and equal
    each other; of a conflict, ``columns`` is the smallest payload.  Rows of ``without_identity`` are left out.

    Where one id may be resent without end, set ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition``
    before the start: copies then merge in their tasks, before the shuffle.
    """
    known = events.where(F.col(key).isNotNull() & F.col(moment).isNotNull())
    if events.isStreaming:
        known = known.withWatermark(moment, delay)
    payload = F.struct(*[F.col(c) for c in columns])
    bursts = known.groupBy(key, F.session_window(moment, delay).alias("_burst")).agg(
        F.min(payload).alias("_low"), F.max(payload).alias("_high"), F.min(moment).alias("first_seen"),
        F.max(moment).alias("last_seen"), F.count(F.lit(1)).alias("copies"),
    )
    differs = ~F.col("_low").eqNullSafe(F.col("_high"))
    return bursts.select(
        key, *[F.col(f"_low.{c}").alias(c) for c in columns], "first_seen", "last_seen", "copies", differs.alias("conflicting")
    )


def settled_sink(folder: str):
    """``foreachBatch`` function for ``settled`` rows: one write a batch to ``folder/batch=N/conflicting=true|false``.

    A batch that is run again replaces what it wrote before; nothing stored is read.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("conflicting").parquet(f"{folder}/batch={batch_id}")

    return handle


def read_settled(spark: SparkSession, folder: str) -> DataFrame:
    """The stored verdicts; a filter on ``conflicting`` prunes folders."""
    return spark.read.parquet(folder).withColumn("conflicting", F.col("conflicting").cast("boolean"))
