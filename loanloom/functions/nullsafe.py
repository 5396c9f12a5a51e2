"""Null policy: unknown stays unknown, it is never read as zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Money is reconciled in whole ten-thousandths so that sums are exact and do not
# depend on the order in which partial aggregates meet.
MINOR_SCALE = 10_000


def known_total(value: Column) -> Column:
    """Sum that is null as soon as one constituent is null."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division; null instead of an error when the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def share(condition: Column) -> Column:
    """Fraction of rows for which ``condition`` holds; null conditions are skipped."""
    return F.avg(condition.cast("double"))


def tally(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def is_finite(value: Column) -> Column:
    """True for a known, finite number; false for null, NaN and infinities."""
    # NaN sorts above infinity, so one comparison covers both
    return F.coalesce(F.abs(value.cast("double")) < float("inf"), F.lit(False))


def is_infinite(value: Column) -> Column:
    return F.coalesce(F.abs(value.cast("double")) == float("inf"), F.lit(False))


def malformed(value: Column) -> Column:
    """A non-null value that does not read as a number."""
    return value.isNotNull() & value.try_cast("double").isNull()


def to_minor(amount: Column) -> Column:
    """Exact integer money in ten-thousandths of the currency unit."""
    return F.rint(amount.cast("double") * MINOR_SCALE).cast("bigint")


def clean_floats(df: DataFrame) -> DataFrame:
    """NaN to null in every floating column, applied once at the scan."""
    floating = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            nan_to_null(F.col(f.name)).alias(f.name) if isinstance(f.dataType, floating) else F.col(f.name)
            for f in df.schema.fields
        ]
    )
