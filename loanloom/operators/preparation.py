"""Feature preparation: limits, medians and scales are learned once and applied as columns.

What is learned is a few numbers per column; applying it is one projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.errors import ContractError
from loanloom.operators.application import categories
from loanloom.operators.contracts import Rule, enforce, violation_counts
from loanloom.operators.brackets import edges_by_column


def median_impute_values(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact median per column; a column without any value is imputed with zero."""
    found = edges_by_column(df, columns, (0.5,))
    return {c: found[c][0] if c in found else 0.0 for c in columns}


def winsor_limits(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> dict[str, tuple[float, float]]:
    found = edges_by_column(df, columns, (low, high))
    return {c: (found[c][0], found[c][1]) for c in columns if c in found}


def clip(value: Column, limits: tuple[float, float]) -> Column:
    """Null stays null: least and greatest would skip it."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(limits[0])), F.lit(limits[1])))


def most_frequent(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent category per column (closed vocabularies), ties to the first by name."""
    from loanloom.operators.profiling import describe_text

    return {r["column"]: r["top"] for r in describe_text(df, columns).collect()}


def one_hot(feature: str, values: Sequence[str]) -> list[Column]:
    return [F.coalesce((F.col(feature) == v).cast("double"), F.lit(0.0)).alias(f"{feature}={v}") for v in values]


def checked_one_hot(feature: str, values: Sequence[str]) -> list[Column]:
    """``one_hot`` that stops at a category outside the vocabulary."""
    known = F.col(feature).isNull() | F.col(feature).isin(*values)
    stop = F.raise_error(F.concat(F.lit(f"Unknown category of {feature}: "), F.col(feature).cast("string"))).cast("double")
    first, *rest = one_hot(feature, values)
    return [F.when(known, first).otherwise(stop).alias(f"{feature}={values[0]}"), *rest]


def scale_statistics(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation; a constant column keeps scale one."""
    row = df.agg(*[x for i, c in enumerate(columns) for x in (F.avg(f"`{c}`").alias(f"m{i}"), F.stddev_pop(f"`{c}`").alias(f"s{i}"))]).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


@dataclass
class SegmentPreparation:
    """log1p of amounts, 1%/99% clipping, median imputation, standard scaling."""

    columns: Sequence[str]
    amounts: Sequence[str] = ("annual_income", "requested_amount")
    limits: dict = field(default_factory=dict)
    medians: dict = field(default_factory=dict)
    scales: dict = field(default_factory=dict)

    def _logged(self, df: DataFrame) -> DataFrame:
        picked = {c: F.log1p(F.col(c).cast("double")) if c in self.amounts else F.col(c).cast("double") for c in self.columns}
        return df.withColumns(picked)

    def _filled(self, df: DataFrame) -> DataFrame:
        out = self._logged(df)
        return out.withColumns(
            {
                c: F.coalesce(clip(F.col(c), self.limits[c]) if c in self.limits else F.col(c), F.lit(self.medians[c]))
                for c in self.columns
            }
        )

    def fit(self, df: DataFrame) -> SegmentPreparation:
        positive = [Rule(f"Segmentation amounts must be positive: {a}", F.col(a) <= 0) for a in self.amounts if a in self.columns]
        enforce(violation_counts(df, positive))
        logged = self._logged(df)
        found = edges_by_column(logged, self.columns, (0.01, 0.5, 0.99))
        self.limits = {c: (q[0], q[2]) for c, q in found.items()}
        # clipping moves values only past the limits, so the median is the clipped median
        self.medians = {c: found[c][1] if c in found else 0.0 for c in self.columns}
        self.scales = scale_statistics(self._filled(df), self.columns)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.scales:
            raise ContractError("Preparation is not fitted")
        filled = self._filled(df)
        return filled.withColumns({c: (F.col(c) - m) / s for c, (m, s) in self.scales.items()})


@dataclass
class ModelPreparation:
    """Median-imputed numbers and one-hot columns over fixed vocabularies."""

    numeric: Sequence[str]
    categorical: Sequence[str]
    medians: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> ModelPreparation:
        self.medians = median_impute_values(df, self.numeric)
        return self

    def names(self) -> list[str]:
        return [*self.numeric, *[f"{c}={v}" for c in self.categorical for v in categories(c)]]

    def origins(self) -> dict[str, str]:
        return {n: n.split("=")[0] for n in self.names()}

    def expressions(self) -> list[Column]:
        numbers = [F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])).alias(c) for c in self.numeric]
        return numbers + [x for c in self.categorical for x in checked_one_hot(c, categories(c))]

    def transform(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Kept columns and one ``features`` vector."""
        from pyspark.ml.functions import array_to_vector

        return df.select(*keep, array_to_vector(F.array(*self.expressions())).alias("features"))
