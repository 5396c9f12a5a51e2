"""Table profiling and exploratory reports.

Counts and moments of all columns come from one wide aggregate; quantiles come
from the distributed prefix search.  Only report rows (one per column) are ever
small enough to matter to the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom.functions.binning import equal_width, left_closed, quantile_bin
from loanloom.functions.nullsafe import is_finite, ratio
from loanloom.functions.reshape import long_rows
from loanloom.operators.brackets import column_quantiles, edges_by_column
from loanloom.operators.prefix import quantile_edges, quantiles_of_counts

# Edges of the age bins, left-closed.
AGE_EDGES = [18, 25, 30, 35, 40, 45, 50, 55, 60, 70]
QUALITY_PROBS = (0.01, 0.25, 0.50, 0.75, 0.99)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def overview(df: DataFrame, key: str, label: str) -> DataFrame:
    y = F.col(label)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        (F.count(F.lit(1)) - F.count_distinct(F.col(key))).alias("duplicate_ids"),
        F.avg(y.cast("double")).alias("positive_rate"),
        F.count_if(y == 0).alias("negatives"),
        F.count_if(y == 1).alias("positives"),
        ratio(F.count_if(y == 0), F.count_if(y == 1)).alias("imbalance_ratio"),
    )


def column_types(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(df.dtypes, "column string, dtype string")


def missing_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing fraction per column."""
    names = list(columns or df.columns)
    totals = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"k{i}") for i, c in enumerate(names)])
    rows = [
        {"column": F.lit(c), "missing_rows": F.col("n") - F.col(f"k{i}"),
         "missing_fraction": ratio(F.col("n") - F.col(f"k{i}"), F.col("n"))}
        for i, c in enumerate(names)
    ]
    return long_rows(totals, rows)


def _first(report: DataFrame, top: int | None) -> DataFrame:
    return report if top is None else report.limit(top)


def ranked_missing(df: DataFrame, columns: Sequence[str] | None = None, top: int | None = None) -> DataFrame:
    """Columns with unknown values, most of them first; ``top`` is a display size."""
    report = missing_report(df, columns).where("missing_rows > 0")
    return _first(report.orderBy(F.desc("missing_fraction"), "column"), top)


def mostly_missing(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return missing_report(df).agg(F.count_if(F.col("missing_fraction") > threshold).alias("columns_over_threshold"))


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per numeric column."""
    totals = df.agg(
        *[
            stat
            for i, c in enumerate(columns)
            for stat in (
                F.count(c).alias(f"n{i}"), F.avg(F.col(c).cast("double")).alias(f"m{i}"),
                F.stddev_samp(F.col(c).cast("double")).alias(f"s{i}"),
                F.min(F.col(c).cast("double")).alias(f"lo{i}"), F.max(F.col(c).cast("double")).alias(f"hi{i}"),
            )
        ]
    )
    moments = long_rows(
        totals,
        [
            {"column": F.lit(c), "known_rows": F.col(f"n{i}"), "mean": F.col(f"m{i}"), "std": F.col(f"s{i}"),
             "minimum": F.col(f"lo{i}"), "maximum": F.col(f"hi{i}")}
            for i, c in enumerate(columns)
        ],
    )
    parts = column_quantiles(df, columns, (0.25, 0.5, 0.75)).select(
        "column", F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75")
    )
    return moments.join(parts, "column", "left")


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count per value of each code column, nulls left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    long = df.select(pairs.alias("_p")).select("_p.column", "_p.value").where("value is not null")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n_rows"))


def describe_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, distinct values and the most frequent value per text column."""
    counts = category_counts(df, columns)
    # most frequent first, then alphabetical: min over (-count, value)
    return counts.groupBy("column").agg(
        F.sum("n_rows").alias("known_rows"), F.count(F.lit(1)).alias("distinct_values"),
        F.min(F.struct(-F.col("n_rows"), F.col("value").alias("value"))).alias("_top"),
    ).select("column", "known_rows", "distinct_values", F.col("_top.value").alias("top"), (-F.col("_top.col1")).alias("top_rows"))


def iqr_outliers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows outside 1.5 interquartile ranges, with the maximum and the 99th percentile."""
    edges = edges_by_column(df, columns, (0.25, 0.75, 0.99))
    known = [c for c in columns if c in edges]
    tests, rows = [], []
    for i, c in enumerate(known):
        q1, q3, p99 = edges[c]
        spread = 1.5 * (q3 - q1)
        value = F.col(c).cast("double")
        tests += [F.count_if((value < q1 - spread) | (value > q3 + spread)).alias(f"n{i}"), F.max(value).alias(f"x{i}")]
        rows.append({"column": F.lit(c), "iqr_outliers": F.col(f"n{i}"), "maximum": F.col(f"x{i}"), "p99": F.lit(float(p99))})
    return long_rows(df.agg(*tests), rows)


def sentinel_counts(df: DataFrame, sentinels: Mapping[str, object]) -> DataFrame:
    """Rows that hold a placeholder value, per column."""
    pairs = list(sentinels.items())
    totals = df.agg(*[F.count_if(F.col(c) == F.lit(v)).alias(f"n{i}") for i, (c, v) in enumerate(pairs)])
    return long_rows(totals, [{"column": F.lit(c), "sentinel_rows": F.col(f"n{i}")} for i, (c, _) in enumerate(pairs)])


def coverage(base: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Share of base ids that occur in a source."""
    ids = source.select(key).distinct().withColumn("_hit", F.lit(1))
    joined = base.select(key).distinct().join(ids, key, "left")
    return joined.agg(
        F.count(F.lit(1)).alias("base_ids"), F.count("_hit").alias("covered_ids"),
        ratio(F.count("_hit"), F.count(F.lit(1))).alias("coverage"),
    )


def rate_by(df: DataFrame, column: str | Column, label: str, min_count: int = 200) -> DataFrame:
    """Positive rate per group; unknown is a group of its own."""
    value = F.col(column) if isinstance(column, str) else column
    grouped = df.groupBy(F.coalesce(value.cast("string"), F.lit("MISSING")).alias("group_value")).agg(
        F.avg(F.col(label).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n_rows")
    )
    return grouped.where(F.col("n_rows") >= min_count)


def rate_by_top(df: DataFrame, column: str, label: str, min_count: int = 200, top: int | None = None) -> DataFrame:
    return _first(rate_by(df, column, label, min_count).orderBy(F.desc("rate"), "group_value"), top)


def rate_by_age(df: DataFrame, age: Column, label: str) -> DataFrame:
    return rate_by(df, left_closed(age, AGE_EDGES), label, 1)


def rate_by_quantile(df: DataFrame, column: str, label: str, bins: int = 10) -> DataFrame:
    edges = quantile_edges(df, column, [i / bins for i in range(bins + 1)])
    return rate_by(df, quantile_bin(F.col(column), edges), label, 1)


def histogram(df: DataFrame, column: str, bins: int = 40, by: str | None = None) -> DataFrame:
    """Equal-width histogram over the whole range; with ``by`` also the density per group."""
    value = F.col(column).cast("double")
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        low = high = 0.0
    placed = df.where(value.isNotNull()).withColumn("bin", equal_width(value, F.lit(low), F.lit(high), bins))
    keys = ([by] if by else []) + ["bin"]
    counts = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    width = (high - low) / bins if high > low else 1.0
    if by is None:
        return counts.withColumn("bin_start", F.lit(low) + F.col("bin") * F.lit(width))
    # group sizes have one row per group of `by`; the join side is as small as the report
    sizes = counts.groupBy(by).agg(F.sum("n_rows").alias("_size"))
    return counts.join(sizes, by).withColumn("density", F.col("n_rows") / (F.col("_size") * F.lit(width))).drop("_size")


def correlations(df: DataFrame, label: str, columns: Sequence[str], top: int | None = None) -> DataFrame:
    """Pearson correlation with the label, strongest first; all columns in one aggregate."""
    y = F.col(label).cast("double")
    totals = df.agg(*[F.corr(F.col(c).cast("double"), y).alias(f"r{i}") for i, c in enumerate(columns)])
    report = long_rows(totals, [{"column": F.lit(c), "correlation": F.col(f"r{i}")} for i, c in enumerate(columns)])
    known = report.where(F.col("correlation").isNotNull() & ~F.isnan("correlation"))
    return _first(known.orderBy(F.desc(F.abs("correlation")), "column"), top)


def source_profile(
    source: DataFrame, eligible: DataFrame, key: str, event: str, owners: DataFrame | None = None, via: str | None = None
) -> DataFrame:
    """Raw row coverage of one history source among eligible applicants.

    ``owners`` maps ``via`` to the applicant for tables that lack the id.  Rows
    are counted per applicant (or per ``via``) before any join.
    """
    if owners is None:
        per_id = source.groupBy(key).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col(event).try_cast("double") > 0).alias("future")
        )
    else:
        per_account = source.groupBy(via).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col(event).try_cast("double") > 0).alias("future")
        )
        mapped = per_account.join(owners.select(via, key), via, "left")
        per_id = mapped.groupBy(key).agg(F.sum("n").alias("n"), F.sum("future").alias("future"))
    ids = eligible.select(key).distinct().withColumn("_eligible", F.lit(1))
    joined = per_id.join(ids, key, "full").withColumn("n", F.coalesce("n", F.lit(0)))
    totals = joined.agg(
        F.sum("n").alias("raw_rows"),
        F.count("_eligible").alias("eligible_applicants"),
        F.count_if((F.col("n") > 0) & F.col("_eligible").isNotNull()).alias("applicants_with_rows"),
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("orphan_rows"),
        F.coalesce(F.sum("future"), F.lit(0)).alias("future_rows"),
    )
    # distribution including applicants without any row: a table of distinct counts
    spread = joined.where(F.col("_eligible").isNotNull()).groupBy("n").agg(F.count(F.lit(1)).alias("weight"))
    q = quantiles_of_counts(spread, "n", (0.5, 0.95)).first()
    percent = ratio(100 * F.col("applicants_with_rows"), F.col("eligible_applicants"))
    return totals.withColumns(
        {
            "coverage_pct": percent,
            "rows_p50": F.lit(q["q0"] if q else None).cast("double"),
            "rows_p95": F.lit(q["q1"] if q else None).cast("double"),
        }
    )


def column_quality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing share, unreadable and negative counts, range and mean per column."""
    stats, rows = [F.count(F.lit(1)).alias("n")], []
    for i, c in enumerate(columns):
        raw = F.col(c)
        number = raw.try_cast("double")
        finite = F.when(is_finite(number), number)
        stats += [
            F.count(raw).alias(f"k{i}"), F.count_if(raw.isNotNull() & finite.isNull()).alias(f"bad{i}"),
            F.count_if(finite < 0).alias(f"neg{i}"), F.min(finite).alias(f"lo{i}"), F.max(finite).alias(f"hi{i}"),
            F.avg(finite).alias(f"avg{i}"),
        ]
        rows.append(
            {
                "column": F.lit(c), "n_rows": F.col("n"),
                "missing_pct": ratio(100 * (F.col("n") - F.col(f"k{i}")), F.col("n")),
                "invalid_numeric": F.col(f"bad{i}"), "negative_numeric": F.col(f"neg{i}"),
                "minimum": F.col(f"lo{i}"), "maximum": F.col(f"hi{i}"), "mean": F.col(f"avg{i}"),
            }
        )
    return long_rows(df.agg(*stats), rows)


def feature_quality(
    df: DataFrame, contract: Sequence[str], groups: Mapping[str, str] | None = None, text: Sequence[str] = ()
) -> DataFrame:
    """One row per contract feature: status, coverage, range, mean and quantiles."""
    groups = groups or {}
    present = [c for c in contract if c in df.columns]
    numeric = [c for c in present if c not in text]
    stats = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(present):
        stats.append(F.count(c).alias(f"k{i}"))
        if c in numeric:
            value = F.col(c).cast("double")
            finite = F.when(is_finite(value), value)
            stats += [F.count_if(value.isNotNull() & finite.isNull()).alias(f"bad{i}"), F.min(finite).alias(f"lo{i}"),
                      F.max(finite).alias(f"hi{i}"), F.avg(finite).alias(f"avg{i}")]
    rows = []
    for c in contract:
        here = c in present
        i = present.index(c) if here else -1
        known = F.col(f"k{i}") if here else F.lit(0).cast("bigint")
        number = c in numeric
        rows.append(
            {
                "feature": F.lit(c), "source_group": F.lit(groups.get(c, "application")),
                "status": F.lit("GENERATED" if here else "BLOCKED_NOT_GENERATED"), "n_rows": F.col("n"),
                "coverage_pct": ratio(100 * known, F.col("n")),
                "missing_pct": ratio(100 * (F.col("n") - known), F.col("n")),
                "nonfinite": F.col(f"bad{i}") if number else F.lit(None).cast("bigint"),
                "minimum": F.col(f"lo{i}") if number else F.lit(None).cast("double"),
                "mean": F.col(f"avg{i}") if number else F.lit(None).cast("double"),
                "maximum": F.col(f"hi{i}") if number else F.lit(None).cast("double"),
            }
        )
    report = long_rows(df.agg(*stats), rows)
    parts = column_quantiles(df, numeric, QUALITY_PROBS)
    named = [F.col(f"q{i}").alias(f"p{round(100 * p)}") for i, p in enumerate(QUALITY_PROBS)]
    return report.join(parts.select(F.col("column").alias("feature"), *named), "feature", "left")


def feature_histograms(df: DataFrame, columns: Sequence[str], bins: int = 20) -> DataFrame:
    """Equal-width histograms of many features in one pass after one range pass.

    The driver holds two numbers per column, the bin expressions are literals.
    """
    bounds = df.agg(
        *[f for i, c in enumerate(columns) for f in (F.min(F.col(c).cast("double")).alias(f"lo{i}"),
                                                    F.max(F.col(c).cast("double")).alias(f"hi{i}"))]
    ).first()
    placed = []
    for i, c in enumerate(columns):
        low, high = bounds[f"lo{i}"], bounds[f"hi{i}"]
        if low is None:
            continue
        bin_no = equal_width(F.col(c).cast("double"), F.lit(low), F.lit(high), bins)
        placed.append(F.struct(F.lit(c).alias("feature"), bin_no.alias("bin")))
    long = df.select(F.explode(F.array(*placed)).alias("_b")).select("_b.feature", "_b.bin").where("bin is not null")
    return long.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n_rows"))


def feature_inventory(quality: DataFrame, definitions: DataFrame) -> DataFrame:
    """Quality rows next to their definitions; features without quality are dropped from use."""
    joined = definitions.join(quality, "feature", "left")
    keep = F.when(F.coalesce(F.col("status") == "GENERATED", F.lit(False)), "KEEP").otherwise("DROP")
    return joined.withColumn("recommendation", keep)


def population_stability(expected: DataFrame, actual: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Drift of one numeric column between two cohorts in quantile bins of the first."""
    edges = quantile_edges(expected, column, [i / bins for i in range(bins + 1)])

    def shares(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(quantile_bin(F.col(column), edges).alias("bin")).agg(F.count(F.lit(1)).alias(name))

    both = shares(expected, "n_expected").join(shares(actual, "n_actual"), "bin", "full").na.fill(0)
    sizes = both.agg(F.sum("n_expected").alias("e"), F.sum("n_actual").alias("a")).first()
    e = F.greatest(F.col("n_expected") / F.lit(float(sizes["e"])), F.lit(1e-6))
    a = F.greatest(F.col("n_actual") / F.lit(float(sizes["a"])), F.lit(1e-6))
    return both.withColumn("contribution", (a - e) * F.log(a / e))
