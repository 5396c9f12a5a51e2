"""Read-only jobs over the application ledger and its audit tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanloom.errors import ContractError
from loanloom.functions.digest import table_digest
from loanloom.operators.contracts import union_reports
from loanloom.operators.salted import header_join

METRICS = ("roc_auc", "average_precision", "brier", "log_loss")

# Business group of every feature of the published contracts.
FEATURE_GROUPS = {
    "Application": ["age_years", "household_size", "dependent_children", "education_level", "housing_status"],
    "Employment": ["years_employed", "employment_type", "occupation", "employment_tenure_missing", "employed_age_ratio"],
    "Affordability": ["annual_income", "requested_amount", "quoted_monthly_payment", "proposed_payment_income_ratio",
                      "principal_income_ratio", "income_per_household_member", "payment_principal_ratio"],
    "Borrowing History": ["credit_bureau_inquiries_1m", "credit_bureau_inquiries_3m", "credit_bureau_inquiries_12m",
                          "credit_bureau_inquiry_history_missing"],
    "Debt Exposure": ["loan_to_goods_price_ratio"],
}


def result_view(
    predictions: DataFrame, scores: DataFrame, decisions: DataFrame, models: DataFrame, applications: DataFrame
) -> DataFrame:
    """Current decision of every application with its prediction, score and model release."""
    current = applications.select(F.col("current_decision_id").alias("decision_id"), "application_id")
    return (
        decisions.join(current, "decision_id")
        .join(predictions, "prediction_id")
        .join(scores, "prediction_id")
        .join(models, "model_version_id")
        .select(
            "application_id", "prediction_id", F.col("calibrated_pd").alias("probability"), "risk_score", "risk_band",
            "recommendation", F.col("release_name").alias("model_version"), "quality_flags",
        )
    )


def application_detail(
    applications: DataFrame, versions: DataFrame, quotes: DataFrame, results: DataFrame
) -> DataFrame:
    """Applications with the input of their current version, its quote and, where scored, the result."""
    current = versions.select("application_id", F.col("version").alias("current_version"), "version_id", "input_json")
    terms = quotes.select("version_id", "monthly_payment", "annual_rate", "term_months")
    return (
        applications.join(current, ["application_id", "current_version"])
        .join(terms, "version_id", "left")
        .join(results.select("application_id", "probability", "risk_band"), "application_id", "left")
        .drop("version_id")
    )


def import_analyses(imports: DataFrame, analyses: DataFrame, owner: int | str | None = None) -> DataFrame:
    """Stored analyses next to their import, optionally of one owner; the filter reaches the scan.

    An import with a large part of all analyses is dealt over tasks.
    """
    mine = imports if owner is None else imports.where(F.col("owner_id") == owner)
    stored = header_join(analyses, mine, "import_id")
    return stored.select("import_id", *[c for c in mine.columns + analyses.columns if c != "import_id"])


def page(df: DataFrame, limit: int, offset: int, created: str = "created_at", key: str = "id") -> DataFrame:
    """One page, newest first; the page size is the feature."""
    return df.orderBy(F.desc(created), key).offset(offset).limit(limit)


def page_after(
    df: DataFrame, limit: int, last: tuple[object, object] | None = None, created: str = "created_at", key: str = "id"
) -> DataFrame:
    """The page that follows the row (created, key) ``last``, newest first.

    The position is a filter, which reaches the scan, so a page far down costs what the first one costs.
    """
    if last is not None:
        moment, after = last
        df = df.where((F.col(created) < F.lit(moment)) | ((F.col(created) == F.lit(moment)) & (F.col(key) > F.lit(after))))
    return df.orderBy(F.desc(created), key).limit(limit)


def page_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def entity_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("entity"), "n_rows") for name, df in tables.items()]
    return union_reports(counts)


def daily_trend(applications: DataFrame, created: str, score: str, scored: Column) -> DataFrame:
    """Applications and mean affordability per UTC day; days without a score keep a null mean."""
    return applications.groupBy(F.to_date(created).alias("day")).agg(
        F.count(F.lit(1)).alias("applications"),
        F.avg(F.when(scored, F.col(score))).alias("health"),
    )


def event_timeline(events: DataFrame, entity: str, moment: str, event: str) -> DataFrame:
    """Previous state and step number are kept by the events themselves; order is by time."""
    return events.orderBy(entity, moment, event)


def feature_groups(features: Sequence[str]) -> list[tuple[str, str]]:
    """(group, feature) for a contract; an unmapped feature is an error."""
    owner = {f: g for g, members in FEATURE_GROUPS.items() for f in members}
    unmapped = sorted(set(features) - set(owner))
    if unmapped:
        raise ContractError(f"Feature contract contains unmapped features: {unmapped}")
    return [(owner[f], f) for f in features]


def unmapped_features(features: DataFrame, groups: DataFrame) -> DataFrame:
    return features.join(groups, "feature", "left_anti")


def leaderboard(folds: DataFrame, metrics: Sequence[str] = ("brier", "roc_auc", "average_precision")) -> DataFrame:
    """Mean over folds per (model, calibration), ranked by Brier, then AUC, then name.

    Ranks run over one row per candidate, a list that does not grow with the data.
    """
    mean = folds.groupBy("model", "calibration").agg(*[F.avg(m).alias(m) for m in metrics])
    order = W.partitionBy(F.lit(0)).orderBy("brier", F.desc("roc_auc"), "model", "calibration")
    return mean.withColumn("rank", F.row_number().over(order))


def research_summary(
    runs: DataFrame, metrics: DataFrame, baseline: str, bins: DataFrame | None = None, ablations: DataFrame | None = None
) -> DataFrame:
    """Registry of runs with their metrics, deltas against a baseline and Brier rank.

    ``runs``: model, version, feature_count, dataset_size; ``metrics``: model and the four metrics; ``bins``: model,
    bin and what was measured in it; ``ablations``: model, variant and its metrics.  Bins and variants become sorted
    arrays of their run, a report's handful each; a run without any has an empty one.
    """
    joined = runs.join(metrics, "model", "left")
    for part, order, name in ((bins, "bin", "calibration_bins"), (ablations, "variant", "ablations")):
        if part is not None:
            fields = F.struct(order, *[c for c in part.columns if c not in ("model", order)])
            lists = part.groupBy("model").agg(F.sort_array(F.collect_list(fields)).alias(name))
            joined = joined.join(lists, "model", "left")
            joined = joined.withColumn(name, F.coalesce(name, F.array().cast(joined.schema[name].dataType)))
    everyone = W.partitionBy(F.lit(0))
    base = {m: F.max(F.when(F.col("model") == baseline, F.col(m))).over(everyone) for m in METRICS}
    order = everyone.orderBy("brier", F.desc("roc_auc"), "model")
    return joined.withColumns(
        {**{f"{m}_delta": F.col(m) - base[m] for m in METRICS}, "rank": F.row_number().over(order)}
    )


def fingerprints(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(table_name, row_count, digest_sum, digest_xor)`` for a set of tables."""
    parts = [table_digest(df).select(F.lit(name).alias("table_name"), "row_count", "digest_sum", "digest_xor")
             for name, df in tables.items()]
    return union_reports(parts)


def changed_tables(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tables that appeared, vanished or changed content between two fingerprint reports."""
    b = before.select("table_name", F.struct("row_count", "digest_sum", "digest_xor").alias("_b"))
    a = after.select("table_name", F.struct("row_count", "digest_sum", "digest_xor").alias("_a"))
    both = b.join(a, "table_name", "full")
    change = (
        F.when(F.col("_b").isNull(), "ADDED").when(F.col("_a").isNull(), "REMOVED")
        .when(F.col("_a") != F.col("_b"), "CHANGED")
    )
    return both.select("table_name", change.alias("change")).where(F.col("change").isNotNull())


#: Parts into which a window's time is cut; a key's events of one part are summed in one task at most.
SUB_BUCKETS = 96


def sliding_counts(events: DataFrame, key: str, moment: str, seconds: int) -> DataFrame:
    """Events of the same key in the closed window of ``seconds`` before each event time.

    The count is the running count at the event minus the running count just before the window, so no frame is
    summed again for every row.  Time is cut into ``SUB_BUCKETS`` parts of a window: counts run inside a part, and the
    parts before it add their totals, of which a key has one row a part.  Both running counts come from one union
    of events and window starts.  A key with many events in one window is spread over the parts of that window.
    """
    width = seconds * 1_000_000
    part = max(1, width // SUB_BUCKETS)
    at = F.unix_micros(F.col(moment).cast("timestamp"))
    # equal event times of a key are one weighted row
    weighted = events.groupBy(key, moment).agg(F.count(F.lit(1)).alias("_n")).withColumn("_us", at)
    one = weighted.select(key, moment, "_us", "_n", F.lit(1).alias("_sort"))
    # at one time, the start of a window comes before the events, which it does not count
    starts = weighted.select(key, moment, (F.col("_us") - width).alias("_us"), F.lit(0).cast("bigint").alias("_n"), F.lit(0).alias("_sort"))
    points = one.unionByName(starts).withColumn("_part", F.floor(F.col("_us") / part))
    inside = W.partitionBy(key, "_part").orderBy("_us", "_sort").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = points.groupBy(key, "_part").agg(F.sum("_n").alias("_sum"))
    totals = totals.select(F.col(key).alias("_k"), F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    same = F.col(key).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p"))
    known = points.withColumn("_run", F.sum("_n").over(inside)).join(totals, same)
    running = F.col("_run") + F.col("_before")
    return known.groupBy(key, moment).agg(
        F.max("_n").alias("at_once"), F.sum(F.when(F.col("_sort") == 1, running).otherwise(-running)).alias("in_window")
    )


def rate_breaches(events: DataFrame, key: str, moment: str, seconds: int, limit: int) -> DataFrame:
    return sliding_counts(events, key, moment, seconds).where(F.col("in_window") >= limit)
