"""Borrower segments: candidate sweep, cluster quality, stability and profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.errors import ContractError
from loanloom.functions.nullsafe import ratio
from loanloom.operators import lloyd

MIN_SHARE = 0.01
MIN_STABILITY = 0.80
SILHOUETTE_TOLERANCE = 0.01
SEEDS = (42, 43, 44)
#: Starts of each fit, of which the most compact is taken.
STARTS = 5

# Relative and absolute margins of a segment description.
RATIO_TRAITS = (("income", "income"), ("requested", "requested loan amount"))
MARGIN_TRAITS = (("age", "age", 4.0), ("tenure", "employment tenure", 2.0))
INQUIRY_MARGIN = 0.25


def vectors(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])).alias("features"))


def standardized(df: DataFrame, array: str, keep: Sequence[str], size: int) -> DataFrame:
    """Standardize an array column by population deviation; two numbers per dimension are learned."""
    stats = df.agg(
        *[x for i in range(size) for x in (F.avg(F.col(array)[i].cast("double")).alias(f"m{i}"),
                                          F.stddev_pop(F.col(array)[i].cast("double")).alias(f"s{i}"))]
    ).first()
    scaled = [(F.col(array)[i].cast("double") - stats[f"m{i}"]) / (stats[f"s{i}"] or 1.0) for i in range(size)]
    return df.select(*keep, array_to_vector(F.array(*scaled)).alias("features"))


def fit_kmeans(df: DataFrame, k: int, seed: int = SEEDS[0], steps: int = lloyd.STEPS, starts: int = 1) -> lloyd.Fit:
    """The most compact of ``starts`` fits to all rows, which share their passes."""
    return min(lloyd.fit_all(df, [(k, seed, start) for start in range(starts)], steps), key=lambda f: f.inertia)


def squared_silhouette(df: DataFrame, cluster: str = "cluster") -> float:
    """Squared-Euclidean silhouette of all rows."""
    return float(ClusteringEvaluator(featuresCol="features", predictionCol=cluster).evaluate(df))


def cluster_scatter(df: DataFrame, label: str, array: str) -> DataFrame:
    """``(label, centroid, size, scatter)``; scatter is the mean distance to the centroid.

    Centroids are map-side-combined vector means, one row per cluster; whether
    they are broadcast is left to the measured size.
    """
    numbers = F.transform(array, lambda x: x.cast("double"))
    points = df.select(label, numbers.alias("_x"))
    means = Summarizer.mean(array_to_vector("_x"))
    centers = points.groupBy(label).agg(vector_to_array(means).alias("centroid"))
    gaps = F.zip_with("_x", "centroid", lambda x, c: (x - c) * (x - c))
    distance = F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda a, b: a + b))
    joined = points.join(centers, label)
    return joined.groupBy(label).agg(
        F.max("centroid").alias("centroid"), F.count(F.lit(1)).alias("size"), F.avg(distance).alias("scatter")
    )


def davies_bouldin(df: DataFrame, label: str, array: str) -> float:
    """Mean over clusters of the worst (scatter + scatter) / distance.

    Centres meet on their dimensions, so distances are sums over a join of the centre rows and nothing but the
    mean comes to the driver.
    """
    centers = cluster_scatter(df, label, array).select(F.col(label).alias("l"), "scatter", F.posexplode("centroid").alias("d", "x"))
    other = centers.select(F.col("l").alias("r"), F.col("scatter").alias("other"), "d", F.col("x").alias("y"))
    gaps = centers.join(other, "d").where("l <> r").groupBy("l", "r").agg(
        F.sqrt(F.sum((F.col("x") - F.col("y")) ** 2)).alias("distance"), F.first(F.col("scatter") + F.col("other")).alias("spread")
    )
    worst = gaps.groupBy("l").agg(F.max(F.col("spread") / F.col("distance")).alias("worst"))
    return float(worst.agg(F.avg("worst")).first()[0])


def adjusted_rand(df: DataFrame, left: str, right: str) -> DataFrame:
    """Adjusted Rand index from the contingency table; pairs are counted, not formed."""
    cells = df.groupBy(left, right).agg(F.count(F.lit(1)).alias("n"))

    def pairs(n: Column) -> Column:
        return (n.cast("double") * (n - 1)) / 2

    inner = cells.agg(F.sum(pairs(F.col("n"))).alias("cells"), F.sum("n").alias("total"))
    rows = cells.groupBy(left).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("v")).first()["v"]
    columns = cells.groupBy(right).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("v")).first()["v"]
    expected = F.lit(float(rows)) * F.lit(float(columns)) / pairs(F.col("total"))
    best = F.lit((rows + columns) / 2)
    score = F.when(best == expected, F.lit(1.0)).otherwise((F.col("cells") - expected) / (best - expected))
    return inner.select(score.alias("adjusted_rand"))


def cluster_shares(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Size and share per cluster; the total comes from the few cluster rows."""
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size")).first()[0]
    return sizes.withColumn("share", F.col("size") / F.lit(float(total)))


def sweep(df: DataFrame, candidates: Sequence[int], *, stability: bool = True, starts: int = STARTS) -> list[dict]:
    """Diagnostics of every k over all rows of (id, features)."""
    return [row for row, _ in _swept(df, candidates, stability, starts)]


def _swept(df: DataFrame, candidates: Sequence[int], stability: bool, starts: int) -> list[tuple[dict, lloyd.Fit]]:
    """Diagnostics and fit of every k.

    All fits of the sweep (k, seed, start) take their steps in the same passes over the rows; silhouettes, scatter
    and the agreement of seeds take one more pass.  ``rows`` is what that pass has labelled.  A k that leaves a
    cluster empty has a minimum share of 0 and no stability, and no rule selects it.
    """
    seeds = SEEDS if stability else SEEDS[:1]
    found = lloyd.fit_all(df, [(k, seed, start) for k in candidates for seed in seeds for start in range(starts)])
    best = [min((f for f in found if (f.k, f.seed) == (k, seed)), key=lambda f: f.inertia) for k in candidates for seed in seeds]
    pairs = [(i * len(seeds), i * len(seeds) + j) for i in range(len(candidates)) for j in range(1, len(seeds))]
    measured, tables = lloyd.quality(df, best, pairs)
    agreement = [lloyd.rand_index(t) for t in tables]
    out = []
    for i, k in enumerate(candidates):
        fit, seen = best[i * len(seeds)], measured[i * len(seeds)]
        whole = len(fit.centers) == k and bool((fit.sizes > 0).all())
        row = {
            "k": k, "rows": seen.rows, "silhouette": seen.silhouette, "inertia": fit.inertia,
            "minimum_share": float(fit.sizes.min() / seen.rows) if whole else 0.0,
            "davies_bouldin": lloyd.davies_bouldin(fit, seen.scatter),
        }
        if stability:
            others = agreement[i * (len(seeds) - 1) : (i + 1) * (len(seeds) - 1)]
            row["stability"] = sum(others) / len(others) if whole else 0.0
        out.append((row, fit))
    return out


def choose_by_silhouette(rows: Sequence[Mapping]) -> int:
    """Stable candidates with non-trivial clusters; best silhouette, then the smaller k."""
    usable = [r for r in rows if r["minimum_share"] >= MIN_SHARE and r["stability"] >= MIN_STABILITY]
    if not usable:
        raise ContractError("No stable nontrivial segmentation; do not force risk labels")
    return max(usable, key=lambda r: (r["silhouette"], -r["k"]))["k"]


def choose_by_compactness(rows: Sequence[Mapping]) -> int:
    """Within 0.01 of the best silhouette, lowest Davies-Bouldin index, then the smaller k."""
    usable = [r for r in rows if r["minimum_share"] >= MIN_SHARE]
    if not usable:
        raise ContractError("No candidate produced clusters of at least 1% on the diagnostic sample")
    best = max(r["silhouette"] for r in usable)
    close = [r for r in usable if r["silhouette"] >= best - SILHOUETTE_TOLERANCE]
    return min(close, key=lambda r: (r["davies_bouldin"], r["k"]))["k"]


def segment_outcomes(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Customers and observed rate per segment on an assessment cohort."""
    name = F.concat(F.lit("Segment "), (F.col(cluster) + 1).cast("string"))
    return df.groupBy(name.alias("segment")).agg(
        F.count(F.lit(1)).alias("customers"), F.avg(F.col(label).cast("double")).alias("observed_rate")
    )


def segment_profiles(df: DataFrame, cluster: str, measures: Mapping[str, str]) -> DataFrame:
    """Size, share, mean of every measure and a description against the cohort.

    The cohort mean is the weighted mean of the few segment rows, read once.
    """
    sums = [x for k, c in measures.items() for x in (F.sum(F.col(c).cast("double")).alias(f"s_{k}"), F.count(c).alias(f"n_{k}"))]
    parts = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), *sums)
    whole = parts.agg(
        F.sum("size").alias("size"), *[ratio(F.sum(f"s_{k}"), F.sum(f"n_{k}")).alias(k) for k in measures]
    ).first()
    means = {f"mean_{k}": ratio(F.col(f"s_{k}"), F.col(f"n_{k}")) for k in measures}
    out = parts.withColumns(means).withColumn("percentage", F.col("size") * 100 / F.lit(float(whole["size"])))
    cohort = {k: whole[k] for k in measures}
    return out.select(cluster, "size", "percentage", *means, describe_segment(cohort).alias("description"))


def describe_segment(cohort: Mapping[str, float]) -> Column:
    """Sentence naming how a segment differs from the cohort means."""
    traits = []
    for key, text in RATIO_TRAITS:
        value, average = F.col(f"mean_{key}"), cohort[key]
        if average:
            traits.append(F.when(value >= average * 1.15, f"higher-than-cohort-average {text}")
                          .when(value <= average * 0.85, f"lower-than-cohort-average {text}"))
    for key, text, margin in MARGIN_TRAITS:
        value, average = F.col(f"mean_{key}"), cohort[key]
        traits.append(F.when(value >= average + margin, f"higher average {text}")
                      .when(value <= average - margin, f"lower average {text}"))
    windows = ["inquiries_1m", "inquiries_3m", "inquiries_12m"]
    mine = sum((F.col(f"mean_{w}") for w in windows), F.lit(0.0))
    theirs = sum(cohort[w] for w in windows)
    traits.append(F.when(mine > theirs + INQUIRY_MARGIN, "more recorded inquiry activity")
                  .when(mine + INQUIRY_MARGIN < theirs, "less recorded inquiry activity"))
    found = F.array_compact(F.array(*traits))
    near = F.lit("This segment is near cohort averages across the profiled measures.")
    return F.when(F.size(found) > 0, F.concat(F.lit("This segment has "), F.concat_ws(", ", found), F.lit("."))).otherwise(near)


def pca_projection(df: DataFrame) -> tuple[DataFrame, list[float]]:
    """Two components of all standardized (id, features) rows and their explained variance."""
    model = PCA(k=2, inputCol="features", outputCol="projected").fit(df)
    xy = vector_to_array("projected")
    points = model.transform(df).select("id", xy[0].alias("pca_1"), xy[1].alias("pca_2"))
    return points, [float(v) for v in model.explainedVariance.toArray()]


def select_and_assign(
    df: DataFrame, candidates: Sequence[int] = range(2, 8), *, rule=None, starts: int = STARTS, stability: bool = True
) -> tuple[DataFrame, lloyd.Fit, list[dict]]:
    """Choose k by a rule over the sweep of all rows of (id, features) and assign them by its fit.

    Returns ``id, cluster``, the model and the diagnostics of every k.  The default rule is ``choose_by_silhouette``;
    ``choose_by_compactness`` needs no stability.
    """
    found = _swept(df, candidates, stability, starts)
    rows = [row for row, _ in found]
    k = (rule or choose_by_silhouette)(rows)
    model = next(fit for row, fit in found if row["k"] == k)
    return model.transform(df).select("id", "cluster"), model, rows


def thinned(points: DataFrame, every: int = 4, key: str = "id") -> DataFrame:
    """Every n-th point, in key order."""
    from loanloom.operators.prefix import ranked

    return ranked(points, [key]).where(F.col("rank") % every == 0).drop("rank", "rank_total")
