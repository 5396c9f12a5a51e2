"""Exact evaluation of probability scores without a global sort."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.functions.binning import inner_edges_below
from loanloom.functions.finance import risk_band
from loanloom.functions.nullsafe import ratio
from loanloom.functions.reshape import long_rows
from loanloom.operators.prefix import PART, quantile_edges, range_sorted, running_sums

# Fixed values: (approve below, reject at) pairs of the policy table.
POLICY_PAIRS = ((0.03, 0.10), (0.05, 0.15), (0.07, 0.20))
REPLICATES = 200


def score_groups(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row per distinct score with its positive and negative counts."""
    return df.groupBy(F.col(score).alias("p")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


def score_ladder(df: DataFrame, score: str = "p", label: str = "y", groups: Sequence[str] = ()) -> DataFrame:
    """Distinct scores from high to low with running true and false positives."""
    counted = df.groupBy(*groups, F.col(score).alias("p")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    keyed = counted.withColumn("_down", -F.col("p"))
    return running_sums(keyed, ["_down"], {"tp": "pos", "fp": "neg"}, groups).drop("_down")


def rank_metrics(df: DataFrame, score: str = "p", label: str = "y", groups: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC, Gini, KS and step-wise average precision from one pass over the ladder."""
    ladder = score_ladder(df, score, label, groups)
    tp, fp, positives, negatives = (F.col(c) for c in ("tp", "fp", "tp_total", "fp_total"))
    doubled = F.col("neg") * (2 * (tp - F.col("pos")) + F.col("pos"))
    gain = F.col("pos") * ratio(tp, tp + fp)
    folded = ladder.groupBy(*groups).agg(
        F.sum(doubled.cast("decimal(38,0)")).alias("_pairs"),
        F.max(ratio(tp, positives) - ratio(fp, negatives)).alias("ks"),
        F.sum(gain).alias("_gain"),
        F.max(positives).alias("positives"),
        F.max(negatives).alias("negatives"),
    )
    pairs = 2.0 * F.col("positives") * F.col("negatives")
    auc = ratio(F.col("_pairs"), pairs)
    # the curve starts at (0, 0), so the distance is never below zero
    return folded.select(
        *groups, "positives", "negatives", auc.alias("roc_auc"), (2 * auc - 1).alias("gini"),
        F.greatest(F.col("ks"), F.lit(0.0)).alias("ks"),
        ratio(F.col("_gain"), F.col("positives")).alias("average_precision"),
    )


def _clipped(p: Column, eps: float) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def probability_losses(
    df: DataFrame, score: str = "p", label: str = "y", eps: float = 1e-6, groups: Sequence[str] = ()
) -> DataFrame:
    y, p = F.col(label), F.col(score)
    safe = _clipped(p, eps)
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(-F.when(y == 1, F.log(safe)).otherwise(F.log(1 - safe))).alias("log_loss"),
    )


def threshold_metrics(df: DataFrame, threshold: float, score: str = "p", label: str = "y") -> DataFrame:
    """Accuracy, precision, recall and F1 at one threshold; empty denominators give zero."""
    flagged, bad = F.col(score) >= threshold, F.col(label) == 1
    counts = df.agg(
        F.count_if(flagged & bad).alias("tp"), F.count_if(flagged & ~bad).alias("fp"),
        F.count_if(~flagged & bad).alias("fn"), F.count_if(~flagged & ~bad).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    return counts.select(
        "tp", "fp", "fn", "tn",
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        F.coalesce(ratio(tp, tp + fp), zero).alias("precision"),
        F.coalesce(ratio(tp, tp + fn), zero).alias("recall"),
        F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), zero).alias("f1"),
    )


def evaluate(df: DataFrame, threshold: float = 0.15, score: str = "p", label: str = "y") -> dict[str, float]:
    """All headline metrics of one prediction set as numbers."""
    ranks = rank_metrics(df, score, label).first().asDict()
    losses = probability_losses(df, score, label).first().asDict()
    at = threshold_metrics(df, threshold, score, label).first().asDict()
    return {**ranks, **losses, **{k: at[k] for k in ("accuracy", "precision", "recall", "f1")}}


def calibration_bins(df: DataFrame, bins: int = 10, score: str = "p", label: str = "y") -> DataFrame:
    """Mean prediction and observed rate in quantile bins; empty bins are dropped."""
    edges = quantile_edges(df, score, [i / bins for i in range(bins + 1)])
    binned = df.withColumn("bin", inner_edges_below(F.col(score), edges))
    return binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(score).alias("mean_predicted_probability"),
        F.avg(F.col(label).cast("double")).alias("observed_rate"),
    )


def baselines(df: DataFrame, prevalence: Column, label: str = "y") -> DataFrame:
    """What a constant prevalence and an always-zero classifier would score."""
    y = F.col(label).cast("double")
    return df.agg(
        F.avg(y).alias("average_precision"),
        F.avg((prevalence - y) * (prevalence - y)).alias("brier"),
        (1 - F.avg(y)).alias("accuracy_always_zero"),
    )


def policy_table(
    df: DataFrame, pairs: Sequence[tuple[float, float]] = POLICY_PAIRS, score: str = "p", label: str = "y"
) -> DataFrame:
    """Count, share and observed rate of the three decision groups for every threshold pair.

    All groups of all pairs are conditional sums of one aggregate; rows are not multiplied.
    """
    p, y = F.col(score), F.col(label)
    groups = []
    for a, r in pairs:
        groups += [
            (a, r, "approval_candidate", p < a),
            (a, r, "review", (p >= a) & (p < r)),
            (a, r, "rejection_candidate", p >= r),
        ]
    totals = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(m).alias(f"n{i}") for i, (_, _, _, m) in enumerate(groups)],
        *[F.count_if(m & (y == 1)).alias(f"b{i}") for i, (_, _, _, m) in enumerate(groups)],
    )
    return long_rows(
        totals,
        [
            {
                "approve_below": F.lit(a), "reject_at": F.lit(r), "group_name": F.lit(g), "n_rows": F.col(f"n{i}"),
                "share": ratio(F.col(f"n{i}"), F.col("n")), "observed_rate": ratio(F.col(f"b{i}"), F.col(f"n{i}")),
            }
            for i, (a, r, g, _) in enumerate(groups)
        ],
    )


def band_outcomes(df: DataFrame, score: str = "p", label: str = "y") -> DataFrame:
    return df.groupBy(risk_band(F.col(score)).alias("band")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.col(label).cast("double")).alias("observed_rate"),
        F.avg(score).alias("mean_pd"),
    )


def reference_percentile(probes: DataFrame, reference: DataFrame, score: str = "p") -> DataFrame:
    """Percent of reference scores at or below each probe score.

    Both sides meet as distinct scores in one ordered prefix count; probes then
    pick their value up by equality, never by a range join.
    """
    marked = reference.select(F.col(score).alias("_s"), F.lit(1).alias("_w")).unionByName(
        probes.select(F.col(score).alias("_s"), F.lit(0).alias("_w"))
    )
    counted = marked.groupBy("_s").agg(F.sum("_w").alias("_w"))
    upto = running_sums(counted, ["_s"], {"_below": "_w"})
    placed = upto.select(F.col("_s").alias(score), (100.0 * F.col("_below") / F.col("_below_total")).alias("reference_percentile"))
    return probes.join(placed, score)


def paired_mismatch(left: DataFrame, right: DataFrame, key: str = "id", label: str = "y") -> DataFrame:
    """Identity and label agreement of two prediction sets of the same cohort."""
    a = left.select(key, F.col(label).alias("_a"), F.lit(1).alias("_in_left"))
    b = right.select(key, F.col(label).alias("_b"), F.lit(1).alias("_in_right"))
    both = a.join(b, key, "full")
    return both.agg(
        F.count_if(F.col("_in_right").isNull()).alias("only_left"),
        F.count_if(F.col("_in_left").isNull()).alias("only_right"),
        F.count_if(F.col("_a") != F.col("_b")).alias("label_mismatch"),
        F.count_if(F.col("_a") == F.col("_b")).alias("paired"),
    )


def paired_comparison(df: DataFrame, scores: dict[str, str], label: str = "y") -> DataFrame:
    """Metrics of several models on the same rows: one row per model.

    Rows are widened to (model, score) once; every metric then aggregates per model.
    """
    models = [F.struct(F.lit(m).alias("model"), F.col(c).alias("p")) for m, c in scores.items()]
    long = df.select(F.col(label).alias("y"), F.explode(F.array(*models)).alias("_m")).select("y", "_m.model", "_m.p")
    ranks = rank_metrics(long, "p", "y", ["model"])
    losses = probability_losses(long, "p", "y", 1e-7, ["model"])
    return ranks.join(losses, "model").select("model", "roc_auc", "average_precision", "brier", "log_loss")


def metric_deltas(comparison: DataFrame, base: str, other: str) -> DataFrame:
    """``other`` minus ``base`` for every metric, as ``(metric, delta)``."""
    names = ["roc_auc", "average_precision", "brier", "log_loss"]

    def of(model: str, name: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col(name)))

    wide = comparison.agg(*[(of(other, n) - of(base, n)).alias(n) for n in names])
    return long_rows(wide, [{"metric": F.lit(n), "delta": F.col(n)} for n in names])


def bootstrap_intervals(
    df: DataFrame, score: str = "p", label: str = "y", replicates: int = REPLICATES, seed: int = 42
) -> DataFrame:
    """95% Poisson-bootstrap intervals of AUC, average precision and Brier score; ``n_rows`` were drawn from.

    Resampling n equal rows draws Poisson(n), so replicates are drawn per
    distinct score and class, from generators keyed by them: the interval is
    the same on every cluster.  The ladder is range-sorted and stored once; both passes
    stream its partitions in order and keep only one running total per
    replicate, so the replicates never multiply the shuffled rows.  The driver
    sees ``partitions x replicates`` totals.
    """
    ladder = score_groups(df, score, label).withColumn("_down", -F.col("p"))
    placed = range_sorted(ladder, ["_down"]).select(PART, "p", "pos", "neg")

    def draws(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Draws of each score and class, from a generator of their own: the same in any partition."""
        drawn = np.zeros((2, len(batch), replicates))
        for side, name in enumerate(("pos", "neg")):
            for i, (p, rate) in enumerate(zip(batch["p"].to_numpy(float), batch[name].to_numpy(float), strict=True)):
                if rate:
                    key = [int(np.float64(p).view(np.uint64)), seed * 2 + side]
                    drawn[side, i] = np.random.Generator(np.random.Philox(key=np.array(key, np.uint64))).poisson(rate, replicates)
        return drawn[0], drawn[1]

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, rows = None, np.zeros(replicates)
        pos, neg, brier = (np.zeros(replicates) for _ in range(3))
        for batch in batches:
            if batch.empty:
                continue
            part = int(batch[PART].iloc[0])
            a, b = draws(batch)
            rows[0] += batch["pos"].sum() + batch["neg"].sum()
            p = batch["p"].to_numpy()[:, None]
            pos, neg = pos + a.sum(0), neg + b.sum(0)
            brier = brier + (a * (1 - p) ** 2 + b * p**2).sum(0)
        if part is not None:
            yield pd.DataFrame({PART: part, "rep": range(replicates), "pos": pos, "neg": neg, "brier": brier, "rows": rows})

    sums = placed.mapInPandas(totals, f"{PART} int, rep int, pos double, neg double, brier double, rows double").toPandas()
    sums = sums.sort_values(["rep", PART])
    before = sums.groupby("rep")[["pos", "neg"]].cumsum() - sums[["pos", "neg"]]
    sums[["pos_before", "neg_before"]] = before
    shifts = {int(k): (g["pos_before"].to_numpy(), g["neg_before"].to_numpy()) for k, g in sums.groupby(PART)}
    shared = df.sparkSession.sparkContext.broadcast(shifts)

    def contributions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = None
        area, gain = np.zeros(replicates), np.zeros(replicates)
        for batch in batches:
            if batch.empty:
                continue
            if part is None:
                part = int(batch[PART].iloc[0])
                tp0, fp0 = shared.value[part]
            a, b = draws(batch)
            tp, fp = tp0 + a.cumsum(0), fp0 + b.cumsum(0)
            area = area + (b * (tp - a / 2)).sum(0)
            with np.errstate(invalid="ignore", divide="ignore"):
                gain = gain + np.where(a > 0, a * tp / (tp + fp), 0.0).sum(0)
            tp0, fp0 = tp[-1], fp[-1]
        if part is not None:
            yield pd.DataFrame({"rep": range(replicates), "area": area, "gain": gain})

    parts = placed.mapInPandas(contributions, "rep int, area double, gain double")
    per_rep = parts.groupBy("rep").agg(F.sum("area").alias("area"), F.sum("gain").alias("gain"))
    whole = sums.groupby("rep", as_index=False)[["pos", "neg", "brier"]].sum()
    joined = per_rep.join(df.sparkSession.createDataFrame(whole), "rep").where("pos > 0 and neg > 0")
    metrics = joined.select(
        ratio(F.col("area"), F.col("pos") * F.col("neg")).alias("roc_auc"),
        ratio(F.col("gain"), F.col("pos")).alias("average_precision"),
        ratio(F.col("brier"), F.col("pos") + F.col("neg")).alias("brier"),
    )
    names = ["roc_auc", "average_precision", "brier"]
    wide = metrics.agg(*[F.percentile(n, F.array(F.lit(0.025), F.lit(0.975))).alias(n) for n in names])
    return long_rows(
        wide, [
            {"metric": F.lit(n), "lower": F.col(n)[0], "upper": F.col(n)[1], "n_rows": F.lit(int(sums["rows"].sum())).cast("bigint")}
            for n in names
        ]
    )
