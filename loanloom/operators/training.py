"""Model families, tuning, calibration and nested selection on Spark MLlib."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.errors import ContractError
from loanloom.operators.cohorts import FOLDS, class_sizes, fold_role, nested_folds, stratified_cap
from loanloom.operators.contracts import Rule, enforce, violation_counts
from loanloom.operators.evaluation import probability_losses, rank_metrics
from loanloom.operators.isotonic import IsotonicCurve, fit_isotonic
from loanloom.operators.logistic import fit_all as fit_logistics
from loanloom.operators.logistic import held_out_scores
from loanloom.operators.preparation import ModelPreparation

SEED = 42
LOGIT_CLIP = 1e-7
METHODS = ("sigmoid", "isotonic")

# Grids and ranges of the search.
GRIDS = {
    "logistic_regression": [{"C": c} for c in (0.01, 0.05, 0.2, 1.0)],
    "decision_tree": [{"maxDepth": d, "minInstancesPerNode": m} for d in (4, 6, 8) for m in (50, 200)],
    "random_forest": [
        {"maxDepth": d, "minInstancesPerNode": m, "featureSubsetStrategy": f}
        for d in (8, 12) for m in (50, 100) for f in ("sqrt", "0.3")
    ],
}
BOOSTED_RANGES = {
    "maxIter": ("int", 200, 600), "stepSize": ("log", 0.02, 0.15), "maxDepth": ("int", 3, 8),
    "minInstancesPerNode": ("int", 1, 50), "subsamplingRate": ("real", 0.6, 1.0), "featureSubsetStrategy": ("share", 0.4, 1.0),
}


def random_draws(ranges: Mapping[str, tuple], trials: int, seed: int = SEED) -> list[dict]:
    """Seeded draws from search ranges; integers inclusive, ``log`` ranges log-uniform, ``share`` as MLlib reads shares."""
    rng = random.Random(seed)
    out = []
    for _ in range(trials):
        draw = {}
        for name, (kind, low, high) in ranges.items():
            if kind == "int":
                draw[name] = rng.randint(low, high)
            elif kind == "log":
                draw[name] = low * (high / low) ** rng.random()
            elif kind == "share":
                draw[name] = f"{rng.uniform(low, high):.6f}"
            else:
                draw[name] = rng.uniform(low, high)
        out.append(draw)
    return out


def candidates(name: str, trials: int) -> list[dict]:
    if name in GRIDS:
        return GRIDS[name]
    if name == "gradient_boosted":
        return random_draws(BOOSTED_RANGES, trials)
    raise ContractError(f"Unknown model family: {name}")


def inverse_penalty(params: Mapping, rows: int) -> float:
    """C is the usual inverse penalty, converted to MLlib's per-row scale."""
    return 1.0 / (params.get("C", 1.0) * max(rows, 1))


def estimator(name: str, params: Mapping, rows: int):
    """Class-weighted estimator."""
    common = {"featuresCol": "features", "labelCol": "y", "weightCol": "w"}
    if name == "logistic_regression":
        return LogisticRegression(maxIter=100, regParam=inverse_penalty(params, rows), **common)
    if name == "decision_tree":
        return DecisionTreeClassifier(seed=SEED, **common, **params)
    if name == "random_forest":
        return RandomForestClassifier(seed=SEED, **{"numTrees": 300, **params}, **common)
    if name == "gradient_boosted":
        return GBTClassifier(seed=SEED, **common, **params)
    raise ContractError(f"Unknown model family: {name}")


def class_weight(sizes: Mapping[int, int], label: str = "y") -> Column:
    """Balanced weights from the class counts of the fitting rows only."""
    n = sum(sizes.values())
    return F.when(F.col(label) == 1, n / (2.0 * sizes[1])).otherwise(n / (2.0 * sizes[0]))


@dataclass
class Fitted:
    """A preparation and a fitted classifier; ``score`` adds the raw positive probability."""

    name: str
    params: dict
    preparation: ModelPreparation
    model: object

    def vectors(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        return self.preparation.transform(df, keep)

    def score(self, df: DataFrame, keep: Sequence[str], column: str = "raw") -> DataFrame:
        scored = self.model.transform(self.vectors(df, keep))
        return scored.select(*keep, vector_to_array("probability")[1].alias(column))


def prepare(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], extra: Sequence[str] = ()):
    """Preparation learned on the rows, their weighted vectors (cached for the iterations) and class sizes."""
    sizes = class_sizes(train, "y")
    if set(sizes) != {0, 1}:
        raise ContractError("Training requires both target classes")
    prep = ModelPreparation(numeric, categorical).fit(train)
    ready = prep.transform(train.withColumn("w", class_weight(sizes)), ["y", "w", *extra]).persist()
    return prep, ready, sizes


def fit(name: str, params: Mapping, train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Fitted:
    """Fit one family on rows with features and ``y``."""
    prep, ready, sizes = prepare(train, numeric, categorical)
    try:
        model = estimator(name, params, sum(sizes.values())).fit(ready)
    finally:
        ready.unpersist()
    return Fitted(name, dict(params), prep, model)


def search(name: str, ready: DataFrame, rows: int, options: Sequence[Mapping], fold_column: str):
    """Best option by mean ROC-AUC over given folds, with the model refitted on all rows.

    A single option needs no search; its AUC is then unknown.  Penalties of a logistic regression are searched in
    the passes of one fit.
    """
    if len(options) == 1:
        return dict(options[0]), None, estimator(name, options[0], rows).fit(ready)
    if name == "logistic_regression":
        best, auc = _best_penalty(ready, rows, options, fold_column)
        return dict(options[best]), auc, estimator(name, options[best], rows).fit(ready)
    base = estimator(name, options[0], rows)
    maps = []
    for option in options:
        tuned = estimator(name, option, rows)
        maps.append({base.getParam(p.name): v for p, v in tuned.extractParamMap().items() if tuned.isSet(p)})
    found = CrossValidator(
        estimator=base, estimatorParamMaps=maps, numFolds=FOLDS, foldCol=fold_column, parallelism=4,
        evaluator=BinaryClassificationEvaluator(labelCol="y", metricName="areaUnderROC", numBins=0),
    ).fit(ready)
    best = max(range(len(options)), key=lambda i: found.avgMetrics[i])
    return dict(options[best]), float(found.avgMetrics[best]), found.bestModel


def _best_penalty(ready: DataFrame, rows: int, options: Sequence[Mapping], fold_column: str) -> tuple[int, float]:
    """Place and mean ROC-AUC of the best option, the first among equals."""
    specs = [(place, inverse_penalty(option, rows), fold) for place, option in enumerate(options) for fold in range(FOLDS)]
    fits = fit_logistics(ready, [(penalty, fold) for _, penalty, fold in specs], fold_column)
    scores = held_out_scores(ready, fits, [place for place, _, _ in specs], fold_column)
    found = rank_metrics(scores, groups=["option", "fold"]).groupBy("option").agg(F.avg("roc_auc").alias("auc"))
    means = {r["option"]: r["auc"] for r in found.collect()}
    best = max(range(len(options)), key=lambda place: means[place])
    return best, float(means[best])


def tune(
    name: str, train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], *, trials: int = 5,
    tune_rows: int | None = None, key: str = "id", grid: Sequence[Mapping] | None = None,
) -> tuple[dict, float | None]:
    """Best parameters by three-fold ROC-AUC.

    ``tune_rows`` bounds the labelled rows of the search (the class mix is kept); the fit that follows takes all.
    Rows that bring a ``tune_fold`` column are searched by it, others get folds of their own.
    """
    rows = bounded(train, tune_rows, key)
    if "tune_fold" not in rows.columns:
        rows = rows.join(nested_folds(rows, key, "y").select(key, F.col("assess_fold").alias("tune_fold")), key)
    _, ready, sizes = prepare(rows, numeric, categorical, ["tune_fold"])
    try:
        params, auc, _ = search(name, ready, sum(sizes.values()), list(grid or candidates(name, trials)), "tune_fold")
    finally:
        ready.unpersist()
    return params, auc


def bounded(train: DataFrame, tune_rows: int | None, key: str = "id") -> DataFrame:
    """At most ``tune_rows`` labelled rows with the class mix kept; all rows without a bound."""
    if tune_rows is None:
        return train
    return train.join(stratified_cap(train, tune_rows, key, "y").select(key), key, "left_semi")


# ---------------------------------------------------------------- calibration
def clipped_logit(p: Column) -> Column:
    safe = F.least(F.greatest(p, F.lit(LOGIT_CLIP)), F.lit(1 - LOGIT_CLIP))
    return F.log(safe / (1 - safe))


@dataclass
class Calibrator:
    """Unweighted calibration learned on a disjoint cohort of natural prevalence."""

    method: str
    slope: float = 1.0
    offset: float = 0.0
    curve: IsotonicCurve | None = None

    def apply(self, df: DataFrame, raw: str = "raw", column: str = "p") -> DataFrame:
        if self.method == "sigmoid":
            margin = self.slope * clipped_logit(F.col(raw)) + self.offset
            return df.withColumn(column, 1 / (1 + F.exp(-margin)))
        return df.withColumn(column, F.least(F.greatest(self.curve.apply(F.col(raw)), F.lit(0.0)), F.lit(1.0)))


def fit_calibrator(method: str, df: DataFrame, raw: str = "raw") -> Calibrator:
    if method not in METHODS:
        raise ContractError(f"Unknown calibration: {method}")
    if set(class_sizes(df, "y")) != {0, 1}:
        raise ContractError("Calibration requires both classes")
    if method == "isotonic":
        return Calibrator("isotonic", curve=fit_isotonic(df, raw, "y"))
    rows = df.select("y", F.lit(1.0).alias("w"), array_to_vector(F.array(clipped_logit(F.col(raw)))).alias("features"))
    (curve,) = fit_logistics(rows, [(1e-9, None)])
    return Calibrator("sigmoid", float(curve.coefficients[0]), curve.intercept)


def score_batch(df: DataFrame, fitted: Fitted, calibrator: Calibrator, keep: Sequence[str], *, check: bool = False) -> DataFrame:
    """Calibrated probabilities of many rows; ``check`` also proves that all lie in [0, 1]."""
    out = calibrator.apply(fitted.score(df, keep)).drop("raw")
    if check:
        bad = ~F.coalesce(F.col("p").between(0, 1) & ~F.isnan("p"), F.lit(False))
        enforce(violation_counts(out, [Rule("Invalid calibrated output", bad)]))
    return out


# ---------------------------------------------------------------- selection
def nested_selection(
    df: DataFrame, models: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], *, trials: int = 5,
    tune_rows: int | None = None, grids: Mapping[str, Sequence[Mapping]] | None = None, folds: int = FOLDS,
) -> DataFrame:
    """Per outer fold, family and calibration: metrics on rows that fitted neither model nor calibrator.

    Rows are ranked once for outer folds, calibration slots and inner folds, and stored in as many partitions as their
    size asks for, as every step of every fit is a pass over them.
    Assessment predictions of all candidates stay narrow branches over the
    cached rows and are measured in one grouped pass at the end.  ``tune_rows`` bounds the labelled rows of the
    parameter search in each fold; the folds of the search are the same with and without that bound, and every
    model is then fitted to all base rows.
    """
    placed = df.join(nested_folds(df, "id", "y", folds).drop("y"), "id").checkpoint()
    predictions = None
    for fold in range(folds):
        role = placed.withColumn("_role", fold_role(fold))
        base, cal, assess = (role.where(F.col("_role") == r).drop("_role") for r in ("base", "calibration", "assessment"))
        prep, ready, sizes = prepare(base, numeric, categorical, ["tune_fold"])
        for name in models:
            options = list((grids or {}).get(name) or candidates(name, trials))
            if tune_rows is not None and len(options) > 1:
                params, inner = tune(name, base, numeric, categorical, tune_rows=tune_rows, grid=options)
                model = estimator(name, params, sum(sizes.values())).fit(ready)
            else:
                params, inner, model = search(name, ready, sum(sizes.values()), options, "tune_fold")
            fitted = Fitted(name, params, prep, model)
            cal_raw = fitted.score(cal, ["y"]).persist()
            for method in METHODS:
                calibrated = fit_calibrator(method, cal_raw).apply(fitted.score(assess, ["id", "y"]))
                part = calibrated.select(
                    F.lit(name).alias("model"), F.lit(method).alias("calibration"), F.lit(fold).alias("fold"),
                    F.lit(inner).cast("double").alias("inner_auc"), "y", "p",
                )
                predictions = part if predictions is None else predictions.unionByName(part)
            cal_raw.unpersist()
        ready.unpersist()
    groups = ["model", "calibration", "fold"]
    predictions = predictions.persist()  # a few numbers a row and candidate, read by three aggregates
    ranks = rank_metrics(predictions, groups=groups).select(*groups, "roc_auc", "average_precision")
    inner = predictions.groupBy(*groups).agg(F.max("inner_auc").alias("inner_auc"), F.count(F.lit(1)).alias("assessed_rows"))
    losses = probability_losses(predictions, groups=groups).select(*groups, "brier")
    out = ranks.join(losses, groups).join(inner, groups).checkpoint()  # a few rows, so that the caches can go
    predictions.unpersist()
    return out


def ablation(
    parts: Mapping[str, DataFrame], variants: Mapping[str, tuple[Sequence[str], Sequence[str]]], name: str,
    params: Mapping, method: str,
) -> list[dict]:
    """Refit with fewer features and compare on the policy cohort; diagnostic only."""
    out = []
    for label, (numeric, categorical) in variants.items():
        if not numeric and not categorical:
            continue
        fitted = fit(name, params, parts["development"], numeric, categorical)
        cal = fit_calibrator(method, fitted.score(parts["calibration"], ["y"]))
        p = cal.apply(fitted.score(parts["policy"], ["id", "y"])).persist()
        ranks = rank_metrics(p).first()
        out.append(
            {
                "variant": label, "feature_count": len(numeric) + len(categorical), "roc_auc": ranks["roc_auc"],
                "average_precision": ranks["average_precision"], "brier": probability_losses(p).first()["brier"],
                "policy_rows": p.count(),
            }
        )
        p.unpersist()
    return out
