"""Model release: features, cohorts, nested selection, refit, calibration, one look at the test cohort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.errors import ContractError
from loanloom.operators import evaluation as E
from loanloom.operators import training as T
from loanloom.operators.application import CATEGORICAL, ID, LABEL, LITE
from loanloom.operators.cohorts import class_sizes, split_cohorts
from loanloom.operators.isotonic import IsotonicCurve
from loanloom.operators.ledger import leaderboard
from loanloom.operators.preparation import ModelPreparation
from loanloom.operators.risk import Policy, support_statistics
from loanloom.plans.readiness import feature_table
from loanloom.sources.sinks import RunDirectory

FAMILIES = ("logistic_regression", "decision_tree", "random_forest", "gradient_boosted")
MIN_DEVELOPMENT = 12


def cohort_parts(universe: DataFrame, rows: DataFrame) -> dict[str, DataFrame]:
    """Rows per cohort; cohorts are cut on the universe shared by all contracts."""
    tagged = rows.join(split_cohorts(universe).select("id", "cohort"), "id").persist()
    return {c: tagged.where(F.col("cohort") == c).drop("cohort") for c in ("development", "calibration", "policy", "test")}


def run(
    spark: SparkSession, raw: str, root: str, *, variant: str = "lite", models: Sequence[str] = FAMILIES, trials: int = 5,
    max_rows: int | None = None, tune_rows: int | None = 60_000, grids: Mapping[str, Sequence[Mapping]] | None = None,
) -> str:
    """Train and publish one research release; returns its run id.

    ``tune_rows`` bounds the labelled rows of each parameter search and ``max_rows`` those of the development cohort;
    calibration, policy and test cohorts are never cut.
    """
    if trials < 1 or (tune_rows is not None and tune_rows < 20) or (max_rows is not None and max_rows < 100):
        raise ContractError("Positive trials, tune_rows>=20 and max_rows>=100 required")
    if not models or set(models) - set(FAMILIES):
        raise ContractError("Unknown model selection")

    def labeled(kind: str) -> DataFrame:
        table = feature_table(spark, raw, f"{root}/processed", kind).where("IS_TRAIN = 1")
        return table.drop("IS_TRAIN").withColumnRenamed(ID, "id").withColumnRenamed(LABEL, "y")

    rows = labeled(variant)
    universe = (labeled("lite") if variant != "lite" else rows).select("id", "y")
    features = [c for c in rows.columns if c not in ("id", "y")]
    numeric = [c for c in features if c not in CATEGORICAL]
    parts = cohort_parts(universe, rows)
    development = T.bounded(parts["development"], max_rows)
    if min(class_sizes(development, "y").values()) < MIN_DEVELOPMENT:
        raise ContractError("Development cohort too small for nested model/calibrator selection")

    folds = T.nested_selection(development, models, numeric, CATEGORICAL, trials=trials, tune_rows=tune_rows, grids=grids).persist()
    ranking = leaderboard(folds, ("brier", "roc_auc", "average_precision")).persist()
    winner = ranking.where("rank = 1").first()
    name, method = winner["model"], winner["calibration"]

    # frozen choice: refit on development, calibrate on its own cohort, describe on policy
    options = list((grids or {}).get(name) or T.candidates(name, trials))
    params, auc = (dict(options[0]), None) if len(options) == 1 else T.tune(
        name, development, numeric, CATEGORICAL, tune_rows=tune_rows, grid=options)
    fitted = T.fit(name, params, development, numeric, CATEGORICAL)
    calibrator = T.fit_calibrator(method, fitted.score(parts["calibration"], ["y"]))
    reference = T.score_batch(parts["calibration"], fitted, calibrator, ["id", "y"], check=True)
    policy_cohort = T.score_batch(parts["policy"], fitted, calibrator, ["id", "y"], check=True)

    # only the frozen champion sees the test cohort
    test = T.score_batch(parts["test"], fitted, calibrator, ["id", "y"], check=True).persist()
    prevalence = development.agg(F.avg(F.col("y").cast("double"))).first()[0]
    metrics = E.evaluate(test)
    baseline = E.baselines(test, F.lit(prevalence)).first().asDict()
    intervals = {r["metric"]: [r["lower"], r["upper"]] for r in E.bootstrap_intervals(test).collect()}
    support = support_statistics(development, [c for c in numeric if c in LITE])

    directory = RunDirectory(spark, root)
    run_id = directory.start()
    fitted.model.write().save(f"{directory.path(run_id)}/model")
    metadata = {
        "feature_set": variant, "mode": "RESEARCH", "release_ready": False, "best_model": name, "params": params,
        "calibration": {"method": method, "slope": calibrator.slope, "offset": calibrator.offset}, "tuning_auc": auc,
        "feature_columns": features, "medians": fitted.preparation.medians, "support": support, "policy": Policy().version,
        "test_metrics": metrics, "baseline": baseline, "bootstrap_95pct": intervals,
    }
    if calibrator.curve is not None:
        points = spark.createDataFrame(calibrator.curve.points, "score double, value double")
        points.coalesce(1).write.parquet(f"{directory.path(run_id)}/isotonic")
    directory.publish(
        run_id, metadata,
        {
            "splits": split_cohorts(universe), "development_folds": folds, "model_comparison": ranking,
            "policy_validation": E.policy_table(policy_cohort), "risk_bands": E.band_outcomes(test),
            "calibration_bins": E.calibration_bins(test), "reference_predictions": reference, "test_predictions": test,
        },
    )
    return run_id


def load_release(spark: SparkSession, root: str, run_id: str | None = None) -> tuple[T.Fitted, T.Calibrator, dict]:
    """Fitted model, calibrator and metadata of a published run."""
    from pyspark.ml.classification import (
        DecisionTreeClassificationModel, GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel,
    )

    from loanloom.sources import files

    directory = RunDirectory(spark, root)
    base = directory.path(run_id or directory.latest())
    meta = files.read_json(spark, f"{base}/metadata.json")
    loaders = {
        "logistic_regression": LogisticRegressionModel, "decision_tree": DecisionTreeClassificationModel,
        "random_forest": RandomForestClassificationModel, "gradient_boosted": GBTClassificationModel,
    }
    features = meta["feature_columns"]
    prep = ModelPreparation([c for c in features if c not in CATEGORICAL], CATEGORICAL, meta["medians"])
    fitted = T.Fitted(meta["best_model"], meta["params"], prep, loaders[meta["best_model"]].load(f"{base}/model"))
    c = meta["calibration"]
    curve = None
    if c["method"] == "isotonic":  # its points are bounded by the resolution of scores
        stored = spark.read.parquet(f"{base}/isotonic").orderBy("score").collect()
        curve = IsotonicCurve([(r["score"], r["value"]) for r in stored])
    return fitted, T.Calibrator(c["method"], c["slope"], c["offset"], curve), meta
