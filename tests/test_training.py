"""Training, calibration and explanation invariants on the smallest useful tables."""

import json

import pytest
from pyspark.sql import functions as F

from loanloom import ContractError
from loanloom.operators import explain as X
from loanloom.operators import training as T
from loanloom.operators.application import BASE_NUMERIC, CATEGORICAL
from loanloom.plans import training_run, views
from loanloom.plans.scoring import score_applications, stored_release
from loanloom.plans.training_queries import labeled

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    df = labeled(spark, SF).persist()
    df.count()
    return df


@pytest.fixture(scope="module")
def linear(rows):
    return T.fit("logistic_regression", {"C": 1.0}, rows, BASE_NUMERIC, CATEGORICAL)


def test_attribution_adds_up(rows, linear):
    parts = X.linear_contributions(linear, rows, X.background_means(linear, rows), ["id"])
    assert X.additivity_error(parts).first()[0] < 1e-8
    names = {c[2:] for c in parts.columns if c.startswith("c_")}
    assert names == {*BASE_NUMERIC, *CATEGORICAL}
    top = X.top_contributions(parts, ["id"], 3).first()
    values = [x["contribution"] for x in top.increases_risk]
    assert len(values) <= 3 and values == sorted(values, reverse=True) and all(v > 0 for v in values)


@pytest.mark.parametrize(("name", "params"), [
    ("decision_tree", {"maxDepth": 5}), ("random_forest", {"maxDepth": 5, "numTrees": 7}), ("gradient_boosted", {"maxIter": 6, "maxDepth": 3})])
def test_path_attribution_adds_up_and_follows_the_path(rows, name, params):
    fitted = T.fit(name, params, rows, BASE_NUMERIC, CATEGORICAL)
    parts = X.tree_contributions(fitted, rows, ["id"])
    assert parts.count() == rows.count()
    assert X.additivity_error(parts).first()[0] < 1e-9
    p = fitted.score(rows, ["id"], "p").join(parts.select("id", "margin"), "id")
    same = F.col("margin") if name != "gradient_boosted" else 1 / (1 + F.exp(-2 * F.col("margin")))
    assert p.agg(F.max(F.abs(F.col("p") - same))).first()[0] < 1e-9
    if name == "decision_tree":  # only features on some path have a share
        used = {fitted.preparation.origins()[fitted.preparation.names()[i]] for i in fitted.model.featureImportances.indices}
        shares = {r["feature"] for r in X.global_importance(parts).where("mean_absolute_contribution > 0").collect()}
        assert shares == used


def test_path_attribution_needs_trees(rows, linear):
    with pytest.raises(ContractError):
        X.tree_contributions(linear, rows, ["id"])


def test_calibrated_probabilities(rows, linear):
    raw = linear.score(rows, ["id", "y"])
    prevalence = rows.agg(F.avg("y")).first()[0]
    for method in T.METHODS:
        p = T.fit_calibrator(method, raw).apply(raw)
        got = p.agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.avg("p").alias("mean")).first()
        assert 0 <= got.lo <= got.hi <= 1 and got.mean == pytest.approx(prevalence, abs=0.01)
    with pytest.raises(ContractError):
        T.fit_calibrator("platt", raw)


def test_one_class_is_refused(rows):
    with pytest.raises(ContractError):
        T.fit("decision_tree", {}, rows.where("y = 0"), BASE_NUMERIC, CATEGORICAL)


def test_random_draws_are_seeded_and_inside():
    draws = T.random_draws(T.BOOSTED_RANGES, 20)
    assert draws == T.random_draws(T.BOOSTED_RANGES, 20)
    for d in draws:
        assert 200 <= d["maxIter"] <= 600 and 0.4 <= float(d["featureSubsetStrategy"]) <= 1 and 0.02 <= d["stepSize"] <= 0.15 and 0.6 <= d["subsamplingRate"] <= 1


def test_release_round_trip(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    views.raw_applications(spark, SF).coalesce(1).write.parquet(str(raw / "application_train.parquet"))
    (raw / "adapter_manifest.json").write_text(json.dumps({
        "annuity_monthly_verified": True, "category_mapping_verified": True, "cash_product_verified": True, "currency": "XXX", "evidence": "test"}))
    root = str(tmp_path / "out")
    grids = {"decision_tree": [{"maxDepth": 3, "minInstancesPerNode": 20}]}
    run_id = training_run.run(spark, str(raw), root, models=["decision_tree"], grids=grids)
    fitted, calibrator, meta = training_run.load_release(spark, root)
    assert meta["run_id"] == run_id and meta["release_ready"] is False and 0 < meta["test_metrics"]["roc_auc"] <= 1
    stored = training_run.RunDirectory(spark, root).read("test_predictions")
    again = T.score_batch(labeled(spark, SF).join(stored.select("id"), "id", "left_semi"), fitted, calibrator, ["id"])
    gap = again.join(stored.select("id", F.col("p").alias("q")), "id").agg(F.max(F.abs(F.col("p") - F.col("q"))), F.count(F.lit(1))).first()
    assert gap[0] < 1e-12 and gap[1] == stored.count()
    scored = score_applications(views.raw_applications(spark, SF), stored_release(spark, root))
    whole = scored.agg(F.count(F.lit(1)), F.count("reason"), F.count("calibrated_pd"), F.count("reference_percentile")).first()
    assert whole[0] == views.raw_applications(spark, SF).count() and whole[0] - whole[1] == whole[2] == whole[3]
    both = scored.join(stored.select(F.col("id").alias("SK_ID_CURR"), "p"), "SK_ID_CURR")
    assert both.agg(F.max(F.abs(F.col("calibrated_pd") - F.col("p")))).first()[0] < 1e-12
    assert scored.where("reason is not null and (recommendation <> 'MANUAL_REVIEW' or array_position(reason_codes, reason) = 0)").isEmpty()
    assert scored.where("model_version <> '%s' or decision_status <> 'MANUAL_REVIEW'" % run_id).isEmpty()
    with pytest.raises(ContractError):
        training_run.run(spark, str(raw), root, models=["unknown"])
