"""Shared Newton steps against the library's classifier."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from loanloom.operators import training as T
from loanloom.operators.evaluation import rank_metrics
from loanloom.operators.logistic import fit_all, held_out_scores
from loanloom.operators.sums import array_sums


@pytest.fixture(scope="module")
def ready(spark):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(50, 12, 900), rng.lognormal(10, 1, 900), rng.integers(0, 2, 900), np.zeros(900), rng.normal(0, 1e-3, 900)])
    y = (rng.random(900) < 1 / (1 + np.exp(-(0.05 * (x[:, 0] - 50) + 0.8 * x[:, 2] - 1)))).astype(int)
    rows = [(i, r.tolist(), int(t), 2.0 if t else 0.7, i % 3) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id long, x array<double>, y int, w double, fold int").repartition(6)
    return df.withColumn("features", array_to_vector("x")).cache()


def library(df, penalty):
    return LogisticRegression(featuresCol="features", labelCol="y", weightCol="w", regParam=penalty, maxIter=1000, tol=1e-12).fit(df)


def test_coefficients_equal_the_library(spark, ready):
    specs = [(p, held) for p in (1.0, 0.05, 1e-3, 1e-6) for held in (None, 0, 2)]
    for fit in fit_all(ready, specs, "fold"):
        model = library(ready if fit.held_out is None else ready.where(F.col("fold") != fit.held_out), fit.penalty)
        spread = np.array([12, 40_000, 0.5, 1, 1e-3])  # coefficients per deviation
        assert np.abs((fit.coefficients - model.coefficients.toArray()) * spread).max() < 1e-4
        assert abs(fit.intercept - model.intercept) < 1e-3
        assert fit.coefficients[3] == 0 and fit.steps < 30


def test_probability_is_the_librarys(spark, ready):
    (fit,) = fit_all(ready, [(0.01, None)])
    both = library(ready, 0.01).transform(ready).select(
        fit.probability(F.col("x")).alias("own"), F.element_at(T.vector_to_array("probability"), 2).alias("p"))
    assert both.agg(F.max(F.abs(F.col("own") - F.col("p")))).first()[0] < 1e-5


def test_every_row_is_scored_by_fits_that_have_not_seen_it(spark, ready):
    fits = fit_all(ready, [(p, held) for p in (1.0, 0.01) for held in range(3)], "fold")
    scores = held_out_scores(ready, fits, [0, 0, 0, 1, 1, 1], "fold")
    assert scores.count() == 2 * ready.count()
    got = {(r["option"], r["fold"]): r["roc_auc"] for r in rank_metrics(scores, groups=["option", "fold"]).collect()}
    for option, penalty in enumerate((1.0, 0.01)):
        for held in range(3):
            model = library(ready.where(F.col("fold") != held), penalty)
            p = model.transform(ready.where(F.col("fold") == held)).select("y", F.element_at(T.vector_to_array("probability"), 2).alias("p"))
            assert got[option, held] == pytest.approx(rank_metrics(p).first()["roc_auc"], abs=1e-6)


def test_search_takes_the_same_penalty_as_fits_one_by_one(spark, ready):
    rows, options = ready.count(), T.GRIDS["logistic_regression"]
    params, auc, model = T.search("logistic_regression", ready, rows, options, "fold")
    means = []
    for option in options:
        parts = []
        for held in range(3):
            fitted = T.estimator("logistic_regression", option, rows).fit(ready.where(F.col("fold") != held))
            p = fitted.transform(ready.where(F.col("fold") == held)).select("y", F.element_at(T.vector_to_array("probability"), 2).alias("p"))
            parts.append(rank_metrics(p).first()["roc_auc"])
        means.append(sum(parts) / 3)
    assert auc == pytest.approx(max(means), abs=1e-4)
    assert means[options.index(params)] == pytest.approx(max(means), abs=1e-4)
    assert model.coefficients.size == 5


def test_sums_over_many_tasks(spark):
    df = spark.range(1000).repartition(50)
    found = array_sums(df, lambda batch: iter([(0, np.array([batch.num_rows, sum(batch["id"].to_pylist())])), (7, np.ones(3))]))
    assert found[0].tolist() == [1000, 499500] and found[7][0] >= 40


def test_no_rows(spark, ready):
    with pytest.raises(ValueError, match="rows"):
        fit_all(ready.limit(0), [(1.0, None)])
