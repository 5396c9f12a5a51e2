"""Isotonic blocks against plain pooling, the library and the definition."""

import random

import numpy as np
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from loanloom.operators.isotonic import RESOLUTION, blocks, evaluate, fit_isotonic, pool


def plain(scores, labels):
    """Value of every distinct score by repeated merging of the first violating pair."""
    groups = [[x, [y for s, y in zip(scores, labels, strict=True) if s == x]] for x in sorted(set(scores))]
    merged = [([x], list(ys)) for x, ys in groups]
    while True:
        at = next((i for i in range(len(merged) - 1) if np.mean(merged[i][1]) >= np.mean(merged[i + 1][1])), None)
        if at is None:
            return {x: float(np.mean(ys)) for xs, ys in merged for x in xs}
        merged[at : at + 2] = [(merged[at][0] + merged[at + 1][0], merged[at][1] + merged[at + 1][1])]


def frame(spark, scores, labels, parts=7):
    return spark.createDataFrame(list(zip(scores, labels, strict=True)), "s double, y int").repartition(parts)


@pytest.mark.parametrize("seed", range(4))
def test_equal_to_plain_pooling(spark, seed):
    rng = random.Random(seed)
    scores = [round(rng.random(), 2 + seed) for _ in range(400)]
    labels = [int(rng.random() < (s if seed % 2 else 1 - s) * 0.7) for s in scores]
    want = plain(scores, labels)
    found = blocks(frame(spark, scores, labels), "s", "y")
    got = {x: v for x in want for low, high, v in found if low - 0.5 / RESOLUTION <= x <= high + 0.5 / RESOLUTION}
    assert got.keys() == want.keys()
    assert all(abs(got[x] - want[x]) < 1e-12 for x in want)
    assert (np.diff(found[:, 2]) > 0).all()


def test_parts_pool_to_the_whole():
    rng = np.random.default_rng(5)
    x, y = np.sort(rng.random(600)), rng.random(600).round(2)
    one = np.ones(600)
    whole = pool(x, x, one, y)
    for cut in (1, 200, 599):
        left, right = pool(x[:cut], x[:cut], one[:cut], y[:cut]), pool(x[cut:], x[cut:], one[cut:], y[cut:])
        joined = pool(*(np.concatenate(p) for p in zip(left, right, strict=True)))
        assert all(np.allclose(a, b, rtol=0, atol=1e-9) for a, b in zip(joined, whole, strict=True))


def test_curve_equals_the_library(spark):
    rng = random.Random(9)
    scores = [round(rng.random(), 4) for _ in range(1500)]
    df = frame(spark, scores, [int(rng.random() < s) for s in scores]).cache()
    curve = fit_isotonic(df, "s", "y")
    model = IsotonicRegression(featuresCol="s", labelCol="d", predictionCol="p").fit(df.withColumn("d", F.col("y").cast("double")))
    both = model.transform(spark.range(1001).select((F.col("id") / 1000).alias("s"))).withColumn("own", curve.apply(F.col("s")))
    assert both.agg(F.max(F.abs(F.col("own") - F.col("p")))).first()[0] < 1e-9
    asked = [0.0, 0.123456, 0.5, 1.0]
    rows = spark.createDataFrame([(a,) for a in asked], "s double").select(curve.apply(F.col("s")).alias("p")).collect()
    assert np.allclose([r["p"] for r in rows], evaluate(curve.points, asked))


def test_edges(spark):
    df = spark.createDataFrame([(0.2, 1), (0.2, 0), (None, 1), (float("nan"), 1), (0.9, None)], "s double, y int")
    assert blocks(df, "s", "y").tolist() == [[0.2, 0.2, 0.5]]
    out = spark.createDataFrame([(0.0,), (0.2,), (1.0,), (1.5,), (-1.0,), (None,)], "s double")
    curve = fit_isotonic(df, "s", "y")
    assert [r[0] for r in out.select(curve.apply(F.col("s"))).collect()] == [0.5, 0.5, 0.5, 0.5, 0.5, None]
    with pytest.raises(ValueError, match="labelled"):
        fit_isotonic(df.limit(0), "s", "y")


def test_scoring_has_no_python(spark):
    df = frame(spark, [0.1, 0.4, 0.8], [0, 1, 1])
    plan = df.select(fit_isotonic(df, "s", "y").apply(F.col("s")).alias("p"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
