"""K-Means fits that share their passes, against plain steps and the library."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from loanloom.operators import lloyd
from loanloom.operators import segmentation as S


def frame(spark, rows, parts=5):
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id long, x array<double>")
    return df.select("id", array_to_vector("x").alias("features")).repartition(parts)


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(3)
    return np.concatenate([rng.normal(m, 0.6, (250, 3)) for m in ([0, 0, 0], [6, 0, 1], [0, 7, 2], [5, 5, 5])])


def plain_inertia(rows, centers):
    return float(((rows[:, None] - centers[None]) ** 2).sum(2).min(1).sum())


def test_fits_settle_where_plain_steps_do(spark, blobs):
    specs = [(k, seed, start) for k in (1, 2, 4, 6) for seed in (42, 43) for start in (0, 1)]
    fits = lloyd.fit_all(frame(spark, blobs), specs)
    assert [(f.k, f.seed, f.start) for f in fits] == specs
    for fit in fits:
        assert len(fit.centers) == fit.k and fit.sizes.sum() == len(blobs)
        assert fit.inertia == pytest.approx(plain_inertia(blobs, fit.centers), rel=1e-9)
        nearest = ((blobs[:, None] - fit.centers[None]) ** 2).sum(2).argmin(1)
        moved = np.array([blobs[nearest == j].mean(0) for j in range(fit.k)])
        assert np.abs(moved - fit.centers).max() < 1e-3 and fit.steps < lloyd.STEPS


def test_as_compact_as_the_library(spark, blobs):
    df = frame(spark, blobs).cache()
    for k in (2, 3, 4, 5, 7):
        own = S.fit_kmeans(df, k, starts=5).inertia
        theirs = min(KMeans(k=k, seed=42 + 1000 * s, maxIter=150, featuresCol="features").fit(df).summary.trainingCost for s in range(5))
        assert own <= theirs * 1.001


def test_partitions_do_not_matter(spark, blobs):
    one, many = (lloyd.fit_all(frame(spark, blobs, parts), [(4, 42, 0), (3, 7, 1)]) for parts in (1, 9))
    for a, b in zip(one, many, strict=True):
        assert np.allclose(a.centers, b.centers)


def test_quality_equals_the_library_and_the_definitions(spark, blobs):
    df = frame(spark, blobs).cache()
    fits = lloyd.fit_all(df, [(2, 42, 0), (4, 42, 0), (4, 43, 0), (6, 44, 0)])
    measured, tables = lloyd.quality(df, fits, [(1, 2), (1, 3)])
    for fit, seen in zip(fits, measured, strict=True):
        labeled = fit.transform(df).cache()
        assert seen.rows == len(blobs)
        assert seen.silhouette == pytest.approx(ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(labeled), abs=1e-9)
        arrays = labeled.select("cluster", vector_to_array("features").alias("x"))
        assert lloyd.davies_bouldin(fit, seen.scatter) == pytest.approx(S.davies_bouldin(arrays, "cluster", "x"), abs=1e-9)
        assert [r["count"] for r in labeled.groupBy("cluster").count().orderBy("cluster").collect()] == fit.sizes.tolist()
    for (a, b), table in zip([(1, 2), (1, 3)], tables, strict=True):
        both = fits[a].transform(df).select("id", F.col("cluster").alias("l")).join(fits[b].transform(df).select("id", F.col("cluster").alias("r")), "id")
        assert lloyd.rand_index(table) == pytest.approx(S.adjusted_rand(both, "l", "r").first()[0], abs=1e-12)


def test_few_different_rows(spark):
    rows = np.array([[1.0, 1.0]] * 500 + [[2.0, 2.0]] * 3)
    (fit, one) = lloyd.fit_all(frame(spark, rows), [(4, 42, 0), (1, 42, 0)])
    assert sorted(fit.sizes.tolist()) == [3, 500] and fit.inertia == pytest.approx(0, abs=1e-9)
    measured, _ = lloyd.quality(frame(spark, rows), [fit, one])
    assert measured[0].silhouette == pytest.approx(1) and measured[1].silhouette == 0
    with pytest.raises(ValueError, match="rows"):
        lloyd.fit_all(frame(spark, rows).limit(0), [(2, 42, 0)])


def test_sweep_selects_the_real_number_of_groups(spark, blobs):
    df = frame(spark, blobs).cache()
    rows = S.sweep(df, range(2, 7), starts=3)
    assert {r["rows"] for r in rows} == {len(blobs)}
    assert S.choose_by_silhouette(rows) == S.choose_by_compactness(rows) == 4
    assert next(r for r in rows if r["k"] == 4)["stability"] == pytest.approx(1)
    assigned, model, _ = S.select_and_assign(df, range(2, 6), starts=2)
    assert assigned.count() == len(blobs) and len(model.clusterCenters()) == 4


def test_passes_take_no_more_tasks_than_cores(spark):
    """A few rows in many partitions: what a step costs follows from the rows, not from how they came."""
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 3 * 10)]) for i in range(300)], "id int, x array<double>").repartition(64)
    sc = spark.sparkContext
    sc.setJobGroup("lloyd-passes", "passes")
    try:
        (fit,) = lloyd.fit_all(rows.select(array_to_vector("x").alias("features")), [(3, 1, 0)])
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    last = tracker.getJobInfo(max(tracker.getJobIdsForGroup("lloyd-passes")))
    assert max(tracker.getStageInfo(s).numTasks for s in last.stageIds) <= sc.defaultParallelism
    assert fit.sizes.sum() == 300


def test_passes_use_the_cores_though_rows_come_in_one_partition(spark):
    """Rows that small tables leave in few partitions are dealt over the cores, a block each at least."""
    rows = spark.range(4 * lloyd.BLOCK).selectExpr("array(double(id % 7), double(id % 3 * 10)) x").coalesce(1)
    sc = spark.sparkContext
    sc.setJobGroup("lloyd-cores", "cores")
    try:
        (fit,) = lloyd.fit_all(rows.select(array_to_vector("x").alias("features")), [(3, 1, 0)])
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    last = tracker.getJobInfo(max(tracker.getJobIdsForGroup("lloyd-cores")))
    assert max(tracker.getStageInfo(s).numTasks for s in last.stageIds) == min(sc.defaultParallelism, 4)
    assert fit.sizes.sum() == 4 * lloyd.BLOCK


def test_statistics_of_many_sets_with_equal_centres(spark):
    """Sets of different sizes keep their order; a row between equal centres counts for the first."""
    rng = np.random.default_rng(5)
    rows = np.concatenate([rng.normal(0, 2, (700, 2)), [[1.0, 0.0]] * 5])
    sets = [rng.normal(0, 2, (3, 2)), np.array([[1.0, 0.0], [1.0, 0.0]]), rng.normal(0, 2, (1, 2)), rng.normal(0, 2, (3, 2))]
    points, width = lloyd._points(frame(spark, rows, 2))
    for centers, table in zip(sets, lloyd._statistics(lloyd._packed(points, width), width, sets, 2), strict=True):
        gaps = ((rows[:, None] - centers[None]) ** 2).sum(2)
        nearest = gaps.argmin(1)
        for j in range(len(centers)):
            mine = rows[nearest == j]
            expected = [len(mine), gaps[nearest == j, j].sum(), (mine**2).sum(), *mine.sum(0)]
            assert np.allclose(table[j], expected)


def test_passes_cost_no_plan_of_their_own(spark, blobs, monkeypatch):
    """Steps read the stored blocks, so their number does not add to the frames that are planned and collected."""
    df, seen = frame(spark, blobs), []
    kind = type(df)
    collect, pack = kind.collect, lloyd._packed
    monkeypatch.setattr(kind, "collect", lambda self: seen.append(1) or collect(self))
    counts = []
    for steps in (1, 150):
        (fit,) = lloyd.fit_all(df, [(6, 42, 0)], steps)
        counts.append((fit.steps, len(seen)))
        seen.clear()
    assert counts[0][0] == 1 < counts[1][0] and counts[0][1] == counts[1][1]
    points, width = lloyd._points(df)
    whole = np.concatenate([x for x, _ in lloyd._blocks(pack(points, width).collect(), width)])
    assert sorted(map(tuple, whole)) == sorted(map(tuple, blobs))


def test_sums_of_many_partitions_meet_before_the_driver(spark, blobs):
    points, width = lloyd._points(frame(spark, blobs, 40))
    blocks = lloyd._packed(points, width)
    assert blocks.getNumPartitions() == 40
    found = lloyd._summed(blocks, width, lambda x, key: np.array([len(x), x.sum(), len(np.unique(key))], float))
    assert found == pytest.approx([len(blobs), blobs.sum(), len(blobs)])


def test_tasks_that_read_the_fits_need_no_ml():
    import subprocess
    import sys

    code = "import sys, loanloom.operators.lloyd; sys.exit('pyspark.ml' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=lloyd.__file__.rsplit("/loanloom/", 1)[0]).returncode == 0
