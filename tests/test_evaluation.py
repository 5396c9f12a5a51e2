"""Metrics, cohorts, quantiles and segmentation against brute force."""

import math
import random
from datetime import timedelta

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loanloom import ContractError
from loanloom.operators import cohorts as C
from loanloom.operators import evaluation as E
from loanloom.operators import ledger as L
from loanloom.operators import prefix
from loanloom.operators import segmentation as S

FEW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
pairs = st.lists(st.tuples(st.integers(0, 8), st.integers(0, 1)), min_size=4, max_size=40).filter(lambda r: len({y for _, y in r}) == 2)


def frame(spark, rows):
    return spark.createDataFrame([(i, y, p / 10 + 0.05) for i, (p, y) in enumerate(rows)], "id long, y int, p double")


def brute(rows):
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ks = max(sum(p >= t for p in pos) / len(pos) - sum(p >= t for p in neg) / len(neg) for t in set(pos + neg))
    ap = sum(
        sum(p == t for p in pos) / len(pos) * sum(p >= t for p in pos) / (sum(p >= t for p in pos) + sum(p >= t for p in neg))
        for t in set(pos + neg)
    )
    return auc, max(ks, 0), ap


@FEW
@given(rows=pairs)
def test_rank_metrics_equal_brute_force(spark, rows):
    m = E.rank_metrics(frame(spark, rows)).first()
    auc, ks, ap = brute(rows)
    assert (m.roc_auc, m.ks, m.average_precision) == pytest.approx((auc, ks, ap))
    assert m.gini == pytest.approx(2 * auc - 1)


@FEW
@given(values=st.lists(st.integers(-50, 50), min_size=1, max_size=60))
def test_quantiles_equal_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    assert prefix.quantile_edges(df, "v", probs) == pytest.approx(list(np.quantile(values, probs)))


def test_running_sums_per_group(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.randint(0, 9)) for g in ("a", "b") for i in rng.sample(range(500), 200)]
    df = spark.createDataFrame(rows, "g string, k int, n int").repartition(3)
    got = {(r.g, r.k): (r.s, r.s_total) for r in prefix.running_sums(df, ["k"], {"s": "n"}, ["g"]).collect()}
    for g in ("a", "b"):
        total = 0
        whole = sum(n for gg, _, n in rows if gg == g)
        for _, k, n in sorted(r for r in rows if r[0] == g):
            total += n
            assert got[(g, k)] == (total, whole)


def test_bootstrap_interval_contains_the_estimate(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 8), int(rng.random() < 0.3)) for _ in range(300)]
    rows = [(min(8, p + 2 * y), y) for p, y in rows]
    df = frame(spark, rows)
    first = {r.metric: (r.lower, r.upper) for r in E.bootstrap_intervals(df, replicates=40).collect()}
    again = {r.metric: (r.lower, r.upper) for r in E.bootstrap_intervals(df.repartition(7), replicates=40).collect()}
    auc, _, ap = brute(rows)
    assert first["roc_auc"][0] < auc < first["roc_auc"][1] and first["average_precision"][0] < ap < first["average_precision"][1]
    assert first["roc_auc"] == pytest.approx(again["roc_auc"], abs=0.05)
    brier = E.probability_losses(df).first().brier
    assert first["brier"][0] < brier < first["brier"][1]


def test_split_of_600(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(600)], "id long, y int")
    split = C.split_cohorts(df)
    sizes = {r.cohort: r["count"] for r in split.groupBy("cohort").count().collect()}
    assert sizes == {"development": 360, "calibration": 90, "policy": 60, "test": 90}
    p = C.partition_problems(split, df).first()
    assert (p.in_several, p.unassigned, p.unknown) == (0, 0, 0)
    assert C.set_difference(split, C.split_cohorts(df.repartition(9)), ["id", "cohort"]).isEmpty()
    assert split.where("y = 1").groupBy("cohort").count().count() == 4


def test_split_needs_both_classes(spark):
    df = spark.createDataFrame([(i, 0) for i in range(100)], "id long, y int")
    with pytest.raises(ContractError):
        C.split_cohorts(df)


def test_folds_are_disjoint_and_stratified(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "id long, y int")
    rows = C.fold_lineage(df).collect()
    for fold in range(3):
        mine = [r for r in rows if r.fold == fold]
        assert sum(r.n_rows for r in mine) == 240
        assert {r.role for r in mine} == {"assessment", "calibration", "base"}


def test_allocation_keeps_the_total():
    assert C.allocate(60, {0: 459, 1: 51}) == {0: 54, 1: 6}
    for total in range(20):
        assert sum(C.allocate(total, {0: 13, 1: 7}).values()) == total


def test_sliding_counts_equal_brute_force(spark):
    from datetime import datetime, timedelta

    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = [("hot" if rng.random() < 0.6 else "cold", start + timedelta(seconds=rng.randint(0, 4000))) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, t timestamp")
    got = {(r.k, r.t): r.in_window for r in L.sliding_counts(df, "k", "t", 600).collect()}
    assert len(got) == len(set(rows))
    for k, t in set(rows):
        assert got[(k, t)] == sum(kk == k and timedelta(0) <= t - tt <= timedelta(seconds=600) for kk, tt in rows)


def clusters(spark):
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(c, 0.3, (30, 2)) for c in ((0, 0), (4, 0), (0, 4))])
    labels = np.repeat([0, 1, 2], 30)
    rows = [(i, [float(v) for v in x], int(c)) for i, (x, c) in enumerate(zip(points, labels))]
    return points, labels, spark.createDataFrame(rows, "id long, x array<double>, cluster int")


def test_cluster_quality_equals_brute_force(spark):
    from pyspark.ml.functions import array_to_vector

    points, labels, df = clusters(spark)
    d = ((points[:, None] - points[None]) ** 2).sum(-1)
    width = []
    for i in range(len(points)):
        inside = d[i][labels == labels[i]].sum() / 29
        outside = min(d[i][labels == c].mean() for c in {0, 1, 2} - {labels[i]})
        width.append((outside - inside) / max(inside, outside))
    got = S.squared_silhouette(df.select("id", array_to_vector("x").alias("features"), "cluster"))
    assert got == pytest.approx(np.mean(width))
    centers = np.stack([points[labels == c].mean(0) for c in range(3)])
    scatter = [np.linalg.norm(points[labels == c] - centers[c], axis=1).mean() for c in range(3)]
    worst = [max((scatter[a] + scatter[b]) / np.linalg.norm(centers[a] - centers[b]) for b in range(3) if b != a) for a in range(3)]
    assert S.davies_bouldin(df, "cluster", "x") == pytest.approx(np.mean(worst))


def test_sliding_count_of_one_hot_key(spark):
    from datetime import datetime

    start = datetime(2024, 1, 1)
    rows = [(0, start + timedelta(milliseconds=7 * i)) for i in range(6000)] + [(1 + i % 50, start + timedelta(seconds=i)) for i in range(12000)]
    got = L.sliding_counts(spark.createDataFrame(rows, "k int, t timestamp"), "k", "t", 10)
    assert "RangeFrame, -" not in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        if r.k == 0:
            i = round((r.t - start).total_seconds() * 1000 / 7)
            assert r.in_window == min(i, 10_000 // 7) + 1


def test_sweep_covers_all_rows_and_selects(spark):
    from pyspark.ml.functions import array_to_vector

    _, labels, df = clusters(spark)
    rows = df.select("id", array_to_vector("x").alias("features"))
    assigned, model, found = S.select_and_assign(rows, range(2, 5), starts=2)
    assert [r["k"] for r in found] == [2, 3, 4] and len(model.clusterCenters()) == 3
    groups = {}
    for r in assigned.collect():
        groups.setdefault(r.cluster, set()).add(int(labels[r.id]))
    assert sorted(map(sorted, groups.values())) == [[0], [1], [2]]
    points, shares = S.pca_projection(rows)
    assert points.count() == len(labels) and shares[0] >= shares[1]


def test_adjusted_rand_limits(spark):
    df = spark.createDataFrame([(i % 3, (i % 3) * 7, i % 2) for i in range(60)], "a int, b int, c int")
    assert S.adjusted_rand(df, "a", "b").first()[0] == pytest.approx(1)
    assert abs(S.adjusted_rand(df, "a", "c").first()[0]) < 0.1


def test_selection_rules():
    rows = [
        {"k": 2, "silhouette": 0.300, "davies_bouldin": 1.4, "minimum_share": 0.2, "stability": 0.95},
        {"k": 3, "silhouette": 0.305, "davies_bouldin": 1.1, "minimum_share": 0.1, "stability": 0.70},
        {"k": 4, "silhouette": 0.296, "davies_bouldin": 1.1, "minimum_share": 0.005, "stability": 0.99},
    ]
    assert S.choose_by_silhouette(rows) == 2
    assert S.choose_by_compactness(rows) == 3
    with pytest.raises(ContractError):
        S.choose_by_silhouette([{**rows[0], "stability": 0.1}])


def test_log_loss_of_certain_errors_is_finite(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (2, 0, 1.0)], "id long, y int, p double")
    assert E.probability_losses(df).first().log_loss == pytest.approx(-math.log(1e-6), rel=1e-6)
