"""Catalogue: training, calibration and explanation.

A query gives the rows of its operator; the one named ``_facts`` beside it what holds of them for any fitted model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.operators import explain as X
from loanloom.operators import preparation as P
from loanloom.operators import training as T
from loanloom.operators.application import BASE_NUMERIC, CATEGORICAL
from loanloom.operators.cohorts import split_cohorts
from loanloom.operators.isotonic import fit_isotonic
from loanloom.plans import application_queries as A
from loanloom.plans import views
from loanloom.plans.evaluation_queries import COHORT_STEPS, RANKED
from loanloom.plans.registry import query, rounded
from loanloom.plans.views import with_views
from loanloom.session import ensure_checkpoint_dir

RAW = ["v_raw"]
#: The low ends of the boosted trees' search ranges.
BOOSTED = {"maxIter": 200, "stepSize": 0.1, "maxDepth": 3, "minInstancesPerNode": 10, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.7"}
#: The cohort steps over the labelled rows of the short contract.
LABELED = {**A.LITE_STEPS, **COHORT_STEPS, "ranked": RANKED.replace("v_scored", "(select SK_ID_CURR id, TARGET y from lite)")}


def labeled(spark: SparkSession, sf: str) -> DataFrame:
    return A.lite(spark, sf).withColumnRenamed("SK_ID_CURR", "id").withColumnRenamed("TARGET", "y")


def cohorts(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Rows per cohort; stored once, as every fit reads them many times."""
    rows = labeled(spark, sf)
    ensure_checkpoint_dir(spark)
    tagged = rows.join(split_cohorts(rows).select("id", "cohort"), "id").checkpoint()
    return {c: tagged.where(F.col("cohort") == c).drop("cohort") for c in ("development", "calibration", "policy", "test")}


def _valid(*columns: str) -> Column:
    """Rows whose probabilities all lie in [0, 1]."""
    good = F.lit(True)
    for c in columns:
        good = good & F.coalesce(F.col(c).between(0, 1) & ~F.isnan(c), F.lit(False))
    return F.count_if(good).alias("valid")


COMPARED = ("logistic_regression", "decision_tree")
METRICS = ["roc_auc", "average_precision", "brier", "inner_auc"]


def compared(spark: SparkSession, sf: str) -> DataFrame:
    """Two families over their own grids, two calibrations, three nested folds."""
    return T.nested_selection(labeled(spark, sf), COMPARED, BASE_NUMERIC, CATEGORICAL)


@query("train_compare")
def _compare(spark: SparkSession, sf: str) -> DataFrame:
    return compared(spark, sf)


@query("train_compare_facts", with_views(
    RAW, "select model, calibration, cast(rk % 3 as integer) fold, count(*) assessed_rows, true in_range from ranked, "
    f"(select unnest({list(COMPARED)}) model), (select unnest({list(T.METHODS)}) calibration) group by 1, 2, 3", LABELED))
def _compare_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows assessed by each candidate, every metric known and in [0, 1], that of the search included."""
    good = F.lit(True)
    for m in METRICS:
        good = good & F.coalesce(F.col(m).between(0, 1), F.lit(False))
    return compared(spark, sf).select("model", "calibration", "fold", "assessed_rows", good.alias("in_range"))


def calibrated(spark: SparkSession, sf: str) -> tuple[DataFrame, list[T.Calibrator]]:
    """Both calibrations of the test cohort."""
    parts = cohorts(spark, sf)
    fitted = T.fit("logistic_regression", {"C": 1.0}, parts["development"], BASE_NUMERIC, CATEGORICAL)
    raw = fitted.score(parts["calibration"], ["y"])
    test = fitted.score(parts["test"], ["id", "y"])
    sigmoid, isotonic = (T.fit_calibrator(method, raw) for method in T.METHODS)
    return isotonic.apply(sigmoid.apply(test, column="p_sigmoid"), column="p_isotonic"), [sigmoid, isotonic]


@query("calibrate")
def _calibrate(spark: SparkSession, sf: str) -> DataFrame:
    return calibrated(spark, sf)[0].select("id", "y", "p_sigmoid", "p_isotonic")


@query("calibrate_facts", with_views(
    RAW, "select y, count(*) n_rows, count(*) valid, true rising from split where cohort = 'test' group by 1", LABELED))
def _calibrate_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Valid probabilities that rise with the raw score."""
    both, (sigmoid, isotonic) = calibrated(spark, sf)
    steps = [value for _, value in isotonic.curve.points]
    rising = sigmoid.slope > 0 and steps == sorted(steps)
    return both.groupBy("y").agg(F.count(F.lit(1)).alias("n_rows"), _valid("p_sigmoid", "p_isotonic"), F.lit(rising).alias("rising"))


@query("isotonic_steps", with_views(
    ["v_scored"], "select score, round(max(least_mean), 10) value from (select b.score, min(b.total / b.n) over (partition by a.place order by b.place "
    "rows between current row and unbounded following) least_mean from firsts a join lasts b using (place_a)) group by 1",
    {"scores": "select round(p * 100) / 100 score, count(*)::double n, sum(y)::double t from v_scored group by 1",
     "sums": "select score, row_number() over (order by score) place, sum(n) over (order by score) n, sum(t) over (order by score) t, n n0, t t0 from scores",
     "firsts": "select place, place place_a from sums",
     "lasts": "select a.place place_a, b.place, b.score, b.n - a.n + a.n0 n, b.t - a.t + a.t0 total from sums a join sums b on b.place >= a.place"}))
def _isotonic(spark: SparkSession, sf: str) -> DataFrame:
    """The fitted curve at every distinct score; the oracle takes the greatest least mean over all intervals around it."""
    rows = views.scored(spark, sf).select((F.round(F.col("p") * 100) / 100).alias("score"), "y")
    curve = fit_isotonic(rows, "score", "y")
    return rounded(rows.select("score").distinct().withColumn("value", curve.apply(F.col("score"))), 10, "value")


def batch_scored(spark: SparkSession, sf: str) -> DataFrame:
    """The test cohort scored by boosted trees."""
    parts = cohorts(spark, sf)
    fitted = T.fit("gradient_boosted", BOOSTED, parts["development"], BASE_NUMERIC, CATEGORICAL)
    calibrator = T.fit_calibrator("sigmoid", fitted.score(parts["calibration"], ["y"]))
    return T.score_batch(parts["test"], fitted, calibrator, ["id", "y"], check=True)


@query("score_batch")
def _score(spark: SparkSession, sf: str) -> DataFrame:
    return batch_scored(spark, sf)


@query("score_batch_facts", with_views(RAW, "select y, count(*) n_rows, count(*) valid from split where cohort = 'test' group by 1", LABELED))
def _score_facts(spark: SparkSession, sf: str) -> DataFrame:
    return batch_scored(spark, sf).groupBy("y").agg(F.count(F.lit(1)).alias("n_rows"), _valid("p"))


WITHOUT = {"all": (), "without household": ("household_size", "dependent_children"), "without income": ("annual_income",)}


def ablated(spark: SparkSession, sf: str) -> DataFrame:
    variants = {v: ([c for c in BASE_NUMERIC if c not in cut], CATEGORICAL) for v, cut in WITHOUT.items()}
    found = T.ablation(cohorts(spark, sf), variants, "logistic_regression", {"C": 1.0}, "sigmoid")
    schema = "variant string, feature_count int, roc_auc double, average_precision double, brier double, policy_rows bigint"
    return spark.createDataFrame([tuple(r.values()) for r in found], schema)


@query("feature_ablation")
def _ablation(spark: SparkSession, sf: str) -> DataFrame:
    return ablated(spark, sf)


@query("feature_ablation_facts", with_views(
    RAW, "select variant, cast(k as integer) feature_count, count(*) policy_rows, true in_range from split, (select unnest("
    + str([{"variant": v, "k": len(BASE_NUMERIC) + len(CATEGORICAL) - len(cut)} for v, cut in WITHOUT.items()]) + ", recursive := true)) where cohort = 'policy' group by 1, 2", LABELED))
def _ablation_facts(spark: SparkSession, sf: str) -> DataFrame:
    good = F.col("roc_auc").between(0, 1) & F.col("average_precision").between(0, 1) & F.col("brier").between(0, 1)
    return ablated(spark, sf).select("variant", "feature_count", "policy_rows", good.alias("in_range"))


def _linear(spark: SparkSession, sf: str) -> tuple[T.Fitted, dict[str, DataFrame]]:
    parts = cohorts(spark, sf)
    return T.fit("logistic_regression", {"C": 1.0}, parts["development"], BASE_NUMERIC, CATEGORICAL), parts


def permuted(spark: SparkSession, sf: str) -> DataFrame:
    """Every feature of the contract; ``n_rows`` is what each permuted copy has scored."""
    fitted, parts = _linear(spark, sf)
    return X.permutation_importance(fitted, parts["test"], [*BASE_NUMERIC, *CATEGORICAL])


@query("permutation_importance")
def _permutation(spark: SparkSession, sf: str) -> DataFrame:
    return permuted(spark, sf)


@query("permutation_importance_facts", with_views(
    RAW, f"select feature, count(*) n_rows, true in_range from split, (select unnest({[*BASE_NUMERIC, *CATEGORICAL]}) feature) where cohort = 'test' group by 1", LABELED))
def _permutation_facts(spark: SparkSession, sf: str) -> DataFrame:
    good = F.col("roc_auc").between(0, 1) & F.col("auc_drop").between(-1, 1)
    return permuted(spark, sf).select("feature", "n_rows", good.alias("in_range"))


@query("linear_attribution", with_views(RAW, "select count(*) n_rows, true additive from split where cohort = 'test'", LABELED))
def _attribution(spark: SparkSession, sf: str) -> DataFrame:
    """Base value and contributions add up to the margin of every row."""
    fitted, parts = _linear(spark, sf)
    rows = X.linear_contributions(fitted, parts["test"], X.background_means(fitted, parts["development"]), ["id"])
    error = X.additivity_error(rows).select((F.col("max_additivity_error") < 1e-9).alias("additive"))
    return error.withColumn("n_rows", F.lit(rows.count()).cast("bigint"))


@query("top_contributions", with_views(RAW, "select id, true consistent from split where cohort = 'test'", LABELED))
def _top(spark: SparkSession, sf: str) -> DataFrame:
    """Increases and reductions are sorted, at most five each, of the right sign, and no other feature is stronger."""
    fitted, parts = _linear(spark, sf)
    wide = X.linear_contributions(fitted, parts["test"], X.background_means(fitted, parts["development"]), ["id"])
    names = [c for c in wide.columns if c.startswith("c_")]
    rows = X.top_contributions(wide, ["id"]).join(wide.select("id", F.array(*names).alias("all")), "id")
    up, down = F.col("increases_risk.contribution"), F.col("reduces_risk.contribution")
    best = F.slice(F.sort_array(F.filter("all", lambda x: x > 0), asc=False), 1, X.TOP)
    worst = F.slice(F.sort_array(F.filter("all", lambda x: x < 0)), 1, X.TOP)
    return rows.select("id", ((up == best) & (down == worst)).alias("consistent"))


def path_attributed(spark: SparkSession, sf: str) -> DataFrame:
    """Path attributions of a tree and a forest to every row of the test cohort."""
    parts, out = cohorts(spark, sf), None
    for name, params in (("decision_tree", {"maxDepth": 4, "minInstancesPerNode": 50}), ("random_forest", {"maxDepth": 8, "minInstancesPerNode": 50, "numTrees": 50})):
        fitted = T.fit(name, params, parts["development"], BASE_NUMERIC, CATEGORICAL)
        rows = X.tree_contributions(fitted, parts["test"], ["id"]).withColumn("model", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("tree_attribution")
def _paths(spark: SparkSession, sf: str) -> DataFrame:
    return path_attributed(spark, sf)


@query("tree_attribution_facts", with_views(
    RAW, "select model, count(*) n_rows, count(*) additive from split, (select unnest(['decision_tree', 'random_forest']) model) where cohort = 'test' group by 1", LABELED))
def _paths_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Base value and contributions add up to the model's own probability in every row."""
    rows = path_attributed(spark, sf)
    total = sum((F.col(c) for c in rows.columns if c.startswith("c_")), F.col("base_value"))
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.abs(total - F.col("margin")) < 1e-9).alias("additive"))


@query("median_impute", with_views(
    RAW, "select SK_ID_CURR id, round(coalesce(years_employed, m), 9) years_employed from lite, (select median(years_employed) m from lite)", A.LITE_STEPS))
def _impute(spark: SparkSession, sf: str) -> DataFrame:
    rows = labeled(spark, sf)
    value = P.median_impute_values(rows, ["years_employed"])["years_employed"]
    return rounded(rows.select("id", F.coalesce("years_employed", F.lit(value)).alias("years_employed")), 9, "years_employed")


@query("winsorize", with_views(
    RAW, "select SK_ID_CURR id, round(case when annual_income is not null then least(greatest(annual_income, lo), hi) end, 6) annual_income from lite, "
    "(select quantile_cont(annual_income, 0.01) lo, quantile_cont(annual_income, 0.99) hi from lite)", A.LITE_STEPS))
def _winsorize(spark: SparkSession, sf: str) -> DataFrame:
    rows = labeled(spark, sf)
    limits = P.winsor_limits(rows, ["annual_income"])["annual_income"]
    return rounded(rows.select("id", P.clip(F.col("annual_income"), limits).alias("annual_income")), 6, "annual_income")


HOT = ["COMMERCIAL_ASSOCIATE", "OTHER", "PENSIONER", "STATE_SERVANT", "WORKING"]


@query("one_hot", with_views(
    RAW, "select SK_ID_CURR id, " + ", ".join(f"cast(employment_type = '{v}' as double) \"employment_type={v}\"" for v in HOT) + " from lite", A.LITE_STEPS))
def _one_hot(spark: SparkSession, sf: str) -> DataFrame:
    return labeled(spark, sf).select("id", *P.one_hot("employment_type", HOT))


@query("standard_scale", with_views(
    RAW, "select SK_ID_CURR id, round((requested_amount - avg(requested_amount) over ()) / stddev_pop(requested_amount) over (), 6) requested_amount from lite", A.LITE_STEPS))
def _scale(spark: SparkSession, sf: str) -> DataFrame:
    rows = labeled(spark, sf)
    mean, deviation = P.scale_statistics(rows, ["requested_amount"])["requested_amount"]
    return rounded(rows.select("id", ((F.col("requested_amount") - mean) / deviation).alias("requested_amount")), 6, "requested_amount")


@query("most_frequent", with_views(
    RAW, "select 'occupation' \"column\", min_by(v, (-n, v)) top from (select occupation v, count(*) n from lite group by 1) union all "
    "select 'housing_status', min_by(v, (-n, v)) from (select housing_status v, count(*) n from lite group by 1)", A.LITE_STEPS))
def _frequent(spark: SparkSession, sf: str) -> DataFrame:
    found = P.most_frequent(labeled(spark, sf), ["occupation", "housing_status"])
    return spark.createDataFrame(list(found.items()), "`column` string, top string")


@query("class_weights", with_views(
    RAW, "select TARGET y, (select count(*) from lite) / (2.0::double * count(*)) w, count(*) n_rows from lite group by 1", A.LITE_STEPS))
def _weights(spark: SparkSession, sf: str) -> DataFrame:
    rows = labeled(spark, sf)
    weight = T.class_weight(T.class_sizes(rows, "y"))
    return rows.groupBy("y").agg(F.max(weight).alias("w"), F.count(F.lit(1)).alias("n_rows"))
