"""Catalogue: evaluation, cohorts, policy and affordability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.operators import cohorts as C
from loanloom.operators import evaluation as E
from loanloom.operators import risk as R
from loanloom.operators.application import CATEGORICAL, ID
from loanloom.plans import application_queries as A
from loanloom.plans import views
from loanloom.plans.registry import query, rounded
from loanloom.plans.views import with_views

S = ["v_scored"]
LADDER = (
    "select p, pos, neg, sum(pos) over (order by p desc) tp, sum(neg) over (order by p desc) fp, sum(pos) over () np, "
    "sum(neg) over () nn from (select p, count(*) filter (where y = 1) pos, count(*) filter (where y = 0) neg from v_scored group by 1)"
)


@query("auc_ks_ap", with_views(
    S, "select cast(max(np) as bigint) positives, cast(max(nn) as bigint) negatives, "
    "round(cast(sum(neg * (2 * (tp - pos) + pos)) as double) / (2.0::double * max(np) * max(nn)), 12) roc_auc, "
    "round(2 * (cast(sum(neg * (2 * (tp - pos) + pos)) as double) / (2.0::double * max(np) * max(nn))) - 1, 12) gini, "
    "round(greatest(max(cast(tp as double) / np - cast(fp as double) / nn), 0), 12) ks, "
    "round(sum(pos * cast(tp as double) / (tp + fp)) / max(np), 12) average_precision from ladder", {"ladder": LADDER}))
def _ranks(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.rank_metrics(views.scored(spark, sf)), 12, "roc_auc", "gini", "ks", "average_precision")


@query("auc_by_pairs", with_views(
    S, "select round((cast(sum(case when a.p > b.p then 2 when a.p = b.p then 1 else 0 end) as double)) / (2 * count(*)), 12) roc_auc "
    "from v_scored a join v_scored b on a.y = 1 and b.y = 0"))
def _auc_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The oracle counts ordered pairs; the engine never forms a pair."""
    return rounded(E.rank_metrics(views.scored(spark, sf)).select("roc_auc"), 12, "roc_auc")


@query("score_ladder", with_views(
    S, "select p, pos, neg, cast(tp as bigint) tp, cast(fp as bigint) fp from ladder", {"ladder": LADDER}))
def _ladder(spark: SparkSession, sf: str) -> DataFrame:
    return E.score_ladder(views.scored(spark, sf)).select("p", "pos", "neg", "tp", "fp")


@query("brier_logloss", with_views(
    S, "select count(*) n_rows, round(avg((p - y) * (p - y)), 12) brier, round(avg(-case when y = 1 then ln(least(greatest(p, 1e-6::double), 1 - 1e-6::double)) "
    "else ln(1 - least(greatest(p, 1e-6::double), 1 - 1e-6::double)) end), 12) log_loss from v_scored"))
def _losses(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.probability_losses(views.scored(spark, sf)), 12, "brier", "log_loss")


@query("threshold_metrics", with_views(
    S, "select tp, fp, fn, tn, cast(tp + tn as double) / (tp + fp + fn + tn) accuracy, coalesce(cast(tp as double) / nullif(tp + fp, 0), 0) \"precision\", "
    "coalesce(cast(tp as double) / nullif(tp + fn, 0), 0) recall, coalesce(cast(2 * tp as double) / nullif(2 * tp + fp + fn, 0), 0) f1 from ("
    "select count(*) filter (where p >= 0.15 and y = 1) tp, count(*) filter (where p >= 0.15 and y = 0) fp, "
    "count(*) filter (where p < 0.15 and y = 1) fn, count(*) filter (where p < 0.15 and y = 0) tn from v_scored)"))
def _threshold(spark: SparkSession, sf: str) -> DataFrame:
    return E.threshold_metrics(views.scored(spark, sf), 0.15)


EDGES = "select " + ", ".join(f"quantile_cont(p, {i / 10}) e{i}" for i in range(1, 10)) + " from v_scored"
BIN = " + ".join(f"cast(p > e{i} as integer)" for i in range(1, 10))


@query("calibration_bins", with_views(
    S, f"select {BIN} bin, count(*) n_rows, round(avg(p), 12) mean_predicted_probability, avg(cast(y as double)) observed_rate "
    "from v_scored, edges group by 1", {"edges": EDGES}))
def _bins(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.calibration_bins(views.scored(spark, sf)), 12, "mean_predicted_probability")


@query("baselines", with_views(
    S, "select avg(cast(y as double)) average_precision, round(avg((0.1::double - y) * (0.1::double - y)), 12) brier, 1 - avg(cast(y as double)) accuracy_always_zero from v_scored"))
def _baselines(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.baselines(views.scored(spark, sf), F.lit(0.1)), 12, "brier")


BOOTSTRAP_SQL = with_views(
    S, "select metric, count(*) n_rows, true inside from v_scored, (select unnest(['roc_auc', 'average_precision', 'brier']) metric) group by 1")


@query("bootstrap_intervals")
def _intervals(spark: SparkSession, sf: str) -> DataFrame:
    return E.bootstrap_intervals(views.scored(spark, sf))


def _estimates(rows: DataFrame) -> dict[str, float]:
    """The bootstrapped metrics over all rows."""
    ranks = E.rank_metrics(rows).select("roc_auc", "average_precision")
    return {**ranks.first().asDict(), "brier": E.probability_losses(rows).first()["brier"]}


@query("bootstrap_ci", BOOTSTRAP_SQL)
def _bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Rows drawn from for each of the three intervals, and whether it lies in [0, 1] and holds the value of all rows."""
    rows = views.scored(spark, sf)
    whole = _estimates(rows)
    found = E.bootstrap_intervals(rows).collect()  # a row a metric
    checked = [(r["metric"], r["n_rows"], 0 <= r["lower"] <= whole[r["metric"]] <= r["upper"] <= 1) for r in found]
    return spark.createDataFrame(checked, "metric string, n_rows bigint, inside boolean")


@query("bootstrap_ci_facts", BOOTSTRAP_SQL)
def _bootstrap_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Every interval lies in [0, 1] and holds the value of all rows."""
    rows = views.scored(spark, sf)
    value = F.element_at(F.create_map(*[F.lit(x) for pair in _estimates(rows).items() for x in pair]), F.col("metric"))
    inside = (F.col("lower") >= 0) & (F.col("lower") <= value) & (value <= F.col("upper")) & (F.col("upper") <= 1)
    return E.bootstrap_intervals(rows).select("metric", "n_rows", inside.alias("inside"))


POLICY_SQL = " union all ".join(
    f"select {a}::double approve_below, {r}::double reject_at, '{g}' group_name, count(*) filter (where {m}) n_rows, "
    f"cast(count(*) filter (where {m}) as double) / count(*) share, avg(cast(y as double)) filter (where {m}) observed_rate from v_scored"
    for a, r in E.POLICY_PAIRS
    for g, m in (("approval_candidate", f"p < {a}"), ("review", f"p >= {a} and p < {r}"), ("rejection_candidate", f"p >= {r}")))


@query("policy_table", with_views(S, POLICY_SQL))
def _policy_table(spark: SparkSession, sf: str) -> DataFrame:
    return E.policy_table(views.scored(spark, sf))


BAND = "case when p < 0.05 then 'Low' when p < 0.15 then 'Medium' else 'High' end"


@query("band_outcomes", with_views(
    S, f"select {BAND} band, count(*) n_rows, avg(cast(y as double)) observed_rate, round(avg(p), 12) mean_pd from v_scored group by 1"))
def _bands(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.band_outcomes(views.scored(spark, sf)), 12, "mean_pd")


ADVICE = ("case when supported and p < 0.05 then 'APPROVAL_CANDIDATE' when supported and p >= 0.15 then 'REJECTION_CANDIDATE' else 'MANUAL_REVIEW' end")
CONTEXT = "select *, id % 7 <> 3 supported, id % 5 <> 1 verified, id % 2 = 0 affordable, case when id % 3 = 0 then 'lite' else 'full' end variant from v_scored"
LIVE = "verified and supported and variant = 'full'"


@query("policy_decisions", with_views(
    S, f"select id, recommendation, case when {LIVE} and recommendation = 'REJECTION_CANDIDATE' then 'REJECTED' "
    f"when {LIVE} and recommendation = 'APPROVAL_CANDIDATE' and affordable then 'APPROVED' else 'MANUAL_REVIEW' end decision_status, "
    f"{BAND} risk_band, round(100 * p, 2) risk_score, round(100 * (1 - p), 2) credit_health_index from (select *, {ADVICE} recommendation from ctx)",
    {"ctx": CONTEXT}))
def _decisions(spark: SparkSession, sf: str) -> DataFrame:
    policy = R.Policy("live-1", "LIVE", 0.05, 0.15, "report-1", "reviewer", "m1", "full")
    scored = views.scored(spark, sf).withColumns(
        {
            "supported": F.col("id") % 7 != 3, "verified": F.col("id") % 5 != 1, "affordable": F.col("id") % 2 == 0,
            "variant": F.when(F.col("id") % 3 == 0, "lite").otherwise("full"), "model_version": F.lit("m1"),
            "release_ready": F.lit(True), "data_valid": F.lit(True), "product_eligible": F.lit(True),
        }
    )
    out = R.apply_policy(scored, policy)
    return out.select("id", "recommendation", "decision_status", "risk_band", "risk_score", "credit_health_index")


@query("score_percentile", with_views(
    S, "select a.id, a.p, 100.0::double * count(*) filter (where b.p <= a.p) / count(*) reference_percentile "
    "from v_scored a, v_scored b group by 1, 2"))
def _percentile(spark: SparkSession, sf: str) -> DataFrame:
    scored = views.scored(spark, sf)
    return E.reference_percentile(scored.select("id", "p"), scored)


@query("paired_mismatch", with_views(
    S, "select count(*) filter (where b.id is null) only_left, count(*) filter (where a.id is null) only_right, "
    "count(*) filter (where a.y <> b.y) label_mismatch, count(*) filter (where a.y = b.y) paired from (select id, y from v_scored where id % 10 <> 1) a "
    "full join (select id, case when id % 9 = 2 then 1 - y else y end y from v_scored where id % 10 <> 2) b on a.id = b.id"))
def _paired(spark: SparkSession, sf: str) -> DataFrame:
    scored = views.scored(spark, sf)
    changed = scored.where("id % 10 <> 2").withColumn("y", F.when(F.col("id") % 9 == 2, 1 - F.col("y")).otherwise(F.col("y")))
    return E.paired_mismatch(scored.where("id % 10 <> 1"), changed)


OTHER = "greatest(0.01::double, least(0.99::double, p * 0.5::double + cast((id * 37) % 100 as double) / 400))"
MODELS = f"select 'base' model, y, p from v_scored union all select 'other', y, {OTHER} from v_scored"
MODEL_LADDER = (
    "select model, p, pos, neg, sum(pos) over (partition by model order by p desc) tp, sum(neg) over (partition by model order by p desc) fp "
    "from (select model, p, count(*) filter (where y = 1) pos, count(*) filter (where y = 0) neg from models group by 1, 2)"
)
COMPARE = (
    "select l.model, round(cast(sum(neg * (2 * (tp - pos) + pos)) as double) / (2.0::double * sum(pos) * sum(neg)), 12) roc_auc, "
    "round(sum(pos * cast(tp as double) / (tp + fp)) / sum(pos), 12) average_precision, max(brier) brier, max(log_loss) log_loss from model_ladder l "
    "join (select model, round(avg((p - y) * (p - y)), 12) brier, round(avg(-case when y = 1 then ln(p) else ln(1 - p) end), 12) log_loss from models group by 1) m "
    "on l.model = m.model group by 1"
)
COMPARE_STEPS = {"models": MODELS, "model_ladder": MODEL_LADDER, "compared": COMPARE}


def _two_models(spark: SparkSession, sf: str) -> DataFrame:
    shifted = F.expr("greatest(cast(0.01 as double), least(cast(0.99 as double), p * cast(0.5 as double) + cast((id * 37) % 100 as double) / 400))")
    return views.scored(spark, sf).withColumn("q", shifted)


@query("paired_comparison", with_views(S, "select * from compared", COMPARE_STEPS))
def _comparison(spark: SparkSession, sf: str) -> DataFrame:
    out = E.paired_comparison(_two_models(spark, sf), {"base": "p", "other": "q"})
    return rounded(out, 12, "roc_auc", "average_precision", "brier", "log_loss")


@query("metric_deltas", with_views(
    S, "select metric, round(delta, 10) delta from (select o.roc_auc - b.roc_auc roc_auc, o.average_precision - b.average_precision average_precision, "
    "o.brier - b.brier brier, o.log_loss - b.log_loss log_loss from compared b join compared o on b.model = 'base' and o.model = 'other') "
    "unpivot (delta for metric in (roc_auc, average_precision, brier, log_loss))", COMPARE_STEPS))
def _deltas(spark: SparkSession, sf: str) -> DataFrame:
    out = E.paired_comparison(_two_models(spark, sf), {"base": "p", "other": "q"})
    return rounded(E.metric_deltas(out, "base", "other"), 10, "delta")


@query("probability_difference", with_views(
    S, f"select round(avg(abs(q - p)), 12) mean_absolute_difference, round(max(abs(q - p)), 12) max_absolute_difference from (select *, {OTHER} q from v_scored)"))
def _difference(spark: SparkSession, sf: str) -> DataFrame:
    gap = F.abs(F.col("q") - F.col("p"))
    out = _two_models(spark, sf).agg(F.avg(gap).alias("mean_absolute_difference"), F.max(gap).alias("max_absolute_difference"))
    return rounded(out, 12, "mean_absolute_difference", "max_absolute_difference")


# ---------------------------------------------------------------- cohorts
RANKED = "select id, y, row_number() over (partition by y order by md5(cast(id as string)), id) - 1 rk, count(*) over (partition by y) nc, count(*) over () n from v_scored"
COHORT_STEPS = {
    "ranked": RANKED,
    # class sizes, then largest-remainder cuts of the three reserved cohorts in turn
    "c0": "select y, max(nc) lf, max(n) n from ranked group by 1",
    "t1": "select y, n, lf, floor(q) + cast(row_number() over (order by floor(q) - q, y) <= k - sum(floor(q)) over () as integer) take from (select *, cast(round_even(n * 0.15::double, 0) as bigint) k, cast(round_even(n * 0.15::double, 0) as bigint) * lf / sum(lf) over ()::double q from c0)",
    "c1": "select y, n, lf - take lf, take a from t1",
    "t2": "select y, n, lf, a, floor(q) + cast(row_number() over (order by floor(q) - q, y) <= k - sum(floor(q)) over () as integer) take from (select *, cast(round_even(n * 0.10::double, 0) as bigint) k, cast(round_even(n * 0.10::double, 0) as bigint) * lf / sum(lf) over ()::double q from c1)",
    "c2": "select y, n, lf - take lf, a, a + take b from t2",
    "t3": "select y, a, b, floor(q) + cast(row_number() over (order by floor(q) - q, y) <= k - sum(floor(q)) over () as integer) take from (select *, cast(round_even(n * 0.15::double, 0) as bigint) k, cast(round_even(n * 0.15::double, 0) as bigint) * lf / sum(lf) over ()::double q from c2)",
    "cuts": "select y, a, b, b + take c from t3",
    "split": "select id, r.y, case when rk < a then 'test' when rk < b then 'policy' when rk < c then 'calibration' else 'development' end cohort from ranked r join cuts on r.y = cuts.y",
}


@query("cohort_split", with_views(S, "select * from split", COHORT_STEPS))
def _split(spark: SparkSession, sf: str) -> DataFrame:
    return C.split_cohorts(views.scored(spark, sf))


@query("cohort_sizes", with_views(S, "select cohort, y, count(*) n_rows from split group by 1, 2", COHORT_STEPS))
def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    return C.split_cohorts(views.scored(spark, sf)).groupBy("cohort", "y").agg(F.count(F.lit(1)).alias("n_rows"))


@query("partition_problems", with_views(
    S, "select 0::bigint in_several, (select count(*) from v_scored where id % 17 = 3) unassigned, 0::bigint \"unknown\""))
def _problems(spark: SparkSession, sf: str) -> DataFrame:
    scored = views.scored(spark, sf)
    return C.partition_problems(C.split_cohorts(scored).where("id % 17 <> 3"), scored)


@query("fold_lineage", with_views(
    S, "select fold, case when rk % 3 = fold then 'assessment' when (rk // 3) % 5 = 0 then 'calibration' else 'base' end role, y, count(*) n_rows "
    "from ranked, (values (0), (1), (2)) f(fold) group by 1, 2, 3", {"ranked": RANKED}))
def _lineage(spark: SparkSession, sf: str) -> DataFrame:
    return C.fold_lineage(views.scored(spark, sf))


@query("stratified_cap", with_views(
    S, "select id, r.y from ranked r join (select y, floor(q) + cast(row_number() over (order by floor(q) - q, y) <= 120 - sum(floor(q)) over () as integer) take "
    "from (select *, 120 * lf / n::double q from c0)) t on r.y = t.y where rk < take", {"ranked": RANKED, "c0": COHORT_STEPS["c0"]}))
def _cap(spark: SparkSession, sf: str) -> DataFrame:
    return C.stratified_cap(views.scored(spark, sf), 120)


@query("deterministic_sample", with_views(S, "select id from v_scored order by md5(cast(id as string)), id limit 50"))
def _sample(spark: SparkSession, sf: str) -> DataFrame:
    return C.deterministic_sample(views.scored(spark, sf).select("id"), 50)


@query("cohort_set_difference", with_views(
    S, "select id, 'left' side from v_scored where id % 4 <> 0 and id % 6 = 0 union all select id, 'right' from v_scored where id % 6 <> 0 and id % 4 = 0"))
def _set_difference(spark: SparkSession, sf: str) -> DataFrame:
    scored = views.scored(spark, sf)
    return C.set_difference(scored.where("id % 4 <> 0"), scored.where("id % 6 <> 0"), ["id"])


# ---------------------------------------------------------------- support and affordability
SUPPORT_RANGES = ["annual_income", "requested_amount", "household_size"]
SEEN_ROWS = "SK_ID_CURR % 3 = 1 and years_employed is not null and education_level <> 'ACADEMIC_DEGREE'"
SUPPORT_SQL = (
    "select SK_ID_CURR, flags, len(flags) n_flags from (select SK_ID_CURR, list_filter(["
    + ", ".join(
        f"case when {c} = 'OTHER' or {c} not in (select {c} from dev) then 'unsupported_category:{c}' end" for c in CATEGORICAL)
    + ", " + ", ".join(
        f"case when {c} < (select min({c}) from dev) or {c} > (select max({c}) from dev) then 'outside_development_range:{c}' end" for c in SUPPORT_RANGES)
    + ", case when years_employed is null then 'unseen_missing_tenure' end], lambda x: x is not null) flags from lite)"
)
FLAG_TEXT = "select SK_ID_CURR, array_to_string(flags, '|') flags, n_flags from flagged"


@query("support_flags", with_views(
    ["v_raw"], FLAG_TEXT, {**A.LITE_STEPS, "dev": f"select * from lite where {SEEN_ROWS}", "flagged": SUPPORT_SQL}))
def _support(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.lite(spark, sf)
    statistics = R.support_statistics(rows.where(SEEN_ROWS), SUPPORT_RANGES)
    flags = R.support_flags(statistics)
    return rows.select(ID, F.concat_ws("|", flags).alias("flags"), F.size(flags).cast("bigint").alias("n_flags"))


AFFORD_BASE = (
    "select SK_ID_CURR, AMT_INCOME_TOTAL annual_income, AMT_CREDIT principal, 36 as months, "
    "case when SK_ID_CURR % 2 = 0 then AMT_ANNUITY end emi, cast((SK_ID_CURR * 31) % 1000 as double) / 4000 p from v_raw"
)
PER_EMI = "((1 - pow(1.01::double, -36.0::double)) / 0.01::double)"
AFFORD = (
    "select *, e / (annual_income / 12) burden from (select *, case when annual_income > 0 then coalesce(emi, principal * 0.01::double / (1 - pow(1.01::double, -36.0::double))) end e from afford_base)"
)
LEVEL = "case when burden <= 0.2 then 'Low' when burden <= 0.4 then 'Moderate' when burden is not null then 'High' end"
SCORE = "case when burden <= 0.2 then 100 when burden <= 0.4 then 100 - (burden - 0.2) * 250 when burden is not null then greatest(0, 50 - (burden - 0.4) * (50 / 0.6::double)) end"
AFFORD_STEPS = {"afford_base": AFFORD_BASE, "afford": AFFORD}


def _afford_base(spark: SparkSession, sf: str) -> DataFrame:
    return views.raw_applications(spark, sf).select(
        ID, F.col("AMT_INCOME_TOTAL").alias("annual_income"), F.col("AMT_CREDIT").alias("principal"),
        F.lit(36).alias("months"), F.when(F.col(ID) % 2 == 0, F.col("AMT_ANNUITY")).alias("emi"),
        ((F.col(ID) * 31) % 1000 / F.lit(4000.0)).alias("p"),
    )


@query("affordability", with_views(
    ["v_raw"], f"select SK_ID_CURR, round(burden, 9) burden, {LEVEL} affordability_level, round(cast({SCORE} as double), 6) affordability_score, "
    "round(case when e is not null then annual_income / 12 * 0.3::double end, 6) recommended_max_emi from afford", AFFORD_STEPS))
def _affordability(spark: SparkSession, sf: str) -> DataFrame:
    out = R.affordability(_afford_base(spark, sf))
    out = out.select(ID, "burden", "affordability_level", "affordability_score", "recommended_max_emi")
    return rounded(rounded(out, 9, "burden"), 6, "affordability_score", "recommended_max_emi")


RANGES_SQL = " union all ".join(
    f"select SK_ID_CURR, {i} range_no, '{label}' \"label\", round(annual_income / 12 * {lo}::double * {PER_EMI}, 4) range_min, "
    f"round(annual_income / 12 * {hi}::double * {PER_EMI}, 4) range_max from afford_base where annual_income > 0"
    for i, (label, lo, hi) in enumerate((("Conservative Loan Range", 0.1, 0.2), ("Moderate Loan Range", 0.2, 0.25), ("Maximum Suggested Loan Range", 0.25, 0.3)), 1))


@query("loan_ranges", with_views(["v_raw"], RANGES_SQL, AFFORD_STEPS))
def _ranges(spark: SparkSession, sf: str) -> DataFrame:
    out = R.loan_ranges(_afford_base(spark, sf)).select(ID, "range_no", "label", "range_min", "range_max")
    return rounded(out, 4, "range_min", "range_max")


def _between(lo: float, hi: float) -> str:
    return f"principal >= annual_income / 12 * {lo}::double * {PER_EMI} and principal <= annual_income / 12 * {hi}::double * {PER_EMI}"


@query("matching_range", with_views(
    ["v_raw"], f"select SK_ID_CURR, case when annual_income > 0 then case when principal < annual_income / 12 * 0.1::double * {PER_EMI} then 'below' "
    f"when {_between(0.1, 0.2)} then 'Conservative Loan Range' when {_between(0.2, 0.25)} then 'Moderate Loan Range' "
    f"when {_between(0.25, 0.3)} then 'Maximum Suggested Loan Range' else 'above' end end matching_range from afford_base", AFFORD_STEPS))
def _matching(spark: SparkSession, sf: str) -> DataFrame:
    return R.matching_range(_afford_base(spark, sf)).select(ID, "matching_range")


RANK_OF = "case {0} when 'Low' then 0 when 'Moderate' then 1 when 'High' then 2 end"
COMBINED_SQL = (
    f"select SK_ID_CURR, model_level, case when lvl is null or model_level is null then null else ['Low', 'Moderate', 'High'][greatest({RANK_OF.format('model_level')}, {RANK_OF.format('lvl')}) + 1] end final_level, "
    f"cast(coalesce({RANK_OF.format('lvl')} > {RANK_OF.format('model_level')}, false) as integer) overridden from ("
    f"select *, {LEVEL} lvl, case when p < lo then 'Low' when p < hi then 'Moderate' else 'High' end model_level from afford, "
    "(select quantile_cont(p, 0.33) lo, quantile_cont(p, 0.66) hi from afford_base))"
)


@query("combined_level", with_views(["v_raw"], COMBINED_SQL, AFFORD_STEPS))
def _combined(spark: SparkSession, sf: str) -> DataFrame:
    base = _afford_base(spark, sf)
    low, high = R.relative_cutoffs(base)
    out = R.combined_level(R.affordability(base), low, high)
    return out.select(ID, "model_level", "final_level", F.col("overridden").cast("int").alias("overridden"))


@query("level_distribution", with_views(
    ["v_raw"], f"select final_level, count(*) n_rows from ({COMBINED_SQL}) where final_level is not null group by 1", AFFORD_STEPS))
def _levels(spark: SparkSession, sf: str) -> DataFrame:
    out = _combined(spark, sf).where(F.col("final_level").isNotNull())
    return out.groupBy("final_level").agg(F.count(F.lit(1)).alias("n_rows"))
