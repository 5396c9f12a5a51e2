"""Catalogue: profiling and exploratory reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.operators import profiling as P
from loanloom.operators.application import BASE_NUMERIC, CATEGORICAL, ID
from loanloom.plans import application_queries as A
from loanloom.plans import views
from loanloom.plans.registry import as_bigint, query, rounded
from loanloom.plans.views import with_views

RAW = ["v_raw"]
AMOUNTS = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "CNT_CHILDREN"]
N_RAW = len(views.APPLICATION)


@query("overview", with_views(
    RAW, f"select count(*) n_rows, {N_RAW}::bigint n_columns, count(*) - count(distinct SK_ID_CURR) duplicate_ids, avg(cast(TARGET as double)) positive_rate, "
    "count(*) filter (where TARGET = 0) negatives, count(*) filter (where TARGET = 1) positives, "
    "cast(count(*) filter (where TARGET = 0) as double) / count(*) filter (where TARGET = 1) imbalance_ratio from v_raw"))
def _overview(spark: SparkSession, sf: str) -> DataFrame:
    return P.overview(views.raw_applications(spark, sf), ID, "TARGET")


MISSING_SQL = " union all ".join(
    f"select '{c}' \"column\", count(*) - count({c}) missing_rows, cast(count(*) - count({c}) as double) / count(*) missing_fraction from v_raw"
    for c in views.APPLICATION)


@query("missing_report", with_views(RAW, MISSING_SQL))
def _missing(spark: SparkSession, sf: str) -> DataFrame:
    return P.missing_report(views.raw_applications(spark, sf))


@query("missing_ranked", with_views(RAW, f"select * from ({MISSING_SQL}) where missing_rows > 0 order by missing_fraction desc, 1 limit 5"))
def _missing_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return P.ranked_missing(views.raw_applications(spark, sf), top=5)


DESCRIBE_SQL = " union all ".join(
    f"select '{c}' \"column\", count({c}) known_rows, round(avg({c}), 6) mean, round(stddev_samp({c}), 6) std, "
    f"cast(min({c}) as double) minimum, cast(max({c}) as double) maximum, round(quantile_cont({c}::double, 0.25), 6) p25, "
    f"round(quantile_cont({c}::double, 0.5), 6) p50, round(quantile_cont({c}::double, 0.75), 6) p75 from v_raw" for c in AMOUNTS)


@query("describe_numeric", with_views(RAW, DESCRIBE_SQL))
def _describe(spark: SparkSession, sf: str) -> DataFrame:
    out = P.describe_numeric(views.raw_applications(spark, sf), AMOUNTS)
    return rounded(out, 6, "mean", "std", "p25", "p50", "p75")


CODES = ["NAME_INCOME_TYPE", "NAME_EDUCATION_TYPE", "OCCUPATION_TYPE"]


@query("describe_text", with_views(RAW, " union all ".join(
    f"select '{c}' \"column\", cast(sum(n) as bigint) known_rows, count(*) distinct_values, min_by(v, (-n, v)) top, max(n) top_rows "
    f"from (select {c} v, count(*) n from v_raw where {c} is not null group by 1)" for c in CODES)))
def _describe_text(spark: SparkSession, sf: str) -> DataFrame:
    return P.describe_text(views.raw_applications(spark, sf), CODES)


@query("category_counts", with_views(RAW, " union all ".join(
    f"select '{c}' \"column\", {c} \"value\", count(*) n_rows from v_raw where {c} is not null group by 2" for c in CODES)))
def _categories(spark: SparkSession, sf: str) -> DataFrame:
    return P.category_counts(views.raw_applications(spark, sf), CODES)


IQR_SQL = " union all ".join(
    f"select '{c}' \"column\", count(*) filter (where {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) iqr_outliers, "
    f"cast(max({c}) as double) maximum, round(max(p99), 6) p99 from v_raw, (select quantile_cont({c}::double, 0.25) q1, quantile_cont({c}::double, 0.75) q3, "
    f"quantile_cont({c}::double, 0.99) p99 from v_raw)" for c in AMOUNTS)


@query("iqr_outliers", with_views(RAW, IQR_SQL))
def _iqr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.iqr_outliers(views.raw_applications(spark, sf), AMOUNTS), 6, "p99")


@query("sentinel_counts", with_views(
    RAW, "select 'DAYS_EMPLOYED' \"column\", count(*) filter (where DAYS_EMPLOYED = 365243) sentinel_rows from v_raw union all "
    "select 'NAME_EDUCATION_TYPE', count(*) filter (where NAME_EDUCATION_TYPE = 'Unlisted') from v_raw"))
def _sentinels(spark: SparkSession, sf: str) -> DataFrame:
    return P.sentinel_counts(views.raw_applications(spark, sf), {"DAYS_EMPLOYED": 365243, "NAME_EDUCATION_TYPE": "Unlisted"})


@query("relational_coverage", with_views(
    ["v_raw", "v_snap"], "select count(*) base_ids, count(*) filter (where SK_ID_CURR in (select SK_ID_CURR from v_snap)) covered_ids, "
    "cast(count(*) filter (where SK_ID_CURR in (select SK_ID_CURR from v_snap)) as double) / count(*) coverage from v_raw"))
def _coverage(spark: SparkSession, sf: str) -> DataFrame:
    return P.coverage(views.raw_applications(spark, sf), views.snapshots(spark, sf), ID)


@query("rate_by_category", with_views(
    RAW, "select coalesce(OCCUPATION_TYPE, 'MISSING') group_value, avg(cast(TARGET as double)) rate, count(*) n_rows from v_raw group by 1 having count(*) >= 20"))
def _rate(spark: SparkSession, sf: str) -> DataFrame:
    return P.rate_by(views.raw_applications(spark, sf), "OCCUPATION_TYPE", "TARGET", 20)


@query("rate_by_category_top", with_views(
    RAW, "select coalesce(OCCUPATION_TYPE, 'MISSING') group_value, avg(cast(TARGET as double)) rate, count(*) n_rows from v_raw group by 1 having count(*) >= 20 "
    "order by rate desc, group_value limit 3"))
def _rate_top(spark: SparkSession, sf: str) -> DataFrame:
    return P.rate_by_top(views.raw_applications(spark, sf), "OCCUPATION_TYPE", "TARGET", 20, 3)


AGE_CASE = "case " + " ".join(
    f"when age >= {lo} and age < {hi} then '[{lo}, {hi})'" for lo, hi in zip(P.AGE_EDGES, P.AGE_EDGES[1:])) + " else 'MISSING' end"


@query("rate_by_age", with_views(
    RAW, f"select {AGE_CASE} group_value, avg(cast(TARGET as double)) rate, count(*) n_rows from (select *, -DAYS_BIRTH / 365.25::double age from v_raw) group by 1"))
def _rate_age(spark: SparkSession, sf: str) -> DataFrame:
    return P.rate_by_age(views.raw_applications(spark, sf), -F.col("DAYS_BIRTH") / 365.25, "TARGET")


DECILE = " + ".join(f"cast(AMT_CREDIT > d{i} as integer)" for i in range(1, 10))


@query("rate_by_decile", with_views(
    RAW, f"select cast({DECILE} as string) group_value, avg(cast(TARGET as double)) rate, count(*) n_rows from v_raw, (select "
    + ", ".join(f"quantile_cont(AMT_CREDIT, {i / 10}) d{i}" for i in range(1, 10)) + " from v_raw) group by 1"))
def _rate_decile(spark: SparkSession, sf: str) -> DataFrame:
    return P.rate_by_quantile(views.raw_applications(spark, sf), "AMT_CREDIT", "TARGET")


HIST = "least(greatest(cast(floor((AMT_CREDIT - lo) / ((hi - lo) / 40)) as integer), 0), 39)"
RANGE = "(select min(AMT_CREDIT) lo, max(AMT_CREDIT) hi from v_raw)"


@query("histogram", with_views(
    RAW, f"select {HIST} bin, count(*) n_rows, round(max(lo) + {HIST} * ((max(hi) - max(lo)) / 40), 6) bin_start from v_raw, {RANGE} group by {HIST}"))
def _histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.histogram(views.raw_applications(spark, sf), "AMT_CREDIT", 40), 6, "bin_start")


@query("histogram_by_target", with_views(
    RAW, f"select h.TARGET, bin, n_rows, round(n_rows / (size * width), 12) density from (select TARGET, {HIST} bin, count(*) n_rows, max((hi - lo) / 40) width "
    f"from v_raw, {RANGE} group by 1, 2) h join (select TARGET, count(*) size from v_raw group by 1) s on h.TARGET = s.TARGET"))
def _histogram_by(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.histogram(views.raw_applications(spark, sf), "AMT_CREDIT", 40, "TARGET"), 12, "density")


CORR_COLUMNS = ["DAYS_BIRTH", "DAYS_EMPLOYED", "AMT_INCOME_TOTAL", "AMT_CREDIT", "CNT_FAM_MEMBERS", "CNT_CHILDREN", "EXT_SOURCE_1", "EXT_SOURCE_3"]


@query("correlations", with_views(
    RAW, "select * from (" + " union all ".join(f"select '{c}' \"column\", round(corr({c}, TARGET), 9) correlation from v_raw" for c in CORR_COLUMNS)
    + ") order by abs(correlation) desc, 1 limit 6"))
def _correlations(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.correlations(views.raw_applications(spark, sf), "TARGET", CORR_COLUMNS, 6), 9, "correlation")


ELIGIBLE = {**A.ADAPT_STEPS, "eligible": "select SK_ID_CURR from adapted where reason is null"}


def _profile_sql(rows: str) -> str:
    return (
        f"select cast(count(*) as bigint) raw_rows, (select count(*) from eligible) eligible_applicants, "
        f"(select count(distinct SK_ID_CURR) from src where SK_ID_CURR in (select SK_ID_CURR from eligible)) applicants_with_rows, "
        f"count(*) filter (where SK_ID_CURR is null) orphan_rows, count(*) filter (where ev > 0) future_rows, "
        f"100 * cast((select count(distinct SK_ID_CURR) from src where SK_ID_CURR in (select SK_ID_CURR from eligible)) as double) / (select count(*) from eligible) coverage_pct, "
        f"(select quantile_cont(n::double, 0.5) from per) rows_p50, (select quantile_cont(n::double, 0.95) from per) rows_p95 from src"
    )


PER = "select e.SK_ID_CURR, count(s.SK_ID_CURR) n from eligible e left join src s on e.SK_ID_CURR = s.SK_ID_CURR group by 1"


@query("source_coverage", with_views(
    ["v_raw", "v_bureau"], _profile_sql("src"), {**ELIGIBLE, "src": "select SK_ID_CURR, DAYS_CREDIT ev from v_bureau", "per": PER}))
def _source(spark: SparkSession, sf: str) -> DataFrame:
    eligible = A.lite(spark, sf).select(ID)
    out = P.source_profile(views.bureau(spark, sf), eligible, ID, "DAYS_CREDIT")
    return as_bigint(out, "raw_rows", "orphan_rows", "future_rows")


@query("source_coverage_via_owner", with_views(
    ["v_raw", "v_bureau", "v_raw_balance"], _profile_sql("src"),
    {**ELIGIBLE, "src": "select b.SK_ID_CURR, m.MONTHS_BALANCE ev from v_raw_balance m left join (select * from v_bureau where SK_ID_BUREAU % 10 <> 3) b "
     "using (SK_ID_BUREAU)", "per": PER}))
def _source_owner(spark: SparkSession, sf: str) -> DataFrame:
    """Owner map with a tenth of the accounts withheld, so unmapped rows are counted."""
    eligible = A.lite(spark, sf).select(ID)
    owners = views.bureau(spark, sf).where("SK_ID_BUREAU % 10 <> 3")
    out = P.source_profile(views.raw_balance(spark, sf), eligible, ID, "MONTHS_BALANCE", owners, "SK_ID_BUREAU")
    return as_bigint(out, "raw_rows", "orphan_rows", "future_rows")


QUALITY = ["user_id", "value", "event_type", "props"]


@query("column_quality", " union all ".join(
    f"select '{c}' \"column\", count(*) n_rows, 100 * cast(count(*) - count({c}) as double) / count(*) missing_pct, "
    f"count(*) filter (where {c} is not null and try_cast({c} as double) is null) invalid_numeric, count(*) filter (where try_cast({c} as double) < 0) negative_numeric, "
    f"min(try_cast({c} as double)) minimum, max(try_cast({c} as double)) maximum, round(avg(try_cast({c} as double)), 6) mean from events" for c in QUALITY))
def _column_quality(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.column_quality(views.table(spark, sf, "events"), QUALITY), 6, "mean")


FEATURES = [*BASE_NUMERIC, "occupation", "employment_tenure_missing", "principal_income_ratio", "bureau_account_count"]


def _feature_sql() -> str:
    parts = []
    for c in FEATURES:
        if c == "bureau_account_count":
            parts.append(
                "select 'bureau_account_count' feature, 'bureau' source_group, 'BLOCKED_NOT_GENERATED' status, count(*) n_rows, 0::double coverage_pct, 100::double missing_pct, "
                "null::bigint nonfinite, null::double minimum, null::double mean, null::double maximum, null::double p1, null::double p25, null::double p50, null::double p75, null::double p99 from lite")
            continue
        head = (f"select '{c}' feature, 'application' source_group, 'GENERATED' status, count(*) n_rows, 100 * cast(count({c}) as double) / count(*) coverage_pct, "
                f"100 * cast(count(*) - count({c}) as double) / count(*) missing_pct, ")
        if c in CATEGORICAL:
            parts.append(head + "null, null, null, null, null, null, null, null, null from lite")
        else:
            qs = ", ".join(f"round(quantile_cont({c}::double, {q}), 6)" for q in P.QUALITY_PROBS)
            parts.append(head + f"0, cast(min({c}) as double), round(avg({c}), 6), cast(max({c}) as double), {qs} from lite")
    return "select * from (" + " union all ".join(reversed(parts)) + ")"


@query("feature_quality", with_views(RAW, _feature_sql(), A.LITE_STEPS))
def _feature_quality(spark: SparkSession, sf: str) -> DataFrame:
    out = P.feature_quality(A.lite(spark, sf), FEATURES, {"bureau_account_count": "bureau"}, CATEGORICAL)
    return rounded(out, 6, "mean", "p1", "p25", "p50", "p75", "p99")


HISTS = ["annual_income", "requested_amount", "household_size"]


@query("feature_histograms", with_views(RAW, " union all ".join(
    f"select '{c}' feature, least(greatest(cast(floor(({c} - lo) / ((hi - lo) / 20)) as integer), 0), 19) bin, count(*) n_rows from lite, "
    f"(select min({c}) lo, max({c}) hi from lite) group by 2" for c in HISTS), A.LITE_STEPS))
def _feature_histograms(spark: SparkSession, sf: str) -> DataFrame:
    return P.feature_histograms(A.lite(spark, sf), HISTS)


@query("feature_inventory", with_views(
    RAW, "select feature, definition, case when q.f is not null then 'KEEP' else 'DROP' end recommendation, q.cov coverage_pct from (values "
    "('annual_income', 'yearly income'), ('occupation', 'canonical occupation'), ('missed_payment_count', 'not generated')) d(feature, definition) "
    "left join (select 'annual_income' f, 100 * cast(count(annual_income) as double) / count(*) cov from lite union all "
    "select 'occupation', 100 * cast(count(occupation) as double) / count(*) from lite) q on q.f = feature", A.LITE_STEPS))
def _inventory(spark: SparkSession, sf: str) -> DataFrame:
    quality = P.feature_quality(A.lite(spark, sf), ["annual_income", "occupation"], text=["occupation"])
    definitions = spark.createDataFrame(
        [("annual_income", "yearly income"), ("occupation", "canonical occupation"), ("missed_payment_count", "not generated")],
        "feature string, definition string",
    )
    return P.feature_inventory(quality, definitions).select("feature", "definition", "recommendation", "coverage_pct")


PSI_BIN = " + ".join(f"cast(v > d{i} as integer)" for i in range(1, 10))


@query("population_stability", with_views(
    [], "select coalesce(e.bin, a.bin) bin, coalesce(n_expected, 0) n_expected, coalesce(n_actual, 0) n_actual, "
    "round((greatest(coalesce(n_actual, 0) / sa, 1e-6::double) - greatest(coalesce(n_expected, 0) / se, 1e-6::double)) * ln(greatest(coalesce(n_actual, 0) / sa, 1e-6::double) / greatest(coalesce(n_expected, 0) / se, 1e-6::double)), 10) contribution "
    "from (select bin, count(*) n_expected from binned where side = 0 group by 1) e full join (select bin, count(*) n_actual from binned where side = 1 group by 1) a on e.bin = a.bin, "
    "(select cast(count(*) filter (where side = 0) as double) se, cast(count(*) filter (where side = 1) as double) sa from binned)",
    {"sides": "select o_totalprice v, cast(o_orderdate >= timestamp '1998-06-30' as integer) side from orders",
     "cutd": "select " + ", ".join(f"quantile_cont(v, {i / 10}) d{i}" for i in range(1, 10)) + " from sides where side = 0",
     "binned": f"select side, {PSI_BIN} bin from sides, cutd"}))
def _psi(spark: SparkSession, sf: str) -> DataFrame:
    orders = views.table(spark, sf, "orders")
    recent = F.col("o_orderdate") >= F.lit("1998-06-30").cast("timestamp_ntz")
    out = P.population_stability(orders.where(~recent), orders.where(recent), "o_totalprice")
    return rounded(out, 10, "contribution")
