"""Catalogue: ledger, dashboard and audit jobs, segmentation."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.errors import ContractError
from loanloom.functions.digest import table_digest
from loanloom.operators import evaluation as E
from loanloom.operators import ledger as L
from loanloom.operators import segmentation as S
from loanloom.operators.lloyd import Fit
from loanloom.operators.preparation import SegmentPreparation
from loanloom.plans import application_queries as A
from loanloom.plans import views
from loanloom.plans.registry import query, rounded
from loanloom.plans.views import with_views
from loanloom.session import ensure_checkpoint_dir

# ---------------------------------------------------------------- ledger
BAND = "case when o_orderkey % 100 < 5 then 'Low' when o_orderkey % 100 < 15 then 'Medium' else 'High' end"


def _ledger(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    orders = views.table(spark, sf, "orders")
    return {
        "predictions": orders.selectExpr("o_orderkey as prediction_id", "o_orderkey % 100 / cast(100 as double) as calibrated_pd",
                                         "o_orderpriority as model_version_id", "o_orderstatus as quality_flags"),
        "scores": orders.where("o_orderkey % 19 <> 4").selectExpr("o_orderkey as prediction_id", "cast(o_orderkey % 100 as double) as risk_score", f"{BAND} as risk_band"),
        "decisions": orders.selectExpr("o_orderkey * 10 as decision_id", "o_orderkey as prediction_id", "'MANUAL_REVIEW' as recommendation"),
        "models": orders.select("o_orderpriority").distinct().selectExpr("o_orderpriority as model_version_id", "concat('release-', substring(o_orderpriority, 1, 1)) as release_name"),
        "applications": orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("k")).selectExpr("o_custkey as application_id", "k * 10 as current_decision_id"),
    }


@query("result_view",
       "select o_custkey application_id, o_orderkey prediction_id, o_orderkey % 100 / 100::double probability, cast(o_orderkey % 100 as double) risk_score, "
       f"{BAND} risk_band, 'MANUAL_REVIEW' recommendation, concat('release-', substring(o_orderpriority, 1, 1)) model_version, o_orderstatus quality_flags "
       "from orders where o_orderkey in (select max(o_orderkey) from orders group by o_custkey) and o_orderkey % 19 <> 4")
def _result_view(spark: SparkSession, sf: str) -> DataFrame:
    return L.result_view(**_ledger(spark, sf))


@query("application_detail",
       "select o_custkey application_id, c current_version, k input_json, case when k % 7 <> 2 then floor(p / 36) end monthly_payment, case when k % 7 <> 2 then 0.12::double end annual_rate, "
       "case when k % 7 <> 2 then 36 end term_months, case when k % 19 <> 4 then k % 100 / 100::double end probability, "
       "case when k % 19 <> 4 then case when k % 100 < 5 then 'Low' when k % 100 < 15 then 'Medium' else 'High' end end risk_band from ("
       "select o_custkey, count(*) c, max(o_orderkey) k, max_by(o_totalprice, o_orderkey) p from orders group by 1)")
def _detail(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer stand for versions of an application; some versions have no quote."""
    parts = _ledger(spark, sf)
    orders = views.table(spark, sf, "orders")
    apps = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("current_version"), F.max("o_orderkey").alias("k"))
    latest = apps.select(F.col("o_custkey").alias("application_id"), F.col("current_version").alias("version"), F.col("k").alias("version_id"), F.col("k").alias("input_json"))
    quotes = orders.where("o_orderkey % 7 <> 2").selectExpr(
        "o_orderkey as version_id", "cast(floor(o_totalprice / 36) as double) as monthly_payment", "cast(0.12 as double) as annual_rate", "36 as term_months")
    applications = apps.select(F.col("o_custkey").alias("application_id"), "current_version")
    return L.application_detail(applications, latest, quotes, L.result_view(**parts))


@query("import_analyses",
       "select o_custkey owner_id, l_orderkey import_id, o_orderpriority label, l_linenumber analysis_no from lineitem join orders on o_orderkey = l_orderkey")
def _import_analyses(spark: SparkSession, sf: str) -> DataFrame:
    imports = views.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("import_id"), F.col("o_custkey").alias("owner_id"), F.col("o_orderpriority").alias("label"))
    analyses = views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("import_id"), F.col("l_linenumber").alias("analysis_no"))
    return L.import_analyses(imports, analyses)


@query("application_page",
       "select o_orderkey id, cast(cast(o_orderdate as date) as string) created_at, o_totalprice from orders order by o_orderdate desc, o_orderkey limit 20 offset 40")
def _page(spark: SparkSession, sf: str) -> DataFrame:
    orders = views.table(spark, sf, "orders").selectExpr("o_orderkey as id", "cast(cast(o_orderdate as date) as string) as created_at", "o_totalprice")
    return L.page(orders, 20, 40)


@query("application_page_after",
       "select o_orderkey id, cast(cast(o_orderdate as date) as string) created_at, o_totalprice from orders "
       "where cast(cast(o_orderdate as date) as string) < '1996-06-30' or (cast(cast(o_orderdate as date) as string) = '1996-06-30' and o_orderkey > 5000) "
       "order by o_orderdate desc, o_orderkey limit 20")
def _page_after(spark: SparkSession, sf: str) -> DataFrame:
    orders = views.table(spark, sf, "orders").selectExpr("o_orderkey as id", "cast(cast(o_orderdate as date) as string) as created_at", "o_totalprice")
    return L.page_after(orders, 20, ("1996-06-30", 5000))


@query("page_total", "select count(*) total from orders")
def _page_total(spark: SparkSession, sf: str) -> DataFrame:
    return L.page_total(views.table(spark, sf, "orders"))


@query("entity_counts", " union all ".join(f"select '{t}' entity, count(*) n_rows from {t}" for t in ("customer", "orders", "lineitem", "events")))
def _entities(spark: SparkSession, sf: str) -> DataFrame:
    return L.entity_counts({t: views.table(spark, sf, t) for t in ("customer", "orders", "lineitem", "events")})


@query("daily_trend",
       "select cast(cast(ts as date) as string) \"day\", count(*) applications, round(avg(case when event_type <> 'error' then case when v <= 0.2 then 100 when v <= 0.4 then 100 - (v - 0.2) * 250 "
       "else greatest(0, 50 - (v - 0.4) * (50 / 0.6::double)) end end), 6) health from (select *, value / 200 v from events) group by 1")
def _trend(spark: SparkSession, sf: str) -> DataFrame:
    from loanloom.functions.finance import affordability_score

    events = views.table(spark, sf, "events").withColumn("score", affordability_score(F.col("value") / 200))
    out = L.daily_trend(events, "ts", "score", F.col("event_type") != "error")
    return rounded(out.withColumn("day", F.col("day").cast("string")), 6, "health")


@query("event_timeline", "select user_id, event_id, event_type from events order by user_id, ts, event_id")
def _timeline(spark: SparkSession, sf: str) -> DataFrame:
    return L.event_timeline(views.table(spark, sf, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("rate_limit_breaches",
       "select user_id, cast(epoch_us(ts) as bigint) ts_us, at_once, in_window from (select user_id, ts, cast(count(*) as bigint) at_once, "
       "cast(max(c) as bigint) in_window from (select user_id, ts, count(*) over (partition by user_id order by ts range between interval 1 day preceding and current row) c from events) "
       "group by 1, 2) where in_window >= 5")
def _breaches(spark: SparkSession, sf: str) -> DataFrame:
    out = L.rate_breaches(views.table(spark, sf, "events"), "user_id", "ts", 86_400, 5)
    return out.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "at_once", "in_window")


def _text(c: str) -> str:
    return f"coalesce(concat(cast(length(cast({c} as string)) as string), ':', cast({c} as string)), '-')"


DIGEST_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "cast(round(o_totalprice * 100) as bigint)"]


@query("table_fingerprint",
       "select count(*) row_count, cast(sum(cast(w as hugeint)) as string) digest_sum, cast(bit_xor(w) as bigint) digest_xor from (select cast(concat('0x', substring(md5(concat_ws('|', "
       + ", ".join(_text(c) for c in DIGEST_COLUMNS) + ")), 1, 15)) as bigint) w from orders)")
def _fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return table_digest(views.table(spark, sf, "orders"), [F.expr(c) for c in DIGEST_COLUMNS])


@query("changed_tables", "select 'customer' table_name, 'REMOVED' change union all select 'orders', 'CHANGED' union all select 'nation', 'ADDED' from (select count(*) from orders)")
def _changed(spark: SparkSession, sf: str) -> DataFrame:
    """Orders lose one row, customers vanish, nations appear, events stay as they are."""
    orders, events = views.table(spark, sf, "orders"), views.table(spark, sf, "events")
    before = L.fingerprints({"orders": orders, "events": events, "customer": views.table(spark, sf, "customer")})
    after = L.fingerprints({"orders": orders.where("o_orderkey <> 7"), "events": events.repartition(5), "nation": views.table(spark, sf, "nation")})
    return L.changed_tables(before, after)


LANG_LADDER = (
    "select lang, p, pos, neg, sum(pos) over (partition by lang order by p desc) tp, sum(neg) over (partition by lang order by p desc) fp from (select lang, p, "
    "count(*) filter (where y = 1) pos, count(*) filter (where y = 0) neg from fold_scores group by 1, 2)"
)
LANG_STEPS = {
    "fold_scores": "select s.*, d.lang from v_scored s join documents d on d.doc_id = s.id",
    "lang_ladder": LANG_LADDER,
    "lang_metrics": "select l.lang model, round(cast(sum(neg * (2 * (tp - pos) + pos)) as double) / nullif(2.0::double * sum(pos) * sum(neg), 0), 9) roc_auc, "
                    "round(sum(pos * cast(tp as double) / (tp + fp)) / nullif(sum(pos), 0), 9) average_precision, max(brier) brier, max(log_loss) log_loss from lang_ladder l join ("
                    "select lang, round(avg((p - y) * (p - y)), 9) brier, round(avg(-case when y = 1 then ln(p) else ln(1 - p) end), 9) log_loss from fold_scores group by 1) b on b.lang = l.lang group by 1",
}


def _lang_metrics(spark: SparkSession, sf: str) -> DataFrame:
    langs = views.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    scored = views.scored(spark, sf).join(langs, "id")
    ranks = E.rank_metrics(scored, groups=["lang"]).select("lang", "roc_auc", "average_precision")
    losses = E.probability_losses(scored, eps=1e-7, groups=["lang"]).drop("n_rows")
    return rounded(ranks.join(losses, "lang"), 9, "roc_auc", "average_precision", "brier", "log_loss").withColumnRenamed("lang", "model")


@query("leaderboard", with_views(
    ["v_scored"], "select *, cast(row_number() over (order by brier, roc_auc desc, model, calibration) as integer) rank from (select model, calibration, avg(brier) brier, "
    "avg(roc_auc) roc_auc, avg(average_precision) average_precision from (select model, 'sigmoid' calibration, brier, roc_auc, average_precision from lang_metrics union all "
    "select model, 'sigmoid', brier + 0.5, roc_auc - 0.25, average_precision from lang_metrics union all "
    "select model, 'isotonic', brier + 0.25, roc_auc, average_precision from lang_metrics) group by 1, 2)", LANG_STEPS))
def _leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """Per-language metrics stand for candidates; the folds are shifted copies."""
    m = _lang_metrics(spark, sf).select("model", "brier", "roc_auc", "average_precision")
    folds = (
        m.withColumn("calibration", F.lit("sigmoid"))
        .unionByName(m.select("model", F.lit("sigmoid").alias("calibration"), (F.col("brier") + 0.5).alias("brier"),
                              (F.col("roc_auc") - 0.25).alias("roc_auc"), "average_precision"))
        .unionByName(m.select("model", F.lit("isotonic").alias("calibration"), (F.col("brier") + 0.25).alias("brier"), "roc_auc", "average_precision"))
    )
    return L.leaderboard(folds)


DELTAS = ", ".join(f"round({m} - max(case when model = 'en' then {m} end) over (), 9) {m}_delta" for m in L.METRICS)


LANGUAGE_BINS = {
    "lang_scores": "select d.lang, s.p, s.y from v_scored s join documents d on d.doc_id = s.id",
    "lang_edges": "select lang, " + ", ".join(f"quantile_cont(p, {i / 10}) e{i}" for i in range(1, 10)) + " from lang_scores group by 1",
    "lang_bins": "select lang, bin, count(*) n, avg(p) p, avg(y::double) y from (select s.*, " + " + ".join(f"cast(p > e{i} as integer)" for i in range(1, 10))
                 + " bin from lang_scores s join lang_edges e using (lang)) group by 1, 2",
    "lang_curves": "select lang, string_agg(concat_ws(':', bin, n, round(p * 1e6)::bigint, round(y * 1e6)::bigint), '|' order by bin) bins from lang_bins group by 1",
}


@query("research_summary", with_views(
    ["v_scored"], f"select model, dataset_size, {', '.join(L.METRICS)}, {DELTAS}, cast(row_number() over (order by brier, roc_auc desc, model) as integer) rank, bins calibration_bins, "
    "concat('all:17:', round(brier * 1e6)::bigint, '|without history:12:', round((brier + 0.5) * 1e6)::bigint) ablations from lang_metrics "
    "join (select lang, count(*) dataset_size from documents group by 1) r on r.lang = model join lang_curves c on c.lang = model", {**LANG_STEPS, **LANGUAGE_BINS}))
def _summary(spark: SparkSession, sf: str) -> DataFrame:
    """Languages stand for models; a shifted copy of a model's metrics stands for its ablation."""
    langs = views.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    runs = langs.groupBy(F.col("lang").alias("model")).agg(F.count(F.lit(1)).alias("dataset_size"))
    metrics = _lang_metrics(spark, sf)
    scored = views.scored(spark, sf).join(langs, "id")
    curves = None
    for r in runs.select("model").orderBy("model").collect():  # the registry's models
        part = E.calibration_bins(scored.where(F.col("lang") == r["model"])).withColumn("model", F.lit(r["model"]))
        curves = part if curves is None else curves.unionByName(part)
    kinds = [("all", 17, 0.0), ("without history", 12, 0.5)]
    variants = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(k).alias("feature_count"), (F.col("brier") + d).alias("brier")) for v, k, d in kinds]))
    ablations = metrics.where("roc_auc is not null or brier is not null").select("model", variants.alias("v")).select("model", "v.*")
    out = L.research_summary(runs, metrics, "en", curves, ablations)

    def millionths(value):
        return F.round(value * 1_000_000).cast("bigint")

    bins = F.transform("calibration_bins", lambda b: F.concat_ws(
        ":", b["bin"], b["n_rows"], millionths(b["mean_predicted_probability"]), millionths(b["observed_rate"])))
    kept = F.transform("ablations", lambda v: F.concat_ws(":", v["variant"], v["feature_count"], millionths(v["brier"])))
    out = out.withColumns({"calibration_bins": F.array_join(bins, "|"), "ablations": F.array_join(kept, "|")})
    return rounded(out, 9, *[f"{m}_delta" for m in L.METRICS])


@query("unmapped_features", "select event_type feature, count(*) n_rows from events where event_type in ('signup', 'error') group by 1")
def _unmapped(spark: SparkSession, sf: str) -> DataFrame:
    used = views.table(spark, sf, "events").groupBy(F.col("event_type").alias("feature")).agg(F.count(F.lit(1)).alias("n_rows"))
    groups = spark.createDataFrame([("view", "A"), ("click", "A"), ("purchase", "B")], "feature string, grp string")
    return L.unmapped_features(used, groups)


# ---------------------------------------------------------------- segmentation
CLUSTERED = {
    "dims": "select vec_id, \"label\" l, unnest(embedding)::double x, unnest(range(1, len(embedding) + 1)) d from embeddings",
    "cent": "select l, d, avg(x) c from dims group by 1, 2",
    "scat": "select l, avg(dist) s from (select a.vec_id, a.l, sqrt(sum((x - c) * (x - c))) dist from dims a join cent b on a.l = b.l and a.d = b.d group by 1, 2) group by 1",
    "pairs": "select a.l la, b.l lb, sqrt(sum((a.c - b.c) * (a.c - b.c))) dist from cent a join cent b on a.d = b.d and a.l <> b.l group by 1, 2",
}


@query("davies_bouldin", with_views(
    [], "select round(avg(w), 9) davies_bouldin from (select la, max((x.s + y.s) / dist) w from pairs join scat x on x.l = la join scat y on y.l = lb group by 1)", CLUSTERED))
def _db(spark: SparkSession, sf: str) -> DataFrame:
    value = S.davies_bouldin(views.table(spark, sf, "embeddings"), "label", "embedding")
    return spark.createDataFrame([(round(value, 9),)], "davies_bouldin double")


@query("cluster_scatter", with_views([], "select l \"label\", n size, round(s, 9) scatter from scat join (select \"label\" k, count(*) n from embeddings group by 1) on k = l", CLUSTERED))
def _scatter(spark: SparkSession, sf: str) -> DataFrame:
    out = S.cluster_scatter(views.table(spark, sf, "embeddings"), "label", "embedding").drop("centroid")
    return rounded(out, 9, "scatter")


@query("adjusted_rand",
       "select round((c - r * k / t) / ((r + k) / 2 - r * k / t), 9) adjusted_rand from (select (select sum(n * (n - 1) / 2) from (select count(*)::double n from a group by x, y)) c, "
       "(select sum(n * (n - 1) / 2) from (select count(*)::double n from a group by x)) r, (select sum(n * (n - 1) / 2) from (select count(*)::double n from a group by y)) k, "
       "(select count(*)::double * (count(*) - 1) / 2 from a) t)".replace("from a ", "from (select \"label\" x, case when vec_id % 3 = 0 then 0 else \"label\" // 2 end y from embeddings) a ")
       .replace("from a)", "from (select \"label\" x, case when vec_id % 3 = 0 then 0 else \"label\" // 2 end y from embeddings) a)"))
def _ari(spark: SparkSession, sf: str) -> DataFrame:
    labeled = views.table(spark, sf, "embeddings").selectExpr("label as x", "case when vec_id % 3 = 0 then 0 else cast(floor(label / 2) as int) end as y")
    return rounded(S.adjusted_rand(labeled, "x", "y"), 9, "adjusted_rand")


@query("cluster_shares", "select \"label\", count(*) size, cast(count(*) as double) / (select count(*) from embeddings) share from embeddings group by 1")
def _shares(spark: SparkSession, sf: str) -> DataFrame:
    return S.cluster_shares(views.table(spark, sf, "embeddings"), "label")


@query("segment_outcomes", with_views(
    ["v_scored"], "select concat('Segment ', cast(id % 4 + 1 as string)) segment, count(*) customers, avg(cast(y as double)) observed_rate from v_scored group by 1"))
def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return S.segment_outcomes(views.scored(spark, sf).withColumn("c", F.col("id") % 4), "c", "y")


MEASURES = {
    "income": "AMT_INCOME_TOTAL", "requested": "AMT_CREDIT", "age": "DAYS_BIRTH", "tenure": "CNT_CHILDREN",
    "inquiries_1m": "AMT_REQ_CREDIT_BUREAU_MON", "inquiries_3m": "AMT_REQ_CREDIT_BUREAU_QRT", "inquiries_12m": "AMT_REQ_CREDIT_BUREAU_YEAR",
}
TRAITS = (
    "list_filter([case when mean_income >= c_income * 1.15 then 'higher-than-cohort-average income' when mean_income <= c_income * 0.85 then 'lower-than-cohort-average income' end, "
    "case when mean_requested >= c_requested * 1.15 then 'higher-than-cohort-average requested loan amount' when mean_requested <= c_requested * 0.85 then 'lower-than-cohort-average requested loan amount' end, "
    "case when mean_age >= c_age + 4 then 'higher average age' when mean_age <= c_age - 4 then 'lower average age' end, "
    "case when mean_tenure >= c_tenure + 2 then 'higher average employment tenure' when mean_tenure <= c_tenure - 2 then 'lower average employment tenure' end, "
    "case when mean_inquiries_1m + mean_inquiries_3m + mean_inquiries_12m > c_inquiries_1m + c_inquiries_3m + c_inquiries_12m + 0.25 then 'more recorded inquiry activity' "
    "when mean_inquiries_1m + mean_inquiries_3m + mean_inquiries_12m + 0.25 < c_inquiries_1m + c_inquiries_3m + c_inquiries_12m then 'less recorded inquiry activity' end], lambda x: x is not null)"
)


@query("segment_profiles", with_views(
    ["v_raw"], f"select segment, size, percentage, {', '.join(f'round(mean_{k}, 6) mean_{k}' for k in MEASURES)}, case when len({TRAITS}) > 0 then concat('This segment has ', array_to_string({TRAITS}, ', '), '.') "
    "else 'This segment is near cohort averages across the profiled measures.' end description from (select CNT_FAM_MEMBERS segment, count(*) size, count(*) * 100 / (select count(*) from v_raw) percentage, "
    + ", ".join(f"avg({c}::double) mean_{k}" for k, c in MEASURES.items()) + " from v_raw group by 1), (select " + ", ".join(f"avg({c}::double) c_{k}" for k, c in MEASURES.items()) + " from v_raw)"))
def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    raw = views.raw_applications(spark, sf).withColumnRenamed("CNT_FAM_MEMBERS", "segment")
    return rounded(S.segment_profiles(raw, "segment", MEASURES), 6, *[f"mean_{k}" for k in MEASURES])


SEGMENT_FEATURES = ["age_years", "annual_income", "requested_amount", "proposed_payment_income_ratio", "years_employed"]


def _stored(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """Segment features of all rows, and columns beside them; stored once, as many steps read them."""
    ensure_checkpoint_dir(spark)
    return A.lite(spark, sf).select("SK_ID_CURR", *SEGMENT_FEATURES, *more).checkpoint()


def _prepared(rows: DataFrame) -> DataFrame:
    """Scaled features of all rows."""
    scaled = SegmentPreparation(SEGMENT_FEATURES).fit(rows).transform(rows)
    return S.vectors(scaled.withColumnRenamed("SK_ID_CURR", "id"), SEGMENT_FEATURES, ["id"])


@query("segment_preparation", with_views(
    ["v_raw"], "select SK_ID_CURR, round((i - avg(i) over ()) / stddev_pop(i) over (), 6) annual_income, round((t - avg(t) over ()) / stddev_pop(t) over (), 6) years_employed from ("
    "select SK_ID_CURR, least(greatest(ln(1 + annual_income), i1), i99) i, coalesce(least(greatest(years_employed, case when years_employed is not null then t1 end), case when years_employed is not null then t99 end), t50) t "
    "from lite, (select quantile_cont(ln(1 + annual_income), 0.01) i1, quantile_cont(ln(1 + annual_income), 0.99) i99, quantile_cont(years_employed, 0.01) t1, quantile_cont(years_employed, 0.99) t99, "
    "quantile_cont(years_employed, 0.5) t50 from lite))", A.LITE_STEPS))
def _preparation(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.lite(spark, sf)
    out = SegmentPreparation(SEGMENT_FEATURES).fit(rows).transform(rows)
    return rounded(out.select("SK_ID_CURR", "annual_income", "years_employed"), 6, "annual_income", "years_employed")


SWEPT = "k int, rows bigint, silhouette double, inertia double, minimum_share double, davies_bouldin double, stability double"


def swept(points: DataFrame) -> DataFrame:
    """Diagnostics of every k over all rows, with the operator's own starts and seeds."""
    found = S.sweep(points, range(2, 8))
    names = [f.split()[0] for f in SWEPT.split(", ")]
    return points.sparkSession.createDataFrame([tuple(r[n] for n in names) for r in found], SWEPT)


@query("segment_k_sweep")
def _sweep(spark: SparkSession, sf: str) -> DataFrame:
    return swept(_prepared(_stored(spark, sf)))


@query("segment_sweep_facts", with_views(
    ["v_raw"], "select cast(k as integer) k, count(*) \"rows\", true compact, true shares_fit from lite, (select unnest([2, 3, 4, 5, 6, 7]) k) group by 1", A.LITE_STEPS))
def _sweep_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that the sweep has labelled, values within bounds, no inertia above that of one centre."""
    x = vector_to_array("features")
    points = _prepared(_stored(spark, sf))
    n, *spreads = points.agg(F.count(F.lit(1)), *[F.var_pop(x[i]) for i in range(len(SEGMENT_FEATURES))]).first()
    compact = (F.col("inertia") <= n * sum(spreads) + 1e-6) & F.col("silhouette").between(-1, 1) & (F.col("davies_bouldin") > 0)
    fit = F.col("minimum_share").between(0, 1 / F.col("k")) & F.col("stability").between(-1, 1)
    return swept(points).select("k", "rows", compact.alias("compact"), fit.alias("shares_fit"))


@query("segment_rules")
def _segment_rules(spark: SparkSession, sf: str) -> DataFrame:
    """What each release rule chooses of a sweep; null where it refuses all."""
    found = S.sweep(_prepared(_stored(spark, sf)), range(2, 8))
    rows = []
    for rule in (S.choose_by_silhouette, S.choose_by_compactness):
        try:
            rows.append((rule.__name__, rule(found), None))
        except ContractError as refusal:
            rows.append((rule.__name__, None, str(refusal)))
    return spark.createDataFrame(rows, "rule string, k int, refusal string")


def assigned(spark: SparkSession, sf: str) -> tuple[DataFrame, Fit]:
    points = _prepared(_stored(spark, sf))
    model = S.fit_kmeans(points, 4, starts=S.STARTS)
    return model.transform(points), model


@query("segment_assign")
def _assign(spark: SparkSession, sf: str) -> DataFrame:
    return assigned(spark, sf)[0].select("id", "cluster")


@query("segment_assign_facts", with_views(
    ["v_raw"], "select count(*) \"rows\", count(*) nearest, true sizes_agree from lite", A.LITE_STEPS))
def _assign_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows assigned, rows whose segment has the nearest centre, and the sizes that the fit itself has counted."""
    placed, model = assigned(spark, sf)
    x, mine = vector_to_array("features"), F.lit(None).cast("double")
    gaps = [sum(((x[i] - float(v)) ** 2 for i, v in enumerate(c)), F.lit(0.0)) for c in model.centers]
    for j, gap in enumerate(gaps):
        mine = F.when(F.col("cluster") == j, gap).otherwise(mine)
    sizes = F.lit(True)
    for j, n in enumerate(model.sizes):
        sizes = sizes & (F.count_if(F.col("cluster") == j) == int(n))
    return placed.agg(F.count(F.lit(1)).alias("rows"), F.count_if(mine <= F.least(*gaps) + 1e-9).alias("nearest"), sizes.alias("sizes_agree"))


SEGMENT_MEASURES = {
    "income": "annual_income", "requested": "requested_amount", "age": "age_years", "tenure": "years_employed",
    "inquiries_1m": "household_size", "inquiries_3m": "household_size", "inquiries_12m": "household_size",
}


def released(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, int]:
    """k chosen by the compactness rule, assigned to all rows, segments profiled."""
    stored = _stored(spark, sf, "household_size")
    assigned, model, _ = S.select_and_assign(_prepared(stored), rule=S.choose_by_compactness, stability=False)
    rows = stored.join(assigned.withColumnRenamed("id", "SK_ID_CURR"), "SK_ID_CURR")
    return S.segment_profiles(rows, "cluster", SEGMENT_MEASURES), assigned, len(model.centers)


@query("segment_release")
def _release(spark: SparkSession, sf: str) -> DataFrame:
    return released(spark, sf)[0]


@query("segment_release_facts", with_views(
    ["v_raw"], "select count(*) \"rows\", count(*) assigned, true profiled from lite", A.LITE_STEPS))
def _release_facts(spark: SparkSession, sf: str) -> DataFrame:
    profiles, assigned, k = released(spark, sf)
    whole = (F.count_if(F.length("description") > 0) == k) & (F.abs(F.sum("percentage") - 100) < 1e-6)
    return profiles.agg(F.sum("size").alias("rows"), F.lit(assigned.distinct().count()).cast("bigint").alias("assigned"), whole.alias("profiled"))


def projected(spark: SparkSession, sf: str) -> tuple[DataFrame, list[float]]:
    scaled = S.standardized(views.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id"), "embedding", ["id"], 64)
    return S.pca_projection(scaled)


@query("pca_2d")
def _pca(spark: SparkSession, sf: str) -> DataFrame:
    return projected(spark, sf)[0]


@query("pca_facts", "select count(*) \"rows\", 0.0::double mean_1, 0.0::double mean_2, true ordered from embeddings")
def _pca_facts(spark: SparkSession, sf: str) -> DataFrame:
    """All rows projected: components are centred, uncorrelated and the first has the larger variance."""
    points, shares = projected(spark, sf)
    variances = (F.var_pop("pca_1") >= F.var_pop("pca_2")) & (F.abs(F.corr("pca_1", "pca_2")) < 1e-6)
    centred = [(F.round(F.avg(f"pca_{i}"), 6) + 0.0).alias(f"mean_{i}") for i in (1, 2)]
    return points.agg(F.count(F.lit(1)).alias("rows"), *centred, (variances & F.lit(1 >= shares[0] >= shares[1] >= 0)).alias("ordered"))


@query("display_thinning", "select vec_id id from (select vec_id, row_number() over (order by vec_id) - 1 rk from embeddings) where rk % 4 = 0")
def _thinning(spark: SparkSession, sf: str) -> DataFrame:
    return S.thinned(views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")))
