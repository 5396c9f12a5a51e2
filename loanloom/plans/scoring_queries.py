"""Catalogue: batch scoring, the research dataset and the gates of a build."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.operators import application as P
from loanloom.operators import gates as G
from loanloom.operators import risk as R
from loanloom.operators.application import ID
from loanloom.plans import application_queries as A
from loanloom.plans import views
from loanloom.plans.evaluation_queries import SEEN_ROWS, SUPPORT_RANGES, SUPPORT_SQL
from loanloom.plans.registry import query
from loanloom.plans.scoring import Release, score_applications
from loanloom.plans.views import with_views

# a formula stands for the model, so that every value can be held against the oracle
PROBABILITY = "(10 + floor(least(cast(800 as double), proposed_payment_income_ratio * 400)) + dependent_children) / cast(1000 as double)"
REFERENCE_ROWS = "SK_ID_CURR % 4 = 0"
SCORE_STEPS = {
    **A.LITE_STEPS,
    "dev": f"select * from lite where {SEEN_ROWS}",
    "flagged": SUPPORT_SQL,
    "probe": f"select SK_ID_CURR, {PROBABILITY} p from lite",
    "below": f"select p, 100.0::double * (select count(*) from probe r where {REFERENCE_ROWS} and r.p <= d.p) / (select count(*) from probe where {REFERENCE_ROWS}) pct "
             "from (select distinct p from probe) d",
    "scored": "select a.SK_ID_CURR, a.reason, s.p, b.pct, coalesce(f.flags, []) flags from adapted a left join probe s on s.SK_ID_CURR = a.SK_ID_CURR "
              "left join below b on b.p = s.p left join flagged f on f.SK_ID_CURR = a.SK_ID_CURR",
}
ADVICE = "case when reason is null and len(flags) = 0 and p < 0.05 then 'APPROVAL_CANDIDATE' when reason is null and len(flags) = 0 and p >= 0.15 then 'REJECTION_CANDIDATE' else 'MANUAL_REVIEW' end"


@query("score_applications", with_views(
    ["v_raw"], "select SK_ID_CURR, 'formula-1' model_version, reason is null data_valid, reason, p calibrated_pd, round(100 * p, 2) risk_score, "
    "case when p < 0.05 then 'Low' when p < 0.15 then 'Medium' when p is not null then 'High' end risk_band, round(100 * (1 - p), 2) credit_health_index, "
    f"pct reference_percentile, array_to_string(flags, '|') data_quality_flags, {ADVICE} recommendation, 'MANUAL_REVIEW' decision_status, 'sandbox-v1' policy_version, "
    "array_to_string(list_filter(list_concat(['RESEARCH_ONLY', 'SELF_REPORTED_INPUT', reason], flags), lambda c: c is not null), '|') reason_codes from scored", SCORE_STEPS))
def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Every raw application, refused ones with their reason."""
    raw, rows = views.raw_applications(spark, sf), A.lite(spark, sf)

    def formula(df: DataFrame, keep) -> DataFrame:
        return df.select(*keep, F.expr(PROBABILITY).alias("p"))

    statistics = R.support_statistics(rows.where(SEEN_ROWS), SUPPORT_RANGES)
    release = Release("formula-1", formula, statistics, formula(rows.where(REFERENCE_ROWS), [ID]))
    out = score_applications(raw, release)
    return out.withColumns({c: F.array_join(c, "|") for c in ("data_quality_flags", "reason_codes")})


KEPT_EXTRAS = ["credit_bureau_inquiry_history_missing", "credit_bureau_inquiries_1m", "credit_bureau_inquiries_3m", "credit_bureau_inquiries_12m", "loan_to_goods_price_ratio"]


@query("research_dataset", with_views(
    ["v_raw"], f"select lite.*, {', '.join(KEPT_EXTRAS)} from lite join extras using (SK_ID_CURR)", {**A.LITE_STEPS, "extras": A.EXTRAS_SQL}))
def _research(spark: SparkSession, sf: str) -> DataFrame:
    """The contract of 22 features: 28 without the external scores and their flags."""
    return P.research_dataset(views.raw_applications(spark, sf))


MANIFEST = {"annuity_monthly_verified": True, "category_mapping_verified": False, "cash_product_verified": True, "currency": "inr", "evidence": "file"}
SOURCES = {
    "bureau": {"state": "COMPLETE", "evidence": "e1"}, "bureau_balance": {"state": "COMPLETE"},
    "previous_application": {"state": "CONFIRMED_EMPTY", "evidence": "e2"},
}


@query("gate_blockers", with_views(
    ["v_prev"], "select unnest(['Unresolved dataset gate: category_mapping_verified', 'Manifest needs currency/domain and evidence references', "
    "'Full unavailable: schedule_complete', 'Full unavailable: schedule_versions_resolved', 'Full unavailable: payment_identity_verified', 'Full unavailable: availability_verified', "
    "'Full source incomplete: bureau_balance', 'Full source incomplete: installments_payments', 'Full source incomplete: pos_cash_balance', 'Full source incomplete: credit_card_balance', "
    "'bureau: missing columns CREDIT_SCORE']) blocker union all select 'Nonempty source declared empty: previous_application' where exists (select 1 from v_prev)"))
def _gates(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest with open gates, an unproven source and one that is declared empty but has rows."""
    tables = {"bureau": views.bureau(spark, sf), "bureau_balance": views.balance(spark, sf), "previous_application": views.previous(spark, sf)}
    found = G.manifest_blockers(MANIFEST, "full") + G.source_blockers({"sources": SOURCES}, tables)
    found += G.column_blockers(tables, {"bureau": ["SK_ID_CURR", "CREDIT_SCORE"]})
    return G.blockers_frame(spark, found)
