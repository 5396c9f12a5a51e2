"""Every query with an oracle text equals DuckDB, and its plan is one that scales."""

import re

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from loanloom.plans import catalogue

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
# need at least 20 rows of each class, which the smallest scale does not have
MEDIUM_ONLY = {
    "cohort_split", "cohort_sizes", "partition_problems", "calibrate_facts", "score_batch_facts", "feature_ablation_facts",
    "permutation_importance_facts", "linear_attribution", "top_contributions", "train_compare_facts", "tree_attribution_facts",
}
# replicates are drawn in Arrow batches
ARROW = {"bootstrap_ci_facts"}
CANDIDATE_LISTS = {"leaderboard", "research_summary"}
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def connections():
    return {sf: connect(sf) for sf in (SMALL, MEDIUM)}


# the training-data queries have tests of their own
OWN = [name for name in entry.oracle_sql() if name in catalogue.ORACLE]


@pytest.mark.parametrize("name", OWN)
def test_equals_oracle_with_a_scalable_plan(spark, connections, name):
    sf = MEDIUM if name in MEDIUM_ONLY else SMALL
    df = entry.queries()[name](spark, sf)
    plan = physical(df)
    assert name in ARROW or [node for node in UNWANTED if node in plan] == []
    # a window in one task may only see partition totals, or the candidate list of a leaderboard
    for window in re.findall(r"Window [^\n]*\n[^\n]*Sort [^\n]*\n[^\n]*Exchange SinglePartition", plan):
        assert "_sum_" in window or name in CANDIDATE_LISTS
    assert compare(df, connections[sf], entry.oracle_sql()[name]) == []


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_scan_reads_only_needed_columns(spark):
    plan = physical(entry.queries()["previous_features"](spark, SMALL))
    scan = next(line for line in plan.splitlines() if "Scan parquet" in line)
    assert "o_totalprice" not in scan and "o_orderstatus" in scan


def test_account_features_shuffle_once(spark):
    assert physical(entry.queries()["bureau_account_features"](spark, SMALL)).count("Exchange") == 1
