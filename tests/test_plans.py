"""Plans at scale: what reaches the scan, what is combined before a shuffle, and what is never there."""

import os

import pytest

from gaugeworks.operators import roc
from gaugeworks.plans import catalogue, tables

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(FOLDER), reason="needs the test tables")


def _plan(spark, name):
    return catalogue.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["auc_overall", "auc_by_source", "auc_grid", "threshold_table", "dedup_keep_first", "leak_check_exact", "stratified_draws", "path_labels", "multi_head_scores"])
def test_no_cartesian_and_no_python(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan and "Python" not in plan and "Arrow" not in plan


def test_scan_reads_needed_columns_and_takes_filters(spark):
    plan = tables.scored(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan parquet" in x and "err_id" in x)
    assert "IsNotNull(label)" in scan and "IsNotNull(score)" in scan and "scored_at" not in scan and "loaded_at" not in scan


def test_groups_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in _plan(spark, "dedup_keep_first")
    assert "TakeOrderedAndProject" in _plan(spark, "topk_errors")


def test_scores_are_counted_before_the_shuffle(spark):
    plan = roc.score_counts(tables.scored_pictures(spark, FOLDER), ["source"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "CartesianProduct" not in plan and "Python" not in plan


def test_counts_are_made_once(spark):
    """A curve and its vertices read the written counts: no scan of the scores, no deduplication, is in their plan."""
    plan = _plan(spark, "roc_vertices")
    assert "errors_top" not in plan and "counts-" in plan
