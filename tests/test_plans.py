"""Physical-plan checks: no cartesian products, no row-at-a-time Python, window
limits planned as WindowGroupLimit, filters and column pruning reaching the scan."""

import pytest

from casespark.plans.registry import all_queries

QUERIES = all_queries()
PY_OK = {"score_cases", "score_cases_failed"}            # the user-function hook (mapInPandas) by design
NESTED_LOOP_OK = {"range_class_join"}                    # a handful of range rows, broadcast


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_cartesian_no_python(spark, small_dir, key):
    if key in ("ingest_responses",):
        pytest.skip("streaming query: plan checked inside foreachBatch")
    p = plan(QUERIES[key](spark, small_dir))
    assert "CartesianProduct" not in p
    if key not in NESTED_LOOP_OK:
        assert "BroadcastNestedLoopJoin" not in p
    if key not in PY_OK:
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "MapInPandas" not in p


def test_sampling_uses_window_group_limit(spark, small_dir):
    p = plan(QUERIES["sample_per_disease"](spark, small_dir))
    assert "WindowGroupLimit" in p


def test_scan_pruning_and_pushdown(spark, small_dir):
    from pyspark.sql import functions as F
    from casespark.sources import fixtures as fx
    df = fx.encounters(spark, small_dir).filter(F.col("hadm_id") < 500).select("hadm_id", "subject_id")
    p = plan(df)
    assert "PushedFilters: [IsNotNull(o_orderkey), LessThan(o_orderkey,500)]" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in p


@pytest.mark.parametrize("key,fn", [("dedup_keep_first", "partial_min_by"), ("dedup_keep_last", "partial_max_by"),
                                    ("first_lab_per_item", "partial_min_by"), ("bucket_latest", "partial_max_by"),
                                    ("code_frequency_top", "partial_count"), ("miss_over_by_code", "partial_count")])
def test_per_group_reductions_are_partial_aggregates(spark, small_dir, key, fn):
    """A hot key is pre-reduced on the map side: the aggregate has a partial step before its shuffle."""
    p = plan(QUERIES[key](spark, small_dir))
    assert fn in p
