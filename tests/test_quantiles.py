"""Order statistics, moments and positions without a one-task sort, against numpy."""

import numpy as np
import pytest

from casespark.operators import quantiles as Q
from casespark.operators import report as R
from pyspark.sql import functions as F

QS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_order_statistics_and_moments_equal_numpy(spark, partitions):
    rng = np.random.default_rng(partitions)
    groups = {"normal": rng.normal(0, 1e3, 700), "ties": rng.integers(0, 3, 900).astype(float), "one": np.array([4.5]),
              "two": np.array([1.0, 2.0]), "same": np.full(500, -7.0), "huge": np.array([1e300, -1e300, 0.0, 1e-300])}
    rows = [(g, "x", float(v)) for g, vs in groups.items() for v in vs] + [("ties", "x", None), ("empty", "x", None)]
    df = spark.createDataFrame(rows, "side string, rank string, v double")                 # names the plan uses itself
    counts = Q.ranked_counts(df, ["side", "rank"], partitions=partitions)
    got = {(r.side, r.q): r.value for r in Q.order_statistics(counts, ["side", "rank"], QS).collect()}
    assert len(got) == len(groups) * len(QS)
    for g, vs in groups.items():
        for q in QS:
            assert got[g, q] == pytest.approx(np.quantile(vs, q), rel=1e-12, abs=1e-12), (g, q)
    for r in Q.moments(counts, ["side", "rank"]).select("*", Q.std(True).alias("pop"), Q.std(False).alias("sample")).collect():
        vs = groups[r.side]
        assert (r["count"], r.min, r.max) == (len(vs), vs.min(), vs.max())
        if r.side != "huge":
            assert r.mean == pytest.approx(vs.mean()) and r.pop == pytest.approx(vs.std(), abs=1e-9)
            assert r.sample is None if len(vs) == 1 else r.sample == pytest.approx(vs.std(ddof=1), abs=1e-9)


def test_numbered_positions(spark):
    rng = np.random.default_rng(2)
    keys = rng.permutation(5000)[:3000].tolist()
    got = Q.numbered(spark.createDataFrame([(k,) for k in keys], "k long"), ["k"], partitions=7).collect()
    assert sorted((r.place, r.k) for r in got) == list(enumerate(sorted(keys)))
    assert Q.numbered(spark.createDataFrame([], "k long"), ["k"]).collect() == []


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "a double, b double")
    rows = {r["col"]: r for r in R.describe_numeric(empty, ["a", "b"]).collect()}
    assert set(rows) == {"a", "b"} and all(r["count"] == 0 and r.q50 is None and r["std"] is None for r in rows.values())
    assert R.distribution_pct(empty, "a").collect() == []
    counts = spark.createDataFrame([], "id long, before long, after long")
    assert R.before_after_stats({"lab": counts}).collect() == []


def test_supplement_takes_the_first_of_the_rest(spark):
    from casespark.operators.cohort import supplement_cases
    sample = spark.createDataFrame([(5, []), (7, ["a"]), (9, [])], "case_id long, primary array<string>")
    pool = spark.createDataFrame([(i, ["a"] if i % 2 else []) for i in range(20)], "case_id long, primary array<string>")
    assert sorted(r.case_id for r in supplement_cases(sample, pool).collect()) == [1, 3, 7]
    assert sorted(r.case_id for r in supplement_cases(sample.where("case_id = 7"), pool).collect()) == [7]


def test_no_single_task_over_a_column(spark):
    df = spark.range(2000).select((F.col("id") % 97).cast("double").alias("a"))
    plan = Q.order_statistics(Q.ranked_counts(Q.long_form(df, ["a"]), ["col"]), ["col"], [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "NestedLoop" not in plan and "percentile" not in plan
