"""Resampling: draws, counts and intervals against plain numpy."""

import numpy as np
import pytest

from casespark.functions.columns import md5_draw, stream_draw
from casespark.operators import metrics as M
from pyspark.sql import functions as F


def scores(spark, n, seed=3, nulls=True):
    rng = np.random.default_rng(seed)
    rows = [(i, float(rng.integers(0, 4)) / 3, None if nulls and i % 7 == 0 else float(rng.random() ** 3)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "case_id long, a double, b double")


def test_draws_are_those_of_the_column_functions(spark):
    base = M._stream(5, "slot", 2, 3)
    got = M._draws(base, 50).tolist()
    df = spark.range(50).select(md5_draw(5, F.lit("slot"), F.lit(2), F.lit(3)).alias("base"), "id").select(
        stream_draw(F.col("base"), F.col("id") * 2).alias("h"), stream_draw(F.col("base"), F.col("id") * 2 + 1).alias("l"))
    assert got == [(r.h & 0x1FFFFF) << 32 | r.l for r in df.collect()]


def test_counts_of_a_replicate_are_multinomial():
    import pyarrow as pa
    sizes = [{"bucket": 0, "n": 700}, {"bucket": 2, "n": 200}, {"bucket": 3, "n": 100}]
    batch = pa.record_batch({"b": pa.array([0, 2, 3]), "sizes": pa.array([sizes] * 3)})
    counts = np.zeros((4, 500), np.int64)
    for out in M._deal_draws(500, 1, 4)([batch]):
        for p, raw in zip(out.column(0).to_pylist(), out.column(3).to_pylist()):
            counts[p] += np.frombuffer(raw, np.int64)
    assert (counts.sum(0) == 1000).all() and not counts[1].any()
    mean, var = counts.mean(1), counts.var(1)
    for p, share in ((0, 0.7), (2, 0.2), (3, 0.1)):
        assert abs(mean[p] - 1000 * share) < 4 * np.sqrt(1000 * share * (1 - share) / 500)
        assert 0.75 < var[p] / (1000 * share * (1 - share)) < 1.3


@pytest.mark.parametrize("how", [M.bootstrap_ci, M.bootstrap_ci_multinomial])
def test_intervals_are_those_of_plain_resampling(spark, how):
    rows, df = scores(spark, 800)
    got = {r.metric: r for r in how(df, ["a", "b"], n_rep=1500, seed=9).collect()}
    x = np.array([[r[1], np.nan if r[2] is None else r[2]] for r in rows])
    rng = np.random.default_rng(0)
    means = np.array([np.nanmean(x[rng.integers(0, len(x), len(x))], axis=0) for _ in range(1500)])
    for k, metric in enumerate("ab"):
        assert abs(got[metric].value - np.nanmean(x[:, k])) < 1e-12
        se = means[:, k].std()
        for side, q in (("lo", 2.5), ("hi", 97.5)):
            assert abs(getattr(got[metric], side) - np.percentile(means[:, k], q)) < 0.35 * se


def test_small_and_repeated_cases(spark):
    for how in (M.bootstrap_ci, M.bootstrap_ci_multinomial):
        assert [(r.metric, r.value) for r in how(scores(spark, 0)[1], ["a"]).collect()] in ([], [("a", None)])
        one = how(scores(spark, 1, nulls=False)[1], ["a"], n_rep=50).collect()[0]
        assert one.lo == one.hi == one.value
        same = spark.createDataFrame([(1, 0.5)] * 40 + [(2, 1.0)] * 40, "case_id long, a double")
        row = how(same, ["a"], n_rep=300).collect()[0]
        assert row.value == 0.75 and 0.5 <= row.lo <= row.value <= row.hi <= 1.0


def test_no_row_for_each_draw(spark):
    _, df = scores(spark, 3000)
    plan = M.bootstrap_ci_multinomial(df, ["a", "b"], n_rep=1000)._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan and "CartesianProduct" not in plan
