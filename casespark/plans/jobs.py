"""Batch jobs that materialise the reusable tables (cohort, case records,
extracted predictions) as Parquet in the shared folder named by
``spark.checkpoint.dir``.  Reading them back cuts the lineage, so an executor
lost later re-reads files instead of recomputing the cohort from raw tables.

These are entry points for scheduled runs; the registered queries stay lazy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casespark.session import scratch_path


def write_and_read(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)


def materialize_case_tables(spark: SparkSession, sf_dir: str, out: str | None = None) -> dict[str, DataFrame]:
    """Cohort, sampled patients, case records and extracted predictions, each written once."""
    from casespark.plans.cohort_q import sampled_patients, strict
    from casespark.plans.responses_q import valid_dedup
    from casespark.plans.text_q import case_inputs

    base = out or scratch_path(spark, "case-tables")
    cohort = write_and_read(strict(spark, sf_dir), f"{base}/strict_cohort")
    sample = write_and_read(sampled_patients(spark, sf_dir), f"{base}/sample_per_disease")
    cases = write_and_read(case_inputs(spark, sf_dir), f"{base}/case_inputs")
    preds = write_and_read(valid_dedup(spark, sf_dir, "one_match"), f"{base}/valid_predictions", ["round"])
    return {"strict_cohort": cohort, "sample_per_disease": sample, "case_inputs": cases, "valid_predictions": preds}
