"""Report queries: distributions, reduction statistics, describe, costs, top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casespark.functions.columns import finalize, render_list
from casespark.operators import clean as C
from casespark.operators import report as R
from casespark.operators import metrics as M
from casespark.plans.metrics_q import joined
from casespark.plans.registry import query
from casespark.plans.text_q import reduced_labs
from casespark.sources import fixtures as fx


def _clean_dx(spark, d):
    return C.clean_diagnoses(fx.diagnoses(spark, d))


@query("split_dual_code")
def q_split_dual_code(spark, d):
    return R.split_dual_code(fx.diagnoses(spark, d)).select("hadm_id", "seq_num", "v9", "v10")


@query("disease_system")
def q_disease_system(spark, d):
    s = R.disease_system(_clean_dx(spark, d))
    return finalize(R.distribution_pct(s, "system", "system"))


@query("distribution_pct")
def q_distribution_pct(spark, d):
    dx = R.split_dual_code(_clean_dx(spark, d))
    parts = []
    for kind, col in (("name", "diagnosisstring"), ("v9", "v9"), ("v10", "v10")):
        src = dx.filter(F.col(col) != "") if kind != "name" else dx
        parts.append(R.distribution_pct(src, col).withColumn("kind", F.lit(kind)))
    lab = fx.case_labels(spark, d)
    parts.append(R.distribution_pct(lab, "top1").withColumn("kind", F.lit("top1")))
    parts.append(R.distribution_pct(lab.select(F.explode("labels").alias("code")), "code").withColumn("kind", F.lit("labels")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return finalize(out.select("kind", "value", "n", "pct"))


@query("multi_mapping")
def q_multi_mapping(spark, d):
    m = R.multi_mapping(R.split_dual_code(_clean_dx(spark, d)))
    return m.select("side", "value", "n_other", "other")


@query("disease_summary")
def q_disease_summary(spark, d):
    return finalize(R.disease_summary(_clean_dx(spark, d)))


def _counts(spark, d):
    dx = fx.diagnoses(spark, d)
    ents = fx.icu_patients(spark, d).select("hadm_id")
    return R.entity_counts(dx, C.clean_diagnoses(dx), "hadm_id", ents)


def _lab_counts(spark, d):
    labs = fx.labs_offset(spark, d)
    return R.entity_counts(labs, reduced_labs(spark, d), "patientunitstayid")


def _all_counts(spark, d):
    """Rows per entity before and after processing, of the four tables of the second data set."""
    history, exam = fx.past_history(spark, d), fx.physical_exam(spark, d)
    pid = "patientunitstayid"
    return {"diagnosis": _counts(spark, d), "pasthistory": R.entity_counts(history, C.clean_history(history), pid),
            "physicalexam": R.entity_counts(exam, C.clean_exam(exam), pid), "lab": _lab_counts(spark, d)}


@query("before_after_stats")
def q_before_after_stats(spark, d):
    return finalize(R.before_after_stats(_all_counts(spark, d)))


@query("count_histogram")
def q_count_histogram(spark, d):
    return reduce(DataFrame.unionByName, [R.count_histogram(c, kind) for kind, c in _all_counts(spark, d).items()])


@query("in_range_entities")
def q_in_range_entities(spark, d):
    mi = fx.micro(spark, d)
    counts = R.entity_counts(mi, C.micro_first_or_all(mi, fx.encounters(spark, d)), "hadm_id")
    return R.in_range_entities(counts, "hadm_id", "after", 11, 20)


@query("describe_numeric")
def q_describe_numeric(spark, d):
    log = fx.responses(spark, d)
    return finalize(R.describe_numeric(log, ["estimate_tokens", "prompt_tokens", "completion_tokens", "reasoning_tokens"]))


@query("length_distribution")
def q_length_distribution(spark, d):
    return R.length_distribution(fx.case_labels(spark, d), "labels")


@query("missing_top1_codes")
def q_missing_top1_codes(spark, d):
    return R.missing_top1_codes(fx.case_labels(spark, d).filter(F.size("major") > 0)
                                .select(F.col("major").alias("labels"), "top1"))


# Example price table: model, price of a million input and output tokens.
PRICES = [("model_a", 0.5, 4.0), ("model_b", 0.2, 1.5)]


@query("token_cost")
def q_token_cost(spark, d):
    prices = spark.createDataFrame(PRICES, "model string, input_price_m double, output_price_m double")
    return finalize(R.token_cost(fx.responses(spark, d), prices))


@query("top_missed")
def q_top_missed(spark, d):
    b = M.miss_over_by_code(joined(spark, d))
    return finalize(R.top_k(b, "missed_count", 20).select("code", F.col("missed_count").alias("n"), F.col("miss_rate").alias("rate")))


@query("top_over")
def q_top_over(spark, d):
    b = M.miss_over_by_code(joined(spark, d))
    return finalize(R.top_k(b, "over_count", 20).select("code", F.col("over_count").alias("n"), F.col("over_rate").alias("rate")))


@query("limit_cases")
def q_limit_cases(spark, d):
    return R.limit_cases(fx.case_labels(spark, d), 100).select("case_id", render_list("labels").alias("labels"))
