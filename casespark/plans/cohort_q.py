"""Cohort-building queries over the adapter views (set 2 and set 1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from casespark.functions.columns import render_list
from casespark.operators import cohort
from casespark.plans.registry import query
from casespark.plans.tables import bucketed
from casespark.sources import fixtures as fx

TOP_CODES = 30          # of 40 leaf codes: strict cohort neither empty nor everything
PER_DISEASE = 20
PER_CODE = 30
SEED = 42


def top_codes(spark, d, dx=None):
    dx = dx if dx is not None else fx.diagnoses(spark, d)
    return cohort.disease_frequency_top(dx, col="icd_code", n=TOP_CODES)


def strict(spark, d, dx=None, top=None):
    """Strict cohort; the diagnosis frame and top set are shared with the caller (one plan node each)."""
    dx = dx if dx is not None else fx.diagnoses(spark, d)
    top = top if top is not None else top_codes(spark, d, dx)
    return cohort.strict_cohort(dx, fx.icu_patients(spark, d), top)


def sampled_patients(spark, d):
    dx = fx.diagnoses(spark, d)
    top = top_codes(spark, d, dx)
    return cohort.sample_per_disease(strict(spark, d, dx, top), top, n=PER_DISEASE, seed=SEED)


def sampled_ids(spark, d):
    """Stays of the sample (at most PER_DISEASE for each top code), drawn and written once for all queries of a run."""
    return bucketed(spark, d, "sample", lambda: sampled_patients(spark, d).select(F.col("patient_id").alias("hadm_id"))
                    .filter("hadm_id IS NOT NULL").distinct(), key="hadm_id", sources=("lineitem", "orders", "part"))


@query("code_frequency_top")
def q_code_frequency_top(spark, d):
    return cohort.code_frequency_top([fx.case_labels(spark, d)], col="labels", n=TOP_CODES)


@query("disease_frequency_top")
def q_disease_frequency_top(spark, d):
    return cohort.disease_frequency_top(fx.diagnoses(spark, d), col="diagnosisstring", n=100)


@query("strict_cohort")
def q_strict_cohort(spark, d):
    c = strict(spark, d)
    return c.select("patient_id", "age", "gender",
                    render_list("all_list").alias("all_diseases"),
                    render_list("primary_list").alias("primary_diseases"),
                    render_list("major_list").alias("major_diseases"),
                    render_list("other_list").alias("other_diseases"),
                    "total_disease_count", "primary_count", "major_count", "other_count")


@query("cohort_funnel")
def q_cohort_funnel(spark, d):
    dx = fx.diagnoses(spark, d)
    return cohort.cohort_funnel(dx, fx.icu_patients(spark, d), top_codes(spark, d, dx))


@query("coverage_report")
def q_coverage_report(spark, d):
    dx = fx.diagnoses(spark, d)
    return cohort.coverage_report(dx, top_codes(spark, d, dx))


@query("sample_per_disease")
def q_sample_per_disease(spark, d):
    return sampled_patients(spark, d)


@query("sample_per_code")
def q_sample_per_code(spark, d):
    return cohort.sample_per_code(fx.case_labels(spark, d), n=PER_CODE, seed=0)


@query("ordered_distinct")
def q_ordered_distinct(spark, d):
    od = cohort.ordered_distinct(fx.diagnoses(spark, d), "hadm_id", "diagnosisstring", "seq_num")
    return od.select("hadm_id", render_list("values", ";").alias("diseases"),
                     F.size("values").cast("long").alias("n_diseases"))


@query("split_by_patient")
def q_split_by_patient(spark, d):
    return cohort.split_by_patient(fx.encounters(spark, d).select("hadm_id", "subject_id"), "subject_id", seed=1)


@query("patient_diag")
def q_patient_diag(spark, d):
    j = cohort.patient_diag(fx.icu_patients(spark, d), fx.diagnoses(spark, d))
    return j.select("hadm_id", "seq_num", "icd_code", "priority", "gender", "age")


@query("semi_filter")
def q_semi_filter(spark, d):
    return cohort.semi_filter(fx.diagnoses(spark, d), sampled_ids(spark, d), "hadm_id").select("hadm_id", "seq_num", "icd_code", "priority")


@query("resume_pending")
def q_resume_pending(spark, d):
    cases = fx.encounters(spark, d).select(F.col("hadm_id").alias("case_id"), "subject_id")
    return cohort.resume_pending(cases, fx.responses(spark, d), "case_id")


def _sample_cases(spark, d):
    ids = cohort.sample_per_code(fx.case_labels(spark, d), n=PER_CODE, seed=0)
    return fx.case_labels(spark, d).join(ids, "case_id", "left_semi")


@query("nonempty_label")
def q_nonempty_label(spark, d):
    kept = cohort.nonempty_label(_sample_cases(spark, d), "primary")
    return kept.select("case_id", render_list("primary").alias("primary_codes"))


@query("supplement_cases")
def q_supplement_cases(spark, d):
    out = cohort.supplement_cases(_sample_cases(spark, d), fx.case_labels(spark, d), "case_id", "primary")
    return out.select("case_id", render_list("primary").alias("primary_codes"))
