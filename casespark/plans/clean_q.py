"""Cleaning / event-reduction queries (hospital labs, microbiology, tables of set 2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from casespark.functions.columns import finalize, render_list, ts_text
from casespark.operators import clean as C
from casespark.plans.registry import query
from casespark.sources import fixtures as fx


def _ts(c):
    return ts_text(c)


@query("drop_blank_codes")
def q_drop_blank_codes(spark, d):
    return C.drop_blank_codes(fx.diagnoses(spark, d)).select("hadm_id", "seq_num", "icd9code")


@query("exclude_value")
def q_exclude_value(spark, d):
    return C.exclude_value(fx.labs_text(spark, d), "value", "Delete").select("labevent_id", "value")


@query("top_n_ranked_codes")
def q_top_n_ranked_codes(spark, d):
    return C.top_n_ranked_codes(fx.diagnoses(spark, d), 3).select("hadm_id", "seq_num", "icd_code")


@query("within_stay")
def q_within_stay(spark, d):
    w = C.within_stay(fx.labs_text(spark, d), fx.encounters(spark, d), ["hadm_id"])
    return w.select("labevent_id", "hadm_id", _ts(F.col("charttime")).alias("charttime"))


@query("exclude_substring")
def q_exclude_substring(spark, d):
    return C.exclude_substring(fx.labs_text(spark, d), {"comments": ["cancel", "___"]}).select("labevent_id", "comments")


@query("coerce_numeric_complete")
def q_coerce_numeric_complete(spark, d):
    c = C.coerce_numeric_complete(fx.labs_text(spark, d), ["value", "ref_range_lower", "ref_range_upper"])
    return finalize(c.select("labevent_id", "value", "ref_range_lower", "ref_range_upper"))


@query("hours_window")
def q_hours_window(spark, d):
    h = C.hours_window(fx.labs_text(spark, d), fx.encounters(spark, d), ["hadm_id"], 0.0, 240.0)
    return finalize(h.select("labevent_id", "hours"))


@query("exclude_ids")
def q_exclude_ids(spark, d):
    ids = fx.encounters(spark, d).filter(F.col("discharge_location") == "DIED").select("hadm_id")
    return C.exclude_ids(fx.encounters(spark, d), ids, "hadm_id").select("hadm_id", "discharge_location")


@query("split_codes_target")
def q_split_codes_target(spark, d):
    from casespark.plans.cohort_q import top_codes
    targets = top_codes(spark, d).join(fx.code_names(spark, d).withColumnRenamed("code", "icd_code"), "icd_code")
    s = C.split_codes_target(fx.diagnoses(spark, d), targets.select("icd_code", F.col("name").alias("long_title")))
    return s.select("hadm_id", render_list("ids").alias("ids"), render_list("names", "|").alias("names"),
                    render_list("id_names", "|").alias("id_names"))


@query("first_lab_per_item")
def q_first_lab_per_item(spark, d):
    f = C.first_lab_per_item(fx.labs_text(spark, d), fx.encounters(spark, d))
    return f.select("hadm_id", "itemid", "labevent_id", _ts(F.col("charttime")).alias("charttime"), "value", "comments")


@query("micro_first_or_all")
def q_micro_first_or_all(spark, d):
    m = C.micro_first_or_all(fx.micro(spark, d), fx.encounters(spark, d))
    return m.select("hadm_id", "test_name", "microevent_id", _ts(F.col("charttime")).alias("charttime"),
                    "org_name", "comments", "ab_itemid")


LAB_OUT = ["patientunitstayid", "labname", "labresult", "labresultoffset", "labresultrevisedoffset", "labtypeid",
           "labmeasurenamesystem", "labmeasurenameinterface", "labid"]


@query("glucose_4h")
def q_glucose_4h(spark, d):
    return finalize(C.glucose_4h(fx.labs_offset(spark, d)).select(*LAB_OUT))


@query("bucket_latest")
def q_bucket_latest(spark, d):
    a = C.bucket_latest(fx.labs_offset(spark, d), 30, True).withColumn("branch", F.lit("blood_gas_30"))
    b = C.bucket_latest(fx.labs_offset(spark, d), 360, False).withColumn("branch", F.lit("other_360"))
    return finalize(a.unionByName(b).select("branch", *LAB_OUT))


@query("reduce_labs")
def q_reduce_labs(spark, d):
    return finalize(C.reduce_labs(fx.labs_offset(spark, d)).select(*LAB_OUT))


@query("dedup_keep_first")
def q_dedup_keep_first(spark, d):
    return C.dedup_keep(fx.diagnoses(spark, d), ["hadm_id", "diagnosisstring"], ["seq_num"], "first") \
        .select("hadm_id", "diagnosisstring", "seq_num", "icd_code")


@query("dedup_keep_last")
def q_dedup_keep_last(spark, d):
    return C.dedup_keep(fx.diagnoses(spark, d), ["hadm_id", "diagnosisstring"], ["seq_num"], "last") \
        .select("hadm_id", "diagnosisstring", "seq_num", "icd_code")


@query("flag_duplicates")
def q_flag_duplicates(spark, d):
    f = C.flag_duplicates(fx.responses(spark, d).filter("round = 1"), ["case_id"])
    return f.select("case_id", "line_no", "is_dup")


@query("head_per_group")
def q_head_per_group(spark, d):
    h = C.head_per_group(fx.micro(spark, d), ["hadm_id"], ["charttime", "microevent_id"], 15)
    return h.select("hadm_id", "microevent_id", F.col("rn").cast("int").alias("rn"))


@query("clean_diagnoses")
def q_clean_diagnoses(spark, d):
    return C.clean_diagnoses(fx.diagnoses(spark, d)).select("hadm_id", "diagnosisstring", "seq_num", "icd9code")


@query("clean_history")
def q_clean_history(spark, d):
    return C.clean_history(fx.past_history(spark, d)).select(
        "patientunitstayid", "ord", "pasthistorypath", "pasthistoryvalue", "pasthistoryvaluetext")


@query("clean_exam")
def q_clean_exam(spark, d):
    return C.clean_exam(fx.physical_exam(spark, d)).select(
        "patientunitstayid", "ord", "physicalexampath", "physicalexamvalue", F.length("physicalexamtext").alias("text_len"))
