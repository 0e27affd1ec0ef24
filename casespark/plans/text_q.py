"""Text projection queries: sections, rendered tables, prompts, token estimates,
and the assembled case record."""

from __future__ import annotations

from pyspark.sql import functions as F

from casespark.functions.columns import finalize, render_list, ts_text
from casespark.operators import clean as C
from casespark.operators import joins as J
from casespark.operators import metrics as M
from casespark.operators import render as T
from casespark.operators.cohort import age_number
from casespark.plans.registry import query
from casespark.plans.tables import bucketed, written
from casespark.sources import fixtures as fx

LAB_TOKEN_CAP = 8168


@query("note_sections")
def q_note_sections(spark, d):
    return T.note_sections(fx.notes(spark, d))


@query("exam_before_discharge")
def q_exam_before_discharge(spark, d):
    n = fx.notes(spark, d)
    exam = T.section("text", "Physical Exam:\n", "Pertinent Results:", "first")
    return n.select("note_id", T.before_word(exam, "discharge").alias("text"))


@query("strip_findings")
def q_strip_findings(spark, d):
    return fx.reports(spark, d).select("report_id", T.strip_findings("text").alias("text"))


def case_labs(spark, d):
    """Labs of the case text: first per item inside the stay, item names, 'Delete' labels
    dropped, numeric value and range required."""
    first = C.first_lab_per_item(fx.labs_text(spark, d), fx.encounters(spark, d))
    named = J.labs_with_item(first, fx.lab_items(spark, d))
    kept = C.exclude_value(named, "label", "Delete")
    return C.coerce_numeric_complete(kept, ["value", "ref_range_lower", "ref_range_upper"])


@query("render_lab_table")
def q_render_lab_table(spark, d):
    return T.render_lab_table(case_labs(spark, d))


def stays(spark, d, only=None):
    """Stays with demographics and first triage row; ``only``: those whose ``hadm_id`` is in that frame of one column."""
    first_triage = C.first_per_group(fx.triage(spark, d, only), ["stay_id"], ["ord"])
    e = fx.encounters(spark, d).select("subject_id", "hadm_id", "stay_id")
    e = e.join(only, "hadm_id", "left_semi") if only is not None else e
    return e.join(fx.patients(spark, d).select("subject_id", "gender", "anchor_age"), "subject_id", "left") \
        .join(first_triage, "stay_id", "left")


@query("render_vitals")
def q_render_vitals(spark, d):
    return T.render_vitals(stays(spark, d))


def case_micro(spark, d):
    return C.micro_first_or_all(fx.micro(spark, d), fx.encounters(spark, d))


@query("render_micro")
def q_render_micro(spark, d):
    return T.render_micro(case_micro(spark, d))


@query("text_or_none")
def q_text_or_none(spark, d):
    return stays(spark, d).select("hadm_id", T.text_or_none("chiefcomplaint", "The chief complaint: ").alias("ed_chiefcomplaint"))


@query("history_items")
def q_history_items(spark, d):
    return T.history_items(C.clean_history(fx.past_history(spark, d)))


@query("exam_items")
def q_exam_items(spark, d):
    return T.exam_items(C.clean_exam(fx.physical_exam(spark, d)))


def reduced_labs(spark, d):
    """Reduced labs of the second set, written once for all queries of a run."""
    return written(spark, d, "reduced_labs", lambda: C.reduce_labs(fx.labs_offset(spark, d)), sources=("events",))


@query("labs_as_csv")
def q_labs_as_csv(spark, d):
    return T.labs_as_csv(reduced_labs(spark, d), max_tokens=LAB_TOKEN_CAP)


@query("diagnosis_struct")
def q_diagnosis_struct(spark, d):
    s = T.diagnosis_struct(C.clean_diagnoses(fx.diagnoses(spark, d)))

    def names(c):
        return F.concat_ws(";", F.transform(c, lambda x: x["name"]))

    def codes(c):
        return F.concat_ws(",", F.transform(c, lambda x: F.concat(x["icd9code"], F.lit("/"), x["icd10code"])))
    return s.select("hadm_id", names("all_diseases").alias("all_names"), codes("all_diseases").alias("all_codes"),
                    names("primary_diseases").alias("primary_names"), names("major_diseases").alias("major_names"),
                    names("other_diseases").alias("other_names"))


@query("demographics_text")
def q_demographics_text(spark, d):
    return T.demographics_text(fx.icu_patients(spark, d))


@query("age_number")
def q_age_number(spark, d):
    return fx.icu_patients(spark, d).select("hadm_id", age_number("age").alias("age"))


@query("hours_between")
def q_hours_between(spark, d):
    e = fx.encounters(spark, d)
    return finalize(e.select("hadm_id", T.hours_between("admittime", "dischtime").alias("los_hours"),
                             T.hours_between("ed_intime", "ed_outtime").alias("ed_hours")))


@query("icu_los_days")
def q_icu_los_days(spark, d):
    return finalize(fx.icu_patients(spark, d).select("hadm_id", T.icu_los_days("unitdischargeoffset").alias("icu_los_days")))


@query("study_time")
def q_study_time(spark, d):
    m = fx.image_meta(spark, d)
    return m.select("dicom_id", ts_text(T.study_time("StudyDate", "StudyTime")).alias("study_ts"))


@query("truncate_tokens")
def q_truncate_tokens(spark, d):
    hpi = T.section("text", "History of Present Illness:\n", "Past Medical History:", "first")
    n = fx.notes(spark, d).select("note_id", hpi.alias("hpi"))
    t = n.select("note_id", T.truncate_tokens("hpi", LAB_TOKEN_CAP).alias("text"))
    return t.select("note_id", "text", T.token_count("text").cast("long").alias("n_tokens"))


# --------------------------------------------------------------------- SC26 case record
def first_note(spark, d):
    return C.first_per_group(fx.notes(spark, d).select("hadm_id", "note_id", "text"), ["hadm_id"], ["note_id"])


CASE_SOURCES = ("events", "orders", "customer", "lineitem", "documents")


def case_inputs(spark, d):
    """The case inputs, written once for all queries of a run."""
    return bucketed(spark, d, "case_inputs", lambda: build_case_inputs(spark, d), key="hadm_id", sources=CASE_SOURCES)


def case_reports(spark, d):
    """Cleaned reports, one row each."""
    enc = fx.encounters(spark, d).select("hadm_id")
    return fx.reports(spark, d).join(enc, "hadm_id", "left_semi").select("hadm_id", "report_id", T.strip_findings("text").alias("text"))


def build_case_inputs(spark, d):
    """One row per case with every rendered input field (cases need labs, as in the reference)."""
    labs = T.render_lab_table(case_labs(spark, d))
    # cases need labs: stays without any leave before they meet patients and triage rows
    st = stays(spark, d, only=fx.lab_stays(spark, d))
    vit = T.render_vitals(st)
    cc = st.select("hadm_id", "subject_id", "stay_id",
                   T.text_or_none("chiefcomplaint", "The chief complaint: ").alias("ed_chiefcomplaint"))
    note = first_note(spark, d).select(
        "hadm_id",
        F.concat(F.lit("The family history: "),
                 T.section("text", "Social History:\n", "Physical Exam:", "first")).alias("family_history"),
        F.concat(F.lit("The past medical history: "),
                 T.section("text", "Past Medical History:\n", "Social History:", "first")).alias("past_medical_history"),
        F.concat(F.lit("The history of present illness : "),
                 T.section("text", "History of Present Illness:\n", "Past Medical History:", "first")).alias("hpi_text"),
        F.concat(F.lit("The physical exam on admission : "),
                 T.before_word(T.section("text", "Physical Exam:\n", "Pertinent Results:", "first"))).alias("physical_text"))
    # a case's prompt is one text by definition, so its reports meet here; counts of them are taken row by row
    reports = case_reports(spark, d).groupBy("hadm_id").agg(F.array_sort(F.collect_list(F.struct("report_id", "text"))).alias("_r")) \
        .select("hadm_id", F.transform("_r", lambda x: x["text"]).alias("report"))
    micro = T.render_micro(case_micro(spark, d))
    c = labs.join(cc, "hadm_id", "inner").join(vit, "hadm_id", "left").join(note, "hadm_id", "left") \
        .join(reports, "hadm_id", "left").join(micro, "hadm_id", "left")
    return c.select(
        F.concat_ws("/", "subject_id", "hadm_id", F.coalesce(F.col("stay_id"), F.lit(0))).alias("case_id"), "hadm_id",
        "lab", "ed_info", "ed_chiefcomplaint",
        F.coalesce("family_history", F.lit("The family history: None")).alias("family_history"),
        F.coalesce("past_medical_history", F.lit("The past medical history: None")).alias("past_medical_history"),
        F.coalesce("hpi_text", F.lit("The history of present illness : None")).alias("hpi_text"),
        F.coalesce("physical_text", F.lit("The physical exam on admission : None")).alias("physical_text"),
        F.coalesce("report", F.array().cast("array<string>")).alias("report"),
        F.coalesce("micro_info", F.lit("The microbiology tests for the patient: None")).alias("micro_info"))


INPUT_FIELDS = ["lab", "ed_info", "family_history", "ed_chiefcomplaint", "past_medical_history", "physical_text",
                "hpi_text", "micro_info", "report"]


@query("note_input_case")
def q_note_input_case(spark, d):
    from casespark.plans.joins_q import _case_codes
    c = case_inputs(spark, d)
    out = _case_codes(spark, d)
    j = c.join(out, "hadm_id", "inner").filter(F.size("codes") > 0)
    return j.select("case_id", *[F.array_join("report", "\n---\n").alias("report") if f == "report" else f
                                 for f in INPUT_FIELDS],
                    render_list("codes").alias("output_icd_id"), render_list("titles", "|").alias("output_icd_name"))


@query("estimate_tokens")
def q_estimate_tokens(spark, d):
    cases = case_inputs(spark, d)
    texts = cases.select("case_id", "hadm_id").join(case_reports(spark, d), "hadm_id").select("case_id", "text")
    return T.estimate_tokens(cases, [f for f in INPUT_FIELDS if f != "report"], "case_id", parts={"report": texts})


@query("select_fields_by_task")
def q_select_fields_by_task(spark, d):
    """Ordered field list of a task joined into one input text per case."""
    c = case_inputs(spark, d)
    return c.select("case_id", T.assemble_input(c, "lab+").alias("input_text"))


# Template table: prompt variants (user supplied; short instructions here).
TEMPLATES = [("expert_designed", "Rank the most likely diagnosis codes for this case."),
             ("severity_based", "Rank diagnosis codes by clinical severity and evidence."),
             ("cot_based", "Reason step by step, then rank diagnosis codes.")]


@query("assemble_prompt")
def q_assemble_prompt(spark, d):
    tpl = spark.createDataFrame(TEMPLATES, "variant string, template string")
    return T.assemble_prompt(case_inputs(spark, d), tpl, "lab_num+", "case_id")


# --------------------------------------------------------------------- second data set
def set2_cases(spark, d, max_lab_tokens=None):
    return T.set2_case(fx.icu_patients(spark, d), C.clean_history(fx.past_history(spark, d)), C.clean_exam(fx.physical_exam(spark, d)),
                       reduced_labs(spark, d), C.clean_diagnoses(fx.diagnoses(spark, d)), max_lab_tokens=max_lab_tokens)


@query("set2_case")
def q_set2_case(spark, d):
    """Case record: inputs and the names and codes of the disease lists."""
    def names(c):
        return F.concat_ws(";", F.transform(c, lambda x: F.concat_ws("/", x["name"], x["icd9code"], x["icd10code"]))).alias(c)
    return set2_cases(spark, d).select("case_id", *T.SET2_FIELDS, *[names(f"{n}_diseases") for n in ("all", "primary", "major", "other")])


@query("set2_input")
def q_set2_input(spark, d):
    """Prompt input with the lab text cut to the token cap, and tokens per field."""
    return T.set2_input(set2_cases(spark, d, LAB_TOKEN_CAP))


@query("set2_labels")
def q_set2_labels(spark, d):
    lab = set2_label_table(spark, d)
    return lab.select(F.col("case_id").cast("string").alias("case_id"), render_list("labels").alias("labels"), render_list("primary").alias("primary"),
                      render_list("major").alias("major"), "top1", "top1_any")


def set2_label_table(spark, d):
    def build(buckets):
        dx = T.diagnosis_struct(C.clean_diagnoses(fx.diagnoses(spark, d, buckets))).withColumnRenamed("hadm_id", "case_id")
        return T.set2_labels(dx.where("case_id IS NOT NULL"), any_col="top1_any")
    return bucketed(spark, d, "set2_labels", build, placed=True)


def set2_joined(spark, d):
    """Round 1 with 20-item lists, as version-10 codes, next to the labels of the second set."""
    from casespark.plans.metrics_q import preds_valid
    v10 = lambda c: F.transform(c, lambda x: F.concat(F.lit("X"), x)).alias(c)
    p = preds_valid(spark, d, (1,), length=20).select("case_id", v10("ranked"), v10("pred"))
    return p.join(set2_label_table(spark, d), "case_id")


@query("set2_top1_accuracy")
def q_set2_top1_accuracy(spark, d):
    """Top-code accuracy by the first primary disease, and with the first disease where there is none."""
    j = set2_joined(spark, d)
    rows = [M.top1_accuracy(j, top1=c).withColumn("top1", F.lit(name)) for c, name in (("top1", "first_primary"), ("top1_any", "with_fallback"))]
    return finalize(rows[0].unionByName(rows[1]))


@query("set2_recall_at_k")
def q_set2_recall_at_k(spark, d):
    return finalize(M.recall_at_k(set2_joined(spark, d).filter(F.size("labels") > 0), ks=range(1, 21)))
