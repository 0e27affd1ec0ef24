"""Join / set-operation queries of the case build."""

from __future__ import annotations

from pyspark.sql import functions as F

from casespark.functions.columns import finalize, render_list, ts_text
from casespark.operators import joins as J
from casespark.plans.cohort_q import sampled_ids
from casespark.plans.metrics_q import preds_valid
from casespark.plans.registry import query
from casespark.plans.tables import parts
from casespark.sources import fixtures as fx


def _ts(c):
    return ts_text(c)


def _titled(spark, d):
    return J.diag_with_title(fx.diagnoses(spark, d), fx.code_dict(spark, d))


@query("diag_with_title")
def q_diag_with_title(spark, d):
    return _titled(spark, d).select("hadm_id", "seq_num", "icd_code", "icd_version", "long_title")


@query("labs_with_item")
def q_labs_with_item(spark, d):
    return J.labs_with_item(fx.labs_text(spark, d), fx.lab_items(spark, d)).select(
        "labevent_id", "itemid", "label", "fluid", "category")


@query("core_stay")
def q_core_stay(spark, d):
    c = J.core_stay(fx.encounters(spark, d), fx.patients(spark, d), fx.transfers(spark, d))
    return c.select("hadm_id", "subject_id", "gender", "anchor_age", "transfer_seq", "careunit",
                    _ts(F.col("intime")).alias("intime"))


@query("image_meta")
def q_image_meta(spark, d):
    j = J.null_safe_natural_join(fx.images(spark, d), fx.image_meta(spark, d))
    return j.select("dicom_id", "subject_id", "study_id", "split", "StudyDate", "StudyTime")


def _stays(spark, d):
    """Ids of the sampled stays (at most 20 for each of the top codes) and their tables, the order column first."""
    ids = sampled_ids(spark, d)
    tables = {"diagnoses": fx.diagnoses(spark, d).select("hadm_id", "seq_num", "icd_code"),
              "labs": fx.labs_text(spark, d).select("hadm_id", "labevent_id", "itemid"),
              "micro": fx.micro(spark, d).select("hadm_id", "microevent_id", "test_name"),
              "notes": fx.notes(spark, d).select("hadm_id", "note_id", F.length("text").alias("n_chars"))}
    return ids, tables


def _text_of(column):
    return lambda x: x[column].cast("string")


@query("encounter_bundle")
def q_encounter_bundle(spark, d):
    """The nested form: one row per stay, its rows as ordered arrays."""
    ids, tables = _stays(spark, d)
    b = J.encounter_bundle(ids, tables, "hadm_id", nest=True, ids_bounded=True)   # <= 20 per top code
    value = {"diagnoses": "icd_code", "labs": "itemid", "micro": "test_name", "notes": "n_chars"}
    return b.select("hadm_id", *[F.size(t).cast("long").alias(f"n_{t}") for t in tables],
                    *[F.array_join(F.transform(t, _text_of(c)), ",").alias(t) for t, c in value.items()])


@query("bundle_rows")
def q_bundle_rows(spark, d):
    ids, tables = _stays(spark, d)
    r = J.bundle_rows(ids, tables, "hadm_id", ids_bounded=True)
    item = F.coalesce("diagnoses.icd_code", F.col("labs.itemid").cast("string"), "micro.test_name", F.col("notes.n_chars").cast("string"))
    return r.select("hadm_id", "table", "ord", item.alias("item"))


@query("table_profile")
def q_table_profile(spark, d):
    ids, tables = _stays(spark, d)
    return J.encounter_bundle(ids, tables, "hadm_id", nest=False, ids_bounded=True).select("hadm_id", "table", "n_rows")


@query("ed_optional")
def q_ed_optional(spark, d):
    e = J.ed_optional(fx.encounters(spark, d).select("hadm_id", "stay_id"), fx.triage(spark, d).select("stay_id", "ord", "acuity"))
    return e.select("hadm_id", "stay_id", "ord", "acuity")


@query("missing_ids")
def q_missing_ids(spark, d):
    p = preds_valid(spark, d)
    run2 = p.filter((F.col("round") == 2) & (F.size("final") > 0)).select("case_id")
    run3 = p.filter((F.col("round") == 3) & (F.size("pred") > 0)).select("case_id")
    return run2.join(run3, "case_id", "left_anti")


def _crosswalk(spark, d):
    return J.crosswalk_codes(_titled(spark, d), fx.crosswalk(spark, d), fx.code_dict(spark, d))


def _case_codes(spark, d):
    codes, _ = _crosswalk(spark, d)
    s = F.struct("part", "seq_num", "code", "title")
    return codes.groupBy("hadm_id").agg(F.array_sort(F.collect_list(s)).alias("_l")).select(
        "hadm_id", F.transform("_l", lambda x: x["code"]).alias("codes"), F.transform("_l", lambda x: x["title"]).alias("titles"))


@query("crosswalk_codes")
def q_crosswalk_codes(spark, d):
    c = _case_codes(spark, d)
    return c.select("hadm_id", render_list("codes").alias("codes"), render_list("titles", "|").alias("titles"),
                    F.size("codes").cast("long").alias("n_codes"))


@query("crosswalk_unmapped")
def q_crosswalk_unmapped(spark, d):
    _, unmapped = _crosswalk(spark, d)
    return unmapped.select("hadm_id", "n_unmapped")


@query("primary_code")
def q_primary_code(spark, d):
    return J.primary_code(_titled(spark, d), fx.crosswalk(spark, d), fx.code_dict(spark, d), _case_codes(spark, d))


@query("label_pred_full")
def q_label_pred_full(spark, d):
    lab = fx.case_labels(spark, d).select(F.explode("labels").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n_label"))
    prd = preds_valid(spark, d, (1,)).select(F.explode("final").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n_pred"))
    return J.label_pred_full(lab, prd)


@query("join_rounds")
def q_join_rounds(spark, d):
    p = preds_valid(spark, d)
    r = [p.filter(F.col("round") == i).select("case_id", render_list("ranked").alias(f"r{i}")) for i in (1, 2, 3)]
    return r[0].join(r[1], "case_id").join(r[2], "case_id")


def _fallback(spark, d):
    notes = fx.notes(spark, d).select("hadm_id", F.col("note_id").alias("doc_id"))
    reps = fx.reports(spark, d).select("hadm_id", F.col("report_id").alias("doc_id"))
    ids = fx.encounters(spark, d).select("hadm_id")
    return J.source_fallback(ids, [("notes", notes), ("reports", reps)], "hadm_id", parts(spark, d, ("orders", "documents")))


@query("source_fallback")
def q_source_fallback(spark, d):
    rows, _ = _fallback(spark, d)
    return rows.select("hadm_id", "doc_id", "source")


@query("source_fallback_missing")
def q_source_fallback_missing(spark, d):
    _, missing = _fallback(spark, d)
    return missing.select("hadm_id")


@query("code_name_lookup")
def q_code_name_lookup(spark, d):
    codes = fx.case_preds(spark, d).select(F.explode("final").alias("code")).distinct()
    return J.code_name_lookup(codes, fx.code_names(spark, d)).select("code", "name")


@query("stay_attributes")
def q_stay_attributes(spark, d):
    return finalize(J.stay_attributes(fx.encounters(spark, d), fx.patients(spark, d), fx.triage(spark, d)))


@query("union_sources")
def q_union_sources(spark, d):
    n = fx.notes(spark, d).select(F.col("note_id").alias("doc_id"), "hadm_id", F.length("text").alias("n_chars"), F.lit("notes").alias("source"))
    r = fx.reports(spark, d).select(F.col("report_id").alias("doc_id"), "hadm_id", F.length("text").alias("n_chars"), F.lit("reports").alias("source"))
    return J.union_sources(n, r)


@query("intersect_ids")
def q_intersect_ids(spark, d):
    return J.intersect_ids(fx.diagnoses(spark, d).select("hadm_id"), fx.micro(spark, d).select("hadm_id"))


@query("except_ids")
def q_except_ids(spark, d):
    from casespark.plans.cohort_q import top_codes
    dx = fx.diagnoses(spark, d).filter("icd9code IS NOT NULL")
    covered = dx.join(top_codes(spark, d).select("icd_code"), "icd_code", "left_semi").select("hadm_id")
    return J.except_ids(dx.select("hadm_id"), covered)
