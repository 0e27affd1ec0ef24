"""Oracle SQL for joins and set operations (correlated subqueries / EXISTS
where the Spark side uses joins and aggregates)."""

from oracles.cohort_sql import SAMPLED
from oracles.views import with_views

SQL: dict[str, str] = {}


def r6(e):
    return f"round(CAST({e} AS DOUBLE), 6)"


TS = "strftime({c}, '%Y-%m-%d %H:%M:%S')"

SQL["diag_with_title"] = with_views("""
SELECT d.hadm_id, d.seq_num, d.icd_code, d.icd_version, c.long_title
FROM diagnoses d JOIN code_dict c ON c.icd_code = d.icd_code AND c.icd_version = d.icd_version""", "diagnoses", "code_dict")

SQL["labs_with_item"] = with_views("""
SELECT l.labevent_id, l.itemid, i.label, i.fluid, i.category FROM labs_text l JOIN lab_items i ON i.itemid = l.itemid""",
                                   "labs_text", "lab_items")

SQL["core_stay"] = with_views(f"""
SELECT e.hadm_id, e.subject_id, p.gender, p.anchor_age, t.transfer_seq, t.careunit, {TS.format(c='t.intime')} AS intime
FROM encounters e LEFT JOIN patients p ON p.subject_id = e.subject_id LEFT JOIN transfers t ON t.hadm_id = e.hadm_id""",
                              "encounters", "patients", "transfers")

SQL["image_meta"] = with_views("""
SELECT i.dicom_id, i.subject_id, i.study_id, i.split, m."StudyDate", m."StudyTime"
FROM images i JOIN image_meta m
  ON i.dicom_id IS NOT DISTINCT FROM m.dicom_id AND i.subject_id IS NOT DISTINCT FROM m.subject_id
 AND i.study_id IS NOT DISTINCT FROM m.study_id""", "images", "image_meta")

IDS = "ids AS (SELECT DISTINCT patient_id AS hadm_id FROM sampled WHERE patient_id IS NOT NULL)"

_STAY_TABLES = [("diagnoses", "seq_num", "icd_code"), ("labs_text", "labevent_id", "CAST(itemid AS VARCHAR)"),
                ("micro", "microevent_id", "test_name"), ("notes", "note_id", "CAST(length(text) AS VARCHAR)")]
SQL["encounter_bundle"] = with_views("WITH " + SAMPLED + ",\n" + IDS + "\nSELECT i.hadm_id, " + ", ".join(
    f"(SELECT count(*) FROM {t} x WHERE x.hadm_id = i.hadm_id) AS n_{t.removesuffix('_text')}, "
    f"(SELECT coalesce(string_agg({v}, ',' ORDER BY {o}), '') FROM {t} x WHERE x.hadm_id = i.hadm_id) AS {t.removesuffix('_text')}"
    for t, o, v in _STAY_TABLES) + " FROM ids i", "diagnoses", "icu_patients", "labs_text", "micro", "notes")

SQL["bundle_rows"] = with_views("WITH " + SAMPLED + ",\n" + IDS + "\n" + " UNION ALL ".join(
    f"SELECT hadm_id, '{t.removesuffix('_text')}' AS \"table\", CAST(row_number() OVER (PARTITION BY hadm_id ORDER BY {o}) AS INTEGER) AS ord, "
    f"{v} AS item FROM {t} WHERE hadm_id IN (SELECT hadm_id FROM ids)" for t, o, v in _STAY_TABLES),
    "diagnoses", "icu_patients", "labs_text", "micro", "notes")

SQL["table_profile"] = with_views("WITH " + SAMPLED + ",\n" + IDS + """
SELECT hadm_id, 'diagnoses' AS "table", count(*) AS n_rows FROM diagnoses WHERE hadm_id IN (SELECT hadm_id FROM ids) GROUP BY hadm_id
UNION ALL SELECT hadm_id, 'labs', count(*) FROM labs_text WHERE hadm_id IN (SELECT hadm_id FROM ids) GROUP BY hadm_id
UNION ALL SELECT hadm_id, 'micro', count(*) FROM micro WHERE hadm_id IN (SELECT hadm_id FROM ids) GROUP BY hadm_id
UNION ALL SELECT hadm_id, 'notes', count(*) FROM notes WHERE hadm_id IN (SELECT hadm_id FROM ids) GROUP BY hadm_id""",
                                  "diagnoses", "icu_patients", "labs_text", "micro", "notes")

SQL["ed_optional"] = with_views("""
SELECT e.hadm_id, e.stay_id, t.ord, t.acuity FROM encounters e LEFT JOIN triage t ON t.stay_id = e.stay_id""",
                                "encounters", "triage")

PV = """
vl AS (SELECT list(code) AS codes FROM vocab),
pv AS (SELECT p.*, list_filter(p.final, lambda x: list_contains(vl.codes, x)) AS pred FROM case_preds p, vl)"""

SQL["missing_ids"] = with_views("WITH " + PV + """
SELECT case_id FROM pv WHERE round = 2 AND len(final) > 0
EXCEPT ALL SELECT case_id FROM pv WHERE round = 3 AND len(pred) > 0""", "case_preds", "vocab")

XW = """
top AS (SELECT d.hadm_id, d.seq_num, d.icd_code, d.icd_version, c.long_title
        FROM diagnoses d JOIN code_dict c ON c.icd_code = d.icd_code AND c.icd_version = d.icd_version WHERE d.seq_num <= 3),
t_any AS (SELECT icd_code, long_title AS t FROM code_dict QUALIFY row_number() OVER (PARTITION BY icd_code ORDER BY icd_version) = 1),
m10 AS (SELECT t.hadm_id, t.seq_num, x.icd9 AS code, a.t AS title
        FROM top t LEFT JOIN crosswalk x ON x.icd10 = t.icd_code LEFT JOIN t_any a ON a.icd_code = x.icd9
        WHERE t.icd_version = 10),
allc AS (SELECT hadm_id, 0 AS part, seq_num, icd_code AS code, long_title AS title FROM top WHERE icd_version = 9
         UNION ALL SELECT hadm_id, 1, seq_num, code, title FROM m10 WHERE code IS NOT NULL AND title IS NOT NULL),
cc AS (SELECT hadm_id, list(code ORDER BY part, seq_num, code, title) AS codes,
              string_agg(code, ',' ORDER BY part, seq_num, code, title) AS codes_s,
              string_agg(title, '|' ORDER BY part, seq_num, code, title) AS titles_s, count(*) AS n FROM allc GROUP BY hadm_id)"""

V_XW = ("diagnoses", "code_dict", "crosswalk")

SQL["crosswalk_codes"] = with_views("WITH " + XW + "\nSELECT hadm_id, codes_s AS codes, titles_s AS titles, n AS n_codes FROM cc", *V_XW)

SQL["crosswalk_unmapped"] = with_views("WITH " + XW + """
SELECT hadm_id, count(*) AS n_unmapped FROM m10 WHERE code IS NULL OR title IS NULL GROUP BY hadm_id""", *V_XW)

SQL["primary_code"] = with_views("WITH " + XW + """,
f AS (SELECT d.hadm_id, d.icd_code, d.icd_version, c.long_title FROM diagnoses d
      JOIN code_dict c ON c.icd_code = d.icd_code AND c.icd_version = d.icd_version WHERE d.seq_num = 1),
p AS (SELECT f.hadm_id, CASE WHEN f.icd_version = 10 THEN x.icd9 ELSE f.icd_code END AS code,
             CASE WHEN f.icd_version = 10 THEN coalesce(a.t, 'Unknown') ELSE f.long_title END AS name
      FROM f LEFT JOIN crosswalk x ON x.icd10 = f.icd_code
      LEFT JOIN t_any a ON a.icd_code = CASE WHEN f.icd_version = 10 THEN x.icd9 ELSE f.icd_code END)
SELECT p.hadm_id, p.code, p.name FROM p JOIN cc ON cc.hadm_id = p.hadm_id WHERE list_contains(cc.codes, p.code)""", *V_XW)

SQL["label_pred_full"] = with_views("""
WITH l AS (SELECT icd_code AS code, count(*) AS n_label FROM diagnoses WHERE seq_num <= 3 GROUP BY 1),
p AS (SELECT code, count(*) AS n_pred FROM (SELECT unnest(final) AS code FROM case_preds WHERE round = 1) GROUP BY 1)
SELECT coalesce(l.code, p.code) AS code, CAST(coalesce(n_label, 0) AS BIGINT) AS n_label, CAST(coalesce(n_pred, 0) AS BIGINT) AS n_pred
FROM l FULL JOIN p ON p.code = l.code""", "diagnoses", "case_preds")

SQL["join_rounds"] = with_views("""
SELECT case_id, max(CASE WHEN round = 1 THEN r END) AS r1, max(CASE WHEN round = 2 THEN r END) AS r2, max(CASE WHEN round = 3 THEN r END) AS r3
FROM (SELECT case_id, round, array_to_string(ranked, ',') AS r FROM case_preds)
GROUP BY case_id HAVING count(DISTINCT round) = 3""", "case_preds")

SQL["source_fallback"] = with_views("""
SELECT e.hadm_id, n.note_id AS doc_id, 'notes' AS source FROM encounters e JOIN notes n ON n.hadm_id = e.hadm_id
UNION ALL
SELECT e.hadm_id, r.report_id, 'reports' FROM encounters e JOIN reports r ON r.hadm_id = e.hadm_id
WHERE NOT EXISTS (SELECT 1 FROM notes n WHERE n.hadm_id = e.hadm_id)""", "encounters", "notes", "reports")

SQL["source_fallback_missing"] = with_views("""
SELECT DISTINCT hadm_id FROM encounters e WHERE NOT EXISTS (SELECT 1 FROM notes n WHERE n.hadm_id = e.hadm_id)
  AND NOT EXISTS (SELECT 1 FROM reports r WHERE r.hadm_id = e.hadm_id)""", "encounters", "notes", "reports")

SQL["code_name_lookup"] = with_views("""
SELECT c.code, coalesce(n.name, 'Unknown') AS name FROM (SELECT DISTINCT unnest(final) AS code FROM case_preds) c
LEFT JOIN code_names n ON n.code = c.code""", "case_preds", "code_names")

SQL["stay_attributes"] = with_views(f"""
WITH ft AS (SELECT * FROM triage QUALIFY row_number() OVER (PARTITION BY stay_id ORDER BY ord) = 1)
SELECT e.subject_id, e.hadm_id, e.stay_id, e.discharge_location = 'DIED' AS died,
       {r6('(epoch_us(e.dischtime) - epoch_us(e.admittime)) / 3600000000.0')} AS los_hours,
       p.gender, p.anchor_age, p.race, {r6('ft.temperature')} AS temperature, {r6('ft.heartrate')} AS heartrate,
       ft.acuity, ft.chiefcomplaint
FROM encounters e LEFT JOIN patients p ON p.subject_id = e.subject_id LEFT JOIN ft ON ft.stay_id = e.stay_id""",
                                    "encounters", "patients", "triage")

SQL["union_sources"] = with_views("""
SELECT note_id AS doc_id, hadm_id, CAST(length(text) AS INTEGER) AS n_chars, 'notes' AS source FROM notes
UNION ALL SELECT report_id, hadm_id, CAST(length(text) AS INTEGER), 'reports' FROM reports""", "notes", "reports")

SQL["intersect_ids"] = with_views("SELECT hadm_id FROM diagnoses INTERSECT SELECT hadm_id FROM micro", "diagnoses", "micro")

SQL["except_ids"] = with_views("""
WITH dx AS (SELECT * FROM diagnoses WHERE icd9code IS NOT NULL),
top AS (SELECT icd_code FROM dx GROUP BY icd_code ORDER BY count(*) DESC, icd_code LIMIT 30)
SELECT hadm_id FROM dx EXCEPT SELECT hadm_id FROM dx WHERE icd_code IN (SELECT icd_code FROM top)""", "diagnoses")
