"""Oracle SQL for text projection (RE2 has no look-ahead: end markers are consumed)."""

from oracles.views import with_views

SQL: dict[str, str] = {}


def strip(e):
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def sec(text, start, end):
    pat = f"(?s){start}(.*?){end}"
    return f"CASE WHEN regexp_matches({text}, '{pat}') THEN {strip(f'regexp_extract({text}, {chr(39)}{pat}{chr(39)}, 1)')} ELSE 'None' END"


def before_discharge(e):
    return f"CASE WHEN strpos(lower({e}), 'discharge') > 0 THEN substr({e}, 1, strpos(lower({e}), 'discharge') - 1) ELSE {e} END"


HPI = sec("text", "History of Present Illness:\\n", "Past Medical History:")
PMH = sec("text", "Past Medical History:\\n", "Social History:")
EXAM = sec("text", "Physical Exam:\\n", "Pertinent Results:")
FAM = sec("text", "Social History:\\n", "Physical Exam:")
DIAG = ("array_to_string(list_transform(regexp_extract_all(text, '(?s)Discharge Diagnosis:(.*?)Discharge Condition:', 1), "
        "lambda x: " + strip("x") + "), ', ')")

SQL["note_sections"] = with_views(f"""
SELECT note_id, 'hpi' AS section, {HPI} AS text FROM notes
UNION ALL SELECT note_id, 'past_medical_history', {PMH} FROM notes
UNION ALL SELECT note_id, 'physical_exam', {EXAM} FROM notes
UNION ALL SELECT note_id, 'diagnosis', {DIAG} FROM notes""", "notes")

SQL["exam_before_discharge"] = with_views(f"""
SELECT note_id, {before_discharge('e')} AS text FROM (SELECT note_id, {EXAM} AS e FROM notes)""", "notes")

SQL["strip_findings"] = with_views("""
SELECT report_id, regexp_replace(text, '(?s)FINDINGS:.*?IMPRESSION:', 'IMPRESSION:', 'g') AS text FROM reports""", "reports")

NUM = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def num(c):
    return f"CASE WHEN regexp_matches({c}, '{NUM}') THEN TRY_CAST(trim({c}) AS DOUBLE) END"


def ntext(c, missing="nan"):
    return f"coalesce(CAST(round({c}, 6) AS VARCHAR), '{missing}')"


CASE_LABS = f"""
fl AS (SELECT l.* FROM labs_text l JOIN encounters e ON e.hadm_id = l.hadm_id
       WHERE l.charttime BETWEEN e.admittime AND e.dischtime AND lower(coalesce(l.comments, '')) NOT LIKE '%cancel%'
       QUALIFY row_number() OVER (PARTITION BY l.hadm_id, l.itemid ORDER BY l.charttime, l.labevent_id) = 1),
cl AS (SELECT fl.hadm_id, fl.labevent_id, fl.charttime, i.label, i.fluid, i.category, {num('fl.value')} AS v, fl.valueuom,
              {num('CAST(fl.ref_range_lower AS VARCHAR)')} AS lo, {num('CAST(fl.ref_range_upper AS VARCHAR)')} AS hi
       FROM fl JOIN lab_items i ON i.itemid = fl.itemid WHERE i.label IS DISTINCT FROM 'Delete'),
cl2 AS (SELECT * FROM cl WHERE v IS NOT NULL AND lo IS NOT NULL AND hi IS NOT NULL),
labtxt AS (SELECT hadm_id, replace('The following lab tests are available for the patient:' || chr(10) ||
              'labevents name,measurement fluid,measurement category,value,valueuom,lower_bound,upper_bound' || chr(10) ||
              string_agg(concat_ws(',', coalesce(label, 'nan'), coalesce(fluid, 'nan'), coalesce(category, 'nan'), {ntext('v')},
                                   coalesce(valueuom, 'nan'), {ntext('lo')}, {ntext('hi')}), chr(10) ORDER BY charttime, labevent_id)
              || chr(10), 'Beta-2', 'Beta-two') AS lab
           FROM cl2 GROUP BY hadm_id)"""

V_LABS = ("labs_text", "encounters", "lab_items")

SQL["render_lab_table"] = with_views("WITH " + CASE_LABS + "\nSELECT hadm_id, lab FROM labtxt", *V_LABS)

STAYS = """
ft AS (SELECT * FROM triage QUALIFY row_number() OVER (PARTITION BY stay_id ORDER BY ord) = 1),
st AS (SELECT e.subject_id, e.hadm_id, e.stay_id, p.gender, p.anchor_age, ft.* EXCLUDE (stay_id)
       FROM encounters e LEFT JOIN patients p ON p.subject_id = e.subject_id LEFT JOIN ft ON ft.stay_id = e.stay_id)"""

VITALS = f"""
vit AS (SELECT hadm_id, 'The ED info:' || chr(10) ||
          'gender,age approximation,temperature,heartrate,resprate,oxygen saturation,systolic blood pressure,diastolic blood pressure,pain level'
          || chr(10) || concat_ws(',', coalesce(gender, 'nan'), coalesce(CAST(anchor_age AS VARCHAR), 'nan'), {ntext('temperature')},
             {ntext('heartrate')}, {ntext('resprate')}, {ntext('o2sat')}, {ntext('sbp')}, {ntext('dbp')}, coalesce(pain, 'nan')) || chr(10) AS ed_info
        FROM st)"""

SQL["render_vitals"] = with_views("WITH " + STAYS + "," + VITALS + "\nSELECT hadm_id, ed_info FROM vit", "encounters", "patients", "triage")

MICRO = """
mm AS (SELECT mi.hadm_id, mi.test_name, mi.spec_type_desc, mi.microevent_id, mi.charttime, mi.ab_itemid, mi.ab_name, mi.interpretation,
              lower(coalesce(mi.org_name, '')) AS org_name, lower(coalesce(mi.comments, '')) AS comments
       FROM micro mi JOIN encounters e ON e.hadm_id = mi.hadm_id WHERE mi.charttime BETWEEN e.admittime AND e.dischtime),
mk AS (SELECT * FROM mm WHERE org_name NOT LIKE '%cancel%' AND comments NOT LIKE '%cancel%' AND comments NOT LIKE '%\\_\\_\\_%' ESCAPE '\\'),
mr AS (SELECT *, bool_or(ab_itemid IS NULL) OVER (PARTITION BY hadm_id, test_name) AS any_null,
              row_number() OVER (PARTITION BY hadm_id, test_name ORDER BY charttime, microevent_id) AS rn FROM mk),
mf AS (SELECT * FROM mr WHERE NOT any_null OR rn = 1),
m15 AS (SELECT *, row_number() OVER (PARTITION BY hadm_id ORDER BY charttime, microevent_id) AS k FROM mf QUALIFY k <= 15),
mtxt AS (SELECT hadm_id, 'The microbiology tests for the patient:' || chr(10) ||
           'test name,used specimen,grew organism,test antibiotic,antibiotic sensitivity,Comments' || chr(10) ||
           string_agg(concat_ws(',', coalesce(test_name, 'NaN'), coalesce(spec_type_desc, 'NaN'), coalesce(org_name, 'NaN'),
                      coalesce(ab_name, 'NaN'),
                      CASE coalesce(interpretation, 'NaN') WHEN 'S' THEN 'sensitive' WHEN 'I' THEN 'intermediate'
                           WHEN 'R' THEN 'resistant' WHEN 'P' THEN 'pending' WHEN 'NaN' THEN 'NaN' END,
                      coalesce(comments, 'NaN')), chr(10) ORDER BY k) || chr(10) AS micro_info
         FROM m15 GROUP BY hadm_id)"""

SQL["render_micro"] = with_views("WITH " + MICRO + "\nSELECT hadm_id, micro_info FROM mtxt", "micro", "encounters")

SQL["text_or_none"] = with_views("WITH " + STAYS + """
SELECT hadm_id, 'The chief complaint: ' || coalesce(chiefcomplaint, 'None') AS ed_chiefcomplaint FROM st""",
                                 "encounters", "patients", "triage")

SQL["history_items"] = with_views("""
WITH h AS (SELECT * FROM past_history
           QUALIFY row_number() OVER (PARTITION BY patientunitstayid, pasthistorypath, pasthistoryvalue, pasthistoryvaluetext ORDER BY ord) = 1),
h2 AS (SELECT * FROM h WHERE pasthistoryvaluetext IS DISTINCT FROM 'Performed' AND starts_with(pasthistorypath, 'notes/Progress Notes/Past History/'))
SELECT patientunitstayid, 'Patient''s medical history and past conditions: ' ||
       string_agg(substr(pasthistorypath, 35), ', ' ORDER BY ord) AS past_history
FROM h2 GROUP BY patientunitstayid""", "past_history")

SQL["exam_items"] = with_views("""
WITH x AS (SELECT * FROM physical_exam
           QUALIFY row_number() OVER (PARTITION BY patientunitstayid, physicalexampath, physicalexamvalue, physicalexamtext ORDER BY ord) = 1),
x2 AS (SELECT * FROM x WHERE physicalexamvalue IS DISTINCT FROM 'Performed - Structured' AND coalesce(physicalexampath, '') <> '')
SELECT patientunitstayid, 'Physical examination findings and clinical observations: [' ||
       string_agg(string_split(physicalexampath, '/')[-1] || ': ' || coalesce(physicalexamtext, 'nan'), ', ' ORDER BY ord) || ']' AS physical_exam
FROM x2 GROUP BY patientunitstayid""", "physical_exam")

REDUCED = """
g AS (SELECT patientunitstayid, CAST(floor(labresultrevisedoffset / 240.0) * 240 AS BIGINT) AS b, labname, labresult, labid,
             labmeasurenamesystem
      FROM labs_offset WHERE labname IS NOT NULL AND labresult IS NOT NULL AND lower(labname) LIKE '%glucose%'),
ga AS (SELECT patientunitstayid, b AS labresultoffset, labname || '_4h_avg' AS labname, avg(labresult) AS labresult,
              arg_min(labmeasurenamesystem, labid) FILTER (WHERE labmeasurenamesystem IS NOT NULL) AS labmeasurenamesystem,
              min(labid) AS labid
       FROM g GROUP BY patientunitstayid, b, labname),
o AS (SELECT *, CASE WHEN labtypeid IS NOT DISTINCT FROM 7 THEN 30 ELSE 360 END AS width
      FROM labs_offset WHERE labname IS NOT NULL AND labresult IS NOT NULL AND lower(labname) NOT LIKE '%glucose%'),
ob AS (SELECT *, CAST(floor(labresultrevisedoffset / width) * width AS BIGINT) AS b, labtypeid IS NOT DISTINCT FROM 7 AS is7 FROM o),
last AS (SELECT patientunitstayid, labname, is7, b,
                arg_max(labresult, (labresultrevisedoffset, labid)) AS labresult,
                arg_max(labresultoffset, (labresultrevisedoffset, labid)) AS labresultoffset,
                arg_max(labmeasurenamesystem, (labresultrevisedoffset, labid)) FILTER (WHERE labmeasurenamesystem IS NOT NULL) AS labmeasurenamesystem,
                max(labid) AS labid
         FROM ob GROUP BY patientunitstayid, labname, is7, b),
red AS (SELECT patientunitstayid, labresultoffset, labname, labresult, labmeasurenamesystem, labid FROM ga
        UNION ALL SELECT patientunitstayid, labresultoffset, labname, labresult, labmeasurenamesystem, labid FROM last)"""

SQL["labs_as_csv"] = with_views("WITH " + REDUCED + """,
full_txt AS (
  SELECT patientunitstayid, 'Laboratory test results with timestamps and measurements:' || chr(10) ||
         'labresultoffset,labname,labresult,labmeasurenamesystem' || chr(10) ||
         string_agg(concat_ws(',', CAST(labresultoffset AS VARCHAR), labname, coalesce(CAST(round(labresult, 6) AS VARCHAR), ''),
                              coalesce(labmeasurenamesystem, '')), chr(10) ORDER BY labresultoffset, labname, labid) || chr(10) AS t
  FROM (SELECT DISTINCT * FROM red) GROUP BY patientunitstayid),
pieces AS (SELECT patientunitstayid, t, regexp_extract_all(t, '\\s*(?:\\w+|[^\\w\\s])') AS p FROM full_txt)
SELECT patientunitstayid, CASE WHEN len(p) > 8168 THEN array_to_string(p[1:8168], '') ELSE t END AS lab_results FROM pieces""",
                                "labs_offset")

SQL["diagnosis_struct"] = with_views("""
WITH c AS (SELECT *, trim(coalesce(string_split(coalesce(icd9code, ''), ', ')[1], '')) AS v9,
                     trim(coalesce(string_split(coalesce(icd9code, ''), ', ')[2], '')) AS v10
           FROM diagnoses WHERE icd9code IS NOT NULL AND trim(icd9code) <> ''
           QUALIFY row_number() OVER (PARTITION BY hadm_id, diagnosisstring ORDER BY seq_num) = 1)
SELECT hadm_id, coalesce(string_agg(diagnosisstring, ';' ORDER BY seq_num), '') AS all_names,
       string_agg(v9 || '/' || v10, ',' ORDER BY seq_num) AS all_codes,
       coalesce(string_agg(diagnosisstring, ';' ORDER BY seq_num) FILTER (WHERE priority = 'Primary'), '') AS primary_names,
       coalesce(string_agg(diagnosisstring, ';' ORDER BY seq_num) FILTER (WHERE priority = 'Major'), '') AS major_names,
       coalesce(string_agg(diagnosisstring, ';' ORDER BY seq_num) FILTER (WHERE priority IS NULL OR priority NOT IN ('Primary', 'Major')), '') AS other_names
FROM c GROUP BY hadm_id""", "diagnoses")

SQL["demographics_text"] = with_views("""
SELECT hadm_id, 'Patient demographics and basic information: gender: ' || coalesce(gender, 'nan') || ', age: ' ||
       CASE WHEN age IS NULL OR age = '' THEN 'nan' ELSE age END AS patient_info FROM icu_patients""", "icu_patients")

SQL["age_number"] = with_views("SELECT hadm_id, TRY_CAST(regexp_extract(age, '\\d+', 0) AS INTEGER) AS age FROM icu_patients",
                               "icu_patients")

SQL["hours_between"] = with_views("""
SELECT hadm_id, round((epoch_us(dischtime) - epoch_us(admittime)) / 3600000000.0, 6) AS los_hours,
       round((epoch_us(ed_outtime) - epoch_us(ed_intime)) / 3600000000.0, 6) AS ed_hours FROM encounters""", "encounters")

SQL["icu_los_days"] = with_views("SELECT hadm_id, round(unitdischargeoffset / 1440.0, 6) AS icu_los_days FROM icu_patients",
                                 "icu_patients")

SQL["study_time"] = with_views("""
SELECT dicom_id, strftime(date_trunc('minute', strptime(substr(CAST("StudyDate" AS VARCHAR) || printf('%010.3f', "StudyTime"), 1, 14),
                                                        '%Y%m%d%H%M%S')), '%Y-%m-%d %H:%M:%S') AS study_ts
FROM image_meta""", "image_meta")

SQL["truncate_tokens"] = with_views(f"""
WITH h AS (SELECT note_id, {HPI} AS hpi FROM notes),
p AS (SELECT note_id, hpi, regexp_extract_all(hpi, '\\s*(?:\\w+|[^\\w\\s])') AS pieces FROM h),
t AS (SELECT note_id, CASE WHEN len(pieces) > 8168 THEN array_to_string(pieces[1:8168], '') ELSE hpi END AS text FROM p)
SELECT note_id, text, CAST(len(regexp_extract_all(text, '\\w+|[^\\w\\s]')) AS BIGINT) AS n_tokens FROM t""", "notes")

CASE_INPUTS = CASE_LABS + "," + STAYS + "," + VITALS + "," + MICRO + f""",
fn AS (SELECT * FROM notes QUALIFY row_number() OVER (PARTITION BY hadm_id ORDER BY note_id) = 1),
nt AS (SELECT hadm_id, 'The family history: ' || {FAM} AS family_history,
              'The past medical history: ' || {PMH} AS past_medical_history,
              'The history of present illness : ' || {HPI} AS hpi_text,
              'The physical exam on admission : ' || {before_discharge(EXAM)} AS physical_text FROM fn),
rp AS (SELECT r.hadm_id, list(regexp_replace(r.text, '(?s)FINDINGS:.*?IMPRESSION:', 'IMPRESSION:', 'g') ORDER BY r.report_id) AS report
       FROM reports r JOIN encounters e ON e.hadm_id = r.hadm_id GROUP BY r.hadm_id),
ci AS (
  SELECT concat_ws('/', st.subject_id, st.hadm_id, coalesce(st.stay_id, 0)) AS case_id, st.hadm_id, lt.lab, vit.ed_info,
         'The chief complaint: ' || coalesce(st.chiefcomplaint, 'None') AS ed_chiefcomplaint,
         coalesce(nt.family_history, 'The family history: None') AS family_history,
         coalesce(nt.past_medical_history, 'The past medical history: None') AS past_medical_history,
         coalesce(nt.hpi_text, 'The history of present illness : None') AS hpi_text,
         coalesce(nt.physical_text, 'The physical exam on admission : None') AS physical_text,
         coalesce(rp.report, []::VARCHAR[]) AS report,
         coalesce(mtxt.micro_info, 'The microbiology tests for the patient: None') AS micro_info
  FROM labtxt lt JOIN st ON st.hadm_id = lt.hadm_id LEFT JOIN vit ON vit.hadm_id = lt.hadm_id
  LEFT JOIN nt ON nt.hadm_id = lt.hadm_id LEFT JOIN rp ON rp.hadm_id = lt.hadm_id LEFT JOIN mtxt ON mtxt.hadm_id = lt.hadm_id)"""

V_CASE = V_LABS + ("patients", "triage", "micro", "notes", "reports")

XW = """
top AS (SELECT d.hadm_id, d.seq_num, d.icd_code, d.icd_version, c.long_title
        FROM diagnoses d JOIN code_dict c ON c.icd_code = d.icd_code AND c.icd_version = d.icd_version WHERE d.seq_num <= 3),
t_any AS (SELECT icd_code, long_title AS t FROM code_dict QUALIFY row_number() OVER (PARTITION BY icd_code ORDER BY icd_version) = 1),
m10 AS (SELECT t.hadm_id, t.seq_num, x.icd9 AS code, a.t AS title
        FROM top t LEFT JOIN crosswalk x ON x.icd10 = t.icd_code LEFT JOIN t_any a ON a.icd_code = x.icd9 WHERE t.icd_version = 10),
allc AS (SELECT hadm_id, 0 AS part, seq_num, icd_code AS code, long_title AS title FROM top WHERE icd_version = 9
         UNION ALL SELECT hadm_id, 1, seq_num, code, title FROM m10 WHERE code IS NOT NULL AND title IS NOT NULL),
cc AS (SELECT hadm_id, string_agg(code, ',' ORDER BY part, seq_num, code, title) AS output_icd_id,
              string_agg(title, '|' ORDER BY part, seq_num, code, title) AS output_icd_name FROM allc GROUP BY hadm_id)"""

FIELDS = ["lab", "ed_info", "family_history", "ed_chiefcomplaint", "past_medical_history", "physical_text", "hpi_text",
          "micro_info", "report"]

SQL["note_input_case"] = with_views("WITH " + CASE_INPUTS + "," + XW + """
SELECT ci.case_id, ci.lab, ci.ed_info, ci.family_history, ci.ed_chiefcomplaint, ci.past_medical_history, ci.physical_text,
       ci.hpi_text, ci.micro_info, array_to_string(ci.report, chr(10) || '---' || chr(10)) AS report,
       cc.output_icd_id, cc.output_icd_name
FROM ci JOIN cc ON cc.hadm_id = ci.hadm_id""", *V_CASE, "diagnoses", "code_dict", "crosswalk")


def _tok(e):
    return f"CAST(len(regexp_extract_all(coalesce({e}, ''), '\\w+|[^\\w\\s]')) AS BIGINT)"


_rows = " UNION ALL ".join(
    f"SELECT case_id, '{f}' AS field, {_tok('array_to_string(report, chr(32))' if f == 'report' else f)} AS n FROM ci" for f in FIELDS)
SQL["estimate_tokens"] = with_views("WITH " + CASE_INPUTS + f""",
fields AS ({_rows})
SELECT case_id, field, n FROM fields
UNION ALL SELECT case_id, 'total', CAST(sum(n) AS BIGINT) FROM fields GROUP BY case_id""", *V_CASE)

SQL["assemble_prompt"] = with_views("WITH " + CASE_INPUTS + """,
tpl(variant, template) AS (VALUES ('expert_designed', 'Rank the most likely diagnosis codes for this case.'),
                                  ('severity_based', 'Rank diagnosis codes by clinical severity and evidence.'),
                                  ('cot_based', 'Reason step by step, then rank diagnosis codes.'))
SELECT ci.case_id, tpl.variant, tpl.template || chr(10) || chr(10) || coalesce(ci.lab, 'None') || chr(10) || coalesce(ci.ed_info, 'None')
       || chr(10) || coalesce(ci.micro_info, 'None') AS prompt
FROM ci, tpl""", *V_CASE)

SQL["select_fields_by_task"] = with_views("WITH " + CASE_INPUTS + """
SELECT case_id, chr(10) || coalesce(lab, 'None') || chr(10) || coalesce(ed_info, 'None') || chr(10) || coalesce(family_history, 'None')
       || chr(10) || coalesce(ed_chiefcomplaint, 'None') || chr(10) || coalesce(past_medical_history, 'None') AS input_text
FROM ci""", *V_CASE)

SET2 = REDUCED + """,
lab_txt AS (
  SELECT patientunitstayid AS id, 'Laboratory test results with timestamps and measurements:' || chr(10) ||
         'labresultoffset,labname,labresult,labmeasurenamesystem' || chr(10) ||
         string_agg(concat_ws(',', CAST(labresultoffset AS VARCHAR), labname, coalesce(CAST(round(labresult, 6) AS VARCHAR), ''),
                              coalesce(labmeasurenamesystem, '')), chr(10) ORDER BY labresultoffset, labname, labid) || chr(10) AS lab_results
  FROM (SELECT DISTINCT * FROM red) GROUP BY patientunitstayid),
h1 AS (SELECT * FROM past_history
       QUALIFY row_number() OVER (PARTITION BY patientunitstayid, pasthistorypath, pasthistoryvalue, pasthistoryvaluetext ORDER BY ord) = 1),
ht AS (SELECT patientunitstayid AS id, 'Patient''s medical history and past conditions: ' || string_agg(substr(pasthistorypath, 35), ', ' ORDER BY ord) AS past_history
       FROM h1 WHERE pasthistoryvaluetext IS DISTINCT FROM 'Performed' AND starts_with(pasthistorypath, 'notes/Progress Notes/Past History/') GROUP BY 1),
x1 AS (SELECT * FROM physical_exam
       QUALIFY row_number() OVER (PARTITION BY patientunitstayid, physicalexampath, physicalexamvalue, physicalexamtext ORDER BY ord) = 1),
xt AS (SELECT patientunitstayid AS id, 'Physical examination findings and clinical observations: [' ||
              string_agg(string_split(physicalexampath, '/')[-1] || ': ' || coalesce(physicalexamtext, 'nan'), ', ' ORDER BY ord) || ']' AS physical_exam
       FROM x1 WHERE physicalexamvalue IS DISTINCT FROM 'Performed - Structured' AND coalesce(physicalexampath, '') <> '' GROUP BY 1),
dc AS (SELECT *, trim(coalesce(string_split(icd9code, ', ')[1], '')) AS v9, trim(coalesce(string_split(icd9code, ', ')[2], '')) AS v10
       FROM diagnoses WHERE icd9code IS NOT NULL AND trim(icd9code) <> ''
       QUALIFY row_number() OVER (PARTITION BY hadm_id, diagnosisstring ORDER BY seq_num) = 1),
dn AS (SELECT hadm_id AS id, string_agg(t, ';' ORDER BY seq_num) AS all_d, string_agg(t, ';' ORDER BY seq_num) FILTER (WHERE priority = 'Primary') AS primary_d,
              string_agg(t, ';' ORDER BY seq_num) FILTER (WHERE priority = 'Major') AS major_d,
              string_agg(t, ';' ORDER BY seq_num) FILTER (WHERE priority IS NULL OR priority NOT IN ('Primary', 'Major')) AS other_d
       FROM (SELECT *, concat_ws('/', diagnosisstring, v9, v10) AS t FROM dc) GROUP BY 1),
s2 AS (SELECT p.hadm_id AS id, CAST(p.hadm_id AS VARCHAR) AS case_id,
              'Patient demographics and basic information: gender: ' || coalesce(p.gender, 'nan') || ', age: ' ||
              CASE WHEN p.age IS NULL OR p.age = '' THEN 'nan' ELSE p.age END AS patient_info,
              ht.past_history, xt.physical_exam, lab_txt.lab_results
       FROM icu_patients p LEFT JOIN ht ON ht.id = p.hadm_id LEFT JOIN xt ON xt.id = p.hadm_id LEFT JOIN lab_txt ON lab_txt.id = p.hadm_id)"""
V_SET2 = ("labs_offset", "past_history", "physical_exam", "icu_patients", "diagnoses")

SQL["set2_case"] = with_views("WITH " + SET2.strip() + """
SELECT s2.case_id, s2.patient_info, s2.past_history, s2.physical_exam, s2.lab_results, coalesce(dn.all_d, '') AS all_diseases,
       coalesce(dn.primary_d, '') AS primary_diseases, coalesce(dn.major_d, '') AS major_diseases, coalesce(dn.other_d, '') AS other_diseases
FROM s2 LEFT JOIN dn ON dn.id = s2.id""", *V_SET2)

_F2 = ("patient_info", "past_history", "physical_exam", "lab_results")
SQL["set2_input"] = with_views("WITH " + SET2.strip() + f""",
pc AS (SELECT * EXCLUDE (lab_results), CASE WHEN len(p) > 8168 THEN array_to_string(p[1:8168], '') ELSE lab_results END AS lab_results
       FROM (SELECT *, regexp_extract_all(lab_results, '\\s*(?:\\w+|[^\\w\\s])') AS p FROM s2)),
tk AS (SELECT case_id, {' || '.join(f"coalesce({f} || chr(10), '')" for f in _F2)} AS input_text,
              {', '.join(f"CASE WHEN {f} IS NOT NULL THEN {_tok(f)} END AS n_{f}" for f in _F2)} FROM pc)
SELECT *, CAST({' + '.join(f"coalesce(n_{f}, 0)" for f in _F2)} AS BIGINT) AS n_total FROM tk""", *V_SET2)

SET2_LABELS = """
dc AS (SELECT *, trim(coalesce(string_split(icd9code, ', ')[2], '')) AS v10
       FROM diagnoses WHERE icd9code IS NOT NULL AND trim(icd9code) <> ''
       QUALIFY row_number() OVER (PARTITION BY hadm_id, diagnosisstring ORDER BY seq_num) = 1),
l2 AS (SELECT hadm_id AS case_id, coalesce(list(v10 ORDER BY seq_num) FILTER (WHERE v10 <> ''), []) AS labels,
              coalesce(list(v10 ORDER BY seq_num) FILTER (WHERE v10 <> '' AND priority = 'Primary'), []) AS "primary",
              coalesce(list(v10 ORDER BY seq_num) FILTER (WHERE v10 <> '' AND priority = 'Major'), []) AS major FROM dc GROUP BY 1),
l3 AS (SELECT *, "primary"[1] AS top1, coalesce("primary"[1], labels[1]) AS top1_any FROM l2)"""
SQL["set2_labels"] = with_views("WITH " + SET2_LABELS.strip() + """
SELECT CAST(case_id AS VARCHAR) AS case_id, array_to_string(labels, ',') AS labels, array_to_string("primary", ',') AS "primary",
       array_to_string(major, ',') AS major, top1, top1_any FROM l3""", "diagnoses")

_SET2_J = "WITH " + SET2_LABELS.strip() + """,
vl AS (SELECT list(code) AS codes FROM vocab),
j2 AS (SELECT l3.*, list_transform(p.ranked, lambda x: 'X' || x) AS ranked,
              list_transform(list_filter(p.final, lambda x: list_contains(vl.codes, x)), lambda x: 'X' || x) AS pred
       FROM case_preds20 p JOIN l3 ON l3.case_id = p.case_id, vl WHERE p.round = 1)"""
SQL["set2_top1_accuracy"] = with_views(_SET2_J + "\n" + " UNION ALL ".join(f"""
SELECT '{name}' AS top1, count(*) FILTER (WHERE {c} IS NOT NULL AND list_contains(pred, {c})) AS correct, count(*) AS total_all,
       count(*) FILTER (WHERE {c} IS NOT NULL) AS total_with_top1,
       round(count(*) FILTER (WHERE {c} IS NOT NULL AND list_contains(pred, {c})) / count(*), 6) AS accuracy_all,
       round(count(*) FILTER (WHERE {c} IS NOT NULL AND list_contains(pred, {c})) / count(*) FILTER (WHERE {c} IS NOT NULL), 6) AS accuracy_with_top1
FROM j2""" for c, name in (("top1", "first_primary"), ("top1_any", "with_fallback"))), "diagnoses", "case_preds20", "vocab")
SQL["set2_recall_at_k"] = with_views(_SET2_J + """,
ks AS (SELECT unnest(range(1, 21)) AS k)
SELECT CAST(k AS INTEGER) AS k, round(avg(len(list_filter(list_distinct(labels), lambda x: list_contains(ranked[1:k], x))) / len(labels)), 6) AS recall, count(*) AS n
FROM j2, ks WHERE len(labels) > 0 GROUP BY k""", "diagnoses", "case_preds20", "vocab")
