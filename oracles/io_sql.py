"""Oracle SQL for sources/sinks, streaming and the scoring hook (the file round
trips must give back what the tables hold)."""

from oracles.cohort_sql import SAMPLED
from oracles.responses_sql import DEDUP_FIRST, ONE
from oracles.text_sql import CASE_INPUTS, V_CASE
from oracles.views import with_views

SQL: dict[str, str] = {}

SQL["scan_typed_csv"] = with_views("""
SELECT hadm_id, seq_num, icd_code, icd_version, priority, nullif(icd9code, '') AS icd9code, diagnosisstring FROM diagnoses""",
                                   "diagnoses")

SQL["parse_times"] = with_views("""
SELECT hadm_id, strftime(admittime, '%Y-%m-%d %H:%M') AS admit_min,
       CASE WHEN hadm_id % 7 = 0 THEN NULL ELSE strftime(dischtime, '%Y-%m-%d %H:%M') END AS disch_min FROM encounters""",
                                "encounters")

SQL["read_json_lines"] = with_views("""
SELECT case_id, round, line_no, CAST(length(response) AS INTEGER) AS n_chars FROM responses""", "responses")
SQL["read_json_array"] = SQL["read_json_lines"]
SQL["read_json_or_lines"] = SQL["read_json_lines"]

SQL["decode_list_text"] = with_views("""
WITH t AS (SELECT case_id, round,
                  CASE WHEN case_id % 13 = 0 THEN [] WHEN case_id % 17 = 0 THEN []
                       WHEN case_id % 19 = 0 THEN [ranked[1]] ELSE final END AS l FROM case_preds)
SELECT case_id, round, array_to_string(l, ',') AS codes, CAST(len(l) AS BIGINT) AS n FROM t""", "case_preds")

SQL["parse_case_list"] = with_views("SELECT subject_id, hadm_id, coalesce(stay_id, 0) AS stay_id FROM encounters", "encounters")

SQL["parse_code_map"] = with_views("SELECT DISTINCT icd_code AS code, diagnosisstring AS path FROM diagnoses", "diagnoses")

SQL["write_tables"] = with_views("SELECT case_id, array_to_string(labels, ',') AS labels, top1 FROM case_labels",
                                 "case_labels", "diagnoses")

SQL["key_coverage"] = with_views("WITH " + SAMPLED + """,
ids AS (SELECT DISTINCT patient_id AS hadm_id FROM sampled WHERE patient_id IS NOT NULL),
u AS (SELECT DISTINCT 'diagnoses' AS "table", hadm_id FROM diagnoses UNION ALL SELECT DISTINCT 'labs', hadm_id FROM labs_text
      UNION ALL SELECT DISTINCT 'micro', hadm_id FROM micro UNION ALL SELECT DISTINCT 'notes', hadm_id FROM notes
      UNION ALL SELECT DISTINCT 'reports', hadm_id FROM reports),
v AS (SELECT * FROM u UNION ALL SELECT DISTINCT 'ANY', hadm_id FROM u
      UNION ALL SELECT 'ALL', hadm_id FROM u GROUP BY hadm_id HAVING count(*) = 5)
SELECT "table", count(*) AS n_keys, count(*) FILTER (WHERE hadm_id IN (SELECT hadm_id FROM ids)) AS n_in_sample,
       (SELECT count(*) FROM ids) - count(*) FILTER (WHERE hadm_id IN (SELECT hadm_id FROM ids)) AS n_sample_missing
FROM v GROUP BY "table\"""", "diagnoses", "icu_patients", "labs_text", "micro", "notes", "reports")

SQL["ingest_responses"] = with_views("WITH " + ONE + "," + DEDUP_FIRST + """
SELECT case_id, round, line_no, method, array_to_string(ranked, ',') AS ranked, array_to_string(final, ',') AS final FROM vd""",
                                     "responses")

SCORED = """,
pr AS (SELECT hadm_id AS case_id, md5(chr(10) || lab) AS h FROM ci)"""

SQL["score_cases"] = with_views("WITH " + CASE_INPUTS + SCORED + """
SELECT case_id, '{"top10": ["' || c || '"], "predictions": ["' || c || '"]}' AS response, 1 AS attempts
FROM (SELECT case_id, h, lpad(CAST((CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % 40) * 25 AS VARCHAR), 5, '0') AS c FROM pr)
WHERE substr(h, 1, 1) <> 'f'""", *V_CASE)

SQL["score_cases_failed"] = with_views("WITH " + CASE_INPUTS + SCORED + """
SELECT case_id, 3 AS attempts, 'RuntimeError: service unavailable' AS error FROM pr WHERE substr(h, 1, 1) = 'f'""", *V_CASE)
