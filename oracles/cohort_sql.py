"""Oracle SQL (DuckDB) for the cohort queries.  Written independently of the
Spark operators: NOT IN / string_agg / QUALIFY where Spark uses flags, arrays
and window limits."""

from oracles.views import with_views

SQL: dict[str, str] = {}


def md5_draw(seed, *parts) -> str:
    inner = ", ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"CAST(('0x' || substr(md5(concat_ws(':', {inner})), 1, 8)) AS BIGINT)"


TOP = """
dx AS (SELECT * FROM diagnoses WHERE icd9code IS NOT NULL),
top AS (SELECT icd_code FROM dx GROUP BY icd_code ORDER BY count(*) DESC, icd_code LIMIT 30)"""

COHORT = TOP + """,
bad AS (SELECT DISTINCT hadm_id FROM dx WHERE icd_code NOT IN (SELECT icd_code FROM top)),
keep AS (SELECT * FROM dx WHERE hadm_id NOT IN (SELECT hadm_id FROM bad)),
pos AS (SELECT hadm_id, icd_code, min(seq_num) AS p FROM keep GROUP BY hadm_id, icd_code),
ppos AS (SELECT hadm_id, priority, icd_code, min(seq_num) AS p FROM keep GROUP BY hadm_id, priority, icd_code),
lists AS (
  SELECT a.hadm_id,
         (SELECT string_agg(icd_code, ',' ORDER BY p) FROM pos b WHERE b.hadm_id = a.hadm_id) AS all_diseases,
         coalesce((SELECT string_agg(icd_code, ',' ORDER BY p) FROM ppos b WHERE b.hadm_id = a.hadm_id AND priority = 'Primary'), '') AS primary_diseases,
         coalesce((SELECT string_agg(icd_code, ',' ORDER BY p) FROM ppos b WHERE b.hadm_id = a.hadm_id AND priority = 'Major'), '') AS major_diseases,
         coalesce((SELECT string_agg(icd_code, ',' ORDER BY p) FROM ppos b WHERE b.hadm_id = a.hadm_id AND priority = 'Other'), '') AS other_diseases,
         (SELECT count(*) FROM pos b WHERE b.hadm_id = a.hadm_id) AS total_disease_count,
         (SELECT count(*) FROM ppos b WHERE b.hadm_id = a.hadm_id AND priority = 'Primary') AS primary_count,
         (SELECT count(*) FROM ppos b WHERE b.hadm_id = a.hadm_id AND priority = 'Major') AS major_count,
         (SELECT count(*) FROM ppos b WHERE b.hadm_id = a.hadm_id AND priority = 'Other') AS other_count
  FROM (SELECT DISTINCT hadm_id FROM keep) a),
cohort AS (
  SELECT l.hadm_id AS patient_id, TRY_CAST(regexp_extract(p.age, '\\d+', 0) AS INTEGER) AS age, p.gender,
         l.all_diseases, l.primary_diseases, l.major_diseases, l.other_diseases,
         CAST(l.total_disease_count AS BIGINT) AS total_disease_count, CAST(l.primary_count AS BIGINT) AS primary_count,
         CAST(l.major_count AS BIGINT) AS major_count, CAST(l.other_count AS BIGINT) AS other_count
  FROM lists l JOIN icu_patients p ON p.hadm_id = l.hadm_id
  WHERE l.primary_count > 0 AND l.major_count > 0)"""

SAMPLED = COHORT + f""",
cand AS (SELECT DISTINCT c.patient_id, k.icd_code FROM cohort c JOIN keep k ON k.hadm_id = c.patient_id),
ranked AS (SELECT icd_code, patient_id,
                  row_number() OVER (PARTITION BY icd_code ORDER BY {md5_draw(42, 'icd_code', 'patient_id')}, patient_id) AS draw_rank
           FROM cand),
avail AS (SELECT icd_code, count(*) AS available FROM cand GROUP BY icd_code),
sampled AS (
  SELECT t.icd_code AS disease, r.patient_id, CAST(r.draw_rank AS BIGINT) AS draw_rank,
         CAST(coalesce(a.available, 0) AS BIGINT) AS available,
         CAST(least(coalesce(a.available, 0), 20) AS BIGINT) AS sampled
  FROM top t LEFT JOIN avail a ON a.icd_code = t.icd_code
  LEFT JOIN (SELECT * FROM ranked WHERE draw_rank <= 20) r ON r.icd_code = t.icd_code)"""

SQL["code_frequency_top"] = with_views("""
WITH cnt AS (SELECT icd_code AS code, count(*) AS freq FROM diagnoses WHERE seq_num <= 3 GROUP BY icd_code),
top AS (SELECT code, freq, row_number() OVER (ORDER BY freq DESC, code) AS rank FROM cnt QUALIFY rank <= 30)
SELECT code, CAST(freq AS BIGINT) AS freq, CAST(rank AS INTEGER) AS rank, CAST(sum(freq) OVER () AS BIGINT) AS total FROM top
""", "diagnoses")

SQL["disease_frequency_top"] = with_views("""
WITH cnt AS (SELECT diagnosisstring, count(*) AS freq FROM diagnoses WHERE icd9code IS NOT NULL GROUP BY 1),
top AS (SELECT *, row_number() OVER (ORDER BY freq DESC, diagnosisstring) AS rank FROM cnt QUALIFY rank <= 100)
SELECT diagnosisstring, CAST(freq AS BIGINT) AS freq, CAST(rank AS INTEGER) AS rank, CAST(sum(freq) OVER () AS BIGINT) AS total FROM top
""", "diagnoses")

SQL["strict_cohort"] = with_views("WITH " + COHORT + "\nSELECT * FROM cohort", "diagnoses", "icu_patients")

SQL["cohort_funnel"] = with_views("WITH " + TOP + """,
per AS (
  SELECT hadm_id,
         bool_and(icd_code IN (SELECT icd_code FROM top)) AS all_top,
         bool_or(priority = 'Primary') AS has_p, bool_or(priority = 'Major') AS has_m,
         hadm_id IN (SELECT hadm_id FROM icu_patients) AS has_patient
  FROM dx GROUP BY hadm_id),
c AS (
  SELECT count(*) AS patients_with_diagnosis,
         count(*) FILTER (WHERE all_top) AS only_top,
         count(*) FILTER (WHERE NOT all_top) AS with_non_top,
         count(*) FILTER (WHERE all_top AND has_patient) AS candidates,
         count(*) FILTER (WHERE all_top AND has_patient AND NOT has_p) AS without_primary,
         count(*) FILTER (WHERE all_top AND has_patient AND NOT has_m) AS without_major,
         count(*) FILTER (WHERE all_top AND has_patient AND NOT has_p AND NOT has_m) AS without_both,
         count(*) FILTER (WHERE all_top AND has_patient AND NOT (has_p AND has_m)) AS filtered_by_priority,
         count(*) FILTER (WHERE all_top AND has_patient AND has_p AND has_m) AS retained
  FROM per)
SELECT ord, stage, CAST(n AS BIGINT) AS n, n / patients_with_diagnosis AS rate
FROM c, LATERAL (VALUES (0, 'patients_with_diagnosis', patients_with_diagnosis), (1, 'only_top', only_top),
  (2, 'with_non_top', with_non_top), (3, 'candidates', candidates), (4, 'without_primary', without_primary),
  (5, 'without_major', without_major), (6, 'without_both', without_both),
  (7, 'filtered_by_priority', filtered_by_priority), (8, 'retained', retained)) v(ord, stage, n)
""", "diagnoses", "icu_patients")

SQL["coverage_report"] = with_views("WITH " + TOP + """,
pd AS (SELECT DISTINCT hadm_id, icd_code FROM dx),
cov AS (SELECT DISTINCT hadm_id FROM pd WHERE icd_code IN (SELECT icd_code FROM top)),
tot AS (SELECT count(DISTINCT hadm_id) AS total, (SELECT count(*) FROM cov) AS covered FROM pd),
unc AS (SELECT icd_code, count(*) AS n FROM pd WHERE hadm_id NOT IN (SELECT hadm_id FROM cov) GROUP BY icd_code
        ORDER BY n DESC, icd_code LIMIT 50)
SELECT 'summary' AS section, 'total_patients_with_icd' AS name, CAST(total AS BIGINT) AS n, 1.0::DOUBLE AS rate FROM tot
UNION ALL SELECT 'summary', 'covered_patients', CAST(covered AS BIGINT), covered / total FROM tot
UNION ALL SELECT 'summary', 'uncovered_patients', CAST(total - covered AS BIGINT), (total - covered) / total FROM tot
UNION ALL SELECT 'disease_patients', t.icd_code, CAST((SELECT count(*) FROM pd WHERE pd.icd_code = t.icd_code) AS BIGINT), NULL FROM top t
UNION ALL SELECT 'top_uncovered', icd_code, CAST(n AS BIGINT), NULL FROM unc
""", "diagnoses")

SQL["sample_per_disease"] = with_views("WITH " + SAMPLED + "\nSELECT * FROM sampled", "diagnoses", "icu_patients")

SAMPLE_CODE = f"""
pairs AS (SELECT DISTINCT d.hadm_id AS case_id, d.icd_code AS code, l.top1
          FROM diagnoses d JOIN case_labels l ON l.case_id = d.hadm_id WHERE d.seq_num <= 3),
picked AS (SELECT DISTINCT case_id FROM (
  SELECT case_id, row_number() OVER (PARTITION BY code ORDER BY (top1 = code) DESC,
         {md5_draw(0, 'code', 'case_id')}, case_id) AS rk FROM pairs) WHERE rk <= 30)"""

SQL["sample_per_code"] = with_views("WITH " + SAMPLE_CODE + "\nSELECT case_id FROM picked", "diagnoses", "case_labels")

SQL["ordered_distinct"] = with_views("""
WITH f AS (SELECT hadm_id, diagnosisstring, min(seq_num) AS p FROM diagnoses WHERE diagnosisstring IS NOT NULL GROUP BY 1, 2)
SELECT hadm_id, string_agg(diagnosisstring, ';' ORDER BY p) AS diseases, CAST(count(*) AS BIGINT) AS n_diseases
FROM f GROUP BY hadm_id
""", "diagnoses")

SQL["split_by_patient"] = with_views(f"""
SELECT hadm_id, subject_id,
       CASE WHEN {md5_draw(1, 'subject_id')} < {int(0.8 * 2 ** 32)} THEN 'train'
            WHEN {md5_draw(1, 'subject_id')} < {int(0.9 * 2 ** 32)} THEN 'val' ELSE 'test' END AS split
FROM encounters
""", "encounters")

SQL["patient_diag"] = with_views("""
SELECT d.hadm_id, d.seq_num, d.icd_code, d.priority, p.gender, p.age
FROM icu_patients p JOIN diagnoses d ON d.hadm_id = p.hadm_id
""", "icu_patients", "diagnoses")

SQL["semi_filter"] = with_views("WITH " + SAMPLED + """
SELECT hadm_id, seq_num, icd_code, priority FROM diagnoses
WHERE hadm_id IN (SELECT patient_id FROM sampled WHERE patient_id IS NOT NULL)
""", "diagnoses", "icu_patients")

SQL["resume_pending"] = with_views("""
SELECT hadm_id AS case_id, subject_id FROM encounters e
WHERE NOT EXISTS (SELECT 1 FROM responses r WHERE r.case_id = e.hadm_id)
""", "encounters", "responses")

SQL["nonempty_label"] = with_views("WITH " + SAMPLE_CODE + """
SELECT case_id, array_to_string("primary", ',') AS primary_codes FROM case_labels
WHERE case_id IN (SELECT case_id FROM picked) AND len("primary") > 0
""", "diagnoses", "case_labels")

SQL["supplement_cases"] = with_views("WITH " + SAMPLE_CODE + """,
s AS (SELECT * FROM case_labels WHERE case_id IN (SELECT case_id FROM picked)),
removed AS (SELECT count(*) AS n FROM s WHERE len("primary") = 0),
extra AS (SELECT case_id, "primary" FROM case_labels
          WHERE case_id NOT IN (SELECT case_id FROM picked) AND len("primary") > 0
          ORDER BY case_id LIMIT (SELECT n FROM removed))
SELECT case_id, array_to_string("primary", ',') AS primary_codes FROM s WHERE len("primary") > 0
UNION ALL SELECT case_id, array_to_string("primary", ',') FROM extra
""", "diagnoses", "case_labels")
