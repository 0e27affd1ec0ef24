"""Oracle SQL for cleaning / event reduction: window functions and QUALIFY
where the Spark side uses min_by/max_by aggregates."""

from oracles.views import with_views

SQL: dict[str, str] = {}


def r6(e):
    return f"round(CAST({e} AS DOUBLE), 6)"


TS = "strftime({c}, '%Y-%m-%d %H:%M:%S')"
NUM = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def num(c):
    return f"CASE WHEN regexp_matches({c}, '{NUM}') THEN TRY_CAST(trim({c}) AS DOUBLE) END"


SQL["drop_blank_codes"] = with_views("""
SELECT hadm_id, seq_num, icd9code FROM diagnoses WHERE icd9code IS NOT NULL AND trim(icd9code) <> ''""", "diagnoses")

SQL["exclude_value"] = with_views("""
SELECT labevent_id, value FROM labs_text WHERE value IS DISTINCT FROM 'Delete'""", "labs_text")

SQL["top_n_ranked_codes"] = with_views("SELECT hadm_id, seq_num, icd_code FROM diagnoses WHERE seq_num <= 3", "diagnoses")

SQL["within_stay"] = with_views(f"""
SELECT l.labevent_id, l.hadm_id, {TS.format(c='l.charttime')} AS charttime
FROM labs_text l JOIN encounters e ON e.hadm_id = l.hadm_id
WHERE l.charttime BETWEEN e.admittime AND e.dischtime""", "labs_text", "encounters")

SQL["exclude_substring"] = with_views("""
SELECT labevent_id, lower(coalesce(comments, '')) AS comments FROM labs_text
WHERE lower(coalesce(comments, '')) NOT LIKE '%cancel%' AND lower(coalesce(comments, '')) NOT LIKE '%\\_\\_\\_%' ESCAPE '\\'""",
                                     "labs_text")

SQL["coerce_numeric_complete"] = with_views(f"""
SELECT labevent_id, {r6('v')} AS value, {r6('lo')} AS ref_range_lower, {r6('hi')} AS ref_range_upper FROM (
  SELECT labevent_id, {num('value')} AS v, {num('CAST(ref_range_lower AS VARCHAR)')} AS lo,
         {num('CAST(ref_range_upper AS VARCHAR)')} AS hi FROM labs_text)
WHERE v IS NOT NULL AND lo IS NOT NULL AND hi IS NOT NULL""", "labs_text")

SQL["hours_window"] = with_views(f"""
SELECT labevent_id, {r6('h')} AS hours FROM (
  SELECT l.labevent_id, (epoch_us(l.charttime) - epoch_us(e.admittime)) / 3600000000.0 AS h
  FROM labs_text l LEFT JOIN encounters e ON e.hadm_id = l.hadm_id)
WHERE h IS NULL OR (h >= 0 AND h <= 240)""", "labs_text", "encounters")

SQL["exclude_ids"] = with_views("""
SELECT hadm_id, discharge_location FROM encounters
WHERE hadm_id NOT IN (SELECT hadm_id FROM encounters WHERE discharge_location = 'DIED')""", "encounters")

SQL["split_codes_target"] = with_views("""
WITH top AS (SELECT icd_code FROM diagnoses WHERE icd9code IS NOT NULL GROUP BY icd_code ORDER BY count(*) DESC, icd_code LIMIT 30),
t AS (SELECT n.code AS icd_code, n.name FROM code_names n WHERE n.code IN (SELECT icd_code FROM top))
SELECT d.hadm_id, string_agg(d.icd_code, ',' ORDER BY d.seq_num) AS ids, string_agg(t.name, '|' ORDER BY d.seq_num) AS names,
       string_agg(d.icd_code || ':' || t.name, '|' ORDER BY d.seq_num) AS id_names
FROM diagnoses d JOIN t ON t.icd_code = d.icd_code GROUP BY d.hadm_id""", "diagnoses", "code_names")

SQL["first_lab_per_item"] = with_views(f"""
SELECT l.hadm_id, l.itemid, l.labevent_id, {TS.format(c='l.charttime')} AS charttime, l.value, lower(coalesce(l.comments, '')) AS comments
FROM labs_text l JOIN encounters e ON e.hadm_id = l.hadm_id
WHERE l.charttime BETWEEN e.admittime AND e.dischtime AND lower(coalesce(l.comments, '')) NOT LIKE '%cancel%'
QUALIFY row_number() OVER (PARTITION BY l.hadm_id, l.itemid ORDER BY l.charttime, l.labevent_id) = 1""",
                                      "labs_text", "encounters")

SQL["micro_first_or_all"] = with_views(f"""
WITH m AS (
  SELECT mi.hadm_id, mi.test_name, mi.microevent_id, mi.charttime, lower(coalesce(mi.org_name, '')) AS org_name,
         lower(coalesce(mi.comments, '')) AS comments, mi.ab_itemid
  FROM micro mi JOIN encounters e ON e.hadm_id = mi.hadm_id
  WHERE mi.charttime BETWEEN e.admittime AND e.dischtime),
k AS (SELECT * FROM m WHERE org_name NOT LIKE '%cancel%' AND comments NOT LIKE '%cancel%' AND comments NOT LIKE '%\\_\\_\\_%' ESCAPE '\\'),
r AS (SELECT *, count(*) FILTER (WHERE ab_itemid IS NULL) OVER (PARTITION BY hadm_id, test_name) AS n_null,
             row_number() OVER (PARTITION BY hadm_id, test_name ORDER BY charttime, microevent_id) AS rn FROM k)
SELECT hadm_id, test_name, microevent_id, {TS.format(c='charttime')} AS charttime, org_name, comments, ab_itemid
FROM r WHERE n_null = 0 OR rn = 1""", "micro", "encounters")

LAB_OUT = ("patientunitstayid, labname, round(labresult, 6) AS labresult, labresultoffset, labresultrevisedoffset, labtypeid, "
           "labmeasurenamesystem, labmeasurenameinterface, labid")

GLUCOSE = """
g AS (
  SELECT patientunitstayid, CAST(floor(labresultrevisedoffset / 240.0) * 240 AS BIGINT) AS b, labname, labresult,
         labtypeid, labmeasurenamesystem, labmeasurenameinterface, labid
  FROM labs_offset WHERE labname IS NOT NULL AND labresult IS NOT NULL AND lower(labname) LIKE '%glucose%'),
ga AS (
  SELECT patientunitstayid, labname || '_4h_avg' AS labname, avg(labresult) AS labresult, b AS labresultoffset,
         b AS labresultrevisedoffset,
         arg_min(labtypeid, labid) FILTER (WHERE labtypeid IS NOT NULL) AS labtypeid,
         arg_min(labmeasurenamesystem, labid) FILTER (WHERE labmeasurenamesystem IS NOT NULL) AS labmeasurenamesystem,
         arg_min(labmeasurenameinterface, labid) FILTER (WHERE labmeasurenameinterface IS NOT NULL) AS labmeasurenameinterface,
         min(labid) AS labid
  FROM g GROUP BY patientunitstayid, b, labname)"""


def latest(name, minutes, cond):
    cols = ["labresult", "labresultoffset", "labresultrevisedoffset", "labtypeid", "labmeasurenamesystem",
            "labmeasurenameinterface", "labid"]
    aggs = ",\n         ".join(
        f"(SELECT {c} FROM x x2 WHERE x2.patientunitstayid = x.patientunitstayid AND x2.b = x.b AND x2.labname = x.labname "
        f"AND x2.{c} IS NOT NULL ORDER BY x2.labresultrevisedoffset DESC, x2.labid DESC LIMIT 1) AS {c}" for c in cols)
    return f"""
{name}_x AS (
  SELECT *, CAST(floor(labresultrevisedoffset / {minutes}.0) * {minutes} AS BIGINT) AS b FROM labs_offset
  WHERE labname IS NOT NULL AND labresult IS NOT NULL AND lower(labname) NOT LIKE '%glucose%' AND {cond}),
{name} AS (
  SELECT DISTINCT patientunitstayid, labname, b FROM {name}_x),
{name}_r AS (
  SELECT x.patientunitstayid, x.labname,
         {aggs.replace('FROM x x2', f'FROM {name}_x x2')}
  FROM {name} x)"""


BG = latest("bg", 30, "labtypeid IS NOT DISTINCT FROM 7")
OT = latest("ot", 360, "labtypeid IS DISTINCT FROM 7")

SQL["glucose_4h"] = with_views("WITH " + GLUCOSE + f"\nSELECT {LAB_OUT} FROM ga", "labs_offset")
SQL["bucket_latest"] = with_views("WITH " + BG.strip() + "," + OT.strip() + f"""
SELECT 'blood_gas_30' AS branch, {LAB_OUT} FROM bg_r
UNION ALL SELECT 'other_360', {LAB_OUT} FROM ot_r""", "labs_offset")
SQL["reduce_labs"] = with_views("WITH " + GLUCOSE.strip() + "," + BG.strip() + "," + OT.strip() + f"""
SELECT DISTINCT {LAB_OUT} FROM (
  SELECT patientunitstayid, labname, labresult, labresultoffset, labresultrevisedoffset, labtypeid,
         labmeasurenamesystem, labmeasurenameinterface, labid FROM ga
  UNION ALL SELECT * FROM bg_r UNION ALL SELECT * FROM ot_r)""", "labs_offset")

SQL["dedup_keep_first"] = with_views("""
SELECT hadm_id, diagnosisstring, seq_num, icd_code FROM diagnoses
QUALIFY row_number() OVER (PARTITION BY hadm_id, diagnosisstring ORDER BY seq_num) = 1""", "diagnoses")
SQL["dedup_keep_last"] = with_views("""
SELECT hadm_id, diagnosisstring, seq_num, icd_code FROM diagnoses
QUALIFY row_number() OVER (PARTITION BY hadm_id, diagnosisstring ORDER BY seq_num DESC) = 1""", "diagnoses")

SQL["flag_duplicates"] = with_views("""
SELECT case_id, line_no, count(*) OVER (PARTITION BY case_id) > 1 AS is_dup FROM responses WHERE round = 1""", "responses")

SQL["head_per_group"] = with_views("""
SELECT hadm_id, microevent_id, CAST(rn AS INTEGER) AS rn FROM (
  SELECT hadm_id, microevent_id, row_number() OVER (PARTITION BY hadm_id ORDER BY charttime, microevent_id) AS rn FROM micro)
WHERE rn <= 15""", "micro")

SQL["clean_diagnoses"] = with_views("""
SELECT hadm_id, diagnosisstring, seq_num, icd9code FROM diagnoses
WHERE icd9code IS NOT NULL AND trim(icd9code) <> ''
QUALIFY row_number() OVER (PARTITION BY hadm_id, diagnosisstring ORDER BY seq_num) = 1""", "diagnoses")

SQL["clean_history"] = with_views("""
SELECT * FROM (
  SELECT patientunitstayid, ord, pasthistorypath, pasthistoryvalue, pasthistoryvaluetext FROM past_history
  QUALIFY row_number() OVER (PARTITION BY patientunitstayid, pasthistorypath, pasthistoryvalue, pasthistoryvaluetext ORDER BY ord) = 1)
WHERE pasthistoryvaluetext IS DISTINCT FROM 'Performed'""", "past_history")

SQL["clean_exam"] = with_views("""
SELECT * FROM (
  SELECT patientunitstayid, ord, physicalexampath, physicalexamvalue, CAST(length(physicalexamtext) AS INTEGER) AS text_len FROM physical_exam
  QUALIFY row_number() OVER (PARTITION BY patientunitstayid, physicalexampath, physicalexamvalue, physicalexamtext ORDER BY ord) = 1)
WHERE physicalexamvalue IS DISTINCT FROM 'Performed - Structured'""", "physical_exam")
