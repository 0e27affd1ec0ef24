"""Oracle SQL for reports."""

from oracles.metrics_sql import BASE, V
from oracles.views import with_views

SQL: dict[str, str] = {}


def r6(e):
    return f"round(CAST({e} AS DOUBLE), 6)"


CLEAN = """
cdx AS (SELECT * FROM diagnoses WHERE icd9code IS NOT NULL AND trim(icd9code) <> ''
        QUALIFY row_number() OVER (PARTITION BY hadm_id, diagnosisstring ORDER BY seq_num) = 1)"""

SPLIT = """
trim(coalesce(string_split(coalesce({c}, ''), ', ')[1], '')) AS v9,
trim(coalesce(string_split(coalesce({c}, ''), ', ')[2], '')) AS v10"""

SQL["split_dual_code"] = with_views(f"SELECT hadm_id, seq_num, {SPLIT.format(c='icd9code')} FROM diagnoses", "diagnoses")

SQL["disease_system"] = with_views("WITH " + CLEAN + f""",
s AS (SELECT CASE WHEN position('|' IN diagnosisstring) > 0 THEN trim(split_part(diagnosisstring, '|', 1)) ELSE 'unclassified' END AS system
      FROM cdx WHERE diagnosisstring IS NOT NULL)
SELECT system, count(*) AS n, {r6('count(*) * 100.0 / (SELECT count(*) FROM s)')} AS pct FROM s GROUP BY system""", "diagnoses")

SQL["distribution_pct"] = with_views("WITH " + CLEAN + f""",
sp AS (SELECT diagnosisstring, {SPLIT.format(c='icd9code')} FROM cdx),
u AS (SELECT 'name' AS kind, diagnosisstring AS value FROM sp WHERE diagnosisstring IS NOT NULL
      UNION ALL SELECT 'v9', v9 FROM sp WHERE v9 <> ''
      UNION ALL SELECT 'v10', v10 FROM sp WHERE v10 <> ''
      UNION ALL SELECT 'top1', top1 FROM case_labels WHERE top1 IS NOT NULL
      UNION ALL SELECT 'labels', icd_code FROM diagnoses WHERE seq_num <= 3)
SELECT kind, value, count(*) AS n, {r6('count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY kind)')} AS pct
FROM u GROUP BY kind, value""", "diagnoses", "case_labels")

SQL["multi_mapping"] = with_views("WITH " + CLEAN + f""",
p AS (SELECT DISTINCT diagnosisstring AS a, v9 AS b FROM (SELECT diagnosisstring, {SPLIT.format(c='icd9code')} FROM cdx)
      WHERE v9 <> '' AND diagnosisstring IS NOT NULL)
SELECT 'name_to_codes' AS side, a AS value, count(*) OVER (PARTITION BY a) AS n_other, b AS other FROM p QUALIFY n_other > 1
UNION ALL
SELECT 'code_to_names', b, count(*) OVER (PARTITION BY b) AS n_other, a FROM p QUALIFY n_other > 1""", "diagnoses")

SQL["disease_summary"] = with_views("WITH " + CLEAN + f""",
sp AS (SELECT hadm_id, diagnosisstring, {SPLIT.format(c='icd9code')},
              CASE WHEN position('|' IN diagnosisstring) > 0 THEN trim(split_part(diagnosisstring, '|', 1)) ELSE 'unclassified' END AS system
       FROM cdx),
per AS (SELECT hadm_id, count(*) AS c FROM sp GROUP BY hadm_id)
SELECT count(*) AS total_diagnosis_records, count(DISTINCT hadm_id) AS total_patients,
       count(DISTINCT diagnosisstring) AS unique_diagnosis_strings,
       count(DISTINCT v9) FILTER (WHERE v9 <> '') AS unique_icd9_codes,
       count(DISTINCT v10) FILTER (WHERE v10 <> '') AS unique_icd10_codes,
       count(DISTINCT system) FILTER (WHERE diagnosisstring IS NOT NULL) AS disease_systems,
       (SELECT min(c) FROM per) AS min_per_patient, (SELECT max(c) FROM per) AS max_per_patient,
       {r6('(SELECT avg(c) FROM per)')} AS mean_per_patient, {r6('(SELECT median(c) FROM per)')} AS median_per_patient
FROM sp""", "diagnoses")

LAB_REDUCED = """
g AS (SELECT patientunitstayid, CAST(floor(labresultrevisedoffset / 240.0) AS BIGINT) AS b, labname
      FROM labs_offset WHERE labname IS NOT NULL AND labresult IS NOT NULL AND lower(labname) LIKE '%glucose%'),
o AS (SELECT patientunitstayid, CASE WHEN labtypeid IS NOT DISTINCT FROM 7 THEN 'bg' ELSE 'ot' END AS br,
             CAST(floor(labresultrevisedoffset / (CASE WHEN labtypeid IS NOT DISTINCT FROM 7 THEN 30.0 ELSE 360.0 END)) AS BIGINT) AS b,
             labname
      FROM labs_offset WHERE labname IS NOT NULL AND labresult IS NOT NULL AND lower(labname) NOT LIKE '%glucose%'),
after AS (SELECT patientunitstayid, count(*) AS n FROM (SELECT DISTINCT * FROM g UNION ALL SELECT DISTINCT patientunitstayid, b, labname || br FROM o)
          GROUP BY patientunitstayid),
before AS (SELECT patientunitstayid, count(*) AS n FROM labs_offset GROUP BY patientunitstayid),
lc AS (SELECT coalesce(b.patientunitstayid, a.patientunitstayid) AS patientunitstayid, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after
       FROM before b FULL JOIN after a ON a.patientunitstayid = b.patientunitstayid)"""

DX_COUNTS = """
db AS (SELECT hadm_id, count(*) AS n FROM diagnoses GROUP BY hadm_id),
da AS (SELECT hadm_id, count(*) AS n FROM (SELECT DISTINCT hadm_id, diagnosisstring FROM diagnoses
                                          WHERE icd9code IS NOT NULL AND trim(icd9code) <> '') GROUP BY hadm_id),
dc AS (SELECT p.hadm_id, coalesce(db.n, 0) AS before, coalesce(da.n, 0) AS after
       FROM icu_patients p LEFT JOIN db ON db.hadm_id = p.hadm_id LEFT JOIN da ON da.hadm_id = p.hadm_id)"""

HISTORY_COUNTS = """
hb AS (SELECT patientunitstayid AS id, count(*) AS n FROM past_history GROUP BY 1),
ha AS (SELECT id, count(*) AS n FROM (SELECT DISTINCT patientunitstayid AS id, pasthistorypath, pasthistoryvalue, pasthistoryvaluetext FROM past_history
                                     WHERE pasthistoryvaluetext IS DISTINCT FROM 'Performed') GROUP BY id),
hc AS (SELECT hb.id, hb.n AS before, coalesce(ha.n, 0) AS after FROM hb LEFT JOIN ha ON ha.id = hb.id),
eb AS (SELECT patientunitstayid AS id, count(*) AS n FROM physical_exam GROUP BY 1),
ea AS (SELECT id, count(*) AS n FROM (SELECT DISTINCT patientunitstayid AS id, physicalexampath, physicalexamvalue, physicalexamtext FROM physical_exam
                                     WHERE physicalexamvalue IS DISTINCT FROM 'Performed - Structured') GROUP BY id),
ec AS (SELECT eb.id, eb.n AS before, coalesce(ea.n, 0) AS after FROM eb LEFT JOIN ea ON ea.id = eb.id)"""


def _stats(kind, src):
    sides = []
    for side in ("before", "after"):
        sides.append(f"""SELECT '{kind}' AS kind, '{side}' AS side, CAST(min({side}) AS BIGINT) AS min, CAST(max({side}) AS BIGINT) AS max,
       {r6(f'avg({side})')} AS mean, {r6(f'median({side})')} AS median, {r6(f'stddev_pop({side})')} AS std,
       CAST(sum({side}) AS BIGINT) AS total, count(*) AS n_entities, CAST(sum(before) - sum(after) AS BIGINT) AS reduced,
       {r6('CASE WHEN sum(before) > 0 THEN (sum(before) - sum(after)) * 100.0 / sum(before) ELSE 0 END')} AS reduced_pct FROM {src}""")
    return " UNION ALL ".join(sides)


_COUNTS = "WITH " + LAB_REDUCED.strip() + "," + DX_COUNTS + "," + HISTORY_COUNTS + "\n"
_COUNT_VIEWS = ("labs_offset", "diagnoses", "icu_patients", "past_history", "physical_exam")
SQL["before_after_stats"] = with_views(_COUNTS + " UNION ALL ".join([
    _stats("diagnosis", "dc"), _stats("pasthistory", "hc"), _stats("physicalexam", "ec"), _stats("lab", "lc")]), *_COUNT_VIEWS)


def _hist(kind, src, bins):
    rows = []
    for side in ("before", "after"):
        for i, (label, lo, hi) in enumerate(bins):
            cond = f"{side} >= {lo}" + (f" AND {side} <= {hi}" if hi is not None else "")
            rows.append(f"SELECT '{kind}' AS kind, '{side}' AS side, {i} AS ord, '{label}' AS bin, "
                        f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT) AS n FROM {src}")
    return " UNION ALL ".join(rows)


_BINS_DX = [("0", 0, 0), ("1-10", 1, 10), ("11-20", 11, 20), ("21-50", 21, 50), ("50+", 51, None)]
_BINS_LAB = [("0", 0, 0), ("1-50", 1, 50), ("51-100", 51, 100), ("101-200", 101, 200), ("201-500", 201, 500), ("500+", 501, None)]

_BINS_HISTORY = [("0", 0, 0), ("1-5", 1, 5), ("6-10", 6, 10), ("11-20", 11, 20), ("20+", 21, None)]
SQL["count_histogram"] = with_views(_COUNTS + " UNION ALL ".join([
    _hist("diagnosis", "dc", _BINS_DX), _hist("pasthistory", "hc", _BINS_HISTORY), _hist("physicalexam", "ec", _BINS_DX),
    _hist("lab", "lc", _BINS_LAB)]), *_COUNT_VIEWS)

SQL["in_range_entities"] = with_views("""
WITH m AS (
  SELECT mi.hadm_id, mi.test_name, mi.microevent_id, mi.charttime, mi.ab_itemid,
         lower(coalesce(mi.org_name, '')) AS org, lower(coalesce(mi.comments, '')) AS com
  FROM micro mi JOIN encounters e ON e.hadm_id = mi.hadm_id WHERE mi.charttime BETWEEN e.admittime AND e.dischtime),
k AS (SELECT * FROM m WHERE org NOT LIKE '%cancel%' AND com NOT LIKE '%cancel%' AND com NOT LIKE '%\\_\\_\\_%' ESCAPE '\\'),
r AS (SELECT *, bool_or(ab_itemid IS NULL) OVER (PARTITION BY hadm_id, test_name) AS any_null,
             row_number() OVER (PARTITION BY hadm_id, test_name ORDER BY charttime, microevent_id) AS rn FROM k),
after AS (SELECT hadm_id, count(*) AS n FROM r WHERE NOT any_null OR rn = 1 GROUP BY hadm_id)
SELECT hadm_id, n FROM after WHERE n BETWEEN 11 AND 20""", "micro", "encounters")

SQL["describe_numeric"] = with_views(f"""
WITH u AS (SELECT 'estimate_tokens' AS col, CAST(estimate_tokens AS DOUBLE) AS v FROM responses
           UNION ALL SELECT 'prompt_tokens', prompt_tokens FROM responses
           UNION ALL SELECT 'completion_tokens', completion_tokens FROM responses
           UNION ALL SELECT 'reasoning_tokens', reasoning_tokens FROM responses)
SELECT col, count(v) AS count, {r6('avg(v)')} AS mean, {r6('stddev_samp(v)')} AS std, {r6('min(v)')} AS min,
       {r6('quantile_cont(v, 0.25)')} AS q25, {r6('quantile_cont(v, 0.5)')} AS q50, {r6('quantile_cont(v, 0.75)')} AS q75,
       {r6('max(v)')} AS max
FROM u GROUP BY col""", "responses")

SQL["length_distribution"] = with_views("""
SELECT CAST(n AS INTEGER) AS len, count(*) AS n FROM (SELECT hadm_id, count(*) AS n FROM diagnoses WHERE seq_num <= 3 GROUP BY hadm_id)
GROUP BY 1""", "diagnoses")

SQL["missing_top1_codes"] = with_views("""
SELECT DISTINCT d.icd_code AS code FROM diagnoses d
WHERE d.seq_num <= 3 AND d.priority = 'Major'
  AND d.icd_code NOT IN (SELECT top1 FROM case_labels WHERE len(major) > 0)""", "diagnoses", "case_labels")

SQL["token_cost"] = with_views(f"""
WITH p(model, input_price_m, output_price_m) AS (VALUES ('model_a', 0.5, 4.0), ('model_b', 0.2, 1.5)),
t AS (SELECT model, sum(prompt_tokens) / 1e6 AS in_m, sum(completion_tokens + coalesce(reasoning_tokens, 0)) / 1e6 AS out_m
      FROM responses GROUP BY model)
SELECT t.model, {r6('in_m')} AS in_m, {r6('out_m')} AS out_m, {r6('in_m * input_price_m')} AS in_cost,
       {r6('out_m * output_price_m')} AS out_cost, {r6('in_m * input_price_m + out_m * output_price_m')} AS cost
FROM t JOIN p ON p.model = t.model""", "responses")

BYCODE = """
lo AS (SELECT case_id, unnest(labels) AS code, pred FROM j1),
po AS (SELECT case_id, unnest(pred) AS code, labels FROM j1),
bc AS (SELECT code, sum(CASE WHEN kind = 'l' THEN 1 ELSE 0 END) AS nl, sum(CASE WHEN kind = 'p' THEN 1 ELSE 0 END) AS np,
              sum(CASE WHEN kind = 'l' AND bad THEN 1 ELSE 0 END) AS missed, sum(CASE WHEN kind = 'p' AND bad THEN 1 ELSE 0 END) AS over
       FROM (SELECT code, 'l' AS kind, NOT list_contains(pred, code) AS bad FROM lo
             UNION ALL SELECT code, 'p', NOT list_contains(labels, code) FROM po) GROUP BY code)"""

SQL["top_missed"] = with_views("WITH " + BASE + "," + BYCODE + f"""
SELECT code, CAST(missed AS BIGINT) AS n, {r6('CASE WHEN nl > 0 THEN missed / nl ELSE 0 END')} AS rate
FROM bc ORDER BY missed DESC, code LIMIT 20""", *V)

SQL["top_over"] = with_views("WITH " + BASE + "," + BYCODE + f"""
SELECT code, CAST(over AS BIGINT) AS n, {r6('CASE WHEN np > 0 THEN over / np ELSE 0 END')} AS rate
FROM bc ORDER BY over DESC, code LIMIT 20""", *V)

SQL["limit_cases"] = with_views("""
SELECT case_id, array_to_string(labels, ',') AS labels FROM case_labels ORDER BY case_id LIMIT 100""", "case_labels", "diagnoses")

SQL["miss_over_faults"] = with_views("WITH " + BASE + "," + BYCODE + f"""
SELECT code, CAST(CASE WHEN missed > 0 THEN nl ELSE 0 END AS BIGINT) AS total_in_labels, CAST(missed AS BIGINT) AS missed_count,
       {r6('CASE WHEN nl > 0 THEN missed / nl ELSE 0 END')} AS miss_rate, CAST(over AS BIGINT) AS over_count,
       {r6('CASE WHEN np > 0 THEN over / np ELSE 0 END')} AS over_rate,
       CAST(CASE WHEN missed = 0 THEN np END AS BIGINT) AS total_in_predictions
FROM bc WHERE missed > 0 OR over > 0""", *V)
