"""DuckDB restatement of the adapter views (shaping only), used as CTEs by the
oracle SQL.  Base tables are the driver's pre-registered views."""

from __future__ import annotations

LEAF = "CASE WHEN ({i}) * 25 < 100000 THEN lpad(CAST(({i}) * 25 AS VARCHAR), 5, '0') ELSE CAST(({i}) * 25 AS VARCHAR) END"


def leaf(expr: str) -> str:
    return f"({LEAF.format(i=expr)})"


VIEWS: dict[str, tuple[list[str], str]] = {}


def _v(name, deps, sql):
    VIEWS[name] = (deps, sql)


_v("encounters", [], f"""
SELECT o_custkey AS subject_id, o_orderkey AS hadm_id,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END AS stay_id,
       o_orderdate AS admittime,
       o_orderdate + CAST(o_orderkey % 14 + 1 AS INTEGER) * INTERVAL 1 DAY AS dischtime,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS ed_intime,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL
            ELSE o_orderdate + CAST(o_orderkey % 6 + 1 AS INTEGER) * INTERVAL 1 HOUR END AS ed_outtime,
       CASE WHEN o_orderstatus = 'P' AND o_orderkey % 10 = 0 THEN 'DIED' ELSE o_orderpriority END AS discharge_location,
       o_orderstatus AS admission_type
FROM orders""")

_v("patients", [], """
SELECT c_custkey AS subject_id,
       CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
       CAST(c_custkey % 73 + 18 AS INTEGER) AS anchor_age,
       CASE WHEN c_custkey % 41 = 0 THEN '> 89' WHEN c_custkey % 43 = 0 THEN ''
            ELSE CAST(c_custkey % 73 + 18 AS VARCHAR) END AS age,
       c_mktsegment AS race,
       (c_custkey % 50 + 1) * 137 AS unitdischargeoffset
FROM customer""")

_v("icu_patients", [], """
SELECT o_orderkey AS hadm_id, o_custkey AS subject_id,
       CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
       CASE WHEN o_custkey % 41 = 0 THEN '> 89' WHEN o_custkey % 43 = 0 THEN ''
            ELSE CAST(o_custkey % 73 + 18 AS VARCHAR) END AS age,
       (o_orderkey % 50 + 1) * 137 AS unitdischargeoffset
FROM orders""")

_v("diagnoses", [], f"""
SELECT l_orderkey AS hadm_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS seq_num,
       {leaf('CASE WHEN l_suppkey % 10 = 0 THEN l_partkey ELSE l_partkey % 40 END')} AS icd_code,
       CASE WHEN l_linestatus = 'F' THEN 9 ELSE 10 END AS icd_version,
       CASE l_returnflag WHEN 'A' THEN 'Primary' WHEN 'N' THEN 'Major' WHEN 'R' THEN 'Other' END AS priority,
       CASE WHEN l_partkey % 17 = 0 THEN NULL WHEN l_partkey % 19 = 0 THEN ''
            ELSE {leaf('CASE WHEN l_suppkey % 10 = 0 THEN l_partkey ELSE l_partkey % 40 END')} || ', X' || {leaf('CASE WHEN l_suppkey % 10 = 0 THEN l_partkey ELSE l_partkey % 40 END')} END AS icd9code,
       CASE WHEN l_partkey % 23 = 0 THEN 'condition ' || CAST(l_partkey % 30 AS VARCHAR)
            ELSE ['cardiovascular', 'pulmonary', 'renal', 'neurologic', 'infectious'][l_partkey % 5 + 1]
                 || '|condition ' || CAST(l_partkey % 30 AS VARCHAR) END AS diagnosisstring
FROM lineitem""")

_v("code_dict", [], f"""
SELECT {leaf('p_partkey')} AS icd_code, v.icd_version,
       CASE WHEN v.icd_version = 10 THEN p_name || ' (v10)' ELSE p_name END AS long_title
FROM part, (VALUES (9), (10)) v(icd_version)""")

_v("crosswalk", [], f"""
SELECT {leaf('p_partkey')} AS icd10, {leaf('p_partkey - p_partkey % 40 + (p_partkey * 7) % 40')} AS icd9
FROM part WHERE p_partkey % 13 <> 0""")

_v("taxonomy", [], f"""
SELECT leaf, mid, top_lo || '-' || top_hi AS top, top_lo, top_hi FROM (
  SELECT leaf, mid, lpad(CAST(CAST(mid AS INTEGER) // 3 * 3 AS VARCHAR), 3, '0') AS top_lo,
         lpad(CAST(least(CAST(mid AS INTEGER) // 3 * 3 + 2, 999) AS VARCHAR), 3, '0') AS top_hi
  FROM (SELECT {leaf('p_partkey')} AS leaf, substr({leaf('p_partkey')}, 1, 3) AS mid FROM part))""")

_v("vocab", ["taxonomy"], "SELECT leaf AS code FROM taxonomy")

_v("code_names", ["code_dict"], "SELECT icd_code AS code, long_title AS name FROM code_dict WHERE icd_version = 9")

_v("labs_offset", [], """
SELECT user_id AS patientunitstayid, event_id AS labid,
       CASE WHEN event_type = 'error' THEN 'bedside glucose' ELSE event_type END AS labname,
       CASE WHEN event_id % 23 <> 0 THEN value END AS labresult,
       CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 00:00:00')) / 60000000) AS BIGINT) AS labresultoffset,
       CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 00:00:00')) / 60000000) AS BIGINT) + event_id % 45 AS labresultrevisedoffset,
       CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 7 ELSE 1 END AS labtypeid,
       CASE WHEN event_id % 6 <> 0 THEN 'unit_' || CAST(event_id % 4 AS VARCHAR) END AS labmeasurenamesystem,
       CASE WHEN event_id % 10 <> 0 THEN 'iface_' || CAST(event_id % 3 AS VARCHAR) END AS labmeasurenameinterface
FROM events""")

_v("labs_text", ["encounters"], """
SELECT e.event_id AS labevent_id, n.subject_id, ((e.event_id // 20) * 30 + (e.event_id // 20) % 30) AS hadm_id, CAST(e.event_id % 12 AS INTEGER) AS itemid,
       n.admittime + CAST(e.event_id % 20 AS INTEGER) * INTERVAL 1 DAY AS charttime,
       CASE e.event_id % 29 WHEN 0 THEN '<0.1' WHEN 1 THEN '___' WHEN 2 THEN ' 12 ' WHEN 3 THEN '1d' WHEN 4 THEN '1_0'
            ELSE CASE WHEN e.event_id % 37 = 0 THEN 'Delete' WHEN e.event_id % 23 = 0 THEN NULL
                      ELSE printf('%.2f', e.value) END END AS value,
       CASE WHEN e.event_id % 6 <> 0 THEN 'mg/dL' END AS valueuom,
       CAST(e.event_id % 7 AS DOUBLE) AS ref_range_lower,
       CAST(e.event_id % 7 + 50 AS DOUBLE) AS ref_range_upper,
       CASE WHEN e.event_id % 31 = 0 THEN 'CANCELLED by lab' WHEN e.event_id % 47 = 0 THEN 'see note ___' END AS comments
FROM events e JOIN encounters n ON n.hadm_id = ((e.event_id // 20) * 30 + (e.event_id // 20) % 30)""")

_v("lab_items", [], """
SELECT itemid,
       CASE WHEN itemid = 11 THEN 'Beta-2 Microglobulin' ELSE 'Lab ' || CAST(itemid AS VARCHAR) END AS label,
       CASE WHEN itemid % 2 = 0 THEN 'Blood' ELSE 'Urine' END AS fluid,
       CASE WHEN itemid % 3 = 0 THEN 'Hematology' ELSE 'Chemistry' END AS category
FROM (SELECT DISTINCT CAST(event_id % 12 AS INTEGER) AS itemid FROM events)""")

_v("notes", [], """
SELECT doc_id AS note_id, ((doc_id // 2) * 30 + (doc_id // 2) % 30) AS hadm_id,
       concat_ws(chr(10),
         CASE WHEN doc_id % 7 <> 1 THEN 'History of Present Illness:' || chr(10) || text END,
         'Past Medical History:' || chr(10) || 'language ' || lang || ', source ' || source,
         'Social History:' || chr(10) || 'lives alone',
         CASE WHEN doc_id % 7 <> 2 THEN 'Physical Exam:' || chr(10) || 'General: ' || CAST(n_chars AS VARCHAR) || ' characters'
              || CASE WHEN doc_id % 4 = 0 THEN chr(10) || 'Discharge exam: stable' ELSE '' END END,
         'Pertinent Results:' || chr(10) || 'see labs',
         'Discharge Diagnosis:' || chr(10) || source,
         'Discharge Condition:' || chr(10) || 'stable') AS text
FROM documents""")

_v("reports", [], """
SELECT doc_id AS report_id, ((doc_id // 3) * 30 + (doc_id // 3) % 30) AS hadm_id,
       'EXAMINATION: CHEST' || chr(10) || 'FINDINGS: ' || text || chr(10) || 'IMPRESSION: ' || source
       || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'FINDINGS: addendum' || chr(10) || 'IMPRESSION: final' ELSE '' END AS text
FROM documents""")

_v("case_labels", ["diagnoses"], """
SELECT hadm_id AS case_id,
       list(icd_code ORDER BY seq_num) AS labels,
       max(CASE WHEN seq_num = 1 THEN icd_code END) AS top1,
       coalesce(list(icd_code ORDER BY seq_num) FILTER (WHERE priority = 'Primary'), []) AS "primary",
       coalesce(list(icd_code ORDER BY seq_num) FILTER (WHERE priority = 'Major'), []) AS major
FROM diagnoses WHERE seq_num <= 3 GROUP BY hadm_id""")

_STEP = "(CASE r.round WHEN 1 THEN 3 WHEN 2 THEN 7 ELSE 9 END)"
for _name, _length in (("case_preds", 10), ("case_preds20", 20)):
    _v(_name, ["case_labels"], f"""
SELECT case_id, round, model, think, temperature, ranked,
       (CASE WHEN case_id % 9 = 0 THEN ranked[2:CAST(case_id % 4 AS INTEGER) + 1]
             ELSE ranked[1:CAST(case_id % 4 AS INTEGER)] END)
       || (CASE WHEN case_id % 11 = 0 THEN ['X999'] ELSE []::VARCHAR[] END) AS final
FROM (
  SELECT case_id, r.round,
         CASE WHEN r.round = 3 THEN 'model_b' ELSE 'model_a' END AS model,
         r.round = 2 AS think,
         CASE WHEN r.round = 1 THEN 0.0 ELSE 0.7 END::DOUBLE AS temperature,
         [{leaf(f"CASE WHEN i0 < 40 THEN (i0 + j * {_STEP}) % 40 ELSE i0 + j * {_STEP} END")} FOR j IN range({_length})] AS ranked
  FROM (SELECT case_id, CAST(CAST(top1 AS INTEGER) // 25 AS BIGINT) + case_id % 5 AS i0 FROM case_labels), (VALUES (1), (2), (3)) r(round))""")

_ITEMS = "'[' || array_to_string(list_transform({a}, lambda x: '\"' || x || '\"'), ', ') || ']'"
_ITEMS_D = "'[' || array_to_string(list_transform({a}, lambda x: '\"' || x || ':dx\"'), ', ') || ']'"
_ITEMS_E = "'[' || array_to_string(list_transform({a}, lambda x: 'E' || x), ', ') || ']'"


def _items(a, kind=_ITEMS):
    return kind.format(a=a)


_OBJ = "'{\"top10\": ' || " + _items("ranked") + " || ', \"predictions\": ' || " + _items("final") + " || '}'"

_v("responses", ["case_preds"], f"""
SELECT case_id, round, model, think, temperature, case_id * 2 + dup AS line_no, response,
       CAST(length(response) + 400 + case_id % 300 AS BIGINT) AS estimate_tokens,
       CAST(case_id % 300 + 500 AS BIGINT) AS prompt_tokens,
       CAST(trunc(length(response) / 4) AS BIGINT) AS completion_tokens,
       CASE WHEN think THEN CAST(case_id % 50 + 100 AS BIGINT) END AS reasoning_tokens
FROM (
  SELECT case_id, round, model, think, temperature, 0 AS dup,
         CASE WHEN case_id % 3 = 0 THEN '<think>case ' || CAST(case_id AS VARCHAR) || ' reasoning</think>' || chr(10) ELSE '' END ||
         CASE case_id % 8
           WHEN 0 THEN 'Assessment follows.' || chr(10) || '```json' || chr(10) || {_OBJ} || chr(10) || '```' || chr(10) || 'Done.'
           WHEN 1 THEN 'Answer: ' || {_OBJ}
           WHEN 2 THEN 'Draft: {{"top10": [], "predictions": []}}' || chr(10) || 'Final: ' || {_OBJ}
           WHEN 3 THEN '**top10**: ' || {_items('ranked', _ITEMS_D)} || chr(10) || '**predictions**: ' || {_items('final', _ITEMS_D)}
           WHEN 4 THEN '{{"top10": ' || {_items('ranked')} || ', // ranked list' || chr(10) || '"predictions": ' || {_items('final')} || '}}'
           WHEN 5 THEN '{{"top10": ' || {_items('ranked')} || ', "predictions": ' || {_items('final')} || ',}}'
           WHEN 6 THEN '{{"top10": ' || {_items('ranked', _ITEMS_E)} || ', "predictions": ' || {_items('final', _ITEMS_E)} || '}}'
           ELSE 'I cannot determine the diagnosis from the information given.' END AS response
  FROM case_preds
  UNION ALL
  SELECT case_id, round, model, think, temperature, 1 AS dup,
         'Revised.' || chr(10) || '```json' || chr(10) || '{{"top10": ' || {_items('list_reverse(ranked)')}
         || ', "predictions": ' || {_items('final')} || '}}' || chr(10) || '```' AS response
  FROM case_preds WHERE case_id % 50 = 0)""")


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs for ``names`` and their dependencies."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


_v("past_history", [], """
SELECT conv_id AS patientunitstayid, turn AS ord,
       'notes/Progress Notes/Past History/Organ Systems/' || role || '/item ' || CAST(turn % 3 AS VARCHAR) AS pasthistorypath,
       CASE WHEN turn % 4 = 0 THEN 'Performed' ELSE role END AS pasthistoryvalue,
       CASE WHEN turn % 4 = 0 THEN 'Performed' WHEN turn % 5 = 0 THEN NULL ELSE role END AS pasthistoryvaluetext
FROM conversations""")

_v("physical_exam", [], """
SELECT conv_id AS patientunitstayid, turn AS ord,
       'notes/Progress Notes/Physical Exam/Physical Exam/' || role || '/finding ' || CAST(turn % 3 AS VARCHAR) AS physicalexampath,
       CASE WHEN turn % 3 = 0 THEN 'Performed - Structured' ELSE role END AS physicalexamvalue,
       text AS physicalexamtext
FROM conversations""")

_v("micro", ["encounters"], """
SELECT e.event_id AS microevent_id, n.subject_id, ((e.event_id // 20) * 30 + (e.event_id // 20) % 30) AS hadm_id,
       n.admittime + CAST(e.event_id % 20 AS INTEGER) * INTERVAL 1 DAY + CAST(e.event_id % 24 AS INTEGER) * INTERVAL 1 HOUR AS charttime,
       'test ' || CAST(e.event_id % 6 AS VARCHAR) AS test_name,
       CASE WHEN e.event_id % 13 = 0 THEN 'CANCELLED culture' WHEN e.event_id % 4 = 0 THEN NULL
            ELSE 'ORG ' || CAST(e.event_id % 5 AS VARCHAR) END AS org_name,
       CASE WHEN e.event_id % 7 <> 0 THEN e.event_id % 9 END AS ab_itemid,
       CASE WHEN e.event_id % 7 <> 0 THEN 'AB ' || CAST(e.event_id % 9 AS VARCHAR) END AS ab_name,
       CASE WHEN e.event_id % 3 = 0 THEN 'BLOOD CULTURE' WHEN e.event_id % 3 = 1 THEN 'URINE' END AS spec_type_desc,
       CASE WHEN e.event_id % 10 <> 0 THEN ['S', 'I', 'R', 'P'][e.event_id % 4 + 1] END AS interpretation,
       CASE WHEN e.event_id % 19 = 0 THEN '___ pending' WHEN e.event_id % 17 = 0 THEN 'Note' END AS comments
FROM events e JOIN encounters n ON n.hadm_id = ((e.event_id // 20) * 30 + (e.event_id // 20) % 30)""")


_v("transfers", [], """
SELECT l_orderkey AS hadm_id, l_linenumber AS transfer_seq, l_shipdate AS intime,
       l_shipdate + l_linenumber * INTERVAL 1 HOUR AS outtime,
       CASE WHEN l_linestatus = 'F' THEN 'ICU' ELSE 'WARD' END AS careunit
FROM lineitem""")

_v("triage", [], """
SELECT l_orderkey AS stay_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS ord, 36.0 + l_discount * 10 AS temperature, 60.0 + l_quantity AS heartrate,
       CAST(12 + l_linenumber AS DOUBLE) AS resprate, 90.0 + l_tax * 100 AS o2sat,
       CAST(100 + l_partkey % 60 AS DOUBLE) AS sbp, CAST(60 + l_suppkey % 30 AS DOUBLE) AS dbp,
       CAST(l_linenumber % 5 + 1 AS INTEGER) AS acuity,
       CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(l_partkey % 11 AS VARCHAR) END AS pain,
       l_returnflag || '-' || l_linestatus AS chiefcomplaint
FROM lineitem WHERE l_orderkey % 5 <> 0""")

_v("images", [], """
SELECT page_id AS dicom_id, page_id % 37 AS subject_id, CASE WHEN page_id % 9 <> 0 THEN page_id % 50 END AS study_id,
       CASE WHEN page_id % 2 = 0 THEN 'train' ELSE 'test' END AS split
FROM pages""")

_v("image_meta", [], """
SELECT page_id AS dicom_id, page_id % 37 AS subject_id, CASE WHEN page_id % 9 <> 0 THEN page_id % 50 END AS study_id,
       CAST(20240101 + page_id % 28 AS BIGINT) AS "StudyDate",
       CAST((page_id % 24) * 10000 + (page_id % 60) * 100 + (page_id % 59) AS DOUBLE) + 0.25 AS "StudyTime"
FROM pages WHERE page_id % 4 <> 0""")
