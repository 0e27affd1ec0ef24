"""Oracle SQL for response extraction.  DuckDB's JSON reader accepts trailing
commas and NaN, so strict validity adds explicit checks for both."""

from oracles.views import with_views

SQL: dict[str, str] = {}


def valid(x):
    return (f"(coalesce(json_valid({x}), false) AND NOT regexp_matches({x}, ',\\s*[\\]}}]') "
            f"AND NOT regexp_matches({x}, '(^|[^A-Za-z])(NaN|Infinity)'))")


def strip(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def repair(x):
    x = f"regexp_replace({x}, '//[^\\n]*', '', 'g')"
    x = f"regexp_replace({x}, '(\\s*)([A-Z]\\d{{1,3}}\\.?\\d*)(,|\\s*[\\]\\}}])', '\\1\"\\2\"\\3', 'g')"
    x = f"regexp_replace({x}, ',(\\s*[\\]\\}}])', '\\1', 'g')"
    x = f"regexp_replace({x}, '\\s+', ' ', 'g')"
    return f"regexp_replace({x}, '\\s*([,\\[\\]{{}}:])\\s*', '\\1', 'g')"


FENCED = "regexp_extract_all(response, '(?s)```json\\n(.*?)\\n```', 1)"
NG = "regexp_extract_all(response, '(?s)\\{.*?\\}')"
MD_TOP = "'(?s)\\*\\*top10\\*\\*:\\s*\\[(.*?)\\]'"
MD_PRED = "'(?s)\\*\\*predictions\\*\\*:\\s*\\[(.*?)\\]'"

ONE = f"""
r AS (SELECT *, {FENCED} AS fenced, {NG} AS braces FROM responses),
c AS (SELECT *, CASE WHEN len(fenced) > 0 THEN fenced WHEN len(braces) > 0 THEN braces END AS cand,
             CASE WHEN len(fenced) > 0 THEN 'fenced' WHEN len(braces) > 0 THEN 'braces' END AS m0 FROM r),
p AS (SELECT *, CASE WHEN len(cand) = 1 AND {valid('cand[1]')} THEN cand[1] END AS js,
             regexp_extract_all(regexp_extract(response, {MD_TOP}, 1), '"([^"]+)"', 1) AS mdr,
             regexp_extract_all(regexp_extract(response, {MD_PRED}, 1), '"([^"]+)"', 1) AS mdp,
             regexp_matches(response, {MD_TOP}) AND regexp_matches(response, {MD_PRED}) AS md_ok FROM c),
q AS (SELECT *, cand IS NULL AND md_ok AND len(mdr) > 0 AND len(mdp) > 0 AS use_md FROM p),
s AS (SELECT *, CASE WHEN use_md THEN mdr ELSE json_extract_string(js, '$.top10[*]') END AS rr,
             CASE WHEN use_md THEN mdp ELSE json_extract_string(js, '$.predictions[*]') END AS ff,
             CASE WHEN use_md THEN 'markdown' ELSE m0 END AS method FROM q),
ex AS (SELECT case_id, round, line_no, method,
              CASE WHEN coalesce(len(rr), 0) > 0 AND coalesce(len(ff), 0) > 0 THEN 'valid' ELSE 'invalid' END AS status,
              list_transform(rr, lambda x: split_part(x, ':', 1)) AS ranked,
              list_transform(ff, lambda x: split_part(x, ':', 1)) AS final FROM s)"""

GREEDY = "regexp_extract(response, '(?s)\\{.*\\}')"
_INNER = r'[^{}"]|"(?:[^"\\]|\\.)*"'
_OBJECT = r"\{(?:" + _INNER + r")*\}"
for _ in range(11):
    _OBJECT = r"\{(?:" + _INNER + "|" + _OBJECT + r")*\}"
BAL = ("regexp_extract(CASE WHEN strpos(response, '{') > 0 THEN substr(response, strpos(response, '{')) END, "
       "'(?s)^" + _OBJECT + "')")

LAST = f"""
r AS (SELECT *, {FENCED} AS fenced, {strip('response')} AS stripped,
             list_filter(list_transform(string_split(response, chr(10)), lambda l: {strip('l')}),
                         lambda l: starts_with(l, '{{') AND ends_with(l, '}}') AND {valid('l')}) AS lines,
             {GREEDY} AS greedy, {BAL} AS bal, {NG} AS ng FROM responses),
r2 AS (SELECT *, CASE WHEN {valid(repair('greedy'))} THEN {repair('greedy')} WHEN {valid('greedy')} THEN greedy END AS gp,
              CASE WHEN {valid(repair('bal'))} THEN {repair('bal')} WHEN {valid('bal')} THEN bal END AS bp FROM r),
r3 AS (SELECT *,
         CASE WHEN len(fenced) > 0 THEN fenced[-1] WHEN {valid('stripped')} THEN stripped WHEN len(lines) > 0 THEN lines[-1]
              WHEN greedy <> '' AND gp IS NOT NULL THEN gp WHEN coalesce(bal, '') <> '' AND bp IS NOT NULL THEN bp
              WHEN len(ng) > 0 THEN ng[-1] END AS js0,
         CASE WHEN len(fenced) > 0 THEN 'fenced' WHEN {valid('stripped')} THEN 'whole' WHEN len(lines) > 0 THEN 'line'
              WHEN greedy <> '' AND gp IS NOT NULL THEN 'greedy' WHEN coalesce(bal, '') <> '' AND bp IS NOT NULL THEN 'balanced'
              WHEN len(ng) > 0 THEN 'braces' END AS method FROM r2),
r4 AS (SELECT *, CASE WHEN {valid('js0')} THEN js0 WHEN {valid(repair('js0'))} THEN {repair('js0')} END AS js FROM r3),
r5 AS (SELECT *, json_extract_string(js, '$.top10[*]') AS rr, json_extract_string(js, '$.predictions[*]') AS ff FROM r4),
ex AS (SELECT case_id, round, line_no, method,
              CASE WHEN coalesce(len(rr), 0) > 0 AND coalesce(len(ff), 0) > 0 THEN 'valid' ELSE 'invalid' END AS status,
              list_transform(rr, lambda x: {strip("split_part(x, ':', 1)")}) AS ranked,
              list_transform(ff, lambda x: {strip("split_part(x, ':', 1)")}) AS final FROM r5)"""

FLAT = """
SELECT case_id, round, line_no, status, method,
       CASE WHEN status = 'valid' THEN array_to_string(ranked, ',') ELSE '' END AS ranked,
       CASE WHEN status = 'valid' THEN array_to_string(final, ',') ELSE '' END AS final FROM ex"""

SQL["extract_responses"] = with_views("WITH " + ONE + FLAT, "responses")
SQL["extract_responses_last"] = with_views("WITH " + LAST + FLAT, "responses")

SQL["split_reasoning"] = with_views(f"""
SELECT case_id, round, line_no,
       CASE WHEN strpos(response, '<think>') > 0 THEN inner_text ELSE 'No reasoning found' END AS reasoning,
       CASE WHEN strpos(response, '<think>') > 0 THEN {strip("replace(response, '<think>' || inner_text || '</think>', '')")}
            ELSE response END AS answer
FROM (SELECT *, split_part(split_part(response, '<think>', 2), '</think>', 1) AS inner_text FROM responses)""", "responses")

SQL["repair_json"] = with_views(f"""
SELECT case_id, round, line_no, {repair('g')} AS repaired, {valid(repair('g'))} AS is_valid
FROM (SELECT *, {GREEDY} AS g FROM responses)""", "responses")

SQL["code_of_item"] = with_views(f"""
SELECT case_id, round, line_no, array_to_string(list_transform(items, lambda x: {strip("split_part(x, ':', 1)")}), ',') AS codes
FROM (SELECT *, regexp_extract_all(regexp_extract(response, {MD_TOP}, 1), '"([^"]+)"', 1) AS items FROM responses)
WHERE len(items) > 0""", "responses")

DEDUP_FIRST = """
vd AS (SELECT * FROM ex WHERE status = 'valid' QUALIFY row_number() OVER (PARTITION BY round, case_id ORDER BY line_no) = 1)"""
DEDUP_LAST = """
vd AS (SELECT * FROM ex WHERE status = 'valid' QUALIFY row_number() OVER (PARTITION BY round, case_id ORDER BY line_no DESC) = 1)"""
VOC = """
vl AS (SELECT list(code) AS codes FROM vocab),
vv AS (SELECT vd.*, list_filter(final, lambda x: list_contains(vl.codes, x)) AS valid,
              CAST(len(final) - len(list_filter(final, lambda x: list_contains(vl.codes, x))) AS BIGINT) AS n_error FROM vd, vl)"""

SQL["is_ranked_prefix"] = with_views("WITH " + ONE + "," + DEDUP_FIRST + """
SELECT case_id, round, ranked[1:len(final)] = final AS all_match, final[1:1] = ranked[1:1] AS first_match FROM vd""", "responses")

SQL["dedup_valid"] = with_views("WITH " + LAST + "," + DEDUP_LAST + "," + VOC + """
SELECT case_id, round, line_no, array_to_string(ranked, ',') AS ranked, array_to_string(valid, ',') AS valid, n_error FROM vv""",
                                "responses", "vocab")

SQL["self_consistency"] = with_views("WITH " + ONE + "," + DEDUP_FIRST + """
SELECT round, count(*) AS n_valid, count(*) FILTER (WHERE ranked[1:len(final)] = final) AS n_all_match,
       count(*) FILTER (WHERE final[1:1] = ranked[1:1]) AS n_first_match FROM vd GROUP BY round""", "responses")

SQL["extraction_report"] = with_views("WITH " + ONE + "," + DEDUP_FIRST + "," + VOC + """,
e AS (SELECT round, count(*) AS log_rows, count(*) FILTER (WHERE status = 'valid') AS valid,
             count(*) FILTER (WHERE status = 'invalid') AS invalid,
             count(*) FILTER (WHERE status = 'valid' AND method = 'markdown') AS markdown,
             count(*) FILTER (WHERE status = 'valid') - count(DISTINCT case_id) FILTER (WHERE status = 'valid') AS duplicate_valid_rows
      FROM ex GROUP BY round),
v AS (SELECT round, count(*) AS valid_dedup, sum(n_error) AS error_codes, count(*) FILTER (WHERE n_error > 0) AS error_cases
      FROM vv GROUP BY round)
SELECT e.round, x.item, CAST(coalesce(x.n, 0) AS BIGINT) AS n
FROM e LEFT JOIN v ON v.round = e.round,
LATERAL (VALUES ('log_rows', e.log_rows), ('valid', e.valid), ('invalid', e.invalid),
                ('duplicate_valid_rows', e.duplicate_valid_rows), ('markdown', e.markdown), ('valid_dedup', v.valid_dedup),
                ('error_codes', v.error_codes), ('error_cases', v.error_cases)) x(item, n)""", "responses", "vocab")
