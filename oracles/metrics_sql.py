"""Oracle SQL (DuckDB) for the prediction-audit metrics.  Long-form
(unnest + GROUP BY / FULL JOIN) where the Spark side uses array algebra."""

from oracles.views import with_views

SQL: dict[str, str] = {}
V = ("case_preds", "case_labels", "vocab", "diagnoses")


def inter(a, b):
    return f"len(list_filter(list_distinct({a}), lambda x: list_contains({b}, x)))"


def union(a, b):
    return f"len(list_distinct(list_concat({a}, {b})))"


def setsize(a):
    return f"len(list_distinct({a}))"


def r6(e):
    return f"round(CAST({e} AS DOUBLE), 6)"


BASE = """
vl AS (SELECT list(code) AS codes FROM vocab),
pv AS (
  SELECT p.*, list_filter(p.final, lambda x: list_contains(vl.codes, x)) AS pred
  FROM case_preds p, vl),
j AS (
  SELECT p.case_id, p.round, p.model, p.think, p.temperature, p.ranked, p.pred,
         l.labels, l.top1, l."primary", l.major
  FROM pv p JOIN case_labels l ON l.case_id = p.case_id),
j1 AS (SELECT * FROM j WHERE round = 1)"""


def w(body, *extra):
    """body may start with additional CTEs ("name AS (...), ...") followed by a SELECT."""
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return with_views("WITH " + BASE + "\n" + body, *V, *extra)
    return with_views("WITH " + BASE + ",\n" + body, *V, *extra)


def w20(body):
    """``w`` over the runs whose ranked lists hold 20 items."""
    return with_views("WITH " + BASE.replace("FROM case_preds p", "FROM case_preds20 p") + ("\n" if body.strip().upper().startswith("SELECT") else ",\n")
                      + body.strip(), "case_preds20", "case_labels", "vocab", "diagnoses")


SQL["valid_codes_only"] = w("""
SELECT case_id, round, array_to_string(pred, ',') AS valid, CAST(len(final) - len(pred) AS BIGINT) AS n_error FROM pv
""")

SQL["join_predictions"] = w("""
SELECT case_id, array_to_string(ranked, ',') AS ranked, array_to_string(pred, ',') AS pred,
       array_to_string(labels, ',') AS labels, top1 FROM j1
""")

PER_CASE = f"""
pc AS (
  SELECT case_id,
         CASE WHEN list_sort(list_distinct(labels)) = list_sort(list_distinct(pred)) THEN 1.0 ELSE 0.0 END AS exact,
         {inter('labels', 'pred')} AS i, {union('labels', 'pred')} AS u,
         {setsize('labels')} AS nl, {setsize('pred')} AS np
  FROM j1)"""

SQL["subset_accuracy"] = w(PER_CASE + f"\nSELECT count(*) AS n, {r6('avg(exact)')} AS subset_accuracy FROM pc")
SQL["jaccard_accuracy"] = w(PER_CASE + f"""
SELECT count(*) AS n, {r6('avg(CASE WHEN u > 0 THEN i / u END)')} AS jaccard_accuracy,
       count(*) FILTER (WHERE u = 0) AS n_undefined FROM pc""")
SQL["samples_prf"] = w(PER_CASE + f"""
SELECT count(*) AS n,
       {r6('avg(CASE WHEN np > 0 THEN i / np ELSE 0 END)')} AS samples_precision,
       {r6('avg(CASE WHEN nl > 0 THEN i / nl ELSE 0 END)')} AS samples_recall,
       {r6('avg(CASE WHEN nl + np > 0 THEN 2 * i / (nl + np) ELSE 0 END)')} AS samples_f1 FROM pc""")
SQL["hamming_loss"] = w(PER_CASE + f"""
SELECT count(*) AS n, {r6('sum(nl + np - 2 * i) / (count(*) * (SELECT count(*) FROM vocab))')} AS hamming_loss FROM pc""")

LONG = """
lab AS (SELECT DISTINCT case_id, code FROM (SELECT case_id, unnest(labels) AS code FROM j1)),
prd AS (SELECT DISTINCT case_id, code FROM (SELECT case_id, unnest(pred) AS code FROM j1)),
o AS (
  SELECT coalesce(l.code, p.code) AS code,
         count(*) FILTER (WHERE l.code IS NOT NULL AND p.code IS NOT NULL) AS tp,
         count(*) FILTER (WHERE l.code IS NULL) AS fp,
         count(*) FILTER (WHERE p.code IS NULL) AS fn
  FROM lab l FULL JOIN prd p ON l.case_id = p.case_id AND l.code = p.code GROUP BY 1),
rep AS (
  SELECT v.code, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn,
         CASE WHEN coalesce(tp, 0) + coalesce(fp, 0) > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
         CASE WHEN coalesce(tp, 0) + coalesce(fn, 0) > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
         coalesce(tp, 0) + coalesce(fn, 0) AS support
  FROM vocab v LEFT JOIN o ON o.code = v.code),
rep2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM rep)"""

SQL["per_code_report"] = w(LONG + f""",
named AS (SELECT r.*, coalesce(n.name, 'Unknown') AS name FROM rep2 r LEFT JOIN code_names n ON n.code = r.code)
SELECT code, name, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
       {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1, CAST(support AS BIGINT) AS support
FROM named""", "code_names")

SQL["avg_report"] = w(LONG + "," + PER_CASE.strip().rstrip(",") + f""",
t AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
             sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1 * support) AS wf,
             sum(support) AS support FROM rep2),
mi AS (SELECT CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p,
              CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r, support FROM t)
SELECT 'micro avg' AS average, {r6('p')} AS precision, {r6('r')} AS recall,
       {r6('CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END')} AS f1, CAST(support AS BIGINT) AS support FROM mi
UNION ALL SELECT 'macro avg', {r6('mp')}, {r6('mr')}, {r6('mf')}, CAST(support AS BIGINT) FROM t
UNION ALL SELECT 'weighted avg', {r6('wp / support')}, {r6('wr / support')}, {r6('wf / support')}, CAST(support AS BIGINT) FROM t
UNION ALL SELECT 'samples avg', {r6('avg(CASE WHEN np > 0 THEN i / np ELSE 0 END)')},
       {r6('avg(CASE WHEN nl > 0 THEN i / nl ELSE 0 END)')},
       {r6('avg(CASE WHEN nl + np > 0 THEN 2 * i / (nl + np) ELSE 0 END)')}, CAST(sum(nl) AS BIGINT) FROM pc""")

SQL["top1_accuracy"] = w(f"""
SELECT count(*) FILTER (WHERE top1 IS NOT NULL AND top1 <> '' AND list_contains(pred, top1)) AS correct,
       count(*) AS total_all, count(*) FILTER (WHERE top1 IS NOT NULL AND top1 <> '') AS total_with_top1,
       {r6("count(*) FILTER (WHERE top1 IS NOT NULL AND top1 <> '' AND list_contains(pred, top1)) / count(*)")} AS accuracy_all,
       {r6("count(*) FILTER (WHERE top1 IS NOT NULL AND top1 <> '' AND list_contains(pred, top1)) / count(*) FILTER (WHERE top1 IS NOT NULL AND top1 <> '')")} AS accuracy_with_top1
FROM j1""")

SQL["recall_at_k"] = w(f"""
ks AS (SELECT unnest(range(1, 11)) AS k)
SELECT CAST(k AS INTEGER) AS k, {r6(f"avg({inter('labels', 'ranked[1:k]')} / len(labels))")} AS recall, count(*) AS n
FROM j1, ks GROUP BY k""")

SQL["hit_at_k"] = w20(f"""
ks AS (SELECT unnest([3, 5, 10, 20]) AS k)
SELECT CAST(k AS INTEGER) AS k, {r6(f"avg(CASE WHEN {inter('labels', 'ranked[1:k]')} > 0 THEN 1.0 ELSE 0.0 END)")} AS hit_rate,
       count(*) AS n
FROM j1, ks GROUP BY k""")

SQL["group_recall"] = w(f"""
g AS (SELECT 'primary' AS grp, "primary" AS lst, pred FROM j1 UNION ALL SELECT 'major', major, pred FROM j1)
SELECT grp, count(*) FILTER (WHERE len(lst) > 0 AND {inter('lst', 'pred')} > 0) AS hit,
       count(*) FILTER (WHERE len(lst) > 0) AS total,
       {r6(f"coalesce(count(*) FILTER (WHERE len(lst) > 0 AND {inter('lst', 'pred')} > 0) / nullif(count(*) FILTER (WHERE len(lst) > 0), 0), 0.0)")} AS recall
FROM g GROUP BY grp""")

SQL["code_accuracy"] = w(f"""
SELECT top1 AS code, count(*) FILTER (WHERE list_contains(pred, top1)) AS correct, count(*) AS total,
       {r6('count(*) FILTER (WHERE list_contains(pred, top1)) / count(*)')} AS accuracy
FROM j1 WHERE top1 IS NOT NULL GROUP BY top1""")

MOC = """
lab_o AS (SELECT case_id, code, i FROM (SELECT case_id, unnest(labels) AS code, generate_subscripts(labels, 1) AS i FROM j1)),
prd_o AS (SELECT case_id, code, i FROM (SELECT case_id, unnest(pred) AS code, generate_subscripts(pred, 1) AS i FROM j1)),
lab_m AS (SELECT l.*, NOT EXISTS (SELECT 1 FROM prd_o p WHERE p.case_id = l.case_id AND p.code = l.code) AS bad FROM lab_o l),
prd_m AS (SELECT p.*, NOT EXISTS (SELECT 1 FROM lab_o l WHERE l.case_id = p.case_id AND l.code = p.code) AS bad FROM prd_o p),
moc AS (
  SELECT j1.case_id,
         coalesce((SELECT string_agg(code, ',' ORDER BY i) FROM lab_m m WHERE m.case_id = j1.case_id AND bad), '') AS missed,
         (SELECT count(*) FROM lab_m m WHERE m.case_id = j1.case_id AND bad) AS n_missed,
         coalesce((SELECT string_agg(code, ',' ORDER BY i) FROM prd_m m WHERE m.case_id = j1.case_id AND bad), '') AS over,
         (SELECT count(*) FROM prd_m m WHERE m.case_id = j1.case_id AND bad) AS n_over,
         len(labels) AS n_labels, len(pred) AS n_pred
  FROM j1),
moc2 AS (SELECT *, CASE WHEN n_labels > 0 THEN n_missed / n_labels ELSE 0.0 END AS miss_rate,
                   CASE WHEN n_pred > 0 THEN n_over / n_pred ELSE 0.0 END AS over_rate FROM moc)"""

SQL["miss_over_case"] = w(MOC + f"""
SELECT case_id, missed, CAST(n_missed AS BIGINT) AS n_missed, {r6('miss_rate')} AS miss_rate, over,
       CAST(n_over AS BIGINT) AS n_over, {r6('over_rate')} AS over_rate,
       CAST(n_labels AS BIGINT) AS n_labels, CAST(n_pred AS BIGINT) AS n_pred FROM moc2""")

SQL["miss_over_summary"] = w(MOC + f"""
SELECT count(*) AS total_cases, CAST(sum(n_missed) AS BIGINT) AS total_missed, CAST(sum(n_over) AS BIGINT) AS total_over,
       {r6('avg(n_missed)')} AS avg_missed_per_case, {r6('avg(n_over)')} AS avg_over_per_case,
       {r6('avg(miss_rate)')} AS avg_miss_rate, {r6('avg(over_rate)')} AS avg_over_rate,
       {r6('stddev_pop(miss_rate)')} AS std_miss_rate, {r6('stddev_pop(over_rate)')} AS std_over_rate FROM moc2""")

SQL["miss_over_by_code"] = w(MOC + f""",
u AS (SELECT code, TRUE AS is_label, bad FROM lab_m UNION ALL SELECT code, FALSE, bad FROM prd_m),
g AS (SELECT code, count(*) FILTER (WHERE is_label) AS total_in_labels, count(*) FILTER (WHERE NOT is_label) AS total_in_predictions,
             count(*) FILTER (WHERE is_label AND bad) AS missed_count, count(*) FILTER (WHERE NOT is_label AND bad) AS over_count
      FROM u GROUP BY code)
SELECT code, total_in_labels, total_in_predictions, missed_count, over_count,
       {r6('CASE WHEN total_in_labels > 0 THEN missed_count / total_in_labels ELSE 0.0 END')} AS miss_rate,
       {r6('CASE WHEN total_in_predictions > 0 THEN over_count / total_in_predictions ELSE 0.0 END')} AS over_rate FROM g""")

SQL["severity_bins"] = w(MOC + f""",
bins AS (SELECT * FROM (VALUES (0, 0.0, 0.2, '0.0-0.2'), (1, 0.2, 0.4, '0.2-0.4'), (2, 0.4, 0.6, '0.4-0.6'),
                               (3, 0.6, 0.8, '0.6-0.8'), (4, 0.8, 1.0, '0.8-1.0')) b(i, lo, hi, bin)),
sides AS (SELECT 'miss' AS side, miss_rate AS r FROM moc2 UNION ALL SELECT 'over', over_rate FROM moc2)
SELECT s.side, b.bin, CAST(count(r) AS BIGINT) AS n,
       {r6('count(r) / (SELECT count(*) FROM moc2)')} AS pct
FROM (SELECT DISTINCT side FROM sides) s CROSS JOIN bins b
LEFT JOIN sides x ON x.side = s.side AND x.r >= b.lo AND (x.r < b.hi OR (b.i = 4 AND x.r <= b.hi))
GROUP BY s.side, b.bin""")

SQL["micro_macro_pr"] = w(MOC + "," + LONG.strip() + f""",
mi AS (SELECT (SELECT sum({inter('labels', 'pred')}) FROM j1) AS tp,
              (SELECT count(*) FROM lab_m WHERE bad) AS fn, (SELECT count(*) FROM prd_m WHERE bad) AS fp)
SELECT {r6('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END')} AS micro_recall,
       {r6('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END')} AS micro_precision,
       {r6('(SELECT avg(tp / (tp + fn)) FROM o WHERE tp + fn > 0)')} AS macro_recall,
       {r6('(SELECT avg(tp / (tp + fp)) FROM o WHERE tp + fp > 0)')} AS macro_precision
FROM mi""")


def _cons(rounds, label=None):
    n = len(rounds)
    alias = [f"a{i}" for i in range(n)]
    joins = " JOIN ".join(f"(SELECT case_id, ranked, pred FROM j WHERE round = {r}) {a}" +
                          ("" if i == 0 else f" ON {a}.case_id = a0.case_id") for i, (r, a) in enumerate(zip(rounds, alias)))

    def inter_n(lists):
        base = f"list_distinct({lists[0]})"
        cond = " AND ".join(f"list_contains({x}, x)" for x in lists[1:])
        return f"len(list_filter({base}, lambda x: {cond}))"

    def union_n(lists):
        return f"len(list_distinct(flatten([{', '.join(lists)}])))"

    rows = []
    for k in (1, 2, 3, 5, 10, 20):
        ls = [f"{a}.ranked[1:{k}]" for a in alias]
        rows.append(f"SELECT 'ranked' AS measure, {k} AS k, CASE WHEN {union_n(ls)} > 0 THEN {inter_n(ls)} / {union_n(ls)} END AS v FROM {joins}")
    ls = [f"{a}.pred[1:1]" for a in alias]
    rows.append(f"SELECT 'final_top1', 1, CAST({inter_n(ls)} AS DOUBLE) FROM {joins}")
    ls = [f"{a}.pred" for a in alias]
    rows.append(f"SELECT 'final_all', 0, CASE WHEN {union_n(ls)} > 0 THEN {inter_n(ls)} / {union_n(ls)} END FROM {joins}")
    sel = "" if label is None else f"'{label}' AS pair, "
    return (f"SELECT {sel}measure, CAST(k AS INTEGER) AS k, {r6('avg(v)')} AS value, count(*) AS n, "
            f"count(*) FILTER (WHERE v IS NULL) AS n_undefined FROM ({' UNION ALL '.join(rows)}) GROUP BY measure, k")


SQL["pair_consistency"] = w20(" UNION ALL ".join(_cons([a, b], f"{a}-{b}") for a, b in ((1, 2), (1, 3), (2, 3))))
SQL["triple_consistency"] = w20(_cons([1, 2, 3]))


def _poisson_case(u):
    from casespark.operators.metrics import POISSON1_THRESHOLDS as T
    whens = " ".join(f"WHEN {u} < {t} THEN {k}" for k, t in enumerate(T))
    return f"CASE {whens} ELSE {len(T)} END"


def _mul32(h, c):
    return f"((({h}) * {c & 0xFFFF} + ((({h}) * {c >> 16}) & 65535) * 65536) & 4294967295)"


def _mix32(x):
    x = f"xor({x}, ({x}) >> 16)"
    x = _mul32(x, 0x7FEB352D)
    x = f"xor({x}, ({x}) >> 15)"
    x = _mul32(x, 0x846CA68B)
    return f"xor({x}, ({x}) >> 16)"


_BASE = "CAST(('0x' || substr(md5(concat_ws(':', '7', CAST(case_id AS VARCHAR))), 1, 8)) AS BIGINT)"
_U = _mix32(f"(({_BASE}) + ((rep * {0x9E3779B9}) & 4294967295)) & 4294967295")

SQL["bootstrap_ci"] = w(f"""
sc AS (SELECT case_id, k, {inter('labels', 'ranked[1:k]')} / len(labels) AS s FROM j1, (SELECT unnest(range(1, 11)) AS k)),
fan AS (SELECT case_id, rep, {_poisson_case(_U)} AS wt FROM (SELECT DISTINCT case_id FROM j1), (SELECT unnest(range(1000)) AS rep)),
reps AS (SELECT f.rep, s.k, sum(f.wt * s.s) / sum(f.wt) AS m FROM fan f JOIN sc s ON s.case_id = f.case_id GROUP BY f.rep, s.k)
SELECT 'recall_at_' || CAST(r.k AS VARCHAR) AS metric, {r6('v.value')} AS value, {r6('r.lo')} AS lo, {r6('r.hi')} AS hi
FROM (SELECT k, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM reps GROUP BY k) r
JOIN (SELECT k, avg(s) AS value FROM sc GROUP BY k) v ON v.k = r.k""")

SQL["run_sweep"] = with_views("WITH " + BASE + f""",
pc AS (SELECT model, think, temperature, round, top1, pred,
         CASE WHEN list_sort(list_distinct(labels)) = list_sort(list_distinct(pred)) THEN 1.0 ELSE 0.0 END AS exact,
         {inter('labels', 'pred')} AS i, {union('labels', 'pred')} AS u, {setsize('labels')} AS nl, {setsize('pred')} AS np
       FROM j)
SELECT model, think, temperature, CAST(round AS INTEGER) AS round, count(*) AS n, {r6('avg(exact)')} AS subset_accuracy,
       {r6('avg(CASE WHEN u > 0 THEN i / u END)')} AS jaccard_accuracy,
       {r6('avg(CASE WHEN np > 0 THEN i / np ELSE 0 END)')} AS samples_precision,
       {r6('avg(CASE WHEN nl > 0 THEN i / nl ELSE 0 END)')} AS samples_recall,
       {r6('avg(CASE WHEN nl + np > 0 THEN 2 * i / (nl + np) ELSE 0 END)')} AS samples_f1,
       {r6('sum(nl + np - 2 * i) / (count(*) * (SELECT count(*) FROM vocab))')} AS hamming_loss,
       count(*) FILTER (WHERE u = 0) AS n_undefined,
       {r6("count(*) FILTER (WHERE top1 IS NOT NULL AND top1 <> '' AND list_contains(pred, top1)) / count(*)")} AS accuracy_all
FROM pc GROUP BY model, think, temperature, round""", *V)


def _md5(*parts):
    return f"CAST(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8)) AS BIGINT)"


def _draw53(base, i):
    hi, lo = (_mix32(f"({base} + ((({i}) * 2 + {k}) * {0x9E3779B9} & 4294967295)) & 4294967295") for k in (0, 1))
    return f"((({hi}) & 2097151) * 4294967296 + ({lo}))"


_KS = range(1, 11)
SQL["bootstrap_ci_multinomial"] = w(f"""
sc AS (SELECT case_id, {_md5("'11'", "'bucket'", "CAST(case_id AS VARCHAR)")} % 64 AS b,
              {', '.join(f"{inter('labels', f'ranked[1:{k}]')} / len(labels) AS r{k}" for k in _KS)} FROM j1),
ix AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY b ORDER BY case_id) - 1 AS loc,
              row_number() OVER (ORDER BY b, case_id) - 1 AS idx FROM sc),
rb AS MATERIALIZED (SELECT rep, b, n, {_md5("'11'", "'slot'", "CAST(rep AS VARCHAR)", "CAST(b AS VARCHAR)")} AS s1,
              {_md5("'11'", "'case'", "CAST(rep AS VARCHAR)", "CAST(b AS VARCHAR)")} AS s2
       FROM (SELECT unnest(range(1000)) AS rep), (SELECT b, count(*) AS n FROM ix GROUP BY b)),
hits AS (SELECT rep, {_draw53('s1', 'slot')} % (SELECT count(*) FROM ix) AS idx FROM (SELECT rep, s1, unnest(range(n)) AS slot FROM rb)),
cnt AS MATERIALIZED (SELECT h.rep, ix.b, count(*) AS c FROM hits h JOIN ix ON ix.idx = h.idx GROUP BY h.rep, ix.b),
dr AS (SELECT rep, b, {_draw53('s2', 'j')} % n AS loc
       FROM (SELECT cnt.rep, cnt.b, rb.n, rb.s2, unnest(range(cnt.c)) AS j FROM cnt JOIN rb ON rb.rep = cnt.rep AND rb.b = cnt.b)),
reps AS MATERIALIZED (SELECT d.rep, {', '.join(f'avg(ix.r{k}) AS r{k}' for k in _KS)} FROM dr d JOIN ix ON ix.b = d.b AND ix.loc = d.loc GROUP BY d.rep)
{' UNION ALL '.join(f"SELECT 'recall_at_{k}' AS metric, {r6(f'(SELECT avg(r{k}) FROM ix)')} AS value, {r6(f'quantile_cont(r{k}, 0.025)')} AS lo, {r6(f'quantile_cont(r{k}, 0.975)')} AS hi FROM reps" for k in _KS)}""")
