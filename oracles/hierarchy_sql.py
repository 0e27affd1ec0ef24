"""Oracle SQL for the code hierarchy: LIKE-prefix joins and range predicates."""

from oracles.metrics_sql import BASE, V, inter, r6, union, setsize
from oracles.views import with_views

SQL: dict[str, str] = {}


def w(body, *extra):
    body = body.strip()
    sep = "\n" if body.upper().startswith("SELECT") else ",\n"
    return with_views("WITH " + BASE + sep + body, *V, "taxonomy", *extra)


CODES = "codes AS (SELECT DISTINCT icd_code AS code FROM diagnoses)"

# first class (by class order) having a member whose 3-char prefix starts the code
PCLS = """
pcls AS (SELECT c.code, (SELECT min(t.top) FROM taxonomy t WHERE c.code LIKE substr(t.leaf, 1, 3) || '%') AS class FROM {src} c)"""

SQL["prefix_class_join"] = w(CODES + "," + PCLS.format(src="codes") + "\nSELECT code, class FROM pcls")

SQL["range_class_join"] = w(CODES + """
SELECT c.code, (SELECT min(top) FROM taxonomy t WHERE substr(c.code, 1, 3) BETWEEN t.top_lo AND t.top_hi) AS range FROM codes c""")

# long form: (case, class) rows for labels and predictions
CLS_LONG = """
cl AS (SELECT DISTINCT x.case_id, t.top AS cls FROM (SELECT case_id, unnest(labels) AS code FROM j1) x
       JOIN (SELECT DISTINCT substr(leaf, 1, 3) AS p, top FROM taxonomy) t ON substr(x.code, 1, 3) = t.p),
cp AS (SELECT DISTINCT x.case_id, t.top AS cls FROM (SELECT case_id, unnest(pred) AS code FROM j1) x
       JOIN (SELECT DISTINCT substr(leaf, 1, 3) AS p, top FROM taxonomy) t ON substr(x.code, 1, 3) = t.p),
lists AS (SELECT j1.case_id,
                 coalesce((SELECT list(cls) FROM cl WHERE cl.case_id = j1.case_id), []) AS L,
                 coalesce((SELECT list(cls) FROM cp WHERE cp.case_id = j1.case_id), []) AS P FROM j1)"""

SQL["class_metrics"] = w(CLS_LONG + f""",
pc AS (SELECT CASE WHEN list_sort(L) = list_sort(P) THEN 1.0 ELSE 0.0 END AS exact, {inter('L', 'P')} AS i,
              {union('L', 'P')} AS u, {setsize('L')} AS nl, {setsize('P')} AS np FROM lists)
SELECT count(*) AS n, {r6('avg(exact)')} AS subset_accuracy, {r6('avg(CASE WHEN u > 0 THEN i / u END)')} AS jaccard_accuracy,
       {r6('avg(CASE WHEN np > 0 THEN i / np ELSE 0 END)')} AS samples_precision,
       {r6('avg(CASE WHEN nl > 0 THEN i / nl ELSE 0 END)')} AS samples_recall,
       {r6('avg(CASE WHEN nl + np > 0 THEN 2 * i / (nl + np) ELSE 0 END)')} AS samples_f1,
       {r6('sum(nl + np - 2 * i) / (count(*) * (SELECT count(DISTINCT top) FROM taxonomy))')} AS hamming_loss, count(*) FILTER (WHERE u = 0) AS n_undefined
FROM pc""")

SQL["class_report"] = w(CLS_LONG + f""",
o AS (SELECT coalesce(l.cls, p.cls) AS cls, count(*) FILTER (WHERE l.cls IS NOT NULL AND p.cls IS NOT NULL) AS tp,
             count(*) FILTER (WHERE l.cls IS NULL) AS fp, count(*) FILTER (WHERE p.cls IS NULL) AS fn
      FROM cl l FULL JOIN cp p ON l.case_id = p.case_id AND l.cls = p.cls GROUP BY 1),
r AS (SELECT t.top AS class, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn
      FROM (SELECT DISTINCT top FROM taxonomy) t LEFT JOIN o ON o.cls = t.top),
r2 AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
              CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM r)
SELECT class, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, {r6('precision')} AS precision,
       {r6('recall')} AS recall, {r6('CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END')} AS f1,
       CAST(tp + fn AS BIGINT) AS support FROM r2""")

SQL["class_recall_at_k"] = w(f"""
lc AS (SELECT j1.case_id, coalesce((SELECT list(DISTINCT t.top) FROM taxonomy t WHERE list_contains(j1.labels, t.leaf)), []) AS L FROM j1),
rk AS (SELECT j1.case_id, k.k,
              coalesce((SELECT list(DISTINCT t.top) FROM (SELECT unnest(j1.ranked[1:k.k]) AS code) x
                        JOIN taxonomy t ON substr(t.leaf, 1, 3) = substr(x.code, 1, 3)), []) AS R
       FROM j1, (SELECT unnest(range(1, 11)) AS k) k)
SELECT CAST(rk.k AS INTEGER) AS k, {r6(f"avg({inter('L', 'R')} / len(L))")} AS recall, count(*) AS n
FROM rk JOIN lc ON lc.case_id = rk.case_id GROUP BY rk.k""")

SQL["class_accuracy"] = w(f"""
tc AS (SELECT j1.case_id, (SELECT min(t.top) FROM taxonomy t WHERE substr(t.leaf, 1, 3) = substr(j1.top1, 1, 3)) AS cls,
              EXISTS (SELECT 1 FROM (SELECT unnest(j1.pred) AS code) x JOIN taxonomy t ON substr(t.leaf, 1, 3) = substr(x.code, 1, 3)
                      WHERE t.top = (SELECT min(t2.top) FROM taxonomy t2 WHERE substr(t2.leaf, 1, 3) = substr(j1.top1, 1, 3))) AS hit
       FROM j1)
SELECT cls AS class, count(*) FILTER (WHERE hit) AS correct, count(*) AS total, {r6('count(*) FILTER (WHERE hit) / count(*)')} AS accuracy
FROM tc WHERE cls IS NOT NULL GROUP BY cls
UNION ALL
SELECT 'ALL', count(*) FILTER (WHERE hit AND cls IS NOT NULL), count(*), {r6('count(*) FILTER (WHERE hit AND cls IS NOT NULL) / count(*)')} FROM tc""")


def _close(label_src):
    return f"""
lp AS ({label_src}),
pp AS (SELECT x.case_id, x.code, t.mid, t.top_lo, t.top_hi FROM (SELECT case_id, unnest(pred) AS code FROM j1) x JOIN taxonomy t ON t.leaf = x.code),
sc AS (SELECT lp.rid, min(CASE WHEN pp.code = lp.label THEN 1 WHEN pp.mid = substr(lp.label, 1, 3) THEN 2
                               WHEN substr(lp.label, 1, 3) BETWEEN pp.top_lo AND pp.top_hi THEN 3 ELSE 4 END) AS s
       FROM lp LEFT JOIN pp ON pp.case_id = lp.case_id GROUP BY lp.rid),
sc2 AS (SELECT coalesce(s, 4) AS score FROM sc),
sv AS (SELECT unnest([1, 2, 3, 4]) AS score)
SELECT CAST(sv.score AS INTEGER) AS score, CAST(count(sc2.score) AS BIGINT) AS n,
       {r6('count(sc2.score) * 100.0 / (SELECT count(*) FROM sc2)')} AS pct
FROM sv LEFT JOIN sc2 ON sc2.score = sv.score GROUP BY sv.score"""


SQL["closeness_top1"] = w(_close("SELECT case_id, case_id AS rid, top1 AS label FROM j1"))
SQL["closeness_all"] = w(_close("SELECT case_id, row_number() OVER () AS rid, label FROM (SELECT case_id, unnest(labels) AS label FROM j1)"))

_MID = CLS_LONG.replace("t.top AS cls", "t.mid AS cls").replace("SELECT DISTINCT substr(leaf, 1, 3) AS p, top FROM taxonomy",
                                                             "SELECT DISTINCT substr(leaf, 1, 3) AS p, mid FROM taxonomy")
SQL["class_metrics_mid"] = w(_MID + f""",
pc AS (SELECT CASE WHEN list_sort(L) = list_sort(P) THEN 1.0 ELSE 0.0 END AS exact, {inter('L', 'P')} AS i,
              {union('L', 'P')} AS u, {setsize('L')} AS nl, {setsize('P')} AS np FROM lists)
SELECT count(*) AS n, {r6('avg(exact)')} AS subset_accuracy, {r6('avg(CASE WHEN u > 0 THEN i / u END)')} AS jaccard_accuracy,
       {r6('avg(CASE WHEN np > 0 THEN i / np ELSE 0 END)')} AS samples_precision,
       {r6('avg(CASE WHEN nl > 0 THEN i / nl ELSE 0 END)')} AS samples_recall,
       {r6('avg(CASE WHEN nl + np > 0 THEN 2 * i / (nl + np) ELSE 0 END)')} AS samples_f1,
       {r6('sum(nl + np - 2 * i) / (count(*) * (SELECT count(DISTINCT mid) FROM taxonomy))')} AS hamming_loss, count(*) FILTER (WHERE u = 0) AS n_undefined
FROM pc""")
