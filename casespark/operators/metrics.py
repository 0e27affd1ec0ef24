"""Prediction-audit metrics over one joined table
``(case_id, run cols…, ranked[], pred[], labels[], top1, primary[], major[])``.

Everything is row-local array algebra followed by a global (partial) aggregate,
or an explode followed by ``groupBy(code)``; no per-case Python, no joins of
exploded pairs.  Sets vs multisets follow the reference: intersections are
sets, missed/over lists keep repeats, recall divides by the raw label count.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casespark.functions.columns import _GOLDEN, _M32, _MIX_A, _MIX_B, md5_draw, safe_ratio

# the resampling tasks travel by value: executors need numpy and pyarrow, not this library
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def _sets(pred="pred", labels="labels"):
    L, P = F.array_distinct(_c(labels)), F.array_distinct(_c(pred))
    inter = F.size(F.array_intersect(L, P))
    return L, P, inter


def _agg(df: DataFrame, by, *cols: Column) -> DataFrame:
    by = list(by or [])
    return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)


# --------------------------------------------------------------------- JN11
def join_predictions(pred: DataFrame, label: DataFrame, key: str = "case_id", strict: bool = False) -> DataFrame:
    """Inner join on the case key.  ``strict`` reproduces the count guard
    (prediction rows must equal label rows): the query fails where it does not hold."""
    if strict:
        same = pred.agg(F.count(F.lit(1))).scalar() == label.agg(F.count(F.lit(1))).scalar()
        pred = pred.where(F.assert_true(same, "prediction and label count mismatch").isNull())
    return pred.join(label, key, "inner")


# --------------------------------------------------------------------- MT1-MT4
def multilabel_metrics(joined: DataFrame, n_labels: int | Column, by=None, pred="pred", labels="labels",
                       with_top1: str | None = None) -> DataFrame:
    """subset accuracy, jaccard accuracy, samples precision/recall/F1, hamming loss
    (and top-1 accuracy over all cases when ``with_top1`` names the top-1 column),
    all in one aggregate."""
    L, P, inter = _sets(pred, labels)
    nl, np_ = F.size(L), F.size(P)
    union = F.size(F.array_union(L, P))
    x = joined.select(*(by or []),
                      (F.array_sort(L) == F.array_sort(P)).cast("double").alias("_exact"),
                      safe_ratio(inter, union).alias("_jac"),
                      F.coalesce(safe_ratio(inter, np_), F.lit(0.0)).alias("_p"),
                      F.coalesce(safe_ratio(inter, nl), F.lit(0.0)).alias("_r"),
                      F.coalesce(safe_ratio(2 * inter, nl + np_), F.lit(0.0)).alias("_f"),
                      (nl + np_ - 2 * inter).alias("_sym"),
                      (union == 0).alias("_undef"),
                      (F.coalesce(F.array_contains(_c(pred), _c(with_top1)), F.lit(False)) & (_c(with_top1) != "")
                       if with_top1 else F.lit(None).cast("boolean")).alias("_t1"))
    extra = [F.avg(F.col("_t1").cast("double")).alias("accuracy_all")] if with_top1 else []
    return _agg(x, by, *extra,
                F.count(F.lit(1)).alias("n"),
                F.avg("_exact").alias("subset_accuracy"),
                F.avg("_jac").alias("jaccard_accuracy"),
                F.avg("_p").alias("samples_precision"),
                F.avg("_r").alias("samples_recall"),
                F.avg("_f").alias("samples_f1"),
                (F.sum("_sym") / (F.count(F.lit(1)) * (n_labels if isinstance(n_labels, Column) else F.lit(float(n_labels))))).alias("hamming_loss"),
                F.count_if("_undef").alias("n_undefined"))


# --------------------------------------------------------------------- MT5 / MT6 / MT22
def code_outcomes(joined: DataFrame, pred="pred", labels="labels", by=None) -> DataFrame:
    """Per code: tp, fp, fn over cases, on distinct codes per case (multi-hot)."""
    L, P, _ = _sets(pred, labels)
    tagged = F.concat(
        F.transform(F.array_intersect(L, P), lambda c: F.struct(c.alias("code"), F.lit("tp").alias("t"))),
        F.transform(F.array_except(P, L), lambda c: F.struct(c.alias("code"), F.lit("fp").alias("t"))),
        F.transform(F.array_except(L, P), lambda c: F.struct(c.alias("code"), F.lit("fn").alias("t"))))
    x = joined.select(*(by or []), F.explode(tagged).alias("o")).select(*(by or []), "o.code", "o.t")
    return x.groupBy(*(by or []), "code").agg(
        F.count_if(F.col("t") == "tp").alias("tp"), F.count_if(F.col("t") == "fp").alias("fp"),
        F.count_if(F.col("t") == "fn").alias("fn"))


def per_code_report(joined: DataFrame, vocab: DataFrame, names: DataFrame | None = None,
                    pred="pred", labels="labels") -> DataFrame:
    """Classification report per vocabulary code (absent codes kept with zeros)."""
    o = code_outcomes(joined, pred, labels)
    # vocabulary is a bounded dimension; codes outside it are dropped like the multi-hot encoder does
    r = vocab.select("code").join(o, "code", "left").na.fill(0, ["tp", "fp", "fn"])
    p = F.coalesce(safe_ratio("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    rc = F.coalesce(safe_ratio("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    r = r.select("code", F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"),
                 F.col("fn").cast("long").alias("fn"), p.alias("precision"), rc.alias("recall"),
                 (F.col("tp") + F.col("fn")).cast("long").alias("support"))
    r = r.withColumn("f1", F.coalesce(safe_ratio(2 * F.col("precision") * F.col("recall"),
                                                 F.col("precision") + F.col("recall")), F.lit(0.0)))
    if names is not None:
        r = r.join(names, "code", "left").withColumn("name", F.coalesce("name", F.lit("Unknown")))
    return r


def avg_report(per_code: DataFrame, joined: DataFrame, pred="pred", labels="labels") -> DataFrame:
    """micro / macro / weighted averages from the per-code report, samples from cases."""
    t = per_code.agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"), F.sum(F.col("recall") * F.col("support")).alias("wr"),
        F.sum(F.col("f1") * F.col("support")).alias("wf"), F.sum("support").alias("support"))
    micro_p = F.coalesce(safe_ratio("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    micro_r = F.coalesce(safe_ratio("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    micro_f = F.coalesce(safe_ratio(2 * micro_p * micro_r, micro_p + micro_r), F.lit(0.0))
    rows = t.select(F.explode(F.array(
        F.struct(F.lit("micro avg").alias("average"), micro_p.alias("precision"), micro_r.alias("recall"),
                 micro_f.alias("f1"), F.col("support").cast("long").alias("support")),
        F.struct(F.lit("macro avg").alias("average"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("support").cast("long").alias("support")),
        F.struct(F.lit("weighted avg").alias("average"), F.coalesce(safe_ratio("wp", "support"), F.lit(0.0)).alias("precision"),
                 F.coalesce(safe_ratio("wr", "support"), F.lit(0.0)).alias("recall"),
                 F.coalesce(safe_ratio("wf", "support"), F.lit(0.0)).alias("f1"),
                 F.col("support").cast("long").alias("support")),
    )).alias("x")).select("x.*")
    L, P, inter = _sets(pred, labels)
    nl, np_ = F.size(L), F.size(P)
    samples = joined.agg(
        F.lit("samples avg").alias("average"),
        F.avg(F.coalesce(safe_ratio(inter, np_), F.lit(0.0))).alias("precision"),
        F.avg(F.coalesce(safe_ratio(inter, nl), F.lit(0.0))).alias("recall"),
        F.avg(F.coalesce(safe_ratio(2 * inter, nl + np_), F.lit(0.0))).alias("f1"),
        F.sum(nl).cast("long").alias("support"))
    return rows.unionByName(samples)


def micro_macro_pr(joined: DataFrame, pred="pred", labels="labels") -> DataFrame:
    """micro recall/precision on list counts (repeats in labels count as misses);
    macro over codes with a non-zero denominator, on per-case code sets."""
    L, P, inter = _sets(pred, labels)
    lab, prd = _c(labels), _c(pred)
    fn_list = F.size(F.filter(lab, lambda x: ~F.array_contains(prd, x)))
    fp_list = F.size(F.filter(prd, lambda x: ~F.array_contains(lab, x)))
    micro = joined.agg(F.sum(inter).alias("tp"), F.sum(fn_list).alias("fn"), F.sum(fp_list).alias("fp"))
    o = code_outcomes(joined, pred, labels)
    macro = o.agg(F.avg(F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn")))).alias("macro_recall"),
                  F.avg(F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp")))).alias("macro_precision"))
    m = micro.select(F.coalesce(safe_ratio("tp", F.col("tp") + F.col("fn")), F.lit(0.0)).alias("micro_recall"),
                     F.coalesce(safe_ratio("tp", F.col("tp") + F.col("fp")), F.lit(0.0)).alias("micro_precision"))
    both = (m.select("micro_recall", "micro_precision", F.lit(None).cast("double").alias("macro_recall"),
                     F.lit(None).cast("double").alias("macro_precision"))
            .unionByName(macro.select(F.lit(None).cast("double").alias("micro_recall"),
                                      F.lit(None).cast("double").alias("micro_precision"), "macro_recall", "macro_precision")))
    return both.agg(*[F.max(c).alias(c) for c in ("micro_recall", "micro_precision", "macro_recall", "macro_precision")])


# --------------------------------------------------------------------- MT7-MT10
def top1_accuracy(joined: DataFrame, pred="pred", top1="top1", by=None) -> DataFrame:
    """Two denominators: all cases (set 1) and cases with a top-1 label (set 2)."""
    has = _c(top1).isNotNull() & (_c(top1) != "")
    hit = has & F.coalesce(F.array_contains(_c(pred), _c(top1)), F.lit(False))
    return _agg(joined, by, F.count_if(hit).alias("correct"), F.count(F.lit(1)).alias("total_all"),
                F.count_if(has).alias("total_with_top1"),
                safe_ratio(F.count_if(hit), F.count(F.lit(1))).alias("accuracy_all"),
                safe_ratio(F.count_if(hit), F.count_if(has)).alias("accuracy_with_top1"))


def recall_at_k(joined: DataFrame, ks=range(1, 11), ranked="ranked", labels="labels", by=None) -> DataFrame:
    """mean |set(labels) ∩ set(ranked[:k])| / len(labels) per k."""
    L = F.array_distinct(_c(labels))
    x = joined.select(*(by or []), L.alias("_L"), F.size(_c(labels)).alias("_n"), _c(ranked).alias("_r"),
                      F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k"))
    score = safe_ratio(F.size(F.array_intersect("_L", F.slice("_r", 1, F.col("k")))), "_n")
    return x.groupBy(*(by or []), "k").agg(F.avg(score).alias("recall"), F.count(F.lit(1)).alias("n"))


def hit_at_k(joined: DataFrame, ks=(3, 5, 10, 20), ranked="ranked", labels="labels", by=None) -> DataFrame:
    """share of cases with any label in ranked[:k]."""
    x = joined.select(*(by or []), _c(labels).alias("_L"), _c(ranked).alias("_r"),
                      F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k"))
    hit = F.arrays_overlap("_L", F.slice("_r", 1, F.col("k")))
    return x.groupBy(*(by or []), "k").agg(F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("hit_rate"),
                                            F.count(F.lit(1)).alias("n"))


def group_recall(joined: DataFrame, groups=("primary", "major"), pred="pred") -> DataFrame:
    """Any disease of the group predicted; cases without the group are excluded."""
    x = joined.select(F.explode(F.array(*[
        F.struct(F.lit(g).alias("grp"), (F.size(_c(g)) > 0).alias("has"),
                 F.coalesce(F.arrays_overlap(_c(g), _c(pred)), F.lit(False)).alias("hit")) for g in groups])).alias("x"))
    return x.groupBy(F.col("x.grp").alias("grp")).agg(
        F.count_if(F.col("x.has") & F.col("x.hit")).alias("hit"), F.count_if("x.has").alias("total")
    ).withColumn("recall", F.coalesce(safe_ratio("hit", "total"), F.lit(0.0)))


# --------------------------------------------------------------------- MT14 / MT15
def code_accuracy(joined: DataFrame, pred="pred", top1="top1") -> DataFrame:
    hit = F.coalesce(F.array_contains(_c(pred), _c(top1)), F.lit(False))
    return (joined.filter(_c(top1).isNotNull()).groupBy(_c(top1).alias("code"))
            .agg(F.count_if(hit).alias("correct"), F.count(F.lit(1)).alias("total"))
            .withColumn("accuracy", safe_ratio("correct", "total")))


# --------------------------------------------------------------------- MT18-MT21
def miss_over_case(joined: DataFrame, pred="pred", labels="labels", key="case_id") -> DataFrame:
    lab, prd = _c(labels), _c(pred)
    missed = F.filter(lab, lambda x: ~F.array_contains(prd, x))
    over = F.filter(prd, lambda x: ~F.array_contains(lab, x))
    return joined.select(
        key, missed.alias("missed"), over.alias("over"),
        F.size(lab).alias("n_labels"), F.size(prd).alias("n_pred")
    ).select(key, "missed", F.size("missed").cast("long").alias("n_missed"),
             F.coalesce(safe_ratio(F.size("missed"), "n_labels"), F.lit(0.0)).alias("miss_rate"),
             "over", F.size("over").cast("long").alias("n_over"),
             F.coalesce(safe_ratio(F.size("over"), "n_pred"), F.lit(0.0)).alias("over_rate"),
             F.col("n_labels").cast("long").alias("n_labels"), F.col("n_pred").cast("long").alias("n_pred"))


def miss_over_summary(per_case: DataFrame) -> DataFrame:
    return per_case.agg(
        F.count(F.lit(1)).alias("total_cases"), F.sum("n_missed").alias("total_missed"), F.sum("n_over").alias("total_over"),
        F.avg("n_missed").alias("avg_missed_per_case"), F.avg("n_over").alias("avg_over_per_case"),
        F.avg("miss_rate").alias("avg_miss_rate"), F.avg("over_rate").alias("avg_over_rate"),
        F.stddev_pop("miss_rate").alias("std_miss_rate"), F.stddev_pop("over_rate").alias("std_over_rate"))


def miss_over_by_code(joined: DataFrame, pred="pred", labels="labels") -> DataFrame:
    """Per code over every occurrence: label total, prediction total, missed, over, rates."""
    lab, prd = _c(labels), _c(pred)
    tagged = F.concat(
        F.transform(lab, lambda c: F.struct(c.alias("code"), F.lit(True).alias("is_label"),
                                            (~F.array_contains(prd, c)).alias("bad"))),
        F.transform(prd, lambda c: F.struct(c.alias("code"), F.lit(False).alias("is_label"),
                                            (~F.array_contains(lab, c)).alias("bad"))))
    x = joined.select(F.explode(tagged).alias("o")).select("o.*")
    g = x.groupBy("code").agg(
        F.count_if("is_label").alias("total_in_labels"), F.count_if(~F.col("is_label")).alias("total_in_predictions"),
        F.count_if(F.col("is_label") & F.col("bad")).alias("missed_count"),
        F.count_if(~F.col("is_label") & F.col("bad")).alias("over_count"))
    return g.select("code", "total_in_labels", "total_in_predictions", "missed_count", "over_count",
                    F.coalesce(safe_ratio("missed_count", "total_in_labels"), F.lit(0.0)).alias("miss_rate"),
                    F.coalesce(safe_ratio("over_count", "total_in_predictions"), F.lit(0.0)).alias("over_rate"))


def miss_over_faults(by_code: DataFrame) -> DataFrame:
    """View of ``miss_over_by_code`` as the first set reports it: codes that were missed or over-predicted at least
    once; label totals count only for missed codes, prediction totals are given only for codes never missed."""
    missed = F.col("missed_count") > 0
    return by_code.where(missed | (F.col("over_count") > 0)).select(
        "code", F.when(missed, F.col("total_in_labels")).otherwise(F.lit(0)).alias("total_in_labels"), "missed_count", "miss_rate",
        "over_count", "over_rate", F.when(~missed, F.col("total_in_predictions")).alias("total_in_predictions"))


SEVERITY_BINS = [(0.0, 0.2), (0.2, 0.4), (0.4, 0.6), (0.6, 0.8), (0.8, 1.0)]  # last bin closed


def severity_bins(per_case: DataFrame, bins=SEVERITY_BINS) -> DataFrame:
    cols = []
    for side in ("miss_rate", "over_rate"):
        r = F.col(side)
        for i, (lo, hi) in enumerate(bins):
            cond = (r >= F.lit(lo)) & ((r <= F.lit(hi)) if i == len(bins) - 1 else (r < F.lit(hi)))
            cols.append(F.count_if(cond).alias(f"{side}|{lo:.1f}-{hi:.1f}"))
    wide = per_case.agg(F.count(F.lit(1)).alias("_n"), *cols)
    long = wide.select("_n", F.explode(F.array(*[
        F.struct(F.lit(c.split("|")[0].replace("_rate", "")).alias("side"), F.lit(c.split("|")[1]).alias("bin"),
                 F.col(f"`{c}`").cast("long").alias("n")) for c in wide.columns if c != "_n"])).alias("x"))
    return long.select("x.side", "x.bin", "x.n", safe_ratio("x.n", "_n").alias("pct"))


# --------------------------------------------------------------------- MT23 / MT24
def _jacc(arrs: list[Column]) -> Column:
    inter, union = arrs[0], arrs[0]
    for a in arrs[1:]:
        inter, union = F.array_intersect(inter, a), F.array_union(union, a)
    return safe_ratio(F.size(F.array_distinct(inter)), F.size(F.array_distinct(union)))


def _consistency_measures(idx: list[int], ks) -> list[tuple[str, int, Column]]:
    m = [("ranked", int(k), _jacc([F.slice(F.col(f"r{i}"), 1, k) for i in idx])) for k in ks]
    first = F.size(F.array_distinct(_intersect_all([F.slice(F.col(f"p{i}"), 1, 1) for i in idx]))).cast("double")
    return m + [("final_top1", 1, first), ("final_all", 0, _jacc([F.col(f"p{i}") for i in idx]))]


def _runs_side_by_side(runs: DataFrame, run_ids: list, key: str, run_col: str, ranked: str, pred: str) -> DataFrame:
    """One row per case with r0/p0, r1/p1, ... (JN14 as a pivoting aggregate: one shuffle,
    no self join); cases missing from any run are dropped, as an inner join would."""
    cols = []
    for i, r in enumerate(run_ids):
        this = F.col(run_col) == r
        # a run that lists a case twice: both lists of the greater row, never of two rows
        cols += [F.max(F.when(this, F.struct(F.col(ranked).alias("r"), F.col(pred).alias("p")))).alias(f"x{i}"),
                 F.count_if(this).alias(f"n{i}")]
    g = runs.filter(F.col(run_col).isin(list(run_ids))).groupBy(key).agg(*cols)
    for i in range(len(run_ids)):
        g = g.withColumn(f"r{i}", F.col(f"x{i}.r")).withColumn(f"p{i}", F.col(f"x{i}.p")).drop(f"x{i}")
    present = None
    for i in range(len(run_ids)):
        c = F.col(f"n{i}") > 0
        present = c if present is None else present & c
    return g.filter(present).drop(*[f"n{i}" for i in range(len(run_ids))])


def pairwise_consistency(runs: DataFrame, run_ids: list, pairs: list[tuple], ks=(1, 2, 3, 5, 10), key="case_id",
                         run_col="round", ranked="ranked", pred="pred") -> DataFrame:
    """Every pair of runs from one join of all runs (each run is scanned and shuffled once)."""
    j = _runs_side_by_side(runs, run_ids, key, run_col, ranked, pred)
    pos = {r: i for i, r in enumerate(run_ids)}
    named = [((F.lit(f"{a}-{b}").alias("pair"),), m) for a, b in pairs for m in _consistency_measures([pos[a], pos[b]], ks)]
    return _averages(j, named, ["pair"])


def run_consistency(runs: DataFrame, run_ids: list, ks=(1, 2, 3, 5, 10), key="case_id", run_col="round",
                    ranked="ranked", pred="pred") -> DataFrame:
    """Agreement of 2 or 3 runs of the same cases: ranked[:k] overlap (|∩|/|∪| of sets),
    first final code overlap (|∩|/1), whole final list overlap.  Cases must be in all runs."""
    j = _runs_side_by_side(runs, run_ids, key, run_col, ranked, pred)
    return _averages(j, [((), m) for m in _consistency_measures(list(range(len(run_ids))), ks)], [])


def _averages(cases: DataFrame, named: list[tuple], extra: list[str]) -> DataFrame:
    """Mean of every measure over the cases: one wide aggregate, and its single row turned into rows."""
    measured = cases.select(*[v.alias(f"m{i}") for i, (_, (_, _, v)) in enumerate(named)])
    wide = measured.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"a{c[1:]}") for c in measured.columns],
                        *[F.count_if(F.col(c).isNull()).alias(f"u{c[1:]}") for c in measured.columns])
    rows = F.explode(F.array(*[F.struct(*names, F.lit(measure).alias("measure"), F.lit(k).alias("k"), F.col(f"a{i}").alias("value"),
                                        F.col(f"u{i}").alias("n_undefined")) for i, (names, (measure, k, _)) in enumerate(named)]))
    return wide.select("n", rows.alias("x")).where("n > 0").select(*[f"x.{c}" for c in extra], "x.measure", "x.k", "x.value", "n", "x.n_undefined")


def _intersect_all(arrs):
    out = arrs[0]
    for a in arrs[1:]:
        out = F.array_intersect(out, a)
    return out


# --------------------------------------------------------------------- MT13
def _poisson_thresholds(kmax: int = 12):
    import math
    out, cdf, p = [], 0.0, math.exp(-1.0)
    for k in range(kmax):
        cdf += p
        out.append(min(int(cdf * 2 ** 32), 2 ** 32))
        p = p / (k + 1)
    return out


POISSON1_THRESHOLDS = _poisson_thresholds()


def _mixed(x):
    """``mix32`` of a numpy array."""
    import numpy as np
    x = (x ^ (x >> np.uint64(16))) * np.uint64(_MIX_A) & np.uint64(_M32)
    x = (x ^ (x >> np.uint64(15))) * np.uint64(_MIX_B) & np.uint64(_M32)
    return x ^ (x >> np.uint64(16))


def _poisson_sums(n_rep: int, width: int):
    """Task: for every replicate the sums of weight times score and of the weights of known scores.

    The weight is a Poisson(1) draw by inverse CDF of a uniform 32-bit integer (exact integer thresholds)."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        limits = np.array(POISSON1_THRESHOLDS, np.uint64)
        sums = np.zeros((n_rep, 2 * width))
        for batch in batches:
            base = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(base), width)
            known = np.concatenate([np.nan_to_num(x), ~np.isnan(x)], 1)
            for rep in range(n_rep):
                u = _mixed((base + np.uint64(rep * _GOLDEN & _M32)) & np.uint64(_M32))
                sums[rep] += np.searchsorted(limits, u, "right") @ known
        yield pa.record_batch([pa.array(np.arange(n_rep, dtype=np.int32))] + [pa.array(sums[:, k].copy()) for k in range(2 * width)],
                              ["rep"] + [f"v{k}" for k in range(2 * width)])
    return run


def _intervals(sums: DataFrame, scores: DataFrame, score_cols: list[str], level: float) -> DataFrame:
    """metric, value, lo, hi from the partial sums of every replicate (rep, sums of scores, sums of weights)."""
    width = len(score_cols)
    means = sums.groupBy("rep").agg(*[safe_ratio(F.sum(f"v{k}"), F.sum(f"v{width + k}")).alias(f"m{k}") for k in range(width)])
    long = means.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"m{k}").alias("m"))
                                            for k, c in enumerate(score_cols)])).alias("x")).select("x.*")
    lo_q, hi_q = (1 - level) / 2, 1 - (1 - level) / 2
    ci = long.groupBy("metric").agg(F.percentile("m", lo_q).alias("lo"), F.percentile("m", hi_q).alias("hi"))    # n_rep values
    full = scores.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in score_cols]).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in score_cols])).alias("x")).select("x.*")
    return full.join(ci, "metric", "inner")   # both sides: one row per metric


def _sums_schema(width: int) -> str:
    return ", ".join(["rep int"] + [f"v{k} double" for k in range(2 * width)])


def bootstrap_ci(scores: DataFrame, score_cols: list[str], key: str = "case_id", n_rep: int = 1000,
                 level: float = 0.95, seed: int = 7) -> DataFrame:
    """Confidence intervals of the mean of each per-case score column.

    Poisson bootstrap: each (replicate, case) gets an independent Poisson(1) weight, so a replicate mean is
    Σw·s/Σw over the known scores.  One pass without index or join: a task keeps the sums of its replicates and gives
    ``n_rep`` rows, whatever the number of cases.  Output: metric, value, lo, hi."""
    # one md5 per case seeds a cheap integer stream over the replicates
    rows = scores.select(md5_draw(seed, F.col(key)).alias("base"), F.array(*[F.col(c).cast("double") for c in score_cols]).alias("scores"))
    width = len(score_cols)
    # every small row costs n_rep draws: spread them over all tasks, not over the few that their bytes ask for
    spread = rows.repartition(int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return _intervals(spread.mapInArrow(_poisson_sums(n_rep, width), _sums_schema(width)), scores, score_cols, level)


def _draws(bases, upto):
    """Draws ``i < upto`` of the streams ``bases`` as 53-bit integers: the numpy twin of two ``stream_draw`` columns."""
    import numpy as np

    i = np.arange(upto, dtype=np.uint64) * np.uint64(2)
    high, low = (_mixed((np.uint64(bases) + (k * np.uint64(_GOLDEN) & np.uint64(_M32))) & np.uint64(_M32)) for k in (i, i + np.uint64(1)))
    return ((high & np.uint64(0x1FFFFF)) << np.uint64(32) | low).astype(np.int64)


def _stream(*parts) -> int:
    """``md5_draw`` of ``parts`` outside Spark."""
    import hashlib
    return int(hashlib.md5(":".join(str(p) for p in parts).encode()).hexdigest()[:8], 16)


def _deal_draws(n_rep: int, seed: int, buckets: int):
    """Task: for bucket ``b`` with ``n_b`` cases, where the draws of its ``n_b`` slots fall, as counts per replicate.

    A draw is uniform over all cases, so the counts of a replicate over all buckets are multinomial; the driver sees
    nothing of it.  Yields (bucket hit, counts of the replicates)."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for b, sizes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size = np.zeros(buckets, np.int64)
                for s in sizes:
                    size[s["bucket"]] = s["n"]
                ends = np.cumsum(size)
                counts = np.zeros((buckets, n_rep), np.int64)
                for rep in range(n_rep):
                    at = _draws(_stream(seed, "slot", rep, b), int(size[b])) % ends[-1]
                    counts[:, rep] = np.bincount(np.searchsorted(ends, at, "right"), minlength=buckets)
                hit = np.flatnonzero(counts.any(1))
                yield pa.record_batch({"bucket": pa.array(hit.astype(np.int32)), "kind": pa.array(np.zeros(len(hit), np.int32)),
                                       "local": pa.array(np.zeros(len(hit), np.int64)),
                                       "counts": pa.array([counts[p].tobytes() for p in hit], pa.binary()),
                                       "scores": pa.nulls(len(hit), pa.list_(pa.float64()))})
    return run


def _draw_locally(n_rep: int, seed: int, width: int):
    """Task over rows sorted by bucket and kind: adds up a bucket's counts, then draws that many of its cases for every
    replicate.  Yields one row per bucket and replicate: sums of the drawn scores, then how many were not null."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        bucket, counts, scores = None, None, []

        def result():
            x = np.concatenate(scores)
            known = np.concatenate([np.nan_to_num(x), ~np.isnan(x)], 1)
            sums = np.empty((n_rep, 2 * width))
            for rep in range(n_rep):
                drawn = _draws(_stream(seed, "case", rep, bucket), int(counts[rep])) % len(x)
                sums[rep] = np.bincount(drawn, minlength=len(x)) @ known
            return pa.record_batch([pa.array(np.arange(n_rep, dtype=np.int32))] + [pa.array(sums[:, k].copy()) for k in range(2 * width)],
                                   ["rep"] + [f"v{k}" for k in range(2 * width)])

        for batch in batches:
            numbers, kinds = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            edges = np.flatnonzero(np.r_[True, (numbers[1:] != numbers[:-1]) | (kinds[1:] != kinds[:-1]), True])
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if numbers[lo] != bucket:
                    if scores and counts is not None:
                        yield result()
                    bucket, counts, scores = int(numbers[lo]), None, []
                part = batch.slice(lo, hi - lo)
                if kinds[lo] == 0:
                    for raw in part.column(3).to_pylist():
                        add = np.frombuffer(raw, np.int64)
                        counts = add.copy() if counts is None else counts + add
                else:
                    flat = part.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    scores.append(flat.reshape(hi - lo, width))
        if scores and counts is not None:
            yield result()
    return run


def bootstrap_ci_multinomial(scores: DataFrame, score_cols: list[str], key: str = "case_id", n_rep: int = 1000,
                             level: float = 0.95, seed: int = 7, buckets: int = 64) -> DataFrame:
    """Confidence intervals by exact resampling: each replicate draws n of the n cases with replacement.

    Cases lie in ``buckets`` buckets by a hash of their key.  Where a replicate's draws fall is decided bucket by bucket
    (multinomial counts: one row of ``n_rep`` counts for each pair of buckets), then every bucket draws its own cases
    in place.  Cases move once, no row of a draw exists, and nothing is counted on the driver.  A bucket's scores are
    held by one task: let ``buckets`` grow with the cases.  Null scores stay out of the means.  Output: metric, value,
    lo, hi."""
    width = len(score_cols)
    values = [F.col(c).cast("double") for c in score_cols]
    cases = scores.select(F.col(key).alias("key"), (md5_draw(seed, F.lit("bucket"), F.col(key)) % buckets).cast("int").alias("bucket"),
                          F.array(*values).alias("scores"))
    sizes = cases.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("sizes"))
    slots = sizes.select(F.explode("sizes.bucket").alias("b"), "sizes").repartitionById(buckets, "b")
    schema = "bucket int, kind int, local long, counts binary, scores array<double>"
    dealt = slots.mapInArrow(_deal_draws(n_rep, seed, buckets), schema)
    held = cases.select("bucket", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("local"), F.lit(None).cast("binary").alias("counts"), "scores", "key")
    # a case's place in its bucket is its rank by key and scores: one sort, no window before it
    met = (dealt.withColumn("key", F.lit(None).cast(cases.schema["key"].dataType)).unionByName(held)
           .repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "kind", "key", "scores").drop("key"))
    return _intervals(met.mapInArrow(_draw_locally(n_rep, seed, width), _sums_schema(width)), scores, score_cols, level)


def recall_scores(joined: DataFrame, ks=range(1, 11), ranked="ranked", labels="labels", key="case_id") -> DataFrame:
    """Per-case recall@k columns (input of bootstrap_ci)."""
    L = F.array_distinct(_c(labels))
    return joined.select(key, *[safe_ratio(F.size(F.array_intersect(L, F.slice(_c(ranked), 1, int(k)))), F.size(_c(labels)))
                                .alias(f"recall_at_{k}") for k in ks])
