"""Cohort selection: frequency-ranked code sets, strict cohorts, funnels,
coverage, stratified deterministic sampling and patient-level splits.

Skew rule used throughout: anything "per patient" or "per disease" is first
reduced with a (partial) aggregate on (patient, disease) so a hot patient or
disease never ships its raw rows to one task; arrays are only collected once
their length is bounded by the size of the top set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casespark.functions.columns import md5_draw, safe_ratio
from casespark.operators.quantiles import numbered

PRIORITIES = ("Primary", "Major", "Other")


# --------------------------------------------------------------------- AG1 / AG2
def code_frequency_top(lists: list[DataFrame] | DataFrame, col: str = "labels", n: int = 50,
                       code_col: str = "code") -> DataFrame:
    """Count every occurrence of every code over the array column of several
    inputs; keep the n most frequent (ties by code); ``total`` = sum kept."""
    if isinstance(lists, DataFrame):
        lists = [lists]
    codes = None
    for df in lists:
        part = df.select(F.explode(F.col(col)).alias(code_col))
        codes = part if codes is None else codes.unionByName(part)
    return _top_n(codes.groupBy(code_col).agg(F.count(F.lit(1)).alias("freq")), code_col, n)


def disease_frequency_top(diag: DataFrame, col: str = "diagnosisstring", n: int = 100,
                          require: str | None = "icd9code") -> DataFrame:
    """value_counts().head(n) over rows whose ``require`` column is present."""
    d = diag.filter(F.col(require).isNotNull()) if require else diag
    return _top_n(d.groupBy(col).agg(F.count(F.lit(1)).alias("freq")), col, n)


def _top_n(counts: DataFrame, key: str, n: int) -> DataFrame:
    # top-k is the feature: TakeOrderedAndProject keeps only n rows per partition
    top = counts.orderBy(F.desc("freq"), F.asc(key)).limit(n)
    w = Window.orderBy(F.desc("freq"), F.asc(key))  # over <= n rows only
    return top.select(key, "freq", F.row_number().over(w).alias("rank"), top.agg(F.sum("freq")).scalar().alias("total"))


# --------------------------------------------------------------------- AG4 / AG5
def _patient_disease(diag: DataFrame, top: DataFrame, patient: str, disease: str, order: str,
                     require: str | None) -> DataFrame:
    """(patient, disease) with first position overall and per priority, and top-set flag."""
    d = diag.filter(F.col(require).isNotNull()) if require else diag
    flags = F.broadcast(top.select(F.col(disease), F.lit(True).alias("in_top")))  # |top| = n rows
    pd_ = d.groupBy(patient, disease).agg(
        F.min(order).alias("first_pos"),
        *[F.min(F.when(F.col("priority") == p, F.col(order))).alias(f"pos_{p.lower()}") for p in PRIORITIES])
    return pd_.join(flags, disease, "left").withColumn("in_top", F.coalesce("in_top", F.lit(False)))


def _ordered_list(pos_col: str, val: str) -> F.Column:
    s = F.when(F.col(pos_col).isNotNull(), F.struct(F.col(pos_col).alias("p"), F.col(val).alias("v")))
    return F.transform(F.array_sort(F.collect_list(s)), lambda x: x["v"])


def age_number(c) -> F.Column:
    """First digit run of the age text as int ('> 89' -> 89, '' -> NULL)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract(c, r"\d+", 0).try_cast("int")


def strict_cohort(diag: DataFrame, patients: DataFrame, top: DataFrame, patient: str = "hadm_id",
                  disease: str = "icd_code", order: str = "seq_num", require: str | None = "icd9code") -> DataFrame:
    """Patients all of whose diseases are in ``top`` and who have at least one
    Primary and one Major disease; ordered-distinct lists by priority."""
    pdz = _patient_disease(diag, top, patient, disease, order, require)
    only_top = pdz.groupBy(patient).agg(F.bool_and("in_top").alias("all_top")).filter("all_top").select(patient)
    # every surviving patient has <= |top| distinct diseases: bounded arrays
    lists = pdz.join(only_top, patient, "left_semi").groupBy(patient).agg(
        _ordered_list("first_pos", disease).alias("all_list"),
        *[_ordered_list(f"pos_{p.lower()}", disease).alias(f"{p.lower()}_list") for p in PRIORITIES])
    pat = patients.select(F.col(patient), "gender", age_number("age").alias("age"))
    out = lists.join(pat, patient, "inner").filter((F.size("primary_list") > 0) & (F.size("major_list") > 0))
    return out.select(
        F.col(patient).alias("patient_id"), "age", "gender", "all_list", "primary_list", "major_list", "other_list",
        F.size("all_list").cast("long").alias("total_disease_count"),
        F.size("primary_list").cast("long").alias("primary_count"),
        F.size("major_list").cast("long").alias("major_count"),
        F.size("other_list").cast("long").alias("other_count"))


def cohort_funnel(diag: DataFrame, patients: DataFrame, top: DataFrame, patient: str = "hadm_id",
                  disease: str = "icd_code", order: str = "seq_num", require: str | None = "icd9code") -> DataFrame:
    """Counts at each filter stage of ``strict_cohort`` in one aggregate pass."""
    pdz = _patient_disease(diag, top, patient, disease, order, require)
    per = pdz.groupBy(patient).agg(
        F.bool_and("in_top").alias("all_top"),
        F.max(F.col("pos_primary").isNotNull()).alias("has_p"),
        F.max(F.col("pos_major").isNotNull()).alias("has_m"))
    per = per.join(patients.select(patient, F.lit(True).alias("has_patient")), patient, "left")
    cand = F.col("all_top") & F.col("has_patient").isNotNull()
    agg = per.agg(
        F.count(F.lit(1)).alias("patients_with_diagnosis"),
        F.count_if("all_top").alias("only_top"),
        F.count_if(~F.col("all_top")).alias("with_non_top"),
        F.count_if(cand).alias("candidates"),
        F.count_if(cand & ~F.col("has_p")).alias("without_primary"),
        F.count_if(cand & ~F.col("has_m")).alias("without_major"),
        F.count_if(cand & ~F.col("has_p") & ~F.col("has_m")).alias("without_both"),
        F.count_if(cand & ~(F.col("has_p") & F.col("has_m"))).alias("filtered_by_priority"),
        F.count_if(cand & F.col("has_p") & F.col("has_m")).alias("retained"))
    stages = [c for c in agg.columns]
    long = agg.select(F.col("patients_with_diagnosis").alias("base"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(s).alias("stage"), F.col(s).cast("long").alias("n")) for i, s in enumerate(stages)
    ])).alias("x"))
    return long.select(F.col("x.ord").alias("ord"), F.col("x.stage").alias("stage"), F.col("x.n").alias("n"),
                       safe_ratio(F.col("x.n"), F.col("base")).alias("rate"))


# --------------------------------------------------------------------- AG6
def coverage_report(diag: DataFrame, top: DataFrame, patient: str = "hadm_id", disease: str = "icd_code",
                    require: str | None = "icd9code", n_uncovered: int = 50) -> DataFrame:
    """Coverage of patients by the top set: summary rows, per-disease patient
    counts and the most common diseases among uncovered patients.
    Output: section, name, n, rate."""
    d = diag.filter(F.col(require).isNotNull()) if require else diag
    pdz = d.select(patient, disease).distinct()
    flagged = pdz.join(F.broadcast(top.select(disease, F.lit(True).alias("in_top"))), disease, "left")
    per = flagged.groupBy(patient).agg(F.max(F.col("in_top").isNotNull()).alias("covered"))
    summ = per.agg(F.count(F.lit(1)).alias("total"), F.count_if("covered").alias("covered"))
    summary = summ.select(F.explode(F.array(
        F.struct(F.lit("total_patients_with_icd").alias("name"), F.col("total").cast("long").alias("n"), F.lit(1.0).alias("rate")),
        F.struct(F.lit("covered_patients").alias("name"), F.col("covered").cast("long").alias("n"),
                 safe_ratio("covered", "total").alias("rate")),
        F.struct(F.lit("uncovered_patients").alias("name"), (F.col("total") - F.col("covered")).cast("long").alias("n"),
                 safe_ratio(F.col("total") - F.col("covered"), "total").alias("rate")),
    )).alias("x")).select(F.lit("summary").alias("section"), "x.*")
    per_disease = (top.select(disease).join(flagged.filter("in_top").groupBy(disease).agg(F.count(F.lit(1)).alias("n")),
                                            disease, "left")
                   .select(F.lit("disease_patients").alias("section"), F.col(disease).alias("name"),
                           F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.lit(None).cast("double").alias("rate")))
    unc = pdz.join(per.filter(~F.col("covered")), patient, "left_semi").groupBy(disease).agg(F.count(F.lit(1)).alias("n"))
    unc_top = (unc.orderBy(F.desc("n"), F.asc(disease)).limit(n_uncovered)
               .select(F.lit("top_uncovered").alias("section"), F.col(disease).alias("name"), F.col("n").cast("long"),
                       F.lit(None).cast("double").alias("rate")))
    return summary.unionByName(per_disease).unionByName(unc_top)


# --------------------------------------------------------------------- WN9 / WN10
def sample_per_disease(cohort: DataFrame, top: DataFrame, n: int = 20, seed: int = 42,
                       disease: str = "icd_code") -> DataFrame:
    """Up to n patients per top disease, drawn by a seeded md5 order.
    Output: disease, patient_id (NULL when none available), draw_rank, available, sampled."""
    cand = cohort.select("patient_id", F.explode("all_list").alias(disease)).join(
        F.broadcast(top.select(disease)), disease, "left_semi")
    # row_number <= n becomes a partial WindowGroupLimit before the shuffle: a hot disease ships <= n rows/partition
    w = Window.partitionBy(disease).orderBy(md5_draw(seed, F.col(disease), F.col("patient_id")), F.col("patient_id"))
    picked = cand.withColumn("draw_rank", F.row_number().over(w)).filter(F.col("draw_rank") <= n)
    avail = cand.groupBy(disease).agg(F.count(F.lit(1)).alias("available"))
    stats = top.select(disease).join(avail, disease, "left").select(
        disease, F.coalesce("available", F.lit(0)).cast("long").alias("available"))
    stats = stats.withColumn("sampled", F.least(F.col("available"), F.lit(n)).cast("long"))
    return stats.join(picked, disease, "left").select(
        F.col(disease).alias("disease"), "patient_id", F.col("draw_rank").cast("long").alias("draw_rank"),
        "available", "sampled")


def sample_per_code(cases: DataFrame, n: int = 30, seed: int = 0, labels: str = "labels",
                    top1: str = "top1", key: str = "case_id") -> DataFrame:
    """Per label code up to n cases: cases whose top1 is the code first, then the
    other labelled cases, each group in seeded md5 order.  Output: distinct key."""
    pairs = cases.select(key, top1, F.explode(F.array_distinct(labels)).alias("code"))
    pairs = pairs.withColumn("is_primary", (F.col(top1) == F.col("code")).cast("int"))
    w = Window.partitionBy("code").orderBy(F.desc("is_primary"), md5_draw(seed, F.col("code"), F.col(key)), F.col(key))
    picked = pairs.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= n)
    return picked.select(key).distinct()


# --------------------------------------------------------------------- WN11 / WN12
def ordered_distinct(df: DataFrame, key: str, val: str, order: str) -> DataFrame:
    """Distinct values per key in first-appearance order (pre-reduced per (key, val))."""
    first = df.filter(F.col(val).isNotNull()).groupBy(key, val).agg(F.min(order).alias("_pos"))
    return first.groupBy(key).agg(_ordered_list("_pos", val).alias("values"))


def split_by_patient(cases: DataFrame, patient: str = "subject_id", weights=(("train", 0.8), ("val", 0.1), ("test", 0.1)),
                     seed: int = 1) -> DataFrame:
    """Assign every case of a patient to the same split by an md5 draw on the patient."""
    draw = md5_draw(seed, F.col(patient))
    total = sum(w for _, w in weights)
    cum, expr = 0.0, None
    for name, w in weights[:-1]:
        cum += w
        bound = int(cum / total * 2 ** 32)        # integer threshold: exact in any engine
        expr = F.when(draw < bound, name) if expr is None else expr.when(draw < bound, name)
    last = weights[-1][0]
    expr = F.lit(last) if expr is None else expr.otherwise(last)
    return cases.withColumn("split", expr)


# --------------------------------------------------------------------- JN7-9, JN19, FLT9
def patient_diag(patients: DataFrame, diag: DataFrame, key: str = "hadm_id") -> DataFrame:
    return patients.join(diag, key, "inner")


def semi_filter(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def resume_pending(cases: DataFrame, log: DataFrame, key: str = "case_id") -> DataFrame:
    """Cases not yet in the response log (restart = skip completed)."""
    return cases.join(log.select(key), key, "left_anti")


def nonempty_label(cases: DataFrame, col: str = "primary") -> DataFrame:
    return cases.filter(F.size(F.col(col)) > 0)


def supplement_cases(sample: DataFrame, pool: DataFrame, key: str = "case_id", col: str = "primary") -> DataFrame:
    """Drop sampled cases with an empty ``col`` list and top the sample up with
    the first (by key) non-empty pool cases not in the sample, as many as were removed."""
    kept = nonempty_label(sample, col)
    removed = sample.agg(F.count_if(F.size(F.col(col)) == 0))           # one row, read as a scalar subquery
    rest = nonempty_label(pool, col).join(sample.select(key), key, "left_anti")
    chosen = numbered(rest.select(key), [key]).where(F.col("place") < removed.scalar()).select(key)
    return kept.unionByName(rest.join(chosen, key, "left_semi").select(*kept.columns))
