"""Reports: distributions, before/after reduction statistics, histograms,
describe(), mapping ambiguity, token costs, top-k lists.

Totals are one-row aggregates read as scalar subqueries; medians and quartiles are
exact order statistics over counted values (``quantiles.py``); nothing is windowed
over raw rows and no task sees a whole column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casespark.functions.columns import safe_ratio
from casespark.operators import quantiles as Q


def _c(c):
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------- SC11 / SC17 / AG3
def split_dual_code(df: DataFrame, col: str = "icd9code") -> DataFrame:
    """'v9, v10' -> v9, v10 (trimmed; missing part -> '')."""
    parts = F.split(F.coalesce(F.col(col), F.lit("")), ", ")
    v9 = F.trim(F.coalesce(F.get(parts, 0), F.lit("")))
    v10 = F.trim(F.coalesce(F.get(parts, 1), F.lit("")))
    return df.withColumn("v9", v9).withColumn("v10", v10)


def disease_system(df: DataFrame, col: str = "diagnosisstring", unclassified: str = "unclassified") -> DataFrame:
    """Text before the first '|', trimmed; no '|' -> ``unclassified``."""
    return df.withColumn("system", F.when(F.col(col).contains("|"), F.trim(F.substring_index(col, "|", 1)))
                         .otherwise(F.lit(unclassified)))


def distribution_pct(df: DataFrame, col: str, value_name: str = "value") -> DataFrame:
    """Value counts with percentage of all non-null values."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias(value_name)).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / counts.agg(F.sum("n")).scalar())


# --------------------------------------------------------------------- AG13 / AG14
def multi_mapping(diag: DataFrame, name: str = "diagnosisstring", code: str = "v9") -> DataFrame:
    """Names mapped to more than one code and codes mapped to more than one name, one row for each partner.
    Output: side, value, n_other, other."""
    pairs = diag.filter(F.col(code).isNotNull() & (F.col(code) != "") & F.col(name).isNotNull()) \
        .select(F.col(name).alias("a"), F.col(code).alias("b")).distinct()

    def partners(side: str, own: str, other: str) -> DataFrame:
        many = pairs.groupBy(F.col(own).alias("value")).agg(F.count(F.lit(1)).alias("n_other")).filter("n_other > 1")
        return pairs.select(F.col(own).alias("value"), F.col(other).alias("other")).join(many, "value").select(
            F.lit(side).alias("side"), "value", "n_other", "other")

    return partners("name_to_codes", "a", "b").unionByName(partners("code_to_names", "b", "a"))


def disease_summary(diag: DataFrame, patient: str = "hadm_id", name: str = "diagnosisstring") -> DataFrame:
    """One row: records, patients, unique names/v9/v10/systems, per-patient counts."""
    d = disease_system(split_dual_code(diag))
    per = d.groupBy(patient).agg(F.count(F.lit(1)).alias("c"))
    a = d.agg(F.count(F.lit(1)).alias("total_diagnosis_records"), F.countDistinct(patient).alias("total_patients"),
              F.countDistinct(name).alias("unique_diagnosis_strings"),
              F.countDistinct(F.when(F.col("v9") != "", F.col("v9"))).alias("unique_icd9_codes"),
              F.countDistinct(F.when(F.col("v10") != "", F.col("v10"))).alias("unique_icd10_codes"),
              F.countDistinct(F.when(F.col(name).isNotNull(), F.col("system"))).alias("disease_systems"))
    counts = Q.ranked_counts(per.select(F.lit("patient").alias("of"), "c"), ["of"], "c")
    p = Q.moments(counts, ["of"]).select(F.col("min").cast("long").alias("min_per_patient"),
                                         F.col("max").cast("long").alias("max_per_patient"), F.col("mean").alias("mean_per_patient"))
    m = Q.order_statistics(counts, ["of"], [0.5]).select(F.col("value").alias("median_per_patient"))
    return combine_rows(a, p, m)


def combine_rows(*frames: DataFrame) -> DataFrame:
    """Merge single-row frames with disjoint columns into one row (union + aggregate, no join)."""
    cols = [c for f in frames for c in f.columns]
    types = {fld.name: fld.dataType for f in frames for fld in f.schema.fields}
    u = None
    for f in frames:
        sel = [F.col(c) if c in f.columns else F.lit(None).cast(types[c]).alias(c) for c in cols]
        part = f.select(*sel)
        u = part if u is None else u.unionByName(part)
    return u.agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])


# --------------------------------------------------------------------- AG8 / AG9 / AG10
def entity_counts(before: DataFrame, after: DataFrame, key: str, entities: DataFrame | None = None) -> DataFrame:
    """Per entity: rows before and after processing (entities with no rows count 0)."""
    b = before.groupBy(key).agg(F.count(F.lit(1)).alias("before"))
    a = after.groupBy(key).agg(F.count(F.lit(1)).alias("after"))
    j = b.join(a, key, "full")
    if entities is not None:
        j = entities.select(key).distinct().join(j, key, "left")
    return j.select(key, F.coalesce("before", F.lit(0)).cast("long").alias("before"),
                    F.coalesce("after", F.lit(0)).cast("long").alias("after"))


def before_after_stats(counts: dict[str, DataFrame]) -> DataFrame:
    """For each kind of table and side: min, max, mean, median, population std, total; reduction count and %."""
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("v")) for s in ("before", "after")]))
    long = reduce(DataFrame.unionByName, [c.select(F.lit(kind).alias("kind"), sides.alias("x")).select("kind", "x.*")
                                          for kind, c in counts.items()])
    by = ["kind", "side"]
    ranked = Q.ranked_counts(long, by)
    m = Q.moments(ranked, by).join(Q.wide_quantiles(Q.order_statistics(ranked, by, [0.5]), by, {0.5: "median"}), by)
    totals = m.groupBy("kind").agg(*[F.max(F.when(F.col("side") == s, F.col("total"))).alias(f"total_{s}") for s in ("before", "after")])
    red = F.col("total_before") - F.col("total_after")
    return m.join(totals, "kind").select(
        "kind", "side", F.col("min").cast("long").alias("min"), F.col("max").cast("long").alias("max"), "mean", "median",
        Q.std(population=True).alias("std"), F.col("total").cast("long").alias("total"), F.col("count").alias("n_entities"),
        red.cast("long").alias("reduced"), F.coalesce(safe_ratio(red * 100, "total_before"), F.lit(0.0)).alias("reduced_pct"))


# Fixed bin edges per table kind: (label, lo, hi) inclusive, hi None = open.
BINS = {
    "diagnosis": [("0", 0, 0), ("1-10", 1, 10), ("11-20", 11, 20), ("21-50", 21, 50), ("50+", 51, None)],
    "pasthistory": [("0", 0, 0), ("1-5", 1, 5), ("6-10", 6, 10), ("11-20", 11, 20), ("20+", 21, None)],
    "physicalexam": [("0", 0, 0), ("1-10", 1, 10), ("11-20", 11, 20), ("21-50", 21, 50), ("50+", 51, None)],
    "lab": [("0", 0, 0), ("1-50", 1, 50), ("51-100", 51, 100), ("101-200", 101, 200), ("201-500", 201, 500),
            ("500+", 501, None)],
}


def count_histogram(counts: DataFrame, kind: str) -> DataFrame:
    """Entities per bin of their row count, before and after; empty bins kept."""
    bins = BINS[kind]
    cols = []
    for side in ("before", "after"):
        for i, (label, lo, hi) in enumerate(bins):
            cond = (F.col(side) >= lo) & ((F.col(side) <= hi) if hi is not None else F.lit(True))
            cols.append(F.count_if(cond).alias(f"{side}|{i}"))
    w = counts.agg(*cols)
    rows = [F.struct(F.lit(side).alias("side"), F.lit(i).alias("ord"), F.lit(label).alias("bin"),
                     F.col(f"`{side}|{i}`").cast("long").alias("n"))
            for side in ("before", "after") for i, (label, _, _) in enumerate(bins)]
    return w.select(F.explode(F.array(*rows)).alias("x")).select(F.lit(kind).alias("kind"), "x.*")


def in_range_entities(counts: DataFrame, key: str, col: str = "after", lo: int = 11, hi: int = 20) -> DataFrame:
    return counts.filter(F.col(col).between(lo, hi)).select(key, F.col(col).alias("n"))


# --------------------------------------------------------------------- AG11 / AG15 / AG16
def describe_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, sample std, min, linear quartiles, max per column (exact)."""
    counts = Q.ranked_counts(Q.long_form(df, cols), ["col"])
    quartiles = Q.wide_quantiles(Q.order_statistics(counts, ["col"], [0.25, 0.5, 0.75]), ["col"], {0.25: "q25", 0.5: "q50", 0.75: "q75"})
    m = Q.moments(counts, ["col"]).select("col", "count", "mean", Q.std(population=False).alias("std"), "min", "max")
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "col string")          # a column without values has count 0
    j = names.join(m.join(quartiles, "col"), "col", "left")
    return j.select("col", F.coalesce("count", F.lit(0)).alias("count"), "mean", "std", "min", "q25", "q50", "q75", "max")


def length_distribution(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.size(col).alias("len")).agg(F.count(F.lit(1)).alias("n"))


def missing_top1_codes(cases: DataFrame, labels: str = "labels", top1: str = "top1") -> DataFrame:
    """Codes appearing as a label but never as the first label."""
    all_codes = cases.select(F.explode(labels).alias("code")).distinct()
    firsts = cases.select(F.col(top1).alias("code")).distinct()
    return all_codes.join(firsts, "code", "left_anti")


# --------------------------------------------------------------------- AG12
def token_cost(log: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """Σ tokens / 1e6 × price per model; reasoning tokens count as output when present.
    ``prices``: model, input_price_m, output_price_m (a small dimension)."""
    t = log.groupBy(model).agg(
        (F.sum("prompt_tokens") / 1e6).alias("in_m"),
        (F.sum(F.col("completion_tokens") + F.coalesce(F.col("reasoning_tokens"), F.lit(0))) / 1e6).alias("out_m"))
    j = t.join(prices, model, "inner")
    return j.select(model, "in_m", "out_m", (F.col("in_m") * F.col("input_price_m")).alias("in_cost"),
                    (F.col("out_m") * F.col("output_price_m")).alias("out_cost")) \
        .withColumn("cost", F.col("in_cost") + F.col("out_cost"))


# --------------------------------------------------------------------- TK1 / TK2
def top_k(df: DataFrame, by: str, n: int = 20, tie: str = "code") -> DataFrame:
    """n rows with the largest ``by`` (ties by ``tie``): planned as TakeOrderedAndProject."""
    return df.orderBy(F.desc(by), F.asc(tie)).limit(n)


def limit_cases(cases: DataFrame, n: int, order: str = "case_id") -> DataFrame:
    return cases.orderBy(order).limit(n)
