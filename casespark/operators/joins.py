"""Relational joins of the case build: dictionaries, stay bundles, crosswalks,
fall-back sources, set operations.

Dimension tables (code dictionary, lab items, crosswalk) are joined without a
hint: Spark's size estimate decides broadcast (autoBroadcastJoinThreshold) and
AQE converts at run time; only frames whose size is bounded by construction
are hinted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casespark.functions.columns import hours_between


# --------------------------------------------------------------------- JN1 / JN2 / JN7
def diag_with_title(diag: DataFrame, dictionary: DataFrame) -> DataFrame:
    """JN1: inner equi join on (code, version)."""
    return diag.join(dictionary, ["icd_code", "icd_version"], "inner")


def labs_with_item(labs: DataFrame, items: DataFrame) -> DataFrame:
    """JN2: big fact ⋈ small item dictionary on itemid."""
    return labs.join(items, "itemid", "inner")


# --------------------------------------------------------------------- JN3 / JN4 / JN6
def core_stay(admissions: DataFrame, patients: DataFrame, transfers: DataFrame) -> DataFrame:
    """JN3: admissions left-join patients (subject) left-join transfers (stay): one row per transfer."""
    return admissions.join(patients, "subject_id", "left").join(transfers, "hadm_id", "left")


def null_safe_natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """JN4: join on every shared column with NULL matching NULL (pandas merge semantics)."""
    shared = [c for c in left.columns if c in right.columns]
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in shared else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in shared])
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in shared])


def ed_optional(encounters: DataFrame, ed: DataFrame, key: str = "stay_id") -> DataFrame:
    """JN6: ED rows by stay id; encounters without a stay id keep NULL ED columns."""
    return encounters.join(ed, key, "left")


# --------------------------------------------------------------------- JN5
def _tagged_rows(ids: DataFrame, tables: dict[str, DataFrame], key: str, ids_bounded: bool) -> DataFrame:
    """Rows of all tables for the selected stays as one frame: key, table, and a struct column for each table.

    One semi join for the union: ids that are not broadcast cost one shuffle of each table, by the key that everything
    after it groups by."""
    parts = [t.select(key, F.lit(name).alias("table"), F.struct(*[c for c in t.columns if c != key]).alias(name))
             for name, t in tables.items()]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    ids = ids.select(key).distinct()
    return rows.join(F.broadcast(ids) if ids_bounded else ids, key, "left_semi")


def encounter_bundle(ids: DataFrame, tables: dict[str, DataFrame], key: str, nest: bool = False,
                     ids_bounded: bool = False) -> DataFrame:
    """JN5: all rows of every table for the selected stays.

    ``nest=False``: one (table, key) row with the number of rows for each stay and table that has any.  ``nest=True``:
    one row per stay with an array of structs per table, in the order of their first column (a stay's bundle is one
    value by definition; ``bundle_rows`` gives the same without arrays).  ``ids_bounded``: the id list has a size bound
    by construction (e.g. n per disease × |top set|) and is broadcast."""
    rows = _tagged_rows(ids, tables, key, ids_bounded)
    if not nest:
        return rows.groupBy(key, "table").agg(F.count(F.lit(1)).alias("n_rows"))
    nested = rows.groupBy(key).agg(*[F.array_sort(F.collect_list(name)).alias(name) for name in tables])
    ids = ids.select(key).distinct()
    return ids.join(nested, key, "left").select(key, *[F.coalesce(name, F.array().cast(dict(nested.dtypes)[name])).alias(name)
                                                       for name in tables])


def bundle_rows(ids: DataFrame, tables: dict[str, DataFrame], key: str, ids_bounded: bool = False) -> DataFrame:
    """JN5 without arrays: every row of every table with its place in its stay's table (``ord`` from 1, by the first
    column of the table); one shuffle by (stay, table), whatever the size of a stay."""
    rows = _tagged_rows(ids, tables, key, ids_bounded)
    place = F.row_number().over(Window.partitionBy(key, "table").orderBy(*tables))
    return rows.withColumn("ord", place)


# --------------------------------------------------------------------- JN12 / WN8
def crosswalk_codes(diag_titled: DataFrame, crosswalk: DataFrame, dictionary: DataFrame, key: str = "hadm_id",
                    n: int = 3) -> tuple[DataFrame, DataFrame]:
    """JN12: ranked codes (seq_num <= n): version-9 codes first (own title), then
    version-10 codes mapped to version 9 with the title of the first dictionary
    row of that code (any version).  Unmapped codes are dropped and counted.
    Returns (codes: key, part, seq_num, code, title; unmapped: key, n_unmapped)."""
    top = diag_titled.filter(F.col("seq_num") <= n)
    v9 = top.filter(F.col("icd_version") == 9).select(key, F.lit(0).alias("part"), "seq_num",
                                                      F.col("icd_code").alias("code"), F.col("long_title").alias("title"))
    title_any = dictionary.groupBy("icd_code").agg(F.min_by("long_title", "icd_version").alias("title"))
    v10 = top.filter(F.col("icd_version") == 10).join(crosswalk, top.icd_code == crosswalk.icd10, "left")
    mapped = v10.join(title_any, v10.icd9 == title_any.icd_code, "left").select(
        key, F.lit(1).alias("part"), "seq_num", F.col("icd9").alias("code"), F.col("title"))
    ok = mapped.filter(F.col("code").isNotNull() & F.col("title").isNotNull())
    unmapped = mapped.filter(F.col("code").isNull() | F.col("title").isNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_unmapped"))
    return v9.unionByName(ok), unmapped


def primary_code(diag_titled: DataFrame, crosswalk: DataFrame, dictionary: DataFrame, cases: DataFrame,
                 key: str = "hadm_id", labels: str = "codes") -> DataFrame:
    """WN8: the rank-1 code of a case, crosswalked to version 9 (name from the
    dictionary, else 'Unknown'), kept only when it is among the case's codes."""
    first = diag_titled.filter(F.col("seq_num") == 1)
    title_any = dictionary.groupBy("icd_code").agg(F.min_by("long_title", "icd_version").alias("t_any"))
    x = first.join(crosswalk, first.icd_code == crosswalk.icd10, "left")
    code = F.when(F.col("icd_version") == 10, F.col("icd9")).otherwise(F.col("icd_code"))
    x = x.select(key, code.alias("code"), "icd_version", "long_title")
    x = x.join(title_any, x.code == title_any.icd_code, "left")
    name = F.when(F.col("icd_version") == 10, F.coalesce("t_any", F.lit("Unknown"))).otherwise(F.col("long_title"))
    x = x.select(key, "code", name.alias("name"))
    return x.join(cases.select(key, labels), key, "inner").filter(F.array_contains(labels, F.col("code"))).select(key, "code", "name")


# --------------------------------------------------------------------- JN13 / JN17 / JN18
def label_pred_full(label_counts: DataFrame, pred_counts: DataFrame, key: str = "code") -> DataFrame:
    """JN13: full outer join of per-code counts, missing side -> 0."""
    j = label_counts.join(pred_counts, key, "full")
    return j.select(key, F.coalesce("n_label", F.lit(0)).cast("long").alias("n_label"),
                    F.coalesce("n_pred", F.lit(0)).cast("long").alias("n_pred"))


def source_fallback(ids: DataFrame, sources: list[tuple[str, DataFrame]], key: str, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """JN17: rows from the first source (in priority order) that has the id;
    ids found in none are returned separately.

    ``parts``: partitions of the ids.  Bare ids pack so well that partitions merged by their bytes would hold tens of
    millions of them, and a task sorts what it gets."""
    ids = ids.select(key).repartition(parts, key) if parts else ids
    tagged = [df.withColumn("source", F.lit(name)).withColumn("_prio", F.lit(i)) for i, (name, df) in enumerate(sources)]
    u = reduce(lambda a, b: a.unionByName(b), tagged).join(ids.select(key), key, "left_semi")
    best = u.groupBy(key).agg(F.min("_prio").alias("_prio"))
    rows = u.join(best, [key, "_prio"], "left_semi").drop("_prio")
    missing = ids.select(key).distinct().join(best, key, "left_anti")
    return rows, missing


def code_name_lookup(codes: DataFrame, names: DataFrame, code: str = "code") -> DataFrame:
    """JN18: code -> name, else 'Unknown'."""
    return codes.join(names, code, "left").withColumn("name", F.coalesce("name", F.lit("Unknown")))


# --------------------------------------------------------------------- PRJ1
def stay_attributes(encounters: DataFrame, patients: DataFrame, triage: DataFrame) -> DataFrame:
    """Death flag, length of stay in hours, demographics and the first triage row."""
    first_triage = triage.groupBy("stay_id").agg(
        F.min_by(F.struct(*[c for c in triage.columns if c not in ("stay_id",)]), "ord").alias("t"))
    hours = hours_between("admittime", "dischtime")
    e = encounters.select("subject_id", "hadm_id", "stay_id",
                          (F.col("discharge_location") == "DIED").alias("died"), hours.alias("los_hours"))
    j = e.join(patients.select("subject_id", "gender", "anchor_age", "race"), "subject_id", "left")
    return j.join(first_triage, "stay_id", "left").select(
        "subject_id", "hadm_id", "stay_id", "died", "los_hours", "gender", "anchor_age", "race",
        F.col("t.temperature").alias("temperature"), F.col("t.heartrate").alias("heartrate"),
        F.col("t.acuity").alias("acuity"), F.col("t.chiefcomplaint").alias("chiefcomplaint"))


# --------------------------------------------------------------------- ST1-ST3
def union_sources(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def intersect_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def except_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)
