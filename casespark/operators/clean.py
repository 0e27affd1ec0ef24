"""Row cleaning and per-entity reduction of events (labs, microbiology,
diagnoses, history, exam).

"First/last row per group" is always an aggregate (``min_by``/``max_by`` on an
explicit ordinal) rather than a window, so a hot group is pre-reduced on the
map side; "last non-null per column" is ``max_by(col, ord)`` with the ordinal
nulled where the column is null (rows with a NULL ordering are skipped).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casespark.operators.skew import join_back
from casespark.functions.columns import floor_bucket, hours_between, null_safe_ne, numeric_text


def _c(c):
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------- filters
def drop_blank_codes(df: DataFrame, col: str = "icd9code") -> DataFrame:
    """FLT1: code present and not blank after trimming."""
    return df.filter(F.col(col).isNotNull() & (F.trim(F.col(col)) != ""))


def exclude_value(df: DataFrame, col: str, value: str) -> DataFrame:
    """FLT2: drop rows equal to a sentinel; NULLs stay."""
    return df.filter(null_safe_ne(col, value))


def top_n_ranked_codes(df: DataFrame, n: int = 3, col: str = "seq_num") -> DataFrame:
    """FLT3: keep ranked codes seq_num <= n."""
    return df.filter(F.col(col) <= n)


def within_stay(events: DataFrame, encounters: DataFrame, key: list[str], t: str = "charttime",
                start: str = "admittime", end: str = "dischtime") -> DataFrame:
    """FLT4: events of the stay with start <= t <= end (inclusive); NULL bound -> no rows."""
    enc = encounters.select(*key, F.col(start).alias("_start"), F.col(end).alias("_end"))
    return (events.join(enc, key, "inner")
            .filter((F.col(t) >= F.col("_start")) & (F.col(t) <= F.col("_end"))).drop("_start", "_end"))


def exclude_substring(df: DataFrame, cols_needles: dict[str, list[str]], lower: bool = True) -> DataFrame:
    """FLT5: lower-case (NULL -> ''), drop rows containing any needle in the given column."""
    out = df
    for col, needles in cols_needles.items():
        norm = F.lower(F.coalesce(F.col(col), F.lit(""))) if lower else F.coalesce(F.col(col), F.lit(""))
        out = out.withColumn(col, norm)
        for nd in needles:
            out = out.filter(~F.col(col).contains(nd))
    return out


def coerce_numeric_complete(df: DataFrame, cols: list[str]) -> DataFrame:
    """FLT6: text -> double (bad -> NULL), keep rows where all are present."""
    out = df
    for c in cols:
        out = out.withColumn(c, numeric_text(F.col(c).cast("string")))
    return out.na.drop(subset=cols)


def hours_window(events: DataFrame, encounters: DataFrame, key: list[str], lo: float | None, hi: float | None,
                 t: str = "charttime", start: str = "admittime") -> DataFrame:
    """FLT8: hours since admission within [lo, hi]; rows without a time pass."""
    enc = encounters.select(*key, F.col(start).alias("_start"))
    j = events.join(enc, key, "left")
    hours = hours_between(F.col("_start"), F.col(t))
    j = j.withColumn("hours", hours)
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (F.col("hours") >= lo)
    if hi is not None:
        cond = cond & (F.col("hours") <= hi)
    return j.filter(F.col("hours").isNull() | cond).drop("_start")


def exclude_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """FLT11: drop listed ids (anti join; the id list is data, not a literal)."""
    return df.join(ids.select(key), key, "left_anti")


# --------------------------------------------------------------------- first / last per group
def first_per_group(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One whole row per group: the earliest (or latest) by ``order`` (ties broken by the listed order)."""
    other = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in other])
    ordk = F.struct(*[F.col(c) for c in order])
    pick = (F.max_by if last else F.min_by)(row, ordk)
    return df.groupBy(*keys).agg(pick.alias("_r")).select(*keys, "_r.*")


def first_lab_per_item(labs: DataFrame, encounters: DataFrame) -> DataFrame:
    """WN1: labs inside the stay, comments without 'cancel', earliest per (stay, item)."""
    inside = within_stay(labs, encounters, ["hadm_id"], "charttime", "admittime", "dischtime")
    kept = exclude_substring(inside, {"comments": ["cancel"]})
    return first_per_group(kept, ["hadm_id", "itemid"], ["charttime", "labevent_id"])


def micro_first_or_all(micro: DataFrame, encounters: DataFrame) -> DataFrame:
    """WN2: per (stay, test): drop cancelled; if any antibiotic id is missing keep
    only the earliest row, else all rows."""
    inside = within_stay(micro, encounters, ["hadm_id"], "charttime", "admittime", "dischtime")
    kept = exclude_substring(inside, {"org_name": ["cancel"], "comments": ["cancel", "___"]})
    keys = ["hadm_id", "test_name"]
    g = kept.groupBy(*keys).agg(F.max(F.col("ab_itemid").isNull()).alias("_any_null"),
                               F.min(F.struct("charttime", "microevent_id")).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    keep = (~F.col("_any_null")) | (F.struct("charttime", "microevent_id") == F.col("_first"))
    return join_back(kept, g, keys).filter(keep).drop("_any_null", "_first", "_rows")


# --------------------------------------------------------------------- lab reduction of set 2
LAB_ATTRS = ["labresultoffset", "labresultrevisedoffset", "labtypeid", "labmeasurenamesystem",
             "labmeasurenameinterface", "labid"]


def _is_glucose(c="labname") -> Column:
    return F.lower(F.col(c)).contains("glucose")


def _lab_base(labs: DataFrame) -> DataFrame:
    return labs.filter(F.col("labname").isNotNull() & F.col("labresult").isNotNull())


def glucose_4h(labs: DataFrame, minutes: int = 240, pid: str = "patientunitstayid") -> DataFrame:
    """AG7: glucose rows averaged per bucket of the revised offset; attributes are
    the first non-null value in input order (labid); offsets := bucket start."""
    g = _lab_base(labs).filter(_is_glucose())
    g = g.withColumn("_bucket", floor_bucket("labresultrevisedoffset", minutes))
    first_nn = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("labid"))).alias(c)
                for c in ("labtypeid", "labmeasurenamesystem", "labmeasurenameinterface", "labid")]
    a = g.groupBy(pid, "_bucket", "labname").agg(
        F.avg("labresult").alias("labresult"), F.min("labresult").alias("labresult_min"),
        F.max("labresult").alias("labresult_max"), F.count(F.lit(1)).alias("labresult_count"), *first_nn)
    return a.select(pid, F.concat(F.col("labname"), F.lit("_4h_avg")).alias("labname"), "labresult",
                    F.col("_bucket").alias("labresultoffset"), F.col("_bucket").alias("labresultrevisedoffset"),
                    "labtypeid", "labmeasurenamesystem", "labmeasurenameinterface", "labid")


def bucket_latest(labs: DataFrame, minutes: int, blood_gas: bool, pid: str = "patientunitstayid") -> DataFrame:
    """WN3: per (bucket of revised offset, name) the latest non-null value of every
    column, ordered by (revised offset, labid).  ``blood_gas`` selects type 7, else
    every other type including a missing one."""
    base = _lab_base(labs).filter(~_is_glucose())
    is7 = F.col("labtypeid").eqNullSafe(F.lit(7))
    base = base.filter(is7 if blood_gas else ~is7)
    base = base.withColumn("_bucket", floor_bucket("labresultrevisedoffset", minutes))
    ordk = F.struct("labresultrevisedoffset", "labid")
    cols = ["labresult"] + LAB_ATTRS
    a = base.groupBy(pid, "_bucket", "labname").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), ordk)).alias(c) for c in cols])
    return a.select(pid, "labname", *cols)


def reduce_labs(labs: DataFrame, pid: str = "patientunitstayid") -> DataFrame:
    """WN4: glucose 4h means ∪ blood gas 30-min latest ∪ others 6-h latest, exact duplicates dropped."""
    cols = [pid, "labname", "labresult"] + LAB_ATTRS
    parts = [glucose_4h(labs, 240, pid).select(*cols),
             bucket_latest(labs, 30, True, pid).select(*cols),
             bucket_latest(labs, 360, False, pid).select(*cols)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


# --------------------------------------------------------------------- duplicates
def dedup_keep(df: DataFrame, key: list[str], order: list[str], keep: str = "first") -> DataFrame:
    """WN5: drop duplicates on ``key`` keeping the first/last row in ``order`` (explicit ordinal)."""
    return first_per_group(df, key, order, last=(keep == "last"))


def flag_duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """WN6: rows whose key occurs more than once (count per key joined back; NULL keys equal each other)."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
    return join_back(df, counts, key).withColumn("is_dup", F.col("_rows") > 1).drop("_rows")


def head_per_group(df: DataFrame, key: list[str], order: list[str], n: int = 15) -> DataFrame:
    """WN7: first n rows per group; ``row_number <= n`` is planned as a WindowGroupLimit
    (partial top-n before the shuffle)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


# --------------------------------------------------------------------- table cleaners of set 2
def clean_diagnoses(diag: DataFrame, pid: str = "hadm_id", order: str = "seq_num") -> DataFrame:
    """Codes present and non-blank, then one row per (stay, diagnosis string), first kept."""
    return dedup_keep(drop_blank_codes(diag, "icd9code"), [pid, "diagnosisstring"], [order], "first")


def clean_history(hist: DataFrame, pid: str = "patientunitstayid", order: str = "ord") -> DataFrame:
    keyed = dedup_keep(hist, [pid, "pasthistorypath", "pasthistoryvalue", "pasthistoryvaluetext"], [order], "first")
    return exclude_value(keyed, "pasthistoryvaluetext", "Performed")


def clean_exam(exam: DataFrame, pid: str = "patientunitstayid", order: str = "ord") -> DataFrame:
    keyed = dedup_keep(exam, [pid, "physicalexampath", "physicalexamvalue", "physicalexamtext"], [order], "first")
    return exclude_value(keyed, "physicalexamvalue", "Performed - Structured")


def split_codes_target(diag: DataFrame, targets: DataFrame, key: str = "hadm_id", code: str = "icd_code",
                       name: str = "long_title", order: str = "seq_num") -> DataFrame:
    """FLT12: keep codes in the target set (a dimension; Spark's size estimate picks the join);
    drop cases with none left; ordered id, name and 'id:name' lists."""
    kept = diag.join(targets.select(code, name), code, "inner")
    s = F.struct(F.col(order).alias("o"), F.col(code).alias("c"), F.col(name).alias("n"))
    g = kept.groupBy(key).agg(F.array_sort(F.collect_list(s)).alias("_l"))
    return g.select(key, F.transform("_l", lambda x: x["c"]).alias("ids"),
                    F.transform("_l", lambda x: x["n"]).alias("names"),
                    F.transform("_l", lambda x: F.concat(x["c"], F.lit(":"), x["n"])).alias("id_names"))
