"""Code hierarchy: leaf -> mid class (3-char prefix) -> top range class.

The taxonomy is a dimension table ``(leaf, mid, top, top_lo, top_hi)``.
Theta joins of the reference become equi joins: a code's class is found by
its 3-character prefix (first class wins), and range membership is decided by
the range of the prediction itself, so no nested-loop join is needed on the
fact side.

Classes of the members of array columns come from one plan at every size
(``lookup_members``): explode, equi join, regroup by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casespark.functions.columns import safe_ratio
from casespark.operators.lookup import by_stem, lookup_members


def prefix_classes(taxonomy: DataFrame, level: str = "top") -> DataFrame:
    """prefix(3) -> class; when several classes share a prefix the first (by class order) wins."""
    return (taxonomy.select(F.substring("leaf", 1, 3).alias("prefix"), F.col(level).alias("cls"))
            .groupBy("prefix").agg(F.min("cls").alias("cls")))


def prefix_class_join(codes: DataFrame, taxonomy: DataFrame, level: str = "top", code: str = "code") -> DataFrame:
    """JN15: code -> class by 3-char prefix as an equi join (prefix table is bounded by the code system)."""
    pref = prefix_classes(taxonomy, level)
    return (codes.withColumn("prefix", F.substring(code, 1, 3))
            .join(pref, "prefix", "left").drop("prefix").withColumnRenamed("cls", "class"))


def range_class_join(codes: DataFrame, taxonomy: DataFrame, code: str = "code") -> DataFrame:
    """JN16: lo <= prefix <= hi on strings, first range wins.

    The range of every distinct prefix is resolved once: ranges are dealt to the first characters that they span, so
    prefixes meet their candidates by an equi join (overlapping ranges included).  The rows, repeats included, get the
    result by another."""
    first = F.explode(F.sequence(F.ascii("top_lo"), F.greatest(F.ascii("top_lo"), F.ascii("top_hi"))))
    ranges = taxonomy.select("top", "top_lo", "top_hi").distinct().withColumn("_first", first)
    prefixes = codes.select(F.substring(code, 1, 3).alias("_prefix")).where("_prefix IS NOT NULL").distinct()
    resolved = (prefixes.withColumn("_first", F.ascii("_prefix")).join(ranges, "_first")
                .where((F.col("_prefix") >= F.col("top_lo")) & (F.col("_prefix") <= F.col("top_hi")))
                .groupBy("_prefix").agg(F.min("top").alias("range")))
    return codes.withColumn("_prefix", F.substring(code, 1, 3)).join(resolved, "_prefix", "left").drop("_prefix")


def map_codes(df: DataFrame, columns: dict[str, str], mapping: DataFrame, distinct: tuple[str, ...] = (),
              small: bool = False, rows: list[str] | None = None) -> DataFrame:
    """Classes (mapping ``k`` -> ``v``) of the members of array expressions; unmapped members are dropped."""
    res = lookup_members(df, columns, mapping, small=small, rows=rows, usual=by_stem)
    for out in distinct:
        res = res.withColumn(out, F.array_distinct(out))
    return res


def _prefixes(col: str) -> str:
    return f"transform(`{col}`, x -> substr(x, 1, 3))"


def class_sets(joined: DataFrame, taxonomy: DataFrame, level: str = "top", key: str = "case_id",
               labels: str = "labels", pred: str = "pred", ranked: str | None = None,
               label_by_membership: bool = False, rows: list[str] | None = None) -> DataFrame:
    """Add ``cls_labels``/``cls_pred`` (and ``cls_ranked``) class sets per case.

    Predictions map by 3-char prefix; labels by prefix too unless
    ``label_by_membership`` (exact leaf membership, as in class recall@k).  ``rows``: columns that no two rows share."""
    # a prefix has three characters: the table is bounded by the alphabet of the codes, however many leaves there are
    pref = prefix_classes(taxonomy, level).select(F.col("prefix").alias("k"), F.col("cls").alias("v"))
    columns = {"cls_pred": _prefixes(pred)}
    if ranked:
        columns["cls_ranked"] = _prefixes(ranked)
    if not label_by_membership:
        return map_codes(joined, columns | {"cls_labels": _prefixes(labels)}, pref, distinct=("cls_labels", "cls_pred"), small=True,
                         rows=rows)
    member = taxonomy.select(F.col("leaf").alias("k"), F.col(level).alias("v"))
    return map_codes(map_codes(joined, columns, pref, distinct=("cls_pred",), small=True, rows=rows), {"cls_labels": f"`{labels}`"}, member,
                     distinct=("cls_labels",), rows=rows)


def class_recall_at_k(cls_joined: DataFrame, ks=range(1, 11)) -> DataFrame:
    """|set(label classes) ∩ set(classes of ranked[:k])| / |label classes|, mean per k."""
    x = cls_joined.select("cls_labels", "cls_ranked", F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k"))
    s = safe_ratio(F.size(F.array_intersect("cls_labels", F.array_distinct(F.slice("cls_ranked", 1, F.col("k"))))),
                   F.size("cls_labels"))
    return x.groupBy("k").agg(F.avg(s).alias("recall"), F.count(F.lit(1)).alias("n"))


def class_accuracy(joined: DataFrame, taxonomy: DataFrame, level: str = "top", top1: str = "top1",
                   pred: str = "pred", key: str = "case_id", rows: list[str] | None = None) -> DataFrame:
    """Per class of the top-1 label: a prediction falls in the same class.
    Adds an ``ALL`` row whose denominator is every case.  ``rows``: columns that no two rows share."""
    pref = prefix_classes(taxonomy, level)
    c = joined.select(key, top1, pred).withColumn("prefix", F.substring(top1, 1, 3)).join(F.broadcast(pref), "prefix", "left").drop("prefix")
    c = map_codes(c, {"pcls": _prefixes(pred)}, pref.select(F.col("prefix").alias("k"), F.col("cls").alias("v")), distinct=("pcls",), small=True,
                  rows=rows)
    hit = F.coalesce(F.array_contains("pcls", F.col("cls")), F.lit(False))
    per = (c.filter(F.col("cls").isNotNull()).groupBy(F.col("cls").alias("class"))
           .agg(F.count_if(hit).alias("correct"), F.count(F.lit(1)).alias("total")))
    overall = c.agg(F.lit("ALL").alias("class"), F.count_if(hit & F.col("cls").isNotNull()).alias("correct"),
                    F.count(F.lit(1)).alias("total"))
    return per.unionByName(overall).withColumn("accuracy", safe_ratio("correct", "total"))


def _closeness(label: Column, pinfo: str) -> Column:
    """1 exact, 2 prediction in the label prefix's mid class, 3 label prefix inside
    the prediction's range class, 4 unrelated; no predictions -> 4."""
    prefix = F.substring(label, 1, 3)
    scores = F.transform(F.col(pinfo), lambda p: (
        F.when(p["member"] == label, 1).when(p["value"]["mid"] == prefix, 2)
        .when((p["value"]["lo"] <= prefix) & (prefix <= p["value"]["hi"]), 3).otherwise(4)))
    return F.coalesce(F.array_min(scores), F.lit(4))


def closeness(joined: DataFrame, taxonomy: DataFrame, mode: str = "top1", key: str = "case_id",
              pred: str = "pred", top1: str = "top1", labels: str = "labels", rows: list[str] | None = None) -> DataFrame:
    """Distribution of best closeness scores (per case for ``top1``, per label occurrence for ``all``).

    ``rows``: columns that no two rows share."""
    info = taxonomy.select(F.col("leaf").alias("k"), F.struct(F.col("mid").alias("mid"), F.col("top_lo").alias("lo"),
                                                              F.col("top_hi").alias("hi")).alias("v"))
    needed = joined.select(*dict.fromkeys([key, top1 if mode == "top1" else labels, pred]))
    df = lookup_members(needed, {"_pinfo": f"`{pred}`"}, info, rows=rows, usual=by_stem, named=True)
    if mode == "top1":
        s = df.select(_closeness(F.col(top1), "_pinfo").alias("score"))
    else:
        s = df.select(F.explode(labels).alias("_l"), "_pinfo").select(_closeness(F.col("_l"), "_pinfo").alias("score"))
    wide = s.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("score") == i).alias(f"s{i}") for i in (1, 2, 3, 4)])
    long = wide.select("_n", F.explode(F.array(*[F.struct(F.lit(i).alias("score"), F.col(f"s{i}").cast("long").alias("n"))
                                                 for i in (1, 2, 3, 4)])).alias("x"))
    return long.select("x.score", "x.n", (F.coalesce(safe_ratio("x.n", "_n"), F.lit(0.0)) * 100).alias("pct"))
