"""Code-hierarchy queries: class joins, class-level metrics, closeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from casespark.functions.columns import finalize
from casespark.operators import hierarchy as H
from casespark.operators import metrics as M
from casespark.plans.metrics_q import joined
from casespark.plans.registry import query
from casespark.sources import fixtures as fx


def _codes(spark, d):
    return fx.diagnoses(spark, d).select(F.col("icd_code").alias("code")).distinct()


@query("prefix_class_join")
def q_prefix_class_join(spark, d):
    return H.prefix_class_join(_codes(spark, d), fx.taxonomy(spark, d), level="top")


@query("range_class_join")
def q_range_class_join(spark, d):
    return H.range_class_join(_codes(spark, d), fx.taxonomy(spark, d))


def _needed(spark, d, *more):
    """The columns that class sets are made of, one row a case."""
    return joined(spark, d).select("case_id", "pred", "labels", *more)


def _cls(spark, d, **kw):
    return H.class_sets(_needed(spark, d, *([kw["ranked"]] if "ranked" in kw else [])), fx.taxonomy(spark, d), level="top", rows=["case_id"], **kw)


def _n_classes(spark, d, level):
    return fx.taxonomy(spark, d).agg(F.count_distinct(level)).scalar()


@query("class_metrics")
def q_class_metrics(spark, d):
    c = _cls(spark, d)
    return finalize(M.multilabel_metrics(c, _n_classes(spark, d, "top"), pred="cls_pred", labels="cls_labels"))


@query("class_metrics_mid")
def q_class_metrics_mid(spark, d):
    """The same metrics on the 3-character (mid) classes."""
    c = H.class_sets(_needed(spark, d), fx.taxonomy(spark, d), level="mid", rows=["case_id"])
    return finalize(M.multilabel_metrics(c, _n_classes(spark, d, "mid"), pred="cls_pred", labels="cls_labels"))


@query("class_report")
def q_class_report(spark, d):
    c = _cls(spark, d)
    classes = fx.taxonomy(spark, d).select(F.col("top").alias("code")).distinct()
    r = M.per_code_report(c, classes, pred="cls_pred", labels="cls_labels")
    return finalize(r.select(F.col("code").alias("class"), "tp", "fp", "fn", "precision", "recall", "f1", "support"))


@query("class_recall_at_k")
def q_class_recall_at_k(spark, d):
    c = _cls(spark, d, ranked="ranked", label_by_membership=True)
    return finalize(H.class_recall_at_k(c, ks=range(1, 11)))


@query("class_accuracy")
def q_class_accuracy(spark, d):
    return finalize(H.class_accuracy(joined(spark, d), fx.taxonomy(spark, d), level="top", rows=["case_id"]))


@query("closeness_top1")
def q_closeness_top1(spark, d):
    return finalize(H.closeness(joined(spark, d), fx.taxonomy(spark, d), mode="top1", rows=["case_id"]))


@query("closeness_all")
def q_closeness_all(spark, d):
    return finalize(H.closeness(joined(spark, d), fx.taxonomy(spark, d), mode="all", rows=["case_id"]))
