"""URL filter: host and path rules, and logistic regression on hashed character n-grams (DataFrame operations only).

Each distinct (host, path) is judged once.  Rules are found by equi joins: a site asks with every parent of its host
and every prefix of its path that has the length of some rule's path, so neither a long rule list nor a frequent
host multiplies rows.  What no rule decides goes to a logistic regression trained from a small labelled URL table.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casespark.llm.shared import Scratch

NGRAMS, FEATURES = (3, 4, 5), 1 << 14


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(_rest(url), r"(?s)^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    return F.when(at > 0, F.substr(u, at + F.lit(3))).otherwise(F.lit(""))


def ngrams(host: str, path: str) -> Column:
    """Character n-grams of ``^host$`` and ``^path$``, marked by where they come from."""
    parts = [f"transform(sequence(1, greatest(length({c}) + 3 - {n}, 1)), i -> concat('{mark}', substr(concat('^', {c}, '$'), i, {n})))"
             for mark, c in (("h:", host), ("p:", path)) for n in NGRAMS]
    return F.expr(f"concat({', '.join(parts)})")


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "block") -> PipelineModel:
    """Model from rows (url, 0/1); rows with a null are skipped, and without any row nothing is blocked."""
    rows = labelled.where(F.col(url_col).isNotNull() & F.col(label_col).isNotNull()).select(
        host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"),
        F.col(label_col).cast("double").alias("label")).select(ngrams("host", "path").alias("grams"), "label").coalesce(1)
    if rows.isEmpty():                                         # the labelled table is small
        rows = rows.sparkSession.createDataFrame([([], 0.0)], "grams array<string>, label double")
    return Pipeline(stages=[
        HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True),
        LogisticRegression(regParam=0.01, maxIter=50),
    ]).fit(rows)


def matched_rules(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the sites that some rule fits; the longest rule wins, then the first by name, then allow."""
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]  # no more than the longest path
    asked = (sites.where("host <> ''")
             .withColumn("labels", F.split("host", r"\."))
             .withColumn("parent", F.explode(F.expr(
                 "transform(sequence(1, size(labels)), i -> concat_ws('.', slice(labels, i, size(labels) - i + 1)))")))
             .withColumn("length", F.explode(F.array(*[F.lit(n) for n in sorted(lengths)]) if lengths else F.array().cast("array<int>")))
             .where("length(path) >= length")
             .select("host", "path", "parent", F.expr("substr(path, 1, length)").alias("start")))
    known = rules.select(F.col("host").alias("parent"), F.col("path").alias("start"), "verdict")
    return (asked.join(known, ["parent", "start"])
            .groupBy("host", "path")
            .agg(F.min(F.struct(-F.length(F.concat("parent", "start")).alias("n"), F.concat("parent", "start").alias("rule"),
                                "verdict")).alias("best"))
            .select("host", "path", "best.rule", "best.verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, labelled: DataFrame, id_col: str = "page_id",
                url_col: str = "url") -> DataFrame:
    """One row per input row: ``id_col, host, path, rule, verdict``.

    Null urls and those without ``://`` have an empty host and path, which no rule fits and which show the regression
    nothing: they are allowed.
    Repeated rows and ids are judged row by row; an empty table gives an empty result; other columns are ignored.
    A rule (host, path, verdict) fits its host and all subdomains where the path begins with the rule's.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    sites = rows.select("host", "path").distinct()
    ruled = sites.join(matched_rules(sites, rules), ["host", "path"], "left")
    judged = train(labelled).transform(ruled.where("verdict IS NULL").withColumn("grams", ngrams("host", "path")))
    verdicts = scratch.table(
        ruled.where("verdict IS NOT NULL").select("host", "path", "rule", "verdict").unionByName(
            judged.select("host", "path", "rule", F.when((F.col("prediction") > 0.5) & (F.col("host") != ""), "block").otherwise("allow").alias("verdict"))),
        "verdicts")
    return rows.join(verdicts, ["host", "path"]).select(F.col("id").alias(id_col), "host", "path", "rule", "verdict")
