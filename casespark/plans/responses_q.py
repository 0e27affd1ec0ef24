"""Response-log queries: reasoning split, JSON repair, extraction profiles,
de-duplication, self-consistency and extraction reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from casespark.functions.columns import render_list
from casespark.operators import responses as RS
from casespark.operators.vocab import valid_codes_only
from casespark.plans.registry import query
from casespark.plans.tables import written
from casespark.sources import fixtures as fx

RUN = ["round"]


def extracted(spark, d, profile="one_match"):
    return RS.extract_responses(fx.responses(spark, d), profile=profile, ranked_key="top10")


def extracted_written(spark, d, profile="one_match"):
    """The extraction, run once and written: de-duplication, vocabulary and reports read it several times."""
    return written(spark, d, f"extracted_{profile}", lambda: extracted(spark, d, profile).select(
        "case_id", "round", "line_no", "status", "method", "ranked", "final"), sources=("lineitem",))


def valid_dedup(spark, d, profile="one_match"):
    keep = "first" if profile == "one_match" else "last"
    every = extracted_written(spark, d, profile)
    v = RS.dedup_valid(every, keep=keep, by=RUN)
    return valid_codes_only(v, fx.vocab(spark, d), "final", out="valid", errors="n_error", rows=[*RUN, "case_id"], among=every)


@query("split_reasoning")
def q_split_reasoning(spark, d):
    log = fx.responses(spark, d)
    reasoning, answer = RS.split_reasoning(F.col("response"))
    return log.select("case_id", "round", "line_no", reasoning.alias("reasoning"), answer.alias("answer"))


@query("repair_json")
def q_repair_json(spark, d):
    log = fx.responses(spark, d)
    greedy = F.regexp_extract("response", RS.GREEDY, 0)
    return log.select("case_id", "round", "line_no", RS.repair_json(greedy).alias("repaired"),
                      RS.valid_json(RS.repair_json(greedy)).alias("is_valid"))


def _flat(df):
    return df.select("case_id", "round", "line_no", "status", "method",
                     F.coalesce(render_list("ranked"), F.lit("")).alias("ranked"),
                     F.coalesce(render_list("final"), F.lit("")).alias("final"))


@query("extract_responses")
def q_extract_responses(spark, d):
    return _flat(extracted(spark, d, "one_match"))


@query("extract_responses_last")
def q_extract_responses_last(spark, d):
    return _flat(extracted(spark, d, "last_match"))


@query("code_of_item")
def q_code_of_item(spark, d):
    items = F.regexp_extract_all(F.regexp_extract("response", r"(?s)\*\*top10\*\*:\s*\[(.*?)\]", 1), F.lit(r'"([^"]+)"'), 1)
    log = fx.responses(spark, d).select("case_id", "round", "line_no", items.alias("items")).filter(F.size("items") > 0)
    return log.select("case_id", "round", "line_no", render_list(RS.code_of_item("items")).alias("codes"))


@query("is_ranked_prefix")
def q_is_ranked_prefix(spark, d):
    v = valid_dedup(spark, d)
    return v.select("case_id", "round", RS.is_ranked_prefix("ranked", "final").alias("all_match"),
                    (F.slice("final", 1, 1) == F.slice("ranked", 1, 1)).alias("first_match"))


@query("dedup_valid")
def q_dedup_valid(spark, d):
    v = valid_dedup(spark, d, "last_match")
    return v.select("case_id", "round", "line_no", render_list("ranked").alias("ranked"), render_list("valid").alias("valid"),
                    "n_error")


@query("self_consistency")
def q_self_consistency(spark, d):
    return RS.self_consistency(valid_dedup(spark, d), by=RUN)


@query("extraction_report")
def q_extraction_report(spark, d):
    return RS.extraction_report(extracted_written(spark, d), valid_dedup(spark, d), by=RUN)
