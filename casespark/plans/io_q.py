"""Source/sink, streaming and user-function queries.  Inputs that the reference
reads as files (CSV, JSON, text lists, code maps, response logs) are first
derived from the given tables by Spark and written to the shared scratch folder."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from casespark.functions.columns import render_list, ts_text
from casespark.operators import udf as U
from casespark.plans.registry import query
from casespark.plans.tables import parts
from casespark.session import release_shuffles
from casespark.sources import fixtures as fx
from casespark.sources import readers as IO
from casespark.streaming.ingest import LOG_SCHEMA, ingest_responses, maintain_valid, valid_responses

DIAG_SCHEMA = "hadm_id long, seq_num int, icd_code string, icd_version int, priority string, icd9code string, diagnosisstring string"


@query("scan_typed_csv")
def q_scan_typed_csv(spark, d):
    path = IO.scratch(spark, "diag-csv")
    fx.diagnoses(spark, d).write.option("header", True).option("compression", "gzip").csv(path)
    return IO.scan_typed_csv(spark, path, DIAG_SCHEMA)


@query("parse_times")
def q_parse_times(spark, d):
    e = fx.encounters(spark, d).select(
        "hadm_id", ts_text("admittime").alias("admittime"),
        F.when(F.col("hadm_id") % 7 == 0, F.lit("not a time")).otherwise(ts_text("dischtime"))
        .alias("dischtime"))
    p = IO.parse_times(e, ["admittime", "dischtime"])
    return p.select("hadm_id", ts_text("admittime", 16).alias("admit_min"), ts_text("dischtime", 16).alias("disch_min"))


def _log_json(spark, d, multiline, auto=False):
    path = IO.scratch(spark, "log-json")
    if multiline:
        log = fx.responses(spark, d, parts(spark, d, ("lineitem",)))
        IO.write_json_array(log.where("line_no IS NOT NULL"), path)
    else:
        fx.responses(spark, d).write.json(path)
    return IO.read_json_or_lines(spark, path, LOG_SCHEMA, None if auto else multiline)


@query("read_json_lines")
def q_read_json_lines(spark, d):
    return _log_json(spark, d, False).select("case_id", "round", "line_no", F.length("response").alias("n_chars"))


@query("read_json_array")
def q_read_json_array(spark, d):
    return _log_json(spark, d, True).select("case_id", "round", "line_no", F.length("response").alias("n_chars"))


@query("read_json_or_lines")
def q_read_json_or_lines(spark, d):
    """Format detected from the file (here a JSON array per file)."""
    return _log_json(spark, d, True, auto=True).select("case_id", "round", "line_no", F.length("response").alias("n_chars"))


@query("decode_list_text")
def q_decode_list_text(spark, d):
    p = fx.case_preds(spark, d)
    cid = F.col("case_id")
    txt = (F.when(cid % 13 == 0, F.lit(None).cast("string")).when(cid % 17 == 0, F.lit("nan"))
           .when(cid % 19 == 0, F.element_at("ranked", 1))
           .when(F.size("final") == 0, F.lit("[]"))
           .otherwise(F.concat(F.lit("['"), F.array_join("final", "', '"), F.lit("']"))))
    t = p.select("case_id", "round", txt.alias("valid_prediction"))
    out = IO.decode_list_text(t, "valid_prediction")
    return out.select("case_id", "round", render_list("valid_prediction").alias("codes"),
                      F.size("valid_prediction").cast("long").alias("n"))


@query("parse_case_list")
def q_parse_case_list(spark, d):
    path = IO.scratch(spark, "case-list")
    e = fx.encounters(spark, d)
    e.select(F.concat_ws(" ", "subject_id", "hadm_id", F.coalesce(F.col("stay_id"), F.lit(0))).alias("value")).write.text(path)
    return IO.parse_case_list(spark, path)


@query("parse_code_map")
def q_parse_code_map(spark, d):
    path = IO.scratch(spark, "code-map")
    m = fx.diagnoses(spark, d).groupBy("icd_code").agg(F.array_sort(F.collect_set("diagnosisstring")).alias("paths"))
    m.select(F.concat(F.col("icd_code"), F.lit(": "), F.array_join("paths", "; ")).alias("value")).write.text(path)
    return IO.parse_code_map(spark, path)


@query("write_tables")
def q_write_tables(spark, d):
    path = IO.scratch(spark, "labels-parquet")
    lab = fx.case_labels(spark, d).select("case_id", render_list("labels").alias("labels"), "top1")
    # folders by the code's three-character class, whose number is bounded; one a code would be a folder for each leaf
    IO.write_tables(lab.withColumn("top1_class", F.substring("top1", 1, 3)), path, "parquet", partition_by=["top1_class"])
    return spark.read.schema("case_id long, labels string, top1 string").parquet(path).select("case_id", "labels", "top1")


@query("key_coverage")
def q_key_coverage(spark, d):
    from casespark.plans.cohort_q import sampled_ids
    tables = {"diagnoses": fx.diagnoses(spark, d), "labs": fx.labs_text(spark, d), "micro": fx.micro(spark, d),
              "notes": fx.notes(spark, d), "reports": fx.reports(spark, d)}
    return IO.key_coverage(tables, "hadm_id", sampled_ids(spark, d))


@query("ingest_responses")
def q_ingest_responses(spark, d):
    """Stream the response log in many arrivals, out of order, and return the valid table (= batch result)."""
    base = IO.scratch(spark, "ingest")
    log = fx.responses(spark, d)
    part = (F.lit(3) - F.floor(F.col("line_no") % 4)).cast("int")
    # the source takes the oldest files first; plain text of the log would be many times the tables that it is made of
    log.withColumn("part", part).write.partitionBy("part").option("compression", "gzip").json(f"{base}/in")
    release_shuffles(spark)
    ingest_responses(spark, f"{base}/in/*", f"{base}/out", f"{base}/log-chk", max_files_per_trigger=16).awaitTermination()
    maintain_valid(spark, f"{base}/out", f"{base}/valid-chk").awaitTermination()
    release_shuffles(spark)
    return valid_responses(spark, f"{base}/valid-chk").select(
        "case_id", "round", "line_no", "method", render_list("ranked").alias("ranked"), render_list("final").alias("final"))


def _demo_model(prompt: str) -> str:
    """Deterministic stand-in for a chat model: a leaf code chosen by the prompt's md5;
    fails for digests starting with 'f' (exercises retries and the failure table)."""
    h = hashlib.md5(prompt.encode("utf-8")).hexdigest()
    if h[0] == "f":
        raise RuntimeError("service unavailable")
    code = f"{(int(h[:8], 16) % 40) * 25:05d}"
    return '{"top10": ["%s"], "predictions": ["%s"]}' % (code, code)


def _scored(spark, d):
    from casespark.plans.text_q import case_inputs
    from casespark.operators.render import assemble_input
    c = case_inputs(spark, d)
    cases = c.select(F.col("hadm_id").alias("case_id"), assemble_input(c, "lab").alias("prompt"))
    return U.score_cases(cases, _demo_model, attempts=3)


@query("score_cases")
def q_score_cases(spark, d):
    scored, _ = _scored(spark, d)
    return scored.select("case_id", "response", "attempts")


@query("score_cases_failed")
def q_score_cases_failed(spark, d):
    _, failed = _scored(spark, d)
    return failed.select("case_id", "attempts", "error")
