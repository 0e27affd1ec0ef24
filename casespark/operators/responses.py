"""Free-text model responses -> ranked and final code lists, as a whole-table
job of JVM-side regex and JSON functions (no per-row Python).

Two extraction profiles follow the two evaluation paths of the reference:

* ``one_match`` (set 1): fenced ```json block -> non-greedy ``{…}`` -> bold
  markdown lists; exactly one JSON candidate is accepted, no repair.
* ``last_match`` (set 2): fenced block -> whole text -> last one-line object ->
  greedy ``{…}`` (repaired first) -> first balanced object -> non-greedy ``{…}``; the last candidate
  wins and a failed parse is retried after repair.

Every candidate is parsed once, strictly (comments, trailing commas and trailing
text are invalid) and with the declared schema, so validity and the two lists come
from the same pass.  Nesting and length of an answer are not limited.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casespark.functions.columns import let

# Extraction and repair patterns.
FENCED = r"(?s)```json\n(.*?)\n```"
NONGREEDY = r"(?s)\{.*?\}"
GREEDY = r"(?s)\{.*\}"
COMMENT = r"//[^\n]*"
BARE_CODE = r"([A-Z]\d{1,3}\.?\d*)(,|\s*[\]\}])"
TRAILING_COMMA = r",(\s*[\]\}])"
BLANKS = r"\s+"
AROUND_PUNCTUATION = r"\s*([,\[\]{}:])\s*"
#: what the depth automaton reads: an escaped character, a quote, a brace, or a run of anything else
BRACE_TOKENS = r"(?s)\\.|[\"{}]|[^\\\"{}]+|\\"


def _c(c):
    return F.col(c) if isinstance(c, str) else c


WHITESPACE = " \t\n\x0b\x0c\r"      # the characters of \s


def strip_ws(c) -> Column:
    """str.strip() on ASCII whitespace, without a regex."""
    return F.btrim(_c(c), F.lit(WHITESPACE))


_NO_LIMIT = str(2**31 - 1)
_STRICT = {"allowSingleQuotes": "false", "allowComments": "false", "allowUnquotedFieldNames": "false", "mode": "PERMISSIVE",
           "maxNestingDepth": _NO_LIMIT, "maxStringLen": _NO_LIMIT, "maxNumLen": _NO_LIMIT}
_END = '{"__end":true}'             # closes the array around a candidate: whatever follows the value shows


def valid_json(c) -> Column:
    """Strict JSON text holding exactly one value: with the closing mark it parses as an array of two (trailing
    data, comments, trailing commas, bare words fail)."""
    both = F.from_json(F.concat(F.lit("["), _c(c), F.lit("," + _END + "]")), "array<string>", _STRICT)
    return F.coalesce((F.size(both) == 2) & (F.get(both, F.lit(1)) == _END), F.lit(False))


#: what a JSON value begins with (Spark reads NaN, INF and Infinity as numbers)
_VALUE_BEGINS = r'^(?:[\[{"+\-0-9tfn]|NaN|I[nN])'


def parse_object(c, ranked_key: str) -> Column:
    """The two lists of a candidate as a struct; NULL unless the text is one strict JSON object.

    Other members are read over without being built, however deep they nest."""
    schema = f"array<struct<__end:boolean,`{ranked_key}`:array<string>,predictions:array<string>>>"
    return F.element_at(F.transform(
        F.array(F.from_json(F.concat(F.lit("["), _c(c), F.lit("," + _END + "]")), schema, _STRICT)),
        lambda both: F.when((F.size(both) == 2) & F.get(both, F.lit(1))["__end"],
                            F.get(both, F.lit(0)))), 1)


def balanced_object(c) -> Column:
    """Object from the first opening brace to the one that closes it, or NULL.

    A fold over brace and quote tokens counts the depth; braces inside strings do not count, an escaped character
    counts for nothing.  One pass, any depth."""
    text = F.substring(_c(c), F.instr(_c(c), "{"), F.length(_c(c)))
    tokens = F.regexp_extract_all(text, F.lit(BRACE_TOKENS), 0)

    def step(acc: Column, token: Column) -> Column:
        at = acc["at"] + F.length(token)
        live = (acc["end"] == 0) & ~acc["quoted"]
        return F.struct(
            at.alias("at"),
            F.when(live & (token == "{"), acc["depth"] + 1).when(live & (token == "}"), acc["depth"] - 1).otherwise(acc["depth"]).alias("depth"),
            F.when(token == '"', ~acc["quoted"]).otherwise(acc["quoted"]).alias("quoted"),
            F.when(live & (token == "}") & (acc["depth"] == 1), at).otherwise(acc["end"]).alias("end"))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("end"))
    end = F.aggregate(tokens, start, step, lambda acc: acc["end"])
    return F.when(F.instr(_c(c), "{") > 0, let(end, lambda n: F.when(n > 0, F.substring(text, F.lit(1), n))))


# --------------------------------------------------------------------- SC25
def repair_json(c) -> Column:
    """Drop // comments, quote bare codes, drop trailing commas, squeeze blanks."""
    x = F.regexp_replace(_c(c), COMMENT, "")
    x = F.regexp_replace(x, BARE_CODE, "\"$1\"$2")
    x = F.regexp_replace(x, TRAILING_COMMA, "$1")
    x = F.regexp_replace(x, BLANKS, " ")
    return F.regexp_replace(x, AROUND_PUNCTUATION, "$1")


# --------------------------------------------------------------------- SC18 / SC19 / SC20
def code_of_item(arr, strip: bool = True) -> Column:
    """'code:description' -> 'code' for every item."""
    return F.transform(_c(arr), lambda x: strip_ws(F.split(x, ":", 2)[0]) if strip else F.split(x, ":", 2)[0])


def is_ranked_prefix(ranked, final) -> Column:
    """final equals the first len(final) items of ranked."""
    return F.slice(_c(ranked), 1, F.greatest(F.size(_c(final)), F.lit(0))) == _c(final)


def split_reasoning(c) -> tuple[Column, Column]:
    """(reasoning, answer): text after the first <think> up to the next tag (or the end), and the response
    without that closed block, stripped; no <think> -> ('No reasoning found', response)."""
    has = _c(c).contains("<think>")
    inner = F.split(F.try_element_at(F.split(_c(c), "<think>"), F.lit(2)), "</think>")[0]
    whole = F.concat(F.lit("<think>"), inner, F.lit("</think>"))
    reasoning = F.when(has, inner).otherwise(F.lit("No reasoning found"))
    answer = F.when(has, strip_ws(F.replace(_c(c), whole, F.lit("")))).otherwise(_c(c))
    return reasoning, answer


# --------------------------------------------------------------------- SC24
def extract_responses(log: DataFrame, profile: str = "one_match", ranked_key: str = "top10",
                      response: str = "response") -> DataFrame:
    """Adds status ('valid'/'invalid'), method, ranked[], final[] to every log row."""
    r = F.col(response)
    fenced = F.regexp_extract_all(r, F.lit(FENCED), 1)
    if profile == "one_match":
        braces = F.regexp_extract_all(r, F.lit(NONGREEDY), 0)
        cand = F.when(F.size(fenced) > 0, fenced).when(F.size(braces) > 0, braces)
        method = F.when(F.size(fenced) > 0, "fenced").when(F.size(braces) > 0, "braces")
        md_top = F.regexp_extract(r, rf"(?s)\*\*{ranked_key}\*\*:\s*\[(.*?)\]", 1)
        md_pred = F.regexp_extract(r, r"(?s)\*\*predictions\*\*:\s*\[(.*?)\]", 1)
        md_ok = r.rlike(rf"(?s)\*\*{ranked_key}\*\*:\s*\[(.*?)\]") & r.rlike(r"(?s)\*\*predictions\*\*:\s*\[(.*?)\]")
        md_r = F.regexp_extract_all(md_top, F.lit(r'"([^"]+)"'), 1)
        md_p = F.regexp_extract_all(md_pred, F.lit(r'"([^"]+)"'), 1)
        x = log.withColumn("_cand", cand).withColumn("_method", method)
        parsed = F.when(F.size("_cand") == 1, parse_object(F.col("_cand")[0], ranked_key))
        use_md = F.col("_cand").isNull() & md_ok & (F.size(md_r) > 0) & (F.size(md_p) > 0)
        x = x.withColumn("_p", parsed)
        ranked = F.when(use_md, md_r).otherwise(F.col(f"_p.{ranked_key}"))
        final = F.when(use_md, md_p).otherwise(F.col("_p.predictions"))
        method = F.when(use_md, F.lit("markdown")).otherwise(F.col("_method"))
        x = x.withColumn("_r", ranked).withColumn("_f", final).withColumn("method", method)
        ok = (F.size(F.coalesce("_r", F.array())) > 0) & (F.size(F.coalesce("_f", F.array())) > 0)
        return (x.withColumn("status", F.when(ok, "valid").otherwise("invalid"))
                .withColumn("ranked", F.when(ok, code_of_item("_r", strip=False)))
                .withColumn("final", F.when(ok, code_of_item("_f", strip=False)))
                .drop("_cand", "_method", "_p", "_r", "_f"))
    # ----- last_match profile: every intermediate is its own column so each pattern runs and each candidate is parsed
    # once; later steps are only evaluated for rows the earlier steps did not settle
    def fixed_first(candidate: str) -> Column:
        return F.coalesce(parse_object(repair_json(candidate), ranked_key), parse_object(candidate, ranked_key))

    def fixed_last(candidate: str) -> Column:
        return F.coalesce(parse_object(candidate, ranked_key), parse_object(repair_json(candidate), ranked_key))

    x = log.withColumn("_fenced", fenced)
    no_fence = F.size("_fenced") == 0
    x = x.withColumn("_stripped", F.when(no_fence, strip_ws(r)))
    object_like = F.col("_stripped").startswith("{")
    x = x.withColumn("_whole", F.when(object_like, parse_object("_stripped", ranked_key)))
    # a whole text that is JSON but no object ends the search, without lists
    x = x.withColumn("_other", F.when(
        no_fence & ~object_like & F.col("_stripped").rlike(_VALUE_BEGINS), valid_json("_stripped")).otherwise(F.lit(False)))
    need_lines = no_fence & F.col("_whole").isNull() & ~F.col("_other")
    lines = F.filter(F.transform(F.split(r, "\n"), lambda l: strip_ws(l)), lambda l: l.startswith("{") & l.endswith("}") &
                     (l != F.col("_stripped")))                      # the whole text has failed before
    x = x.withColumn("_line", F.when(need_lines, F.try_element_at(F.filter(
        F.transform(lines, lambda l: parse_object(l, ranked_key)), lambda p: p.isNotNull()), F.lit(-1))))
    need_g = need_lines & F.col("_line").isNull()
    x = x.withColumn("_greedy", F.when(need_g, F.regexp_extract(r, GREEDY, 0)))
    x = x.withColumn("_gp", F.when(F.col("_greedy") != "", fixed_first("_greedy")))
    need_b = need_g & F.col("_gp").isNull()
    x = x.withColumn("_bal", F.when(need_b, balanced_object(r)))
    x = x.withColumn("_bp", F.when(F.col("_bal").isNotNull(), fixed_first("_bal")))
    need_n = need_b & F.col("_bp").isNull()
    x = x.withColumn("_last", F.when(~no_fence, F.try_element_at("_fenced", F.lit(-1))).when(
        need_n, F.try_element_at(F.regexp_extract_all(r, F.lit(NONGREEDY), 0), F.lit(-1))))
    x = x.withColumn("_lp", F.when(F.col("_last").isNotNull(), fixed_last("_last")))
    steps = [(~no_fence, "_lp", "fenced"), (F.col("_other") | F.col("_whole").isNotNull(), "_whole", "whole"),
             (F.col("_line").isNotNull(), "_line", "line"), (F.col("_gp").isNotNull(), "_gp", "greedy"),
             (F.col("_bp").isNotNull(), "_bp", "balanced"), (F.col("_last").isNotNull(), "_lp", "braces")]
    parsed, method = F.when(steps[0][0], F.col(steps[0][1])), F.when(steps[0][0], F.lit(steps[0][2]))
    for condition, column, name in steps[1:]:
        parsed, method = parsed.when(condition, F.col(column)), method.when(condition, F.lit(name))
    x = x.withColumn("method", method).withColumn("_p", parsed)
    ok = (F.size(F.coalesce(F.col(f"_p.{ranked_key}"), F.array())) > 0) & \
         (F.size(F.coalesce(F.col("_p.predictions"), F.array())) > 0)
    return (x.withColumn("status", F.when(ok, "valid").otherwise("invalid"))
            .withColumn("ranked", F.when(ok, code_of_item(f"_p.{ranked_key}")))
            .withColumn("final", F.when(ok, code_of_item("_p.predictions")))
            .drop("_fenced", "_stripped", "_whole", "_other", "_line", "_greedy", "_gp", "_bal", "_bp", "_last", "_lp", "_p"))


def dedup_valid(extracted: DataFrame, key: str = "case_id", order: str = "line_no", keep: str = "first",
                by: list[str] | None = None) -> DataFrame:
    """Valid rows, one per case (first or last in log order)."""
    # no filter on the derived status before the aggregate: Catalyst would push it below the
    # extraction projection and inline the whole regex/JSON cascade into the predicate.
    # Invalid rows get a NULL ordering instead, which min_by/max_by skip.
    keys = [*(by or []), key]
    row = F.struct(F.col(order), F.col("method"), F.col("ranked"), F.col("final"))
    ordk = F.when(F.col("status") == "valid", F.col(order))
    pick = (F.max_by if keep == "last" else F.min_by)(row, ordk)
    g = extracted.groupBy(*keys).agg(pick.alias("_r"))
    return g.filter(F.col("_r").isNotNull()).select(*keys, "_r.*")


# --------------------------------------------------------------------- MT25 / MT26
def self_consistency(valid: DataFrame, by: list[str] | None = None) -> DataFrame:
    all_match = is_ranked_prefix("ranked", "final")
    first = F.slice("final", 1, 1) == F.slice("ranked", 1, 1)
    agg = [F.count(F.lit(1)).alias("n_valid"), F.count_if(all_match).alias("n_all_match"),
           F.count_if(first).alias("n_first_match")]
    return valid.groupBy(*by).agg(*agg) if by else valid.agg(*agg)


def extraction_report(extracted: DataFrame, vocab_valid: DataFrame, by: list[str] | None = None,
                      key: str = "case_id") -> DataFrame:
    """Totals: log rows, valid, invalid, duplicated valid rows, markdown extractions,
    valid after de-duplication, wrong codes and cases with wrong codes.
    ``vocab_valid``: de-duplicated valid rows with an ``n_error`` column."""
    by = by or []
    e = extracted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("log_rows"), F.count_if(F.col("status") == "valid").alias("valid"),
        F.count_if(F.col("status") == "invalid").alias("invalid"),
        F.count_if((F.col("status") == "valid") & (F.col("method") == "markdown")).alias("markdown"),
        (F.count_if(F.col("status") == "valid") - F.count_distinct(F.when(F.col("status") == "valid", F.col(key))))
        .alias("duplicate_valid_rows"))
    v = vocab_valid.groupBy(*by).agg(F.count(F.lit(1)).alias("valid_dedup"), F.sum("n_error").alias("error_codes"),
                                     F.count_if(F.col("n_error") > 0).alias("error_cases"))
    if by:
        j = e.join(v, by, "left")          # both sides: one row per run
    else:
        from casespark.operators.report import combine_rows
        j = combine_rows(e, v)
    items = ["log_rows", "valid", "invalid", "duplicate_valid_rows", "markdown", "valid_dedup", "error_codes", "error_cases"]
    long = F.explode(F.array(*[F.struct(F.lit(i).alias("item"), F.coalesce(F.col(i), F.lit(0)).cast("long").alias("n"))
                               for i in items]))
    return j.select(*by, long.alias("x")).select(*by, "x.item", "x.n")
