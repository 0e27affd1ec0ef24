"""Text projection: note sections, report clean-up, table rendering, prompt
assembly and token estimates.

All regexes run JVM-side on whole texts (``(?s)`` where a section spans lines).
Per-case text is assembled from an ordered ``collect_list`` whose length is
bounded by construction (one row per lab item after the first-per-item
reduction, at most ``n`` microbiology rows, one row per field).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NL = "\n"

# Section headings of discharge notes (start, end, mode).
NOTE_SECTIONS = [
    ("hpi", "History of Present Illness:\n", "Past Medical History:", "first"),
    ("past_medical_history", "Past Medical History:\n", "Social History:", "first"),
    ("physical_exam", "Physical Exam:\n", "Pertinent Results:", "first"),
    ("diagnosis", "Discharge Diagnosis:", "Discharge Condition:", "all"),
]

# Antibiotic sensitivity words.
SENSITIVITY = {"S": "sensitive", "I": "intermediate", "R": "resistant", "P": "pending", "NaN": "NaN"}

# Field lists per task.
TASK_FIELDS = {
    "lab": ["lab"],
    "lab+": ["lab", "ed_info", "family_history", "ed_chiefcomplaint", "past_medical_history"],
    "lab_num": ["lab", "ed_info"],
    "lab_text": ["lab", "family_history", "ed_chiefcomplaint"],
    "lab_num+": ["lab", "ed_info", "micro_info"],
    "lab_text+": ["lab", "family_history", "ed_chiefcomplaint", "past_medical_history"],
    "all": ["lab", "ed_info", "family_history", "ed_chiefcomplaint", "past_medical_history", "physical_text", "report"],
}

TOKEN = r"\w+|[^\w\s]"
TOKEN_WITH_SPACE = r"\s*(?:\w+|[^\w\s])"


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python-style strip(): leading and trailing whitespace of any kind (trim() only drops spaces)."""
    return F.btrim(_c(c), F.lit(" \t\n\x0b\x0c\r"))


def _quote(s: str) -> str:
    import re
    return re.escape(s).replace("\\\n", "\\n").replace("\n", "\\n")


# --------------------------------------------------------------------- SC1 / SC2 / SC3
def section(text, start: str, end: str, mode: str = "first") -> Column:
    """Text between two headings; first match stripped (missing -> 'None'), or all
    matches stripped and joined by ', ' (end is a look-ahead)."""
    pat = f"(?s){_quote(start)}(.*?)(?={_quote(end)})"
    if mode == "first":
        return F.when(_c(text).rlike(pat), strip_ws(F.regexp_extract(_c(text), pat, 1))).otherwise(F.lit("None"))
    found = F.regexp_extract_all(_c(text), F.lit(pat), 1)
    return F.concat_ws(", ", F.transform(found, lambda x: strip_ws(x)))


def note_sections(notes: DataFrame, spec=NOTE_SECTIONS, key: str = "note_id", text: str = "text") -> DataFrame:
    """Long form: key, section, text."""
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("section"), section(text, s, e, m).alias("value"))
                               for name, s, e, m in spec]))
    return notes.select(key, rows.alias("x")).select(key, "x.section", F.col("x.value").alias("text"))


def before_word(c, word: str = "discharge") -> Column:
    """Cut at the first case-insensitive occurrence of ``word``."""
    pos = F.instr(F.lower(_c(c)), word.lower())
    return F.when(pos > 0, _c(c).substr(F.lit(1), pos - 1)).otherwise(_c(c))


def strip_findings(c) -> Column:
    """Delete every 'FINDINGS:' block up to (not including) the next 'IMPRESSION:'."""
    return F.regexp_replace(_c(c), r"(?s)FINDINGS:.*?(?=IMPRESSION:)", "")


# --------------------------------------------------------------------- SC4 / SC5 / SC6 / SC10
def _num_text(c) -> Column:
    return F.coalesce(F.round(_c(c), 6).cast("string"), F.lit("nan"))


def _txt(c) -> Column:
    return F.coalesce(_c(c).cast("string"), F.lit("nan"))


# Fixed value.
LAB_HEADER = "labevents name,measurement fluid,measurement category,value,valueuom,lower_bound,upper_bound"


def render_lab_table(labs: DataFrame, key: str = "hadm_id", order=("charttime", "labevent_id")) -> DataFrame:
    """One text per case: prefix, header and one CSV line per lab row (in time order);
    'Beta-2' -> 'Beta-two'."""
    line = F.concat_ws(",", _txt("label"), _txt("fluid"), _txt("category"), _num_text("value"), _txt("valueuom"),
                       _num_text("ref_range_lower"), _num_text("ref_range_upper"))
    g = labs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[F.col(o) for o in order], line.alias("l")))).alias("_ls"))
    body = F.concat_ws(NL, F.transform("_ls", lambda s: s["l"]))
    text = F.concat(F.lit("The following lab tests are available for the patient:\n" + LAB_HEADER + NL), body, F.lit(NL))
    return g.select(key, F.replace(text, F.lit("Beta-2"), F.lit("Beta-two")).alias("lab"))


# Fixed value.
VITALS_HEADER = ("gender,age approximation,temperature,heartrate,resprate,oxygen saturation,"
                 "systolic blood pressure,diastolic blood pressure,pain level")


def render_vitals(stay: DataFrame, key: str = "hadm_id") -> DataFrame:
    """Header + one line: demographics and first triage vitals; missing -> 'nan'."""
    line = F.concat_ws(",", _txt("gender"), _txt("anchor_age"), _num_text("temperature"), _num_text("heartrate"),
                       _num_text("resprate"), _num_text("o2sat"), _num_text("sbp"), _num_text("dbp"), _txt("pain"))
    return stay.select(key, F.concat(F.lit("The ED info:\n" + VITALS_HEADER + NL), line, F.lit(NL)).alias("ed_info"))


# Fixed value.
MICRO_HEADER = "test name,used specimen,grew organism,test antibiotic,antibiotic sensitivity,Comments"


def render_micro(micro: DataFrame, key: str = "hadm_id", n: int = 15, order=("charttime", "microevent_id")) -> DataFrame:
    """At most n rows per case; NULL -> 'NaN'; sensitivity code -> word."""
    from pyspark.sql import Window
    sens = F.create_map(*[x for k, v in SENSITIVITY.items() for x in (F.lit(k), F.lit(v))])

    def t(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("NaN"))
    line = F.concat_ws(",", t("test_name"), t("spec_type_desc"), t("org_name"), t("ab_name"),
                       F.element_at(sens, t("interpretation")), t("comments"))
    w = Window.partitionBy(key).orderBy(*order)
    top = micro.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)   # WindowGroupLimit: partial top-n
    g = top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_rn", line.alias("l")))).alias("_ls"))
    text = F.concat(F.lit("The microbiology tests for the patient:\n" + MICRO_HEADER + NL),
                    F.concat_ws(NL, F.transform("_ls", lambda s: s["l"])), F.lit(NL))
    return g.select(key, text.alias("micro_info"))


def labs_as_csv(labs: DataFrame, key: str = "patientunitstayid",
                cols=("labresultoffset", "labname", "labresult", "labmeasurenamesystem"),
                order=("labresultoffset", "labname", "labid"), max_tokens: int | None = None,
                chunk_width: int = 1440) -> DataFrame:
    """SC10: chosen columns as CSV text with header (empty field for NULL).  With
    ``max_tokens`` the text is cut to that many estimated tokens (SC23)."""
    def f(c):
        dt = dict(labs.dtypes)[c]
        v = F.round(F.col(c), 6).cast("string") if dt in ("double", "float") else F.col(c).cast("string")
        return F.coalesce(v, F.lit(""))
    line = F.concat_ws(",", *[f(c) for c in cols])
    rows = labs.select(key, *[F.col(o) for o in order], line.alias("l"))
    if max_tokens is not None:
        # tokens never span a line break, so a line whose preceding lines already use the
        # budget cannot reach the truncated text: drop it before collecting (exact, bounded)
        head = token_count(F.lit("Laboratory test results with timestamps and measurements:\n" + ",".join(cols)))
        rows = rows.withColumn("_t", token_count("l"))
        # keys whose whole text fits the budget skip the running sum (one small aggregate decides)
        fits = rows.groupBy(key).agg(F.sum("_t").alias("_kt")).withColumn("_fits", F.col("_kt") + head < max_tokens)
        rows = rows.join(fits.select(key, "_fits"), key, "inner")
        small = rows.filter("_fits").drop("_fits", "_t")
        big = tokens_before(rows.filter(~F.col("_fits")).drop("_fits"), key, list(order), "_t",
                            F.floor(F.col(order[0]) / F.lit(chunk_width)))
        rows = small.unionByName(big.filter(F.col("_before") + head < max_tokens).drop("_before", "_t"))
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[F.col(o) for o in order], F.col("l")))).alias("_ls"))
    text = F.concat(F.lit("Laboratory test results with timestamps and measurements:\n" + ",".join(cols) + NL),
                    F.concat_ws(NL, F.transform("_ls", lambda s: s["l"])), F.lit(NL))
    if max_tokens is not None:
        text = truncate_tokens(text, max_tokens)
    return g.select(key, text.alias("lab_results"))


def tokens_before(rows: DataFrame, key: str, order: list[str], tokens: str, chunk: Column) -> DataFrame:
    """Running sum of ``tokens`` over the rows before each row of a key, in ``order``.

    Skew-safe two-level prefix sum: ``chunk`` must be monotone in ``order`` (e.g. the
    day of the first order column).  Chunk totals come from a partial aggregate, the
    prefix over chunks is a window over one row per (key, chunk), and the running sum
    inside a chunk is a window partitioned by (key, chunk) -- a hot key is spread over
    its chunks instead of landing in one task."""
    from pyspark.sql import Window
    x = rows.withColumn("_chunk", chunk)
    tot = x.groupBy(key, "_chunk").agg(F.sum(tokens).alias("_ct"))
    wc = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumn("_cb", F.coalesce(F.sum("_ct").over(wc), F.lit(0))).drop("_ct")
    wr = Window.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_rb", F.coalesce(F.sum(tokens).over(wr), F.lit(0)))
    return x.join(tot, [key, "_chunk"], "inner").withColumn("_before", F.col("_cb") + F.col("_rb")) \
        .drop("_chunk", "_cb", "_rb")


# --------------------------------------------------------------------- SC7 / SC8 / SC9 / SC13
def text_or_none(c, prefix: str) -> Column:
    """prefix + value when the value is text, else prefix + 'None'."""
    return F.concat(F.lit(prefix), F.coalesce(_c(c), F.lit("None")))


# Fixed value.
HISTORY_PREFIX = "notes/Progress Notes/Past History/"


def history_items(hist: DataFrame, key: str = "patientunitstayid", order: str = "ord",
                  prefix: str = HISTORY_PREFIX) -> DataFrame:
    """Paths under the prefix, prefix stripped, joined by ', ' in row order."""
    h = hist.filter(F.col("pasthistorypath").startswith(prefix))
    item = F.expr(f"substring(pasthistorypath, {len(prefix) + 1})")
    g = h.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order), item.alias("i")))).alias("_ls"))
    return g.select(key, F.concat(F.lit("Patient's medical history and past conditions: "),
                                  F.concat_ws(", ", F.transform("_ls", lambda s: s["i"]))).alias("past_history"))


def exam_items(exam: DataFrame, key: str = "patientunitstayid", order: str = "ord") -> DataFrame:
    """'<last path segment>: <text>' per row, in brackets."""
    e = exam.filter(F.col("physicalexampath").isNotNull() & (F.col("physicalexampath") != ""))
    item = F.concat(F.element_at(F.split("physicalexampath", "/"), -1), F.lit(": "),
                    F.coalesce(F.col("physicalexamtext"), F.lit("nan")))
    g = e.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order), item.alias("i")))).alias("_ls"))
    return g.select(key, F.concat(F.lit("Physical examination findings and clinical observations: ["),
                                  F.concat_ws(", ", F.transform("_ls", lambda s: s["i"])), F.lit("]")).alias("physical_exam"))


def demographics_text(pat: DataFrame, key: str = "hadm_id") -> DataFrame:
    age = F.when((F.col("age").isNull()) | (F.col("age") == ""), F.lit("nan")).otherwise(F.col("age"))
    return pat.select(key, F.format_string("Patient demographics and basic information: gender: %s, age: %s",
                                           F.coalesce("gender", F.lit("nan")), age).alias("patient_info"))


# --------------------------------------------------------------------- SC12
def diagnosis_struct(diag: DataFrame, key: str = "hadm_id", order: str = "seq_num") -> DataFrame:
    """all / primary / major / other arrays of {name, icd9code, icd10code}; unknown priority -> other."""
    parts = F.split(F.coalesce(F.col("icd9code"), F.lit("")), ", ")
    info = F.struct(F.col("diagnosisstring").alias("name"), F.trim(F.coalesce(F.get(parts, 0), F.lit(""))).alias("icd9code"),
                    F.trim(F.coalesce(F.get(parts, 1), F.lit(""))).alias("icd10code"))
    s = F.struct(F.col(order).alias("o"), info.alias("d"), F.col("priority").alias("p"))
    g = diag.groupBy(key).agg(F.array_sort(F.collect_list(s)).alias("_ls"))

    def pick(cond):
        return F.transform(F.filter("_ls", cond), lambda x: x["d"])
    return g.select(key, pick(lambda x: F.lit(True)).alias("all_diseases"),
                    pick(lambda x: x["p"] == "Primary").alias("primary_diseases"),
                    pick(lambda x: x["p"] == "Major").alias("major_diseases"),
                    pick(lambda x: ~x["p"].isin("Primary", "Major") | x["p"].isNull()).alias("other_diseases"))


# --------------------------------------------------------------------- SC15 / SC16
def hours_between(a, b) -> Column:
    """(b - a) in hours as double; NULL-safe."""
    from casespark.functions.columns import hours_between as _hb
    return _hb(a, b)


def icu_los_days(c) -> Column:
    return _c(c) / F.lit(60.0 * 24)


def study_time(date_col, time_col) -> Column:
    """yyyymmdd + HHMMSS.fff (zero-padded to 10) -> timestamp floored to the minute."""
    txt = F.concat(_c(date_col).cast("string"), F.format_string("%010.3f", _c(time_col)))
    t = F.substring(txt, 1, 12)                      # yyyyMMddHHmm: seconds floored away
    ok = F.try_to_timestamp(t, F.lit("yyyyMMddHHmm")).isNotNull()
    return F.when(ok, F.to_timestamp_ntz(t, F.lit("yyyyMMddHHmm")))


# --------------------------------------------------------------------- SC21 / SC22 / SC23
def token_count(c) -> Column:
    """Token estimate: words and single punctuation marks (BPE not built)."""
    return F.size(F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit(TOKEN), 0))


def truncate_tokens(c, n: int) -> Column:
    """First n estimated tokens of the text, original spacing kept."""
    pieces = F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit(TOKEN_WITH_SPACE), 0)
    return F.when(F.size(pieces) > n, F.array_join(F.slice(pieces, 1, n), "")).otherwise(_c(c))


def assemble_input(case: DataFrame, task: str) -> Column:
    """'\\n' + field for every field of the task; list fields become a report block."""
    parts = []
    for f in TASK_FIELDS[task]:
        dt = dict(case.dtypes)[f]
        v = F.col(f)
        if dt.startswith("array"):
            v = F.concat(F.lit("The report info:\n"), F.array_join(v, "\n---\n"))
        parts.append(F.concat(F.lit(NL), F.coalesce(v, F.lit("None"))))
    return F.concat(*parts)


def assemble_prompt(cases: DataFrame, templates: DataFrame, task: str, key: str = "case_id") -> DataFrame:
    """Every case under every template variant: the variant names are exploded per
    case and equi-joined to the (small) template table, so no cartesian operator."""
    variants = templates.agg(F.array_sort(F.collect_set("variant"))).scalar()      # one row: the names of the template table
    x = cases.select(key, assemble_input(cases, task).alias("input"), F.explode(variants).alias("variant"))
    return x.join(templates, "variant").select(
        key, "variant", F.concat(F.col("template"), F.lit(NL), F.col("input")).alias("prompt"))


def estimate_tokens(cases: DataFrame, fields: list[str], key: str = "case_id", parts: dict[str, DataFrame] | None = None) -> DataFrame:
    """Per field and total token estimates (long form: key, field, n).

    ``parts``: fields that consist of many texts, as frames (key, text) with one row a text; a token never spans two
    texts, so their counts are added up and the texts never meet.  A case without texts has 0."""
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), token_count(f).cast("long").alias("n")) for f in fields],
                             *[F.struct(F.lit(f).alias("field"), F.lit(0).cast("long").alias("n")) for f in parts or {}]))
    long = cases.select(key, rows.alias("x")).select(key, "x.field", "x.n")
    for name, texts in (parts or {}).items():
        counts = texts.join(cases.select(key), key, "left_semi").select(key, F.lit(name).alias("field"), token_count("text").cast("long").alias("n"))
        long = long.unionByName(counts)
    long = long.groupBy(key, "field").agg(F.sum("n").alias("n"))
    tot = long.groupBy(key).agg(F.sum("n").cast("long").alias("n")).withColumn("field", F.lit("total"))
    return long.unionByName(tot.select(key, "field", "n"))


SET2_FIELDS = ["patient_info", "past_history", "physical_exam", "lab_results"]


def set2_case(patients: DataFrame, history: DataFrame, exam: DataFrame, labs: DataFrame, diagnoses: DataFrame, *,
              key: str = "hadm_id", other_key: str = "patientunitstayid", max_lab_tokens: int | None = None) -> DataFrame:
    """Case record of the second set: one row per stay with the rendered inputs (NULL where a stay has no rows of a
    table) and the disease lists by priority (empty without diagnoses).

    The tables are cleaned and reduced already; ``max_lab_tokens`` cuts the lab text as for a prompt."""
    same = lambda df: df.withColumnRenamed(other_key, key)
    c = (demographics_text(patients, key).join(same(history_items(history, other_key)), key, "left")
         .join(same(exam_items(exam, other_key)), key, "left")
         .join(same(labs_as_csv(labs, other_key, max_tokens=max_lab_tokens)), key, "left")
         .join(diagnosis_struct(diagnoses, key), key, "left"))
    empty = F.array().cast(dict(c.dtypes)["all_diseases"])
    lists = [f"{n}_diseases" for n in ("all", "primary", "major", "other")]
    return c.select(F.col(key).cast("string").alias("case_id"), *SET2_FIELDS, *[F.coalesce(n, empty).alias(n) for n in lists])


def set2_input(cases: DataFrame) -> DataFrame:
    """Prompt input of the second set: every present field on lines of its own, and the tokens of each field (NULL where
    it is absent) and of all."""
    text = F.concat(*[F.coalesce(F.concat(F.col(f), F.lit(NL)), F.lit("")) for f in SET2_FIELDS])
    counted = cases.select("case_id", text.alias("input_text"), *[F.when(F.col(f).isNotNull(), token_count(f)).cast("long").alias(f"n_{f}")
                                                                  for f in SET2_FIELDS])
    total = sum((F.coalesce(f"n_{f}", F.lit(0)) for f in SET2_FIELDS[1:]), F.coalesce(f"n_{SET2_FIELDS[0]}", F.lit(0)))
    return counted.withColumn("n_total", total.cast("long"))


def set2_labels(cases: DataFrame, fallback: bool = False, any_col: str | None = None) -> DataFrame:
    """Labels of the second set: non-empty version-10 codes of all, primary and major diseases; the top code is the
    first primary one, with ``fallback`` else the first of all; ``any_col``: column for the latter next to the former."""
    def codes(name: str) -> Column:
        return F.filter(F.transform(f"{name}_diseases", lambda x: x["icd10code"]), lambda c: c.isNotNull() & (c != ""))
    x = cases.select("case_id", codes("all").alias("labels"), codes("primary").alias("primary"), codes("major").alias("major"))
    top = F.get("primary", F.lit(0))
    either = F.coalesce(top, F.get("labels", F.lit(0)))
    x = x.withColumn("top1", either if fallback else top)
    return x.withColumn(any_col, either) if any_col else x


def union_all(dfs):
    return reduce(lambda a, b: a.unionByName(b), dfs)
