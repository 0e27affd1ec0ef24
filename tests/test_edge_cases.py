"""Hand-written rows for the quirks of the reference (expected values worked out
"""

import pytest
from pyspark.sql import functions as F

from casespark.functions.columns import floor_bucket, md5_draw, numeric_text
from casespark.operators import clean as C
from casespark.operators import cohort as CO
from casespark.operators import hierarchy as H
from casespark.operators import joins as J
from casespark.operators import metrics as M
from casespark.operators import render as T
from casespark.operators import report as R
from casespark.operators import responses as RS
from casespark.sources.readers import decode_list_text


def test_numeric_text(spark):
    vals = ["1.5", " 2 ", "1e3", "inf", "nan", "<0.1", "1,5", "1_0", "1d", "0x10", "-3.", ".5"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(numeric_text("v")).collect()]
    assert got == [1.5, 2.0, 1000.0, None, None, None, None, None, None, None, -3.0, 0.5]


def test_floor_bucket_negative(spark):
    df = spark.createDataFrame([(-5,), (239,), (240,), (0,)], "x long")
    assert [r[0] for r in df.select(floor_bucket("x", 30)).collect()] == [-30, 210, 240, 0]
    assert [r[0] for r in df.select(floor_bucket("x", 240)).collect()] == [-240, 0, 240, 0]


LAB_SCHEMA = ("patientunitstayid long, labid long, labname string, labresult double, labresultoffset long, "
              "labresultrevisedoffset long, labtypeid int, labmeasurenamesystem string, labmeasurenameinterface string")


def test_bucket_latest_takes_last_non_null_per_column(spark):
    rows = [(1, 1, "k", 5.0, 10, 10, 1, "a", "i"), (1, 2, "k", 6.0, 20, 20, 1, None, None)]
    out = C.bucket_latest(spark.createDataFrame(rows, LAB_SCHEMA), 360, False).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.labresult, r.labmeasurenamesystem, r.labmeasurenameinterface, r.labid, r.labresultoffset) == (6.0, "a", "i", 2, 20)


def test_glucose_mean_first_attrs_and_negative_bucket(spark):
    rows = [(1, 1, "bedside glucose", 4.0, 10, 10, None, None, "x"), (1, 2, "bedside glucose", 6.0, 100, 100, 7, "u", "y"),
            (1, 3, "bedside glucose", 9.0, -5, -5, 1, "v", "z")]
    out = {r.labresultoffset: r for r in C.glucose_4h(spark.createDataFrame(rows, LAB_SCHEMA)).collect()}
    assert out[0].labresult == 5.0 and out[0].labtypeid == 7 and out[0].labmeasurenamesystem == "u"
    assert out[0].labmeasurenameinterface == "x" and out[0].labname == "bedside glucose_4h_avg"
    assert out[-240].labresult == 9.0


def test_type_null_goes_to_other_branch(spark):
    rows = [(1, 1, "k", 5.0, 10, 10, None, "a", "i")]
    df = spark.createDataFrame(rows, LAB_SCHEMA)
    assert C.bucket_latest(df, 30, True).count() == 0
    assert C.bucket_latest(df, 360, False).count() == 1


def test_exclude_value_keeps_null(spark):
    df = spark.createDataFrame([("Delete",), (None,), ("x",)], "v string")
    assert sorted(C.exclude_value(df, "v", "Delete").collect(), key=repr) == sorted([(None,), ("x",)], key=repr)


def test_within_stay_inclusive_and_null_bound(spark):
    ev = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00"), (2, 1, "2024-01-02 00:00:00"), (3, 2, "2024-01-01 00:00:00")],
                               "id int, hadm_id int, t string").withColumn("charttime", F.to_timestamp_ntz("t"))
    enc = spark.createDataFrame([(1, "2024-01-01 00:00:00", "2024-01-02 00:00:00"), (2, None, "2024-01-02 00:00:00")],
                                "hadm_id int, a string, b string") \
        .withColumn("admittime", F.to_timestamp_ntz("a")).withColumn("dischtime", F.to_timestamp_ntz("b"))
    assert sorted(r.id for r in C.within_stay(ev, enc, ["hadm_id"]).collect()) == [1, 2]


PRED = "case_id long, ranked array<string>, pred array<string>, labels array<string>, top1 string"


def test_repeated_labels_and_empty_predictions(spark):
    rows = [(1, ["a", "c", "b"], ["a"], ["a", "a", "b"], "a"), (2, ["x"], [], ["x"], "x")]
    j = spark.createDataFrame(rows, PRED)
    moc = {r.case_id: r for r in M.miss_over_case(j).collect()}
    assert moc[1].missed == ["b"] and moc[1].n_missed == 1 and abs(moc[1].miss_rate - 1 / 3) < 1e-12
    assert moc[1].over == [] and moc[1].over_rate == 0.0
    assert moc[2].over_rate == 0.0 and moc[2].miss_rate == 1.0
    rk = {r.k: r.recall for r in M.recall_at_k(j.filter("case_id = 1"), ks=[1, 2, 3]).collect()}
    assert abs(rk[1] - 1 / 3) < 1e-12 and abs(rk[3] - 2 / 3) < 1e-12
    ml = M.multilabel_metrics(j, 3).first()
    assert ml.samples_precision == pytest.approx(0.5)       # case 2: empty prediction -> 0
    assert ml.n_undefined == 0


def test_severity_bins_edges(spark):
    rows = [(1, 0.0, 0.2), (2, 0.6, 1.0), (3, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "case_id long, miss_rate double, over_rate double")
    got = {(r.side, r.bin): r.n for r in M.severity_bins(df).collect()}
    assert got[("miss", "0.0-0.2")] == 1 and got[("miss", "0.6-0.8")] == 1 and got[("miss", "0.8-1.0")] == 1
    assert got[("over", "0.2-0.4")] == 1 and got[("over", "0.8-1.0")] == 1 and got[("over", "0.0-0.2")] == 1
    assert sum(v for (s, _), v in got.items() if s == "miss") == 3


def test_age_number_and_dual_code(spark):
    df = spark.createDataFrame([("> 89", "v9"), ("", "a, b"), (None, None), ("45", "")], "age string, icd9code string")
    out = R.split_dual_code(df).select(CO.age_number("age").alias("a"), "v9", "v10").collect()
    assert [tuple(r) for r in out] == [(89, "v9", ""), (None, "a", "b"), (None, "", ""), (45, "", "")]


def test_sample_per_disease_fewer_than_n(spark):
    cohort = spark.createDataFrame([(1, ["d1"]), (2, ["d1", "d2"])], "patient_id long, all_list array<string>")
    top = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "icd_code string")
    out = CO.sample_per_disease(cohort, top, n=20).collect()
    stats = {r.disease: (r.available, r.sampled) for r in out}
    assert stats == {"d1": (2, 2), "d2": (1, 1), "d3": (0, 0)}
    assert sum(1 for r in out if r.patient_id is not None) == 3


def test_md5_draw_is_stable(spark):
    v = spark.range(1).select(md5_draw(42, F.lit("a"), F.lit(7))).first()[0]
    import hashlib
    assert v == int(hashlib.md5(b"42:a:7").hexdigest()[:8], 16)


def test_split_by_patient_keeps_patient_together(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(200)], "hadm_id long, subject_id long")
    out = CO.split_by_patient(df, "subject_id").groupBy("subject_id").agg(F.countDistinct("split").alias("n")).collect()
    assert all(r.n == 1 for r in out)


def test_crosswalk_unmapped_dropped_and_counted(spark):
    diag = spark.createDataFrame([(1, 1, "A", 9, "ta"), (1, 2, "B", 10, "tb"), (1, 3, "C", 10, "tc")],
                                 "hadm_id long, seq_num int, icd_code string, icd_version int, long_title string")
    xw = spark.createDataFrame([("B", "Z")], "icd10 string, icd9 string")
    dic = spark.createDataFrame([("Z", 10, "z10"), ("Z", 9, "z9"), ("A", 9, "ta")], "icd_code string, icd_version int, long_title string")
    codes, unmapped = J.crosswalk_codes(diag, xw, dic)
    got = sorted((r.part, r.seq_num, r.code, r.title) for r in codes.collect())
    assert got == [(0, 1, "A", "ta"), (1, 2, "Z", "z9")]
    assert [tuple(r) for r in unmapped.collect()] == [(1, 1)]


def test_ordered_distinct_first_appearance(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "b", 3), (1, "c", 4)], "k int, v string, o int")
    assert CO.ordered_distinct(df, "k", "v", "o").first().values == ["b", "a", "c"]


TAX = [("00000", "000", "000-002", "000", "002"), ("00025", "000", "000-002", "000", "002"),
       ("00100", "001", "000-002", "000", "002"), ("00500", "005", "003-005", "003", "005")]


@pytest.mark.parametrize("pred,score", [(["00000"], 1), (["00025"], 2), (["00100"], 3), (["00500"], 4), ([], 4),
                                        (["00500", "00025"], 2)])
def test_closeness_scores(spark, pred, score):
    tax = spark.createDataFrame(TAX, "leaf string, mid string, top string, top_lo string, top_hi string")
    j = spark.createDataFrame([(1, [], pred, ["00000"], "00000")], PRED)
    got = {r.score: r.n for r in H.closeness(j, tax, "top1").collect()}
    assert got[score] == 1 and sum(got.values()) == 1


def test_note_sections_and_exam(spark):
    text = ("History of Present Illness:\n  hello there \nPast Medical History:\nhtn\nSocial History:\nnone\n"
            "Physical Exam:\nok then DISCHARGE: fine\nPertinent Results:\nx\n"
            "Discharge Diagnosis:\n a \nDischarge Condition:\nDischarge Diagnosis: b\nDischarge Condition: good")
    df = spark.createDataFrame([(1, text), (2, "nothing")], "note_id long, text string")
    s = {(r.note_id, r.section): r.text for r in T.note_sections(df).collect()}
    assert s[(1, "hpi")] == "hello there" and s[(1, "past_medical_history")] == "htn"
    assert s[(1, "diagnosis")] == "a, b" and s[(2, "hpi")] == "None"
    exam = df.select(T.before_word(T.section("text", "Physical Exam:\n", "Pertinent Results:"), "discharge")).first()[0]
    assert exam == "ok then "


def test_strip_findings_and_truncate(spark):
    df = spark.createDataFrame([("A FINDINGS: x IMPRESSION: y FINDINGS: z IMPRESSION: w", "a, b c")], "t string, u string")
    r = df.select(T.strip_findings("t").alias("s"), T.truncate_tokens("u", 2).alias("k"), T.token_count("u").alias("n")).first()
    assert r.s == "A IMPRESSION: y IMPRESSION: w" and r.k == "a," and r.n == 4


def test_decode_list_text(spark):
    df = spark.createDataFrame([(1, "['a', 'b']"), (2, None), (3, "nan"), (4, "x"), (5, "[]")], "i int, v string")
    got = [r.v for r in decode_list_text(df, "v").orderBy("i").collect()]
    assert got == [["a", "b"], [], [], ["x"], []]


def test_repair_json(spark):
    df = spark.createDataFrame([('{"a": [A1, B22], // x\n "b": 1,}',)], "s string")
    assert df.select(RS.repair_json("s")).first()[0] == '{"a":["A1","B22"],"b":1}'


def test_split_reasoning(spark):
    df = spark.createDataFrame([(1, "<think>abc</think>\n answer "), (2, "plain")], "i int, r string")
    reasoning, answer = RS.split_reasoning(F.col("r"))
    got = [tuple(x) for x in df.orderBy("i").select(reasoning, answer).collect()]
    assert got == [("abc", "answer"), ("No reasoning found", "plain")]


RESPONSES = {
    "fenced": 'x\n```json\n{"top10": ["1:a", "2"], "predictions": ["1"]}\n```',
    "two": 'Answer {"top10": ["1"], "predictions": ["1"]} more {"x": 1}',
    "markdown": '**top10**: ["1:a", "2:b"]\n**predictions**: ["1:a"]',
    "empty": '{"top10": ["1"], "predictions": []}',
    "trailing": '{"top10": ["1",], "predictions": ["1"]}',
    "bare": '{"top10": [A12, B3.4], "predictions": [A12]}',
    "comment": '{"top10": ["1"], // c\n"predictions": ["1"]}',
    "prose": "no json here",
    "lines": '{"top10": ["1"], "predictions": ["1"]}\n{"top10": ["2"], "predictions": ["2"]}',
}

EXPECTED = {  # (one_match status, ranked), (last_match status, ranked)
    "fenced": (("valid", ["1", "2"]), ("valid", ["1", "2"])),
    "two": (("invalid", None), ("valid", ["1"])),
    "markdown": (("valid", ["1", "2"]), ("invalid", None)),
    "empty": (("invalid", None), ("invalid", None)),
    "trailing": (("invalid", None), ("valid", ["1"])),
    "bare": (("invalid", None), ("valid", ["A12", "B3.4"])),
    "comment": (("invalid", None), ("valid", ["1"])),
    "prose": (("invalid", None), ("invalid", None)),
    "lines": (("invalid", None), ("valid", ["2"])),
}


@pytest.mark.parametrize("profile,idx", [("one_match", 0), ("last_match", 1)])
def test_extraction_profiles(spark, profile, idx):
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(RESPONSES.items())], "case_id long, kind string, response string")
    out = {r.kind: (r.status, r.ranked) for r in RS.extract_responses(df, profile).collect()}
    assert out == {k: v[idx] for k, v in EXPECTED.items()}


def test_dedup_keeps_first_or_last_valid(spark):
    rows = [(1, 1, "invalid", None), (1, 2, "valid", ["a"]), (1, 3, "valid", ["b"]), (2, 4, "invalid", None)]
    df = spark.createDataFrame(rows, "case_id long, line_no long, status string, ranked array<string>") \
        .withColumn("final", F.col("ranked")).withColumn("method", F.lit("m"))
    first = {r.case_id: r.ranked for r in RS.dedup_valid(df, keep="first").collect()}
    last = {r.case_id: r.ranked for r in RS.dedup_valid(df, keep="last").collect()}
    assert first == {1: ["a"]} and last == {1: ["b"]}


def test_consistency_union_empty_is_undefined(spark):
    runs = spark.createDataFrame([(1, 1, ["a"], []), (1, 2, ["a"], []), (2, 1, ["a"], ["x"]), (2, 2, ["b"], ["x"])],
                                 "case_id long, round int, ranked array<string>, pred array<string>")
    got = {(r.measure, r.k): r for r in M.run_consistency(runs, [1, 2], ks=[1]).collect()}
    assert got[("final_all", 0)].n_undefined == 1 and got[("final_all", 0)].value == 1.0
    assert got[("ranked", 1)].value == 0.5


def test_tokens_before_matches_single_window(spark):
    from pyspark.sql import Window
    rows = [(k % 3, i, (i * 7) % 5 + 1) for k in range(3) for i in range(k * 40, k * 40 + 200)]
    df = spark.createDataFrame(rows, "k int, o int, t int")
    got = T.tokens_before(df, "k", ["o"], "t", F.floor(F.col("o") / 17))
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    ref = df.withColumn("ref", F.coalesce(F.sum("t").over(w), F.lit(0)))
    bad = got.join(ref, ["k", "o", "t"]).filter(F.col("_before") != F.col("ref")).count()
    assert bad == 0 and got.count() == df.count()


def test_labs_as_csv_token_cap_exact(spark):
    rows = [(1, i, f"name{i % 3}", float(i), i, i, 1, "u", "i") for i in range(300)] + [(2, 5, "x", 1.0, 5, 5, 1, None, "i")]
    df = spark.createDataFrame(rows, "patientunitstayid long, labid long, labname string, labresult double, labresultoffset long, "
                                     "labresultrevisedoffset long, labtypeid int, labmeasurenamesystem string, labmeasurenameinterface string")
    capped = {r.patientunitstayid: r.lab_results for r in T.labs_as_csv(df, max_tokens=100, chunk_width=7).collect()}
    full = {r.patientunitstayid: r.lab_results for r in T.labs_as_csv(df).collect()}
    cut = df.sparkSession.createDataFrame([(full[1],)], "t string").select(T.truncate_tokens("t", 100)).first()[0]
    assert capped[1] == cut and capped[2] == full[2]
    assert df.sparkSession.createDataFrame([(capped[1],)], "t string").select(T.token_count("t")).first()[0] == 100
