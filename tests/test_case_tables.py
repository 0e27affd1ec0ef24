"""Bucketed case tables: no shuffle of predictions, new tables for new inputs."""

import re
import shutil

from casespark.operators.vocab import valid_codes_only
from casespark.plans import metrics_q as MQ
from casespark.plans.registry import all_queries

Q = all_queries()


def exchanges(df):
    return re.findall(r"Exchange (?:hashpartitioning|rangepartitioning)\((\w+)", df._jdf.queryExecution().executedPlan().toString())


def test_joins_and_runs_read_matching_buckets(spark, small_dir):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)          # as for tables that are too large
        assert exchanges(MQ.joined(spark, small_dir)) == []
        for key in ("join_predictions", "join_rounds", "recall_at_k", "miss_over_summary"):
            assert "case_id" not in exchanges(Q[key](spark, small_dir)), key
        for key in ("avg_report", "pair_consistency", "triple_consistency"):
            assert "case_id" not in exchanges(Q[key](spark, small_dir)), key
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_tables_are_written_once_and_anew_for_other_inputs(spark, small_dir, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for t in ("lineitem", "part"):
        shutil.copy(f"{small_dir}/{t}.parquet", folder / f"{t}.parquet")
    first = MQ.labels(spark, str(folder))
    assert MQ.labels(spark, str(folder)).inputFiles() == first.inputFiles()
    n = first.count()
    spark.read.parquet(f"{small_dir}/lineitem.parquet").limit(50).coalesce(1).write.mode("overwrite").parquet(str(folder / "lineitem.parquet.new"))
    (folder / "lineitem.parquet").unlink()
    (folder / "lineitem.parquet.new").rename(folder / "lineitem.parquet")
    assert MQ.labels(spark, str(folder)).count() < n


def test_ranked_lists_are_made_where_they_are_read(spark, small_dir):
    short, long = MQ.preds_valid(spark, small_dir, (1,)), MQ.preds_valid(spark, small_dir, length=20)
    assert set(short.inputFiles()) == set(long.inputFiles())
    assert long.selectExpr("min(size(ranked))", "max(size(ranked))").first() == (20, 20)
    assert short.selectExpr("max(size(ranked))", "count(distinct round)").first() == (10, 1)


def test_buckets_grow_with_the_input(spark, small_dir, monkeypatch):
    from casespark.plans import tables
    monkeypatch.setattr(tables, "BUCKET_BYTES", 1000)
    n = tables.parts(spark, small_dir, ("lineitem", "part"))
    assert n > int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = tables.bucketed(spark, small_dir, "grown", lambda buckets: spark.range(500).selectExpr("id AS case_id").repartition(buckets, "case_id"), placed=True)
    assert t.count() == 500 and len(t.inputFiles()) > n // 2


def test_only_members_travel_to_the_dimension(spark):
    from casespark.operators.lookup import lookup_members
    df = spark.createDataFrame([(1, "wide", ["a", "x"]), (1, "wide", ["a", "x"]), (2, "w", []), (None, "w", None)], "i int, wide string, l array<string>")
    dim = spark.createDataFrame([("a", "A")], "k string, v string")
    got = lookup_members(df, {"out": "l"}, dim)
    assert sorted(map(tuple, got.select("i", "wide", "out").collect()), key=str) == [(1, "wide", ["A"]), (1, "wide", ["A"]), (2, "w", []), (None, "w", None)]
    keyed = lookup_members(df.limit(4).dropDuplicates(["i"]), {"out": "l"}, dim, rows=["i"])
    assert sorted(map(tuple, keyed.select("i", "out").collect()), key=str) == [(1, ["A"]), (2, []), (None, None)]
    plan = lookup_members(df, {"out": "l"}, dim)._jdf.queryExecution().optimizedPlan().toString()
    inner = plan[plan.index("Join Inner"):]                                       # members meet the dimension without the other columns
    assert "collect_set" in plan and "first(row" not in plan and plan.count("Join LeftOuter") == 1 and "named_struct(i" not in inner.split("Generate")[0]


def test_keyed_rows_stay_in_their_buckets_at_every_size(spark, small_dir):
    """Valid codes, classes and closeness shuffle no case, however large the vocabulary and the taxonomy are."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    dim = spark.createDataFrame([(f"{i:05d}",) for i in range(3000)], "code string")
    cases = spark.range(400).selectExpr("id AS case_id", "array('00001', concat('X', id % 3), '00999', '00001') AS final").repartition(4, "case_id")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 4000)       # under the dimension, over its exceptions
        valid = valid_codes_only(cases, dim, "final", rows=["case_id"])
        assert not {"_id_0", "coalesce", "member"} & set(exchanges(valid))
        assert {(tuple(r.valid), r.n_error) for r in valid.collect()} == {(("00001", "00999", "00001"), 1)} and valid.count() == 400
        for key in ("class_metrics", "class_accuracy", "closeness_top1", "class_recall_at_k"):
            assert not {"_id", "_of", "_id_0", "coalesce", "member"} & set(exchanges(Q[key](spark, small_dir))), key
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_exceptions_are_looked_up_and_the_rest_follows_from_the_member(spark):
    from casespark.operators.lookup import by_stem, lookup_members
    dim = spark.createDataFrame([("aaa1", "A"), ("aaa2", "A"), ("aaa3", "Z"), ("aaa3", "A"), ("bbb1", None), ("bbb2", "B"), ("c", "C"), (None, "N")],
                                "k string, v string")
    lists = [["aaa1", "aaa3", "aaa9", None, "aaa1"], ["bbb1", "bbb2", "bbb3"], ["c", "cc", ""], [], None, ["aaa2"]]
    df = spark.createDataFrame([(i if i != 2 else None, l, f"row {i}") for i, l in enumerate(lists)], "i int, l array<string>, other string")
    plain = {r.i: r for r in lookup_members(df, {"out": "l"}, dim).collect()}
    for rows in (None, ["i"]):
        got = lookup_members(df, {"out": "l"}, dim, rows=rows, usual=by_stem).collect()
        assert {r.i: r for r in got} == plain and len(got) == len(lists)
    named = {r.i: r.out for r in lookup_members(df, {"out": "l"}, dim, rows=["i"], usual=by_stem, named=True).collect()}
    assert [tuple(x) for x in named[0]] == [("aaa1", "A"), ("aaa3", "A"), ("aaa3", "Z"), ("aaa1", "A")] and named[4] is None and named[3] == []


def test_both_top_codes_of_set2_come_from_one_pass(spark):
    from casespark.operators.render import set2_labels
    one = "array<struct<name:string,icd9code:string,icd10code:string>>"
    df = spark.createDataFrame([(1, [("a", "1", "X1"), ("b", "2", "X2")], [("b", "2", "X2")], []), (2, [("a", "1", "X1")], [], []), (3, [], [], [])],
                               f"case_id int, all_diseases {one}, primary_diseases {one}, major_diseases {one}")
    got = {r["case_id"]: (r["top1"], r["top1_any"]) for r in set2_labels(df, any_col="top1_any").collect()}
    assert got == {1: ("X2", "X2"), 2: (None, "X1"), 3: (None, None)}


def test_stays_without_labs_leave_before_the_joins(spark, small_dir):
    from casespark.plans.text_q import stays
    from casespark.sources import fixtures as fx
    some = fx.lab_stays(spark, small_dir)
    part = stays(spark, small_dir, only=some)
    assert sorted(map(str, part.collect())) == sorted(map(str, stays(spark, small_dir).join(some, "hadm_id", "left_semi").select(part.columns).collect()))


def test_resampling_sorts_each_bucket_once(spark):
    from casespark.operators.metrics import bootstrap_ci_multinomial
    scores = spark.createDataFrame([(i, float(i % 3)) for i in range(50)] + [(None, 1.0), (7, None)], "case_id int, s double")
    out = bootstrap_ci_multinomial(scores, ["s"], n_rep=20, buckets=4)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    row = out.first()
    assert row["lo"] <= row["value"] <= row["hi"]


def test_ids_of_the_fallback_lie_in_the_wanted_partitions(spark):
    from casespark.operators.joins import source_fallback
    ids, a, b = (spark.range(n).toDF("k") for n in (9, 3, 6))
    rows, missing = source_fallback(ids, [("a", a), ("b", b)], "k", parts=37)
    assert re.search(r"hashpartitioning\(k#\d+L, 37\)", rows._jdf.queryExecution().executedPlan().toString())
    assert sorted(map(tuple, rows.collect())) == [(0, "a"), (1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "b")]
    assert sorted(r[0] for r in missing.collect()) == [6, 7, 8]


def test_a_partitioned_table_has_few_files_a_folder_and_no_folder_a_code(spark, small_dir, tmp_path):
    import collections
    from casespark.sources import readers as IO
    IO.write_tables(spark.range(0, 400, 1, 16).selectExpr("id", "id % 3 AS g"), str(tmp_path / "t"), partition_by=["g"])
    files = collections.Counter(f.parent.name for f in (tmp_path / "t").glob("g=*/part-*"))
    assert len(files) == 3 and max(files.values()) <= IO.FILES_PER_FOLDER
    out = Q["write_tables"](spark, small_dir)
    assert all(re.search(r"/top1_class=[^/]{3}/", f) for f in out.inputFiles())
    assert out.count() == MQ.labels(spark, small_dir).count()


def test_the_extraction_runs_once_for_a_report(spark, small_dir):
    from casespark.plans import responses_q as RQ
    for profile in ("one_match", "last_match"):
        plan = RQ.valid_dedup(spark, small_dir, profile)._jdf.queryExecution().optimizedPlan().toString()
        assert "from_json" not in plan and "jsontostructs" not in plan.lower() and "regexp_extract" not in plan
    assert "regexp_extract" not in Q["extraction_report"](spark, small_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_texts_that_cannot_be_json_are_not_parsed(spark):
    from casespark.operators.responses import _VALUE_BEGINS, valid_json
    texts = ["Answer", "1", "-1", "+INF", "NaN", "Infinity", "INF", "-INF", "null", "true", '"a"', "[1]", "{}", "I cannot", "", "]", ",", "﻿1", "_x", ".5", "'a'", "*"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", valid_json("t").alias("ok"), df_begins("t", _VALUE_BEGINS).alias("begins"))
    assert [r["t"] for r in df.collect() if r["ok"] and not r["begins"]] == []
    assert [r["t"] for r in df.collect() if r["begins"]] == ["1", "-1", "+INF", "NaN", "Infinity", "INF", "-INF", "null", "true", '"a"', "[1]", "{}"]


def df_begins(c, pattern):
    from pyspark.sql import functions as F
    return F.col(c).rlike(pattern)


def test_items_of_a_ranked_list_do_not_work_out_its_start_again(spark):
    from casespark.sources import fixtures as fx
    df = fx.case_runs(spark.createDataFrame([(7, "00025"), (8, "500000"), (9, None)], "case_id long, top1 string"), 3)
    got = {(r["case_id"], r["round"]): r["ranked"] for r in df.collect()}
    assert got[7, 1] == ["00075", "00150", "00225"] and got[8, 3] == ["500075", "500300", "500525"] and got[9, 2] == [None] * 3
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("cast(top1") == 1
