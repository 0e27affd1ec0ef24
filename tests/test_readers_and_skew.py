"""Splittable JSON arrays, join-back under skew, lookups with repeated rows."""

import json
import random

import pytest

from casespark.operators import clean as C
from casespark.operators import hierarchy as H
from casespark.operators.lookup import lookup_members
from casespark.operators.skew import join_back
from casespark.sources.json_array import _moves, read_json_array
from casespark.sources.readers import read_json_or_lines
from pyspark.sql import functions as F

SCHEMA = "i long, s string, l array<string>, o struct<k:string>"


def elements(seed, n):
    rng = random.Random(seed)
    bits = ["}", "{", "[", "]", '"', "\\", ",", "\n", "é", "😀", "a", " ", "}, {", '\\"}']
    return [{"i": i, "s": "".join(rng.choice(bits) for _ in range(rng.randrange(0, 30))),
             "l": ["".join(rng.choice(bits) for _ in range(3)) for _ in range(rng.randrange(3))],
             "o": {"k": "}" * rng.randrange(3)}} for i in range(n)]


def as_rows(found):
    return sorted((r.i, r.s, r.l, r.o.k if r.o else None) for r in found)


@pytest.mark.parametrize("indent,split", [(None, 300), (2, 300), (None, 64), (2, 1 << 20)])
def test_array_is_cut_at_its_elements_whatever_the_splits(spark, tmp_path, indent, split):
    want = []
    for k in range(3):
        part = elements(k, 120)
        want += [(e["i"], e["s"], e["l"], e["o"]["k"]) for e in part]
        (tmp_path / f"part{k}.json").write_text(json.dumps(part, indent=indent, ensure_ascii=bool(k)) + "\n" * k, encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        got = read_json_array(spark, str(tmp_path), SCHEMA)
        if split < 1000:
            assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 20      # read by many tasks
        assert as_rows(got.collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_array_edges(spark, tmp_path):
    for k, text in enumerate(["[]", "", " [ ] \n", "[{}]", '[{"i": 1}]', '\n[\n{"i": 2} ,\n\n{"i": 3}\n]\n', '[{"i": 4, "o": {"k": "x"}}]',
                              '[5, {"i": 6}, "s", {"i": 7}, 8]', '[{"i": "x"}]']):
        (tmp_path / f"{k}.json").write_text(text)
    rows = {k: sorted((r.i for r in read_json_array(spark, str(tmp_path / f"{k}.json"), SCHEMA).collect()), key=str) for k in range(9)}
    assert rows[0] == rows[1] == rows[2] == [] and rows[3] == [None] and rows[4] == [1] and rows[5] == [2, 3] and rows[6] == [4]
    assert [i for i in rows[7] if i is not None] == [6, 7] and rows[8] == [None]


def test_element_over_many_batches_and_files(spark, tmp_path):
    """What is open when an Arrow batch, a split or a file ends is neither lost nor carried to the next file."""
    want = []
    for k in range(3):
        part = [*elements(k, 20), {"i": 100 + k, "s": '}\\"[{' * 200, "l": ["]"] * 50, "o": {"k": "{"}}]
        want += [(e["i"], e["s"], e["l"], e["o"]["k"]) for e in part]
        (tmp_path / f"{k}.json").write_text(json.dumps(part))
    (tmp_path / "open.json").write_text('[{"i": 7, "s": "a", "l": [], "o": {"k": "b"}}, {"i": 8')
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")
    old = [spark.conf.get(k) for k in keys]
    try:
        for split in (1 << 20, 500):
            for k, v in zip(keys, (split, 0, 7)):
                spark.conf.set(k, v)
            assert [r for r in as_rows(read_json_array(spark, str(tmp_path), SCHEMA).where("i NOT IN (7, 8)").collect())] == sorted(w for w in want if w[0] not in (7, 8))
            assert read_json_array(spark, str(tmp_path / "open.json"), SCHEMA).where("i = 7").count() == 1
    finally:
        for k, v in zip(keys, old):
            spark.conf.set(k, v)


def test_moves_of_chunks_are_those_of_their_characters():
    import pyarrow as pa

    def walk(text, inside):
        depth, skip = 0, False
        for c in text:
            if skip or c == "\\":
                skip = not skip
            elif c == '"':
                inside = not inside
            elif not inside:
                depth += (c in "{[") - (c == "]")
        return inside, depth - (not inside)
    rng = random.Random(3)
    for _ in range(300):
        chunks = ["".join(rng.choice('\\\\\\""{[]aé,\n') for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 20))]
        skipped = rng.randrange(len(chunks))
        odd, plain, quoted = _moves(pa.array(chunks).cast(pa.binary()).slice(skipped))
        got = [((bool(o), int(a)), (not o, int(b))) for o, a, b in zip(odd, plain, quoted)]
        assert got == [(walk(c, False), walk(c, True)) for c in chunks[skipped:]]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_query_writes_whole_arrays(spark, tmp_path, monkeypatch, adaptive):
    """Every file of read_json_array is one JSON array that holds its rows once; the log is shuffled by case only."""
    from casespark.plans import io_q
    rows = [(k, (k * 7 + n) % 200, k % 10, n, 1.0 * n, "ANR"[n % 3], "FO"[n % 2]) for k in range(400) for n in range(1, 1 + k % 5)]
    spark.createDataFrame(rows + rows[:50], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, "
                          "l_returnflag string, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(io_q.IO, "scratch", lambda _, name: str(tmp_path / name))
    # joins of large tables: planned with a shuffle, and changed to a broadcast when the sizes are known
    new = {"spark.sql.adaptive.enabled": adaptive, "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m"}
    old = {k: spark.conf.get(k, None) for k in new}
    try:
        for k, v in new.items():
            spark.conf.set(k, v)
        got = sorted(tuple(r) for r in io_q.q_read_json_array(spark, str(tmp_path)).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    arrays = [json.loads(f.read_text()) for f in (tmp_path / "log-json").rglob("part-*")]
    assert sum(1 for a in arrays if a) > 1
    assert got == sorted((e["case_id"], e["round"], e["line_no"], len(e["response"])) for a in arrays for e in a)
    want = [(r.case_id, r.round, r.line_no, len(r.response)) for r in io_q.fx.responses(spark, str(tmp_path)).collect()]
    assert got == sorted(want) and len(want) > 900


def test_format_is_found(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n [ {"i": 1},\n {"i": 2}]')
    (tmp_path / "l.json").write_text('{"i": 1}\n{"i": 2}\n')
    for name in ("a.json", "l.json"):
        assert sorted(r.i for r in read_json_or_lines(spark, str(tmp_path / name), SCHEMA).collect()) == [1, 2]


def test_hot_group_is_spread_over_tasks(spark):
    rows = [(0 if i % 3 == 0 else i, i) for i in range(6000)] + [(None, -1), (None, -2)]
    df = spark.createDataFrame(rows, "k long, v long")
    g = df.groupBy("k").agg(F.count(F.lit(1)).alias("_rows"))
    keys = ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in zip(keys, ("false", "16", "-1")):
            spark.conf.set(k, v)
        out = join_back(df, g, ["k"]).withColumn("task", F.spark_partition_id())
        got = out.collect()
        assert sorted((str(r.k), r.v, r._rows) for r in got) == sorted((str(k), v, {0: 2000, None: 2}.get(k, 1)) for k, v in rows)
        hot = out.where("k = 0").groupBy("task").count().collect()
        assert len(hot) >= 12 and max(r["count"] for r in hot) < 2 * 2000 / 16 + 50
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_duplicates_with_missing_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4), ("b", 5)], "k string, v long")
    assert {r.v: r.is_dup for r in C.flag_duplicates(df, ["k"]).collect()} == {1: True, 2: True, 3: True, 4: True, 5: False}


def test_lookup_keeps_repeated_rows_and_has_a_stable_key(spark):
    dim = spark.createDataFrame([("a", "A"), ("b", "B"), ("b", "B2")], "k string, v string")
    rows = [(1, ["a", "x", "a"], None), (1, ["a", "x", "a"], None), (1, ["b"], "y"), (2, [], "z"), (3, None, None), (None, ["a"], "q"),
            (None, ["a"], None), (4, None, "n"), (4, None, "n")]
    df = spark.createDataFrame(rows, "id long, l array<string>, other string")
    got = lookup_members(df, {"out": "l"}, dim)
    want = {"a": ["A"], "b": ["B", "B2"]}
    expected = [(i, l, o, None if l is None else [v for m in l for v in want.get(m, [])]) for i, l, o in rows]
    assert sorted(map(str, [tuple(r) for r in got.collect()])) == sorted(map(str, expected))
    assert "monotonically_increasing_id" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_range_lookup_with_overlaps_and_without_nested_loop(spark):
    taxonomy = spark.createDataFrame([("000-002", "000", "002"), ("001-00Z", "001", "00Z"), ("9-Z", "9", "Z"), ("A00-B99", "A00", "B99")],
                                     "top string, top_lo string, top_hi string")
    codes = ["00012", "0019", "002", "00Zx", "003", "A001", "B99", "C00", "Z", "Z1", "", "9", None, "001", "001", "é"]
    got = H.range_class_join(spark.createDataFrame([(c,) for c in codes], "code string"), taxonomy)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    bounds = [r[:] for r in [("000-002", "000", "002"), ("001-00Z", "001", "00Z"), ("9-Z", "9", "Z"), ("A00-B99", "A00", "B99")]]

    def first(c):
        return None if c is None else min((t for t, lo, hi in bounds if lo <= c[:3] <= hi), default=None)
    assert sorted(map(str, [(r.code, r.range) for r in got.collect()])) == sorted(map(str, [(c, first(c)) for c in codes]))
