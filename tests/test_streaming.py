"""Stream of response logs: keyed state, any order, replays, cost of a batch."""

import json

import pytest

from casespark.streaming.ingest import ingest_responses, invalid_responses, maintain_valid, valid_responses


def arrive(folder, name, lines):
    with open(folder / name, "w") as f:
        for case, line, good in lines:
            body = '{"top10": ["%d"], "predictions": ["%d"]}' % (line, line) if good else "none"
            f.write(json.dumps({"case_id": case, "round": 1, "line_no": line, "response": body}) + "\n")


def run(spark, base, profile):
    a = ingest_responses(spark, str(base / "in"), str(base / profile), str(base / f"{profile}-log"), profile=profile, max_files_per_trigger=1)
    a.awaitTermination()
    b = maintain_valid(spark, str(base / profile), str(base / f"{profile}-valid"), profile=profile, max_files_per_trigger=1)
    b.awaitTermination()
    rows = valid_responses(spark, str(base / f"{profile}-valid")).collect()
    return {(r.case_id): (r.line_no, r.ranked, r.final) for r in rows}, b.recentProgress


@pytest.mark.parametrize("profile,pick", [("one_match", min), ("last_match", max)])
def test_state_holds_the_row_of_the_batch_rule_in_any_order(spark, tmp_path, profile, pick):
    (tmp_path / "in").mkdir()
    waves = [[(1, 5, True), (2, 8, False), (3, 7, True)], [(1, 2, True), (1, 3, False), (2, 9, True)], [(1, 9, True), (4, 1, False)]]
    for n, lines in enumerate(waves[:2]):
        arrive(tmp_path / "in", f"part{n}.json", lines)
    run(spark, tmp_path, profile)
    arrive(tmp_path / "in", "part2.json", waves[2])            # a later run takes up only what is new
    got, progress = run(spark, tmp_path, profile)
    want = {}
    for case, line, good in (x for w in waves for x in w):
        if good:
            want[case] = pick(want.get(case, line), line)
    assert got == {c: (line, [str(line)], [str(line)]) for c, line in want.items()}
    assert sum(p["stateOperators"][0]["numRowsUpdated"] for p in progress if p["stateOperators"]) == 1      # one key changed, of three
    bad = {(r.case_id, r.line_no) for r in invalid_responses(spark, str(tmp_path / profile)).collect()}
    assert bad == {(2, 8), (1, 3), (4, 1)}
    assert valid_responses(spark, str(tmp_path / f"{profile}-valid")).count() == 3      # keys, however long the history


def test_replayed_rows_change_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    arrive(tmp_path / "in", "a.json", [(1, 5, True), (2, 6, True)])
    first, _ = run(spark, tmp_path, "one_match")
    arrive(tmp_path / "in", "b.json", [(1, 5, True), (2, 6, True)])          # the same lines again
    again, _ = run(spark, tmp_path, "one_match")
    assert first == again


def test_log_history_and_state_lie_compressed(spark, tmp_path, monkeypatch):
    """A fault before: the log lay as plain text, several times the rest of what the query writes."""
    import pyarrow.parquet as pq

    import casespark.plans.io_q as q
    from casespark.plans.registry import all_queries
    codes = [[f"{(97 * case + 25 * k) % 100000:05d}" for k in range(10)] for case in range(2000)]
    rows = [(case, 1, "m", False, 0.0, 2 * case, json.dumps({"top10": c, "predictions": c[:1]}), 1, 1, 1, None) for case, c in enumerate(codes)]
    monkeypatch.setattr(q.fx, "responses", lambda spark, d: spark.createDataFrame(rows, q.LOG_SCHEMA))
    monkeypatch.setattr(q.IO, "scratch", lambda spark, name: str(tmp_path / name))
    got = sorted((r.case_id, r.line_no, r.ranked, r.final) for r in all_queries()["ingest_responses"](spark, "unused").collect())
    assert got == [(case, 2 * case, ",".join(c), c[0]) for case, c in enumerate(codes)]
    log = [f for f in (tmp_path / "ingest" / "in").rglob("part-*")]
    assert 2 * sum(f.stat().st_size for f in log) < sum(len(r[6]) for r in rows)
    for f in (tmp_path / "ingest" / "out").rglob("*.parquet"):
        assert pq.ParquetFile(f).metadata.row_group(0).column(4).compression == "ZSTD"
