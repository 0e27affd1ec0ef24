"""Near duplicates, fingerprints and repeated strings against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from casespark.llm.fingerprint import edited_fingerprints, fingerprints
from casespark.llm.minhash_dedup import drop_near_duplicates, near_duplicates
from casespark.llm.repeats import remove_repeats

SCHEMA = "doc_id long, text string, kept string, n long, id long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(rows, k):
    sets = [(i, shingles(t, k)) for i, t in rows]
    least = {i: i for i, _ in sets}
    changed = True
    links = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if s and t and 100 * len(s & t) >= 80 * len(s | t)]
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if (least[a], least[b]) != (m, m):
                least[a] = least[b] = m
                changed = True
    return least


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed):
    """Groups of near copies around the threshold, a very common line, copies and odd rows."""
    rng = random.Random(seed)
    line = "this one line stands at the top of very many documents here"
    texts = []
    for _ in range(6):
        words = [f"v{rng.randrange(300)}" for _ in range(rng.choice([12, 60, 150]))]
        texts += [edited(rng, words, rng.randrange(0, max(2, len(words) // 10))) for _ in range(40)]
    texts += [line + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 60))) for _ in range(200)]
    texts += [None, "", " \n ", "One", "one", "one two", "A B", "a b", "a\tb", texts[0], "long " * 30_000]
    return list(enumerate(texts))


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus(1)
    for k in (2, 5):
        got = {r.doc_id: r for r in near_duplicates(table(spark, rows), words=k).collect()}
        want = components(rows, k)
        assert len(got) == len(rows)
        for i, t in rows:
            assert got[i].n_shingles == len(shingles(t, k))
            assert got[i].component_id == want[i], (k, i)
            assert got[i].kept == (i == want[i])


def test_long_lists_are_divided_without_loss(spark, monkeypatch):
    import casespark.llm.minhash_dedup as m
    for name, value in (("LONG", 20), ("BIG", 4), ("SIDE", 8), ("CENTRES", 1)):
        monkeypatch.setattr(m, name, value)
    rows = corpus(2)
    got = {r.doc_id: r.component_id for r in near_duplicates(table(spark, rows), words=2).collect()}
    assert got == components(rows, 2)


def test_documents_with_one_common_line_meet_in_short_lists(spark, tmp_path, monkeypatch):
    """A fault before: the long lists of a common line, divided by more values of that line, stayed long."""
    import casespark.llm.minhash_dedup as m
    from casespark.llm.shared import Scratch
    monkeypatch.setattr(m, "LONG", 20)
    line = " ".join(f"line{k}" for k in range(12))
    rows = [(i, f"{line} " + " ".join(f"w{i}x{k}" for k in range(12))) for i in range(300)]
    rows += [(1000 + i, t + f" end{i}") for i, t in rows[::10]] + [(2000 + i, f"{line} only{i}") for i in range(10)]
    got = {r.doc_id: r.component_id for r in near_duplicates(table(spark, rows), words=2).collect()}
    assert got == components(rows, 2)
    scratch = Scratch(spark, "common-line-test")
    base = table(spark, rows).select(F.col("doc_id").alias("id"), "text")
    nodes = scratch.table(base.mapInArrow(m._sketcher(2), "id long, n long, d1 long, d2 long, sketch binary")
                          .select(F.col("id").alias("node"), "n", "sketch"), "nodes")
    search = m._Search(base, scratch, 2, 80)
    parts = nodes.select("node", F.col("node").alias("component")).limit(0)
    lists = search.open_lists(nodes, search.lists(nodes), parts, spark.createDataFrame([], "component long, size long, low long, high long"))
    assert max(r["count"] for r in lists.groupBy("key").count().collect()) <= 2 * m.LONG


def test_near_duplicates_edge_tables(spark):
    assert near_duplicates(table(spark, [])).collect() == []
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (3, None)]
    assert sorted(r.doc_id for r in drop_near_duplicates(table(spark, rows)).collect()) == [1, 3]


def test_fingerprints_of_edited_texts(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "bé", "日本", "delta"]) + str(rng.randrange(99)) for _ in range(rng.randrange(120))))
            for i in range(0, 300, 3)] + [(1, None), (2, ""), (4, "x"), (5, "ab" * 40_000), (7, "same"), (8, "same")]
    got = {r.doc_id: r for r in edited_fingerprints(table(spark, rows), partitions=5).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    plain = {r.doc_id: r.fingerprint for r in fingerprints(table(spark, rows)).collect()}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        new = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert got[i].fingerprint == plain[i]
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1
    assert got[7].fingerprint == got[8].fingerprint and got[1].fingerprint == got[2].fingerprint
    long_ones = [r for r in got.values() if r.n_chars > 300]
    assert np.mean([r.near_edited > r.near_next for r in long_ones]) > 0.9
    single = edited_fingerprints(table(spark, [(9, "only one")])).collect()
    assert single[0].edited_sha256 == hashlib.sha256(b"onlyonly").hexdigest()
    assert edited_fingerprints(table(spark, [])).collect() == []
    assert len(edited_fingerprints(table(spark, [(1, "a"), (1, "a"), (1, "b"), (None, "c")])).collect()) == 4


def brute_repeats(rows):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for x in texts:
        for p in range(len(x) - 199):
            seen[x[p:p + 200]] = seen.get(x[p:p + 200], 0) + 1
    out = []
    for x in texts:
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - 199):
            if seen[x[p:p + 200]] > 1:
                gone[p:p + 200] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((len(x), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [20_000, 1])                 # 1: every block is dealt string by string
def test_repeats_equal_brute_force(spark, monkeypatch, crowd):
    import casespark.llm.repeats as m
    monkeypatch.setattr(m, "CROWD", crowd)
    rng = random.Random(4)

    def words(n):
        return " ".join(rng.choice(["the", "née", "of", "tion", "x"]) + str(rng.randrange(1000)) for _ in range(n))

    passage, short = words(60), words(25)                      # over and under 200 bytes
    texts = [words(40) + passage + words(rng.randrange(40)) for _ in range(6)]
    texts += [words(20) + short + words(20) for _ in range(6)]
    texts += [passage[k:] for k in (0, 1, 57, 150)] + [passage[:-k] for k in (1, 77)]
    texts += [texts[0], texts[0][:150] + "#" + texts[0][151:], "q" * 399, "ab" * 400, "z" * 199, "y" * 200, None, "", "é" * 150]
    texts += [words(300) + passage + words(10) + passage]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    got = sorted((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in remove_repeats(table(spark, rows)).collect())
    assert got == sorted((i, x) for (i, _), x in zip(rows, brute_repeats(rows)))
    assert remove_repeats(table(spark, [])).collect() == []


def crowd(seed, n):
    """Texts of one template, many of them just under the threshold with each other, and unrelated ones of few words."""
    rng = random.Random(seed)
    base = [f"t{i}" for i in range(60)]
    texts = [edited(rng, base, rng.randrange(3, 9)) for _ in range(n // 3)]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(n // 3)]
    texts += [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(80, 160))) for _ in range(n // 3)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_duplicates_of_crowds_and_short_texts_equal_brute_force(spark, monkeypatch):
    """Each pair is compared in one block only, whose texts travel once: no link may get lost by that."""
    import casespark.llm.minhash_dedup as m
    for name, value in (("BIG", 8), ("SIDE", 16)):
        monkeypatch.setattr(m, name, value)
    rows = crowd(4, 240)
    got = {r.doc_id: r.component_id for r in near_duplicates(table(spark, rows), words=2).collect()}
    assert got == components(rows, 2)


def test_lists_hardly_grow_by_chance_and_a_pair_is_met_once(spark, tmp_path):
    """Rows of lists and pairs to estimate: a fault before, when any two of the ten least values made a list."""
    import casespark.llm.minhash_dedup as m
    from casespark.llm.shared import Scratch
    rng = random.Random(5)
    rows = [(i, " ".join(f"v{int(rng.paretovariate(0.6))}" for _ in range(300))) for i in range(400)]
    scratch = Scratch(spark, "lists-test")
    base = table(spark, rows).select(F.col("doc_id").alias("id"), "text")
    nodes = scratch.table(base.mapInArrow(m._sketcher(2), "id long, n long, d1 long, d2 long, sketch binary")
                          .select(F.col("id").alias("node"), "n", "sketch"), "nodes")
    search = m._Search(base, scratch, 2, 80)
    lists = search.lists(nodes)
    sketches = {r.node: [r.sketch[8 * k:8 * k + 8] for k in range(10)] for r in nodes.collect()}
    held = {}
    for node, v in sketches.items():
        for x in range(10):
            for y in range(x):
                held.setdefault((v[y], v[x]), []).append(node)
    before = sum(len(x) for x in held.values() if len(x) > 1)
    assert 4 * lists.count() < before, (lists.count(), before)
    crowds = crowd(6, 300)
    base = table(spark, crowds).select(F.col("doc_id").alias("id"), "text")
    nodes = scratch.table(base.mapInArrow(m._sketcher(2), "id long, n long, d1 long, d2 long, sketch binary").where("n > 0")
                          .groupBy("n", "d1", "d2", "sketch").agg(F.min("id").alias("node")).select("node", "n", "sketch"), "nodes-2")
    search = m._Search(base, scratch, 2, 80)
    parts = nodes.select("node", F.col("node").alias("component")).limit(0)
    large = spark.createDataFrame([], "component long, size long, low long, high long")
    rows = search.open_lists(nodes, search.lists(nodes), parts, large).drop("crowd")
    met = [(r.a, r.b) for r in search._against_all(nodes, rows).collect()]
    assert met and len(met) == len(set(met))
