"""Tokenizers, packing, language model and classifier: round trips, brute force and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import casespark.llm.hmm_lm as hmm
from casespark.llm.byte_bpe import ByteBPE
from casespark.llm.hmm_lm import score_texts
from casespark.llm.packing import HARD, OPEN, cuts, pack
from casespark.llm.pieces import PieceModel, Trie, Unigram, decode_pieces, encode_and_decode, encode_pieces
from casespark.llm.quality import quality_scores
from casespark.llm.text_arrays import text_buffers

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, classes string, score string"
ODD = [None, "", " ", "\n\n a", "don't we'll 've", "'s", " 's", "x's's", "日本 語　x", "😀😀", "<|endoftext|>", "a" * 3000, "▁ ▁", "é́\x1c\x85 12 ٣"]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], SCHEMA)


def fuzz(n, seed):
    rng = random.Random(seed)
    parts = ["'s", "'", "'re", " ", "  ", "\n", "\t", "a", "Zé", "٣", "12", "!", "ll", "　", "日本", "😀", "'Ve", "d", "the", ". "]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(15))) for _ in range(n)]


def test_byte_bpe_equals_the_library():
    reference = Tokenizer.from_file(BPE)
    reference.encode_special_tokens = True
    texts = [t or "" for t in ODD] + fuzz(1500, 1)
    encoder = ByteBPE(BPE)
    data, offs = text_buffers(pa.array(texts))
    for _ in range(2):                                         # second time from the table
        ids, counts = encoder.encode(data, offs)
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


def test_cuts_are_optimal():
    rng = random.Random(2)
    for _ in range(60):
        limit = rng.choice([4, 7, 16])
        nodes = np.cumsum([0] + [rng.randrange(1, min(limit, 5)) for _ in range(rng.randrange(1, 9))])
        pen = np.array([0] + [rng.choice([0, 4, HARD]) for _ in nodes[1:]])

        def cost(chosen):
            total, at = 0, 0
            for j in chosen:
                size = int(nodes[j] - nodes[at])
                if size > limit:
                    return math.inf
                total += (0 if size & (size - 1) == 0 else limit - size) + int(pen[j]) + OPEN
                at = j
            return total

        n = len(nodes)
        best = min(cost([j for j, take in zip(range(1, n - 1), bits) if take] + [n - 1]) for bits in product([0, 1], repeat=n - 2))
        assert cost(cuts(nodes, pen, limit)) == best


def test_packing_keeps_every_id_once(spark):
    reference = Tokenizer.from_file(BPE)
    reference.encode_special_tokens = True
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice(["the", "house.", "tree", "ran!"]) for _ in range(rng.choice([5, 300, 2000]))) for _ in range(40)]
    rows = list(enumerate(texts))
    pieces = pack(table(spark, rows + rows[:1]).repartition(3), BPE).collect()
    want = {i: reference.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert len(by_doc[0]) == 2                                 # the repeated row
    for i, t in rows[1:]:
        found = sorted(by_doc[i], key=lambda p: p.start)
        ids = np.frombuffer(b"".join(p.ids for p in found), "<u4").tolist()
        assert ids == want[i] and [p.start for p in found] == list(np.cumsum([0] + [p.length for p in found[:-1]]))
        assert all(p.doc_tokens == len(ids) and len(p.ids) == 4 * p.length for p in found)
    waste = total = 0
    for found in by_sequence.values():
        found.sort(key=lambda p: p.offset)
        assert [p.offset for p in found] == list(np.cumsum([0] + [p.length for p in found[:-1]]))
        size = sum(p.length for p in found)
        assert size == found[0].sequence_length <= 1024
        waste += 0 if size & (size - 1) == 0 else 1024 - size
        total += size
    assert waste < 0.15 * total                                # three partitions, each with an unfinished sequence
    assert pack(table(spark, []), BPE).collect() == []


@pytest.fixture(scope="module")
def unigram():
    model = PieceModel.load(PIECES)
    return Unigram(model, Trie(model))


def best_score(model, text):
    """Brute-force Viterbi over a dictionary, on the whole marked text."""
    marked = "▁" + text.replace(" ", "▁") if text else ""
    pieces = {p: s for p, s, ok in zip(model.pieces, model.scores, model.normal) if ok}
    unknown = min(pieces.values()) - 10
    best = [0.0] + [-math.inf] * len(marked)
    for i in range(len(marked)):
        for k in range(i + 1, min(len(marked), i + 16) + 1):
            s = pieces.get(marked[i:k])
            if s is not None:
                best[k] = max(best[k], best[i] + s)
        if marked[i] not in pieces:
            best[i + 1] = max(best[i + 1], best[i] + unknown)
    return best[-1]


def test_unigram_paths_are_best_and_round_trip(unigram):
    model = unigram.model
    unknown = model.scores[model.normal].min() - 10
    texts = [t or "" for t in ODD] + fuzz(400, 4) + ["zq" * 400]
    for text, ids in zip(texts, unigram.encode(texts)):
        raw = b"".join(bytes([i - model.bytes_at]) if 0 <= i - model.bytes_at < 256 else model.pieces[i].encode() for i in ids)
        marked = "▁" + text.replace(" ", "▁") if text else ""
        assert raw.decode() == marked
        bytes_used = bytes(i - model.bytes_at for i in ids if 0 <= i - model.bytes_at < 256)
        score = sum(model.scores[i] for i in ids if model.normal[i]) + unknown * len(bytes_used.decode())
        assert score == pytest.approx(best_score(model, text), abs=1e-6)


def test_pieces_in_a_table(spark):
    rows = list(enumerate(ODD))
    both = {r.doc_id: (r.ids, r.decoded) for r in encode_and_decode(table(spark, rows), PIECES).collect()}
    assert both == {r.doc_id: (r.ids, r.decoded) for r in decode_pieces(encode_pieces(table(spark, rows), PIECES), PIECES).collect()}
    got = {r.doc_id: r for r in decode_pieces(encode_pieces(table(spark, rows), PIECES), PIECES).collect()}
    for i, t in rows:
        assert got[i].decoded == (t or "").replace("▁", " ")
        assert bool(got[i].ids) == bool(t)
    assert encode_pieces(table(spark, []), PIECES).collect() == []


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def prose(n, seed):
    rng = random.Random(seed)
    words = [[f"{a}{k}" for k in range(120)] for a in ("en", "fr", "de")]
    return [(i, " ".join(rng.choice(words[i % 3][: rng.choice([10, 120])]) for _ in range(rng.randrange(2, 120)))) for i in range(n)]


def test_base_scores_and_gain_on_held_out_rows(spark, monkeypatch):
    monkeypatch.setattr(hmm, "HEAD", 100)                      # most words come from the join
    rows = prose(300, 5) + [(1000, None), (1001, ""), (1002, "never seen before"), (1003, "word " * 5000), (None, "en1 en2")]
    got = score_texts(table(spark, rows + rows[:1])).collect()
    assert len(got) == len(rows) + 1
    held = {i: i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    count = Counter()
    for i, t in rows + rows[:1]:
        if not held[i]:
            count.update(tokens(t))
    n, v = sum(count.values()), len(count)
    texts = dict(rows)
    for r in got:
        w = tokens(texts[r.doc_id])
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(x in count for x in w), n, held[r.doc_id])
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert np.isfinite(r.score)
    ours = [r for r in got if r.held_out and r.doc_id is not None]
    assert sum(r.score for r in ours) > sum(r.base_score for r in ours)
    assert score_texts(table(spark, [])).collect() == []
    alone = score_texts(table(spark, [(None, "a b")])).collect()[0]
    assert (alone.base_score, alone.score, alone.train_tokens) == (0.0, 0.0, 0)


def test_forward_recursion_equals_the_sum_over_paths(monkeypatch):
    monkeypatch.setattr(hmm, "STATES", 2)
    rng = np.random.default_rng(6)
    mass = np.array([0.5, 0.3, 0.2])
    model = {"start": np.array([0.6, 0.4]), "move": np.array([[0.7, 0.3], [0.2, 0.8]]), "emit": rng.dirichlet([1, 1, 1], 2)}
    sequences = [[0, 1, 2, 2], [1], [2, 0]]
    flat = np.array(sum(sequences, []))
    sizes = np.array([len(s) for s in sequences])
    got = hmm.log_ratios(flat, np.cumsum(sizes) - sizes, sizes, model, mass)
    for g, seq in zip(got, sequences):
        total = 0.0
        for path in product([0, 1], repeat=len(seq)):
            p = model["start"][path[0]]
            for t, (s, c) in enumerate(zip(path, seq)):
                p *= model["emit"][s, c] / mass[c] * (model["move"][path[t - 1], s] if t else 1)
            total += p
        assert g == pytest.approx(math.log10(total))


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(7)
    good = ["house", "tree", "river", "walk", "blue", "quiet"]
    rows = [(i, " ".join(rng.choice(good) + ("" if i % 3 else rng.choice(["!!", "$$$", "***"])) for _ in range(rng.randrange(20, 60))))
            for i in range(300)]
    odd = [(900, None), (901, ""), (902, "x" * 100_000), (903, "word " * 20_000)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in rows] + [(5, None, 0), (None, 1, 0), (77777, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_scores(table(spark, rows + odd), labels).collect()}
    assert len(got) == len(rows) + len(odd)
    held = [r for r in got.values() if r.held_out and r.doc_id < 300]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.9
    assert got[900].score == got[901].score
    assert quality_scores(table(spark, []), labels).collect() == []
    unknown = quality_scores(table(spark, rows[:3]), labels.where("false")).collect()
    assert {r.score for r in unknown} == {0.5}
