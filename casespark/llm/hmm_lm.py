"""Hidden Markov language model.

Base model: smoothed frequencies of the training tokens.  The ``HEAD`` most frequent words are known to every task;
the counts of all others are looked up by a join.  The hidden Markov model emits word classes (frequent words by
themselves, other head words in hashed classes; words met once, beyond the head or never in one), and a word within its class by the base
model, so a token's probability in a state is its base probability times a ratio of its class.

Baum-Welch: expected counts of transitions and emissions are added up over all partitions, for all training texts in
pieces of ``PIECE`` tokens.  The score of a text is the scaled forward recursion over its whole token sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casespark.llm.shared import Scratch, tree_sums
from casespark.llm.text_arrays import LOWER, span_hashes, steps, text_buffers, word_spans

STATES, ITERATIONS, PIECE = 8, 4, 256
HEAD, OWN_CLASS, HASHED, SEEDS = 1 << 18, 4096, 1024, 256
RARE, END = OWN_CLASS + HASHED, OWN_CLASS + HASHED + 1
CLASSES = END + 1
SMOOTH = 20.0                                                  # tokens of the base model in a state's emissions, besides 2 %
_END_HASH = 0x454E44                                           # the end token's place among the word hashes


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all documents, each document followed by its end, and the number of tokens of each."""
    starts, ends, doc = word_spans(data, offs)
    h = span_hashes(LOWER[data], starts, ends) if len(starts) else np.zeros(0, np.uint64)
    counts = np.bincount(doc, minlength=len(offs) - 1)
    return np.insert(h.astype(np.int64), np.cumsum(counts), _END_HASH), counts + 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        h = np.concatenate([words, *[p[0] for p in parts]])
        c = np.concatenate([times, *[p[1] for p in parts]])
        keys, where = np.unique(h, return_inverse=True)
        return keys, np.bincount(where, c, len(keys)).astype(np.int64)

    for batch in batches:
        data, offs = text_buffers(batch.column(0))
        for lo, hi in steps(offs):
            parts.append(np.unique(_tokens(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])[0], return_counts=True))
            if len(parts) == 8:
                (words, times), parts = merged(), []
                if len(words) > 2_000_000:                     # bounded memory: the shuffle adds the rest up
                    yield pa.record_batch({"h": pa.array(words), "c": pa.array(times)})
                    words, times = words[:0], times[:0]
    words, times = merged()
    yield pa.record_batch({"h": pa.array(words, pa.int64()), "c": pa.array(times, pa.int64())})


def initial_model(bigrams: np.ndarray, mass: np.ndarray, seeds: np.ndarray) -> dict[str, np.ndarray]:
    """States from clusters of the most frequent words that follow each other more often than by chance."""
    k = STATES
    near = (bigrams + bigrams.T) / max(bigrams.sum(), 1.0)
    share = near.sum(1, keepdims=True)
    lift = np.log(np.maximum(near / np.maximum(share * share.T, 1e-12), 1e-3) + 1e-12)
    lift[near == 0] = lift.min() if lift.size else 0
    norm = lift - lift.mean(1, keepdims=True)
    norm /= np.maximum(np.linalg.norm(norm, axis=1, keepdims=True), 1e-9)
    centres = norm[:1]
    for _ in range(1, k):                                      # farthest word next
        centres = np.concatenate([centres, norm[[int(np.argmin((norm @ centres.T).max(1)))]]])
    for _ in range(20):
        group = np.argmax(norm @ centres.T, 1)
        centres = np.stack([norm[group == g].mean(0) if (group == g).any() else centres[g] for g in range(k)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    emit = np.tile(mass, (k, 1))
    for word, g in zip(seeds, np.argmax(norm @ centres.T, 1)):
        emit[:, word] *= 0.2
        emit[g, word] *= 5 * k
    return {"start": np.full(k, 1 / k), "move": np.full((k, k), 0.1 / k) + 0.9 * np.eye(k),
            "emit": emit / emit.sum(1, keepdims=True)}


def expected_counts(classes: np.ndarray, begin: np.ndarray, length: np.ndarray, first: np.ndarray, model: dict,
                    mass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected emissions, transitions and starts over pieces ``classes[begin : begin + length]``.

    A piece inside a text starts from the long-run distribution of the states.
    """
    k = STATES
    move = model["move"].astype(np.float32)
    ratio = (model["emit"] / mass).T.astype(np.float32)
    long_run = np.linalg.matrix_power(model["move"], 64).mean(0).astype(np.float32)
    order = np.argsort(-length, kind="stable")
    begin, length, first = begin[order], length[order], first[order]
    steps_, n = int(length[0]), len(length)
    active = [int(np.searchsorted(-length, -t, "left")) for t in range(steps_)]     # pieces longer than t
    alpha, scale = [], []
    for t in range(steps_):
        m = active[t]
        seen = ratio[classes[begin[:m] + t]]
        a = (np.where(first[:m, None], model["start"].astype(np.float32), long_run) if t == 0 else alpha[-1][:m] @ move) * seen
        z = a.sum(1, keepdims=True)
        alpha.append(a / z)
        scale.append(z)
    emit, moves = np.zeros((k, CLASSES)), np.zeros((k, k))
    beta = np.ones((0, k), np.float32)
    where, gammas = [], []
    for t in range(steps_ - 1, -1, -1):
        m = active[t]
        beta = np.concatenate([beta, np.ones((m - len(beta), k), np.float32)])
        where.append(classes[begin[:m] + t])
        gammas.append(alpha[t] * beta)
        if t:
            step = beta * ratio[classes[begin[:m] + t]] / scale[t]
            moves += (alpha[t - 1][:m].T @ step) * move
            beta = step @ move.T
    gamma, at = np.concatenate(gammas), np.concatenate(where)
    for s in range(k):
        emit[s] = np.bincount(at, gamma[:, s], CLASSES)
    return emit, moves, (gammas[-1] * first[:, None]).sum(0)


def log_ratios(classes: np.ndarray, begin: np.ndarray, length: np.ndarray, model: dict, mass: np.ndarray) -> np.ndarray:
    """log10 of model probability over base probability of each sequence: the scaled forward recursion."""
    ratio = (model["emit"] / mass).T
    order = np.argsort(-length, kind="stable")
    begin, sizes = begin[order], length[order]
    total = np.zeros(len(order))
    a = np.zeros((0, STATES))
    for t in range(int(sizes[0]) if len(sizes) else 0):
        m = int(np.searchsorted(-sizes, -t, "left"))
        a = (np.tile(model["start"], (m, 1)) if t == 0 else a[:m] @ model["move"]) * ratio[classes[begin[:m] + t]]
        z = a.sum(1)
        a /= z[:, None]
        total[:m] += np.log10(z)
    out = np.zeros(len(order))
    out[order] = total
    return out


def _rows(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all rows, and where each row's begin and how many there are."""
    sizes = np.array([len(x) // 2 for x in batch.column(column).to_pylist()], np.int64)
    flat = np.frombuffer(b"".join(batch.column(column).to_pylist()), np.uint16).astype(np.int64)
    return flat, np.cumsum(sizes) - sizes, sizes


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[part] = total.get(part, 0) + np.frombuffer(sums)
    yield pa.record_batch({"part": pa.array(list(total), pa.int32()), "sums": pa.array([x.tobytes() for x in total.values()], pa.binary())})


def baum_welch(encoded: DataFrame, model: dict, mass: np.ndarray) -> dict:
    """One round over the training rows: expected counts by task, added up by rows of the model."""
    shared = encoded.sparkSession.sparkContext.broadcast((model, mass))     # STATES * CLASSES numbers

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, mass = shared.value
        emit, moves, starts = np.zeros((STATES, CLASSES)), np.zeros((STATES, STATES)), np.zeros(STATES)
        for batch in batches:
            flat, begin, sizes = _rows(batch, 0)
            pieces = -(-sizes // PIECE)
            number = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            at = np.repeat(begin, pieces) + number * PIECE
            length = np.minimum(PIECE, np.repeat(begin + sizes, pieces) - at)
            order = np.argsort(length, kind="stable")
            at, length, first = at[order], length[order], (number == 0)[order]
            for lo in range(0, len(at), 4096):
                e, m, s = expected_counts(flat, at[lo:lo + 4096], length[lo:lo + 4096], first[lo:lo + 4096], model, mass)
                emit, moves, starts = emit + e, moves + m, starts + s
        rows = [np.concatenate([emit[s], moves[s], starts[s:s + 1]]) for s in range(STATES)]
        yield pa.record_batch({"part": pa.array(range(STATES), pa.int32()), "sums": pa.array([r.tobytes() for r in rows], pa.binary())})

    schema = "part int, sums binary"
    got = tree_sums(encoded.where("NOT held_out").select("classes").mapInArrow(count, schema), "part", _add_up).collect()
    shared.unpersist()
    rows = np.zeros((STATES, CLASSES + STATES + 1))
    for r in got:
        rows[r["part"]] = np.frombuffer(r["sums"])
    emit, moves, starts = rows[:, :CLASSES] + (SMOOTH + 0.02 * rows[:, :CLASSES].sum(1, keepdims=True)) * mass, rows[:, CLASSES:-1] + 0.1, rows[:, -1] + 0.1
    return {"start": starts / starts.sum(), "move": moves / moves.sum(1, keepdims=True), "emit": emit / emit.sum(1, keepdims=True)}


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, folds: int = 10,
                iterations: int = ITERATIONS) -> DataFrame:
    """One row per input row: ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from the rows whose ``crc32(id) mod folds`` is not 0; rows with a null id teach nothing and count as held
    out.  Null texts are empty and consist of the end token.  Scores are log10 probabilities of the whole token
    sequence; without training rows every token has probability 1.  Repeated rows and ids are scored (and learned
    from) one by one; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "hmm")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn(
        "held_out", F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % folds == 0, F.lit(True)))
    counts = scratch.table(base.where("NOT held_out").select("text").mapInArrow(_count, "h long, c long")
                           .groupBy("h").agg(F.sum("c").alias("c")), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    below = 0.1 * (v + 1) + n
    # the least frequency class from which on there are at most HEAD words
    rank = F.floor(F.log2("c") * 8)
    sizes = sorted(counts.groupBy(rank.alias("rank")).count().collect(), reverse=True)     # a row per class
    fit = int((np.cumsum([r[1] for r in sizes]) <= HEAD).sum())
    head = counts.where(rank >= sizes[fit - 1][0]).toArrow().sort_by([("c", "descending"), ("h", "ascending")]) if fit else None
    words = np.array(head.column("h") if head else [], np.int64)
    times = np.array(head.column("c") if head else [], np.int64)
    kind = np.where(np.arange(len(words)) < OWN_CLASS, np.arange(len(words)),
                    OWN_CLASS + (words.astype(np.uint64) % np.uint64(HASHED)).astype(np.int64))
    kind[times == 1] = RARE                                    # they stand for the words never met
    kind[words == _END_HASH] = END
    share = (times + 0.1) / below
    mass = np.bincount(kind, share, CLASSES)
    mass[RARE] += max(1 - share.sum(), 0.1 / below)
    mass = np.maximum(mass, 1e-300)
    by_hash = np.argsort(words)
    known = spark.sparkContext.broadcast((words[by_hash], times[by_hash], kind[by_hash]))      # HEAD rows

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, times, kind = known.value
        row = TaskContext.get().partitionId() << 40
        bigrams = np.zeros(SEEDS * SEEDS)
        for batch in batches:
            data, offs = text_buffers(batch.column(1))
            for lo, hi in steps(offs):
                h, size = _tokens(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
                doc = np.repeat(np.arange(hi - lo), size)
                spot = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0))
                in_head = words[spot] == h if len(words) else np.zeros(len(h), bool)
                classes = np.where(in_head, kind[spot], np.where(h == _END_HASH, END, RARE)) if len(words) else \
                    np.where(h == _END_HASH, END, RARE)
                logs = np.bincount(doc[in_head], np.log10(times[spot[in_head]] + 0.1), hi - lo)
                heads = np.bincount(doc[in_head], minlength=hi - lo)
                order = np.lexsort((h[~in_head], doc[~in_head]))
                far, far_doc = h[~in_head][order], doc[~in_head][order]
                new = np.flatnonzero(np.r_[True, (far[1:] != far[:-1]) | (far_doc[1:] != far_doc[:-1])]) if len(far) else np.zeros(0, np.int64)
                often = np.diff(np.r_[new, len(far)])
                list_at = np.r_[0, np.cumsum(np.bincount(far_doc[new], minlength=hi - lo))].astype(np.int32)
                taught = ~np.array(batch.column(2).to_pylist()[lo:hi], bool)
                both = (doc[1:] == doc[:-1]) & taught[doc[1:]] & (classes[1:] < SEEDS) & (classes[:-1] < SEEDS)
                bigrams += np.bincount(classes[:-1][both] * SEEDS + classes[1:][both], minlength=SEEDS * SEEDS)
                edge = np.r_[0, np.cumsum(size)]
                raw = classes.astype(np.uint16)
                yield pa.record_batch({
                    "row": pa.array(np.arange(row, row + hi - lo)), "id": batch.column(0).slice(lo, hi - lo),
                    "held_out": batch.column(2).slice(lo, hi - lo), "n_tokens": pa.array(size.astype(np.int64)),
                    "head_log": pa.array(logs.astype(np.float64)), "n_head": pa.array(heads.astype(np.int64)),
                    "classes": pa.array([raw[s:e].tobytes() for s, e in zip(edge[:-1], edge[1:])], pa.binary()),
                    "far": pa.ListArray.from_arrays(list_at, pa.array(far[new], pa.int64())),
                    "often": pa.ListArray.from_arrays(list_at, pa.array(often.astype(np.int64), pa.int64()))})
                row += hi - lo
        yield pa.record_batch({
            "row": pa.array([-1]), "id": pa.array([None], pa.int64()), "held_out": pa.array([True]),
            "n_tokens": pa.array([0], pa.int64()), "head_log": pa.array([0.0]), "n_head": pa.array([0], pa.int64()),
            "classes": pa.array([bigrams.astype(np.int64).tobytes()], pa.binary()),
            "far": pa.array([[]], pa.list_(pa.int64())), "often": pa.array([[]], pa.list_(pa.int64()))})

    written = scratch.table(base.mapInArrow(
        encode, "row long, id long, held_out boolean, n_tokens long, head_log double, n_head long, classes binary, "
        "far array<long>, often array<long>"), "encoded")
    encoded = written.where("row >= 0")

    def add_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SEEDS * SEEDS, np.int64)
        for batch in batches:
            for x in batch.column(1).to_pylist():
                total += np.frombuffer(x, np.int64)
        yield pa.record_batch({"row": pa.array([-1]), "sums": pa.array([total.tobytes()], pa.binary())})

    partial = written.where("row < 0").select("row", F.col("classes").alias("sums"))
    bigrams = np.zeros(SEEDS * SEEDS)
    for r in tree_sums(partial, "row", add_bigrams).collect():
        bigrams += np.frombuffer(r["sums"], np.int64)
    model = initial_model(bigrams.reshape(SEEDS, SEEDS), mass, np.arange(SEEDS))
    for _ in range(iterations if n else 0):
        model = baum_welch(encoded, model, mass)
    final = spark.sparkContext.broadcast((model, mass))

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, mass = final.value
        for batch in batches:
            flat, begin, sizes = _rows(batch, 6)
            gain = log_ratios(flat, begin, sizes, model, mass) if n else np.zeros(batch.num_rows)
            yield pa.record_batch([batch.column(k) for k in range(6)] + [pa.array(gain, pa.float64())],
                                  ["row", "id", "held_out", "n_tokens", "head_log", "n_head", "gain"])

    scored = encoded.select("row", "id", "held_out", "n_tokens", "head_log", "n_head", "classes").mapInArrow(
        forward, "row long, id long, held_out boolean, n_tokens long, head_log double, n_head long, gain double")
    tails = (encoded.select("row", F.explode(F.arrays_zip("far", "often")).alias("x"))
             .select("row", F.col("x.far").alias("h"), F.col("x.often").alias("often"))
             .join(counts, "h", "left")
             .groupBy("row").agg(F.sum(F.col("often") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("far_log"),
                                 F.sum(F.when(F.col("c").isNotNull(), F.col("often")).otherwise(0)).alias("n_far")))
    base_score = (F.col("head_log") + F.coalesce("far_log", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(below))))
    return (scored.join(tails, "row", "left")
            .select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_far", F.lit(0))).alias("n_known"),
                    F.lit(int(n)).alias("train_tokens"), base_score.alias("base_score"),
                    (base_score + F.col("gain")).alias("score")))
