"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated by temperature.

1. Every word (run of letters, digits or symbols, case kept) has a slot in a table of ``slots`` rows and a fixed
   sparse ternary index vector.  One pass over all documents adds to each word the index vectors of its neighbours
   within ``REACH`` words.  The sums are integers, so they do not depend on the order of tasks; each task sends at
   most ``slots`` rows, and reducers add them up in a stream.
2. A second pass pools the normalised word vectors of each document: weighted mean and standard deviation.
3. The network learns from at most ``max_train_rows`` labelled documents (those with the smallest hash of their id),
   and a temperature is fitted on a part of these that the weights never saw.  The model is a few kilobytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casespark.llm.shared import Scratch, tree_sums
from casespark.llm.text_arrays import mix, span_hashes, steps, text_buffers

SLOTS, DIM, NONZERO, REACH, BLOCK = 1 << 14, 32, 4, 2, 256
WEIGHT = 1e-3                                                  # frequent words count less in the mean
FEATURES = 2 * DIM + 2
#: separators, letters (with all non-ASCII bytes), digits, symbols
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_CLASS[48:58] = 2


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the nonzero entries of every slot's index vector."""
    h = mix(np.arange(SLOTS * NONZERO, dtype=np.uint64) + np.uint64(1)).reshape(SLOTS, NONZERO)
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def word_slots(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot and document number of every word."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _CLASS[data]
    cut = np.ones(n + 1, bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    cut[offs] = True
    edges = np.flatnonzero(cut)
    starts, ends = edges[:-1], edges[1:]
    words = kind[starts] > 0
    starts, ends = starts[words], ends[words]
    slots = (span_hashes(data, starts, ends) % np.uint64(SLOTS)).astype(np.int64)
    return slots, np.searchsorted(offs, starts, "right") - 1


def _neighbour_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    where, sign = index_vectors()
    sums = np.zeros(SLOTS * DIM)
    counts = np.zeros(SLOTS)
    for batch in batches:
        data, offs = text_buffers(batch.column(0))
        for lo, hi in steps(offs):
            slots, doc = word_slots(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
            counts += np.bincount(slots, minlength=SLOTS)
            for gap in range(1, REACH + 1):
                same = doc[gap:] == doc[:-gap]
                left, right = slots[:-gap][same], slots[gap:][same]
                for a, b in ((left, right), (right, left)):
                    for k in range(NONZERO):
                        sums += np.bincount(a * DIM + where[b, k], sign[b, k], SLOTS * DIM)
    table = np.concatenate([sums.reshape(SLOTS, DIM), counts[:, None]], 1).reshape(SLOTS // BLOCK, -1)
    used = np.flatnonzero(counts.reshape(-1, BLOCK).any(1))
    yield pa.record_batch({"block": pa.array(used.astype(np.int32)),
                           "sums": pa.array([table[i].astype(np.int64).tobytes() for i in used], pa.binary())})


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
            add = np.frombuffer(sums.as_buffer(), np.int64)
            total[block] = total[block] + add if block in total else add.copy()
    yield pa.record_batch({"block": pa.array(list(total), pa.int32()),
                           "sums": pa.array([x.tobytes() for x in total.values()], pa.binary())})


def word_vectors(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Unit vector and weight of every slot, from all documents; the table has ``SLOTS`` rows at every input size."""
    schema = "block int, sums binary"
    partial = docs.select(F.col(text_col).cast("string")).mapInArrow(_neighbour_sums, schema)
    blocks = tree_sums(partial, "block", _add_up).collect()                       # SLOTS * (DIM + 1) numbers
    table = np.zeros((SLOTS // BLOCK, BLOCK * (DIM + 1)))
    for row in blocks:
        table[row["block"]] = np.frombuffer(row["sums"], np.int64)
    table = table.reshape(SLOTS, DIM + 1)
    sums, counts = table[:, :DIM], table[:, DIM]
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    vectors = (sums / np.maximum(length, 1e-12)).astype(np.float32)
    share = counts / max(counts.sum(), 1.0)
    return vectors, (WEIGHT / (WEIGHT + share)).astype(np.float32)


def pooled(data: np.ndarray, offs: np.ndarray, vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Features of each document: weighted mean and deviation of its word vectors, lengths; zeros without words."""
    n = len(offs) - 1
    out = np.zeros((n, FEATURES), np.float32)
    for lo, hi in steps(offs):
        slots, doc = word_slots(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
        if not len(slots):
            continue
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        at, w = lo + doc[first], weights[slots]
        words = np.diff(np.r_[first, len(slots)])
        total = np.add.reduceat(w, first)
        for k in range(DIM):
            v = vectors[slots, k]
            mean = np.add.reduceat(v * w, first) / total
            out[at, k] = mean
            plain = np.add.reduceat(v, first) / words
            out[at, DIM + k] = np.sqrt(np.maximum(np.add.reduceat(v * v, first) / words - plain * plain, 0))
        out[at, 2 * DIM] = np.log1p(words)
        out[at, 2 * DIM + 1] = total / words
    return out


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 7) -> dict[str, np.ndarray]:
    """Two-layer network on rows ``x`` and 0/1 labels ``y``, with a temperature from the last fifth of the rows.

    With fewer than 20 rows or a single class the model is the smoothed share of label 1.
    """
    if len(y) < 20 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return {"share": np.array([share])}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    x, y = x[order].astype(np.float64), y[order].astype(np.float64)
    fit = len(y) - max(4, len(y) // 5)
    mean, scale = x[:fit].mean(0), x[:fit].std(0) + 1e-6
    z = (x - mean) / scale
    p = {"w1": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), "b1": np.zeros(hidden),
         "w2": rng.normal(0, 1 / np.sqrt(hidden), hidden), "b2": np.zeros(1)}
    m, v, t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(fit), max(1, fit // 128)):
            h = np.tanh(z[rows] @ p["w1"] + p["b1"])
            d = (1 / (1 + np.exp(-(h @ p["w2"] + p["b2"]))) - y[rows]) / len(rows)
            back = np.outer(d, p["w2"]) * (1 - h * h)
            grads = {"w1": z[rows].T @ back + 1e-4 * p["w1"], "b1": back.sum(0), "w2": h.T @ d + 1e-4 * p["w2"],
                     "b2": np.array([d.sum()])}
            t += 1
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= 0.005 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    logit = np.tanh(z[fit:] @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"]
    heats = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [np.logaddexp(0, np.where(y[fit:] > 0, -1, 1) * logit / heat).mean() for heat in heats]
    return p | {"mean": mean, "scale": scale, "temperature": np.array([heats[int(np.argmin(loss))]])}


def probability(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    if "share" in model:
        return np.full(len(x), model["share"][0])
    z = (x.astype(np.float64) - model["mean"]) / model["scale"]
    logit = (np.tanh(z @ model["w1"] + model["b1"]) @ model["w2"] + model["b2"]) / model["temperature"]
    return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", *, folds: int = 5, max_train_rows: int = 20_000,
                   threshold: float = 0.3) -> DataFrame:
    """One row per input row: ``id_col, held_out, score, predicted``.

    Rows whose ``crc32(id) mod folds`` is 0 (``held_out``) never teach; the word vectors use the texts of all rows
    and no labels.  Null texts count as empty and get the score of a document without words; labels that are null
    or whose id is null or unknown are skipped; repeated labels of an id all count.  Without usable labels every
    score is the smoothed share of label 1.  Only the id, the text and the label are read, whatever else is there.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    vectors, weights = word_vectors(base)
    known = spark.sparkContext.broadcast((vectors, weights))   # SLOTS * (DIM + 1) floats: 2 MB

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vecs, wts = known.value
        for batch in batches:
            data, offs = text_buffers(batch.column(1))
            x = pooled(data, offs, vecs, wts)
            yield pa.record_batch({"id": batch.column(0), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    table = scratch.table(base.mapInArrow(features, "id long, x binary"), "features")
    fold = F.crc32(F.col("id").cast("string").cast("binary")) % folds
    usable = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
              .where("y IS NOT NULL AND id IS NOT NULL").where(fold != 0))
    # a hash bound that leaves about twice as many rows as are wanted, so that no task sends more than its share
    share = min(1.0, 2 * max_train_rows / max(1, usable.count()))
    taught = (table.join(usable.where(F.shiftrightunsigned(F.xxhash64("id"), 32) <= int(share * (2**32 - 1))), "id")
              .orderBy(F.shiftrightunsigned(F.xxhash64("id"), 32), "id", "y", "x").limit(max_train_rows).collect())      # bounded by the parameter
    model = train(np.array([np.frombuffer(r["x"], np.float32) for r in taught]).reshape(len(taught), FEATURES),
                  np.array([r["y"] for r in taught], np.float64))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, FEATURES)
            yield pa.record_batch({"id": batch.column(0), "score": pa.array(probability(model, x), pa.float64())})

    return (table.mapInArrow(score, "id long, score double")
            .select(F.col("id").alias(id_col), F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that the classifier predicts as good, with their own columns (rows of one id share a verdict)."""
    verdicts = (quality_scores(docs, labels, id_col, text_col).groupBy(F.col(id_col).alias("__id"))
                .agg(F.max("predicted").alias("__good")).where("__good = 1"))
    return docs.join(verdicts, docs[id_col].cast("long").eqNullSafe(verdicts["__id"]), "left_semi")
