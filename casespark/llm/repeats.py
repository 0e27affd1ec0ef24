"""Removal of repeated byte strings by sorting sampled suffixes bucket by bucket.

A byte goes when a string of ``LENGTH`` bytes over it also starts anywhere else.  Sorting all suffixes of a corpus is
out of reach, so a cover sample of positions is ranked instead: any two equal strings of LENGTH bytes hold sampled
positions at the same distances from their starts.  (A residue cover modulo v has this for every pair of positions
and samples about 1 / sqrt(v) of the text; here the cover is defined by content, the least hash of the ``GRAM``-byte
strings in every window, which samples one position in 76.)

* Buckets: sampled suffixes are divided by the hash of their first GRAM bytes; a bucket with one suffix ends there.
* Ranks: in a bucket, suffixes are told apart by all bytes that a string over the position can reach (``SIDE`` on
  either side).  Positions of equal rank repeat every string over them.
* Ties that are shorter: of a string over a position either the left or the right ``HALF`` bytes are whole.  Ranks
  that share a half form a block; a task takes the blocks of its keys one chunk after another, sorts the strings of
  one row of each rank by distance and hash, and so finds those that two ranks have.
* Blocks of over ``CROWD`` ranks (the edge of a passage that very many documents share) are not gathered in a task:
  their strings are counted by hash, dealt over all tasks.

Buckets and ranks are counts by hash with partial sums, so a passage in a third of all documents is one row per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casespark.llm.shared import Scratch
from casespark.llm.text_arrays import MORE_CODES, span_hashes, steps, text_buffers

LENGTH, GRAM = 200, 50
SIDE = LENGTH - GRAM
HALF = SIDE // 2
CROWD, CHUNK = 20_000, 4_000
_NO_ID = -2**63


def _sliding(x: np.ndarray, width: int, extreme: np.ufunc, fill: int) -> np.ndarray:
    """Extreme of x[i : i + width] for every i; what lies behind the end counts as ``fill``."""
    n = len(x)
    rows = -(-(n + width) // width)
    padded = np.full(rows * width, fill, x.dtype)
    padded[:n] = x
    grid = padded.reshape(rows, width)
    ahead = extreme.accumulate(grid, axis=1).ravel()
    behind = extreme.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return extreme(behind[:n], ahead[width - 1:width - 1 + n])


def sampled(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the cover sample (least gram of some string of LENGTH bytes, all of equals) and their gram hashes."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    to_end = np.repeat(offs[1:], np.diff(offs)) - np.arange(n)
    h = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    at = np.flatnonzero(to_end >= GRAM)
    h[at] = span_hashes(data, at, at + GRAM) >> np.uint64(1) | np.uint64(1)
    least = _sliding(h, SIDE + 1, np.minimum, np.iinfo(np.uint64).max)
    least[to_end < LENGTH] = 0                                 # no string starts here
    over = _sliding(least[::-1].copy(), SIDE + 1, np.maximum, 0)[::-1]         # strings from a - SIDE to a
    at = np.flatnonzero((over == h) & (to_end >= GRAM))
    return at, h[at]


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = text_buffers(batch.column(2))
        ids, ties = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for lo, hi in steps(offs):
            start = offs[lo:hi + 1] - offs[lo]
            at, h = sampled(data[offs[lo]:offs[hi]], start)
            doc = np.searchsorted(start, at, "right") - 1
            yield pa.record_batch({"key": pa.array(h.astype(np.int64)), "id": pa.array(ids[lo + doc], pa.int64()),
                                   "t": pa.array(ties[lo + doc], pa.int64()), "pos": pa.array(at - start[doc], pa.int64())})


def _per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, t, bytes, list) of every row (id, t, text, list), and its number of bytes."""
    for batch in batches:
        data, offs = text_buffers(batch.column(2))
        for i, (d, t, items) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)))):
            yield d, t, data[offs[i]:offs[i + 1]], items


def _pair(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return span_hashes(data, starts, ends).astype(np.int64), span_hashes(data, starts, ends, MORE_CODES).astype(np.int64)


def _flush(rows: dict[str, list[np.ndarray]]) -> pa.RecordBatch:
    return pa.record_batch({k: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for k, v in rows.items()})


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every sampled position of a shared bucket: hashes of its whole reach, of its halves, and the reach itself."""
    names = ("key", "r1", "r2", "left", "right", "h_left", "h_right", "id", "t", "pos")
    rows, held = {k: [] for k in names}, 0
    for d, t, data, at in _per_document(batches):
        at = np.array(sorted(at), np.int64)
        left, right = np.minimum(at, SIDE), np.minimum(len(data) - at - GRAM, SIDE)
        r1, r2 = _pair(data, at - left, at + GRAM + right)
        values = {"key": (span_hashes(data, at, at + GRAM) >> np.uint64(1) | np.uint64(1)).astype(np.int64), "r1": r1, "r2": r2,
                  "left": left, "right": right, "id": np.full(len(at), d), "t": np.full(len(at), t), "pos": at,
                  "h_left": span_hashes(data, at - np.minimum(left, HALF), at).astype(np.int64),
                  "h_right": span_hashes(data, at + GRAM, at + GRAM + np.minimum(right, HALF)).astype(np.int64)}
        for k in names:
            rows[k].append(values[k].astype(np.int64))
        held += len(at)
        if held > 100_000:
            yield _flush(rows)
            rows, held = {k: [] for k in names}, 0
    yield _flush(rows)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every listed position: the bytes that its strings on the listed side can reach, and how many are before it."""
    names = ("key", "h", "only", "id", "t", "pos", "on_left", "before")
    rows, texts = {k: [] for k in names}, []
    for d, t, data, items in _per_document(batches):
        for x in items:
            low = max(x["pos"] - (SIDE if x["on_left"] else HALF - 1), 0)
            high = min(x["pos"] + GRAM + (HALF if x["on_left"] else SIDE), len(data))
            for k, v in zip(names, (x["key"], x["h"], x["only"], d, t, x["pos"], int(x["on_left"]), x["pos"] - low)):
                rows[k].append(v)
            texts.append(data[low:high].tobytes())
        if len(texts) > CHUNK:
            yield pa.record_batch({k: pa.array(v, pa.int64()) for k, v in rows.items()} | {"bytes": pa.array(texts, pa.binary())})
            rows, texts = {k: [] for k in names}, []
    yield pa.record_batch({k: pa.array(v, pa.int64()) for k, v in rows.items()} | {"bytes": pa.array(texts, pa.binary())})


def repeated_starts(blocks: np.ndarray, on_left: np.ndarray, before: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, distance) of the strings, by how far they start before the row's position, that another row of the same
    block has at the same distance.  Left sides have distances from HALF to SIDE, right sides those below HALF."""
    size = np.array([len(x) for x in texts], np.int64)
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size
    far = np.arange(SIDE + 1)
    row, distance = np.nonzero((far[None] <= before[:, None]) & (before[:, None] - far[None] + LENGTH <= size[:, None])
                               & ((far[None] >= HALF) == (on_left[:, None] > 0)))
    if not len(row):
        return row, distance
    starts = offs[row] + before[row] - distance
    h = span_hashes(data, starts, starts + LENGTH)
    order = np.lexsort((h, distance, blocks[row]))
    b, d, h = blocks[row][order], distance[order], h[order]
    same = (b[1:] == b[:-1]) & (d[1:] == d[:-1]) & (h[1:] == h[:-1])
    twice = order[np.r_[same, False] | np.r_[False, same]]
    return row[twice], distance[twice]


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered runs (id, t, lo, hi) of the rows that stand alone in their rank; blocks arrive sorted."""
    held: list[tuple] = []

    def spans() -> pa.RecordBatch:
        columns = [np.array(c, np.int64) for c in list(zip(*held))[:8]]
        key, h, on_left, only, ids, ties, pos, before = columns
        block = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (h[1:] != h[:-1]) | (on_left[1:] != on_left[:-1])])
        row, distance = repeated_starts(block, on_left, before, [r[8] for r in held])
        mine = only[row] == 1
        row, distance = row[mine], distance[mine]
        order = np.lexsort((distance, row))
        row, distance = row[order], distance[order]
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (distance[1:] != distance[:-1] + 1)]) if len(row) else row
        last = np.r_[first[1:], len(row)] - 1 if len(row) else row
        return pa.record_batch({"id": pa.array(ids[row[first]]), "t": pa.array(ties[row[first]]),
                                "lo": pa.array(pos[row[first]] - distance[last]),
                                "hi": pa.array(pos[row[first]] - distance[first] + LENGTH)})

    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if len(held) >= CHUNK and r[:3] != held[-1][:3]:
                yield spans()
                held = []
            held.append(r)
    if held:
        yield spans()


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of LENGTH bytes over the listed positions, on the side they share with other ranks."""
    names = ("w1", "w2", "only", "id", "t", "start")
    rows, held = {k: [] for k in names}, 0
    for d, t, data, items in _per_document(batches):
        for x in items:
            low = max(x["pos"] - (SIDE if x["on_left"] else HALF), 0)
            high = min(x["pos"] - (0 if x["on_right"] else HALF), len(data) - LENGTH)
            starts = np.arange(low, high + 1)
            if not len(starts):
                continue
            part, shift = data[low:high + LENGTH], starts - low
            w1, w2 = _pair(part, shift, shift + LENGTH)
            n = len(starts)
            for k, v in zip(names, (w1, w2, np.full(n, x["only"]), np.full(n, d), np.full(n, t), starts)):
                rows[k].append(v.astype(np.int64))
            held += n
            if held > 100_000:
                yield _flush(rows)
                rows, held = {k: [] for k in names}, 0
    yield _flush(rows)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for d, t, data, spans in _per_document([batch]):
            change = np.zeros(len(data) + 1, np.int64)
            for s in spans or []:
                change[s["lo"]] += 1
                change[s["hi"]] -= 1
            gone = np.cumsum(change[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
            kept = data[~gone].tobytes()
            out.append((None if d == _NO_ID else d, len(data), int(gone.sum()), len(edges) // 2,
                        [{"lo": int(a), "hi": int(b)} for a, b in edges.reshape(-1, 2)], kept,
                        hashlib.sha256(kept).hexdigest()))
        kinds = {"id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(),
                 "spans": pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])), "kept": pa.binary(), "kept_sha256": pa.string()}
        columns = list(zip(*out)) if out else [()] * len(kinds)
        yield pa.record_batch({k: pa.array(c, kind) for (k, kind), c in zip(kinds.items(), columns)})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, spans, kept, kept_sha256`` for every row.

    ``spans`` are the maximal removed runs (byte offsets), ``kept`` the remaining bytes: a cut may fall inside a
    character.  Strings are judged on the input and never cross documents; a string that repeats inside one document
    counts.  Null texts are empty, texts under LENGTH bytes stay whole, repeated rows are copies of each other (also
    with equal or null ids).  An empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.select("id", F.xxhash64("text").alias("t"), "text")
    sample = scratch.table(base.mapInArrow(_sample, "key long, id long, t long, pos long"), "sample")
    buckets = sample.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    at = scratch.table(sample.join(buckets, "key").groupBy("id", "t").agg(F.collect_set("pos").alias("at")), "at")
    scratch.drop("sample")
    ranked = scratch.table(base.join(at, ["id", "t"]).select("id", "t", "text", "at").mapInArrow(
        _ranks, "key long, r1 long, r2 long, left long, right long, h_left long, h_right long, id long, t long, pos long"), "ranked")
    scratch.drop("at")
    rank = ["key", "r1", "r2", "left", "right"]
    ranks = scratch.table(ranked.groupBy(*rank).agg(F.count("*").alias("n"), F.min(F.struct("id", "t", "pos")).alias("one"),
                                                    F.min("h_left").alias("h_left"), F.min("h_right").alias("h_right")), "ranks")
    repeated = ranks.where(f"n > 1 AND left + right >= {SIDE}").select(*rank)
    whole = ranked.join(repeated, rank).select(
        "id", "t", F.expr("pos - left").alias("lo"), F.expr(f"pos + {GRAM} + right").alias("hi"))
    halves = ranks.where(f"left + right >= {SIDE}").select("one", "n", "key", F.explode(F.array(
        F.struct(F.lit(True).alias("on_left"), F.when(F.col("left") >= HALF, F.col("h_left")).alias("h")),
        F.struct(F.lit(False).alias("on_left"), F.when(F.col("right") >= HALF, F.col("h_right")).alias("h")))).alias("half")
    ).select("one", "n", "key", "half.on_left", "half.h").where("h IS NOT NULL")
    shared = (halves.groupBy("key", "on_left", "h").agg(F.count("*").alias("ranks"), F.min("n").alias("least"))
              .where("ranks > 1 AND least = 1").select("key", "on_left", "h", (F.col("ranks") > CROWD).alias("crowd")))
    asked = scratch.table(halves.join(shared, ["key", "on_left", "h"]).select(
        "one.id", "one.t", "one.pos", "key", "on_left", "h", "crowd", F.when(F.col("n") == 1, 1).otherwise(0).alias("only")), "asked")
    blocks = asked.where("NOT crowd").groupBy("id", "t").agg(F.collect_list(F.struct("pos", "key", "on_left", "h", "only")).alias("items"))
    contexts = base.join(blocks, ["id", "t"]).select("id", "t", "text", "items").mapInArrow(
        _contexts, "key long, h long, only long, id long, t long, pos long, on_left long, before long, bytes binary")
    in_blocks = scratch.table(
        contexts.select("key", "h", "on_left", "only", "id", "t", "pos", "before", "bytes").repartition("key", "h", "on_left")
        .sortWithinPartitions("key", "h", "on_left").mapInArrow(_resolve, "id long, t long, lo long, hi long"), "in-blocks")
    crowds = (asked.where("crowd").groupBy("id", "t", "pos")
              .agg(F.max("on_left").alias("on_left"), F.max(~F.col("on_left")).alias("on_right"), F.min("only").alias("only"))
              .groupBy("id", "t").agg(F.collect_list(F.struct("pos", "on_left", "on_right", "only")).alias("items")))
    strings = scratch.table(base.join(crowds, ["id", "t"]).select("id", "t", "text", "items").mapInArrow(
        _strings, "w1 long, w2 long, only long, id long, t long, start long"), "strings")
    # a string may be listed under several of its positions: count where it starts
    twice = (strings.groupBy("w1", "w2").agg(F.min(F.struct("id", "t", "start")).alias("a"), F.max(F.struct("id", "t", "start")).alias("b"))
             .where("a <> b").select("w1", "w2"))
    single = strings.where("only = 1").join(twice, ["w1", "w2"]).select(
        "id", "t", F.col("start").alias("lo"), F.expr(f"start + {LENGTH}").alias("hi"))
    spans = scratch.table(whole.unionByName(single).unionByName(in_blocks).distinct().groupBy("id", "t")
                          .agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    for name in ("ranked", "ranks", "strings", "asked", "in-blocks"):
        scratch.drop(name)
    return (base.join(spans, ["id", "t"], "left").select("id", "t", "text", "spans")
            .mapInArrow(_cut, "id long, n_bytes long, n_removed long, n_spans long, spans array<struct<lo:long,hi:long>>, "
                              "kept binary, kept_sha256 string")
            .withColumnRenamed("id", id_col))
