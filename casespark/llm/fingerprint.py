"""Document fingerprints: quartile digests of hashed byte triplets, and a bounded difference score.

Every window of four bytes counts three hashed triplets in ``BUCKETS`` buckets.  A bucket's two-bit code tells in which
quartile of the document's own counts it lies; the digest is a length code, two quartile ratios and the codes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casespark.llm.text_arrays import STEP_BYTES, steps, text_buffers

BUCKETS = 128
#: differences at this score or above count as no likeness at all
BOUND = 400
_CODES = np.random.default_rng(31).integers(0, 2**32, (4, 256), dtype=np.uint32)
_COST = np.array([0, 1, 2, 6])                                 # by the distance of two codes


def digests(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Digest rows (length code, two ratios, BUCKETS codes) of all documents; texts under three bytes count nothing."""
    n = len(offs) - 1
    size = np.diff(offs)
    counts = np.zeros((n, BUCKETS), np.int64)
    for lo, hi in steps(offs):
        part, at = data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        if len(part) < 3:
            continue
        doc = np.repeat(np.arange(hi - lo), np.diff(at))
        a, b, c, d = (code[part] for code in _CODES)
        for second, third in ((1, 2), (1, 3), (2, 3)):
            m = len(part) - third
            if m <= 0:
                continue
            inside = doc[:m] == doc[third:]
            h = (a[:m] + b[second:second + m]) ^ (c if third == 2 else d)[third:third + m]
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            bucket = (h >> np.uint32(25)).astype(np.int64)
            counts[lo:hi] += np.bincount((doc[:m] * BUCKETS + bucket)[inside], minlength=(hi - lo) * BUCKETS).reshape(-1, BUCKETS)
    ranked = np.sort(counts, 1)
    q1, q2, q3 = (ranked[:, BUCKETS * k // 4 - 1] for k in (1, 2, 3))
    out = np.zeros((n, 3 + BUCKETS), np.uint8)
    out[:, 0] = np.minimum(255, np.round(np.log(size + 1) / np.log(1.2)))
    out[:, 1] = 15 * q1 // np.maximum(q3, 1)
    out[:, 2] = 15 * q2 // np.maximum(q3, 1)
    out[:, 3:] = (counts > q1[:, None]).astype(np.uint8) + (counts > q2[:, None]) + (counts > q3[:, None])
    return out


def as_text(rows: np.ndarray) -> list[str]:
    """Hex strings: length code, both ratios in one byte, four codes a byte."""
    codes = rows[:, 3:].reshape(len(rows), -1, 4)
    packed = (codes * np.array([64, 16, 4, 1], np.uint8)).sum(2).astype(np.uint8)
    head = np.stack([rows[:, 0], rows[:, 1] * 16 + rows[:, 2]], 1).astype(np.uint8)
    return [r.tobytes().hex() for r in np.concatenate([head, packed], 1)]


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1 for equal digests down to 0 for a difference of ``BOUND`` or more."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    length = np.minimum(4 * np.maximum(np.abs(x[:, 0] - y[:, 0]) - 1, 0), 80) + (x[:, 0] != y[:, 0])
    ratios = np.abs(x[:, 1:3] - y[:, 1:3]).sum(1)
    return 1 - np.minimum(length + ratios + _COST[np.abs(x[:, 3:] - y[:, 3:])].sum(1), BOUND) / BOUND


def _of_texts(texts: list[str]) -> np.ndarray:
    return digests(*text_buffers(pa.array(texts, pa.large_string())))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint`` for every row (null text: empty), without a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(as_text(digests(*text_buffers(batch.column(1)))), pa.string())],
                                  [id_col, "fingerprint"])
    return (docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, f"`{id_col}` long, fingerprint string"))


def with_next(docs: DataFrame, id_col: str, text_col: str, partitions: int) -> DataFrame:
    """Rows (part, copied, id, tie, z): every row in its range of descending ids, sorted, and after the last row of a
    range a copy of the first of the next (after the last range: of the first).  ``z`` is the compressed text.

    The ranges come from a pass over the ids alone; the driver holds two ids for each range.  Texts move once.
    """
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-2**63)).alias("id"), F.col(text_col).cast("string").alias("text"))
    ranges = (base.select("id").repartitionByRange(partitions, F.desc("id")).groupBy(F.spark_partition_id().alias("p"))
              .agg(F.max("id").alias("high"), F.min("id").alias("low")).orderBy(F.desc("high")).collect())
    lows = np.array([~r["low"] for r in ranges], np.int64)     # ascending for descending ids, without overflow
    heads = {r["high"]: (k - 1) % len(ranges) for k, r in enumerate(ranges)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offs = text_buffers(batch.column(1))
            raw = [data[s:e].tobytes() for s, e in zip(offs[:-1].tolist(), offs[1:].tolist())]
            tie = [int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little", signed=True) for t in raw]
            z = [squeeze(t) for t in raw]
            part = np.searchsorted(lows, ~ids).tolist()
            again = [i for i, d in enumerate(ids.tolist()) if d in heads]
            rows = list(range(len(z))) + again
            yield pa.record_batch({
                "part": pa.array(part + [heads[int(ids[i])] for i in again], pa.int32()),
                "copied": pa.array([0] * len(z) + [1] * len(again), pa.int32()),
                "id": pa.array(ids[rows], pa.int64()), "tie": pa.array([tie[i] for i in rows], pa.int64()),
                "z": pa.array([z[i] for i in rows], pa.binary())})

    moved = base.mapInArrow(deal, "part int, copied int, id long, tie long, z binary")
    return moved.repartitionById(max(1, len(ranges)), "part").sortWithinPartitions("part", "copied", F.desc("id"), "tie")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                        partitions: int | None = None) -> DataFrame:
    """``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every row.

    The edited text has the last half of a text's code points replaced by as many from the beginning of the next
    document by descending id (after the last: the first; a single document is its own next).  Null texts count as
    empty; rows that repeat an id follow each other in the order of a hash of their text, null ids come last.  Equal
    texts have equal fingerprints; an empty table gives an empty result; other columns are ignored.
    """
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = (f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        stretch = zstandard.ZstdDecompressor().decompress
        part, rows, held = None, [], 0                          # rows: (id, copied, text)

        def result() -> pa.RecordBatch:
            """Results of the rows whose next is there."""
            texts = [r[2] for r in rows]
            done = [i for i in range(len(rows) - 1) if not rows[i][1]]
            edited = [t[:len(t) - len(t) // 2] + texts[i + 1][:len(t) // 2] for i in done for t in (texts[i],)]
            own, new = _of_texts(texts), _of_texts(edited)
            nxt = own[[i + 1 for i in done]] if done else own[:0]
            mine = own[done] if done else own[:0]
            ids = [rows[i][0] for i in done]
            return pa.record_batch([
                pa.array([None if x == -2**63 else x for x in ids], pa.int64()),
                pa.array([len(texts[i]) for i in done], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array(as_text(mine), pa.string()), pa.array(as_text(new), pa.string()),
                pa.array(likeness(mine, new), pa.float64()), pa.array(likeness(mine, nxt), pa.float64())],
                [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            for p, copied, doc, z in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4))):
                if p != part or held > 4 * STEP_BYTES:
                    if len(rows) > 1:
                        yield result()
                    rows, part, held = rows[-1:] if p == part else [], p, 0
                if copied and rows and rows[-1][1]:
                    continue                                    # only the first copy is the next
                text = stretch(z).decode("utf-8")
                rows.append((doc, copied, text))
                held += len(text)
        if len(rows) > 1:
            yield result()

    return with_next(docs, id_col, text_col, partitions).mapInArrow(run, schema)
