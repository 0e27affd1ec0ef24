"""Order-preserving packing of token ids into sequences by dynamic programming.

The ids of the documents of a partition, in their order, form one stream.  A sequence is a window of it of at most
``limit`` ids.  Windows may end at document ends (no penalty), sentence ends (small) or, inside a run of
``REACH`` ids without any, anywhere on a grid (large).  With f(j) the least cost of cutting the stream at j,

    f(j) = penalty(j) + min over j - limit <= i < j of  f(i) + limit - (j - i)

is a sliding minimum of f(i) + i, which a monotone queue gives in constant time per boundary; windows whose length
is a power of two need no padding and are tried as well.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casespark.llm.byte_bpe import ByteBPE
from casespark.llm.text_arrays import steps, text_buffers

SENTENCE, HARD, OPEN, REACH = 4, 64, 8, 64
#: text that the dynamic program sees at a time, after what the windows before it left
STREAM_BYTES = 500_000
SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
          "sequence_length long")


def sentence_ends(encoder: ByteBPE, size: int) -> np.ndarray:
    """Whether the text of an id ends a sentence or a line."""
    letters = {c: b for b, c in enumerate(encoder.alphabet)}
    ends = np.zeros(size, bool)
    for i in range(size):
        token = encoder.model.id_to_token(i)
        if token and letters.get(token[-1]) in b".!?\n":
            ends[i] = True
    return ends


def cuts(nodes: np.ndarray, penalties: np.ndarray, limit: int) -> list[int]:
    """Indices into ``nodes`` (ascending positions, first 0, gaps at most ``limit``) of the cheapest cuts, last included."""
    n = len(nodes)
    jumps: list[list[int]] = [[] for _ in range(n)]             # nodes a power of two before
    p = 1
    while p < limit:
        want = nodes - p
        i = np.searchsorted(nodes, want)
        for j in np.flatnonzero(nodes[i] == want).tolist():
            jumps[j].append(int(i[j]))
        p *= 2
    position, penalty = nodes.tolist(), penalties.tolist()
    key, cost, back = [0] * n, [0] * n, [0] * n                 # key: cost + position
    queue = deque([0])
    for j in range(1, n):
        least = position[j] - limit
        while position[queue[0]] < least:
            queue.popleft()
        i = queue[0]
        best = key[i] + limit - position[j]
        for k in jumps[j]:
            if cost[k] < best:
                best, i = cost[k], k
        cost[j], back[j] = best + penalty[j] + OPEN, i
        key[j] = value = cost[j] + position[j]
        while queue and key[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    out, j = [], n - 1
    while j > 0:
        out.append(j)
        j = back[j]
    return out[::-1]


class _Stream:
    """The uncut rest of the stream: ids and the parts of documents they belong to."""

    def __init__(self, ends: np.ndarray, limit: int):
        self.ends, self.limit = ends, limit
        self.ids = np.zeros(0, np.int32)
        self.parts: list[tuple] = []                            # (doc_id, start in it, length, its ids)
        self.sequences = 0

    def add(self, doc_ids: list, ids: np.ndarray, counts: np.ndarray) -> None:
        self.ids = np.concatenate([self.ids, ids])
        self.parts += [(d, 0, c, c) for d, c in zip(doc_ids, counts.tolist())]

    def windows(self) -> np.ndarray:
        closes = np.cumsum([p[2] for p in self.parts])
        soft = np.flatnonzero(self.ends[self.ids]) + 1
        nodes = np.union1d(np.r_[0, closes], soft)
        gaps = np.flatnonzero(np.diff(nodes) > REACH)
        if len(gaps):
            nodes = np.union1d(nodes, np.concatenate([np.arange(nodes[g] + REACH, nodes[g + 1], REACH) for g in gaps]))
        penalties = np.full(len(nodes), HARD)
        penalties[np.isin(nodes, soft)] = SENTENCE
        penalties[np.isin(nodes, closes)] = 0
        return nodes[cuts(nodes, penalties, self.limit)]

    def pieces(self, first: int, last: bool) -> pa.RecordBatch:
        """Cut what has come; keep the last window for what follows unless this is the end."""
        rows: list[tuple] = []
        edges = self.windows() if self.parts else np.zeros(0, np.int64)
        done = edges if last else edges[:-1]
        stop = int(done[-1]) if len(done) else 0
        part, at, into = 0, 0, 0                                # part number, stream position, ids of the part used
        for lo, hi in zip(np.r_[0, done[:-1]].tolist() if len(done) else [], done.tolist()):
            while at < hi:
                doc, start, length, total = self.parts[part]
                take = min(length - into, hi - at)
                rows.append((doc, start + into, take, self.ids[at:at + take].astype("<u4").tobytes(), total,
                             first + self.sequences, at - lo, hi - lo))
                at, into = at + take, into + take
                if into == length:
                    part, into = part + 1, 0
            self.sequences += 1
        self.ids = self.ids[stop:]
        self.parts = self.parts[part:]
        if into:
            doc, start, length, total = self.parts[0]
            self.parts[0] = (doc, start + into, length - into, total)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        columns = list(zip(*rows)) if rows else [()] * len(kinds)
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, limit: int = 1024,
         closing_id: int = 0) -> DataFrame:
    """Pieces of sequences of at most ``limit`` ids: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset,
    sequence_length``; ``ids`` holds little-endian unsigned 32-bit ids.

    Every document (null text: empty) gives its ids and ``closing_id``; each id lies in exactly one piece and pieces
    follow the order of rows in a partition.  No shuffle; one unfinished sequence per partition.  Repeated rows and
    ids are packed one by one, a text of any length is cut into windows, an empty table gives no piece.  The string of
    a special token counts as ordinary text.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteBPE(tokenizer_path)
        stream = _Stream(sentence_ends(encoder, 1 << 16), limit)
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offs = text_buffers(batch.column(1))
            ids_of = batch.column(0).to_pylist()
            for lo, hi in steps(offs, STREAM_BYTES):
                ids, counts = encoder.encode(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
                ids = np.insert(ids, np.cumsum(counts), closing_id)
                stream.add(ids_of[lo:hi], ids, counts + 1)
                yield stream.pieces(first, last=False)
        yield stream.pieces(first, last=True)

    return base.mapInArrow(run, SCHEMA).withColumnRenamed("doc_id", id_col)
