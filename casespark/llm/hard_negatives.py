"""Hard negatives by a vertical branch-and-bound scan over decomposed vectors (BOND).

Rows are dealt into blocks of bounded size.  A task turns a block into one array per dimension, ordered by label and
id, with the least and greatest entry of each dimension.  Each anchor reads the dimensions in the order of its own
falling magnitudes; after every few of them, what the dimensions still unread can add at least and at most bounds the
score of every candidate, and candidates that cannot matter leave the bitmap.  What is left at the end has its exact
score.

1. Among rows of the anchor's label: the best ``positives`` of each block, then of all blocks.
2. Among rows of other labels: for each window of scores that an anchor's positives set, the best ``negatives``.

Every anchor meets every block (a search of stated queries against all rows); no pair of rows is ever written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casespark.llm.shared import Scratch
from casespark.llm.vectors import rows_of, scaled, usable

#: dimensions read between two looks at the bounds
STRIDE = 8
BLOCK_ROWS = 16_384
#: scaled entries are held within this bound: scores of up to 256 dimensions are exact in 64 bits
LIMIT = 2**27


class Block:
    """Vectors of one block, one array per dimension, ordered by label, id and row number."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.lexsort((rows, ids, labels))
        self.ids, self.rows, self.labels = ids[order], rows[order], labels[order]
        self.columns = np.ascontiguousarray(x[order].T)
        self.low = self.columns.min(1) if len(rows) else np.zeros(x.shape[1], np.int64)
        self.high = self.columns.max(1) if len(rows) else np.zeros(x.shape[1], np.int64)

    def of_label(self, label: int) -> slice:
        return slice(int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right")))

    def scan(self, anchor: np.ndarray, left: np.ndarray, shrink: Callable[[np.ndarray, np.ndarray], np.ndarray]
             ) -> tuple[np.ndarray, np.ndarray]:
        """Places that stay and their exact scores.

        ``left`` holds the first candidates; ``shrink(least, most)`` gives a bitmap of those to keep from bounds of
        their scores.
        """
        order = np.argsort(-np.abs(anchor), kind="stable")
        q = anchor[order]
        a, b = q * self.low[order], q * self.high[order]
        rest_low = np.append(np.cumsum(np.minimum(a, b)[::-1])[::-1], 0)
        rest_high = np.append(np.cumsum(np.maximum(a, b)[::-1])[::-1], 0)
        score = np.zeros(len(left), np.int64)
        for at in range(0, len(order), STRIDE):
            upto = min(at + STRIDE, len(order))
            for k in range(at, upto):
                if q[k]:
                    score += q[k] * self.columns[order[k]][left]
            keep = shrink(score + rest_low[upto], score + rest_high[upto])
            if not keep.all():
                left, score = left[keep], score[keep]
            if not len(left):
                break
        return left, score

    def best(self, score: np.ndarray, left: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` first by falling score, then id, then row number."""
        if len(score) > count:                                 # all that reach the score of the last one
            sure = np.flatnonzero(score >= np.partition(score, -count)[-count])
        else:
            sure = np.arange(len(score))
        return sure[np.lexsort((self.rows[left[sure]], self.ids[left[sure]], -score[sure]))[:count]]


def _top(count: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Keeps what may be among the ``count`` highest scores."""
    def shrink(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        if len(least) <= count:
            return np.ones(len(least), bool)
        return most >= np.partition(least, -count)[-count]
    return shrink


def _windows(bounds: list[tuple[int, int]], count: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Keeps what may be among the ``count`` highest scores of some window (lowest, highest score)."""
    def shrink(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(least), bool)
        for low, high in bounds:
            fits = (most >= low) & (least <= high)
            sure = least[(least >= low) & (most <= high)]
            if len(sure) > count:
                fits &= most >= np.partition(sure, -count)[-count]
            keep |= fits
        return keep
    return shrink


def window_of(score: int, floor_percent: int) -> tuple[int, int] | None:
    """Scores s with ``floor_percent * score <= 100 * s <= 100 * score``; None where no integer fits."""
    low = -(-floor_percent * score // 100)
    return (low, score) if low <= score else None


_SCAN_IN = "block int, kind int, row long, id long, label long, x array<bigint>, scores array<bigint>"
_SCAN_OUT = "anchor long, window long, score long, id long, row long"


def _scan(dims: int, search: Callable[[Block, dict], Iterator[tuple[int, np.ndarray, np.ndarray]]]):
    """Task over rows sorted by block and kind: kind 0 builds the block, each row of kind 1 is an anchor that searches it.

    ``search`` yields for each window its number, the chosen places and their scores.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, block = None, [], None
        out: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            size = [len(o[2]) for o in out]
            return pa.record_batch({
                "anchor": pa.array(np.repeat(np.array([o[0] for o in out], np.int64), size)),
                "window": pa.array(np.repeat(np.array([o[1] for o in out], np.int64), size)),
                "score": pa.array(np.concatenate([o[2] for o in out])),
                "id": pa.array(ids := np.concatenate([o[3] for o in out]), mask=ids == _NO_ID),
                "row": pa.array(np.concatenate([o[4] for o in out]))})

        for batch in batches:
            blocks, kinds = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            edges = np.flatnonzero(np.r_[True, (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1]), True])
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                part = batch.slice(lo, hi - lo)
                rows, labels = (part.column(k).to_numpy(zero_copy_only=False) for k in (2, 4))
                ids = part.column(3).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
                x = rows_of(part.column(5), dims, np.int64)
                if blocks[lo] != number:
                    number, parts, block = int(blocks[lo]), [], None
                if kinds[lo] == 0:
                    parts.append((ids, rows, labels, x))
                    continue
                if block is None and parts:
                    block = Block(*(np.concatenate(c) for c in zip(*parts)))
                    parts = []
                if block is None:
                    continue
                scores = part.column(6).to_pylist()
                for i in range(hi - lo):
                    anchor = {"row": int(rows[i]), "label": int(labels[i]), "x": x[i], "scores": scores[i]}
                    for window, places, score in search(block, anchor):
                        if len(places):
                            out.append((anchor["row"], window, score, block.ids[places], block.rows[places]))
                            held += len(places)
                    if held > 50_000:
                        yield flush()
                        out, held = [], 0
        if held:
            yield flush()
    return run


#: stands for a null id inside a task: after all others
_NO_ID = 2**63 - 1


def _against_blocks(rows: DataFrame, anchors: DataFrame, blocks: int, dims: int, search) -> DataFrame:
    """Results of ``search`` for every anchor in every block; a block moves once, an anchor once to each block."""
    data = rows.select(F.col("block"), F.lit(0).alias("kind"), "row", "id", "label", "x", F.lit(None).cast("array<bigint>").alias("scores"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "row", "id",
                           "label", "x", "scores")
    met = data.unionByName(asked).repartitionById(blocks, "block").sortWithinPartitions("block", "kind")
    return met.mapInArrow(_scan(dims, search), _SCAN_OUT)


def _first(found: DataFrame, count: int) -> DataFrame:
    """The first ``count`` of each anchor and window over all blocks, with their place from 1."""
    w = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= count)


def mine_hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                        label_col: str = "label", *, positives: int = 5, negatives: int = 5, floor_percent: int = 80,
                        scale: float = 256, label: Column | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each anchor (rows where
    ``is_anchor`` holds) and each of its ``positives`` best other rows of the same label, the first ``negatives`` rows
    of other labels whose score lies between ``floor_percent`` percent of the positive's score and that score.

    A score is the inner product of ``floor(scale * entry)``; higher ones come first, ties by smaller id (null ids
    last).  ``label`` gives another label than ``label_col``.  Rows with a null label or vector, a null, NaN or
    infinite entry, or another number of entries than most usable rows (of equally frequent ones the greater) take no
    part.  Scaled entries are held within ``LIMIT``.  Rows that repeat an id or a whole row are rows of their own:
    each is an anchor and a possible partner of the others.  A negative positive score has an empty window.  An empty
    table, or one without anchors, gives an empty result; other columns are ignored.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "negatives")
    vector = F.col(vector_col)
    good = (rows.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) if label is None else label).cast("long").alias("label"),
                        F.coalesce(is_anchor, F.lit(False)).alias("asks"), vector.alias("v"))
            .where(usable(F.col("v")) & F.col("label").isNotNull()))
    lengths = (good.groupBy(F.size("v").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("length")))
    most = lengths.first()
    dims, n = (most["length"], most["n"]) if most else (0, 0)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n // block_rows), min(tasks, n // 1024))
    # blocks of equal size whatever the ids; row numbers and blocks hold from here on, because the table is written
    dealt = (good.where(F.size("v") == dims).repartition(blocks).withColumn("row", F.monotonically_increasing_id())
             .select("row", F.shiftright("row", 33).cast("int").alias("block"), "id", "label", "asks",
                     scaled(F.col("v"), scale, LIMIT).alias("x")))
    table = scratch.table(dealt, "rows")
    anchors = table.where("asks").withColumn("scores", F.lit(None).cast("array<bigint>"))

    def search_positives(block: Block, anchor: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        same = block.of_label(anchor["label"])
        left = np.arange(same.start, same.stop)
        left, score = block.scan(anchor["x"], left[block.rows[left] != anchor["row"]], _top(positives))
        chosen = block.best(score, left, positives)
        yield 0, left[chosen], score[chosen]

    found = _first(_against_blocks(table, anchors, blocks, dims, search_positives), positives)
    near = scratch.table(found.select("anchor", F.col("id").alias("positive_id"), F.col("row").alias("positive_row"),
                                      F.col("score").alias("positive_score")), "positives")

    def search_negatives(block: Block, anchor: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        bounds = [(p, w) for p in anchor["scores"] if (w := window_of(p, floor_percent))]
        if not bounds:
            return
        same = block.of_label(anchor["label"])
        left = np.r_[0:same.start, same.stop:len(block.rows)]
        left, score = block.scan(anchor["x"], left, _windows([w for _, w in bounds], negatives))
        for p, (low, high) in bounds:
            inside = np.flatnonzero((score >= low) & (score <= high))
            chosen = inside[block.best(score[inside], left[inside], negatives)]
            yield p, left[chosen], score[chosen]

    asked = (table.where("asks").drop("scores")
             .join(near.groupBy("anchor").agg(F.collect_set("positive_score").alias("scores")),      # at most ``positives``
                   F.col("row") == F.col("anchor")))
    windows = _first(_against_blocks(table, asked, blocks, dims, search_negatives), negatives)
    names = table.where("asks").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return (windows.select("anchor", F.col("window").alias("positive_score"), F.col("place").alias("rank"),
                           F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(near, ["anchor", "positive_score"]).join(names, "anchor")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
                    "negative_score"))
