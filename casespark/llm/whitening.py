"""Whitening of embeddings with a covariance weighted by multiplicity.

1. Every entry becomes an integer, and rows with the same integer vector form one distinct vector with a count.
2. Integer sums over the distinct vectors, weighted by their counts, give the exact mean; a second pass adds up the
   weighted products of centred vectors, one matrix per task.
3. The eigenvectors of that covariance (a matrix of the dimensions, on the driver) whiten each distinct vector once.
   A further pass measures the covariance of what came out.
4. Results are joined back to the rows.  A vector that holds more than 1/``SHARE`` of all rows (there are fewer than
   ``SHARE`` such vectors) is dealt over as many join keys as its share asks for.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casespark.llm.shared import Scratch
from casespark.llm.vectors import rows_of, scaled, sum_over_tasks, usable

SHARE = 1000
#: scaled entries are held within this bound, so that sums over 2**32 rows fit in 64 bits
LIMIT = 2**30


def _sums(dims: int, counted: bool, column: int, kind: type):
    """Task: weight and weighted sum of the vectors of ``column``; column 0 holds the counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims + 1, kind)
        for batch in batches:
            x, m = rows_of(batch.column(column), dims, kind), batch.column(0).to_numpy(zero_copy_only=False)
            m = m if counted else np.ones_like(m)
            total[0] += m.sum()
            total[1:] += m.astype(kind) @ x
        yield pa.record_batch({"total": pa.array([total.tobytes()], pa.binary())})
    return run


def _products(dims: int, counted: bool, column: int, centred):
    """Task: sum over the vectors of weight times the outer product of the centred vector with itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            c = centred(batch.column(column))
            m = batch.column(0).to_numpy(zero_copy_only=False)
            weight = m.astype(np.float64) if counted else np.ones(len(m))
            total += (c * weight[:, None]).T @ c
        yield pa.record_batch({"total": pa.array([total.tobytes()], pa.binary())})
    return run


def _square_sums(deviations: np.ndarray) -> list[int]:
    """Exact sum of squares of each row of integers."""
    most = int(np.abs(deviations).max(initial=0))
    exact = deviations if most * most * max(1, deviations.shape[1]) < 2**63 else deviations.astype(object)
    return [int(v) for v in (exact * exact).sum(1)]


def covariance(distinct: DataFrame, column: str, dims: int, *, counted: bool, integers: bool) -> tuple[int, np.ndarray, np.ndarray]:
    """Weight n of the vectors of ``column`` (weighted by column ``m``, or each by one), their sums and covariance."""
    vectors = distinct.select("m", column)
    kind = np.int64 if integers else np.float64
    total = sum_over_tasks(vectors.mapInArrow(_sums(dims, counted, 1, kind), "total binary"), kind)
    n, sums = (int(total[0]), total[1:]) if total is not None else (0, np.zeros(dims, kind))
    if not n:
        return 0, sums, np.zeros((dims, dims))
    if integers:
        def centred(part):
            return (n * rows_of(part, dims, np.int64) - sums) / n       # exact up to the division
    else:
        def centred(part):
            return rows_of(part, dims, np.float64) - sums / n
    products = sum_over_tasks(vectors.mapInArrow(_products(dims, counted, 1, centred), "total binary"), np.float64)
    return n, sums, products.reshape(dims, dims) / n


def principal(cov: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling), unit eigenvectors as columns with their largest entry positive, and the trace."""
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    largest = vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] if vectors.size else np.ones(vectors.shape[1])
    return values, vectors * np.where(largest < 0, -1.0, 1.0), float(np.trace(cov))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, components: int = 32, scale: float = 64,
           shift: int = 1_000_000, weights: str = "counts", dims: int | None = None) -> DataFrame:
    """One row per usable row and component: ``id_col, component, n, deviation, whitened, explained, identity_error,
    multiplicity``.

    ``x = floor(scale * entry) + shift``; ``weights`` is ``counts`` (every row fits) or ``one`` (every distinct vector
    fits once).  ``n`` is the size of the fit list, ``deviation`` (decimal) the exact sum of ``(n*x - S)**2``,
    ``explained`` an eigenvalue's share of the trace, ``identity_error`` the largest absolute entry of the whitened
    vectors' covariance minus the identity, over the components with variance.

    Left out are rows whose vector is null, holds a null, NaN or infinite entry, or has another length than ``dims``
    (not given: the length of most usable rows, of equally frequent ones the greater).  Scaled entries are held within
    ``LIMIT``.  Repeated rows and ids are kept one by one, null ids too.  A component without variance (fewer distinct
    vectors than dimensions) has a null ``whitened``; with no variance at all ``explained`` and ``identity_error``
    are null.  An empty table, or vectors without entries, give an empty result.  Other columns are ignored.
    """
    if weights not in ("counts", "one"):
        raise ValueError("weights: counts or one")
    counted = weights == "counts"
    scratch = Scratch(rows.sparkSession, "whitening")
    vector = F.col(vector_col)
    base = (rows.where(usable(vector))
            .select(F.col(id_col).alias("id"), F.transform(scaled(vector, scale, LIMIT), lambda v: v + F.lit(int(shift))).alias("x")))
    if dims is not None:
        base = base.where(F.size("x") == dims)
    distinct = scratch.table(base.groupBy("x").agg(F.count(F.lit(1)).alias("m")), "distinct")
    if dims is None:
        lengths = distinct.groupBy(F.size("x").alias("length")).agg(F.sum("m").alias("n")).orderBy(F.desc("n"), F.desc("length"))
        first = lengths.first()
        dims = first["length"] if first else 0
        base, distinct = base.where(F.size("x") == dims), distinct.where(F.size("x") == dims)
    n, sums, cov = covariance(distinct, "x", dims, counted=counted, integers=True)
    values, axes, trace = principal(cov, min(components, dims))
    varied = values > max(1, dims) * np.finfo(float).eps * max(trace, 0.0)
    project = axes / np.sqrt(np.where(varied, values, 1.0))

    def white(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved = n * rows_of(batch.column(0), dims, np.int64) - sums
            w = np.where(varied, (moved / n) @ project, 0.0)
            yield pa.record_batch({
                "x": batch.column(0), "m": batch.column(1),
                "w": pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), len(values)).cast(pa.list_(pa.float64())),
                "deviation": pa.array([Decimal(v) for v in _square_sums(moved)], pa.decimal128(38))})

    if not len(values):                                        # no rows, or vectors without entries
        return rows.limit(0).select(F.col(id_col), *[F.lit(None).cast(k).alias(c) for c, k in (
            ("component", "int"), ("n", "long"), ("deviation", "decimal(38,0)"), ("whitened", "double"), ("explained", "double"),
            ("identity_error", "double"), ("multiplicity", "long"))])
    whites = scratch.table(distinct.select("x", "m").mapInArrow(white, "x array<bigint>, m long, w array<double>, deviation decimal(38,0)"),
                           "white")
    _, _, after = covariance(whites, "w", len(values), counted=counted, integers=False)
    kept = np.flatnonzero(varied)
    error = float(np.abs(after[np.ix_(kept, kept)] - np.eye(len(kept))).max()) if len(kept) else None

    total = distinct.agg(F.sum("m")).first()[0] or 0
    copies = F.ceil(F.col("m") * SHARE / F.lit(max(1, total))).cast("int")
    hot = whites.where(F.col("m") * SHARE > total).select("x", copies.alias("copies"))          # fewer than SHARE rows
    left = (base.join(F.broadcast(hot), "x", "left")
            .withColumn("copy", F.coalesce(F.pmod(F.xxhash64("id"), F.col("copies")).cast("int"), F.lit(0))).drop("copies"))
    right = whites.select("*", F.explode(F.sequence(F.lit(0), F.greatest(copies, F.lit(1)) - 1)).alias("copy"))
    joined = left.withColumn("h", F.xxhash64("x")).join(right.withColumn("h", F.xxhash64("x")), ["h", "copy", "x"])
    shares = F.array(*[F.lit(float(v / trace) if trace > 0 else None).cast("double") for v in values])
    exists = F.array(*[F.lit(bool(v)) for v in varied])
    return (joined.select("id", "m", "deviation", F.posexplode("w").alias("k", "v"))
            .select(F.col("id").alias(id_col), (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"),
                    "deviation", F.when(exists[F.col("k")], F.col("v")).alias("whitened"), shares[F.col("k")].alias("explained"),
                    F.lit(error).cast("double").alias("identity_error"), F.col("m").alias("multiplicity")))
