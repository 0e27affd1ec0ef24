"""Vector columns as numpy blocks, and sums of per-task arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: groups in which tasks' partial arrays are added before the driver sees them
FAN = 64


def scaled(vector: Column, factor: float, limit: float) -> Column:
    """Long array ``floor(factor * entry)`` of an array column, entries taken as double and held within ``limit``."""
    return F.transform(vector.cast("array<double>"),
                       lambda c: F.floor(F.least(F.greatest(c * float(factor), F.lit(-float(limit))), F.lit(float(limit)))).cast("long"))


def usable(vector: Column) -> Column:
    """Neither null nor holding a null, NaN or infinite entry."""
    finite = F.forall(vector.cast("array<double>"), lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False)))
    return vector.isNotNull() & finite


def rows_of(column: pa.Array, dims: int, kind: type) -> np.ndarray:
    """Matrix of an Arrow list column whose lists all have ``dims`` entries."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), dims)


def sum_over_tasks(parts: DataFrame, kind: type) -> np.ndarray | None:
    """Sum of equally long arrays, one binary row of column ``total`` for each task; None without rows.

    Partial arrays are added in ``FAN`` groups on the executors, so the driver gets that many arrays at any input size.
    """
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                part = np.frombuffer(raw, kind)
                total = part.copy() if total is None else total + part
        if total is not None:
            yield pa.record_batch({"total": pa.array([total.tobytes()], pa.binary())})

    grouped = (parts.withColumn("group", F.spark_partition_id() % FAN).repartition(FAN, "group")
               .select("total").mapInArrow(add, "total binary").collect())
    return sum((np.frombuffer(r["total"], kind) for r in grouped[1:]), np.frombuffer(grouped[0]["total"], kind)) if grouped else None
