"""User scoring hook: apply a user function (prompt -> response) to the
pending cases with retries, as an Arrow-batched ``mapInPandas`` (the only
Python in the hot path, by design: the function is the user's)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casespark.session import scratch_path


def score_cases(cases: DataFrame, fn: Callable[[str], str], prompt: str = "prompt", key: str = "case_id",
                attempts: int = 3, log: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns (scored, failed).  Cases already in ``log`` are skipped (resume).

    The answers are written once to the shared folder and both results read them, so the function runs
    once per case (and again only for tasks that are lost), and a case is in one of the two."""
    spark = cases.sparkSession
    pending = cases.join(log.select(key).distinct(), key, "left_anti") if log is not None else cases

    def run(batches):
        for pdf in batches:
            out = []
            for k, p in zip(pdf[key].tolist(), pdf[prompt].tolist()):
                err, resp, n = None, None, 0
                while n < attempts:
                    n += 1
                    try:
                        resp, err = fn(p), None
                        break
                    except Exception as ex:  # noqa: BLE001 - user function failures are data
                        err = f"{type(ex).__name__}: {ex}"
                out.append((k, resp, n, err))
            yield pd.DataFrame(out, columns=[key, "response", "attempts", "error"])

    schema = f"`{key}` {dict(cases.dtypes)[key]}, response string, attempts int, error string"
    path = scratch_path(spark, f"scored-{uuid.uuid4().hex[:12]}")
    pending.select(key, prompt).mapInPandas(run, schema).write.parquet(path)
    res = spark.read.schema(schema).parquet(path)
    return res.filter(F.col("error").isNull()).drop("error"), res.filter(F.col("error").isNotNull())
