"""Vocabulary membership for code lists: explode, equi-join with the members that are not in it, regroup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casespark.operators.lookup import itself, lookup_members


def valid_codes_only(df: DataFrame, vocab: DataFrame, col: str, out: str = "valid", errors: str = "n_error",
                     code_col: str = "code", rows: list[str] | None = None,
                     among: DataFrame | None = None) -> DataFrame:
    """Keep list members found in the vocabulary (order and repeats kept) and
    count the others; a NULL list stays NULL with a NULL count.  ``rows``: columns that no two rows share;
    ``among``: a cheaper frame whose lists hold every member of those of ``df``."""
    dim = vocab.select(F.col(code_col).alias("k"), F.col(code_col).alias("v")).distinct()
    return (lookup_members(df, {out: f"`{col}`"}, dim, rows=rows, usual=itself, among=among)
            .withColumn(errors, F.when(F.col(col).isNotNull(), F.size(col) - F.size(out)).cast("long")))
