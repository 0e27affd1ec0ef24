"""Bring per-group results back to the rows of the groups when a few groups hold much of the table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: a group with more than 1/SHARE of all rows is dealt over several join keys; there are fewer than SHARE such groups
SHARE = 1000


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_k_{k}"]) for k in keys])


def join_back(df: DataFrame, groups: DataFrame, keys: list[str], count: str = "_rows") -> DataFrame:
    """``df`` with the columns of ``groups`` (one row for each key, NULL keys included, with the group's number of rows
    in ``count``).

    Groups with more than 1/``SHARE`` of the rows are found first (the list has a proven bound, so it is broadcast).
    Their result is copied to as many join keys as their share asks for, and their rows are dealt over these by a hash
    of the row: no task gets more than about 1/``SHARE`` of the table through one group."""
    total = groups.agg(F.sum(count)).scalar()
    copies = F.ceil(F.col(count) * SHARE / F.greatest(total, F.lit(1))).cast("int")
    renamed = groups.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    hot = renamed.where(F.col(count) * SHARE > total).select(*[f"_k_{k}" for k in keys], copies.alias("_copies"))
    left = df.join(F.broadcast(hot), _same(df, hot, keys), "left").drop(*[f"_k_{k}" for k in keys])
    dealt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.col("_copies"))
    left = left.withColumn("_copy", F.coalesce(dealt.cast("int"), F.lit(0))).drop("_copies")
    right = renamed.withColumn("_to", F.explode(F.sequence(F.lit(0), F.greatest(copies, F.lit(1)) - 1)))
    on = _same(left, right, keys) & (left["_copy"] == right["_to"])
    return left.join(right, on).drop("_copy", "_to", *[f"_k_{k}" for k in keys])
