"""Replace the members of array columns through a dimension table, by one plan at every size.

Where the caller names the columns that identify a row, rows keep their place: members meet a dimension that fits a
broadcast and are grouped again where they lie.  A dimension without a bound is cut to its exceptions first: a member's
``usual`` values follow from the member itself (or from its first characters), and only members whose values differ are
looked up.  These are found from the distinct members and written, so their real size decides how they are joined.

Without such columns only the members travel, under a digest of their row's content (a retried task finds the same key
whatever the order of its input), and what is found is joined back; equal rows share what was found.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casespark.session import scratch_path

Usual = Callable[[DataFrame], DataFrame]


def itself(_: DataFrame) -> Usual:
    """Usual values of a member: the member alone."""
    return lambda members: members.withColumn("usual", F.array(F.struct(F.col("member").alias("value"))))


def by_stem(values: DataFrame, length: int = 3) -> Usual:
    """Usual values of a member: the least ones of those with its first characters (a table bounded by the alphabet)."""
    stem = F.substring("member", 1, length).alias("_stem")
    least = values.groupBy(stem).agg(F.min("values").alias("usual"))
    return lambda members: members.withColumn("_stem", stem).join(F.broadcast(least), "_stem", "left").drop("_stem")


def _exceptions(members: DataFrame, values: DataFrame, usual: Usual) -> DataFrame:
    """(member, values, odd): the members whose values are not the usual ones, NULL for those without values."""
    every = usual(members.select("member").distinct().join(values, "member", "left"))
    odd = every.where(~F.col("values").eqNullSafe(F.col("usual"))).select("member", "values", F.lit(True).alias("odd"))
    path = scratch_path(odd.sparkSession, f"tables/exceptions-{uuid.uuid4().hex[:12]}")
    odd.write.parquet(path)
    return odd.sparkSession.read.schema(odd.schema).parquet(path)


def lookup_members(df: DataFrame, columns: dict[str, str], dim: DataFrame, key: str = "k", value: str = "v",
                   rows: list[str] | None = None, small: bool = False,
                   usual: Callable[[DataFrame], Usual] | None = None, named: bool = False,
                   among: DataFrame | None = None) -> DataFrame:
    """Add ``out`` for every ``out: array expression`` of ``columns``: the values of its members in order.

    Members without a row in ``dim`` are dropped, one with several gives all of them (in the order of the values); a
    NULL array stays NULL and an empty one empty.  Repeats and all other columns stay.  ``rows``: columns that no two
    rows of ``df`` share (NULL is a value); ``small``: ``dim`` is bounded by construction and is sent to the members;
    ``usual``: what most members' values follow from (of the grouped dimension); ``named``: the items of the results
    are (member, value); ``among``: a frame cheaper to read than ``df`` whose arrays hold every member of ``df``."""
    names, outs = df.columns, list(columns)

    def tag(k: int):
        return F.transform(F.coalesce(F.expr(columns[outs[k]]), F.array()), lambda x, i: F.struct(
            F.lit(k).alias("col"), i.alias("pos"), x.alias("member")))

    def item(x):
        return F.transform(x["values"], lambda v: F.struct(x["member"].alias("member"), v["value"].alias("value")) if named else v["value"])

    def untag(k: int):
        return F.flatten(F.transform(F.filter("_all", lambda x: x["col"] == k), item))

    tagged = F.filter(F.flatten(F.array(*[tag(k) for k in range(len(outs))])), lambda x: x["member"].isNotNull())
    values = dim.groupBy(F.col(key).alias("member")).agg(F.array_sort(F.collect_set(F.struct(F.col(value).alias("value")))).alias("values"))

    def find(members: DataFrame) -> DataFrame:
        """``values`` of every row's ``member``, NULL where there are none."""
        if small or usual is None:
            return members.join(F.broadcast(values) if small else values, "member", "left" if rows is not None else "inner")
        follows = usual(values)
        seen = members if among is None else among.select(F.explode(tagged).alias("m")).select("m.member")
        odd = _exceptions(seen.where("member IS NOT NULL"), values, follows)
        return (follows(members.join(odd, "member", "left"))
                .withColumn("values", F.when(F.col("odd"), F.col("values")).otherwise(F.col("usual"))).drop("odd", "usual"))

    # equal rows give equal members: a set holds them once
    all_ = F.array_sort(F.collect_set(F.when(F.col("values").isNotNull(), F.struct("col", "pos", "member", "values")))).alias("_all")
    if rows is not None:
        ids = {f"_id_{i}": F.col(f"`{c}`") for i, c in enumerate(rows)}
        kept = [c for c in names if c not in rows]
        members = df.select(*[c.alias(n) for n, c in ids.items()], F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(0).alias("_")).alias("_row"),
                            F.explode_outer(tagged).alias("m")).select(*ids, "_row", "m.col", "m.pos", "m.member")
        found = find(members).groupBy(*ids).agg(F.first("_row").alias("_row"), all_)
        place = {c: f"_id_{i}" for i, c in enumerate(rows)}
        back = found.select(*[F.col(place[c]).alias(c) if c in place else F.col(f"_row.`{c}`").alias(c) for c in names], "_all")
    else:
        content = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"})
        digest = F.substring(F.unhex(F.sha2(content, 256)), 1, 16)
        members = df.select(digest.alias("_id"), F.explode(tagged).alias("m")).select("_id", "m.col", "m.pos", "m.member")
        grouped = find(members).where("values IS NOT NULL").groupBy("_id").agg(all_)
        empty = F.array().cast(grouped.schema["_all"].dataType)
        back = (df.select("*", digest.alias("_of")).join(grouped, F.col("_of") == F.col("_id"), "left")
                .withColumn("_all", F.coalesce("_all", empty)))
    return back.select(*[F.col(f"`{c}`") for c in names if c not in outs], *[
        F.when(F.expr(columns[o]).isNotNull(), untag(k)).alias(o) for k, o in enumerate(outs)])
