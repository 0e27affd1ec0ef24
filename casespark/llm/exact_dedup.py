"""Exact duplicates through an extendible-hash index on shared files (DataFrame operations only).

Texts are equal when their bytes are equal after all white space ``[\\x20\\x09-\\x0D]`` is deleted.

* Entries: one narrow row per document with the 64-bit key of its normalised text.
* Directory: a key's leading bits name its cell, the cell its bucket.  Doubling the directory splits every bucket that
  holds more than ``capacity`` distinct keys; copies never split a bucket since only distinct keys count.  The number
  of cells follows the number of distinct keys (eight for each bucket that full buckets would need), so buckets hold to
  their capacity at every size.  It is joined without a hint: Spark broadcasts it only while it is small.
* Owner tasks: copies are merged on the map side first, a hot text costs one row per map task.  The texts are then
  dealt by ranges of (bucket, key), so a task owns a range of buckets, chains the texts of each key by their bytes
  and writes the files of its buckets to the shared folder.
* Lookup: a document asks the bucket that the directory names for its key, and only that one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casespark.llm.shared import Scratch

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def depth_for(keys: DataFrame, key_bits: int, capacity: int) -> int:
    """Depth of a directory with about eight cells for each full bucket; no result depends on it."""
    held = keys.agg(F.approx_count_distinct("key")).first()[0]
    return min(key_bits, max(0, math.ceil(math.log2(max(held / capacity, 1)))) + 3)


def directory(keys: DataFrame, key_bits: int, capacity: int, bits: int) -> DataFrame:
    """Cell -> bucket of the extendible-hash directory over the distinct values of column ``key``.

    A cell is the first ``bits`` bits of a key.  The bucket of a cell is the shortest prefix of it, written
    as ``2**depth + prefix``, that holds at most ``capacity`` distinct keys (or the cell itself).
    """
    cells = (keys.select("key").distinct()
             .groupBy(cell(key_bits, bits).alias("cell")).agg(F.count("*").alias("filled")))
    prefixes = cells.select("cell", "filled", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth")).select(
        "cell", "filled", "depth",
        F.expr(f"(1L << depth) + (cell >> ({bits} - depth))").alias("bucket"))
    fits = (prefixes.groupBy("bucket").agg(F.sum("filled").alias("held"))
            .where((F.col("held") <= capacity) | (F.col("bucket") >= F.lit(1 << bits))))
    return prefixes.join(fits, "bucket").groupBy("cell").agg(F.min_by("bucket", "depth").alias("bucket"))


def cell(key_bits: int, bits: int) -> Column:
    """The first ``bits`` bits of ``key``."""
    return F.shiftrightunsigned("key", key_bits - bits) if bits else F.lit(0).cast("long")


def look_up(entries: DataFrame, index: DataFrame, cells: DataFrame, key_bits: int, bits: int) -> DataFrame:
    """The entries with their chains, each from the bucket that the directory names; an entry without one is an error."""
    found = index.select("bucket", "key", "sha", "n_bytes", "keep_id", "group_size")
    return (entries.withColumn("cell", cell(key_bits, bits)).join(cells, "cell", "left")
            .join(found, ["bucket", "key", "sha", "n_bytes"], "left")
            .withColumn("group_size", F.coalesce("group_size", F.raise_error(F.lit("a key is not in the bucket of its cell")).cast("long"))))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, key_bits: int = 64,
                     capacity: int = 4096, max_depth: int | None = None) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    The row of a group with the most code points, then the smallest id, stays.  A null text counts as empty, and all
    texts of white space only form one group with the empty ones.  Rows that repeat an id and its text are counted
    one by one in ``group_size`` and carry equal flags; null ids never win against others.  An empty table gives an
    empty result; further columns are ignored, whatever their names.  ``key_bits`` below 64 only serves to force
    collisions of keys in tests, ``max_depth`` a shallower directory.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = base.select("id", F.char_length("text").alias("n_chars"), normalised(F.col("text")).alias("norm"))
    keyed = texts.withColumn("key", F.shiftrightunsigned(F.xxhash64("norm"), 64 - key_bits) if key_bits < 64
                             else F.xxhash64("norm"))
    entries = scratch.table(
        keyed.select("id", "key", F.octet_length("norm").alias("n_bytes"), F.unhex(F.sha2("norm", 256)).alias("sha")),
        "entries")
    bits = depth_for(entries, key_bits, capacity) if max_depth is None else min(max_depth, key_bits)
    cells = scratch.table(directory(entries, key_bits, capacity, bits), "directory")
    owned = (keyed.groupBy("key", "norm", "n_chars").agg(F.min("id").alias("id"), F.count("*").alias("n"))
             .select("key", "n_chars", "id", "n", F.octet_length("norm").alias("n_bytes"),
                     F.unhex(F.sha2("norm", 256)).alias("sha"), F.xxhash64(F.lit(7), "norm").alias("link"))
             .withColumn("cell", cell(key_bits, bits)).join(cells, "cell").drop("cell")
             .repartitionByRange("bucket", "key"))
    chains = (owned.groupBy("bucket", "key", "sha", "n_bytes")
              .agg(F.max(F.struct("n_chars", F.bitwise_not("id").alias("order"))).alias("best"),
                   F.sum("n").alias("group_size"), F.count_distinct("link").alias("links"))
              .select("bucket", "key", "sha", "n_bytes", F.bitwise_not("best.order").alias("keep_id"),
                      F.when(F.col("links") > 1, F.raise_error(F.lit("two texts share key and digest")).cast("long"))
                      .otherwise(F.col("group_size")).alias("group_size")))
    index = scratch.table(chains.sortWithinPartitions("bucket", "key"), "index")
    return (look_up(entries, index, cells, key_bits, bits)
            .select(F.col("id").alias(id_col), "keep_id", "group_size",
                    F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.lower(F.hex("sha")).alias("text_sha256")))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that stay, with their own columns: one of each group of equal texts.

    A row is known by its id and its text, so the verdict on one text of an id is not that on another; of rows that
    repeat both, one stays."""
    kept = (exact_duplicates(docs, id_col, text_col).where("kept")
            .select(_known(F.col(id_col)).alias("__id"), F.col("text_sha256").alias("__sha")).distinct())
    text = F.col(text_col).cast("string")
    rows = docs.withColumn("__id", _known(F.col(id_col).cast("long"))).withColumn("__sha", F.sha2(normalised(text), 256))
    return one_of_each(rows.join(kept, ["__id", "__sha"], "left_semi"), ["__id", "__sha"],
                       F.char_length(F.coalesce(text, F.lit("")))).select(*docs.columns)


def _known(id_: Column) -> Column:
    """An id as text, null included: joins and groups by it need no null-safe comparison and share one partitioning."""
    return F.coalesce(id_.cast("string"), F.lit("null"))


def one_of_each(rows: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """One row for each value of ``keys``: of greatest ``size``; rows partitioned by the keys are not moved again."""
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in keys]), size).alias("row"))
            .select("row.*"))
