"""Typed readers and writers.

Every reader declares its schema (no inference); code columns are strings so
leading zeros survive.  gzip CSV is not splittable: read it once and land it as
Parquet (``land_parquet``) before heavy use.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from casespark.session import scratch_path
from casespark.sources.json_array import read_json_array, write_json_array  # noqa: F401

#: tasks that write into one folder of a partitioned table
FILES_PER_FOLDER = 4


# --------------------------------------------------------------------- SRC1 / SRC2
def scan_typed_csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True,
                   sep: str = ",") -> DataFrame:
    """CSV (optionally .gz) with an explicit schema; malformed fields become NULL."""
    return (spark.read.schema(schema).option("header", header).option("sep", sep)
            .option("mode", "PERMISSIVE").option("quote", '"').option("escape", '"').option("multiLine", False)
            .csv(path))


def land_parquet(df: DataFrame, path: str, partitions: int | None = None) -> DataFrame:
    """Write once as Parquet (repartitioned: a gzip file arrives as one partition) and read back."""
    (df.repartition(partitions) if partitions else df).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def parse_times(df: DataFrame, cols: list[str], fmt: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Text -> timestamp without time zone; unparseable text -> NULL."""
    out = df
    for c in cols:
        ok = F.try_to_timestamp(F.col(c), F.lit(fmt)).isNotNull()       # validity only; value parsed without a zone
        out = out.withColumn(c, F.when(ok, F.to_timestamp_ntz(F.col(c), F.lit(fmt))))
    return out


# --------------------------------------------------------------------- SRC3
def read_json_or_lines(spark: SparkSession, path: str, schema: StructType | str, multiline: bool | None = None) -> DataFrame:
    """JSON array files (``multiline=True``, split like any text: see ``json_array``) or JSON lines, with a declared
    schema.  ``multiline=None`` decides by the first non-blank character of the input ('[' = array); what is read for
    that ends at the first closing brace."""
    if multiline is None:
        start = F.substring(F.trim(F.regexp_replace("value", r"\s+", " ")), 1, 1)
        first = spark.read.option("lineSep", "}").text(path).select(start.alias("c")).where("c <> ''").limit(1).collect()
        multiline = bool(first) and first[0]["c"] == "["
    return read_json_array(spark, path, schema) if multiline else spark.read.schema(schema).json(path)


# --------------------------------------------------------------------- SRC4
def decode_list_text(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Python-list text "['a', 'b']" -> array; NULL / 'nan' / '' -> []; bare text -> [text]."""
    c = F.col(col)
    quoted = F.regexp_extract_all(c, F.lit(r"'([^']*)'"), 1)
    is_list = F.trim(c).startswith("[")
    empty = c.isNull() | (F.trim(c) == "") | (F.lower(F.trim(c)) == "nan")
    arr = (F.when(empty, F.array().cast("array<string>")).when(is_list, quoted).otherwise(F.array(F.trim(c))))
    return df.withColumn(out or col, arr)


# --------------------------------------------------------------------- SRC5 / SRC6
def parse_case_list(spark: SparkSession, path: str) -> DataFrame:
    """Text lines 'subject hadm stay' -> three long key columns (blank lines skipped)."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    return (spark.read.text(path).filter(F.trim("value") != "")
            .select(F.get(parts, 0).cast("long").alias("subject_id"), F.get(parts, 1).cast("long").alias("hadm_id"),
                    F.get(parts, 2).cast("long").alias("stay_id")))


def parse_code_map(spark: SparkSession, path: str) -> DataFrame:
    """Lines 'code: path; path' -> one (code, path) row per path."""
    line = F.col("value")
    kv = F.split(line, ": ", 2)
    return (spark.read.text(path).filter(line.contains(": "))
            .select(F.trim(F.get(kv, 0)).alias("code"), F.explode(F.split(F.get(kv, 1), "; ")).alias("path"))
            .select("code", F.trim("path").alias("path")))


# --------------------------------------------------------------------- SRC7
def write_tables(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                 mode: str = "overwrite") -> str:
    """Write ``df`` as files; rows of a folder of ``partition_by`` come from few tasks, a hot folder's from several."""
    if partition_by:
        plain = [f.name for f in df.schema.fields if f.name not in partition_by and not isinstance(f.dataType, (ArrayType, MapType, StructType))]
        dealt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(FILES_PER_FOLDER)) if plain else F.lit(0)
        df = df.repartition(*[F.col(f"`{c}`") for c in partition_by], dealt)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)
    return path


# --------------------------------------------------------------------- SRC8 / SRC9
def key_coverage(tables: dict[str, DataFrame], key: str, sample: DataFrame | None = None) -> DataFrame:
    """Distinct keys per table, how many of them are in the sample, and how many of the sample's keys the table lacks;
    the row ``ANY`` holds the union of all tables, the row ``ALL`` the keys that every table has.
    Output: table, n_keys, n_in_sample, n_sample_missing.  Keys of all tables are shuffled once."""
    found = reduce(lambda a, b: a.unionByName(b), [t.select(F.col(key), F.lit(name).alias("table")) for name, t in tables.items()])
    marks = [sample.select(F.col(key), F.lit("").alias("table"))] if sample is not None else []
    keyed = (reduce(lambda a, b: a.unionByName(b), [found, *marks]).where(F.col(key).isNotNull())
             .groupBy(key).agg(F.collect_set("table").alias("tables")))                  # at most one mark a table
    names = F.array_except("tables", F.array(F.lit("")))
    hits = keyed.select(F.array_contains("tables", "").alias("sampled"), F.explode(F.concat(
        F.transform(F.array(*[F.lit(n) for n in tables]), lambda n: F.struct(n.alias("table"), F.array_contains("tables", n).alias("has"))),
        F.array(F.struct(F.lit("ANY").alias("table"), (F.size(names) > 0).alias("has")),
                F.struct(F.lit("ALL").alias("table"), (F.size(names) == len(tables)).alias("has"))))).alias("x"))
    return hits.groupBy("x.table").agg(F.count_if("x.has").alias("n_keys"), F.count_if(F.col("x.has") & F.col("sampled")).alias("n_in_sample"),
                                       F.count_if(~F.col("x.has") & F.col("sampled")).alias("n_sample_missing"))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
