"""Exact order statistics and moments of value columns at any number of rows.

Values are counted first (partial aggregation on the map side), the distinct values are dealt into ranges and written
to the shared folder once.  Totals of the ranges give the range of every wanted rank, and only those ranges are added
up value by value: no task sees a whole column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casespark.session import cut_lineage


def long_form(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows (by…, col, v): every value of every column as double."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in cols]))
    return df.select(*(by or []), pairs.alias("x")).select(*(by or []), "x.col", "x.v")


def ranked_counts(values: DataFrame, by: list[str], value: str = "v", partitions: int | None = None) -> DataFrame:
    """Rows (by…, v, n, part) for the non-null values: how often each occurs, in ranges ``part`` of rising (by, v)."""
    spark = values.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = (values.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v"))
              .agg(F.count(F.lit(1)).alias("n")))
    return cut_lineage(counts.repartitionByRange(partitions, *by, "v").withColumn("part", F.spark_partition_id()))


def order_statistics(counts: DataFrame, by: list[str], quantiles: list[float]) -> DataFrame:
    """Rows (by…, q, value): linearly interpolated quantiles of ``ranked_counts``."""
    parts = counts.groupBy(*by, "part").agg(F.sum("n").alias("_m"))            # a row for each group and range
    over = Window.partitionBy(*by)
    placed = (parts.withColumn("_before", F.sum("_m").over(over.orderBy("part")) - F.col("_m"))
              .withColumn("_total", F.sum("_m").over(over)))
    rank = F.lit(1.0) * F.col("q") * (F.col("_total") - 1)
    wanted = (placed.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
              .withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1))))
              .withColumn("_rank", F.when(F.col("_side") == 0, F.floor(rank)).otherwise(F.ceil(rank)).cast("long"))
              .withColumn("_share", rank - F.floor(rank)))
    hits = wanted.where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_m")))
    needed = counts.join(hits.select(*by, "part", "_before").distinct(), [*by, "part"])
    upto = F.sum("n").over(Window.partitionBy(*by, "part").orderBy("v")) + F.col("_before")
    summed = needed.select(*by, "part", "v", "n", upto.alias("_upto"))
    found = summed.join(hits.select(*by, "part", "q", "_side", "_rank", "_share"), [*by, "part"]).where(
        (F.col("_upto") - F.col("n") <= F.col("_rank")) & (F.col("_rank") < F.col("_upto")))
    low, high = (F.max(F.when(F.col("_side") == s, F.col("v"))) for s in (0, 1))
    return (found.groupBy(*by, "q").agg(low.alias("_low"), high.alias("_high"), F.max("_share").alias("_share"))
            .select(*by, "q", (F.col("_low") + F.col("_share") * (F.col("_high") - F.col("_low"))).alias("value")))


def moments(counts: DataFrame, by: list[str]) -> DataFrame:
    """count, total, mean, min, max and squared deviations (``m2``) of every group of ``ranked_counts``."""
    first = counts.groupBy(*by).agg(F.sum("n").alias("count"), F.sum(F.col("n") * F.col("v")).alias("total"), F.min("v").alias("min"),
                                    F.max("v").alias("max")).withColumn("mean", F.col("total") / F.col("count"))
    away = F.col("v") - F.col("mean")
    second = counts.join(first.select(*by, "mean"), by).groupBy(*by).agg(F.sum(F.col("n") * away * away).alias("m2"))
    return first.join(second, by)


def std(population: bool) -> Column:
    """Standard deviation from ``moments``; a single value has none in the sample form."""
    n = F.col("count") if population else F.when(F.col("count") > 1, F.col("count") - 1)
    return F.sqrt(F.col("m2") / n)


def wide_quantiles(stats: DataFrame, by: list[str], names: dict[float, str]) -> DataFrame:
    """``order_statistics`` with one column for each quantile."""
    return stats.groupBy(*by).agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(n) for q, n in names.items()])


def numbered(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` with ``place``, the 0-based position in ``order`` (a key): ranges are numbered by themselves and moved up
    by what lies before them, so no task orders all rows."""
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(partitions, *order).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_m"))       # a row for each range
    before = F.sum("_m").over(Window.orderBy("_part")) - F.col("_m")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (ranged.withColumn("_own", own).join(parts.select("_part", before.alias("_before")), "_part")
            .withColumn("place", F.col("_before") + F.col("_own") - 1).drop("_part", "_own", "_before"))
