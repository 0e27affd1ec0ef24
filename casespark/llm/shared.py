"""Intermediate tables in the folder that the cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casespark.session import checkpoint_dir


class Scratch:
    """A new sub-folder of the shared folder for one run of an operator.

    ``table`` writes a frame as Parquet and reads it back, which cuts its lineage: a lost executor costs the
    tasks that ran on it, not the stages before the table.  ``drop`` deletes a table that no later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        gc.collect()                                           # shuffle files go when the driver drops their plans
        self.spark._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """``df`` written once in buckets of ``key``: joins on it, however many, shuffle their other side alone."""
        buckets, table = int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"casespark_{uuid.uuid4().hex[:12]}"
        (df.repartition(buckets, key).write.format("parquet").option("path", self.path(name))
         .bucketBy(buckets, key).saveAsTable(table))
        gc.collect()
        self.spark._jvm.System.gc()
        return self.spark.table(table)

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def tree_sums(partial: DataFrame, key: str, add: Callable, fan: int = 1024) -> DataFrame:
    """One row per ``key`` from the partial sums of all tasks, added by ``add`` (mapInArrow) in two steps.

    The first step deals the sums of a key over ``fan`` groups by the task they come from, so that no task reads those
    of all tasks.
    """
    schema = partial.schema
    dealt = partial.withColumn("__group", F.spark_partition_id() % fan).repartition(key, "__group").drop("__group")
    return dealt.mapInArrow(add, schema).repartition(key).mapInArrow(add, schema)
