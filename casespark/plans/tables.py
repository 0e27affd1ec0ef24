"""Case tables of a run: written once, bucketed by the case key, and read by every audit query.

Predictions and labels lie in the same number of buckets of the case key, so their join, the join of several runs and
every aggregate by case read matching buckets and shuffle no prediction.  The tables lie in the shared folder named by
``spark.checkpoint.dir`` and live as long as the application; new input files (another time or length) give new tables.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from casespark.session import scratch_path

_WRITTEN: dict[tuple, tuple[str, str]] = {}


def _file_system(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Time and length of an input: another one asks for new tables."""
    files, jpath = _file_system(spark, path)
    status = files.getFileStatus(jpath)
    return status.getModificationTime(), files.getContentSummary(jpath).getLength()


#: bytes of input files for one bucket: what a task sorts, holds or joins does not grow with the tables
BUCKET_BYTES = 8 << 20


def parts(spark: SparkSession, sf_dir: str, sources: tuple[str, ...]) -> int:
    """Partitions for data of these inputs: the session's number at least, more for large files."""
    size = sum(_stamp(spark, f"{sf_dir.rstrip('/')}/{s}.parquet")[1] for s in sources)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def bucketed(spark: SparkSession, sf_dir: str, name: str, build: Callable[..., DataFrame], *, key: str = "case_id",
             sources: tuple[str, ...] = ("lineitem", "part"), placed: bool = False) -> DataFrame:
    """The table ``name`` of this application and input folder, one sorted file for each bucket of ``key``.

    ``placed``: ``build`` takes the number of buckets and gives rows that lie in them (``repartition(number, key)``)."""
    def write(run: str, path: str) -> str:
        buckets, table = parts(spark, sf_dir, sources), f"casespark_{name}_{run}"
        df = build(buckets) if placed else build().repartition(buckets, key)
        (df.sortWithinPartitions(key).write.format("parquet").option("path", path)
         .bucketBy(buckets, key).sortBy(key).saveAsTable(table))
        return table
    table, _ = _once(spark, sf_dir, name, sources, write)
    return spark.table(table)


def written(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], *, sources: tuple[str, ...]) -> DataFrame:
    """The table ``name`` of this application and input folder as plain Parquet: for keys that may be hot."""
    def write(_: str, path: str) -> str:
        df = build()
        df.write.parquet(path)
        return df.schema.json()
    schema, path = _once(spark, sf_dir, name, sources, write)
    return spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(path)


def _once(spark: SparkSession, sf_dir: str, name: str, sources: tuple[str, ...], write: Callable[[str, str], str]) -> tuple[str, str]:
    mark = (spark.sparkContext.applicationId, name, sf_dir, *(_stamp(spark, f"{sf_dir.rstrip('/')}/{s}.parquet") for s in sources))
    what, path = _WRITTEN.get(mark, ("", ""))
    if not what or not _exists(spark, path):
        run = uuid.uuid4().hex[:12]
        path = scratch_path(spark, f"tables/{name}-{run}")
        what = write(run, path)
        _WRITTEN[mark] = (what, path)
    return what, path


def _exists(spark: SparkSession, path: str) -> bool:
    files, jpath = _file_system(spark, path)
    return files.exists(jpath)
