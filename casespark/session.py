"""Session helpers.

On a cluster the session comes from the environment; these helpers only add
defaults that are unset.  ``checkpoint_dir`` reads ``spark.checkpoint.dir``
(the shared folder the cluster names) and only falls back to a fresh local
folder when nothing is configured, which is the test situation.
"""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # AQE may merge small shuffle partitions down to one task; the text/regex stages after an
    # aggregate are CPU-bound, so keep merged partitions small enough to use every core.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256KB",
}
# local runs only: the driver JVM is the executor
_LOCAL_DEFAULTS = {"spark.driver.memory": "8g"}


def get_spark(master: str | None = None, app: str = "casespark",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if master and master.startswith("local"):
        conf.update(_LOCAL_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session.

    Only when the session names none (local tests) a new folder is made and
    registered, so that ``DataFrame.checkpoint`` works.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        existing = spark.sparkContext.getCheckpointDir()
        if not existing and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = existing or tempfile.mkdtemp(prefix="casespark-ckpt-")     # tests / local runs only
        try:
            spark.conf.set("spark.checkpoint.dir", path)
        except Exception:  # noqa: BLE001 - core confs may be read-only at run time
            pass
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables."""
    return os.path.join(checkpoint_dir(spark), name)


def release_shuffles(spark: SparkSession) -> None:
    """Shuffle files of plans that nothing uses any more go when the driver drops the plans: now, not at some later time."""
    gc.collect()
    spark._jvm.System.gc()
