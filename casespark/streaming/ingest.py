"""Incremental ingestion of model-response logs (Structured Streaming).

Two queries, each exactly once by its own checkpoint:

1. New JSON-lines files in ``in_dir`` are extracted with the whole-table SC24 job.  A micro-batch writes the folder of
   its epoch with overwrite, so a replayed epoch rewrites the same folder: ``extracted`` holds every row, which is the
   invalid table and the history.
2. The extracted rows feed a keyed aggregate: its state holds the row that counts for every key (the first log line, or
   the last for ``last_match``).  The rule looks at line numbers only, so the order of arrival does not matter.

A batch costs what it brings (the state store keeps changes, not copies), and the valid table is read from the state:
one row a key, however long the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casespark.operators.responses import extract_responses

LOG_SCHEMA = ("case_id long, round int, model string, think boolean, temperature double, line_no long, "
              "response string, estimate_tokens long, prompt_tokens long, completion_tokens long, reasoning_tokens long")
KEYS = ("round", "case_id")
_STATE = {"spark.sql.streaming.stateStore.providerClass":
          "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
          "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
          "spark.sql.streaming.stateStore.compression.codec": "zstd"}


def _extracted_schema(keys: tuple[str, ...]) -> str:
    types = dict(c.split() for c in LOG_SCHEMA.split(", "))
    return ", ".join([f"{k} {types[k]}" for k in keys] + ["line_no long", "response string", "status string", "method string",
                                                         "ranked array<string>", "final array<string>"])


def _trigger(writer, available_now: bool):
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")


def ingest_responses(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, profile: str = "one_match",
                     keys: tuple[str, ...] = KEYS, max_files_per_trigger: int | None = None,
                     available_now: bool = True) -> StreamingQuery:
    """Extraction: every log row once, into ``out_dir/extracted``."""
    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        (extract_responses(batch, profile=profile, ranked_key="top10")
         .select(*keys, "line_no", "response", "status", "method", "ranked", "final")
         .write.mode("overwrite").option("compression", "zstd").parquet(f"{out_dir}/extracted/epoch={epoch_id}"))

    reader = spark.readStream.schema(LOG_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    w = reader.json(in_dir).writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    return _trigger(w, available_now).start()


def maintain_valid(spark: SparkSession, out_dir: str, checkpoint: str, profile: str = "one_match", keys: tuple[str, ...] = KEYS,
                   max_files_per_trigger: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Keyed state over the extracted rows: the valid row that counts for every key.

    Only the keys of a batch are touched; what changed is given to the sink and needed by nobody, the state is the table."""
    reader = spark.readStream.schema(_extracted_schema(keys)).option("recursiveFileLookup", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reader.parquet(f"{out_dir}/extracted").where("status = 'valid'")
    pick = F.min_by if profile == "one_match" else F.max_by
    best = rows.groupBy(*keys).agg(pick(F.struct("line_no", "method", "ranked", "final"), F.col("line_no")).alias("row"))
    old = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:                                                       # a query keeps the settings that it starts with
        w = best.writeStream.outputMode("update").foreachBatch(lambda batch, _: batch.write.format("noop").mode("overwrite").save())
        return _trigger(w.option("checkpointLocation", checkpoint), available_now).start()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def valid_responses(spark: SparkSession, checkpoint: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The valid row of every key seen so far, read from the state that ``maintain_valid`` keeps at ``checkpoint``."""
    state = spark.read.format("statestore").load(checkpoint)
    row = next(f.name for f in state.schema["value"].dataType.fields if f.dataType.typeName() == "struct")
    return state.select(*[f"key.{k}" for k in keys], F.col("value").getField(row).alias("row")).select(*keys, "row.*")


def invalid_responses(spark: SparkSession, out_dir: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return (spark.read.schema(_extracted_schema(keys)).option("recursiveFileLookup", True).parquet(f"{out_dir}/extracted")
            .filter(F.col("status") == "invalid"))
