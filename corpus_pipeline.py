"""Corpus pipeline over ``documents``: each stage reads what its predecessor wrote.

Quality classifier (documents that it rejects go), exact duplicates (one of each group stays), near duplicates on
shingles of five words (one of each group stays), surrogates for personal data, packing into training sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casespark.llm.exact_dedup import drop_exact_duplicates
from casespark.llm.minhash_dedup import drop_near_duplicates
from casespark.llm.packing import pack
from casespark.llm.pii import pseudonymise
from casespark.llm.plans import PII_KEY, tokenizer_path
from casespark.llm.quality import keep_good
from casespark.llm.shared import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, words=5, percent=80)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates; ``n_chars`` follows the new text."""
    done = pseudonymise(docs, PII_KEY, count_col="n_entities")
    return done.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("pii", private),
    ("packing", packing),
]

#: SQL expresses neither the classifier nor the packing
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
