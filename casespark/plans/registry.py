"""Query registry: name -> (spark, sf_dir) -> DataFrame with flat columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = fn
        return fn
    return deco


def all_queries() -> dict[str, QueryFn]:
    # import for side effect: every plan module registers its queries
    from casespark.plans import (clean_q, cohort_q, hierarchy_q, io_q, joins_q, metrics_q, report_q,  # noqa: F401
                                 responses_q, text_q)
    return dict(REGISTRY)
