"""Summarise the physical plan of every registered query (operator counts) into PLANS.md."""
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NODES = ["Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition", "BroadcastExchange",
         "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct",
         "HashAggregate", "ObjectHashAggregate", "SortAggregate", "WindowGroupLimit", "Window", "TakeOrderedAndProject",
         "Generate", "MapInPandas", "BatchEvalPython", "ArrowEvalPython"]


def count(plan, node):
    if node == "Window":
        return len(re.findall(r"(?<![A-Za-z])Window(?!GroupLimit)\b", plan))
    return plan.count(node)


def main(sf="/root/testdata/sf0.1"):
    from casespark.plans.registry import all_queries
    from casespark.session import get_spark
    spark = get_spark("local[8]", shuffle_partitions=16)
    qs = all_queries()
    rows = []
    for k in sorted(qs):
        if k == "ingest_responses":
            continue
        p = qs[k](spark, sf)._jdf.queryExecution().executedPlan().toString()
        rows.append((k, {n: count(p, n) for n in NODES}))
    short = {"Exchange hashpartitioning": "hash xchg", "Exchange rangepartitioning": "range xchg",
             "Exchange SinglePartition": "single xchg", "BroadcastExchange": "bcast", "SortMergeJoin": "SMJ",
             "BroadcastHashJoin": "BHJ", "ShuffledHashJoin": "SHJ", "BroadcastNestedLoopJoin": "BNLJ",
             "CartesianProduct": "cart", "HashAggregate": "hash agg", "ObjectHashAggregate": "obj agg",
             "SortAggregate": "sort agg", "WindowGroupLimit": "win limit", "Window": "window",
             "TakeOrderedAndProject": "top-k", "Generate": "explode", "MapInPandas": "pandas",
             "BatchEvalPython": "py udf", "ArrowEvalPython": "arrow udf"}
    used = [n for n in NODES if any(r[1][n] for r in rows)]
    out = ["# Physical plans (initial AQE plans at sf0.1, operator counts per query)", "",
           "Generated by `python tools/plan_report.py`.  Exchanges are the shuffles; `bcast` are broadcasts of",
           "bounded sides; `win limit` is the partial top-n before a shuffle.  No query has a cartesian product or",
           "a row-at-a-time Python UDF; `pandas` appears only in the user scoring hook.", "",
           "| query | " + " | ".join(short[n] for n in used) + " |", "| --- |" + " --- |" * len(used)]
    for k, c in rows:
        out.append(f"| {k} | " + " | ".join(str(c[n]) if c[n] else "" for n in used) + " |")
    open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w").write("\n".join(out) + "\n")
    print("wrote PLANS.md", len(rows))


if __name__ == "__main__":
    main()
