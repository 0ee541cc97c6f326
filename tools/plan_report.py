"""Physical-plan skeletons of the headline queries (evidence for the scale notes).

    python tools/plan_report.py [sf_dir] > PLANS.md

For each query: number of shuffles, join strategies, window limits, Python
evaluation nodes, and the scan filters/columns, taken from the executed plan
(after AQE, on the given tables).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from postwise.session import get_session  # noqa: E402

QUERIES = [
    "ranked_new_postings", "stamp_and_retain", "daily_report", "sponsor_update", "dedup_first_by_url",
    "rank_scored", "top_k_scored", "cap_per_group", "norm_icims", "norm_workday", "json_job_search",
    "norm_html_ladder", "description_ladder", "cache_hits_ranged", "paged_payload_prefix", "score_plugin",
]

PATTERNS = {
    "shuffles": r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin|Exchange SinglePartition",
    "single_partition_exchanges": r"Exchange SinglePartition",
    "broadcast_hash_joins": r"BroadcastHashJoin",
    "sort_merge_joins": r"SortMergeJoin",
    "shuffled_hash_joins": r"ShuffledHashJoin",
    "broadcast_nested_loop_joins": r"BroadcastNestedLoopJoin",
    "cartesian_products": r"CartesianProduct",
    "partial_window_limits": r"WindowGroupLimit.*Partial",
    "partial_aggregates": r"HashAggregate\(keys=.*functions=\[partial_",
    "python_eval": r"BatchEvalPython|ArrowEvalPython",
    "map_in_pandas": r"MapInPandas",
}


def final_plan(plan: str) -> str:
    """Only the final adaptive plan (the text also prints the initial one)."""
    if "== Final Plan ==" in plan:
        plan = plan.split("== Final Plan ==", 1)[1].split("== Initial Plan ==", 1)[0]
    return plan


def skeleton(plan: str) -> dict:
    plan = final_plan(plan)
    out = {k: len(re.findall(p, plan)) for k, p in PATTERNS.items()}
    scans = []
    for m in re.finditer(r"FileScan parquet \[([^\]]*)\][^\n]*?(PushedFilters: \[[^\]]*\])?[^\n]*?ReadSchema: (struct<[^>]*>)", plan):
        scans.append(f"{m.group(3)} {m.group(2) or ''}".strip())
    out["scans"] = scans
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    from postwise.plans.catalog import load_all

    reg = load_all()
    spark = get_session("local[8]")
    print(f"# Plan skeletons ({sf_dir}, executed plans after AQE)\n")
    print("Generated by `tools/plan_report.py`. Counts are physical operators in the final plan of each query;")
    print("AQE picks broadcast joins for small runtime sizes, so at 100 TB the same joins run as sort-merge")
    print("joins on the key (with skew splitting) — the shuffle keys and the absence of single-task operators")
    print("are what carry over. The only single-partition exchange is the global rank's offset table")
    print("(one row per partition of the ranked data, so bounded by the partition count, not the data).\n")
    for name in QUERIES:
        df = reg[name].run(spark, sf_dir)
        df.collect()  # run through this DataFrame's own execution, so AQE's final plan is shown
        plan = df._jdf.queryExecution().executedPlan().toString()
        sk = skeleton(plan)
        print(f"## {name}\n")
        print(f"{(reg[name].run.__doc__ or '').strip().splitlines()[0]}\n")
        for k, v in sk.items():
            if k != "scans" and v:
                print(f"* {k}: {v}")
        for s in sk["scans"][:6]:
            print(f"* scan: `{s}`")
        print()


if __name__ == "__main__":
    main(sys.argv)
