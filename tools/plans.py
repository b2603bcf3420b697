"""Summarise the physical plan of every registered query (writes PLANS.md).

Usage: python tools/plans.py [sf_dir] [out.md]

Counts shuffles (exchanges), join strategies, top-k, windows and Python
evaluation nodes in each query's physical plan.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from caremart.plans.registry import queries  # noqa: E402
from caremart.session import get_session  # noqa: E402


def summary(plan: str) -> dict[str, int]:
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|"
                                   r"RoundRobinPartitioning)", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "bhj": plan.count("BroadcastHashJoin"),
        "smj": plan.count("SortMergeJoin"),
        "nested_loop": plan.count("BroadcastNestedLoopJoin") + plan.count("CartesianProduct"),
        "top_k": plan.count("TakeOrderedAndProject"),
        "window": len(re.findall(r"\bWindow\b", plan)),
        "expand": plan.count("Expand"),
        "python": plan.count("BatchEvalPython") + plan.count("ArrowEvalPython"),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    out = sys.argv[2] if len(sys.argv) > 2 else "PLANS.md"
    spark = get_session("local[8]", 16)
    rows = []
    for name, fn in queries().items():
        plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        rows.append((name, summary(plan)))
    cols = list(rows[0][1])
    with open(out, "w") as f:
        f.write(f"# Physical plan summary ({os.path.basename(sf_dir.rstrip('/'))}, before AQE re-planning)\n\n")
        f.write("Generated by `tools/plans.py`. Counts of plan nodes per registered query: shuffles\n"
                "(exchanges), broadcast hash joins, sort-merge joins, nested-loop joins, top-k,\n"
                "windows, expands (multi-distinct) and Python evaluation.\n\n")
        f.write("| query | " + " | ".join(cols) + " |\n")
        f.write("| --- | " + " | ".join("---" for _ in cols) + " |\n")
        for name, s in rows:
            f.write(f"| {name} | " + " | ".join(str(s[c]) for c in cols) + " |\n")
    spark.stop()


if __name__ == "__main__":
    main()
