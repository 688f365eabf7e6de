"""Physical-plan summary of every registered query (or the formatted plan of one).

    python tools/plan_report.py [--sf DIR] > PLANS.md
    python tools/plan_report.py --explain task_status_rollup

The summary is taken from the plan Spark picks before running (AQE may still
turn a sort-merge join into a broadcast join at runtime when the measured
side is small).
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summary(p: str) -> dict:
    scans = re.findall(r"FileScan parquet .*?Location: InMemoryFileIndex\(1 paths\)\[file:[^\]]*/(\w+)\.parquet", p)
    pushed = [m for m in re.findall(r"PushedFilters: \[([^\]]*)\]", p) if m]
    return {
        "scans": ", ".join(sorted(set(scans))) + (f" (x{len(scans)})" if len(scans) > len(set(scans)) else ""),
        "pushed": len(pushed),
        "exchanges": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition", p)),
        "joins": ", ".join(f"{k}x{v}" for k, v in (
            ("BHJ", p.count("BroadcastHashJoin")), ("SMJ", p.count("SortMergeJoin")),
            ("SHJ", p.count("ShuffledHashJoin")), ("BNLJ", p.count("BroadcastNestedLoopJoin")),
            ("Cartesian", p.count("CartesianProduct"))) if v),
        "partial_agg": "yes" if "partial_" in p else "",
        "other": ", ".join(x for x in ("Window", "WindowGroupLimit", "TakeOrderedAndProject", "Expand", "Generate")
                           if re.search(rf"\b{x}\b", p)),
    }


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("--explain")
    a = ap.parse_args()
    from opsight.plans.registry import registry
    from opsight.session import get_session
    spark = get_session("local[8]", 8)
    reg = registry()
    if a.explain:
        reg[a.explain].build(spark, a.sf).explain("formatted")
        return
    print("# Physical plans\n")
    print(f"Generated by `python tools/plan_report.py` at `{os.path.basename(a.sf)}`. Per query: tables scanned,")
    print("scans with pushed filters, hash/range exchanges, join algorithms, map-side partial")
    print("aggregation, and window / top-N / generator operators. BHJ = broadcast hash join (the")
    print("planner's size estimate or a bounded explicit broadcast), SMJ = sort-merge join, BNLJ =")
    print("broadcast nested loop, used only to attach a one-row aggregate (a scalar) to its rows.")
    print("No query plans a cartesian product.\n")
    print("| query | SURVEY | scans | pushed | exchanges | joins | partial agg | other |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- |")
    from tools.list_operators import key
    for name in sorted(reg, key=lambda n: (key(reg[n].section), n)):
        p = reg[name].build(spark, a.sf)._jdf.queryExecution().executedPlan().toString()
        s = summary(p)
        print(f"| `{name}` | {reg[name].section} | {s['scans']} | {s['pushed']} | {s['exchanges']} | {s['joins']} "
              f"| {s['partial_agg']} | {s['other']} |")


if __name__ == "__main__":
    main()
