"""Stage and task times from Spark's event log (no UI).

    python tools/stage_report.py [--sf DIR] [name ...]

Runs the queries with ``spark.eventLog.enabled`` writing into a fresh scratch
folder, then reads the log: per query the number of jobs, stages and tasks,
the summed task time, and the worst stage's max / median task time (a skew
ratio near 1 means no task dominates its stage).
"""

from __future__ import annotations

import argparse
import glob
import json
import os
import statistics
import sys
import tempfile
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _lines(path: str):
    """Lines of one (rolling, possibly zstd-compressed) event log file."""
    if path.endswith(".zstd"):
        import io
        import zstandard
        with open(path, "rb") as fh:
            data = zstandard.ZstdDecompressor().stream_reader(fh).read()
        yield from io.StringIO(data.decode("utf-8"))
    else:
        with open(path) as fh:
            yield from fh


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    log_dir = tempfile.mkdtemp(prefix="opsight-eventlog-")
    from opsight.plans.registry import registry
    from opsight.session import get_session
    spark = get_session("local[8]", 8, app_name="opsight-stages",
                        extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir})
    reg = registry()
    names = a.names or sorted(reg)
    sc = spark.sparkContext
    for name in names:
        sc.setJobGroup(name, name)
        reg[name].build(spark, a.sf).write.format("noop").mode("overwrite").save()
    spark.stop()

    job_group, stage_job, tasks = {}, {}, defaultdict(list)
    for path in glob.glob(os.path.join(log_dir, "**", "events_*"), recursive=True):
        for line in _lines(path):
            ev = json.loads(line)
            kind = ev.get("Event")
            if kind == "SparkListenerJobStart":
                props = ev.get("Properties") or {}
                job_group[ev["Job ID"]] = props.get("spark.jobGroup.id")
                for sid in ev.get("Stage IDs", []):
                    stage_job[sid] = ev["Job ID"]
            elif kind == "SparkListenerTaskEnd":
                info = ev["Task Info"]
                tasks[ev["Stage ID"]].append(info["Finish Time"] - info["Launch Time"])
    per = defaultdict(lambda: {"jobs": set(), "stages": 0, "tasks": 0, "ms": 0, "skew": 1.0})
    for sid, times in tasks.items():
        q = job_group.get(stage_job.get(sid))
        if q is None:
            continue
        r = per[q]
        r["jobs"].add(stage_job[sid])
        r["stages"] += 1
        r["tasks"] += len(times)
        r["ms"] += sum(times)
        med = statistics.median(times)
        if len(times) >= 4 and med > 0:
            r["skew"] = max(r["skew"], max(times) / med)
    print("| query | jobs | stages | tasks | task ms | worst stage max/median |")
    print("| --- | --- | --- | --- | --- | --- |")
    for q in names:
        r = per.get(q)
        if r:
            print(f"| `{q}` | {len(r['jobs'])} | {r['stages']} | {r['tasks']} | {r['ms']} | {r['skew']:.1f} |")
    print(f"\nevent log: {log_dir}")


if __name__ == "__main__":
    main()
