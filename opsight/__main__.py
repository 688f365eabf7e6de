"""Command line: list the registered checks, run one, show it or write it as a sheet.

    python -m opsight list
    python -m opsight run task_status_rollup --sf /root/testdata/sf0.01 [--out DIR] [--show 20]
    python -m opsight sql task_status_rollup          # the DuckDB twin of a check
    python -m opsight checklist --sf DIR --out DIR     # every daily check as a CSV sheet

``--out`` writes the whole result as CSV with a header (the workbook sheet of
the checklist); ``--show`` only limits what is printed.
"""

from __future__ import annotations

import argparse
import sys


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="python -m opsight")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    r = sub.add_parser("run")
    r.add_argument("name")
    r.add_argument("--sf", default="/root/testdata/sf0.01")
    r.add_argument("--out")
    r.add_argument("--show", type=int, default=20)
    q = sub.add_parser("sql")
    q.add_argument("name")
    c = sub.add_parser("checklist")
    c.add_argument("--sf", default="/root/testdata/sf0.01")
    c.add_argument("--out", required=True)
    a = ap.parse_args(argv)

    from opsight.plans.registry import oracle_sql, registry
    reg = registry()
    if a.cmd == "list":
        def order(kv):
            sec = kv[1].section
            head = sec.rstrip("0123456789-src")
            num = "".join(ch for ch in sec[len(head):] if ch.isdigit())
            return ("LRTFBCGDS".find(head[:1]), int(num or 0), sec)

        for name, q in sorted(reg.items(), key=order):
            print(f"{q.section:8s} {name}")
        return 0
    if a.cmd == "checklist":
        from opsight.plans.checklist import run_checklist
        from opsight.session import get_session
        for path in run_checklist(get_session("local[*]"), a.sf, a.out):
            print(path)
        return 0
    if a.name not in reg:
        print(f"unknown check {a.name!r}; see `python -m opsight list`", file=sys.stderr)
        return 2
    if a.cmd == "sql":
        print(oracle_sql(a.name))
        return 0

    from opsight.session import get_session
    from opsight.sources.readers import to_sheet
    spark = get_session("local[*]")
    df = reg[a.name].build(spark, a.sf)
    if a.out:
        to_sheet(df, a.out)
        print(f"wrote {a.out}")
    else:
        df.show(a.show, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
