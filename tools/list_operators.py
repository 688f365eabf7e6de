"""Print the operator index (SURVEY id -> query name -> function module) as markdown."""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from opsight.plans.registry import registry  # noqa: E402


def key(sec: str):
    m = re.match(r"([A-Z]+)(\d+)", sec)
    order = {"L": 0, "R": 1, "T": 2, "F": 3, "B": 4, "C": 5, "G": 6, "D": 7, "ST": 8}
    return (order.get(m.group(1), 9), int(m.group(2)), sec) if m else (10, 0, sec)


def main():
    import importlib
    rows = sorted(registry().values(), key=lambda q: key(q.section))
    print("| SURVEY id | query / function | module | what it computes | oracle |")
    print("| --- | --- | --- | --- | --- |")
    for q in rows:
        mod = importlib.import_module(q.build.__module__)
        fn = getattr(mod, q.name, None)
        doc = ((fn.__doc__ if fn is not None else None) or "").strip().split("\n")[0].replace("|", "\\|")
        name = q.build.__module__.replace("opsight.", "")
        print(f"| {q.section} | `{q.name}` | `{name}` | {doc} | {'DuckDB SQL' if q.oracle else 'rows only'} |")


if __name__ == "__main__":
    main()
