"""Compare registered Spark queries with their DuckDB oracle SQL.

    python tools/check_oracle.py [--sf /root/testdata/sf0.01] [--fixtures] [name ...]

Rows are compared as multisets after normalising floats (6 decimals) and
timestamps; column names are compared sorted, types by family.
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from opsight.sources.fixtures import TABLES  # noqa: E402

SPARK_FAMILY = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "boolean": "BOOLEAN",
                "date": "DATE", "smallint": "SMALLINT", "float": "FLOAT"}


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, dt.timedelta):
        return v.total_seconds()
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(name, sdf, con, sql, verbose=True):
    t0 = time.time()
    srows = sdf.collect()
    t1 = time.time()
    snames = sdf.columns
    stypes = [SPARK_FAMILY.get(f.dataType.simpleString(), f.dataType.simpleString().upper())
              for f in sdf.schema.fields]
    res = con.execute(sql)
    dnames = [d[0] for d in res.description]
    drows = res.fetchall()
    t2 = time.time()
    dtypes = [str(r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()]
    problems = []
    if sorted(snames) != sorted(dnames):
        problems.append(f"columns spark={snames} duck={dnames}")
    else:
        smap = dict(zip(snames, stypes))
        dmap = dict(zip(dnames, dtypes))
        bad = [(c, smap[c], dmap[c]) for c in snames
               if smap[c] != dmap[c] and not (smap[c].startswith("DECIMAL") and dmap[c].startswith("DECIMAL"))]
        if bad:
            problems.append(f"types {bad}")
    if len(srows) != len(drows):
        problems.append(f"rows spark={len(srows)} duck={len(drows)}")
    if not problems or all(p.startswith("types") for p in problems):
        a, b = rows_of(snames, srows), rows_of(dnames, drows)
        if a != b:
            only_s = list((a - b).elements())[:3]
            only_d = list((b - a).elements())[:3]
            problems.append(f"values differ; spark-only {only_s} duck-only {only_d}")
    status = "OK " if not problems else "BAD"
    if verbose:
        print(f"{status} {name:34s} rows={len(srows):6d} spark={t1 - t0:6.2f}s duck={t2 - t1:5.2f}s"
              + ("" if not problems else "\n      " + "\n      ".join(problems)), flush=True)
    return not problems


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--fixtures", action="store_true")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()

    from opsight.session import get_session
    spark = get_session("local[8]", 8)
    con = duck(a.sf)
    bad = 0
    if a.fixtures:
        from opsight.sources.fixture_sql import FX, with_fixtures
        from opsight.sources.fixtures import Fixtures
        fx = Fixtures(spark, a.sf)
        for n in a.names or FX:
            if n in ("fx_ev", "fx_types"):
                continue
            bad += not compare(n, fx.get(n), con, with_fixtures(f"SELECT * FROM {n}"))
    else:
        from opsight.plans.registry import oracle_sql, registry
        reg = registry()
        for n in a.names or sorted(reg):
            q = reg[n]
            sql = oracle_sql(n)
            try:
                sdf = q.build(spark, a.sf)
                if sql is None:
                    print(f"--  {n:34s} rows={sdf.count():6d} (no oracle)")
                    continue
                bad += not compare(n, sdf, con, sql)
            except Exception as e:  # report and continue
                bad += 1
                print(f"ERR {n:34s} {type(e).__name__}: {str(e)[:600]}", flush=True)
    print(f"done: {bad} problem(s)")


if __name__ == "__main__":
    main()
