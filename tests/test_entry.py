"""The driver contract of __spark_entry__."""

import __spark_entry__ as E
from opsight.plans.registry import registry


def test_entry_runs_the_flagship_query(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:4] == ["task_type", "task", "runable", "concurncy"]
    assert E.entry(spark).schema == df.schema


def test_queries_and_oracles_cover_the_same_names():
    own = registry()
    q, o = ({k: f for k, f in x.items() if k in own} for x in (E.queries(), E.oracle_sql()))
    assert set(q) == set(o) == set(own) and len(q) >= 128
    assert all(callable(f) for f in q.values()) and all(s.strip() for s in o.values())
