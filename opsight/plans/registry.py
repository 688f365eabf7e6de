"""Registry: query name -> (Spark builder, DuckDB oracle SQL or None).

Each operator module registers the *query* that runs its operator over the
fixture views derived from the driver's tables.  ``__spark_entry__`` reads
this registry; nothing else keeps a second list.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    section: str           # SURVEY id, e.g. "R10"
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None     # DuckDB SQL over fx_* views (expanded lazily)


_REGISTRY: dict[str, Query] = {}


def query(name: str, section: str, oracle: str | None = None):
    """Decorator registering ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def deco(fn):
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = Query(name, section, fn, oracle)
        return fn

    return deco


def _load_all() -> None:
    # Import for side effects: each module registers its queries.
    from opsight.operators import (  # noqa: F401
        lag, status, throughput, files, batches, capacity, sessions, actions, lookups,
    )
    from opsight.streaming import streams  # noqa: F401
    from opsight.sources import readers  # noqa: F401


def registry() -> dict[str, Query]:
    _load_all()
    return dict(_REGISTRY)


def oracle_sql(name: str) -> str | None:
    from opsight.sources.fixture_sql import with_fixtures

    q = registry()[name]
    return None if q.oracle is None else with_fixtures(q.oracle)

