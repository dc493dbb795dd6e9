"""Registry of the driver-facing queries: name → (Spark plan, oracle SQL).

Each query reads the driver tables of one scale-factor folder (through the
domain derivations), runs one operator of SURVEY §2 on whole tables, and
returns flat columns (arrays joined to text) so that results compare
across engines. The oracle SQL is the same computation in DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skirmish.plans.oracle_tables import with_domain

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` (DuckDB) is omitted for rows-only checks."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_domain(sql)
        return fn

    return deco


def load_all() -> None:
    """Import the query modules (each registers on import)."""
    from skirmish.plans import (  # noqa: F401
        q_filters, q_joins, q_maintain, q_ordered, q_payloads, q_reports, q_scalars, q_sources, q_streams,
    )
