"""All queries of the library and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return put


def load() -> None:
    """Import every module of queries, each of which registers its own."""
    from tessera.plans import chunks, datasets, ingest, labels, logs, metrics, retrieval, streams, texts  # noqa: F401
