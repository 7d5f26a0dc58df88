"""Registered queries: each has a callable over (spark, sf_dir) and, where SQL can express it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def load() -> None:
    """Import the modules that register queries."""
    from bramble.plans import flagship, q_features, q_labels, q_models, q_sources  # noqa: F401
