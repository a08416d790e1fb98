"""Queries of the core: name -> callable, and the SQL that must give the same rows."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
AREAS = ("index", "text", "graph", "sources", "more")


def prepared(f):
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return f(spark, sf_dir)

    return run


def query(name: str, sql: str | None = None):
    """Register a query under its name, with its oracle where SQL can express it."""

    def put(f):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = prepared(f)
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


def load() -> None:
    """Import the modules that register queries."""
    for area in AREAS:
        importlib.import_module(f"marlstone.queries.{area}")
