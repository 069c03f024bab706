"""Where operators register the query and SQL that hold them against the standard tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from metaloom.adapters import Data, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Registers f(data) under an operator's key, with oracle SQL over the named views."""

    def add(f: Callable[[Data], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Data(spark, sf_dir))
        if sql is not None:
            SQL[name] = with_views(sql, *views.split()) if views else sql
        return f

    return add
