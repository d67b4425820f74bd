"""Registered queries: a Spark job over the given tables and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(job: Query) -> Query:
        QUERIES[name] = job
        if sql is not None:
            ORACLES[name] = sql
        return job

    return register
