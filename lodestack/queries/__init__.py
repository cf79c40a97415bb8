"""Registered queries over the test tables, each with SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _parts():
    from . import code, graphs, ranking, texts

    return texts, ranking, graphs, code


def queries() -> dict[str, Query]:
    return {name: q for part in _parts() for name, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _parts() for name, sql in part.SQL.items()}
