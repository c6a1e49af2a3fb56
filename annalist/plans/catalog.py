"""Registered queries of the history engine over the given tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import activity, contents, objects, packed, references, service

Query = Callable[[SparkSession, str], DataFrame]
_AREAS = (activity, objects, references, service, contents, packed)


def queries() -> dict[str, Query]:
    return {name: query for area in _AREAS for name, (query, _) in area.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in _AREAS for name, (_, sql) in area.QUERIES.items() if sql}
