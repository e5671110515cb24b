"""Named queries over the star-schema tables, with SQL that computes the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _modules():
    from shelfprice.registry import (
        contracts, extraction, history, index, jobs, maintained, ranking, search, streams, text, users, validation,
    )

    return [ranking, history, users, validation, text, search, extraction, jobs, streams, contracts, maintained, index]


def queries() -> dict[str, Query]:
    return {name: fn for module in _modules() for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.SQL.items()}
