"""Queries by name, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(fn, sql)
        return fn

    return register


def r9(column: Column | str, digits: int = 9) -> Column:
    """Round for comparison with another engine; + 0.0 turns -0.0 into 0.0."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), digits) + F.lit(0.0)


def load_all() -> dict[str, Query]:
    from tiltmeter.plans import (  # noqa: F401
        cache_queries,
        grid_queries,
        job_queries,
        kernel_queries,
        layer_queries,
        outlier_queries,
        question_queries,
        rate_queries,
        rotation_queries,
        sampler_queries,
        selector_queries,
        source_queries,
        stream_queries,
    )

    return QUERIES
