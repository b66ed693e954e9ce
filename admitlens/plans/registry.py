"""Registry of named queries: name -> (spark, sf_dir) -> DataFrame, plus the
equivalent DuckDB SQL text where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so that their registrations run."""
    from admitlens.plans import (  # noqa: F401
        questions_plan,
        loading_plan,
        standardise_plan,
        extraction_plan,
        incremental_plan,
        tasks_plan,
    )
