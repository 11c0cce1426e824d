"""Queries of this subpackage over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinetra.llm import queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for name, f in vars(queries).items() if name.startswith("op") and callable(f)}
ORACLE_SQL: dict[str, str] = dict(queries.SQL)
