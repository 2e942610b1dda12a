"""Where queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberline.sources.fixtures import load, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

Tables = Callable[[str], DataFrame]


def query(name: str, tables: str = "", sql: str | None = None) -> Callable:
    """Register a function of a table loader; ``sql`` says the same over the named derived tables (a leading comma adds further ones)."""

    def keep(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: load(spark, sf_dir, t))
        if sql:
            ORACLE_SQL[name] = with_tables(tables, sql) if tables else sql
        return f

    return keep
