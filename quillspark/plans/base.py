"""Shared pieces of the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    """Queries by name, each with the SQL that gives the same rows."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None):
        def register(make: Callable[[Callable[[str], DataFrame], SparkSession], DataFrame]):
            self.queries[name] = lambda spark, sf_dir: make(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"), spark)
            if sql:
                self.oracles[name] = sql
            return make

        return register


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    """A literal table, given as the text of VALUES so that both engines read the same rows."""
    return spark.sql(f"SELECT * FROM (VALUES {rows}) AS t({columns})")


def derived(t: Callable[[str], DataFrame], spark: SparkSession, sql: str, *tables: str) -> DataFrame:
    """Rows that one SELECT, in words both engines understand, derives from the given tables ({part} stands for a table)."""
    return spark.sql(sql, **{name: t(name) for name in tables})


def plain_sql(sql: str, *tables: str) -> str:
    """The same SELECT over the tables by their names."""
    return sql.format(**{name: name for name in tables})
