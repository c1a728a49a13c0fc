"""Registration of queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import derived, with_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The given and derived tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return derived(self.spark, self.dir, name)


def query(sql: str | None = None, *tables: str):
    """Register a function of ``Tables``; ``sql`` may use the derived tables named after it."""

    def add(f: Callable[[Tables], DataFrame]):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = (with_sql(*tables) if tables else "") + sql
        return f

    return add


def ts(text: str) -> Column:
    """A literal time as the tables store times."""
    return F.lit(text).cast("timestamp_ntz")
