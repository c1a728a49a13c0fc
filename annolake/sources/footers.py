"""Counts and extents of stored tables from the ends of their files, without reading rows.

Parquet files carry row counts, and least and largest values by column. A table read by ``footed`` lets
Spark answer ``count``, ``min`` and ``max`` of whole columns from these, so that the extent of a table of
any size costs its footers; results are exact, unlike those of a sample of pages.
"""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession


def footed(spark: SparkSession, path: str) -> DataFrame:
    """A stored table whose aggregates of whole columns come from its files' footers. Fails, as it is read, where
    a footer has no ends for a column: one without values in a row group, or a file written without them.
    """
    own = spark.newSession()  # how files are read for this is no setting of the caller's session
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read.parquet(path)


def asked(spark: SparkSession, path: str, ask: Callable[[DataFrame], DataFrame]) -> Row:
    """The one row of an aggregation of a stored table: from the footers, or where those do not tell, by a scan."""
    try:
        return ask(footed(spark, path)).first()
    except (PySparkException, Py4JError):
        return ask(spark.read.parquet(path)).first()
