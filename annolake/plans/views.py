"""Views that are kept: SQL, units and notice by name, in a table that every session reads.

The table is an append-only log, of which the newest entry of a name counts, so sessions that save
views at the same time lose none. A view is SQL that names its tables in braces (``{anno}``); it is
planned with the tables of the session that asks, and Spark sees through it: filters and columns of a
query on it reach the tables' files.
"""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Table
from ..store import exists

LOG = "name string, text string, resolution array<double>, notice string, at long, mark string"


def _log(spark: SparkSession, path: str, row: tuple) -> None:
    spark.createDataFrame([(*row, time.time_ns(), uuid.uuid4().hex)], LOG).coalesce(1).write.mode("append").parquet(path)


def save(spark: SparkSession, path: str, name: str, text: str, resolution: tuple[float, float, float], notice: str = "") -> None:
    """Keep a view, over one of the same name. The notice is told with each result of it."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not a name: {name!r}")
    _log(spark, path, (name, text, [float(x) for x in resolution], notice))


def drop(spark: SparkSession, path: str, name: str) -> None:
    """Forget a view; its entries stay in the log."""
    _entry(spark, path, name)
    _log(spark, path, (name, None, None, None))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(name, text, resolution, notice) of the views that there are."""
    if not exists(spark, path):
        return spark.createDataFrame([], LOG).drop("at", "mark")
    newest = spark.read.schema(LOG).parquet(path).groupBy("name").agg(F.max_by(F.struct("text", "resolution", "notice"), F.struct("at", "mark")).alias("v"))
    return newest.select("name", "v.*").where("text IS NOT NULL")


def _entry(spark: SparkSession, path: str, name: str):
    found = catalogue(spark, path).where(F.col("name") == name).first()
    if found is None:
        raise KeyError(f"no view {name!r}")
    return found


def table(spark: SparkSession, path: str, name: str, tables: dict[str, DataFrame]) -> Table:
    """A kept view over some tables, to be queried as a table is: with its own resolution, and its notice."""
    found = _entry(spark, path, name)
    named = set(re.findall(r"\{(\w+)\}", found["text"]))
    missing = sorted(named - set(tables))
    if missing:
        raise KeyError(f"view {name!r} needs {missing}")
    rows = spark.sql(found["text"], **{n: tables[n] for n in named})
    return Table(name, rows, tuple(found["resolution"]), {"notice": found["notice"]})
