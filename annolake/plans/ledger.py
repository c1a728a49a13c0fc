"""What is done of a job that works by cells: an append-only log of events, folded to the state of each cell.

An event is a row of keys, status (claimed, completed, failed), run, ``at`` and, of a claim, ``until``. Nothing
is ever changed: several workers may append at once. A cell is

* completed, once any run completed it: the first that did is the one whose rows count;
* processing, while its newest event is a claim whose lease has not run out;
* failed for good, after ``most`` claims of which none completed it;
* retryable, if its newest event is a failure or a claim that ran out;
* pending without any event.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import exists, written

#: Claims of a cell after which it is not tried again, and how long a claim holds.
MOST_TRIES = 3
LEASE = dt.timedelta(hours=1)


def now_utc() -> dt.datetime:
    return dt.datetime.now(dt.UTC).replace(tzinfo=None)


def _schema(keys: list[str]) -> str:
    return ", ".join(f"{k} long" for k in keys) + ", status string, run string, at timestamp_ntz, until timestamp_ntz"


def log(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """All events; none before the first."""
    return spark.read.schema(_schema(keys)).parquet(path) if exists(spark, path) else spark.createDataFrame([], _schema(keys))


def _time(t: dt.datetime) -> Column:
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def _append(cells: DataFrame, path: str, keys: list[str], status: str, run: str, at: dt.datetime, until: dt.datetime | None = None) -> None:
    end = F.lit(None).cast("timestamp_ntz") if until is None else _time(until)
    cells.select(*keys, F.lit(status).alias("status"), F.lit(run).alias("run"), _time(at).alias("at"), end.alias("until")).write.mode("append").parquet(path)


def folded(events: DataFrame, keys: list[str], now: dt.datetime, most: int = MOST_TRIES) -> DataFrame:
    """(keys, status, tries, run) of every cell with an event; ``run`` is the one that completed it first."""
    done = F.col("status") == "completed"
    # what ends a claim comes after it, also at the same instant
    newest = F.max_by(F.struct("status", "until"), F.struct("at", (F.col("status") != "claimed").cast("int"), F.coalesce("until", "at")))
    of = events.groupBy(*keys).agg(
        F.count_if(F.col("status") == "claimed").alias("tries"), newest.alias("last"),
        F.min_by("run", F.when(done, F.struct("at", "run"))).alias("run"), F.bool_or(done).alias("done"),
    )
    held = (F.col("last.status") == "claimed") & (F.col("last.until") > _time(now))
    status = F.when(F.col("done"), "completed").when(held, "processing").when(F.col("tries") >= most, "failed").otherwise("retryable")
    return of.select(*keys, status.alias("status"), "tries", F.when(F.col("done"), F.col("run")).alias("run"))


def remaining(cells: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Cells still to do, in order: failed ones that may be tried again first, then untouched ones.

    ``ledger``: keys and status, one row a cell (pending, processing, retryable, failed, completed).
    """
    rows = cells.join(ledger, keys, "left").withColumn("status", F.coalesce("status", F.lit("pending")))
    rank = F.when(F.col("status") == "retryable", 0).when(F.col("status") == "pending", 1)
    return rows.withColumn("rank", rank).where("rank IS NOT NULL")


def claim(cells: DataFrame, path: str, keys: list[str], count: int | None = None, now: dt.datetime | None = None, lease: dt.timedelta = LEASE, most: int = MOST_TRIES) -> tuple[str, DataFrame]:
    """Claim the next cells (keys) that are to do, all or ``count`` of them: the run's name and the cells that are its own.

    Where two workers claimed a cell at once, both see both claims, and the earlier one (by time, then
    name) has it; the later one's claim counts as a try.
    """
    spark, now = cells.sparkSession, now or now_utc()
    run = uuid.uuid4().hex
    todo = remaining(cells.select(*keys).distinct(), folded(log(spark, path, keys), keys, now, most), keys)
    if count is not None:
        todo = todo.orderBy("rank", *keys).limit(count)
    _append(written(todo.select(*keys), "claims"), path, keys, "claimed", run, now, now + lease)
    events = log(spark, path, keys)
    ended = events.where("status <> 'claimed'").select(*keys, "run").distinct()
    live = events.where((F.col("status") == "claimed") & (F.col("until") > _time(now))).join(ended, [*keys, "run"], "left_anti")
    first = live.groupBy(*keys).agg(F.min(F.struct("at", "run")).alias("m"))
    return run, written(first.where(F.col("m.run") == run).select(*keys), "claimed")


def finish(cells: DataFrame, path: str, keys: list[str], run: str, ok: bool = True, now: dt.datetime | None = None) -> None:
    """Note that a run completed cells, or failed at them."""
    _append(cells, path, keys, "completed" if ok else "failed", run, now or now_utc())


def counted(cells: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """(status, cells, tries): how far a job is; cells without an event are pending."""
    rows = cells.select(*keys).distinct().join(state, keys, "left")
    return rows.groupBy(F.coalesce("status", F.lit("pending")).alias("status")).agg(F.count(F.lit(1)).alias("cells"), F.coalesce(F.sum("tries"), F.lit(0)).alias("tries"))


def results(spark: SparkSession, path: str, target: str, keys: list[str], now: dt.datetime | None = None) -> DataFrame:
    """The rows (run, keys, ...) under ``target`` of completed cells, each from the run that completed it first.

    Rows of runs that stopped, or that lost a cell to another, stay where they are and do not count.
    """
    own = folded(log(spark, path, keys), keys, now or now_utc()).where("status = 'completed'").select("run", *keys)
    return spark.read.parquet(target).join(own, ["run", *keys], "left_semi")
