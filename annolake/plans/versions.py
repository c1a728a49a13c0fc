"""Frozen versions: choosing, making, checking and expiring them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import aggregates
from ..schema import HIDDEN
from ..store import exists, remove, written


def closest(versions: DataFrame, when: Column) -> DataFrame:
    """One row: the newest valid version no later than a time and the oldest no earlier; chosen prefers the past."""
    ok = versions.where("valid")
    past = F.max_by("version", "time_stamp").alias("past")
    row = ok.where(F.col("time_stamp") <= when).agg(past).crossJoin(
        ok.where(F.col("time_stamp") >= when).agg(F.min_by("version", "time_stamp").alias("future"))
    )  # one row each
    return row.select("past", "future", F.coalesce("past", "future").alias("chosen"))


def closest_each(rows: DataFrame, when: str, versions: DataFrame) -> DataFrame:
    """Rows with ``past`` and ``future``: at each row's own time, the newest valid version no later and the oldest no earlier.

    Of versions of one time the past is the one of the largest number, the future that of the smallest. The
    catalogue's times, a few thousand at most, are searched by halves in each row: no join, no sort.
    """
    known = versions.where("valid AND time_stamp IS NOT NULL").select("version", F.unix_micros(F.col("time_stamp").cast("timestamp")).alias("t")).collect()
    known = sorted((r["t"], r["version"]) for r in known)
    if not known:
        return rows.withColumns({c: F.lit(None).cast("int") for c in ("past", "future")})
    at = F.unix_micros(F.col(when).cast("timestamp"))
    times, numbers = [t for t, _ in known], F.array(*[F.lit(v) for _, v in known])
    upto, before = (F.coalesce(scalar.range_bucket(x, times), F.lit(-1)) for x in (at + 1, at))
    return rows.withColumns({"past": F.when(upto > 0, F.get(numbers, upto - 1)), "future": F.when(before >= 0, F.get(numbers, before))})


def newest(versions: DataFrame) -> DataFrame:
    """The newest valid version, of equally new ones the one with the largest number."""
    return versions.where("valid").agg(F.max(F.struct("time_stamp", "version")).alias("m")).select("m.version")


def freeze_merged(anno: DataFrame, seg: DataFrame, when: Column, order: list[str] | None = None, as_of: bool = False) -> DataFrame:
    """Rows valid now and created no later than a time, with their segmentation, as one table.

    ``as_of``: validity at that time instead of now.
    """
    live = F.col("created") <= when
    live &= (F.col("deleted").isNull() | (F.col("deleted") > when)) if as_of else F.col("valid")
    joined = anno.where(live).join(seg, "id").drop(*HIDDEN)
    if as_of:
        joined = joined.withColumn("valid", F.lit(True))
    return joined.select(*[c for c in order if c in joined.columns]) if order else joined


def freeze_split(anno: DataFrame, when: Column) -> DataFrame:
    """The annotation table alone without rows created later or no longer valid."""
    return anno.where(F.col("valid") & (F.col("created") <= when))


def freeze_references(ref: DataFrame, frozen: DataFrame, when: Column) -> DataFrame:
    """Rows of a reference table whose target is in the frozen table."""
    return ref.where(F.col("valid") & (F.col("created") <= when)).join(frozen.select(F.col("id").alias("target_id")), "target_id", "left_semi")


def validated(live: dict[str, DataFrame], frozen: dict[str, DataFrame], when: Column) -> DataFrame:
    """(table_name, live_rows, frozen_rows, ok): counts of live valid rows and frozen ones. A row that
    lacks its segmentation is live but not frozen, so it shows here. Empty frozen tables pass.
    """
    out = None
    for name, df in live.items():
        a = df.where(F.col("valid") & (F.col("created") <= when)).agg(F.count(F.lit(1)).alias("live_rows"))
        b = frozen[name].agg(F.count(F.lit(1)).alias("frozen_rows"))
        row = a.crossJoin(b).select(F.lit(name).alias("table_name"), "live_rows", "frozen_rows", ((F.col("live_rows") == F.col("frozen_rows")) | (F.col("frozen_rows") == 0)).alias("ok"))
        out = row if out is None else out.unionAll(row)
    return out


def retention(versions: DataFrame, now: Column, keep: int = 1) -> DataFrame:
    """Versions to remove, oldest first: expired or invalid ones, but never the newest valid one, and
    never so many that fewer than ``keep`` remain.
    """
    over = (F.col("expires_on") < now) | ~F.col("valid")
    one = versions.agg(F.count(F.lit(1)).alias("_all"), F.max(F.when(F.col("valid"), F.col("time_stamp"))).alias("_newest"))
    every = versions.crossJoin(F.broadcast(one))  # one row
    newest_valid = F.col("valid") & (F.col("time_stamp") == F.col("_newest"))
    gone = every.where(F.coalesce(over, F.lit(False)) & ~F.coalesce(newest_valid, F.lit(False)))
    placed = aggregates.in_order(gone.select("time_stamp", "version", "_all"), ["time_stamp", "version"], "place")
    return placed.where(F.col("place") <= F.col("_all") - keep).select("version", "place")


def removed(spark: SparkSession, plan: DataFrame, root: str) -> list[int]:
    """Delete the folders ``root/version`` of the versions in a retention plan, oldest first; gives those deleted."""
    gone = []
    for version in [r[0] for r in plan.orderBy("place").select("version").collect()]:  # folders that exist, not rows
        if exists(spark, f"{root}/{version}"):
            remove(spark, f"{root}/{version}")
            gone.append(version)
    return gone


def next_version(versions: DataFrame) -> int:
    return (versions.agg(F.max("version")).first()[0] or 0) + 1


def expiry(created: Column, days: int) -> Column:
    return created + F.make_interval(days=F.lit(days), hours=F.lit(-1))


def resolve_alias(versions: DataFrame, version: int) -> int:
    """The version that holds the tables of a virtual one."""
    row = versions.where(F.col("version") == version).select("parent_version").first()
    if row is None:
        raise KeyError(version)
    return row[0] if row[0] is not None else version


def complete(spark: SparkSession, live: dict[str, tuple[DataFrame, DataFrame | None]], when: Column, root: str, version: int) -> DataFrame:
    """Freeze all tables of a version under ``root/version/table``, check them, and give the catalogue rows.

    Refuses a version that is there. Status is AVAILABLE only if every table has all its live rows.
    """
    base = f"{root}/{version}"
    if exists(spark, base):
        raise FileExistsError(base)
    frozen = {}
    for name, (anno, seg) in live.items():
        df = freeze_split(anno, when) if seg is None else freeze_merged(anno, seg, when)
        df.write.parquet(f"{base}/{name}")
        frozen[name] = spark.read.parquet(f"{base}/{name}")
    ok = written(validated({n: a for n, (a, _) in live.items()}, frozen, when), "validated")  # a row a table
    all_ok = ok.agg(F.bool_and("ok").alias("all_ok"))
    return ok.crossJoin(all_ok).select(
        F.lit(version).alias("version"), "table_name", "frozen_rows", F.when(F.coalesce("all_ok", F.lit(True)), "AVAILABLE").otherwise("FAILED").alias("status")
    )
