"""Queries at any time: a frozen version and what changed since."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import filters, lineage
from ..schema import root_columns
from ..store import written


def combined(frozen: DataFrame, delta: DataFrame, version_time: Column, query_time: Column, forward: bool = True) -> DataFrame:
    """Rows in force at the query time, from a version's rows and rows edited between both times.

    ``delta`` has ``created`` and ``deleted``; an edit at the earlier time belongs to the earlier
    state, one at the later time to the later state: intervals are half-open (earlier, later].
    Forward: rows deleted in between leave, rows created in between and not deleted enter.
    Backward: rows created in between leave, rows deleted in between and not created in it return.
    """
    early, late = (version_time, query_time) if forward else (query_time, version_time)

    def between(c: str) -> Column:
        return F.coalesce((F.col(c) > early) & (F.col(c) <= late), F.lit(False))

    created, deleted = between("created"), between("deleted")
    enter = delta.where(created & ~deleted if forward else deleted & ~created)
    leave = delta.where(deleted if forward else created).select("id").distinct()
    stay = frozen.join(leave, "id", "left_anti")
    stay = stay.join(enter.select("id"), "id", "left_anti")  # a row that is in both enters as it is now
    return stay.unionByName(enter.select(*frozen.columns), allowMissingColumns=True)


def asked_then(df: DataFrame, spec: dict[str, dict], roots: DataFrame) -> DataFrame:
    """Rows that satisfy filters given for one time at another: (root_id, other_root) says which roots were which.

    An "equal" on a root asks for all it maps to, however many; a root that maps to nothing matches
    nothing. What roots map to is joined and never leaves the executors. Only root columns are rewritten.
    """
    out = filters.apply(df, without_roots(spec))
    for kind, by in spec.items():
        for c, value in by.items():
            if not c.endswith("root_id"):
                continue
            if kind not in ("equal", "in", "notin"):
                raise ValueError(f"a root cannot be translated in a filter {kind!r}")
            named = [value] if kind == "equal" else list(value)
            there = filters.is_in(roots, "root_id", named).select(F.col("other_root").alias("_then")).distinct()
            if kind == "notin":
                out = out.where(F.col(c).isNotNull()).join(there, F.col(c) == F.col("_then"), "left_anti")
            else:
                out = out.join(there, F.col(c) == F.col("_then"), "left_semi")
    return out


def without_roots(spec: dict[str, dict]) -> dict[str, dict]:
    """Filters that do not depend on roots: those for the live side."""
    return {k: kept for k, v in spec.items() if (kept := {c: x for c, x in v.items() if not c.endswith("root_id")})}


def named_roots(spec: dict[str, dict]) -> list[int]:
    """Roots named in filters."""
    out = []
    for kind, by in spec.items():
        for c, v in by.items():
            if c.endswith("root_id"):
                out += list(v) if kind in ("in", "notin") else [v]
    return sorted(set(out))


def at_time(
    frozen: DataFrame, anno: DataFrame, seg: DataFrame, table: DataFrame, version_time: Column, query_time: Column, spec: dict[str, dict],
    forward: bool = True, limit: int | None = None, select: list[str] | None = None,
) -> DataFrame:
    """Rows of a table at any time that satisfy filters as they hold at that time.

    Roots named in filters are translated to the version's time, the version is asked, rows edited
    since are taken from the live tables, roots are brought to the query time, and all filters are
    applied again. The limit comes last, and of the columns those asked for: supervoxels that only
    served to bring roots to the time leave.
    """
    spark = frozen.sparkSession
    roots = spark.createDataFrame([(r,) for r in named_roots(spec)], "root_id long")
    then = lineage.translate(roots, table, query_time, version_time) if named_roots(spec) else spark.createDataFrame([], "root_id long, other_root long")
    asked = asked_then(frozen, spec, then)
    early, late = (version_time, query_time) if forward else (query_time, version_time)
    edited = filters.edited_between(anno, early, late)
    delta = filters.apply(edited, without_roots(spec)).join(seg, "id")
    rows = written(combined(asked, delta, version_time, query_time, forward), "combined")  # read again for each root
    fresh = lineage.refreshed(rows, root_columns(rows.columns), table, query_time)
    out = filters.apply(fresh, spec)
    out = out if limit is None else out.orderBy("id").limit(limit)
    return out if select is None else out.select(*select)
