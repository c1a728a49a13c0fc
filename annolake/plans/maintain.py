"""Keeping segmentation tables complete and current, as joins over whole tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import aggregates, filters, lineage
from ..schema import AXES, supervoxel_of
from ..sources import volume
from ..store import current, exists, replace, written
from . import ledger


def missing(anno: DataFrame, seg: DataFrame) -> DataFrame:
    """Valid annotations without a segmentation row."""
    return filters.valid(anno).join(seg.select("id"), "id", "left_anti")


def _voxel_points(anno: DataFrame, points: list[str], scale: tuple[float, float, float]) -> DataFrame:
    """(id, type, vx, vy, vz): the voxel of each point."""
    stacked = aggregates.stacked_points(anno, points)
    return stacked.select("id", "type", *[scalar.scaled(F.col(a), s).cast("int").alias(f"v{a}") for a, s in zip("xyz", scale, strict=True)])


def _by_point(found: DataFrame, points: list[str]) -> DataFrame:
    """(id, {point}_supervoxel_id, ...) of looked-up points (id, type, supervoxel_id), 0 where there is none."""
    types = [p.removesuffix("_position") for p in points]
    wide = found.groupBy("id").pivot("type", types).agg(F.first(F.coalesce("supervoxel_id", F.lit(0))))
    return wide.select("id", *[F.coalesce(F.col(t), F.lit(0)).cast("long").alias(supervoxel_name(t)) for t in types])


def looked_up(anno: DataFrame, points: list[str], voxels: DataFrame, scale: tuple[float, float, float]) -> DataFrame:
    """(id, {point}_supervoxel_id, ...): the voxel at each point, 0 where there is none."""
    return _by_point(_voxel_points(anno, points, scale).join(voxels, ["vx", "vy", "vz"], "left"), points)


def looked_up_blocks(anno: DataFrame, points: list[str], path: str, buckets: int, scale: tuple[float, float, float]) -> DataFrame:
    """The same from a volume of compressed blocks."""
    return _by_point(volume.supervoxels(anno.sparkSession, _voxel_points(anno, points, scale), path, buckets), points)


def supervoxel_name(point: str) -> str:
    """The supervoxel column of a point; names without "pt" get it."""
    return f"{point if point.endswith('pt') else f'{point}_pt'}_supervoxel_id"


def ingested(anno: DataFrame, seg: DataFrame, points: list[str], voxels: DataFrame, scale: tuple, lines: DataFrame, when: Column) -> DataFrame:
    """Segmentation rows for annotations that have none: voxels looked up, then roots at a time."""
    new = looked_up(missing(anno, seg), points, voxels, scale)
    for p in points:
        sv = supervoxel_name(p.removesuffix("_position"))
        new = lineage.roots_at(new, sv, lines, when, sv.replace("supervoxel", "root"))
    return new.select(*[c for c in seg.columns if c in new.columns])


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Old rows with the new rows' values, and the new rows that were not there."""
    n = new.select(F.col(key), F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in new.columns if c != key])
    joined = old.withColumn("_old", F.lit(True)).join(n, key, "full")
    cols = [F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in new.columns else F.col(c) for c in old.columns if c != key]
    return joined.select(key, *cols)


def checked(new: DataFrame, kinds: dict[str, str], key: str = "id", low: int = 0, high: int = (1 << 63) - 1) -> tuple[DataFrame, DataFrame]:
    """Rows that a table of these column types can take, and the others as they came with a ``reason``.

    Rejected are rows with a null key, a key outside [low, high], a value that its column's type does not
    hold, and all rows of a key that comes with different values; equal rows of one key are one row.
    """
    cols = [c for c in new.columns if c in kinds]
    given = new.select(*cols).distinct()
    cast = {c: F.col(c).try_cast(kinds[c]) for c in cols}
    reason = F.when(F.col(key).isNull(), "no key")
    for c in cols:
        reason = reason.when(F.col(c).isNotNull() & cast[c].isNull(), f"{c} is no {kinds[c]}")
    reason = reason.when(~cast[key].between(low, high), "key out of range")
    marked = given.withColumn("reason", reason)
    fine = marked.where("reason IS NULL").select(*[cast[c].alias(c) for c in cols], F.struct(*cols).alias("_given"))
    several = fine.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key)
    repeated = fine.join(several, key, "left_semi").select("_given.*", F.lit("repeated key").alias("reason"))
    return fine.join(several, key, "left_anti").select(*cols), marked.where("reason IS NOT NULL").unionByName(repeated)


def upserted_checked(old: DataFrame, new: DataFrame, key: str = "id", low: int = 0, high: int = (1 << 63) - 1) -> tuple[DataFrame, DataFrame]:
    """The table after an upsert of the rows that it can take, and those it cannot with their reasons: one bad row
    costs no other its place.
    """
    good, rejects = checked(new, dict(old.dtypes), key, low, high)
    return upserted(old, good, key), rejects


def upserted_positive(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The same, but a new value counts only if above 0; columns that a side lacks are 0."""
    n = new.select(F.col(key), *[F.col(c).alias(f"_n_{c}") for c in new.columns if c != key])
    joined = old.join(n, key, "full")
    cols = []
    for c in old.columns:
        if c == key:
            continue
        new_c = F.col(f"_n_{c}") if c in new.columns else F.lit(None)
        cols.append(F.coalesce(F.when(new_c > 0, new_c), F.col(c), F.lit(0)).alias(c))
    return joined.select(key, *cols)


def refreshed_expired(seg: DataFrame, roots: list[str], lines: DataFrame, since: Column | None, when: Column) -> DataFrame:
    """New values of rows with an expired or missing root; with ``since`` null, of all rows."""
    rows = seg if since is None else lineage.rows_with_expired(seg, lineage.expired(lines, since, when), roots)
    for r in roots:
        rows = lineage.roots_at(rows, supervoxel_of(r), lines, when, "_now").withColumn(r, F.coalesce("_now", r)).drop("_now")
    return rows


def filled(seg: DataFrame, roots: list[str], lines: DataFrame, when: Column) -> DataFrame:
    """New values of rows that miss a root: only what is missing is looked up."""
    rows = filters.any_root_missing(seg, roots)
    for r in roots:
        rows = lineage.roots_at(rows, supervoxel_of(r), lines, when, "_now").withColumn(r, F.coalesce(r, "_now")).drop("_now")
    return rows


def filled_range(seg: DataFrame, roots: list[str], lines: DataFrame, when: Column, start: int, end: int | None) -> DataFrame:
    """The same for rows of an id range that have no root at all, or only 0."""
    rows = filters.all_roots_missing(filters.id_range(seg, start, end), roots)
    for r in roots:
        rows = lineage.roots_at(rows, supervoxel_of(r), lines, when, "_now").withColumn(r, F.col("_now")).drop("_now")
    return rows


def reset(seg: DataFrame, roots: list[str], bad: list[int]) -> DataFrame:
    """Bad roots as null, in whichever root column they are."""
    return seg.withColumns({r: F.when(~F.coalesce(F.col(r).isin(bad), F.lit(False)), F.col(r)) for r in roots})


def known_roots(rows: DataFrame, seg: DataFrame) -> DataFrame:
    """Rows joined with what the segmentation has for the columns both share."""
    return rows.join(seg, [c for c in rows.columns if c in seg.columns])


def whole_lookup(anno: DataFrame, seg: DataFrame, points: list[str], voxels: DataFrame, scale: tuple, lines: DataFrame, when: Column) -> DataFrame:
    """Look up all points anew and put what was found over the old rows: one job, no cells."""
    new = looked_up(filters.valid(anno), points, voxels, scale)
    for p in points:
        sv = supervoxel_name(p.removesuffix("_position"))
        new = lineage.roots_at(new, sv, lines, when, sv.replace("supervoxel", "root"))
    return upserted_positive(seg, new)


#: Keys of a cell.
CELL = ["cx", "cy", "cz"]


def lookup_some(
    anno: DataFrame, points: list[str], voxels: DataFrame, scale: tuple, path: str, target: str, size: int, cells: int | None = None,
    now: dt.datetime | None = None, lease: dt.timedelta = ledger.LEASE, most: int = ledger.MOST_TRIES,
) -> int:
    """Claim the next ``cells`` cells still to do (all of them if not told), look up their points, and note
    them in the ledger at ``path``; gives how many. ``ledger.results`` reads what was looked up.

    A run's rows lie under its own name, and count once the ledger says that it completed their cell. A
    run that stops leaves claims that others may take up when the lease is over; one that fails says so.
    """
    # rows without the first point have no cell of their own
    places = [F.coalesce(F.floor(F.col(f"{points[0]}_{a}") / size).cast("long"), F.lit(0)).alias(f"c{a}") for a in AXES]
    keyed = filters.valid(anno).select("*", *places)
    run, some = ledger.claim(keyed.select(*CELL), path, CELL, cells, now, lease, most)
    n = some.count()
    if n:
        try:
            rows = keyed.join(some, CELL, "left_semi")
            found = looked_up(rows.drop(*CELL), points, voxels, scale)
            found.join(rows.select("id", *CELL), "id").write.mode("overwrite").parquet(f"{target}/run={run}")
        except Exception:
            ledger.finish(some, path, CELL, run, ok=False, now=now)
            raise
        ledger.finish(some, path, CELL, run, now=now)
    return n


def updated(tables: dict[str, tuple[DataFrame, DataFrame, list[str]]], voxels: DataFrame, scale: tuple, lines: DataFrame, since: Column, when: Column) -> dict[str, DataFrame]:
    """For every table: missing segmentation added, expired roots refreshed."""
    out = {}
    for name, (anno, seg, points) in tables.items():
        roots = [c for c in seg.columns if c.endswith("root_id")]
        full = seg.unionByName(ingested(anno, seg, points, voxels, scale, lines, when), allowMissingColumns=True)
        out[name] = upserted(full, refreshed_expired(full, roots, lines, since, when))
    return out


def transferred(spark: SparkSession, df: DataFrame, target: str, overwrite: bool = False) -> int:
    """Write a staged copy, compare row counts, and only then write it as the target's next version,
    which readers find by ``store.current``; gives the number of rows.
    """
    if exists(spark, target) and not overwrite:
        raise FileExistsError(target)
    staged = written(df, "staged")
    wrote, had = staged.count(), df.count()
    if wrote != had:
        raise ValueError(f"{wrote} of {had} rows were staged for {target}")
    reached = spark.read.schema(df.schema).parquet(replace(staged, target)).count()
    if reached != wrote:
        raise ValueError(f"{reached} of {wrote} rows reached {current(spark, target)}")
    return reached
