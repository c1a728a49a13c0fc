"""Which object a supervoxel belonged to, and when: joins on the lineage table.

``lineage``: supervoxel_id, root_id, valid_from (inclusive), valid_to (exclusive). A lookup at one
time filters the table to that time first, so it is a plain equi-join.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import supervoxel_of
from ..store import written


def at_time(lineage: DataFrame, when: Column) -> DataFrame:
    """Roots in force at one time: supervoxel_id, root_id."""
    return lineage.where((F.col("valid_from") <= when) & (when < F.col("valid_to"))).select("supervoxel_id", "root_id")


def roots_at(df: DataFrame, supervoxel: str, lineage: DataFrame, when: Column, out: str) -> DataFrame:
    """``df`` with the root of a supervoxel column at a time; null where there is none.

    Supervoxel 0 stands for none, as null does: such rows get negative keys by a hash of the row, which
    no supervoxel has, so that they match nothing and gather in no partition.
    """
    now = at_time(lineage, when).where("supervoxel_id > 0").select(F.col("supervoxel_id").alias("_sv"), F.col("root_id").alias("_root"))
    none = -1 - F.pmod(F.xxhash64(*df.columns), F.lit(1 << 20))
    key = F.when(F.col(supervoxel) > 0, F.col(supervoxel)).otherwise(none)
    joined = df.withColumn("_key", key).join(now, F.col("_key") == F.col("_sv"), "left")
    return joined.withColumn(out, F.col("_root")).drop("_key", "_sv", "_root")


def roots_when(df: DataFrame, supervoxel: str, when: str, lineage: DataFrame, out: str) -> DataFrame:
    """The same with a time of each row's own: an equi-join and a condition on the time."""
    l = lineage.select(F.col("supervoxel_id").alias("_sv"), F.col("root_id").alias("_root"), "valid_from", "valid_to")
    on = (F.col(supervoxel) == F.col("_sv")) & (F.col("valid_from") <= F.col(when)) & (F.col(when) < F.col("valid_to"))
    return df.join(l, on, "left").withColumn(out, F.col("_root")).drop("_sv", "_root", "valid_from", "valid_to")


def latest(roots: DataFrame, lineage: DataFrame, when: Column) -> DataFrame:
    """(root_id, is_latest) of distinct roots: whether any supervoxel belongs to them at a time."""
    now = at_time(lineage, when).select("root_id").distinct().withColumn("_is", F.lit(True))
    return roots.select("root_id").distinct().join(now, "root_id", "left").select("root_id", F.coalesce("_is", F.lit(False)).alias("is_latest"))


def expired(lineage: DataFrame, after: Column, upto: Column) -> DataFrame:
    """Roots that ended after one time and no later than another."""
    return lineage.where((F.col("valid_to") > after) & (F.col("valid_to") <= upto)).select("root_id").distinct()


def rows_with_expired(seg: DataFrame, roots: DataFrame, columns: list[str]) -> DataFrame:
    """Segmentation rows of which a root has expired or is missing: one pass, a mark for each column."""
    out = seg
    for i, c in enumerate(columns):
        out = out.join(roots.select(F.col("root_id").alias(f"_r{i}")), F.col(c) == F.col(f"_r{i}"), "left")
    hit = reduce(or_, [F.col(f"_r{i}").isNotNull() | F.col(c).isNull() for i, c in enumerate(columns)])
    return out.where(hit).drop(*[f"_r{i}" for i in range(len(columns))])


def translate(roots: DataFrame, lineage: DataFrame, at: Column, to: Column) -> DataFrame:
    """(root_id, other_root) for each root in force ``at`` a time: roots of the same supervoxels ``to`` another."""
    here = at_time(lineage, at).join(roots.select("root_id").distinct(), "root_id", "left_semi")
    there = at_time(lineage, to).select("supervoxel_id", F.col("root_id").alias("other_root"))
    return here.join(there, "supervoxel_id").select("root_id", "other_root").distinct()


def edit_edges(lineage: DataFrame) -> DataFrame:
    """(earlier, later, at) of every two roots that a supervoxel had one after the other: the graph of edits, a row an
    edge however many supervoxels went along it.
    """
    w = Window.partitionBy("supervoxel_id").orderBy("valid_from")
    steps = lineage.select(F.lag("root_id").over(w).alias("earlier"), F.col("root_id").alias("later"), F.col("valid_from").alias("at"))
    return steps.where("earlier IS NOT NULL AND earlier <> later").distinct()


def histories(roots: DataFrame, edges: DataFrame, after: Column, upto: Column, forward: bool = True) -> DataFrame:
    """(root_id, other_root, depth, path, last) of all roots that edits in (after, upto] lead to from each root, itself
    included at depth 0; backward, of those that led to it. ``last``: no such edit leads on from there.

    Frontiers are walked a depth at a time, each written, so a step's work is that of its frontier and the
    graph's edges; lineage by supervoxel is read once, for the edges. A root that several ways lead to has
    the shortest, of equal ones the smallest path. Two objects that were merged and split again are connected
    though they may share no supervoxel: which supervoxels went where is ``translate``'s to say.
    """
    a, b = ("earlier", "later") if forward else ("later", "earlier")
    step = written(edges.where((F.col("at") > after) & (F.col("at") <= upto)).select(F.col(a).alias("node"), F.col(b).alias("next")).distinct(), "edits")
    front = roots.select("root_id").where("root_id IS NOT NULL").distinct().select("root_id", F.col("root_id").alias("other_root"), F.lit(0).alias("depth"), F.array("root_id").alias("path"))
    known = front = written(front, "histories")
    depth = 0
    while front.limit(1).count():
        depth += 1
        on = front.join(step, front["other_root"] == step["node"]).select("root_id", F.col("next").alias("other_root"), F.lit(depth).alias("depth"), F.concat("path", F.array("next")).alias("path"))
        shortest = on.groupBy("root_id", "other_root").agg(F.min("depth").alias("depth"), F.min("path").alias("path"))
        front = written(shortest.join(known.select("root_id", "other_root"), ["root_id", "other_root"], "left_anti"), "histories")
        known = known.unionByName(front)
    leads = step.select(F.col("node").alias("other_root")).distinct().withColumn("_on", F.lit(True))
    return known.join(leads, "other_root", "left").select("root_id", "other_root", "depth", "path", F.col("_on").isNull().alias("last"))


def replaced(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """A column's values by a map (old, new); values that the map lacks stay."""
    m = mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    return df.join(m, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def refreshed(df: DataFrame, roots: list[str], lineage: DataFrame, when: Column) -> DataFrame:
    """Each root column brought to a time: only roots not in force are looked up anew by supervoxel.

    Rows without a lookup (supervoxel null or the sentinel 1) keep their root. Which roots are in force
    is asked of the rows as they came, so one column's joins are no part of another's.
    """
    given = df
    for root in roots:
        sv = supervoxel_of(root)
        stale = latest(given.select(F.col(root).alias("root_id")), lineage, when).where(~F.col("is_latest"))
        marked = df.join(stale.select(F.col("root_id").alias("_stale")), F.col(root) == F.col("_stale"), "left")
        look = F.when((F.col("_stale").isNotNull() | F.col(root).isNull()) & (F.coalesce(F.col(sv), F.lit(1)) != 1), F.col(sv))
        found = roots_at(marked.withColumn("_look", F.coalesce(look, F.lit(0))), "_look", lineage, when, "_found")
        df = found.withColumn(root, F.coalesce("_found", root)).drop("_stale", "_look", "_found")
    return df
