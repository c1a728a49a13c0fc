"""Lineage, versions, queries at any time, maintenance and streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import VOXEL_SCALE, versions, versions_sql
from ..operators import aggregates, bucketed, filters, lineage
from ..plans import ledger, live, maintain
from ..plans import versions as v
from ..sources import columnfiles, volume
from ..store import current, shared_dir, written
from ..streaming import jobs as streams
from .base import Tables, query, ts

ROOTS = ["pre_pt_root_id", "post_pt_root_id"]
POINTS = ["pre_pt_position", "post_pt_position"]
V2, V4 = "1998-12-31 00:00:00", "2000-12-31 00:00:00"
#: Changes of lineage, and a time between versions.
EARLY, SPLIT, MERGE, BETWEEN = "1996-01-01 00:00:00", "1997-01-01 00:00:00", "1999-06-01 00:00:00", "2000-03-01 00:00:00"


_LOOKED = """SELECT p.id, max(CASE WHEN p.type = 'pre' THEN coalesce(v.supervoxel_id, 0) END) AS pre_pt_supervoxel_id, max(CASE WHEN p.type = 'post' THEN coalesce(v.supervoxel_id, 0) END) AS post_pt_supervoxel_id FROM (
 SELECT id, 'pre' AS type, pre_pt_position_x AS x, pre_pt_position_y AS y, pre_pt_position_z AS z FROM {rows}
 UNION ALL SELECT id, 'post', post_pt_position_x, post_pt_position_y, post_pt_position_z FROM {rows}) p
 LEFT JOIN voxels v ON v.vx = CAST(floor(p.x / 2.0) AS INT) AND v.vy = CAST(floor(p.y / 2.0) AS INT) AND v.vz = p.z GROUP BY p.id"""
_MISSING = "(SELECT a.* FROM anno a LEFT JOIN seg s USING (id) WHERE a.valid AND s.id IS NULL)"
_INGESTED = f"""SELECT k.id, k.pre_pt_supervoxel_id, l.root_id AS pre_pt_root_id, k.post_pt_supervoxel_id, m.root_id AS post_pt_root_id FROM ({_LOOKED.format(rows=_MISSING)}) k
LEFT JOIN lineage l ON l.supervoxel_id = k.pre_pt_supervoxel_id AND l.valid_from <= TIMESTAMP '{{when}}' AND TIMESTAMP '{{when}}' < l.valid_to
LEFT JOIN lineage m ON m.supervoxel_id = k.post_pt_supervoxel_id AND m.valid_from <= TIMESTAMP '{{when}}' AND TIMESTAMP '{{when}}' < m.valid_to"""


def _in_force(alias: str, when: str) -> str:
    return f"{alias}.valid_from <= TIMESTAMP '{when}' AND TIMESTAMP '{when}' < {alias}.valid_to"


@query(f"SELECT s.id, l.root_id AS pre_root_then FROM seg s LEFT JOIN lineage l ON l.supervoxel_id = s.pre_pt_supervoxel_id AND {_in_force('l', SPLIT)}", "seg", "lineage")
def root_asof(t: Tables) -> DataFrame:
    """Roots of supervoxels at the instant of a change."""
    return lineage.roots_at(t.seg, "pre_pt_supervoxel_id", t.lineage, ts(SPLIT), "pre_root_then").select("id", "pre_root_then")


@query(
    "SELECT a.id, l.root_id AS root_when FROM anno a JOIN seg s USING (id) LEFT JOIN lineage l ON l.supervoxel_id = s.pre_pt_supervoxel_id AND l.valid_from <= a.created AND a.created < l.valid_to",
    "anno", "seg", "lineage",
)
def root_asof_each(t: Tables) -> DataFrame:
    """Roots at each row's own time."""
    rows = t.anno.join(t.seg, "id").select("id", "created", "pre_pt_supervoxel_id")
    return lineage.roots_when(rows, "pre_pt_supervoxel_id", "created", t.lineage, "root_when").select("id", "root_when")


@query(f"SELECT r.root_id, EXISTS (SELECT 1 FROM lineage l WHERE l.root_id = r.root_id AND {_in_force('l', MERGE)}) AS is_latest FROM (SELECT DISTINCT post_pt_root_id AS root_id FROM seg WHERE post_pt_root_id IS NOT NULL) r", "seg", "lineage")
def roots_latest(t: Tables) -> DataFrame:
    return lineage.latest(t.seg.selectExpr("post_pt_root_id AS root_id").where("root_id IS NOT NULL"), t.lineage, ts(MERGE))


@query(f"SELECT DISTINCT root_id FROM lineage WHERE valid_to > TIMESTAMP '{SPLIT}' AND valid_to <= TIMESTAMP '{MERGE}'", "lineage")
def roots_expired(t: Tables) -> DataFrame:
    return lineage.expired(t.lineage, ts(SPLIT), ts(MERGE))


@query(
    f"SELECT id FROM seg WHERE pre_pt_root_id IS NULL OR post_pt_root_id IS NULL OR pre_pt_root_id IN (SELECT root_id FROM lineage WHERE valid_to > TIMESTAMP '{V2}' AND valid_to <= TIMESTAMP '{V4}') OR post_pt_root_id IN (SELECT root_id FROM lineage WHERE valid_to > TIMESTAMP '{V2}' AND valid_to <= TIMESTAMP '{V4}')",
    "seg", "lineage",
)
def rows_with_expired_roots(t: Tables) -> DataFrame:
    return lineage.rows_with_expired(t.seg, lineage.expired(t.lineage, ts(V2), ts(V4)), ROOTS).select("id")


def _translated(at: str, to: str) -> str:
    return f"SELECT DISTINCT a.root_id, b.root_id AS other_root FROM lineage a JOIN lineage b USING (supervoxel_id) WHERE {_in_force('a', at)} AND {_in_force('b', to)}"


@query(_translated(V4, EARLY), "lineage")
def roots_translate_past(t: Tables) -> DataFrame:
    """Merged objects to those they came of."""
    return lineage.translate(t.lineage.select("root_id"), t.lineage, ts(V4), ts(EARLY))


@query(_translated(EARLY, V4), "lineage")
def roots_translate_future(t: Tables) -> DataFrame:
    return lineage.translate(t.lineage.select("root_id"), t.lineage, ts(EARLY), ts(V4))


_WALKED = """SELECT DISTINCT a.root_id, a.root_id AS other_root, 0 AS depth, CAST(a.root_id AS VARCHAR) AS path, NOT EXISTS (SELECT 1 FROM lineage x WHERE x.supervoxel_id = a.supervoxel_id AND x.valid_from > a.valid_from) AS last FROM lineage a
UNION ALL SELECT DISTINCT a.root_id, b.root_id, 1, a.root_id || '>' || b.root_id, b.valid_to > TIMESTAMP '9000-01-01' FROM lineage a JOIN lineage b ON b.supervoxel_id = a.supervoxel_id AND b.valid_from = a.valid_to
UNION ALL SELECT a.root_id, c.root_id, 2, min(a.root_id || '>' || b.root_id || '>' || c.root_id), true FROM lineage a JOIN lineage b ON b.supervoxel_id = a.supervoxel_id AND b.valid_from = a.valid_to JOIN lineage c ON c.supervoxel_id = b.supervoxel_id AND c.valid_from = b.valid_to GROUP BY 1, 2"""


@query(_WALKED, "lineage")
def root_histories(t: Tables) -> DataFrame:
    """Descendants of every object over all edits, with depth and shortest path."""
    edges = lineage.edit_edges(t.lineage)
    found = lineage.histories(t.lineage.select("root_id"), edges, ts("1980-01-01 00:00:00"), ts("2100-01-01 00:00:00"))
    return found.withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


@query(_translated(V4, EARLY), "lineage")
def roots_walked_back(t: Tables) -> DataFrame:
    """Objects in force to those they came of, by walking the graph of edits back to its ends between both times."""
    now = lineage.at_time(t.lineage, ts(V4)).select("root_id")
    found = lineage.histories(now, lineage.edit_edges(t.lineage), ts(EARLY), ts(V4), forward=False)
    return found.where("last").select("root_id", "other_root")


@query("SELECT id, CASE WHEN post_pt_root_id BETWEEN 200000 AND 200079 AND post_pt_root_id % 2 = 0 THEN post_pt_root_id + 5000 ELSE post_pt_root_id END AS post_pt_root_id FROM seg", "seg")
def replace_by_map(t: Tables) -> DataFrame:
    """Old roots by a map to new ones."""
    old = t.lineage.where("root_id BETWEEN 200000 AND 200079 AND root_id % 2 = 0").selectExpr("root_id AS old", "root_id + 5000 AS new").distinct()
    return lineage.replaced(t.seg, "post_pt_root_id", old).select("id", "post_pt_root_id")


_REFRESHED = """SELECT s.id,
 CASE WHEN s.{r} IS NOT NULL AND s.{r} IN (SELECT root_id FROM lineage l WHERE {now}) THEN s.{r} ELSE coalesce(l.root_id, s.{r}) END AS {r}
FROM {rows} s LEFT JOIN lineage l ON l.supervoxel_id = s.{sv} AND {now_l}"""


@query(_REFRESHED.format(r="pre_pt_root_id", sv="pre_pt_supervoxel_id", rows="seg", now=_in_force("l", V4), now_l=_in_force("l", V4)), "seg", "lineage")
def refresh_roots(t: Tables) -> DataFrame:
    """Only roots no longer in force are looked up anew."""
    return lineage.refreshed(t.seg.select("id", "pre_pt_supervoxel_id", "pre_pt_root_id"), ["pre_pt_root_id"], t.lineage, ts(V4)).select("id", "pre_pt_root_id")


@query("SELECT root_id FROM (SELECT pre_pt_root_id AS root_id FROM seg UNION SELECT post_pt_root_id FROM seg) WHERE root_id <> 0", "seg")
def distinct_roots(t: Tables) -> DataFrame:
    return aggregates.distinct_roots(t.seg, ROOTS)


@query(f"SELECT a.id, a.valid, a.tag, a.size > 100000.0 AS large, s.pre_pt_root_id, s.post_pt_root_id FROM anno a JOIN seg s USING (id) WHERE a.valid AND a.created <= TIMESTAMP '{V2}'", "anno", "seg")
def freeze_merged(t: Tables) -> DataFrame:
    """Merge at a time."""
    return v.freeze_merged(t.anno, t.seg, ts(V2)).selectExpr("id", "valid", "tag", "size > 100000.0 AS large", *ROOTS)


@query(
    f"""SELECT a.id, a.tag, coalesce(s.pre_pt_root_id, n.pre_pt_root_id) AS pre_pt_root_id FROM anno a LEFT JOIN seg s USING (id) LEFT JOIN ({_INGESTED.format(when=V2)}) n ON n.id = a.id
WHERE a.valid AND a.created <= TIMESTAMP '{V2}'""",
    "anno", "seg", "voxels", "lineage",
)
def freeze_bucketed(t: Tables) -> DataFrame:
    """Both tables by the same hash of the id, missing segmentation put into its buckets, merged without a shuffle."""
    n = 8
    paths = {x: shared_dir(t.spark, x) for x in ("anno", "seg")}
    for name, path in paths.items():
        bucketed.create(getattr(t, name), path, n)
    new = written(maintain.ingested(t.anno, t.seg, POINTS, t.voxels, VOXEL_SCALE, t.lineage, ts(V2)), "new")
    bucketed.update(t.spark, paths["seg"], new, n)
    anno, seg = (bucketed.read(t.spark, paths[x], n) for x in ("anno", "seg"))
    return v.freeze_merged(anno, seg, ts(V2)).select("id", "tag", "pre_pt_root_id")


@query(f"SELECT a.id FROM anno a JOIN seg s USING (id) WHERE a.created <= TIMESTAMP '{V2}' AND (a.deleted IS NULL OR a.deleted > TIMESTAMP '{V2}')", "anno", "seg")
def freeze_as_of(t: Tables) -> DataFrame:
    """The same with validity at that time."""
    return v.freeze_merged(t.anno, t.seg, ts(V2), as_of=True).select("id")


@query(f"SELECT id FROM anno WHERE valid AND created <= TIMESTAMP '{V2}'", "anno")
def freeze_split(t: Tables) -> DataFrame:
    return v.freeze_split(t.anno, ts(V2)).select("id")


@query(f"SELECT r.id, r.target_id FROM ref r JOIN anno a ON a.id = r.target_id JOIN seg s ON s.id = a.id WHERE a.valid AND a.created <= TIMESTAMP '{V2}' AND r.valid AND r.created <= TIMESTAMP '{V2}'", "ref", "anno", "seg")
def freeze_references(t: Tables) -> DataFrame:
    return v.freeze_references(t.ref, v.freeze_merged(t.anno, t.seg, ts(V2)), ts(V2)).select("id", "target_id")


@query("SELECT a.id FROM anno a JOIN seg s USING (id) WHERE a.valid AND a.id >= 1000 AND a.id < 5000", "anno", "seg")
def chunk_merge(t: Tables) -> DataFrame:
    """Valid rows of one id range merged."""
    return filters.valid(filters.id_range(t.anno, 1000, 5000)).join(t.seg, "id").select("id")


_ROW_TIMES = "(SELECT o_orderkey AS id, o_orderdate AS t FROM orders)"


@query(
    f"""SELECT r.id, (SELECT version FROM {versions_sql()} WHERE valid AND time_stamp <= r.t ORDER BY time_stamp DESC LIMIT 1) AS past,
 (SELECT version FROM {versions_sql()} WHERE valid AND time_stamp >= r.t ORDER BY time_stamp LIMIT 1) AS future FROM {_ROW_TIMES} r"""
)
def closest_version(t: Tables) -> DataFrame:
    """For every order's time the newest valid version before and the oldest after it (J17): one scan."""
    return v.closest_each(t.orders.select(F.col("o_orderkey").alias("id"), "o_orderdate"), "o_orderdate", versions(t.spark)).select("id", "past", "future")


@query(
    f"""SELECT 'anno' AS table_name, (SELECT count(*) FROM anno WHERE valid AND created <= TIMESTAMP '{V2}') AS live_rows,
 (SELECT count(*) FROM anno a JOIN seg s USING (id) WHERE a.valid AND a.created <= TIMESTAMP '{V2}') AS frozen_rows, false AS ok
UNION ALL SELECT 'ref', count(*), count(*), true FROM ref WHERE created <= TIMESTAMP '{V2}'""",
    "anno", "seg", "ref",
)
def validate_snapshot(t: Tables) -> DataFrame:
    """Live and frozen counts by table."""
    frozen = {"anno": v.freeze_merged(t.anno, t.seg, ts(V2)), "ref": v.freeze_split(t.ref, ts(V2))}
    return v.validated({"anno": t.anno, "ref": t.ref}, frozen, ts(V2))


_ORDER_VERSIONS = "(SELECT o_orderkey AS version, o_orderdate AS time_stamp, o_orderstatus <> 'F' AS valid, o_orderdate + to_days(CAST(o_custkey % 900 AS INT)) AS expires_on FROM orders)"


def _order_versions(t: Tables) -> DataFrame:
    """A version an order: its date, whether it is valid, and when it expires."""
    return t.orders.selectExpr("o_orderkey AS version", "o_orderdate AS time_stamp", "o_orderstatus <> 'F' AS valid", "o_orderdate + make_dt_interval(CAST(o_custkey % 900 AS INT)) AS expires_on")


@query(
    f"""SELECT version, place FROM (SELECT version, row_number() OVER (ORDER BY time_stamp, version) AS place FROM {_ORDER_VERSIONS},
 (SELECT max(o_orderdate) AS now, max(CASE WHEN o_orderstatus <> 'F' THEN o_orderdate END) AS newest FROM orders)
 WHERE (expires_on < now OR NOT valid) AND NOT (valid AND time_stamp = newest)) WHERE place <= (SELECT count(*) FROM orders) - 10"""
)
def retention_plan(t: Tables) -> DataFrame:
    """Of a version an order, those to remove as of the newest order (W4, T20, U4): ten stay at least."""
    now = t.orders.agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd HH:mm:ss")).first()[0]
    return v.retention(_order_versions(t), ts(now), keep=10)


_MONTHS = """(SELECT year(o_orderdate) * 12 + month(o_orderdate) AS version, max(o_orderdate) AS time_stamp, count(*) % 3 > 0 AS valid,
 max(o_orderdate) + INTERVAL 900 DAY AS expires_on, count(*) AS n FROM orders GROUP BY 1)"""


@query(
    f"""WITH m AS {_MONTHS}, gone AS (SELECT version, row_number() OVER (ORDER BY time_stamp, version) AS place FROM m, (SELECT max(o_orderdate) AS now FROM orders), (SELECT max(time_stamp) AS newest FROM m WHERE valid)
 WHERE (expires_on < now OR NOT valid) AND NOT (valid AND time_stamp = newest))
SELECT version, n FROM m WHERE version NOT IN (SELECT version FROM gone WHERE place <= (SELECT count(*) FROM m) - 40)"""
)
def retention_removed(t: Tables) -> DataFrame:
    """A stored version a month of orders, and what is left of them after the removal of expired and invalid ones."""
    root = shared_dir(t.spark, "versions")
    version = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    t.orders.withColumn("version", version).write.partitionBy("version").parquet(root)
    of = t.orders.groupBy(version.alias("version")).agg(F.max("o_orderdate").alias("time_stamp"), (F.count(F.lit(1)) % 3 > 0).alias("valid"))
    of = written(of.withColumn("expires_on", F.expr("time_stamp + INTERVAL 900 DAY")), "months")
    now = t.orders.agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd HH:mm:ss")).first()[0]
    plan = v.retention(of, ts(now), keep=40)
    v.removed(t.spark, plan.withColumn("version", F.concat(F.lit("version="), F.col("version").cast("string"))), root)
    left = t.spark.read.parquet(root)
    return left.groupBy(F.col("version").cast("long").alias("version")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS version FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def newest_version(t: Tables) -> DataFrame:
    """The newest valid version."""
    return v.newest(_order_versions(t))


@query(
    f"""SELECT 2 AS version, 'anno' AS table_name, count(*) AS frozen_rows, 'AVAILABLE' AS status FROM anno WHERE valid AND created <= TIMESTAMP '{V2}'
UNION ALL SELECT 2, 'ref', count(*), 'AVAILABLE' FROM ref WHERE valid AND created <= TIMESTAMP '{V2}'""",
    "anno", "seg", "ref",
)
def complete_version(t: Tables) -> DataFrame:
    """Fill in missing segmentation, freeze all tables, check them, give their catalogue rows."""
    seg = t.seg.unionByName(maintain.ingested(t.anno, t.seg, POINTS, t.voxels, VOXEL_SCALE, t.lineage, ts(V2)))
    return v.complete(t.spark, {"anno": (t.anno, seg), "ref": (t.ref, None)}, ts(V2), shared_dir(t.spark, "versions"), 2)


@query(
    f"""SELECT 2 AS version, 'anno' AS table_name, count(*) AS frozen_rows, CASE WHEN count(*) = (SELECT count(*) FROM anno WHERE valid AND created <= TIMESTAMP '{V2}') THEN 'AVAILABLE' ELSE 'FAILED' END AS status
FROM anno a JOIN seg s USING (id) WHERE a.valid AND a.created <= TIMESTAMP '{V2}'""",
    "anno", "seg",
)
def incomplete_version(t: Tables) -> DataFrame:
    """A version whose segmentation lacks rows fails its check."""
    return v.complete(t.spark, {"anno": (t.anno, t.seg)}, ts(V2), shared_dir(t.spark, "versions"), 2)


def _edited(early: str, late: str) -> tuple[str, str]:
    return f"(created > TIMESTAMP '{early}' AND created <= TIMESTAMP '{late}')", f"coalesce(deleted > TIMESTAMP '{early}' AND deleted <= TIMESTAMP '{late}', false)"


_C, _D = _edited(V2, BETWEEN)
_FROZEN2 = f"SELECT a.id FROM anno a JOIN seg s USING (id) WHERE a.created <= TIMESTAMP '{V2}' AND (a.deleted IS NULL OR a.deleted > TIMESTAMP '{V2}')"


@query(
    f"""SELECT id FROM ({_FROZEN2}) WHERE id NOT IN (SELECT id FROM anno WHERE {_D})
UNION ALL SELECT a.id FROM anno a JOIN seg s USING (id) WHERE {_C} AND NOT {_D}""",
    "anno", "seg",
)
def combine_forward(t: Tables) -> DataFrame:
    """A version and what was edited after it."""
    frozen = v.freeze_merged(t.anno, t.seg, ts(V2), as_of=True)
    delta = filters.edited_between(t.anno, ts(V2), ts(BETWEEN)).join(t.seg, "id")
    return live.combined(frozen, delta, ts(V2), ts(BETWEEN)).select("id")


_CB, _DB = _edited(BETWEEN, V4)
_FROZEN4 = f"SELECT a.id FROM anno a JOIN seg s USING (id) WHERE a.created <= TIMESTAMP '{V4}' AND (a.deleted IS NULL OR a.deleted > TIMESTAMP '{V4}')"


@query(
    f"""SELECT id FROM ({_FROZEN4}) WHERE id NOT IN (SELECT id FROM anno WHERE {_CB})
UNION ALL SELECT a.id FROM anno a JOIN seg s USING (id) WHERE {_DB} AND NOT {_CB}""",
    "anno", "seg",
)
def combine_backward(t: Tables) -> DataFrame:
    """A later version without what was edited before it (T4)."""
    frozen = v.freeze_merged(t.anno, t.seg, ts(V4), as_of=True)
    delta = filters.edited_between(t.anno, ts(BETWEEN), ts(V4)).join(t.seg, "id")
    return live.combined(frozen, delta, ts(V4), ts(BETWEEN), forward=False).select("id")


_NOW = _in_force("l", BETWEEN)


@query(
    f"""SELECT r.id, r.pre_pt_root_id, r.tag FROM (
  SELECT a.id, a.tag, CASE WHEN s.pre_pt_root_id IS NOT NULL AND s.pre_pt_root_id IN (SELECT root_id FROM lineage l WHERE {_NOW}) THEN s.pre_pt_root_id
    ELSE coalesce(l.root_id, s.pre_pt_root_id) END AS pre_pt_root_id
  FROM anno a JOIN seg s USING (id) LEFT JOIN lineage l ON l.supervoxel_id = s.pre_pt_supervoxel_id AND {_NOW}
  WHERE a.created <= TIMESTAMP '{BETWEEN}' AND (a.deleted IS NULL OR a.deleted > TIMESTAMP '{BETWEEN}') AND a.tag <> '5-LOW'
    AND (a.created > TIMESTAMP '{V2}' OR s.pre_pt_root_id IN (SELECT b.root_id FROM lineage a2 JOIN lineage b USING (supervoxel_id) WHERE a2.root_id IN (300001, 300003, 100021) AND {_in_force('a2', BETWEEN)} AND {_in_force('b', V2)}))
) r WHERE r.pre_pt_root_id IN (300001, 300003, 100021)""",
    "anno", "seg", "lineage",
)
def query_at_time(t: Tables) -> DataFrame:
    """Any time: translated filters, version, delta, refreshed roots, filters again, columns asked for."""
    frozen = written(v.freeze_merged(t.anno, t.seg, ts(V2), as_of=True), "version")
    spec = {"in": {"pre_pt_root_id": [300001, 300003, 100021]}, "notin": {"tag": ["5-LOW"]}}
    return live.at_time(frozen, t.anno, t.seg, t.lineage, ts(V2), ts(BETWEEN), spec, select=["id", "pre_pt_root_id", "tag"])


@query("SELECT a.id FROM anno a LEFT JOIN seg s USING (id) WHERE a.valid AND s.id IS NULL", "anno", "seg")
def missing_segmentation(t: Tables) -> DataFrame:
    """Valid annotations without segmentation."""
    return maintain.missing(t.anno, t.seg).select("id")


@query(_LOOKED.format(rows="anno"), "anno", "voxels")
def point_lookup_pivot(t: Tables) -> DataFrame:
    """Supervoxels at all points."""
    return maintain.looked_up(t.anno, POINTS, t.voxels, VOXEL_SCALE)


@query(_LOOKED.format(rows="anno"), "anno", "voxels")
def point_lookup_blocks(t: Tables) -> DataFrame:
    """The same from compressed blocks, each decoded where its points come to."""
    path = shared_dir(t.spark, "volume")
    volume.write(t.voxels, path, 8)
    return maintain.looked_up_blocks(t.anno, POINTS, path, 8, VOXEL_SCALE)


@query(
    f"""SELECT k.id, k.pre_pt_supervoxel_id, l.root_id AS pre_pt_root_id, k.post_pt_supervoxel_id, m.root_id AS post_pt_root_id FROM ({_LOOKED.format(rows=_MISSING)}) k
LEFT JOIN lineage l ON l.supervoxel_id = k.pre_pt_supervoxel_id AND {_in_force('l', V2)} LEFT JOIN lineage m ON m.supervoxel_id = k.post_pt_supervoxel_id AND {_in_force('m', V2)}""",
    "anno", "seg", "voxels", "lineage",
)
def ingest_missing(t: Tables) -> DataFrame:
    """Segmentation for what has none."""
    return maintain.ingested(t.anno, t.seg, POINTS, t.voxels, VOXEL_SCALE, t.lineage, ts(V2))


@query(
    f"""SELECT * FROM seg UNION ALL SELECT k.id, k.pre_pt_supervoxel_id, l.root_id, k.post_pt_supervoxel_id, m.root_id FROM ({_LOOKED.format(rows=_MISSING)}) k
LEFT JOIN lineage l ON l.supervoxel_id = k.pre_pt_supervoxel_id AND {_in_force('l', V2)} LEFT JOIN lineage m ON m.supervoxel_id = k.post_pt_supervoxel_id AND {_in_force('m', V2)}""",
    "anno", "seg", "voxels", "lineage",
)
def ingest_appended(t: Tables) -> DataFrame:
    """The segmentation table after its missing rows were appended."""
    path = shared_dir(t.spark, "seg")
    t.seg.write.parquet(path)
    new = written(maintain.ingested(t.anno, t.seg, POINTS, t.voxels, VOXEL_SCALE, t.lineage, ts(V2)), "new")
    new.write.mode("append").parquet(path)
    return t.spark.read.parquet(path)


_EXPIRED = f"(SELECT root_id FROM lineage WHERE valid_to > TIMESTAMP '{V2}' AND valid_to <= TIMESTAMP '{V4}')"


@query(
    f"""SELECT s.id, coalesce(l.root_id, s.pre_pt_root_id) AS pre_pt_root_id, coalesce(m.root_id, s.post_pt_root_id) AS post_pt_root_id
FROM (SELECT * FROM seg WHERE pre_pt_root_id IS NULL OR post_pt_root_id IS NULL OR pre_pt_root_id IN {_EXPIRED} OR post_pt_root_id IN {_EXPIRED}) s
LEFT JOIN lineage l ON l.supervoxel_id = s.pre_pt_supervoxel_id AND {_in_force('l', V4)} LEFT JOIN lineage m ON m.supervoxel_id = s.post_pt_supervoxel_id AND {_in_force('m', V4)}""",
    "seg", "lineage",
)
def refresh_expired(t: Tables) -> DataFrame:
    """New roots of rows whose roots expired or are missing."""
    return maintain.refreshed_expired(t.seg, ROOTS, t.lineage, ts(V2), ts(V4)).select("id", *ROOTS)


@query(f"SELECT s.id, coalesce(s.pre_pt_root_id, l.root_id) AS pre_pt_root_id FROM seg s LEFT JOIN lineage l ON l.supervoxel_id = s.pre_pt_supervoxel_id AND {_in_force('l', V2)} WHERE s.pre_pt_root_id IS NULL OR s.post_pt_root_id IS NULL", "seg", "lineage")
def fill_sparse(t: Tables) -> DataFrame:
    """Missing roots at the time of the last update."""
    return maintain.filled(t.seg, ROOTS, t.lineage, ts(V2)).select("id", "pre_pt_root_id")


@query(f"SELECT s.id, l.root_id AS pre_pt_root_id FROM seg s LEFT JOIN lineage l ON l.supervoxel_id = s.pre_pt_supervoxel_id AND {_in_force('l', V2)} WHERE s.id >= 100 AND s.id < 50000 AND (s.pre_pt_root_id IS NULL OR s.pre_pt_root_id = 0) AND (s.post_pt_root_id IS NULL OR s.post_pt_root_id = 0)", "seg", "lineage")
def fill_dense(t: Tables) -> DataFrame:
    """Rows of an id range without any root."""
    return maintain.filled_range(t.seg, ROOTS, t.lineage, ts(V2), 100, 50_000).select("id", "pre_pt_root_id")


@query("SELECT id, CASE WHEN pre_pt_root_id NOT IN (200001, 100021) THEN pre_pt_root_id END AS pre_pt_root_id, CASE WHEN post_pt_root_id NOT IN (200001, 100021) THEN post_pt_root_id END AS post_pt_root_id FROM seg", "seg")
def reset_bad_roots(t: Tables) -> DataFrame:
    """Bad roots to null."""
    return maintain.reset(t.seg, ROOTS, [200001, 100021]).select("id", *ROOTS)


@query("SELECT coalesce(s.id, n.id) AS id, coalesce(CASE WHEN n.pre_pt_root_id > 0 THEN n.pre_pt_root_id END, s.pre_pt_root_id, 0) AS pre_pt_root_id, coalesce(s.post_pt_root_id, 0) AS post_pt_root_id FROM seg s FULL JOIN (SELECT id, CASE WHEN id % 2 = 0 THEN 0 ELSE id END AS pre_pt_root_id FROM anno) n ON n.id = s.id", "seg", "anno")
def upsert_positive(t: Tables) -> DataFrame:
    """Positive new values win, absent ones are 0."""
    new = t.anno.selectExpr("id", "CASE WHEN id % 2 = 0 THEN 0 ELSE id END AS pre_pt_root_id")
    return maintain.upserted_positive(t.seg.select("id", *ROOTS), new).select("id", *ROOTS)


@query("SELECT coalesce(s.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.pre_pt_root_id ELSE s.pre_pt_root_id END AS pre_pt_root_id FROM seg s FULL JOIN (SELECT id, id * 10 AS pre_pt_root_id FROM anno WHERE valid) n ON n.id = s.id", "seg", "anno")
def upsert_by_key(t: Tables) -> DataFrame:
    """Rows that are there are updated, others inserted."""
    new = filters.valid(t.anno).selectExpr("id", "id * 10 AS pre_pt_root_id")
    return maintain.upserted(t.seg.select("id", "pre_pt_root_id"), new)


_BATCH = """(SELECT CASE WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN '99999999999999999999' WHEN id % 17 = 0 THEN '-' || id ELSE CAST(id AS VARCHAR) END AS id, id * 10 AS pre_pt_root_id FROM anno
 UNION ALL SELECT CAST(id AS VARCHAR), id * 10 FROM anno WHERE id % 3 = 0 AND id % 11 <> 0 AND id % 13 <> 0
 UNION ALL SELECT CAST(id AS VARCHAR), id * 10 + 1 FROM anno WHERE id % 19 = 0)"""
_JUDGED = f"""(SELECT id, pre_pt_root_id, CASE WHEN id IS NULL THEN 'no key' WHEN TRY_CAST(id AS BIGINT) IS NULL THEN 'id is no bigint' WHEN CAST(id AS BIGINT) < 1 THEN 'key out of range' WHEN n > 1 THEN 'repeated key' END AS reason
 FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM (SELECT DISTINCT * FROM {_BATCH})))"""


def _bad_batch(t: Tables) -> DataFrame:
    """Annotations' ids as text with objects: some null, too large, below 1, or given twice, with one object or two."""
    key = F.expr("CASE WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN '99999999999999999999' WHEN id % 17 = 0 THEN '-' || id ELSE CAST(id AS STRING) END")
    first = t.anno.select(key.alias("id"), (F.col("id") * 10).alias("pre_pt_root_id"))
    again = t.anno.where("id % 3 = 0 AND id % 11 <> 0 AND id % 13 <> 0").selectExpr("CAST(id AS STRING) AS id", "id * 10 AS pre_pt_root_id")
    other = t.anno.where("id % 19 = 0").selectExpr("CAST(id AS STRING) AS id", "id * 10 + 1 AS pre_pt_root_id")
    return first.unionAll(again).unionAll(other)


@query(f"SELECT coalesce(s.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.pre_pt_root_id ELSE s.pre_pt_root_id END AS pre_pt_root_id FROM seg s FULL JOIN (SELECT CAST(id AS BIGINT) AS id, pre_pt_root_id FROM {_JUDGED} WHERE reason IS NULL) n ON n.id = s.id", "seg", "anno")
def upsert_checked(t: Tables) -> DataFrame:
    """An upsert of which bad rows cost no other row its place."""
    return maintain.upserted_checked(t.seg.select("id", "pre_pt_root_id"), _bad_batch(t), low=1)[0]


@query(f"SELECT id, pre_pt_root_id, reason FROM {_JUDGED} WHERE reason IS NOT NULL", "anno")
def upsert_rejects(t: Tables) -> DataFrame:
    """The rows that the same upsert could not take, and why."""
    return maintain.upserted_checked(t.seg.select("id", "pre_pt_root_id"), _bad_batch(t), low=1)[1]


@query(
    """SELECT s.id, s.pre_pt_supervoxel_id, s.post_pt_supervoxel_id, s.pre_pt_root_id, s.post_pt_root_id FROM seg s JOIN orders o ON o.o_orderkey = s.id
WHERE s.pre_pt_supervoxel_id = 1000 + o.o_custkey AND s.post_pt_supervoxel_id = 1000 + (o.o_orderkey + (o.o_orderkey % 7 = 0)::INT) * 13 % 150""",
    "seg",
)
def known_roots(t: Tables) -> DataFrame:
    """Natural join with known segmentation on all shared columns (J13): a row that a new lookup put into another
    supervoxel has no known root.
    """
    anew = (F.col("o_orderkey") + (F.col("o_orderkey") % 7 == 0).cast("int")) * 13 % 150
    looked = t.orders.select(F.col("o_orderkey").alias("id"), (1000 + F.col("o_custkey")).alias("pre_pt_supervoxel_id"), (1000 + anew).alias("post_pt_supervoxel_id"))
    return maintain.known_roots(looked, t.seg)


@query(
    f"""SELECT coalesce(s.id, k.id) AS id, coalesce(CASE WHEN k.pre_pt_supervoxel_id > 0 THEN k.pre_pt_supervoxel_id END, s.pre_pt_supervoxel_id, 0) AS pre_pt_supervoxel_id
FROM seg s FULL JOIN ({_LOOKED.format(rows='(SELECT * FROM anno WHERE valid)')}) k ON k.id = s.id""",
    "seg", "anno", "voxels",
)
def spatial_lookup(t: Tables) -> DataFrame:
    """All points looked up anew, put over the old rows."""
    return maintain.whole_lookup(t.anno, t.seg, POINTS, t.voxels, VOXEL_SCALE, t.lineage, ts(V2)).select("id", "pre_pt_supervoxel_id")


@query(_LOOKED.format(rows="(SELECT * FROM anno WHERE valid)"), "anno", "voxels")
def resumed_lookup(t: Tables) -> DataFrame:
    """The same by cells, a part of them a run, until none is left."""
    log, target = shared_dir(t.spark, "ledger"), shared_dir(t.spark, "looked-up")
    anno, voxels = written(t.anno, "anno"), written(t.voxels, "voxels")
    n = anno.selectExpr(*[f"floor({POINTS[0]}_{a} / 32768)" for a in "xyz"]).distinct().count()
    while maintain.lookup_some(anno, POINTS, voxels, VOXEL_SCALE, log, target, 32_768, n // 2 + 1):
        pass
    return ledger.results(t.spark, log, target, maintain.CELL).drop("run", *maintain.CELL)


_CELLS = "SELECT DISTINCT CAST(floor(pre_pt_position_x / 8192) AS BIGINT) AS cx, CAST(floor(pre_pt_position_y / 8192) AS BIGINT) AS cy FROM anno"


@query(f"SELECT cx, cy, CASE WHEN (cx + cy) % 4 = 1 THEN 0 ELSE 1 END AS rank FROM ({_CELLS}) WHERE (cx + cy) % 4 IN (1, 3)", "anno")
def remaining_chunks(t: Tables) -> DataFrame:
    """Cells still to do: those to try again first."""
    cells = t.anno.selectExpr("CAST(floor(pre_pt_position_x / 8192) AS BIGINT) AS cx", "CAST(floor(pre_pt_position_y / 8192) AS BIGINT) AS cy").distinct()
    status = F.when(F.expr("(cx + cy) % 4 = 0"), "completed").when(F.expr("(cx + cy) % 4 = 1"), "retryable").otherwise("failed")
    noted = cells.where("(cx + cy) % 4 < 3").withColumn("status", status)
    return ledger.remaining(cells, noted, ["cx", "cy"]).select("cx", "cy", "rank")


@query(
    f"""SELECT cx, cy, CASE WHEN (cx + cy) % 5 = 0 THEN 'failed' ELSE 'completed' END AS status,
 CASE (cx + cy) % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 1 END AS tries FROM ({_CELLS})""",
    "anno",
)
def worked_cells(t: Tables) -> DataFrame:
    """Cells worked on until none is left, by their log (T19): of five kinds one always fails, one stalls at
    first until its lease is over, one fails once, two succeed.
    """
    log, keys = shared_dir(t.spark, "ledger"), ["cx", "cy"]
    cells = written(t.anno.selectExpr("CAST(floor(pre_pt_position_x / 8192) AS BIGINT) AS cx", "CAST(floor(pre_pt_position_y / 8192) AS BIGINT) AS cy").distinct(), "cells")
    now, lease, hour = dt.datetime(2000, 1, 1), dt.timedelta(minutes=30), dt.timedelta(hours=1)
    first = True
    while True:
        run, mine = ledger.claim(cells, log, keys, now=now, lease=lease)
        if not mine.limit(1).count():
            return ledger.folded(ledger.log(t.spark, log, keys), keys, now).select(*keys, "status", F.col("tries").cast("int").alias("tries"))
        kind = F.expr("(cx + cy) % 5")
        fails = (kind == 0) | ((kind == 2) & F.lit(first))
        ledger.finish(mine.where(fails), log, keys, run, ok=False, now=now)
        ledger.finish(mine.where(~fails & ~((kind == 1) & F.lit(first))), log, keys, run, now=now)
        now, first = now + hour, False


_FULL = f"""SELECT * FROM seg UNION ALL SELECT k.id, k.pre_pt_supervoxel_id, l.root_id, k.post_pt_supervoxel_id, m.root_id FROM ({_LOOKED.format(rows=_MISSING)}) k
LEFT JOIN lineage l ON l.supervoxel_id = k.pre_pt_supervoxel_id AND {_in_force('l', V4)} LEFT JOIN lineage m ON m.supervoxel_id = k.post_pt_supervoxel_id AND {_in_force('m', V4)}"""


@query(
    f"""SELECT s.id, CASE WHEN s.stale THEN coalesce(l.root_id, s.pre_pt_root_id) ELSE s.pre_pt_root_id END AS pre_pt_root_id,
 CASE WHEN s.stale THEN coalesce(m.root_id, s.post_pt_root_id) ELSE s.post_pt_root_id END AS post_pt_root_id
FROM (SELECT *, pre_pt_root_id IS NULL OR post_pt_root_id IS NULL OR pre_pt_root_id IN {_EXPIRED} OR post_pt_root_id IN {_EXPIRED} AS stale FROM ({_FULL})) s
LEFT JOIN lineage l ON l.supervoxel_id = s.pre_pt_supervoxel_id AND {_in_force('l', V4)} LEFT JOIN lineage m ON m.supervoxel_id = s.post_pt_supervoxel_id AND {_in_force('m', V4)}""",
    "anno", "seg", "voxels", "lineage",
)
def update_live(t: Tables) -> DataFrame:
    """Missing rows added and expired roots refreshed in one go."""
    out = maintain.updated({"anno": (t.anno, t.seg, POINTS)}, t.voxels, VOXEL_SCALE, t.lineage, ts(V2), ts(V4))
    return out["anno"].select("id", *ROOTS)


@query("SELECT id, tag, valid FROM anno", "anno")
def staged_transfer(t: Tables) -> DataFrame:
    """Staged, counted, put in place of a smaller table."""
    path = shared_dir(t.spark, "production")
    filters.valid(t.anno).write.parquet(path)
    maintain.transferred(t.spark, t.anno, path, overwrite=True)
    return t.spark.read.parquet(current(t.spark, path)).select("id", "tag", "valid")


@query("SELECT o_orderkey AS id, o_custkey AS pre, o_orderkey * 2 AS sv, o_orderkey * 3 AS root FROM orders")
def column_files_ingest(t: Tables) -> DataFrame:
    """Orders as column files of one and two columns, glued by their place and split."""
    rows = aggregates.ranked(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey").selectExpr("rank - 1 AS row_idx", "o_orderkey AS id", "o_custkey AS pre", "o_orderkey * 2 AS sv", "o_orderkey * 3 AS root")
    rows = written(rows, "columns")
    folder = shared_dir(t.spark, "column-files")
    files = [
        *columnfiles.write(rows, folder, "id", ["id"], file_rows=5000),
        *columnfiles.write(rows, folder, "pre", ["pre"]),
        *columnfiles.write(rows, folder, "both", ["sv", "root"], fortran=True, file_rows=7000),
    ]
    anno, seg = columnfiles.split(columnfiles.read(t.spark, files, 4096), {"id": "id", "pre": "pre"}, {"id": "id", "sv": "sv", "root": "root"})
    return anno.join(seg.hint("merge"), "id")


@query("SELECT CAST(rn - 1 AS BIGINT) AS start FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) WHERE (rn - 1) % 1000 = 0 AND o_orderstatus = 'F'")
def missing_chunks(t: Tables) -> DataFrame:
    """Chunks whose first id is not in the table, here that of orders still open."""
    ids = aggregates.ranked(t.orders.select("o_orderkey"), "o_orderkey").selectExpr("rank - 1 AS row_idx", "o_orderkey AS id")
    return columnfiles.missing_chunks(t.spark, ids, [], 1000, t.orders.where("o_orderstatus <> 'F'").selectExpr("o_orderkey AS id"))


@query(
    f"""SELECT k.id, k.pre_pt_supervoxel_id, l.root_id AS pre_pt_root_id, k.post_pt_supervoxel_id, m.root_id AS post_pt_root_id FROM ({_LOOKED.format(rows=_MISSING)}) k
LEFT JOIN lineage l ON l.supervoxel_id = k.pre_pt_supervoxel_id AND {_in_force('l', V2)} LEFT JOIN lineage m ON m.supervoxel_id = k.post_pt_supervoxel_id AND {_in_force('m', V2)}
UNION ALL SELECT * FROM seg""",
    "anno", "seg", "voxels", "lineage",
)
def stream_ingest(t: Tables) -> DataFrame:
    """New annotations as a stream of files, run to its end twice."""
    source, target, check = (shared_dir(t.spark, x) for x in ("arrivals", "seg", "stream"))
    t.anno.repartition(4, "id").write.parquet(source)
    t.seg.write.parquet(target)
    for run in range(2):  # the second finds nothing new
        streams.ingest(t.spark, source, t.anno.schema, target, f"{check}-{run}", t.seg.schema, POINTS, written(t.voxels, "voxels"), VOXEL_SCALE, written(t.lineage, "lineage"), V2).awaitTermination()
    return t.spark.read.schema(t.seg.schema).parquet(target)


@query(
    f"""SELECT s.id, coalesce(l.root_id, s.pre_pt_root_id) AS pre_pt_root_id, coalesce(m.root_id, s.post_pt_root_id) AS post_pt_root_id
FROM seg s LEFT JOIN lineage l ON l.supervoxel_id = s.pre_pt_supervoxel_id AND {_in_force('l', V4)} LEFT JOIN lineage m ON m.supervoxel_id = s.post_pt_supervoxel_id AND {_in_force('m', V4)}""",
    "seg", "lineage",
)
def stream_refresh(t: Tables) -> DataFrame:
    """Lineage changes as a stream with keyed state (R2): the newest rows come first, then all others, closed
    ones and ones that are late among them; the deltas are put together at the end.
    """
    source, target, check = (shared_dir(t.spark, x) for x in ("changes", "seg", "stream"))
    newest = F.col("valid_from") == ts(MERGE)
    t.seg.write.parquet(target)
    for rows in (t.lineage.where(newest), t.lineage.where(~newest)):
        rows.write.mode("append").parquet(source)
        streams.refresh(t.spark, source, t.lineage.schema, target, check, ROOTS, V4).awaitTermination()
    streams.compacted(t.spark, target, ROOTS)
    return streams.latest_rows(t.spark, target, ROOTS).select("id", *ROOTS)
