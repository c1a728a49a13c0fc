"""Domain tables derived from the given ones, as SQL that Spark and other engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .schema import SYNAPSE, Table

RESOLUTION = (4.0, 4.0, 40.0)
#: Size of a voxel of the ``voxels`` table, in voxels of the annotations.
VOXEL_SCALE = (2.0, 2.0, 1.0)

SQL = {
    "anno": """
 SELECT o_orderkey AS id, o_orderdate AS created,
  CASE WHEN o_orderstatus='F' THEN o_orderdate + INTERVAL 200 DAY END AS deleted,
  CASE WHEN o_orderstatus='F' AND o_orderkey % 3 = 0 THEN o_orderkey + 1 END AS superceded_id,
  o_orderstatus <> 'F' AS valid,
  CAST((o_orderkey*7919) % 100000 AS INT) AS pre_pt_position_x, CAST((o_orderkey*104729) % 80000 AS INT) AS pre_pt_position_y, CAST((o_custkey*31) % 4000 AS INT) AS pre_pt_position_z,
  CAST((o_orderkey*6007) % 100000 AS INT) AS post_pt_position_x, CAST((o_orderkey*15331) % 80000 AS INT) AS post_pt_position_y, CAST((o_custkey*17) % 4000 AS INT) AS post_pt_position_z,
  o_orderpriority AS tag, o_totalprice AS size FROM {orders}""",
    "lineage": """
 SELECT 1000 + c_custkey AS supervoxel_id, 100000 + c_nationkey AS root_id, TIMESTAMP '1990-01-01 00:00:00' AS valid_from,
   CASE WHEN c_nationkey >= 20 THEN TIMESTAMP '9999-01-01 00:00:00' ELSE TIMESTAMP '1997-01-01 00:00:00' END AS valid_to FROM {customer}
 UNION ALL SELECT 1000 + c_custkey, 200000 + c_nationkey*4 + c_custkey % 4, TIMESTAMP '1997-01-01 00:00:00', TIMESTAMP '1999-06-01 00:00:00' FROM {customer} WHERE c_nationkey < 20
 UNION ALL SELECT 1000 + c_custkey, 300000 + c_nationkey % 5, TIMESTAMP '1999-06-01 00:00:00', TIMESTAMP '9999-01-01 00:00:00' FROM {customer} WHERE c_nationkey < 20""",
    "seg": """
 SELECT o.o_orderkey AS id, 1000 + o.o_custkey AS pre_pt_supervoxel_id,
  CASE WHEN o.o_orderkey % 89 = 0 THEN NULL WHEN o.o_orderkey % 83 = 0 THEN 0 ELSE a.root_id END AS pre_pt_root_id,
  1000 + (o.o_orderkey*13) % 150 AS post_pt_supervoxel_id,
  CASE WHEN o.o_orderkey % 267 = 0 THEN NULL WHEN o.o_orderkey % 445 = 0 OR o.o_orderkey % 249 = 0 THEN 0 WHEN o.o_orderkey % 415 = 0 THEN NULL ELSE b.root_id END AS post_pt_root_id
 FROM {orders} o
 LEFT JOIN {lineage} a ON a.supervoxel_id = 1000 + o.o_custkey AND a.valid_from <= TIMESTAMP '1998-01-01 00:00:00' AND TIMESTAMP '1998-01-01 00:00:00' < a.valid_to
 LEFT JOIN {lineage} b ON b.supervoxel_id = 1000 + (o.o_orderkey*13) % 150 AND b.valid_from <= TIMESTAMP '1998-01-01 00:00:00' AND TIMESTAMP '1998-01-01 00:00:00' < b.valid_to
 WHERE o.o_orderkey % 97 <> 0""",
    "voxels": """
 SELECT CAST(floor(pre_pt_position_x/2.0) AS INT) AS vx, CAST(floor(pre_pt_position_y/2.0) AS INT) AS vy, pre_pt_position_z AS vz, max(1000 + id % 150) AS supervoxel_id
 FROM {anno} WHERE id % 11 <> 0 GROUP BY 1,2,3""",
    "ref": """
 SELECT o_orderkey*10 + 1 AS id, o_orderkey AS target_id, o_orderdate AS created, true AS valid, o_orderstatus AS label FROM {orders} WHERE o_orderkey % 4 = 0""",
}
_NEEDS = {"anno": ["orders"], "lineage": ["customer"], "seg": ["orders", "lineage"], "voxels": ["anno"], "ref": ["orders"]}

#: (version, time_stamp, valid, expires_on, status)
VERSIONS = (
    (1, "1996-12-31 00:00:00", True, "1997-06-30 00:00:00", "AVAILABLE"),
    (2, "1998-12-31 00:00:00", True, "2002-01-01 00:00:00", "AVAILABLE"),
    (3, "2000-01-01 00:00:00", False, "2000-02-01 00:00:00", "FAILED"),
    (4, "2000-12-31 00:00:00", True, None, "AVAILABLE"),
)


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or a given one."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(SQL[name], **{n: derived(spark, sf_dir, n) for n in _NEEDS[name]})


def with_sql(*names: str) -> str:
    """The same tables as the beginning of a SQL statement."""
    wanted = list(dict.fromkeys([m for n in names for m in (*[x for x in _NEEDS[n] if x in SQL], n)]))
    return "WITH " + ", ".join(f"{n} AS ({SQL[n].format(**{x: x for x in _NEEDS[n]})})" for n in wanted) + "\n"


def versions(spark: SparkSession) -> DataFrame:
    cols = "version int, time_stamp string, valid boolean, expires_on string, status string"
    df = spark.createDataFrame(list(VERSIONS), cols)
    return df.selectExpr(
        "'fixture' AS datastack", "version", "CAST(time_stamp AS TIMESTAMP_NTZ) AS time_stamp", "valid",
        "CAST(expires_on AS TIMESTAMP_NTZ) AS expires_on", "status", "true AS is_merged", "CAST(NULL AS INT) AS parent_version",
    )


def versions_sql() -> str:
    """The version rows as a SQL VALUES list."""
    said = lambda t: "NULL" if t is None else f"TIMESTAMP '{t}'"
    rows = ", ".join(f"({v}, {said(t)}, {str(ok).lower()}, {said(x)}, '{s}')" for v, t, ok, x, s in VERSIONS)
    return f"(SELECT * FROM (VALUES {rows}) AS t(version, time_stamp, valid, expires_on, status))"


def anno_table(spark: SparkSession, sf_dir: str) -> Table:
    return Table("anno", derived(spark, sf_dir, "anno"), RESOLUTION, {"schema": SYNAPSE})
