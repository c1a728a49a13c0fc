"""Scans, projections, filters and joins on frozen tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import RESOLUTION
from ..functions import scalar
from ..operators import filters, projections
from ..plans import query as q
from ..plans import versions, views
from ..schema import SYNAPSE, Table
from ..sources import csv
from ..store import shared_dir, written
from .base import Tables, query, ts

ROOTS = ["pre_pt_root_id", "post_pt_root_id"]
BOX = ((10_000, 10_000, 100), (60_000, 60_000, 3_000))


def _flat(t: Tables) -> DataFrame:
    return t.anno.join(t.seg, "id")


def _anno(t: Tables) -> Table:
    return Table("anno", t.anno, RESOLUTION, {"schema": SYNAPSE})


@query(
    """SELECT a.id, s.pre_pt_root_id, s.pre_pt_supervoxel_id,
 a.pre_pt_position_x * 4.0 AS pre_pt_position_x, a.pre_pt_position_y * 4.0 AS pre_pt_position_y, a.pre_pt_position_z * 40.0 AS pre_pt_position_z
FROM anno a JOIN seg s USING (id)
WHERE a.valid AND a.created <= TIMESTAMP '1998-12-31 00:00:00' AND a.pre_pt_position_x BETWEEN 10000 AND 60000 AND a.pre_pt_position_y BETWEEN 10000 AND 60000
 AND a.pre_pt_position_z BETWEEN 100 AND 3000 AND s.post_pt_root_id IN (200001, 200002, 200003, 200005, 200008, 200010, 200013, 100020, 100021)
ORDER BY a.id LIMIT 5000""",
    "anno", "seg",
)
def frozen_box_query(t: Tables) -> DataFrame:
    """Freeze at a time, then box, list, projection with supervoxels, nanometres, limit."""
    frozen = Table("frozen", versions.freeze_merged(t.anno, t.seg, ts("1998-12-31 00:00:00")), RESOLUTION)
    roots = [200001, 200002, 200003, 200005, 200008, 200010, 200013, 100020, 100021]
    spec = q.QuerySpec(
        filters={"frozen": {"box": {"pre_pt_position": BOX}, "in": {"post_pt_root_id": roots}}},
        select={"frozen": ["id", "pre_pt_root_id", "pre_pt_position"]},
        resolution=(1.0, 1.0, 1.0),
        limit=5000,
    )
    return q.run({"frozen": frozen}, spec).df


_COMPARED = (
    ("eq", "equal", "tag", "'1-URGENT'", "1-URGENT"),
    ("gt", "greater", "size", "200000.0", 200000.0),
    ("lt", "less", "size", "50000.0", 50000.0),
    ("ge", "greater_equal", "id", "5000", 5000),
    ("le", "less_equal", "id", "5000", 5000),
)
_SIGN = {"eq": "=", "gt": ">", "lt": "<", "ge": ">=", "le": "<="}
for _short, _kind, _column, _said, _value in _COMPARED:

    def _one(t: Tables, kind: str = _kind, column: str = _column, value: object = _value) -> DataFrame:
        return filters.compare(t.anno, kind, column, value).select("id", "tag")

    _one.__name__ = f"filter_{_short}"
    query(f"SELECT id, tag FROM anno WHERE {_column} {_SIGN[_short]} {_said}", "anno")(_one)


@query("SELECT id, tag FROM anno WHERE tag IN ('1-URGENT', '2-HIGH')", "anno")
def filter_in(t: Tables) -> DataFrame:
    return filters.is_in(t.anno, "tag", ["1-URGENT", "2-HIGH"]).select("id", "tag")


@query("SELECT id, pre_pt_root_id FROM seg WHERE pre_pt_root_id % 3 = 0 AND pre_pt_root_id BETWEEN 100000 AND 110000", "seg")
def filter_in_long_list(t: Tables) -> DataFrame:
    """A list beyond the literals' bound: a semi-join."""
    wanted = [i for i in range(100_000, 110_001) if i % 3 == 0]
    return filters.is_in(t.seg, "pre_pt_root_id", wanted).select("id", "pre_pt_root_id")


@query("SELECT id, pre_pt_root_id FROM seg WHERE pre_pt_root_id NOT IN (0, 200001, 200002)", "seg")
def filter_notin(t: Tables) -> DataFrame:
    return filters.not_in(t.seg, "pre_pt_root_id", [0, 200001, 200002]).select("id", "pre_pt_root_id")


@query("SELECT id, tag FROM anno WHERE regexp_matches(tag, 'U.*T|LOW$')", "anno")
def filter_regex(t: Tables) -> DataFrame:
    return filters.matches(t.anno, "tag", "U.*T|LOW$").select("id", "tag")


@query(
    "SELECT id FROM anno WHERE pre_pt_position_x BETWEEN 10000 AND 60000 AND pre_pt_position_y BETWEEN 10000 AND 60000 AND pre_pt_position_z BETWEEN 100 AND 3000",
    "anno",
)
def filter_box(t: Tables) -> DataFrame:
    return filters.box(t.anno, "pre_pt_position", *BOX).select("id")


@query(
    "SELECT id FROM anno WHERE (created > TIMESTAMP '1997-01-01 00:00:00' AND created <= TIMESTAMP '1998-06-01 00:00:00') OR (deleted > TIMESTAMP '1997-01-01 00:00:00' AND deleted <= TIMESTAMP '1998-06-01 00:00:00')",
    "anno",
)
def crud_delta(t: Tables) -> DataFrame:
    return filters.edited_between(t.anno, ts("1997-01-01 00:00:00"), ts("1998-06-01 00:00:00")).select("id")


@query("SELECT id FROM anno WHERE valid", "anno")
def filter_valid(t: Tables) -> DataFrame:
    return filters.valid(t.anno).select("id")


@query("SELECT id FROM anno WHERE id >= 1000 AND id < 3000", "anno")
def filter_id_range(t: Tables) -> DataFrame:
    return filters.id_range(t.anno, 1000, 3000).select("id")


@query("SELECT id FROM seg WHERE pre_pt_root_id IS NULL OR post_pt_root_id IS NULL", "seg")
def filter_any_root_missing(t: Tables) -> DataFrame:
    return filters.any_root_missing(t.seg, ROOTS).select("id")


@query("SELECT id FROM seg WHERE (pre_pt_root_id IS NULL OR pre_pt_root_id = 0) AND (post_pt_root_id IS NULL OR post_pt_root_id = 0)", "seg")
def filter_all_roots_missing(t: Tables) -> DataFrame:
    return filters.all_roots_missing(t.seg, ROOTS).select("id")


@query("SELECT id FROM seg WHERE pre_pt_root_id IN (200001, 100021) OR post_pt_root_id IN (200001, 100021)", "seg")
def filter_with_roots(t: Tables) -> DataFrame:
    return filters.with_roots(t.seg, ROOTS, [200001, 100021]).select("id")


@query("SELECT id, pre_pt_root_id FROM seg WHERE pre_pt_root_id <> 0", "seg")
def filter_zero_root(t: Tables) -> DataFrame:
    return filters.without_zero(t.seg, "pre_pt_root_id").select("id", "pre_pt_root_id")


@query(
    """SELECT a.id, (SELECT count(*) FROM anno a2 LEFT JOIN seg s2 USING (id) WHERE s2.id IS NULL) AS n_missing
FROM anno a JOIN seg s USING (id) WHERE s.pre_pt_supervoxel_id <> 1""",
    "anno", "seg",
)
def filter_missing_lookup(t: Tables) -> DataFrame:
    """Rows without a lookup carry the sentinel 1; they are dropped and counted."""
    both = projections.with_sentinel(q.flat(t.anno, t.seg), ["pre_pt_supervoxel_id"])
    kept, lost = filters.without_lookup(both, ["pre_pt_supervoxel_id"])
    return kept.select("id").crossJoin(F.broadcast(lost))  # one row


@query(
    """SELECT id, tag FROM (SELECT a.id, a.tag, s.pre_pt_root_id FROM anno a JOIN seg s USING (id) WHERE s.pre_pt_root_id IN (200001, 200002, 200003))
WHERE tag <> '5-LOW' AND pre_pt_root_id IN (200002, 200003)""",
    "anno", "seg",
)
def post_combination_filter(t: Tables) -> DataFrame:
    """The same predicates on a combined result."""
    rows = filters.apply(_flat(t), {"in": {"pre_pt_root_id": [200001, 200002, 200003]}})
    return filters.apply(rows, {"notin": {"tag": ["5-LOW"]}, "in": {"pre_pt_root_id": [200002, 200003]}}).select("id", "tag")


_DIGEST = "md5('POINT Z (' || pre_pt_position_x || ' ' || pre_pt_position_y || ' ' || pre_pt_position_z || ')')"
_VALUE = f"(1000*ascii({_DIGEST}[1]) + 100*ascii({_DIGEST}[2]) + 10*ascii({_DIGEST}[3]) + ascii({_DIGEST}[4]))"


@query(f"SELECT id FROM anno WHERE {_VALUE} % 7 = 0", "anno")
def hash_sample(t: Tables) -> DataFrame:
    return filters.hash_sampled(t.anno, "pre_pt_position", 7).select("id")


@query(
    f"SELECT id FROM anno, (SELECT greatest(2, CAST(floor(count(*) / 2000.0) AS INT)) AS factor, 2000 * 100.0 / count(*) AS pct FROM anno) WHERE pct >= 100 OR {_VALUE} % factor = 0",
    "anno",
)
def sampling_policy(t: Tables) -> DataFrame:
    """The policy's choice at 2000 points of a whole table, by its count."""
    rows = t.anno.count()
    kind, x = filters.sampling(rows, 2000)
    df = t.anno if kind == "none" else filters.hash_sampled(t.anno, "pre_pt_position", filters.sample_factor(rows, 2000))
    return df.select("id")


@query(
    """SELECT a.id, s.pre_pt_root_id FROM anno a LEFT JOIN seg s USING (id), (SELECT count(*) AS n FROM anno)
WHERE n <= 1000 OR CAST('0x' || substr(md5('42:' || a.id), 1, 8) AS BIGINT) < CAST(floor(1000 * CAST(100 AS DOUBLE) / n / 100 * 4294967296) AS BIGINT)""",
    "anno", "seg",
)
def pct_sample(t: Tables) -> DataFrame:
    """About 1000 rows of the annotation table, sampled below the join with segmentation."""
    some = filters.percent_sampled(t.anno, 1000, t.anno.count())
    return some.join(t.seg, "id", "left").select("id", "pre_pt_root_id")


@query(
    "SELECT a.id, a.valid, s.pre_pt_root_id, s.post_pt_root_id, a.pre_pt_position_x FROM anno a LEFT JOIN seg s USING (id) WHERE a.valid",
    "anno", "seg",
)
def split_left_join(t: Tables) -> DataFrame:
    """Split scan: annotations with what segmentation there is."""
    return filters.valid(q.flat(t.anno, t.seg)).select("id", "valid", *ROOTS, "pre_pt_position_x")


@query("SELECT a.id, a.tag, s.pre_pt_root_id FROM anno a JOIN seg s USING (id) WHERE a.valid AND a.created <= TIMESTAMP '1998-12-31 00:00:00'", "anno", "seg")
def flat_scan(t: Tables) -> DataFrame:
    """A merged table, written and read by name."""
    return written(versions.freeze_merged(t.anno, t.seg, ts("1998-12-31 00:00:00")), "flat").select("id", "tag", "pre_pt_root_id")


@query("SELECT tag, count(*) AS n, CAST(sum(pre_pt_position_x) AS BIGINT) AS sum_x FROM anno WHERE valid GROUP BY tag HAVING count(*) > 10", "anno")
def view_scan(t: Tables) -> DataFrame:
    """A view with its own resolution, filtered and limited as a table is."""
    made = q.Views()
    made.add("by_tag", lambda anno: anno.where("valid").groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.sum("pre_pt_position_x").alias("sum_x")), (1.0, 1.0, 1.0))
    spec = q.QuerySpec(filters={"by_tag": {"greater": {"n": 10}}}, order=None)
    return q.run({"by_tag": made.table("by_tag", t.anno)}, spec).df


@query("SELECT id, (pre_pt_position_x // 2) * 8.0 AS pre_pt_position_x, (pre_pt_position_y // 2) * 8.0 AS pre_pt_position_y, pre_pt_position_z * 40.0 AS pre_pt_position_z FROM anno WHERE valid", "anno")
def view_positions(t: Tables) -> DataFrame:
    """Positions of a view in its own units, given in nanometres."""
    made = q.Views()
    halved = ["id", "CAST(pre_pt_position_x DIV 2 AS INT) AS pre_pt_position_x", "CAST(pre_pt_position_y DIV 2 AS INT) AS pre_pt_position_y", "pre_pt_position_z"]
    made.add("halved", lambda anno: filters.valid(anno).selectExpr(*halved), (8.0, 8.0, 40.0))
    return q.run({"halved": made.table("halved", t.anno)}, q.QuerySpec(resolution=(1.0, 1.0, 1.0))).df


@query(
    """SELECT pre_pt_root_id, count(*) AS n, min(pre_pt_position_x) * 4.0 AS low_position_x, min(pre_pt_position_y) * 4.0 AS low_position_y, min(pre_pt_position_z) * 40.0 AS low_position_z,
 'objects in force only' AS notice FROM anno JOIN seg USING (id) WHERE valid AND pre_pt_root_id > 0 GROUP BY 1 HAVING count(*) > 10""",
    "anno", "seg",
)
def kept_view(t: Tables) -> DataFrame:
    """A view saved twice, asked by name in another session with its own units and notice."""
    path = shared_dir(t.spark, "views")
    low = ", ".join(f"min(pre_pt_position_{a}) AS low_position_{a}" for a in "xyz")
    text = f"SELECT pre_pt_root_id, count(*) AS n, {low} FROM {{anno}} JOIN {{seg}} USING (id) WHERE %s GROUP BY 1"
    views.save(t.spark, path, "objects", text % "true", (1.0, 1.0, 1.0))
    views.save(t.spark, path, "objects", text % "valid AND pre_pt_root_id > 0", RESOLUTION, "objects in force only")
    other = Tables(t.spark.newSession(), t.dir)
    view = views.table(other.spark, path, "objects", {"anno": other.anno, "seg": other.seg})
    found = q.run({"objects": view}, q.QuerySpec(filters={"objects": {"greater": {"n": 10}}}, resolution=(1.0, 1.0, 1.0), order=None))
    return found.df.withColumn("notice", F.lit("; ".join(found.warnings)))


@query(
    """SELECT count(*) AS n, CASE WHEN count(*) = 50 THEN 'limit 1000 is above the cap of 50 rows; limited to 50 rows' ELSE 'limit 1000 is above the cap of 50 rows' END AS warnings
FROM (SELECT id FROM anno WHERE valid LIMIT 50)""",
    "anno",
)
def capped_query(t: Tables) -> DataFrame:
    """A cap that is asked for holds whatever the limit, and the user is told as the rows are read."""
    found = q.run({"anno": _anno(t)}, q.QuerySpec(select={"anno": ["id"]}, limit=1000, cap=50))
    rows = written(found.df, "capped")
    return rows.agg(F.count(F.lit(1)).alias("n")).withColumn("warnings", F.lit("; ".join(found.told())))


@query("SELECT a.* EXCLUDE (created, deleted, superceded_id, size), s.* EXCLUDE (id) FROM anno a JOIN seg s USING (id)", "anno", "seg")
def dropped_column_scan(t: Tables) -> DataFrame:
    """Export scan without a list of columns, unknown names among them."""
    return q.export_limited(t.anno, t.seg, None, (*projections.HIDDEN, "size", "no_such_column"))


@query("SELECT a.id, s.pre_pt_supervoxel_id FROM (SELECT id FROM anno ORDER BY id LIMIT 1000) a JOIN seg s USING (id)", "anno", "seg")
def limited_export_scan(t: Tables) -> DataFrame:
    """The limit stands below the join."""
    return q.export_limited(t.anno, t.seg, 1000).select("id", "pre_pt_supervoxel_id")


@query("SELECT id, pre_pt_root_id, pre_pt_supervoxel_id FROM seg", "seg")
def select_with_supervoxel(t: Tables) -> DataFrame:
    """A root brings its supervoxel."""
    spec = q.QuerySpec(select={"seg": ["id", "pre_pt_root_id"]})
    return q.run({"seg": Table("seg", t.seg)}, spec).df


@query("SELECT id, target_id, label FROM ref", "ref")
def select_all(t: Tables) -> DataFrame:
    """All columns but edit columns."""
    return q.run({"ref": Table("ref", t.ref)}, q.QuerySpec()).df


@query(
    """SELECT a.id AS id_a, r.id AS id_r, a.tag, r.label, a.pre_pt_position_x, a.pre_pt_position_y, a.pre_pt_position_z
FROM anno a JOIN ref r ON r.target_id = a.id WHERE a.valid AND r.valid AND a.size > 100000.0""",
    "anno", "ref",
)
def user_join_suffix(t: Tables) -> DataFrame:
    """Two tables with filters, columns and suffixes of their own."""
    spec = q.QuerySpec(
        joins=(("anno", "id", "ref", "target_id", "inner"),),
        filters={"anno": {"greater": {"size": 100000.0}}},
        select={"anno": ["id", "tag", "pre_pt_position"], "ref": ["id", "label"]},
        suffixes={"anno": "_a", "ref": "_r"},
    )
    return q.run({"anno": _anno(t), "ref": Table("ref", t.ref)}, spec).df


@query(
    """SELECT a.id AS idx, s.id AS idy, r.id AS idz, r.label, s.post_pt_root_id, s.post_pt_supervoxel_id FROM anno a LEFT JOIN seg s ON a.id = s.id JOIN ref r ON r.target_id = a.id
WHERE a.valid""",
    "anno", "seg", "ref",
)
def chained_join(t: Tables) -> DataFrame:
    """Three tables, an outer join among them, with the default suffixes."""
    spec = q.QuerySpec(
        joins=(("anno", "id", "seg", "id", "left"), ("anno", "id", "ref", "target_id", "inner")),
        select={"anno": ["id"], "seg": ["id", "post_pt_root_id"], "ref": ["id", "label"]},
    )
    return q.run({"anno": _anno(t), "seg": Table("seg", t.seg), "ref": Table("ref", t.ref)}, spec).df


@query("SELECT r.id, r.label, a.id AS id_ref, a.tag FROM ref r JOIN anno a ON r.target_id = a.id", "ref", "anno")
def reference_join(t: Tables) -> DataFrame:
    """A reference table with its targets; suffixes "" and "_ref" (J4)."""
    spec = q.QuerySpec(
        joins=(("ref", "target_id", "anno", "id", "inner"),), select={"ref": ["id", "label"], "anno": ["id", "tag"]}, suffixes={"ref": "", "anno": "_ref"}, valid_only=False
    )
    return q.run({"ref": Table("ref", t.ref), "anno": _anno(t)}, spec).df


@query("SELECT id, pre_pt_position_x * 4.0 / 8.0 AS pre_pt_position_x, pre_pt_position_y * 4.0 / 8.0 AS pre_pt_position_y, pre_pt_position_z * 1.0 AS pre_pt_position_z FROM anno WHERE valid", "anno")
def rescale_positions(t: Tables) -> DataFrame:
    """Positions in other units."""
    spec = q.QuerySpec(select={"anno": ["id", "pre_pt_position"]}, resolution=(8.0, 8.0, 40.0))
    return q.run({"anno": _anno(t)}, spec).df


@query(
    "SELECT a.id, coalesce(s.pre_pt_root_id, 1) AS pre_pt_root_id, coalesce(s.pre_pt_supervoxel_id, 1) AS pre_pt_supervoxel_id FROM anno a LEFT JOIN seg s USING (id) WHERE a.valid",
    "anno", "seg",
)
def missing_lookup_sentinel(t: Tables) -> DataFrame:
    """Split mode: what is not looked up is 1."""
    spec = q.QuerySpec(joins=(("anno", "id", "seg", "id", "left"),), select={"anno": ["id"], "seg": ["pre_pt_root_id"]}, sentinel=True)
    return q.run({"anno": _anno(t), "seg": Table("seg", t.seg)}, spec).df


@query("SELECT id, pre_pt_position_x + pre_pt_position_y + pre_pt_position_z AS total, 3 AS n FROM anno WHERE valid", "anno")
def positions_as_arrays(t: Tables) -> DataFrame:
    """Three columns as one array (P8); summed here to be compared."""
    df = q.run({"anno": _anno(t)}, q.QuerySpec(select={"anno": ["id", "pre_pt_position"]}, arrays=True)).df
    total = F.aggregate("pre_pt_position", F.lit(0), lambda a, x: a + x)
    return df.select("id", total.alias("total"), F.size("pre_pt_position").alias("n"))


@query("SELECT id, CASE WHEN id % 13 <> 0 THEN pre_pt_position_x END AS pt_x, CASE WHEN id % 13 <> 0 THEN pre_pt_position_y END AS pt_y, CASE WHEN id % 13 <> 0 THEN pre_pt_position_z END AS pt_z FROM anno", "anno")
def geometry_decode(t: Tables) -> DataFrame:
    """Binary points to integer columns, nulls kept."""
    wkb = scalar.point_wkb(*[F.col(f"pre_pt_position_{a}") for a in "xyz"])
    return projections.from_wkb(t.anno.select("id", F.when(F.col("id") % 13 != 0, wkb).alias("pt")), ["pt"])


@query("SELECT id, CAST(id AS BIGINT) AS whole, CAST(id / 4.0 AS DOUBLE) AS part FROM anno", "anno")
def decimal_narrowing(t: Tables) -> DataFrame:
    """Decimals as integers if all are whole (P10)."""
    df = t.anno.selectExpr("id", "CAST(id AS DECIMAL(20,2)) AS whole", "CAST(id / 4.0 AS DECIMAL(20,2)) AS part")
    return projections.narrowed(df, ["whole", "part"])


@query("SELECT id, valid AS flag, year(created) AS y, month(created) AS m FROM anno", "anno")
def text_decode(t: Tables) -> DataFrame:
    """"t" as true, times in several text forms as UTC."""
    form = F.when(F.col("id") % 3 == 0, F.date_format("created", "yyyy-MM-dd")).when(F.col("id") % 3 == 1, F.date_format("created", "yyyy-MM-dd HH:mm:ss"))
    text = F.coalesce(form, F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss"))
    df = t.anno.select("id", F.when(F.col("valid"), "t").otherwise("f").alias("v"), text.alias("c"))
    when = scalar.parse_time(F.col("c"))
    return df.select("id", scalar.parse_bool(F.col("v")).alias("flag"), F.year(when).alias("y"), F.month(when).alias("m"))


@query("SELECT id, tag, CAST(id % 100 AS INT) AS small FROM anno", "anno")
def normalised_types(t: Tables) -> DataFrame:
    """All-null columns leave, short integers grow."""
    df = t.anno.select("id", "tag", F.lit(None).cast("string").alias("nothing"), (F.col("id") % 100).cast("smallint").alias("small"))
    return projections.typed(df)


@query("SELECT c AS column_name, n = 0 AS all_null FROM (SELECT 'deleted' AS c, count(deleted) AS n FROM anno UNION ALL SELECT 'id', count(id) FROM anno UNION ALL SELECT 'none', 0)", "anno")
def null_profile(t: Tables) -> DataFrame:
    return projections.null_profile(t.anno.select("id", "deleted", F.lit(None).cast("int").alias("none")))


@query("SELECT id, coalesce(pre_pt_root_id, 0) AS pre_pt_root_id, CAST(0 AS BIGINT) AS ctr_pt_root_id FROM seg", "seg")
def schema_alignment(t: Tables) -> DataFrame:
    """Missing columns and nulls as 0, in the target's order."""
    return projections.aligned(t.seg, ["id", "pre_pt_root_id", "ctr_pt_root_id"])


@query("SELECT a.id, a.valid, a.tag, s.pre_pt_root_id FROM anno a JOIN seg s USING (id)", "anno", "seg")
def merged_column_order(t: Tables) -> DataFrame:
    """Schema order, as far as there are columns."""
    return projections.ordered(_flat(t), ["id", "valid", "absent", "tag", "pre_pt_root_id"])


@query("SELECT id, tag FROM anno WHERE valid ORDER BY id LIMIT 100 OFFSET 50", "anno")
def offset_limit(t: Tables) -> DataFrame:
    """Offset and a limit above its cap, in id order."""
    spec = q.QuerySpec(select={"anno": ["id", "tag"]}, offset=50, limit=1000, cap=100)
    return q.run({"anno": _anno(t)}, spec).df


@query("SELECT count(*) AS count FROM anno a JOIN seg s USING (id) WHERE a.valid AND s.post_pt_root_id IN (200001, 200002)", "anno", "seg")
def count_query(t: Tables) -> DataFrame:
    """Count instead of rows (A1)."""
    spec = q.QuerySpec(joins=(("anno", "id", "seg", "id", "inner"),), filters={"seg": {"in": {"post_pt_root_id": [200001, 200002]}}}, select={"anno": ["id"]}, count=True, limit=10)
    return q.run({"anno": _anno(t), "seg": Table("seg", t.seg)}, spec).df


@query("SELECT o_orderkey AS id, true AS valid, o_orderpriority AS tag, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST((o_orderkey * 7919) % 100000 AS INT) END AS pre_pt_position_x, CAST(o_orderkey % 500 AS INT) AS post_pt_position_y FROM orders WHERE o_orderkey % 10 <> 0")
def csv_ingest(t: Tables) -> DataFrame:
    """Orders as text files, then annotations by a mapping; rows without a point leave."""
    path = shared_dir(t.spark, "csv")
    raw = t.orders.select(
        F.col("o_orderkey").alias("key"),
        F.when(F.col("o_orderkey") % 10 == 0, "[1, x, 3]").otherwise(F.format_string("[%d, %d, %d]", F.col("o_orderkey") * 7919 % 100000, F.lit(2), F.lit(3))).alias("pre"),
        F.lit(1).alias("px"), (F.col("o_orderkey") % 500).alias("py"), F.lit(3).alias("pz"),
        F.col("o_orderpriority").alias("prio"), F.col("o_totalprice").alias("price"), F.lit("x").alias("junk"),
    )
    raw.write.csv(path, header=True)
    texts = ", ".join(f"{c} string" for c in ("key", "pre", "px", "py", "pz", "label", "price", "junk"))
    mapping = {"id": "key", "pre_pt_position": "pre", "post_pt_position": ["px", "py", "pz"], "tag": "label", "size": "price"}
    rows = csv.ingest(csv.read(t.spark, path), SYNAPSE, mapping, "2000-01-01 00:00:00", ignore=("junk",), transform=lambda df: csv.by_chunks(df, lambda rows: rows.rename(columns={"prio": "label"}), texts))
    whole, _ = csv.with_points(rows, SYNAPSE)
    return whole.select("id", "valid", "tag", "pre_pt_position_x", "post_pt_position_y")


@query("SELECT id, tag, CAST(pre_pt_position_x AS INT) AS pre_pt_position_x, valid FROM anno", "anno")
def csv_dump(t: Tables) -> DataFrame:
    """Compressed dump with types beside it, read back."""
    path = shared_dir(t.spark, "dump")
    csv.dump(t.anno.select("id", "tag", "pre_pt_position_x", "valid"), path)
    return csv.undump(t.spark, path)
