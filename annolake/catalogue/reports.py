"""Counts, labels, cells and packed blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates
from ..plans import report
from .base import Tables, query

POINT = "pre_pt_position"
_DIGEST = "md5('POINT Z (' || pre_pt_position_x || ' ' || pre_pt_position_y || ' ' || pre_pt_position_z || ')')"
_VALUE = f"(1000*ascii({_DIGEST}[1]) + 100*ascii({_DIGEST}[2]) + 10*ascii({_DIGEST}[3]) + ascii({_DIGEST}[4]))"


@query("SELECT p_type AS tag, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, tag LIMIT 100")
def category_top(t: Tables) -> DataFrame:
    """The hundred most frequent categories."""
    return aggregates.category_counts(t.part.selectExpr("p_type AS tag"), "tag")


@query("SELECT count(*) AS total, count(*) FILTER (pre_pt_root_id = post_pt_root_id AND pre_pt_root_id <> 0) AS self_pairs, count(*) FILTER (pre_pt_root_id = 0 OR post_pt_root_id = 0) AS with_zero FROM seg", "seg")
def pair_report(t: Tables) -> DataFrame:
    return aggregates.pair_report(t.seg, "pre_pt_root_id", "post_pt_root_id")


@query("SELECT 'tag' AS column_name, tag AS value FROM anno UNION SELECT 'status', o_orderstatus FROM orders", "anno")
def unique_strings(t: Tables) -> DataFrame:
    """Distinct values of each text column in one pass."""
    return aggregates.unique_strings(t.orders.selectExpr("o_orderkey", "o_orderpriority AS tag", "o_orderstatus AS status"))


@query("SELECT id, CASE WHEN tag IN ('1-URGENT') THEN 'tag:' || tag ELSE tag END AS tag, CASE WHEN id % 2 = 0 THEN 'kind:1-URGENT' ELSE 'other' END AS kind FROM anno", "anno")
def duplicate_labels(t: Tables) -> DataFrame:
    """Values of several tag columns are told apart by their column."""
    df = t.anno.select("id", "tag", F.when(F.col("id") % 2 == 0, "1-URGENT").otherwise("other").alias("kind"))
    return aggregates.labelled_duplicates(df, ["tag", "kind"])


@query("SELECT id, tag, CAST(dense_rank() OVER (ORDER BY tag) - 1 AS INT) AS tag_code FROM anno", "anno")
def enum_codes(t: Tables) -> DataFrame:
    """Texts as places in their sorted distinct values (X11)."""
    return report.coded(t.anno.select("id", "tag"), ["tag"])


@query("SELECT a.id, s.pre_pt_root_id AS root_id, a.tag, a.size > 100000.0 AS large, a.tag || ' ' || a.id AS label FROM anno a JOIN seg s USING (id) WHERE s.pre_pt_root_id <> 0", "anno", "seg")
def segment_properties(t: Tables) -> DataFrame:
    """One row an annotation with an object."""
    df = t.anno.join(t.seg, "id").withColumn("large", F.col("size") > 100000.0)
    return report.segment_properties(df, "pre_pt_root_id", ["tag"], ["large"], "%s %s", F.col("tag"), F.col("id"))


_BOX = ((0, 0, 0), (100_000, 80_000, 4_000))


@query(
    f"""SELECT level, CAST(least(g - 1, floor(pre_pt_position_x * g / 100000.0)) AS INT) AS cx, CAST(least(h - 1, floor(pre_pt_position_y * h / 80000.0)) AS INT) AS cy, 0 AS cz, count(*) AS n
FROM anno, (VALUES (0, 1, 1), (1, 2, 2), (2, 4, 4)) v(level, g, h), (SELECT count(*) AS total FROM anno)
WHERE total / (g * h) <= 500 OR {_VALUE} % greatest(2, CAST(floor((total / (g * h)) / 500) AS INT)) = 0 GROUP BY ALL""",
    "anno",
)
def level_cells(t: Tables) -> DataFrame:
    """Cells of all levels of a pyramid in one job (V2, V1)."""
    rows = t.anno.count()
    cells = report.pyramid(t.anno, POINT, _BOX, [(1, 1, 1), (2, 2, 1), (4, 4, 1)], 500, rows)
    return cells.groupBy("level", "cx", "cy", "cz").agg(F.count(F.lit(1)).alias("n"))


def _levels_sql(grids: list[tuple[int, int]]) -> str:
    """Levels as a chain of tables: each ranks what the one before left over."""
    parts = ["most AS (SELECT count(*) // 40 + 1 AS m FROM anno)", "r0 AS (SELECT id, pre_pt_position_x AS x, pre_pt_position_y AS y, CAST('0x' || substr(md5('0:' || id), 1, 8) AS BIGINT) AS v FROM anno)"]
    for k, (g, h) in enumerate(grids):
        cell = f"CAST(least({g - 1}, floor(x * {g} / 100000.0)) AS INT) AS cx, CAST(least({h - 1}, floor(y * {h} / 80000.0)) AS INT) AS cy"
        parts.append(f"l{k} AS (SELECT *, row_number() OVER (PARTITION BY cx, cy ORDER BY v, id) AS place FROM (SELECT *, {cell} FROM r{k}))")
        parts.append(f"r{k + 1} AS (SELECT id, x, y, v FROM l{k}, most WHERE place > m)")
    rows = " UNION ALL ".join(f"SELECT {k} AS level, cx, cy, 0 AS cz, id FROM l{k}, most WHERE place <= m" for k in range(len(grids)))
    return ", " + ", ".join(parts) + " " + rows


@query(_levels_sql([(1, 1), (2, 2), (4, 4), (8, 8), (16, 16), (32, 32)]), "anno")
def spread_levels(t: Tables) -> DataFrame:
    """Every row on one level of a pyramid whose cells hold their limit, here a fortieth of the table (V2)."""
    return report.spread_levels(t.anno, POINT, _BOX, t.anno.count() // 40 + 1)


@query(
    f"SELECT id FROM anno, (SELECT count(*) AS total FROM anno) WHERE pre_pt_position_x < 50000 AND pre_pt_position_y < 40000 AND pre_pt_position_z < 4000 AND (greatest(100, total // 40) * 100.0 / (total * 0.25) >= 100 OR {_VALUE} % greatest(2, CAST(floor(CAST(floor(total * 0.25) AS INT) / CAST(greatest(100, total // 40) AS DOUBLE)) AS INT)) = 0)",
    "anno",
)
def cell_cutout(t: Tables) -> DataFrame:
    """One cell, thinned by the policy (V2, F20); the hash branch at every size here."""
    rows = t.anno.count()
    # as many points as keep the policy at its digest branch, whatever the table's size
    return report.cutout(t.anno, POINT, (0, 0, 0), (50_000, 40_000, 4_000), rows, max(100, rows // 40), 0.25).select("id")


@query(
    """SELECT id FROM anno, (SELECT count(*) AS total FROM anno) WHERE pre_pt_position_x < 50000 AND pre_pt_position_y < 40000 AND pre_pt_position_z < 4000
 AND CAST('0x' || substr(md5('42:' || id), 1, 8) AS BIGINT) < CAST(floor(CAST(total // 100 AS INT) * CAST(100 AS DOUBLE) / (total * CAST(0.25 AS DOUBLE)) / 100 * 4294967296) AS BIGINT)""",
    "anno",
)
def thinned_cutout(t: Tables) -> DataFrame:
    """One cell of which a small share is shown (V2, F20): the policy's percent branch, a hundredth of the table's rows."""
    rows = t.anno.count()
    return report.cutout(t.anno, POINT, (0, 0, 0), (50_000, 40_000, 4_000), rows, rows // 100, 0.25).select("id")


@query("SELECT a.id, a.tag, r.id AS id_ref, r.label FROM anno a JOIN ref r ON r.target_id = a.id WHERE a.id IN (4, 8, 12, 400, 404)", "anno", "ref")
def by_id(t: Tables) -> DataFrame:
    """Rows by id with what refers to them (V3)."""
    return report.by_id(t.anno, [4, 8, 12, 400, 404], t.ref).select("id", "tag", "id_ref", "label")


@query("SELECT post_pt_root_id AS root_id, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM seg WHERE post_pt_root_id >= 200000 GROUP BY 1", "seg")
def by_relationship(t: Tables) -> DataFrame:
    """Rows that touch each object (V4)."""
    objects = t.lineage.where("root_id >= 200000").select("root_id").distinct()
    found = report.by_relationship(t.seg, "post_pt_root_id", objects)
    return found.groupBy("root_id").agg(F.sum("n").alias("n"), F.min(F.element_at("ids", 1)).alias("first_id"), F.max(F.element_at("ids", -1)).alias("last_id"))


@query(
    """SELECT 'geometry' AS kind, 'LINE' AS name, count(*) AS n, count(pre_pt_position_x) AS n_values FROM anno
UNION ALL SELECT 'relationship', 'pre_pt_root_id', count(s.pre_pt_root_id), count(DISTINCT s.pre_pt_root_id) FROM anno LEFT JOIN seg s USING (id)
UNION ALL SELECT 'relationship', 'post_pt_root_id', count(s.post_pt_root_id), count(DISTINCT s.post_pt_root_id) FROM anno LEFT JOIN seg s USING (id)
UNION ALL SELECT 'enum', 'tag', count(tag), count(DISTINCT tag) FROM anno UNION ALL SELECT 'number', 'size', count(size), count(DISTINCT size) FROM anno""",
    "anno", "seg",
)
def property_discovery(t: Tables) -> DataFrame:
    """What a table gives a viewer, by its schema, with rows and distinct values of each (V5)."""
    df = t.anno.join(t.seg, "id", "left")
    found = report.discovered(df)
    named = [("relationship", c) for c in found["relationships"]] + [("enum", c) for c in found["enums"]] + [("number", c) for c in found["numbers"]]
    aggs = [F.count(c).alias(f"n{i}") for i, (_, c) in enumerate(named)] + [F.count_distinct(c).alias(f"d{i}") for i, (_, c) in enumerate(named)]
    one = df.agg(F.count(F.lit(1)).alias("n"), F.count(f"{found['points'][0]}_x").alias("d"), *aggs)
    rows = [F.struct(F.lit(k).alias("kind"), F.lit(c).alias("name"), F.col(f"n{i}").alias("n"), F.col(f"d{i}").alias("n_values")) for i, (k, c) in enumerate(named)]
    whole = F.struct(F.lit("geometry").alias("kind"), F.lit(found["geometry"]).alias("name"), F.col("n").alias("n"), F.col("d").alias("n_values"))
    return one.select(F.explode(F.array(whole, *rows)).alias("r")).select("r.*")


@query(
    f"""SELECT level, cx, cy, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * 36) AS BIGINT) AS bytes FROM (
 SELECT 0 AS level, CAST(least(1, floor(pre_pt_position_x * 2 / 100000.0)) AS INT) AS cx, CAST(least(1, floor(pre_pt_position_y * 2 / 80000.0)) AS INT) AS cy, count(*) AS n FROM anno GROUP BY ALL) GROUP BY ALL""",
    "anno",
)
def packed_blocks(t: Tables) -> DataFrame:
    """Packed annotation blocks: lengths by cell, without each block's count (V6); their bytes are tested."""
    rows = report.pyramid(t.anno, POINT, _BOX, [(2, 2, 1)], 1 << 40, t.anno.count())
    packed = report.packed_rows(rows.join(t.anno, "id"), [POINT, "post_pt_position"], ["size"])
    blocks = report.packed_blocks(packed)
    return blocks.groupBy("level", "cx", "cy").agg(F.sum("n").alias("n"), F.sum(F.length("data") - 8).alias("bytes"))
