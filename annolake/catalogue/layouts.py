"""Cut points, buckets, chunks, grids and lake layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import aggregates, layout, manifest
from ..sources import footers
from ..store import children, current, shared_dir, written
from .base import Tables, query, ts

POINT = "pre_pt_position"
_MORTON = "(" + " + ".join(f"(((CAST(pre_pt_position_{a} AS BIGINT) >> {i}) & 1) << {3 * i + k})" for i in range(17) for k, a in enumerate("xyz")) + ")"


@query(f"SELECT id, {_MORTON} AS code FROM anno", "anno")
def morton(t: Tables) -> DataFrame:
    """Morton codes of points (X1); the fixture's coordinates have 17 bits at most."""
    return t.anno.select("id", scalar.morton(*[F.col(f"{POINT}_{a}") for a in "xyz"]).alias("code"))


@query(
    "SELECT id, CAST(floor(pre_pt_position_x / 2.0) AS BIGINT) AS vx, CAST(floor((pre_pt_position_x * 4 / 4.0 - 128) / 512) AS BIGINT) AS chunk_x, 'POINTZ(' || pre_pt_position_x || ' ' || pre_pt_position_y || ' ' || pre_pt_position_z || ')' AS point, tag || ' #' || id AS label FROM anno",
    "anno",
)
def point_functions(t: Tables) -> DataFrame:
    """Scaled and chunked coordinates, point text, labels."""
    x, y, z = (F.col(f"{POINT}_{a}") for a in "xyz")
    return t.anno.select(
        "id", scalar.scaled(x, 2.0).alias("vx"), scalar.chunk_of(x * 4, 128, 4.0, 512).alias("chunk_x"), scalar.point_text(x, y, z).alias("point"),
        scalar.label("%s #%s", F.col("tag"), F.col("id")).alias("label"),
    )


@query("SELECT o_orderkey AS id, year(make_timestamp(CAST(o_orderkey AS BIGINT) * 86400 * 1000000)) AS y FROM orders")
def epoch_times(t: Tables) -> DataFrame:
    """Unix seconds as times."""
    return t.orders.select(F.col("o_orderkey").alias("id"), F.year(scalar.epoch(F.col("o_orderkey") * 86400)).alias("y"))


@query("SELECT id FROM anno WHERE pre_pt_position_x >= 10000 AND pre_pt_position_x < 50000 AND pre_pt_position_y >= 5000 AND pre_pt_position_y < 45000 AND pre_pt_position_z >= 100 AND pre_pt_position_z < 3100", "anno")
def box_in_nanometres(t: Tables) -> DataFrame:
    """A box in nm asked of voxels (X7), upper faces left out."""
    from ..operators import filters

    low, high, res = (40_000, 20_000, 4_000), (200_000, 180_000, 124_000), (4.0, 4.0, 40.0)
    return filters.half_open_box(t.anno, POINT, *[tuple(v / r for v, r in zip(b, res, strict=True)) for b in (low, high)]).select("id")


@query(
    """SELECT CAST(floor(least(min(pre_pt_position_x), min(post_pt_position_x)) / 512) * 512 AS BIGINT) AS min_x, CAST(ceil((greatest(max(pre_pt_position_x), max(post_pt_position_x)) + 1) / 512) * 512 AS BIGINT) AS max_x,
 CAST(floor(least(min(pre_pt_position_y), min(post_pt_position_y)) / 512) * 512 AS BIGINT) AS min_y, CAST(ceil((greatest(max(pre_pt_position_y), max(post_pt_position_y)) + 1) / 512) * 512 AS BIGINT) AS max_y,
 CAST(floor(least(min(pre_pt_position_z), min(post_pt_position_z)) / 512) * 512 AS BIGINT) AS min_z, CAST(ceil((greatest(max(pre_pt_position_z), max(post_pt_position_z)) + 1) / 512) * 512 AS BIGINT) AS max_z FROM anno""",
    "anno",
)
def extent_aligned(t: Tables) -> DataFrame:
    """Extent of all points in whole chunks."""
    return aggregates.extent(t.anno, 512)


@query(
    """SELECT CAST(floor(least(min(pre_pt_position_x), min(post_pt_position_x)) / 512) * 512 AS BIGINT) AS min_x, CAST(ceil((greatest(max(pre_pt_position_x), max(post_pt_position_x)) + 1) / 512) * 512 AS BIGINT) AS max_x,
 CAST(floor(least(min(pre_pt_position_y), min(post_pt_position_y)) / 512) * 512 AS BIGINT) AS min_y, CAST(ceil((greatest(max(pre_pt_position_y), max(post_pt_position_y)) + 1) / 512) * 512 AS BIGINT) AS max_y,
 CAST(floor(least(min(pre_pt_position_z), min(post_pt_position_z)) / 512) * 512 AS BIGINT) AS min_z, CAST(ceil((greatest(max(pre_pt_position_z), max(post_pt_position_z)) + 1) / 512) * 512 AS BIGINT) AS max_z FROM anno""",
    "anno",
)
def footer_extent(t: Tables) -> DataFrame:
    """The same of a stored table, from its files' footers."""
    root = shared_dir(t.spark, "lake")
    t.anno.write.parquet(root)
    row = footers.asked(t.spark, root, lambda df: aggregates.extent(df, 512))
    return t.spark.createDataFrame([row], ", ".join(f"{e}_{a} long" for a in "xyz" for e in ("min", "max")))


@query(
    """SELECT cx, cy, cz, count(*) AS n FROM (
 SELECT CAST(floor(pre_pt_position_x / 8192.0) AS BIGINT) AS cx, CAST(floor(pre_pt_position_y / 8192.0) AS BIGINT) AS cy, CAST(floor(pre_pt_position_z / 8192.0) AS BIGINT) AS cz FROM anno
 UNION ALL SELECT CAST(floor(post_pt_position_x / 8192.0) AS BIGINT), CAST(floor(post_pt_position_y / 8192.0) AS BIGINT), CAST(floor(post_pt_position_z / 8192.0) AS BIGINT) FROM anno) GROUP BY ALL""",
    "anno",
)
def populated_cells(t: Tables) -> DataFrame:
    return aggregates.populated_cells(t.anno, 8192)


@query(
    """SELECT (ix * ny + iy) * nz + iz AS cell, ix, iy, iz, lx + ix * 20000 AS low_x, ly + iy * 20000 AS low_y, lz + iz * 20000 AS low_z,
 least(hx, lx + (ix + 1) * 20000) AS high_x, least(hy, ly + (iy + 1) * 20000) AS high_y, least(hz, lz + (iz + 1) * 20000) AS high_z
FROM (SELECT CAST(min(pre_pt_position_x) AS BIGINT) AS lx, CAST(max(pre_pt_position_x) + 1 AS BIGINT) AS hx, CAST(min(pre_pt_position_y) AS BIGINT) AS ly, CAST(max(pre_pt_position_y) + 1 AS BIGINT) AS hy,
  CAST(min(pre_pt_position_z) AS BIGINT) AS lz, CAST(max(pre_pt_position_z) + 1 AS BIGINT) AS hz FROM anno) e,
 LATERAL (SELECT CAST(ceil((hx - lx) / 20000.0) AS BIGINT) AS nx, CAST(ceil((hy - ly) / 20000.0) AS BIGINT) AS ny, CAST(ceil((hz - lz) / 20000.0) AS BIGINT) AS nz) k,
 generate_series(0, 9) gx(ix), generate_series(0, 9) gy(iy), generate_series(0, 9) gz(iz) WHERE ix < nx AND iy < ny AND iz < nz""",
    "anno",
)
def grid_cells(t: Tables) -> DataFrame:
    """The regular grid over the table's extent."""
    return aggregates.grid_cells(t.anno.select("id", *[f"{POINT}_{a}" for a in "xyz"]), 20000)


@query(" UNION ALL ".join(f"SELECT {k} AS i, CAST(quantile_disc(id, {k / 4}) AS BIGINT) AS id_cut, CAST(quantile_disc(pre_pt_position_x, {k / 4}) AS BIGINT) AS x_cut FROM anno" for k in (1, 2, 3)), "anno")
def percentile_bounds(t: Tables) -> DataFrame:
    """Cut points of two columns by rank."""
    cuts = aggregates.discrete_cuts(t.anno, ["id", f"{POINT}_x"], 4)
    return t.spark.createDataFrame([(i + 1, a, b) for i, (a, b) in enumerate(zip(*cuts.values(), strict=True))], "i int, id_cut long, x_cut long")


_SHARE = "SELECT '{c}' AS column_name, {k} AS i, round((SELECT count(*) FROM anno WHERE {c} <= q.cut) / (SELECT count(*) FROM anno), 2) AS share FROM (SELECT quantile_disc({c}, {k} / 5) AS cut FROM anno) q"


@query(" UNION ALL ".join(_SHARE.format(c=c, k=k) for c in ("id", "pre_pt_position_x", "size") for k in (1, 2, 3, 4)), "anno")
def sketched_bounds(t: Tables) -> DataFrame:
    """Cut points of three columns from sketches of two parts of a table, put together: the share of rows up to
    each, which is within the sketches' error of the fifths asked for (A7, L3).
    """
    columns = ["id", f"{POINT}_x", "size"]
    parts = [aggregates.sketched(t.anno.where(x), columns) for x in ("valid", "NOT valid")]
    cuts = aggregates.sketched_cuts(aggregates.merged_sketches(parts[0].unionAll(parts[1])), 5).collect()  # a row a cut point
    upto = [(F.count_if(F.col(r["column_name"]) <= r["cut"]) / F.count(r["column_name"])) for r in cuts]
    each = [F.struct(F.lit(r["column_name"]).alias("column_name"), F.lit(r["i"]).alias("i"), F.round(x, 2).alias("share")) for r, x in zip(cuts, upto, strict=True)]
    return t.anno.agg(F.array(*each).alias("r")).select(F.explode("r").alias("r")).select("r.*")


@query(" UNION ALL ".join(f"SELECT {k} AS i, CAST(quantile_disc(o_totalprice, {k / 8}) AS DOUBLE) AS cut FROM orders" for k in range(1, 8)))
def lake_quantiles(t: Tables) -> DataFrame:
    """Nearest-rank quantiles of a column of an existing lake."""
    root = shared_dir(t.spark, "lake")
    layout.written_counting(t.orders.select("o_orderkey", "o_totalprice"), root)
    cuts = aggregates.discrete_cuts(t.spark.read.parquet(root), ["o_totalprice"], 8)["o_totalprice"]
    return t.spark.createDataFrame([(i, float(x)) for i, x in enumerate(cuts, 1)], "i int, cut double")


@query("SELECT k AS i, CAST(round(min(id) + (max(id) - min(id)) * k / 4.0, 6) AS DOUBLE) AS cut FROM anno, (VALUES (1), (2), (3)) v(k) GROUP BY k", "anno")
def uniform_bounds(t: Tables) -> DataFrame:
    """Evenly spaced cut points."""
    cuts = aggregates.uniform_cuts(t.anno, "id", 4)
    return t.spark.createDataFrame([(i + 1, round(x, 6)) for i, x in enumerate(cuts)], "i int, cut double")


def _code(of: str) -> str:
    return "(" + " + ".join(f"(((CAST({of}(pre_pt_position_{a}) AS BIGINT) >> {i}) & 1) << {3 * i + k})" for i in range(17) for k, a in enumerate("xyz")) + ")"


@query(f"SELECT k AS i, CAST(lo + (hi - lo) * k // 4 AS BIGINT) AS cut FROM (SELECT {_code('min')} AS lo, {_code('max')} AS hi FROM anno), (VALUES (1), (2), (3)) v(k)", "anno")
def morton_bounds(t: Tables) -> DataFrame:
    """Evenly spaced codes between those of the extent's corners."""
    return t.spark.createDataFrame(list(enumerate(aggregates.uniform_morton_cuts(t.anno, POINT, 4), 1)), "i int, cut long")


@query("SELECT id, CAST(id > 3750 AS INT) + CAST(id > 7500 AS INT) + CAST(id > 11250 AS INT) AS id_partition FROM anno", "anno")
def range_bucket(t: Tables) -> DataFrame:
    """Right-closed buckets (L1)."""
    return layout.bucketed(t.anno.select("id"), layout.Layout("id", "id", "range", 4), [3750, 7500, 11250])


@query("SELECT id, CAST(greatest(0, least(100, (id + 99) // 100 - 1)) AS INT) AS b FROM anno", "anno")
def range_bucket_many(t: Tables) -> DataFrame:
    """The same with a hundred cut points."""
    return t.anno.select("id", scalar.range_bucket(F.col("id"), [100 * i for i in range(1, 101)]).cast("int").alias("b"))


@query("SELECT id, CAST(CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8) AS BIGINT) % 8 AS INT) AS bucket, 0 AS one FROM anno", "anno")
def hash_bucket(t: Tables) -> DataFrame:
    """Hash buckets (L2): each row in one of eight, and in 0 of one."""
    return t.anno.select("id", scalar.hash_bucket(F.col("id"), 8).alias("bucket"), scalar.hash_bucket(F.col("id"), 1).alias("one"))


@query("SELECT id AS start, lead(id) OVER (ORDER BY id) AS \"end\" FROM (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM anno) WHERE rn % 1000 = 1", "anno")
def id_chunks(t: Tables) -> DataFrame:
    """Half-open id ranges of a thousand rows."""
    return aggregates.id_chunks(t.anno, 1000)


@query("SELECT id, CAST(ntile((SELECT count(*) // 500 FROM anno)) OVER (ORDER BY id) - 1 AS BIGINT) AS part FROM anno", "anno")
def even_split(t: Tables) -> DataFrame:
    """Ids dealt to parts of about five hundred."""
    return aggregates.even_split(t.anno, 500)


@query("SELECT 1000 + row_number() OVER (ORDER BY o_orderkey) AS id, o_orderkey FROM orders")
def sequential_ids(t: Tables) -> DataFrame:
    """Ids that continue from a counter."""
    return aggregates.numbered(t.orders.select("o_orderkey"), 1000, "o_orderkey").select("id", "o_orderkey")


@query("SELECT id FROM anno WHERE id > 5000 ORDER BY id LIMIT 500", "anno")
def keyset_page(t: Tables) -> DataFrame:
    """One page after a key."""
    return aggregates.page(t.anno.select("id"), 5000, 500)


@query("SELECT min(id) AS min_id, max(id) AS max_id, count(*) AS row_count FROM anno WHERE valid AND created <= TIMESTAMP '1998-12-31 00:00:00'", "anno")
def id_extent(t: Tables) -> DataFrame:
    return aggregates.id_extent(t.anno, ts("1998-12-31 00:00:00"))


@query("SELECT id, 'pre_pt' AS type, pre_pt_position_x AS x, pre_pt_position_y AS y, pre_pt_position_z AS z FROM anno UNION ALL SELECT id, 'post_pt', post_pt_position_x, post_pt_position_y, post_pt_position_z FROM anno", "anno")
def stacked_points(t: Tables) -> DataFrame:
    """All points one below another."""
    return aggregates.stacked_points(t.anno, [POINT, "post_pt_position"]).withColumn("type", F.concat("type", F.lit("_pt"))).withColumn("type", F.regexp_replace("type", "_pt_pt$", "_pt"))


_CUT = "(SELECT quantile_disc(id, 0.25) AS a, quantile_disc(id, 0.5) AS b, quantile_disc(id, 0.75) AS c FROM anno)"


@query(
    f"""SELECT 'id' AS layout, CAST(id > a AS INT) + CAST(id > b AS INT) + CAST(id > c AS INT) AS bucket, count(*) AS n FROM anno, {_CUT} GROUP BY ALL
UNION ALL SELECT 'x', CAST(pre_pt_position_x > 25000 AS INT) + CAST(pre_pt_position_x > 50000 AS INT), count(*) FROM anno GROUP BY ALL""",
    "anno",
)
def export_multi(t: Tables) -> DataFrame:
    """Two layouts of a table from one scan, read back by bucket."""
    root = shared_dir(t.spark, "lake")
    specs = [layout.Layout("id", "id", "range", 4), layout.Layout("x", f"{POINT}_x", "range", 3, bounds=(25000, 50000), bloom=True)]
    layout.export(t.anno, specs, root)
    out = None
    for s in specs:
        part = t.spark.read.parquet(f"{root}/{s.name}").groupBy(F.col(f"{s.column}_partition").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
        part = part.select(F.lit(s.name).alias("layout"), "bucket", "n")
        out = part if out is None else out.unionAll(part)
    return out


@query("SELECT a.id, s.pre_pt_root_id, (SELECT count(*) FROM anno JOIN seg USING (id)) AS counted FROM anno a JOIN seg s USING (id)", "anno", "seg")
def export_view(t: Tables) -> DataFrame:
    """A view run once to a flat copy, counted on the way, then clustered by Morton code."""
    root = shared_dir(t.spark, "lake")
    view = t.anno.join(t.seg, "id").select("id", *[f"{POINT}_{a}" for a in "xyz"], "pre_pt_root_id")
    n, _ = layout.export_view(view, [layout.Layout("m", POINT, "morton", 4)], root)
    return t.spark.read.parquet(f"{root}/m").select("id", "pre_pt_root_id", F.lit(n).cast("long").alias("counted"))


@query(
    """SELECT v.layout, a.id, a.tag, a.post_pt_position_x, s.post_pt_root_id FROM anno a JOIN seg s USING (id),
 (VALUES ('id'), ('pre_pt_root_id'), ('post_pt_root_id'), ('post_pt_position')) v(layout)""",
    "anno", "seg",
)
def export_discovered(t: Tables) -> DataFrame:
    """Layouts found from a table's columns: id, each object, main point; written and read back."""
    root = shared_dir(t.spark, "lake")
    flat = t.anno.join(t.seg, "id")
    specs = layout.discovered(flat.columns, flat.count(), bytes_per_row=20_000)
    layout.export(flat, specs, root)
    out = None
    for s in specs:
        part = t.spark.read.parquet(f"{root}/{s.name}").select(F.lit(s.name).alias("layout"), "id", "tag", "post_pt_position_x", "post_pt_root_id")
        out = part if out is None else out.unionAll(part)
    return out


_OWN_CUTS = "len([c FOR c IN list_distinct([{cuts}]) IF c < {v}])"


def _by_own(name: str, source: str, column: str) -> str:
    cuts = ", ".join(f"(SELECT quantile_disc({column}, {k / 4}) FROM {source})" for k in (1, 2, 3))
    part = f"CASE WHEN {column} IS NOT NULL THEN {_OWN_CUTS.format(cuts=cuts, v=column)} END"
    return f"SELECT '{name}' AS layout, '{source}' AS source, id, CAST({part} AS INT) AS part FROM anno JOIN seg USING (id)"


_POST = [x.replace("pre_pt", "post_pt") for x in (_MORTON, _code("min"), _code("max"))]


@query(
    " UNION ALL ".join([_by_own("id", "anno", "id"), _by_own("size", "anno", "size"), _by_own("post_pt_root_id", "seg", "post_pt_root_id")])
    + f""" UNION ALL SELECT 'post_pt_position_morton', 'anno', id, CAST(CAST({_POST[0]} > lo + (hi - lo) // 4 AS INT) + CAST({_POST[0]} > lo + (hi - lo) * 2 // 4 AS INT) + CAST({_POST[0]} > lo + (hi - lo) * 3 // 4 AS INT) AS INT)
FROM anno JOIN seg USING (id), (SELECT {_POST[1]} AS lo, {_POST[2]} AS hi FROM anno) e""",
    "anno", "seg",
)
def export_searched(t: Tables) -> DataFrame:
    """Layouts by what each table is searched by, cut by its own rows; the buckets of the joined rows."""
    root = shared_dir(t.spark, "lake")
    tables = {"anno": t.anno, "seg": t.seg}
    specs = layout.searched(tables, {"anno": [POINT, "post_pt_position", "created", "size"], "seg": ["post_pt_root_id"]}, 4)
    layout.export(t.anno.join(t.seg, "id"), specs, root, tables)
    out = None
    for s in specs:
        part = t.spark.read.parquet(f"{root}/{s.name}").select(F.lit(s.name).alias("layout"), F.lit(s.source).alias("source"), "id", F.col(f"{s.column}_partition").cast("int").alias("part"))
        out = part if out is None else out.unionAll(part)
    return out


@query("SELECT id, pre_pt_position_x, true AS fewer FROM anno", "anno")
def compacted_table(t: Tables) -> DataFrame:
    """Many small files as few, clustered along the Morton curve; read by the table's newest version."""
    root = shared_dir(t.spark, "lake")
    t.anno.select("id", *[f"{POINT}_{a}" for a in "xyz"]).repartition(12).write.parquet(root)
    layout.compacted(t.spark, root, layout.Layout("m", POINT, "morton"))
    files = len([x for x in children(t.spark, current(t.spark, root)) if x.endswith(".parquet")])
    return t.spark.read.parquet(current(t.spark, root)).select("id", f"{POINT}_x", F.lit(files < 12).alias("fewer"))


@query("SELECT id FROM anno WHERE id BETWEEN 4000 AND 9000", "anno")
def lake_read(t: Tables) -> DataFrame:
    """A range read that skips whole buckets by their bounds."""
    root = shared_dir(t.spark, "lake")
    spec = layout.Layout("id", "id", "range", 4, bounds=(3750, 7500, 11250))
    layout.write(t.anno, spec, list(spec.bounds), f"{root}/id")
    return layout.read(t.spark, f"{root}/id", spec, list(spec.bounds), 4000, 9000).select("id")


@query("SELECT id, post_pt_position_z FROM anno WHERE pre_pt_position_x >= 20000 AND pre_pt_position_x < 61000 AND pre_pt_position_y >= 3000 AND pre_pt_position_y < 52001 AND pre_pt_position_z >= 500 AND pre_pt_position_z < 3100", "anno")
def clustered_box_read(t: Tables) -> DataFrame:
    """A box from a table along the Morton curve: files by the box's ranges of codes."""
    root = shared_dir(t.spark, "lake")
    layout.export(t.anno.drop("created", "deleted"), [layout.Layout("m", POINT, "morton", 8, files=64)], root)
    return manifest.read_box(t.spark, f"{root}/m", POINT, (20_000, 3_000, 500), (61_000, 52_001, 3_100)).select("id", "post_pt_position_z")


@query("SELECT id, pre_pt_root_id FROM seg WHERE pre_pt_root_id IN (SELECT root_id FROM lineage WHERE valid_to > TIMESTAMP '9000-01-01 00:00:00')", "seg", "lineage")
def filtered_root_read(t: Tables) -> DataFrame:
    """Rows of the objects in force now, from the files whose filters may hold one."""
    root = shared_dir(t.spark, "lake")
    spec = layout.Layout("sv", "pre_pt_supervoxel_id", "range", 4, files=32, filters=("pre_pt_root_id",))
    layout.export(t.seg, [spec], root)
    roots = t.lineage.where(F.col("valid_to") > ts("9000-01-01 00:00:00")).select(F.col("root_id").alias("value"))
    return manifest.read_values(t.spark, f"{root}/sv", "pre_pt_root_id", roots).select("id", "pre_pt_root_id")


@query("SELECT 'partial' AS before, 'complete' AS after, count(*) AS n FROM anno", "anno")
def output_guard(t: Tables) -> DataFrame:
    """An output that is there, in part and as a whole."""
    root = shared_dir(t.spark, "guard")
    low, high, rows = t.anno.agg(F.min("id"), F.max("id"), F.count(F.lit(1))).first()
    # the lower half of the ids, never all of them; a limit would bring its rows to one task
    half = t.anno if low is None else t.anno.where((F.col("id") - F.lit(low)) < (F.lit(high) - F.col("id")))
    half.write.parquet(root)
    before = layout.state_of(t.spark, root, rows)
    t.anno.write.mode("overwrite").parquet(root)
    after = layout.state_of(t.spark, root, rows)
    return written(t.spark.read.parquet(root), "guarded").agg(F.count(F.lit(1)).alias("n")).select(F.lit(before).alias("before"), F.lit(after).alias("after"), "n")
