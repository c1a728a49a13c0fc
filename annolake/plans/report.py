"""Tables for viewers: cells of a pyramid, lookups, properties, packed blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import aggregates, filters
from ..schema import AXES, point_columns
from ..store import written

#: Columns that are no property of a row.
NOT_PROPERTIES = ("id", "valid", "target_id", "created", "deleted", "superceded_id")


def levels(box: tuple[tuple, tuple], rows: int, limit: int, most: int = 10) -> list[tuple[int, int, int]]:
    """Grids of an index: from one cell, long axes are doubled until a cell is expected to hold ``limit`` rows."""
    size = [h - l for l, h in zip(*box, strict=True)]
    grid, out = [1, 1, 1], []
    while True:
        out.append(tuple(grid))
        cells = grid[0] * grid[1] * grid[2]
        if rows / cells <= limit or len(out) > most:
            return out
        edges = [s / g for s, g in zip(size, grid, strict=True)]
        longest = max(edges)
        grid = [g * 2 if e > longest / 2 else g for g, e in zip(grid, edges, strict=True)]


def pyramid(df: DataFrame, point: str, box: tuple[tuple, tuple], grids: list[tuple[int, int, int]], limit: int, rows: int) -> DataFrame:
    """(level, cx, cy, cz, id): every level's cells with the rows that its sampling keeps.

    A level with more rows than ``limit`` a cell keeps a deterministic share by the point's digest,
    so a coarse cell holds a share of its finer ones.
    """
    value = scalar.sample_value(*[F.col(f"{point}_{a}") for a in AXES])
    low, high = box
    parts = []
    for level, grid in enumerate(grids):
        expected = rows / (grid[0] * grid[1] * grid[2])
        factor = 1 if expected <= limit else max(2, int(expected / limit))
        cell = [
            F.least(F.lit(g - 1), F.floor((F.col(f"{point}_{a}") - lo) * g / (hi - lo))).cast("int").alias(f"c{a}")
            for a, lo, hi, g in zip(AXES, low, high, grid, strict=True)
        ]
        parts.append(F.struct(F.lit(level).alias("level"), *cell, F.lit(factor).alias("factor")))
    inside = filters.box(df, point, low, high).select("id", value.alias("v"), *[f"{point}_{a}" for a in AXES])
    each = inside.select("id", "v", F.explode(F.array(*parts)).alias("p")).where(F.col("v") % F.col("p.factor") == 0)
    return each.select("p.level", "p.cx", "p.cy", "p.cz", "id")


#: Bits of a digest (of 32) that tell a cell's rows apart before any are ranked: equal shares of a cell, nearly.
SHARE_BITS = 16


def spread_levels(df: DataFrame, point: str, box: tuple[tuple, tuple], limit: int, first: tuple[int, int, int] = (1, 1, 1), most: int = 21) -> DataFrame:
    """(level, cx, cy, cz, id): every row in the box on exactly one level, at most ``limit`` of them in a cell.

    From a grid of ``first`` cells on, each level takes from each of its cells the rows of the smallest digests
    of their ids; the others go on to the next level, whose long axes have twice as many cells. Levels are
    added as long as rows are left, so dense places go deeper; only where a cell is no larger than one
    unit, or after ``most`` levels, does the last one take all that is left.

    A cell's rows are counted by the first bits of their digests, which tell where its limit lies; only the rows
    of that one share, about a 65,536th of the cell, are ranked, so no cell and no limit is one task.
    """
    low, high = box
    size = [h - l for l, h in zip(low, high, strict=True)]
    digest = scalar.drawn(F.col("id"), 0)
    at = [F.col(f"{point}_{a}") for a in AXES]
    rest = written(filters.box(df, point, low, high).select("id", digest.alias("v"), *[(x - lo).alias(a) for x, lo, a in zip(at, low, AXES, strict=True)]), "level-rows")
    grid, level, out = list(first), 0, None
    while True:
        # the box is closed: its upper faces belong to the last cells
        cell = [F.least(F.lit(g - 1), F.floor(F.col(a) * g / s)).cast("int").alias(f"c{a}") for a, g, s in zip(AXES, grid, size, strict=True)]
        rows = rest.select("*", *cell)
        keys = ["cx", "cy", "cz"]
        edges = [s / g for s, g in zip(size, grid, strict=True)]
        if level + 1 >= most or max(edges) <= 1:
            taken, rest = rows, None
        else:
            shared = rows.withColumn("share", F.shiftright("v", 32 - SHARE_BITS))
            counts = shared.groupBy(*keys, "share").agg(F.count(F.lit(1)).alias("n"))
            upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys).orderBy("share").rowsBetween(Window.unboundedPreceding, 0)))
            # a row a cell that has more rows than it takes: written, so that their number is known and few are broadcast
            edge = upto.where((F.col("upto") > limit) & (F.col("upto") - F.col("n") <= limit)).select(*keys, F.col("share").alias("edge"), (limit - F.col("upto") + F.col("n")).alias("room"))
            marked = shared.join(written(edge, "level-edges"), keys, "left")
            at = marked.where(F.col("share") == F.col("edge"))
            ranked = at.withColumn("taken", F.row_number().over(Window.partitionBy(*keys).orderBy("v", "id")) <= F.col("room"))
            sure = marked.where(F.col("edge").isNull() | (F.col("share") != F.col("edge"))).withColumn("taken", F.col("edge").isNull() | (F.col("share") < F.col("edge")))
            cols = [*keys, "id", "v", *AXES, "taken"]
            decided = written(sure.select(*cols).unionByName(ranked.select(*cols)), "level-rows")
            taken, rest = decided.where("taken"), decided.where("NOT taken").select("id", "v", *AXES)
        part = taken.select(F.lit(level).alias("level"), *keys, "id")
        out = part if out is None else out.unionAll(part)
        if rest is None or not rest.limit(1).count():
            return out
        grid = [g * 2 if e > max(edges) / 2 and e > 1 else g for g, e in zip(grid, edges, strict=True)]
        level += 1


def cutout(df: DataFrame, point: str, low: tuple, high: tuple, rows: int, max_points: int, volume_share: float) -> DataFrame:
    """Rows of one cell, thinned by the sampling policy: by digests of the point or, for a small share, of the
    id, so the same rows come however the table is split.
    """
    kind, x = filters.sampling(rows, max_points, volume_share)
    inside = filters.half_open_box(df, point, low, high)
    if kind == "hash":
        return filters.hash_sampled(inside, point, int(x))
    return filters.share_sampled(inside, x) if kind == "percent" else inside


def by_id(df: DataFrame, ids: list[int], ref: DataFrame | None = None) -> DataFrame:
    """Rows by id, with those that refer to them."""
    some = filters.is_in(df, "id", ids)
    if ref is None:
        return some
    r = ref.select(*[F.col(c).alias(f"{c}_ref") if c in df.columns else F.col(c) for c in ref.columns])
    return some.join(r, some["id"] == r["target_id"])


def by_relationship(df: DataFrame, root: str, objects: DataFrame, per_block: int = 10_000) -> DataFrame:
    """(root_id, block, n, ids): rows that touch each of the objects, all objects in one job.

    An object with more than ``per_block`` rows is several blocks by the ids' hash, so that one with
    very many is no single group.
    """
    hits = df.join(objects.select(F.col("root_id").alias("_o")), F.col(root) == F.col("_o"), "left_semi").select(F.col(root).alias("root_id"), "id")
    sizes = hits.groupBy("root_id").agg(F.ceil(F.count(F.lit(1)) / per_block).cast("int").alias("blocks"))
    dealt = hits.join(sizes, "root_id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    return dealt.groupBy("root_id", "block").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))


def discovered(df: DataFrame) -> dict:
    """What a table gives a viewer: geometry, relationships (roots), enums (texts), numbers."""
    points = point_columns(df.columns)
    if len(points) not in (1, 2):
        raise ValueError(f"{len(points)} points: a row is neither a point nor a line")
    own = {f"{p}_{a}" for p in points for a in AXES}
    props = {c: t for c, t in df.dtypes if c not in own and c not in NOT_PROPERTIES}
    roots = [c for c in props if c.endswith("root_id")]
    rest = {c: t for c, t in props.items() if not c.endswith(("root_id", "supervoxel_id"))}
    return {
        "geometry": "POINT" if len(points) == 1 else "LINE",
        "points": points,
        "relationships": roots,
        "enums": [c for c, t in rest.items() if t == "string"],
        "numbers": {c: t for c, t in rest.items() if t in ("int", "bigint", "float", "double", "boolean")},
    }


def coded(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns as ``{c}_code``: places in their sorted distinct values."""
    for c in columns:
        codes = aggregates.enum_codes(df, c).select(F.col("value").alias(f"_{c}"), F.col("code").cast("int").alias(f"{c}_code"))
        df = df.join(codes, F.col(c) == F.col(f"_{c}"), "left").drop(f"_{c}")
    return df


def segment_properties(df: DataFrame, root: str, tags: list[str], numbers: list[str], form: str, *label: Column) -> DataFrame:
    """A row an annotation with an object: the object, tags told apart, numbers, and a label."""
    some = filters.without_zero(df, root)
    marked = aggregates.labelled_duplicates(some, tags)
    return marked.select("id", F.col(root).alias("root_id"), *tags, *numbers, scalar.label(form, *label).alias("label"))


def packed_rows(df: DataFrame, points: list[str], numbers: list[str]) -> DataFrame:
    """Rows with ``geometry``: little-endian 32-bit floats of the points and numbers, in Arrow batches."""
    wanted = [f"{p}_{a}" for p in points for a in AXES] + numbers
    keep = [c for c in ("level", "cx", "cy", "cz", "id") if c in df.columns]
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c).cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) for c in wanted]
            rows = np.stack(cols, 1).astype("<f4")
            data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * len(wanted)), len(rows), [None, pa.py_buffer(rows.tobytes())])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], data.cast(pa.binary())], [*keep, "geometry"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", geometry binary"
    return df.select(*keep, *wanted).mapInArrow(run, schema)


def packed_blocks(packed: DataFrame, per_block: int = 10_000) -> DataFrame:
    """(level, cx, cy, cz, block, n, data): count, geometries in id order, then 64-bit ids.

    A cell that holds more than ``per_block`` rows is several blocks by the ids' hash, so no group
    outgrows a task; ``n`` rows of 64-bit count come first, as in a file of its own.
    """
    cell = ["level", "cx", "cy", "cz"]
    sizes = packed.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / per_block).cast("int").alias("blocks"))
    dealt = packed.join(sizes, cell).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = dealt.groupBy(*cell, "block").agg(F.array_sort(F.collect_list(F.struct("id", "geometry"))).alias("r"))

    def little(c: Column) -> Column:
        h = F.lpad(F.hex(c), 16, "0")
        return F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)])

    n = F.size("r").cast("long")
    data = F.concat(little(n), F.array_join(F.transform("r", lambda x: F.hex(x["geometry"])), ""), F.array_join(F.transform("r", lambda x: little(x["id"])), ""))
    return rows.select(*cell, "block", n.alias("n"), F.unhex(data).alias("data"))
