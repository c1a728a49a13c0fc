"""Counts, extents, cut points, ranks and chunks."""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..schema import AXES, point_columns
from ..store import written


def counted(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count"))


def category_counts(df: DataFrame, column: str, most: int = 100) -> DataFrame:
    """The most frequent values with their counts; of equals the smaller value comes first."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(column)).limit(most)


def pair_report(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows, pairs of one object with itself, and rows with an object 0, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if((F.col(a) == F.col(b)) & (F.col(a) != 0)).alias("self_pairs"),
        F.count_if((F.col(a) == 0) | (F.col(b) == 0)).alias("with_zero"),
    )


def id_extent(df: DataFrame, upto: Column) -> DataFrame:
    """Smallest and largest id and row count of valid rows created no later than a time."""
    rows = df.where(F.col("valid") & (F.col("created") <= upto))
    return rows.agg(F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.count(F.lit(1)).alias("row_count"))


def extent(df: DataFrame, chunk: int = 1) -> DataFrame:
    """The box of all points, lower sides rounded down and upper ones up to whole chunks.

    Without points or rows the bounds are null: callers take that as one cell.
    """
    points = point_columns(df.columns)
    out = []
    for a in AXES:
        lo = [F.min(f"{p}_{a}") for p in points]
        hi = [F.max(f"{p}_{a}") for p in points]
        low = F.least(*lo) if len(lo) > 1 else lo[0]
        high = F.greatest(*hi) if len(hi) > 1 else hi[0]
        out += [(F.floor(low / chunk) * chunk).cast("long").alias(f"min_{a}"), (F.ceil((high + 1) / chunk) * chunk).cast("long").alias(f"max_{a}")]
    return df.agg(*out)


def stacked_points(df: DataFrame, points: list[str], keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """All points one below another: kept columns, type, x, y, z; rows without a point are left out."""
    rows = ", ".join(f"'{p.removesuffix('_position')}', `{p}_x`, `{p}_y`, `{p}_z`" for p in points)
    return df.selectExpr(*keep, f"stack({len(points)}, {rows}) AS (type, x, y, z)").where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")


def populated_cells(df: DataFrame, size: int) -> DataFrame:
    """Grid cells that hold a point of any column, with their numbers of points."""
    p = stacked_points(df, point_columns(df.columns))
    cells = [F.floor(F.col(a) / size).cast("long").alias(f"c{a}") for a in AXES]
    return p.select(*cells).groupBy("cx", "cy", "cz").agg(F.count(F.lit(1)).alias("n"))


def cell_size(rows: int, box: tuple[tuple, tuple], base: int) -> int:
    """Edge of data-driven cells of a small table: about 50 rows a cell, 1000 to 5000 cells."""
    volume = float(np.prod([h - l for l, h in zip(*box, strict=True)]))
    return max(base, int(round((volume / min(5000, max(1000, rows // 50))) ** (1 / 3))))


def grid_cells(df: DataFrame, size: int) -> DataFrame:
    """All cells of the regular grid over the extent of ``df``: number, place, and clipped bounds."""
    e = extent(df).select("*", *[F.greatest(F.lit(1), F.ceil((F.col(f"max_{a}") - F.col(f"min_{a}")) / size)).cast("long").alias(f"n{a}") for a in AXES])
    for a in AXES:
        e = e.withColumn(f"i{a}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n{a}") - 1)))
    number = (F.col("ix") * F.col("ny") + F.col("iy")) * F.col("nz") + F.col("iz")
    lows = [(F.col(f"min_{a}") + F.col(f"i{a}") * size).alias(f"low_{a}") for a in AXES]
    highs = [F.least(F.col(f"max_{a}"), F.col(f"min_{a}") + (F.col(f"i{a}") + 1) * size).alias(f"high_{a}") for a in AXES]
    return e.select(number.alias("cell"), "ix", "iy", "iz", *lows, *highs)


#: Size of a quantile sketch, and the largest error of a rank that it gives, as a share of all rows, in 99 of 100 cases.
SKETCH_K = 2048
RANK_ERROR = 0.0024
#: Ranks at which a sketch is asked: so many even shares.
GRID = 512
#: Distinct values of a column that one task may rank.
RANKED_VALUES = 1 << 20
#: Parts beyond which a column's values are put in order instead: so many cuts leave most of them in doubt.
MANY_PARTS = 32

_KEYS = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "bigint": "bigint", "float": "double", "double": "double"}


def _key(c: Column, kind: str) -> Column:
    """The number that stands for a value in sketches and blocks: never falls where the value rises."""
    return F.unix_date(c).cast("bigint") if kind == "date" else c.cast(_KEYS.get(kind, "double"))


def _sketch(key: Column, kind: str) -> Column:
    return (F.kll_sketch_agg_bigint if kind == "bigint" else F.kll_sketch_agg_double)(key, SKETCH_K)


def _asked(sketch: str, kind: str, n: int) -> Column:
    """The values at even shares, 0 to 1 in ``n`` steps, of a sketch."""
    quantile = F.kll_sketch_get_quantile_bigint if kind == "bigint" else F.kll_sketch_get_quantile_double
    shares = ",".join(str(i / n) for i in range(n + 1))  # one constant, not a column a share
    return quantile(sketch, F.split(F.lit(shares), ",").cast("array<double>"))


def sketched(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, key, n, sketch) of each column, in one aggregation: mergeable sketches of its values, which
    are few kilobytes however many rows there are. Nulls and NaN do not count. ``merged_sketches`` adds
    those of several tables or of parts of one.
    """
    kinds = dict(df.dtypes)
    fine = {c: F.nanvl(F.col(c), F.lit(None)) if kinds[c] in ("float", "double") else F.col(c) for c in columns}
    keys = {c: _key(fine[c], kinds[c]) for c in columns}
    of = {c: "bigint" if kinds[c] == "date" else _KEYS.get(kinds[c], "double") for c in columns}
    one = df.agg(*[x for i, c in enumerate(columns) for x in (F.count(keys[c]).alias(f"n{i}"), _sketch(keys[c], of[c]).alias(f"s{i}"))])
    rows = ", ".join(f"'{c}', '{of[c]}', n{i}, s{i}" for i, c in enumerate(columns))
    return one.selectExpr(f"stack({len(columns)}, {rows}) AS (column_name, key, n, sketch)")


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """Sketches of the same columns put together."""
    parts = []
    for key, merge in (("bigint", F.kll_merge_agg_bigint), ("double", F.kll_merge_agg_double)):
        mine = sketches.where((F.col("key") == key) & (F.col("n") > 0))
        parts.append(mine.groupBy("column_name", "key").agg(F.sum("n").alias("n"), merge("sketch").alias("sketch")))
    return parts[0].unionAll(parts[1])


def sketched_cuts(sketches: DataFrame, n: int) -> DataFrame:
    """(column_name, i, cut): n - 1 cut points of each column, each within ``RANK_ERROR`` of its rank."""
    out = None
    for key in ("bigint", "double"):
        mine = sketches.where((F.col("key") == key) & (F.col("n") > 0))
        cuts = mine.select("column_name", F.posexplode(_asked("sketch", key, n)).alias("i", "cut")).where(F.col("i").between(1, n - 1)).select("column_name", "i", F.col("cut").cast("double").alias("cut"))
        out = cuts if out is None else out.unionAll(cuts)
    return out


def discrete_cuts(df: DataFrame, columns: list[str], n: int) -> dict[str, list]:
    """n - 1 cut points of each column by share of rows, in its own type: the rows of ranks ceil(rows * i / n).

    Nulls do not count; NaN comes last.
    """
    found = many_cuts(df, {c: [n] for c in columns})
    return {c: found[c, n] for c in columns}


def many_cuts(df: DataFrame, wanted: dict[str, list[int]]) -> dict[tuple[str, int], list]:
    """The same for several columns and numbers of parts at once: (column, n) to its cut points.

    One aggregation sketches all columns. A second pass ranks, for each cut, only the values that the
    sketch leaves in doubt, and counts the others in bulk; where those are more than a task should rank,
    they are sketched anew and narrowed first. Cut points are exact: what a sketch got wrong is noticed,
    as no rank is found then, and narrowed again. Columns in more than ``MANY_PARTS`` parts are put in order,
    range by range, as that many cuts leave little that a sketch could spare.
    """
    kinds = dict(df.dtypes)
    out = {(c, n): [] for c, ns in wanted.items() for n in ns}
    groups: dict[str, list[str]] = {}
    for c, ns in wanted.items():
        many = [n for n in ns if n > MANY_PARTS]
        if many:
            out |= {(c, n): cuts for n, cuts in _ordered_cuts(df, c, many).items()}
            ns = [n for n in ns if n <= MANY_PARTS]
        if any(n > 1 for n in ns):
            kind = kinds[c]
            groups.setdefault("bigint" if _KEYS.get(kind) == "bigint" else "double" if _KEYS.get(kind) == "double" else kind, []).append(c)
    for kind, columns in groups.items():
        few = {c: [n for n in wanted[c] if n <= MANY_PARTS] for c in columns}
        out |= _group_cuts(df.select(*[F.col(c).cast(kind) for c in columns]), kind, few)
    return out


def _ordered_cuts(df: DataFrame, column: str, parts: list[int]) -> dict[int, list]:
    """Cut points of one column for each number of parts, from its distinct values in order.

    Values are counted first, so one that very many rows have is one row, then dealt to ranges; the rows
    up to each value are those of the ranges before and of its own.
    """
    counted = df.select(F.col(column).alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    ranges = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = written(counted.repartitionByRange(ranges, "v").withColumn("block", F.spark_partition_id()), "values")
    held = dealt.groupBy("block").agg(F.sum("n").alias("n")).orderBy("block").collect()  # a row a range
    total, bases = 0, []
    for r in held:
        bases.append((r["block"], total))
        total += r["n"]
    if not total:
        return {n: [] for n in parts}
    base = F.broadcast(df.sparkSession.createDataFrame(bases, "block int, base long"))
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    upto = dealt.join(base, "block").select("v", (F.col("base") + inside).alias("upto"), "n")
    # the i-th of n cuts has rank ceil(total * i / n): a value holds those with total * i / n in (upto - n, upto]
    parted = lambda x: [F.round((x * n - (x * n) % total) / total).cast("long") for n in parts]
    below, reached = parted(F.col("upto") - F.col("n")), parted(F.col("upto"))
    some = upto.select("v", F.array(*below).alias("below"), F.array(*reached).alias("upto"))
    hits = some.where(F.exists(F.arrays_zip("below", "upto"), lambda x: x["below"] < x["upto"]))
    rows = hits.collect()  # a row a cut point at most
    out: dict[int, list] = {n: [None] * (n - 1) for n in parts}
    for r in rows:
        for n, lo, hi in zip(parts, r["below"], r["upto"], strict=True):
            for i in range(lo + 1, min(hi, n - 1) + 1):
                out[n][i - 1] = r["v"]
    return out


def _group_cuts(df: DataFrame, kind: str, wanted: dict[str, list[int]]) -> dict[tuple[str, int], list]:
    columns = list(wanted)
    bounds: dict[str, list] = {c: [] for c in columns}
    stats = _block_stats(df, kind, bounds)
    nans = {c: stats[c].pop(-1, (0, []))[0] for c in columns}
    total = {c: sum(n for n, _ in stats[c].values()) + nans[c] for c in columns}
    ranks = {c: sorted({-(-total[c] * i // n) for n in wanted[c] for i in range(1, n)} if total[c] else ()) for c in columns}
    fine = {c: [r for r in ranks[c] if r <= total[c] - nans[c]] for c in columns}
    found: dict[str, dict] = {c: {r: float("nan") for r in ranks[c] if r not in set(fine[c])} for c in columns}
    while any(len(found[c]) < len(ranks[c]) for c in columns):
        open_ = {c: [r for r in fine[c] if r not in found[c]] for c in columns}
        before = bounds
        bounds, held, inside = _narrowed(kind, bounds, stats, open_)
        if inside <= RANKED_VALUES or bounds == before:
            for c, r, v in _ranked_values(df, kind, bounds, held, open_):
                found[columns[c]][r] = v
            if all(len(found[c]) == len(ranks[c]) for c in columns):
                break
        stats = _block_stats(df, kind, bounds)
        for c in columns:
            stats[c].pop(-1, None)
    return {(c, n): [found[c][-(-total[c] * i // n)] for i in range(1, n)] if total[c] else [] for c in columns for n in wanted[c]}


def _placed(df: DataFrame, kind: str, bounds: dict[str, list]) -> DataFrame:
    """(c, block, key, v): a row a column and value; block -1 holds NaN."""
    each = []
    for i, (c, ends) in enumerate(bounds.items()):
        key = _key(F.col(c), kind)
        block = scalar.range_bucket(key, ends)
        block = F.when(F.isnan(F.col(c)), -1).otherwise(block) if kind == "double" else block
        each.append(F.struct(F.lit(i).alias("c"), block.alias("block"), key.alias("key"), F.col(c).alias("v")))
    return df.select(F.explode(F.array(*each)).alias("r")).select("r.*").where("v IS NOT NULL")


def _block_stats(df: DataFrame, kind: str, bounds: dict[str, list]) -> dict[str, dict[int, tuple[int, list]]]:
    """For each column and block: rows, and values at even shares of them."""
    of = "bigint" if kind in ("bigint", "date") else "double"
    columns = list(bounds)
    out: dict[str, dict[int, tuple[int, list]]] = {c: {} for c in columns}
    if not any(bounds.values()):
        aggs = []
        for i, c in enumerate(columns):
            v = F.nanvl(F.col(c), F.lit(None)) if kind == "double" else F.col(c)
            nan = F.count_if(F.isnan(F.col(c))) if kind == "double" else F.count_if(F.lit(False))
            aggs += [F.count(v).alias(f"n{i}"), nan.alias(f"x{i}"), _sketch(_key(v, kind), of).alias(f"s{i}")]
        row = df.agg(*aggs).select("*", *[F.when(F.col(f"n{i}") > 0, _asked(f"s{i}", of, GRID)).alias(f"q{i}") for i in range(len(columns))]).drop(*[f"s{i}" for i in range(len(columns))]).first()
        for i, c in enumerate(columns):
            out[c] = {0: (row[f"n{i}"], row[f"q{i}"]), -1: (row[f"x{i}"], [])}
        return out
    rows = _placed(df, kind, bounds).where("block >= 0").groupBy("c", "block").agg(F.count(F.lit(1)).alias("n"), _sketch(F.col("key"), of).alias("s"))
    for r in rows.select("c", "block", "n", _asked("s", of, GRID).alias("q")).collect():  # a few rows a cut point
        out[columns[r["c"]]][r["block"]] = (r["n"], r["q"])
    return out


def _narrowed(kind: str, bounds: dict[str, list], stats: dict, ranks: dict[str, list[int]]) -> tuple[dict, dict, int]:
    """New blocks for each column, those of them in which the ranks are looked for, and about how many values those hold.

    A block lies above its lower end and up to its upper one. The two ends that a sketch gives for a rank
    are blocks of their own, so however often a value occurs, what lies between them is less than before.
    """
    new, held, inside = {}, {}, 0
    slack = RANK_ERROR + 1 / GRID
    whole = kind in ("bigint", "date")
    sought = sum(map(len, ranks.values()))
    for c in bounds:
        base, at, spans = 0, [], set()
        for b in sorted(stats[c]):
            at.append((base, b))
            base += stats[c][b][0]
        for r in ranks[c]:
            start, b = next(x for x in reversed(at) if x[0] < r)
            n, grid = stats[c][b]
            if n * sought <= RANKED_VALUES // 16:
                lo, hi, k = grid[0], grid[-1], n
            else:
                share = (r - start) / n
                lo, hi = grid[max(0, int((share - slack) * GRID))], grid[min(GRID, int((share + slack) * GRID) + 1)]
                k = int(n * 2 * (slack + 1 / GRID)) + 1
            spans.add((lo, hi, 1 if lo == hi else k))
        inside += sum(k for *_, k in spans)
        below = [v - 1 if whole else float(np.nextafter(v, -np.inf)) for lo, hi, _ in spans for v in (lo, hi)]
        ends = sorted({x for x in (*below, *[v for lo, hi, _ in spans for v in (lo, hi)]) if not whole or x >= -(1 << 63)})
        new[c] = ends
        held[c] = {k for lo, hi, _ in spans for k in range(bisect_left(ends, lo), bisect_left(ends, hi) + 1)}
    return new, held, inside


def _ranked_values(df: DataFrame, kind: str, bounds: dict, held: dict, ranks: dict[str, list[int]]) -> list[tuple]:
    """(place of column, rank, value) of the ranks that lie in held blocks; values of other blocks are only counted."""
    inside = F.lit(False)
    for i, c in enumerate(bounds):
        inside = inside | ((F.col("c") == i) & F.col("block").isin(sorted(held[c])))
    rows = _placed(df, kind, bounds).where("block >= 0").withColumn("v", F.when(inside, F.col("v")))
    counted = rows.groupBy("c", "block", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("c").orderBy("block", "v").rowsBetween(Window.unboundedPreceding, 0)))
    hit = F.lit(False)
    for i, c in enumerate(bounds):
        if ranks[c]:
            hit = hit | ((F.col("c") == i) & F.exists(F.array(*map(F.lit, ranks[c])), lambda r: (r <= F.col("upto")) & (r > F.col("upto") - F.col("n"))))
    columns = list(bounds)
    rows = upto.where("v IS NOT NULL").where(hit).select("c", "v", "upto", "n").collect()  # a row a cut point
    return [(i, r, v) for i, v, upto_, n in rows for r in ranks[columns[i]] if upto_ - n < r <= upto_]


def uniform_cuts(df: DataFrame, column: str, n: int) -> list[float]:
    """n - 1 evenly spaced cut points between a column's ends."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    return [] if lo is None or n <= 1 else [float(x) for x in np.linspace(lo, hi, n + 1)[1:-1]]


def uniform_morton_cuts(df: DataFrame, point: str, n: int) -> list[int]:
    """n - 1 evenly spaced Morton codes between those of the extent's corners."""
    corners = df.agg(*[f(f"{point}_{a}").alias(f"{k}_{a}") for k, f in (("lo", F.min), ("hi", F.max)) for a in AXES])
    row = corners.select(*[scalar.morton(*[F.col(f"{k}_{a}") for a in AXES]).alias(k) for k in ("lo", "hi")]).first()
    if row["lo"] is None or n <= 1:
        return []
    span = row["hi"] - row["lo"]
    return [row["lo"] + span * i // n for i in range(1, n)]


def partitions_for(rows: int, bytes_per_row: float = 200, target: int = 256 << 20) -> int:
    return max(1, int(np.ceil(rows * bytes_per_row / target)))


def unique_strings(df: DataFrame) -> DataFrame:
    """(column_name, value): distinct values of each string column."""
    cols = [c for c, t in df.dtypes if t == "string"]
    rows = ", ".join(f"'{c}', `{c}`" for c in cols)
    return df.selectExpr(f"stack({len(cols)}, {rows}) AS (column_name, value)").where("value IS NOT NULL").distinct()


def labelled_duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Tag columns with values that occur in more than one of them written as ``column:value``."""
    rows = ", ".join(f"'{c}', `{c}`" for c in columns)
    values = df.selectExpr(f"stack({len(columns)}, {rows}) AS (c, v)").where("v IS NOT NULL")
    shared = values.groupBy("v").agg(F.count_distinct("c").alias("n")).where("n > 1").select("v")
    for i, c in enumerate(columns):
        mark = shared.select(F.col("v").alias(f"_v{i}"))
        df = df.join(mark, F.col(c) == F.col(f"_v{i}"), "left")
        df = df.withColumn(c, F.when(F.col(f"_v{i}").isNotNull(), F.concat(F.lit(f"{c}:"), c)).otherwise(F.col(c))).drop(f"_v{i}")
    return df


def distinct_roots(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct objects over all root columns, without none and 0."""
    one = reduce(lambda a, b: a.unionAll(b), [df.select(F.col(c).alias("root_id")) for c in columns])
    return one.where("root_id IS NOT NULL AND root_id <> 0").distinct()


def enum_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): places of a text column's values in their order, from 0; the values are ranked, not the rows."""
    values = df.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    return in_order(values, ["value"]).select("value", (F.col("rank") - 1).cast("long").alias("code"))


def in_order(df: DataFrame, columns: list[str], out: str = "rank") -> DataFrame:
    """Rows with their place, from 1, in the order of columns of any type; ties by all other columns.

    Rows are dealt to ranges and written with their range's number, so that counts and places agree;
    then places inside a range are added to the rows before it. No task sees all rows.
    """
    parts = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [*columns, *[c for c in df.columns if c not in columns]]
    dealt = written(df.repartitionByRange(parts, *order).withColumn("_block", F.spark_partition_id()), "ranges")
    upto = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    base = dealt.groupBy("_block").agg(F.count(F.lit(1)).alias("_n")).select("_block", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(*order))
    return dealt.join(F.broadcast(base), "_block").withColumn(out, (inside + F.col("_base")).cast("long")).drop("_block", "_base")


def ranked(df: DataFrame, column: str, out: str = "rank") -> DataFrame:
    """Rows with their place, from 1, in the order of a column (ties by all other columns)."""
    return in_order(df, [column], out)


def id_chunks(df: DataFrame, n: int, column: str = "id") -> DataFrame:
    """(start, end) of chunks of n rows by id, the last without end."""
    heads = ranked(df.select(F.col(column).alias("start")), "start").where(F.col("rank") % n == (1 % n))
    number = F.floor((F.col("rank") - 1) / n).cast("long")
    heads = heads.select(number.alias("k"), "start")
    after = heads.select((F.col("k") - 1).alias("k"), F.col("start").alias("end"))
    return heads.join(after, "k", "left").select("start", "end")


def even_split(df: DataFrame, n: int, column: str = "id") -> DataFrame:
    """(column, part): distinct ids in order dealt to parts of about n; fewer ids than n are a part each."""
    ids = df.select(column).distinct()
    total = ids.count()
    k = max(1, round(total / n)) if total >= n else max(1, total)
    # as ntile: the first parts take one more where the ids do not divide
    size, more = divmod(total, k)
    at = F.col("rank") - 1
    part = F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / max(1, size)))
    return ranked(ids, column).select(column, part.cast("long").alias("part"))


def numbered(df: DataFrame, counter: int, order: str) -> DataFrame:
    """Ids that continue from a counter, in the order of a numeric column."""
    return ranked(df, order, "_rank").withColumn("id", (F.lit(counter) + F.col("_rank")).cast("long")).drop("_rank")


def page(df: DataFrame, after: int | None, n: int, key: str = "id") -> DataFrame:
    """The next n rows after a key."""
    rows = df if after is None else df.where(F.col(key) > after)
    return rows.orderBy(key).limit(n)
