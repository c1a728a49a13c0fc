"""Lake layouts: cut points, buckets, and clustered parquet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..schema import main_point, point_columns, point_rank, root_columns
from ..store import current, exists, replace, written
from . import aggregates, manifest


@dataclass(frozen=True)
class Layout:
    """How one copy of a table lies: by ranges or a hash of a column, or by the Morton code of a point; in how
    many files at least (as many as buckets unless told), the columns that get a filter by file, and whether
    the column it goes by gets one of parquet's own, by row group (the files' ends tell those apart already);
    and of several joined tables the one that has the column.
    """

    name: str
    column: str
    kind: str = "range"  # range, uniform, hash, morton or morton_uniform
    n: int = 1
    bounds: tuple | None = None
    bloom: bool = False
    files: int | None = None
    filters: tuple[str, ...] = ()
    source: str | None = None


def with_code(df: DataFrame, spec: Layout) -> tuple[DataFrame, str]:
    """``df`` with the column that the layout goes by: the Morton code for a point."""
    if not spec.kind.startswith("morton"):
        return df, spec.column
    c = f"{spec.column}_morton"
    return df.withColumn(c, scalar.morton(*[F.col(f"{spec.column}_{a}") for a in "xyz"])), c


def bounds_of(df: DataFrame, specs: list[Layout]) -> dict[str, list]:
    """Cut points by layout name: given ones win; all range layouts of a table share their passes."""
    out = {s.name: list(s.bounds) for s in specs if s.bounds is not None}
    todo = [s for s in specs if s.bounds is None and s.kind in ("range", "morton")]
    coded, cols, wanted = df, {}, {}
    for s in todo:
        coded, cols[s.name] = with_code(coded, s)
        wanted.setdefault(cols[s.name], []).append(s.n)
    cuts = aggregates.many_cuts(coded, wanted)
    out |= {s.name: cuts[cols[s.name], s.n] for s in todo}
    for s in specs:
        if s.bounds is None and s.kind == "uniform":
            out[s.name] = aggregates.uniform_cuts(df, s.column, s.n)
        if s.bounds is None and s.kind == "morton_uniform":
            out[s.name] = aggregates.uniform_morton_cuts(df, s.column, s.n)
    return out


def bucketed(df: DataFrame, spec: Layout, cuts: list) -> DataFrame:
    """``df`` with ``{column}_partition``."""
    coded, c = with_code(df, spec)
    bucket = scalar.hash_bucket(F.col(c), spec.n) if spec.kind == "hash" else scalar.range_bucket(F.col(c), sorted(set(cuts)))
    return coded.withColumn(f"{spec.column}_partition", bucket)


#: Rows that a task of a layout sorts and writes, about, where their number is known.
TASK_ROWS = 1_000_000


def write(df: DataFrame, spec: Layout, cuts: list, path: str, count: int = 0) -> None:
    """Write one layout: rows clustered by their bucket and, inside, by the column or code, and the files' manifest.

    The id is the last key, so that the rows of one object or point are dealt to several tasks, too. Tables of
    more than ``TASK_ROWS`` rows a file, if their ``count`` is given, are dealt to more tasks.
    """
    part = f"{spec.column}_partition"
    rows = bucketed(df, spec, cuts)
    _, c = with_code(df.limit(0), spec)
    keys = [part, c, *(["id"] if "id" in rows.columns and c != "id" else [])]
    files = rows.repartitionByRange(max(1, spec.files or spec.n, -(-count // TASK_ROWS)), *keys).sortWithinPartitions(*keys)
    out = files.write.partitionBy(part).option("maxRecordsPerFile", 5_000_000)
    if spec.bloom:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.fpp#{c}", "0.001")
    out.parquet(path)
    manifest.write(df.sparkSession, path, rows.schema, c, spec.filters)


def written_counting(df: DataFrame, path: str) -> int:
    """Write a flat copy and count rows on the way, without another pass."""
    seen = Observation("written")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return seen.get["n"]


def state_of(spark: SparkSession, path: str, rows: int) -> str:
    """absent, partial (another number of rows) or complete."""
    if not exists(spark, path):
        return "absent"
    return "complete" if spark.read.parquet(path).count() == rows else "partial"


def guard(spark: SparkSession, path: str, rows: int) -> None:
    found = state_of(spark, path, rows)
    if found != "absent":
        raise FileExistsError(f"{path} is there ({found})")


def bounds_by_source(tables: dict[str, DataFrame], specs: list[Layout]) -> dict[str, list]:
    """Cut points by layout name, those of each table from its own rows, without a join."""
    out: dict[str, list] = {}
    for name in dict.fromkeys(s.source for s in specs):
        out |= bounds_of(tables[name], [s for s in specs if s.source == name])
    return out


def export(df: DataFrame, specs: list[Layout], root: str, tables: dict[str, DataFrame] | None = None) -> dict[str, list]:
    """Write every layout of a table under ``root/name``, all from one flat copy in the shared folder, so
    the table is computed once and a lost executor costs only its tasks. Gives the cut points: those of
    the copy, or where ``tables`` has the layouts' sources, of these.
    """
    names = [s.name for s in specs]
    if len(set(names)) < len(names):
        raise ValueError(f"layouts share a name: {names}")
    spark = df.sparkSession
    for s in specs:
        if exists(spark, f"{root}/{s.name}"):
            raise FileExistsError(f"{root}/{s.name}")
    flat = written(df, "flat")
    cuts = bounds_of(flat, specs) if tables is None else bounds_by_source(tables, specs)
    count = flat.count()
    for s in specs:
        write(flat, s, cuts.get(s.name, []), f"{root}/{s.name}", count)
    return cuts


def compacted(spark: SparkSession, target: str, spec: Layout, bytes_per_row: float = 200) -> int:
    """Rewrite a table's many files as few large ones, its next version, clustered by a column or along
    the Morton curve of a point; gives the number of files. Readers of the version before go on.
    """
    rows = spark.read.parquet(current(spark, target))
    n = aggregates.partitions_for(rows.count(), bytes_per_row)
    coded, c = with_code(rows, spec)
    clustered = coded.repartitionByRange(n, c).sortWithinPartitions(c).select(*rows.columns)
    replace(clustered, target)
    return n


def export_view(view: DataFrame, specs: list[Layout], root: str) -> tuple[int, dict[str, list]]:
    """Run a view once into a flat copy, counting, and lay it out from there."""
    rows = written_counting(view, f"{root}/flat")
    flat = view.sparkSession.read.parquet(f"{root}/flat")
    cuts = bounds_of(flat, specs)
    for s in specs:
        write(flat, s, cuts.get(s.name, []), f"{root}/{s.name}", rows)
    return rows, cuts


def read(spark: SparkSession, path: str, spec: Layout, cuts: list, low=None, high=None) -> DataFrame:
    """Rows with low <= column <= high; buckets that cannot hold any are not read."""
    df = spark.read.parquet(path)
    part, cuts = f"{spec.column}_partition", sorted(set(cuts))
    if low is not None:
        df = df.where((F.col(part) >= sum(c < low for c in cuts)) & (F.col(spec.column) >= F.lit(low)))
    if high is not None:
        df = df.where((F.col(part) <= sum(c < high for c in cuts)) & (F.col(spec.column) <= F.lit(high)))
    return df


def discovered(columns: list[str], rows: int, bytes_per_row: float = 200) -> list[Layout]:
    """Layouts of a table nobody gave any for: by id, by each object it names, and by its main point."""
    n = aggregates.partitions_for(rows, bytes_per_row)
    out = [Layout("id", "id", "range", n)] if "id" in columns else []
    out += [Layout(c, c, "hash", n, bloom=True) for c in root_columns(columns)]
    point = main_point(columns)
    return [*out, Layout(point, point, "morton", n)] if point else out


def searched(tables: dict[str, DataFrame], by: dict[str, list[str]], n: int) -> list[Layout]:
    """Layouts of tables of the same ids by what each is searched by, each noting the table of its column:
    the id of the first table, every searched number, and one of the searched points, that which comes
    first among main points, along the Morton curve. Times are metadata and get none, and of one column in
    two tables the first counts.
    """
    first = next(iter(tables))
    out = [Layout("id", "id", "range", n, source=first)] if "id" in tables[first].columns else []
    points = []
    for name, columns in by.items():
        kinds = dict(tables[name].dtypes)
        bases = point_columns(tables[name].columns)
        for c in columns:
            if c in bases:
                points.append((point_rank(c), c, name))
            elif c not in kinds:
                raise KeyError(f"no column {c!r} of {name}")
            elif not kinds[c].startswith("timestamp") and c not in [s.column for s in out]:
                out.append(Layout(c, c, "range", n, source=name))
    if points:
        _, c, name = min(points, key=lambda p: p[0])
        out.append(Layout(f"{c}_morton", c, "morton_uniform", n, source=name))
    return out
