"""Queries on frozen tables: joins, filters, projection, names, units, limit."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import filters, projections
from ..schema import Table


@dataclass(frozen=True)
class QuerySpec:
    """A query: filters by table, joins, columns by table, names, units and limit."""

    filters: dict[str, dict[str, dict]] = field(default_factory=dict)
    joins: tuple[tuple[str, str, str, str, str], ...] = ()  # left table, column, right table, column, inner or left
    select: dict[str, list[str]] | None = None
    suffixes: dict[str, str] | None = None
    resolution: tuple[float, float, float] | None = None
    sentinel: bool = False
    arrays: bool = False
    valid_only: bool = True
    sample: dict[str, int] = field(default_factory=dict)
    offset: int = 0
    limit: int | None = None
    cap: int | None = None
    count: bool = False
    order: str | None = "id"


@dataclass(frozen=True)
class QueryResult:
    """Rows, output names by table and column, units, what the user should know, the most rows there can
    be (None: no bound), the names of creation times among the tables' columns, whether given or not,
    and where rows are bounded, what counts them as the query runs.
    """

    df: DataFrame
    columns: dict[str, dict[str, str]]
    resolution: tuple[float, float, float]
    warnings: tuple[str, ...] = ()
    limit: int | None = None
    created: tuple[str, ...] = ()
    seen: Observation | None = None

    def told(self) -> tuple[str, ...]:
        """The warnings once the rows were read: also whether there were as many as there may be."""
        if self.seen is None or self.seen.get["n"] < self.limit:
            return self.warnings
        return (*self.warnings, f"limited to {self.limit} rows")


def _prefixed(df: DataFrame, table: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{table}.{c}") for c in df.columns])


def run(tables: dict[str, Table], spec: QuerySpec) -> QueryResult:
    """Plan a query. Filters and samples stand below the joins, the limit above everything.

    A query gives all its rows, in no order, unless it asks for a limit, an offset or a cap. Then they
    are those that come first by id (where a table has none, by all its columns), so the same query
    gives the same rows; only one that names no order, as on an aggregating view, may give any. A
    limit above the cap is told in the warnings, and after the rows were read, whether there were as many
    as there may be (``QueryResult.told``).
    """
    first = spec.joins[0][0] if spec.joins else next(iter(tables))
    rows: dict[str, DataFrame] = {}
    for name, t in tables.items():
        df = t.df
        if name in spec.sample:
            df = filters.percent_sampled(df, spec.sample[name], t.extra["row_count"])
        if spec.valid_only and "valid" in df.columns:
            df = filters.valid(df)
        rows[name] = filters.apply(df, spec.filters.get(name, {}))
    used = [first]
    out = _prefixed(rows[first], first)
    for left, lc, right, rc, how in spec.joins:
        if left not in used:
            raise ValueError(f"{left!r} is joined before it is there")
        if lc not in rows[left].columns or rc not in rows[right].columns:
            raise KeyError(f"no column {lc!r} of {left} or {rc!r} of {right}")
        other = _prefixed(rows[right], right)
        out = out.join(other, out[f"`{left}.{lc}`"] == other[f"`{right}.{rc}`"], how)
        used.append(right)
    wanted: dict[str, list[str]] = {}
    for name in used:
        cols = rows[name].columns
        asked = (spec.select or {}).get(name)
        if spec.select is None:
            wanted[name] = projections.all_but(cols)
        elif asked:
            wanted[name] = projections.resolve(cols, asked)
    names = projections.suffixed(wanted, spec.suffixes)
    have = tables[first].resolution
    want = spec.resolution or have
    cols = []
    for name, by in names.items():
        ratios = [h / w for h, w in zip(tables[name].resolution, spec.resolution or tables[name].resolution, strict=True)]
        points = tables[name].points
        for c, to in by.items():
            x = F.col(f"`{name}.{c}`")
            base, _, axis = c.rpartition("_")
            if base in points and any(r != 1 for r in ratios):
                x = x * F.lit(ratios["xyz".index(axis)])
            if spec.sentinel and c.endswith(("root_id", "supervoxel_id")):
                x = F.coalesce(x, F.lit(1))
            cols.append(x.alias(to))
    over = spec.limit is not None and spec.cap is not None and spec.limit > spec.cap
    warnings = tuple(tables[n].extra["notice"] for n in used if tables[n].extra.get("notice"))
    warnings += (f"limit {spec.limit} is above the cap of {spec.cap} rows",) if over else ()
    if spec.count:
        return QueryResult(out.agg(F.count(F.lit(1)).alias("count")), names, want, warnings)
    limit = min((n for n in (spec.limit, spec.cap) if n is not None), default=None)
    if limit is not None or spec.offset:
        key = f"{first}.{spec.order}"
        if spec.order and key in out.columns:
            out = out.orderBy(F.col(f"`{key}`"))
        elif spec.order or spec.offset:
            out = out.orderBy(*[F.col(f"`{first}.{c}`") for c in rows[first].columns])
    if spec.offset:
        out = out.offset(spec.offset)
    seen = None
    if limit is not None:
        seen = Observation()
        out = out.limit(limit).observe(seen, F.count(F.lit(1)).alias("n"))
    df = out.select(*cols).drop(*projections.hidden(names, spec.select or {}))
    if spec.arrays:
        df = projections.as_arrays(df)
    created = tuple(projections.created_columns([to for by in names.values() for to in by.values()]))
    return QueryResult(df, names, want, warnings, limit, created, seen)


class Views:
    """Named queries with a resolution of their own."""

    def __init__(self) -> None:
        self._made: dict[str, tuple] = {}

    def add(self, name: str, build, resolution: tuple[float, float, float]) -> None:
        self._made[name] = (build, resolution)

    def table(self, name: str, *args) -> Table:
        build, resolution = self._made[name]
        return Table(name, build(*args), resolution)


def flat(anno: DataFrame, seg: DataFrame, how: str = "left") -> DataFrame:
    """Annotation and segmentation of the same id as one table."""
    return anno.join(seg, "id", how)


def export_limited(anno: DataFrame, seg: DataFrame, limit: int | None, drop: tuple[str, ...] = projections.HIDDEN) -> DataFrame:
    """The export join, with a limit on the annotation side below it and without the dropped columns."""
    some = anno if limit is None else anno.orderBy("id").limit(limit)
    joined = some.join(seg, "id")
    return joined.select(*projections.dropped([anno.columns, seg.columns], drop))
