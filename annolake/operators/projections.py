"""Choosing, renaming and reshaping columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..schema import AXES, HIDDEN, point_columns, supervoxel_of


def resolve(columns: list[str], wanted: list[str]) -> list[str]:
    """Wanted columns, each root followed by its supervoxel if the table has it; points by their axes."""
    out: list[str] = []
    for c in wanted:
        if c in columns:
            out.append(c)
        elif all(f"{c}_{a}" in columns for a in AXES):
            out += [f"{c}_{a}" for a in AXES]
        else:
            raise KeyError(f"no column {c!r}; there are {', '.join(columns)}")
        sv = supervoxel_of(c)
        if c.endswith("root_id") and sv in columns:
            out.append(sv)
    return list(dict.fromkeys(out))


def all_but(columns: list[str], skip: tuple[str, ...] = ("valid", "superceded_id")) -> list[str]:
    return [c for c in columns if c not in skip]


def suffixed(columns: dict[str, list[str]], suffixes: dict[str, str] | None = None) -> dict[str, dict[str, str]]:
    """Output names by table: a column that several tables give gets its table's suffix.

    Suffixes are x, y, z, xx, ... in the order of the tables unless given; two alike are an error.
    A point's suffix stands before its axis.
    """
    names = list(columns)
    auto = {t: "xyz"[i % 3] * (i // 3 + 1) for i, t in enumerate(names)}
    auto |= suffixes or {}
    used = [auto[t] for t in names]
    if len(set(used)) < len(used):
        raise ValueError(f"tables share a suffix: {used}")
    count: dict[str, int] = {}
    for cols in columns.values():
        for c in cols:
            count[c] = count.get(c, 0) + 1
    out: dict[str, dict[str, str]] = {}
    for t, cols in columns.items():
        points = {f"{p}_{a}": (p, a) for p in point_columns(cols) for a in AXES}
        out[t] = {}
        for c in cols:
            if count[c] == 1:
                out[t][c] = c
            elif c in points:
                out[t][c] = f"{points[c][0]}{auto[t]}_{points[c][1]}"
            else:
                out[t][c] = f"{c}{auto[t]}"
    return out


def rescaled(df: DataFrame, have: tuple, want: tuple) -> DataFrame:
    """Positions times the ratio of two resolutions; as they are if all ratios are one."""
    if all(h == w for h, w in zip(have, want, strict=True)):
        return df
    ratio = {a: h / w for a, h, w in zip(AXES, have, want, strict=True)}
    return df.withColumns({f"{p}_{a}": F.col(f"{p}_{a}") * F.lit(ratio[a]) for p in point_columns(df.columns) for a in AXES})


def with_sentinel(df: DataFrame, columns: list[str], sentinel: int = 1) -> DataFrame:
    """Missing supervoxels and roots as ``sentinel``."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(sentinel)) for c in columns})


def as_arrays(df: DataFrame) -> DataFrame:
    """Each point's three columns as one array column in their place."""
    points = set(point_columns(df.columns))
    out = []
    for c in df.columns:
        base, _, axis = c.rpartition("_")
        if base in points and axis in AXES:
            if axis == "x":
                out.append(F.array(*[F.col(f"{base}_{a}") for a in AXES]).alias(base))
        else:
            out.append(F.col(c))
    return df.select(*out)


def from_wkb(df: DataFrame, columns: list[str]) -> DataFrame:
    """Geometry columns decoded to three integer columns each, the originals dropped."""
    for c in columns:
        df = df.withColumn(f"{c}_p", scalar.wkb_point(F.col(c)))
        df = df.withColumns({f"{c}_{a}": F.col(f"{c}_p.{a}") for a in AXES}).drop(c, f"{c}_p")
    return df


def narrowed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Decimal columns as integers if all their values are whole, else as doubles: one pass for all."""
    whole = df.agg(*[F.bool_and(F.col(c) == F.floor(c)).alias(c) for c in columns]).first()
    return df.withColumns({c: F.col(c).cast("long" if whole[c] in (True, None) else "double") for c in columns})


def hidden(names: dict[str, dict[str, str]], asked: dict[str, list[str]]) -> list[str]:
    """Names that edit columns have in a result, by table and column; a creation time that was asked for stays."""
    return [to for t, by in names.items() for c, to in by.items() if c in HIDDEN and not (c == "created" and c in asked.get(t, ()))]


def created_columns(columns: list[str]) -> list[str]:
    """Columns of creation times, suffixed or not."""
    return [c for c in columns if c.startswith("created")]


def null_profile(df: DataFrame) -> DataFrame:
    """A row a column: its name, and whether all its values are null."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return counts.selectExpr(f"stack({len(df.columns)}, {pairs}) AS (column_name, n)").select("column_name", (F.col("n") == 0).alias("all_null"))


def typed(df: DataFrame) -> DataFrame:
    """Without all-null columns; doubles as floats and short integers as ints: one pass of counts."""
    empty = {r[0] for r in null_profile(df).where("all_null").collect()}
    out = []
    for c, kind in df.dtypes:
        if c in empty:
            continue
        to = "float" if kind == "double" else "int" if kind in ("smallint", "tinyint") else None
        out.append(F.col(c).cast(to).alias(c) if to else F.col(c))
    return df.select(*out)


def aligned(df: DataFrame, target: list[str]) -> DataFrame:
    """The target's columns in its order: common ones with nulls as 0, missing ones as 0."""
    return df.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in df.columns else F.lit(0).cast("long").alias(c) for c in target])


def ordered(df: DataFrame, schema_order: list[str]) -> DataFrame:
    """Columns in the schema's order, as far as they are there."""
    return df.select(*[c for c in schema_order if c in df.columns])


def dropped(columns: list[list[str]], drop: tuple[str, ...] = HIDDEN) -> list[str]:
    """Columns of several tables in order, each once, without a list of names; unknown names are no error."""
    return [c for c in dict.fromkeys(c for cols in columns for c in cols) if c not in drop]
