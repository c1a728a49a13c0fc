"""Predicates on tables. All of a query's filters are joined by AND and keep SQL's rule for nulls."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar

#: Lists longer than this become a semi-join instead of a literal list.
LIST_LITERALS = 1000
#: Lists up to this long may be broadcast; longer ones are joined by a shuffle.
BROADCAST_VALUES = 1_000_000

_COMPARE = {
    "equal": lambda c, v: c == F.lit(v),
    "greater": lambda c, v: c > F.lit(v),
    "less": lambda c, v: c < F.lit(v),
    "greater_equal": lambda c, v: c >= F.lit(v),
    "less_equal": lambda c, v: c <= F.lit(v),
}


class FilterError(ValueError):
    """A filter that the table's columns or the given values do not allow."""


def compare(df: DataFrame, kind: str, column: str, value: object) -> DataFrame:
    """Rows whose column compares with a value: equal, greater, less, greater_equal, less_equal."""
    return df.where(_COMPARE[kind](df[_known(df, column)], value))


def _known(df: DataFrame, column: str) -> str:
    if column not in df.columns:
        raise FilterError(f"no column {column!r}; there are {', '.join(df.columns)}")
    return column


def is_in(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose column is one of the values: a literal list, or a semi-join with a longer one."""
    _known(df, column)
    if len(values) <= LIST_LITERALS:
        return df.where(df[column].isin(list(values)))
    return df.join(_listed(df, column, values), df[column] == F.col("wanted"), "left_semi")


def not_in(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose column is none of the values; null is not known to be none of them."""
    _known(df, column)
    if len(values) <= LIST_LITERALS:
        return df.where(~df[column].isin(list(values)))
    return df.where(df[column].isNotNull()).join(_listed(df, column, values), df[column] == F.col("wanted"), "left_anti")


def _listed(df: DataFrame, column: str, values: list) -> DataFrame:
    wanted = df.sparkSession.createDataFrame([(v,) for v in set(values)], df.select(F.col(column).alias("wanted")).schema)
    return F.broadcast(wanted) if len(values) <= BROADCAST_VALUES else wanted


def matches(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose text holds a match of a pattern anywhere."""
    if dict(df.dtypes)[_known(df, column)] != "string":
        raise FilterError(f"{column!r} is no text column")
    return df.where(df[column].rlike(pattern))


def box(df: DataFrame, point: str, low: tuple, high: tuple) -> DataFrame:
    """Rows whose point lies in a closed box; each lower bound must be below the upper one."""
    if len(low) != 3 or len(high) != 3 or any(a >= b for a, b in zip(low, high, strict=True)):
        raise FilterError(f"not a box: {low}, {high}")
    axes = zip("xyz", low, high, strict=True)
    return df.where(reduce(and_, [df[_known(df, f"{point}_{a}")].between(lo, hi) for a, lo, hi in axes]))


def half_open_box(df: DataFrame, point: str, low: tuple, high: tuple) -> DataFrame:
    """The same without the upper faces, so that neighbouring boxes share no row."""
    axes = zip("xyz", low, high, strict=True)
    return df.where(reduce(and_, [(df[f"{point}_{a}"] >= lo) & (df[f"{point}_{a}"] < hi) for a, lo, hi in axes]))


def edited_between(df: DataFrame, after: Column, upto: Column) -> DataFrame:
    """Rows created or deleted after one time and no later than another."""
    inside = [(F.col(c) > after) & (F.col(c) <= upto) for c in ("created", "deleted")]
    return df.where(reduce(or_, [F.coalesce(x, F.lit(False)) for x in inside]))


def valid(df: DataFrame) -> DataFrame:
    return df.where("valid")


def id_range(df: DataFrame, start: int, end: int | None, column: str = "id") -> DataFrame:
    """Rows with start <= id < end; no end for the last chunk."""
    got = df.where(F.col(column) >= start)
    return got if end is None else got.where(F.col(column) < end)


def any_root_missing(df: DataFrame, roots: list[str]) -> DataFrame:
    return df.where(reduce(or_, [F.col(c).isNull() for c in roots]))


def all_roots_missing(df: DataFrame, roots: list[str]) -> DataFrame:
    return df.where(reduce(and_, [F.col(c).isNull() | (F.col(c) == 0) for c in roots]))


def with_roots(df: DataFrame, roots: list[str], values: list[int]) -> DataFrame:
    """Rows of which any root column holds one of the values."""
    return df.where(reduce(or_, [F.coalesce(F.col(c).isin(values), F.lit(False)) for c in roots]))


def without_zero(df: DataFrame, root: str) -> DataFrame:
    return df.where(F.col(root) != 0)


def without_lookup(df: DataFrame, supervoxels: list[str], sentinel: int = 1) -> tuple[DataFrame, DataFrame]:
    """Rows whose supervoxels are all known, and a one-row count of the others."""
    missing = reduce(or_, [F.col(c) == sentinel for c in supervoxels])
    return df.where(~missing), df.agg(F.count_if(missing).alias("n_missing"))


def hash_sampled(df: DataFrame, point: str, factor: int) -> DataFrame:
    """A deterministic share of the rows by their point's digest, about one in ``factor``."""
    x, y, z = (F.col(f"{point}_{a}") for a in "xyz")
    return df.where(scalar.sample_value(x, y, z) % F.lit(factor) == 0)


def sample_factor(rows: int, max_points: int) -> int:
    return max(2, int(rows / max_points))


def sampling(rows: int, max_points: int, volume_share: float = 1.0) -> tuple[str, float]:
    """How to bring a cell down to ``max_points``: ("none", 100), ("percent", p) or ("hash", factor)."""
    if rows <= 0:
        return "none", 100.0
    pct = max_points * 100.0 / (rows * volume_share)
    if pct >= 100:
        return "none", 100.0
    return ("percent", pct) if pct < 5 else ("hash", float(sample_factor(int(rows * volume_share), max_points)))


def share_sampled(df: DataFrame, pct: float, seed: int = 42, key: str = "id") -> DataFrame:
    """About ``pct`` of a hundred rows, drawn by their key and the seed alone."""
    return df.where(scalar.drawn(F.col(key), seed) < F.lit(int(pct / 100 * 2**32)))


def percent_sampled(df: DataFrame, wanted: int, stored_rows: int, seed: int = 42, key: str = "id") -> DataFrame:
    """About ``wanted`` rows of a table by its stored row count; all of them if it has no more.

    Each row is drawn by its key and the seed alone, so the same rows come however the table is
    split; a table without the key is left to Spark's sampler.
    """
    if wanted >= stored_rows:
        return df
    pct = wanted * 100.0 / stored_rows
    if not 0 < pct <= 100:
        raise FilterError(f"not a percentage: {pct}")
    if key not in df.columns:
        return df.sample(fraction=pct / 100, seed=seed)
    return share_sampled(df, pct, seed, key)


def apply(df: DataFrame, filters: dict[str, dict]) -> DataFrame:
    """Filters by kind and column: {"equal": {c: v}, "in": {c: [..]}, "box": {point: (low, high)}, ...}."""
    for kind, by_column in filters.items():
        for column, value in (by_column or {}).items():
            if kind in _COMPARE:
                df = compare(df, kind, column, value)
            elif kind == "in":
                df = is_in(df, column, value)
            elif kind in ("notin", "out"):
                df = not_in(df, column, value)
            elif kind == "regex":
                df = matches(df, column, value)
            elif kind == "box":
                df = box(df, column, *value)
            else:
                raise FilterError(f"no filter {kind!r}")
    return df
