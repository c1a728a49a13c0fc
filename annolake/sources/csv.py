"""Annotations from CSV files, and dumps to them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import scalar
from ..operators import aggregates
from ..schema import AXES, SchemaSpec
from ..store import exists


def read(spark: SparkSession, path: str) -> DataFrame:
    """All columns of a CSV as text."""
    return spark.read.csv(path, header=True)


def by_chunks(df: DataFrame, transform: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str) -> DataFrame:
    """``df`` after a function of pandas frames, which sees a batch of its rows at a time, in the tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return map(transform, frames)

    return df.mapInPandas(run, schema)


def ingest(raw: DataFrame, schema: SchemaSpec, mapping: dict[str, str | list[str]], created: str, ignore: tuple[str, ...] = (), counter: int = 0, order: str | None = None, transform=None) -> DataFrame:
    """Annotations of a schema from text columns.

    ``mapping``: our column or point -> theirs; a point is one text column ("[x, y, z]") or three.
    Values that do not parse become null; edit columns are filled; ids continue from ``counter`` in
    the order of a column, or are the mapped ones. ``transform`` changes the raw frame first, as a
    whole or, with ``by_chunks``, a batch at a time.
    """
    if transform:
        raw = raw.transform(transform)
    raw = raw.drop(*ignore)
    required = [f"{p}_position" for p in schema.points] + (["target_id"] if schema.reference else [])
    lacking = [c for c in required if c not in mapping]
    theirs = [c for v in mapping.values() for c in (v if isinstance(v, list) else [v])]
    lacking += [c for c in theirs if c not in raw.columns]
    if lacking:
        raise KeyError(f"required columns are not there: {', '.join(lacking)}")
    cols = {}
    for p in schema.points:
        name, source = f"{p}_position", mapping[f"{p}_position"]
        if isinstance(source, list):
            parts = [F.col(s).try_cast("double").try_cast("int") for s in source]
            known = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull()
            xyz = [F.when(known, x) for x in parts]
        else:
            point = scalar.parse_point(F.col(source))
            xyz = [point[i] for i in range(3)]
        cols |= {f"{name}_{a}": x for a, x in zip(AXES, xyz, strict=True)}
    kinds = dict(schema.scalars) | ({"target_id": "long"} if schema.reference else {})
    cols |= {c: F.col(mapping[c]).try_cast(k) if c in mapping else F.lit(None).cast(k) for c, k in kinds.items()}
    if "id" in mapping:
        rows = raw.withColumn("_id", F.col(mapping["id"]).try_cast("long"))
    elif order:
        numbered = aggregates.numbered(raw.withColumn("_order", F.col(order).try_cast("double")), counter, "_order")
        rows = numbered.withColumn("_id", F.col("id"))
    else:
        rows = raw.withColumn("_id", F.lit(counter) + 1 + F.monotonically_increasing_id())
    crud = {
        "id": F.col("_id"),
        "created": F.lit(created).cast("timestamp_ntz"),
        "deleted": F.lit(None).cast("timestamp_ntz"),
        "superceded_id": F.lit(None).cast("long"),
        "valid": F.lit(True),
    }
    found = crud | cols
    return rows.select(*[found[c].alias(c) for c in schema.annotation_columns()])


def with_points(df: DataFrame, schema: SchemaSpec) -> tuple[DataFrame, DataFrame]:
    """Rows that have all their points, and a one-row count of those dropped."""
    need = [c for c in schema.position_columns()]
    whole = df.dropna(subset=need) if need else df
    lost = df.agg(F.count_if(F.greatest(*[F.col(c).isNull() for c in need]) if len(need) > 1 else F.lit(False)).alias("n_dropped"))
    return whole, lost


def dump(df: DataFrame, path: str) -> bool:
    """Write compressed CSV and, beside it, its columns and types; nothing if the dump is there."""
    spark = df.sparkSession
    if exists(spark, path):
        return False
    df.write.csv(path, header=True, compression="gzip")
    kinds = spark.createDataFrame(df.dtypes, "column_name string, type string")
    kinds.coalesce(1).write.mode("overwrite").csv(f"{path}.schema", header=True)
    return True


def undump(spark: SparkSession, path: str) -> DataFrame:
    """A dump read back with its types."""
    kinds = spark.read.csv(f"{path}.schema", header=True).collect()
    types = {r[0]: r[1] for r in kinds}
    raw = spark.read.csv(path, header=True)
    return raw.select(*[F.col(c).cast(types[c]).alias(c) for c in raw.columns])
