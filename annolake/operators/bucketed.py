"""Tables that lie alike: files by a hash of the id, so that tables of the same ids join where they lie.

Files of bucket b hold the ids of which Spark's hash gives b, sorted by id. A table's versions are folders
``v=N``, of which each holds only the buckets that the version rewrote; ``{path}.buckets`` notes them
(v, bucket) once the version is whole. A bucket's rows are those of its newest noted version.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..store import children, exists, remove


def bucket_of(n: int, key: str = "id") -> Column:
    return F.pmod(F.hash(key), F.lit(n))


def _noted(spark: SparkSession, path: str) -> dict[int, int]:
    """The newest version of each bucket, of those that versions noted at their end."""
    if not exists(spark, f"{path}.buckets"):
        return {}
    rows = spark.read.schema("v int, bucket int").parquet(f"{path}.buckets")
    return {r["bucket"]: r["v"] for r in rows.groupBy("bucket").agg(F.max("v").alias("v")).collect()}  # a row a bucket


def _registered(spark: SparkSession, path: str, schema: StructType, n: int, key: str) -> str:
    """A name in the catalogue for the files under ``path`` as a bucketed table, whose folders tell its versions."""
    own = spark.newSession()  # how the folders are known is no setting of the caller's session
    own.conf.set("spark.sql.hive.manageFilesourcePartitions", "false")
    name = f"bucketed_{uuid.uuid4().hex}"
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    own.sql(f"CREATE TABLE {name} ({cols}, v INT) USING parquet PARTITIONED BY (v) CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {n} BUCKETS LOCATION '{path}'")
    return name


def _write(df: DataFrame, path: str, n: int, key: str, version: int, buckets: list[int]) -> None:
    """Write one version's buckets, a file each, then note them."""
    spark = df.sparkSession
    name = _registered(spark, path, df.schema, n, key)
    try:
        rows = df.withColumn("v", F.lit(version)).repartition(n, key)
        rows.write.format("parquet").mode("append").partitionBy("v").bucketBy(n, key).sortBy(key).saveAsTable(name)
    finally:
        spark.sql(f"DROP TABLE {name}")
    spark.createDataFrame([(version, b) for b in buckets], "v int, bucket int").coalesce(1).write.mode("append").parquet(f"{path}.buckets")


def create(df: DataFrame, path: str, n: int, key: str = "id") -> None:
    """Write a table in ``n`` buckets as its first version."""
    spark = df.sparkSession
    if exists(spark, path):
        raise FileExistsError(path)
    spark.createDataFrame([], df.schema).write.parquet(f"{path}.schema")
    _write(df, path, n, key, 1, list(range(n)))


def _schema(spark: SparkSession, path: str) -> StructType:
    return spark.read.parquet(f"{path}.schema").schema


def read(spark: SparkSession, path: str, n: int, key: str = "id") -> DataFrame:
    """The table's rows, as Spark knows them to lie: two such tables of as many buckets join by the key without a shuffle."""
    noted = _noted(spark, path)
    name = _registered(spark, path, _schema(spark, path), n, key)
    rows = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the plan holds the files, which are not the catalogue's
    newest = F.array(*[F.lit(noted.get(b, 0)) for b in range(n)])
    return rows.where(F.col("v").isin(sorted(set(noted.values()))) & (F.col("v") == F.get(newest, bucket_of(n, key)))).drop("v")


def update(spark: SparkSession, path: str, changes: DataFrame, n: int, key: str = "id") -> list[int]:
    """Put changed and new rows into a table: a next version of the buckets they fall into; gives those buckets.

    Only the files of these buckets are read, and only they are written anew. A version that stopped
    before it was noted is written over by the next one.
    """
    noted = _noted(spark, path)
    schema = _schema(spark, path)
    touched = sorted(r[0] for r in changes.select(bucket_of(n, key).alias("b")).distinct().collect())  # at most n
    if not touched:
        return []
    version = max(noted.values(), default=0) + 1
    for v in children(spark, path):
        if v == f"v={version}":
            remove(spark, f"{path}/{v}")
    files = []
    for v in sorted({noted[b] for b in touched if b in noted}):
        for f in children(spark, f"{path}/v={v}"):
            found = re.search(r"_(\d+)(?:\..*)?$", f)
            if found and noted.get(int(found[1])) == v and int(found[1]) in touched:
                files.append(f"{path}/v={v}/{f}")
    old = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    new = changes.select(*schema.names)
    rows = old.join(new.select(key), key, "left_anti").select(*schema.names).unionByName(new)
    _write(rows, path, n, key, version, touched)
    return touched
