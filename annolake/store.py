"""Where jobs write: folders that all executors share, tables written and read back, versioned tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder under ``spark.checkpoint.dir``. Where that is unset a folder of this machine
    serves a local session; on a cluster, whose executors could not see it, that is an error.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir")
    if not base:
        if conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows of ``df``, written to a shared folder and read back."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    """A path of the session's own file systems, and the file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there."""
    fs, p = _files(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no folder."""
    fs, p = _files(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _files(spark, path)
    fs.delete(p, True)


def whole_versions(spark: SparkSession, target: str) -> list[int]:
    """Numbers of a versioned table's versions that were written to their end, by their success marks."""
    found = [int(n[2:]) for n in children(spark, target) if n.startswith("v=") and n[2:].isdigit()]
    return [n for n in sorted(found) if exists(spark, f"{target}/v={n}/_SUCCESS")]


def current(spark: SparkSession, target: str) -> str:
    """The folder that holds a table's rows: its newest whole version, or itself if it has none."""
    found = whole_versions(spark, target)
    return f"{target}/v={found[-1]}" if found else target


def replace(df: DataFrame, target: str) -> str:
    """Write ``df`` as the next version of a table; readers see it once it is whole.

    At every moment one whole version is there: what stops in between leaves the version before, and
    the next attempt overwrites the unfinished one. Nothing is renamed. The version before stays, for
    readers that began with it; older ones, and files of a table without versions, are removed.
    """
    spark = df.sparkSession
    found = whole_versions(spark, target)
    n = found[-1] + 1 if found else 1
    df.write.mode("overwrite").parquet(f"{target}/v={n}")
    for name in children(spark, target):
        if name not in (f"v={n}", f"v={n - 1}"):
            remove(spark, f"{target}/{name}")
    return f"{target}/v={n}"
