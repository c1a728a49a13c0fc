"""What the operators of this subpackage share: the shared folder, written tables, word splitting."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters and digits in lower case, bytes of other characters as they are, the rest a space.
ALNUM = bytes(
    (b + 32 if 65 <= b <= 90 else b) if (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else 32
    for b in range(256)
)


def alnum_words(text: str | None) -> list[bytes]:
    """Words of ASCII letters and digits and of all other characters, A-Z lowered, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(ALNUM).split()


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder for one run of an operator, under the folder that driver and executors share.

    It lies under ``spark.checkpoint.dir``. Where that is unset a folder of this machine serves a
    local session, as in tests; on a cluster, whose executors could not see it, that is an error.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir")
    if not base:
        if not conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """The rows of ``df``, written to the shared folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system for a folder that executors write to themselves, and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class RangeReader:
    """Ranges of a file's bytes: memory-mapped where the file system is local, else only what is asked for is read."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)

    def numbers(self, kind: np.dtype, start: int, count: int) -> np.ndarray:
        """``count`` numbers from the ``start``-th on."""
        size = kind.itemsize
        return np.frombuffer(self.file.read_at(count * size, start * size), kind) if count else np.empty(0, kind)


#: Ids up to this many (eight bytes each) may be broadcast; larger sets are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def small_or_shuffled(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """``ids`` with a broadcast hint if it counts at most ``most`` rows, else as it is."""
    return F.broadcast(ids) if ids.count() <= most else ids


#: Rows of a batch that goes to a Python worker: texts are long, so fewer than Spark's own 10,000.
BATCH_ROWS = 1000


def bounded(docs: DataFrame) -> DataFrame:
    """``docs``, after the session was told to hand texts to Python in batches of at most so many rows.

    The setting holds when the plan runs, so it stays; Spark itself bounds a batch's bytes (64 MB).
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
