"""Sets of aligned column files: each holds one column, or several side by side, as a plain array.

A set is a folder of ``.npy`` files; row i of every file belongs to row i of the table. A column may
lie in several files, each with the place of its first row. Files are read in chunks by tasks, and
written by tasks, each its own range of rows; column frames are glued by the row's place. The driver
sees headers and the list of files only.
"""

from __future__ import annotations

import ast
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import written


@dataclass(frozen=True)
class ColumnFile:
    """One file, the columns it holds, where its numbers begin, and the row its first one belongs to."""

    path: str
    columns: tuple[str, ...]
    rows: int
    kind: str
    fortran: bool
    start: int
    first: int = 0


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return fs.open_input_file(path)


def describe(uri: str, columns: tuple[str, ...], first: int = 0) -> ColumnFile:
    """Read a file's header only."""
    with _open(uri) as f:
        head = f.read(128)
        major = head[6]
        size, at = (int.from_bytes(head[8:10], "little"), 10) if major == 1 else (int.from_bytes(head[8:12], "little"), 12)
        f.seek(at)
        said = f.read(size).decode("latin-1")
    fields = ast.literal_eval(said.strip())
    shape = fields["shape"]
    width = shape[1] if len(shape) > 1 else 1
    if width != len(columns):
        raise ValueError(f"{uri} has {width} columns; {len(columns)} are named")
    return ColumnFile(uri, tuple(columns), shape[0], fields["descr"], fields["fortran_order"], at + size, first)


_FACTS = "file int, path string, kind string, fortran boolean, begin long, rows long, first long"


def chunks(spark: SparkSession, files: list[ColumnFile], size: int) -> DataFrame:
    """What tasks read: each file's facts with (start, length) of its chunks, which Spark derives from the rows."""
    facts = [(k, f.path, f.kind, f.fortran, f.start, f.rows, f.first) for k, f in enumerate(files)]
    starts = F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(size).cast("long"))
    each = spark.createDataFrame(facts, _FACTS).where("rows > 0").withColumn("start", F.explode(starts))
    return each.withColumn("length", F.least(F.lit(size).cast("long"), F.col("rows") - F.col("start")))


#: Rows that a task reads, about; chunks are smaller pieces of it, each read at once.
TASK_ROWS = 1_000_000


def read(spark: SparkSession, files: list[ColumnFile], size: int = 1_000_000) -> DataFrame:
    """row_idx and all columns; columns of different lengths are an error."""
    sets: dict[tuple[str, ...], list[int]] = {}
    for k, f in enumerate(files):
        sets.setdefault(f.columns, []).append(k)
    lengths = {c: sum(files[k].rows for k in own) for c, own in sets.items()}
    if len(set(lengths.values())) > 1:
        raise ValueError("column files differ in length: " + ", ".join(f"{'/'.join(c)} {n}" for c, n in lengths.items()))
    out = None
    for columns, own in sets.items():
        whole = all(np.dtype(files[k].kind).kind in "iub" for k in own)
        kind = pa.int64() if whole else pa.float64()

        def run(batches: Iterator[pa.RecordBatch], kind: pa.DataType = kind, columns: tuple[str, ...] = columns) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for c in b.to_pylist():
                    item, n, s, m, begin = np.dtype(c["kind"]), len(columns), c["start"], c["length"], c["begin"]
                    with _open(c["path"]) as file:
                        if c["fortran"] or n == 1:
                            cols = [np.frombuffer(file.read_at(m * item.itemsize, begin + (i * c["rows"] + s) * item.itemsize), item) for i in range(n)]
                        else:
                            block = np.frombuffer(file.read_at(m * n * item.itemsize, begin + s * n * item.itemsize), item).reshape(m, n)
                            cols = [block[:, i] for i in range(n)]
                    arrays = [pa.array(np.arange(c["first"] + s, c["first"] + s + m)), *[pa.array(np.ascontiguousarray(x)).cast(kind) for x in cols]]
                    yield pa.RecordBatch.from_arrays(arrays, ["row_idx", *columns])

        schema = "row_idx long, " + ", ".join(f"`{c}` {'long' if whole else 'double'}" for c in columns)
        mine = [files[k] for k in own]
        tasks = -(-lengths[columns] // max(size, TASK_ROWS))
        few = int(spark.conf.get("spark.sql.shuffle.partitions"))
        one = chunks(spark, mine, size).repartition(max(1, tasks, min(few, sum(-(-f.rows // size) for f in mine))), "file", "start").mapInArrow(run, schema)
        # what tasks read is far larger than the list of chunks that Spark knows the size of: never broadcast
        out = one if out is None else out.join(one.hint("merge"), "row_idx")
    return out


def split(df: DataFrame, annotation: dict[str, str], segmentation: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Annotation and segmentation rows: our column -> the files' column."""
    return tuple(df.select(*[F.col(c).alias(a) for a, c in m.items()]) for m in (annotation, segmentation))


def missing_chunks(spark: SparkSession, ids: DataFrame, files: list[ColumnFile], size: int, loaded: DataFrame) -> DataFrame:
    """Starts of chunks whose first id is not in the table: those to be inserted again."""
    heads = ids.where(F.col("row_idx") % size == 0).select(F.col("row_idx").alias("start"), "id")
    return heads.join(loaded.select("id"), "id", "left_anti").select("start")


#: Rows of a written file.
FILE_ROWS = 1_000_000


def write(df: DataFrame, folder: str, name: str, columns: list[str], fortran: bool = False, file_rows: int = FILE_ROWS) -> list[ColumnFile]:
    """A table's columns side by side, in the order of ``row_idx`` (0, 1, ... without gaps), as files of
    ``file_rows`` rows. Each is written by the task that has its rows, under a name of the attempt's
    own; files of attempts that failed are not among those returned.
    """
    kind = "<i8"
    files = F.floor(F.col("row_idx") / file_rows).cast("long")
    rows = df.select(files.alias("file"), "row_idx", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        fs.create_dir(path, recursive=True)
        now, held = None, []

        def put() -> pa.RecordBatch:
            block = np.concatenate(held)
            shape = block.shape if len(columns) > 1 else (len(block),)
            head = str({"descr": kind, "fortran_order": fortran, "shape": shape}).encode("latin-1")
            head += b" " * (-(len(head) + 11) % 64) + b"\n"
            own = f"{name}-{now:08d}-{uuid.uuid4().hex}.npy"
            with fs.open_output_stream(f"{path}/{own}") as f:
                f.write(b"\x93NUMPY\x01\x00" + len(head).to_bytes(2, "little") + head)
                f.write(np.asarray(block, kind).tobytes("F" if fortran else "C"))
            facts = [[own], [now * file_rows], [len(block)], [10 + len(head)]]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in facts], ["name", "first", "rows", "start"])

        for b in batches:
            block = np.stack([np.asarray(b.column(c).cast(pa.int64())) for c in columns], 1)
            of = np.asarray(b.column("file"))
            for x in np.unique(of).tolist():  # ascending: rows are sorted
                if x != now and held:
                    yield put()
                    held = []
                now = x
                held.append(block[of == x])
        if held:
            yield put()

    dealt = rows.repartition("file").sortWithinPartitions("file", "row_idx").drop("row_idx")
    made = written(dealt.mapInArrow(run, "name string, first long, rows long, start long"), "column-files")
    return [ColumnFile(f"{folder}/{r['name']}", tuple(columns), r["rows"], kind, fortran, r["start"], r["first"]) for r in made.orderBy("first").collect()]
