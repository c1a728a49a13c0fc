"""What each file of a clustered table holds, so that files are chosen before they are read.

A manifest lies beside its table: ``{path}.files`` has a row a file with its rows and the least and
largest key (a column, or the Morton code of a point), ``{path}.bloom`` the filters of chosen columns.
A filter is rows (column, bits, file, word, mask): ``bits`` is the filter's size, a power of two that
the file's distinct values determine, ``word`` the place of 64 bits of it. To ask for values, only the
words that they hash to are read, so neither tables nor filters pass through the driver, which sees
the names of the files that are left.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import AXES
from ..store import written

#: Bits of a filter for each distinct value, at least, and hashes of a value: about 0.0005 false positives.
BITS_PER_VALUE = 16
HASHES = 11
#: Ranges that a box is split into unless the caller says otherwise.
RANGES = 64
_AXIS_BITS = 21


def _spread(v: int) -> int:
    return sum(((v >> i) & 1) << (3 * i) for i in range(_AXIS_BITS))


def code_of(x: int, y: int, z: int) -> int:
    """The Morton code of one point, as ``functions.scalar.morton`` gives it."""
    return _spread(x) | _spread(y) << 1 | _spread(z) << 2


def morton_ranges(low: tuple[int, int, int], high: tuple[int, int, int], most: int = RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges of Morton codes, ends included, that cover a closed box of non-negative whole points.

    A box spans the codes of its two corners. Where those first differ, in a bit of one axis, the box is
    cut in two: the lower part ends at the largest code below the cut, the upper one begins at the
    smallest above it, and the codes between, which lie outside the box, are left out. The part that
    wastes most codes is cut next. Neighbouring ranges are put together.
    """
    top = (1 << _AXIS_BITS) - 1
    low, high = tuple(max(0, v) for v in low), tuple(min(top, v) for v in high)
    if any(a > b for a, b in zip(low, high, strict=True)):
        return []

    def part(lo: tuple, hi: tuple) -> tuple:
        first, last = code_of(*lo), code_of(*hi)
        inside = math.prod(b - a + 1 for a, b in zip(lo, hi, strict=True))
        return (inside - (last - first + 1), first, last, lo, hi)

    parts = [part(low, high)]
    while len(parts) < most and parts[0][0] < 0:
        _, first, last, lo, hi = heapq.heappop(parts)
        bit = (first ^ last).bit_length() - 1
        axis, place = bit % 3, bit // 3
        cut = hi[axis] >> place << place
        for a, b in ((lo, tuple(cut - 1 if k == axis else v for k, v in enumerate(hi))), (tuple(cut if k == axis else v for k, v in enumerate(lo)), hi)):
            heapq.heappush(parts, part(a, b))
    out: list[tuple[int, int]] = []
    for first, last in sorted((p[1], p[2]) for p in parts):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _positions(df: DataFrame, value: str, *keep: str) -> DataFrame:
    """(keep, bits, word, mask) of each place that a text value has in a filter of ``bits`` bits: from two hashes,
    of which the low 32 bits are taken, so that no sum overflows.
    """
    low = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))
    hashed = df.select(*keep, "bits", low(F.xxhash64(value)).alias("h1"), low(F.xxhash64(value, F.lit(1))).alias("h2"))
    each = hashed.select(*keep, "bits", "h1", "h2", F.explode(F.array(*map(F.lit, range(HASHES)))).alias("i"))
    at = each.select(*keep, "bits", (F.col("h1") * 31 + (F.col("i") + F.col("i") * F.col("i")) * F.col("h2")).bitwiseAND(F.col("bits") - 1).alias("at"))
    return at.select(*keep, "bits", F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, CAST(at & 63 AS INT))").alias("mask"))


def write(spark: SparkSession, path: str, schema: StructType, key: str, blooms: tuple[str, ...] = ()) -> None:
    """Write the manifest of the parquet files under ``path``: one aggregation by file over the key and the
    columns that get a filter, and one job for the filters. A null of the table's type tells its schema.
    """
    rows = spark.read.schema(schema).parquet(path).select(F.col("_metadata.file_path").alias("file"), F.col(key).alias("key"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(blooms)])
    distinct = [F.approx_count_distinct(f"c{i}", 0.02).alias(f"d{i}") for i in range(len(blooms))]
    files = rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("least"), F.max("key").alias("greatest"), *distinct)
    told = ("file", "rows", "least", "greatest", F.lit(None).cast(schema).alias("schema"))
    if not blooms:
        files.select(*told).write.parquet(f"{path}.files")
        return
    files = written(files, "files")
    files.select(*told).write.parquet(f"{path}.files")
    values = ", ".join(f"'{c}', CAST(c{i} AS STRING)" for i, c in enumerate(blooms))
    sizes = ", ".join(f"'{c}', d{i}" for i, c in enumerate(blooms))
    power = F.ceil(F.log2(F.greatest(F.lit(64.0), F.col("d") * float(BITS_PER_VALUE))))
    bits = files.selectExpr("file", f"stack({len(blooms)}, {sizes}) AS (column, d)").select("file", "column", F.pow(F.lit(2.0), power).cast("long").alias("bits"))
    each = rows.selectExpr("file", f"stack({len(blooms)}, {values}) AS (column, v)").where("v IS NOT NULL").distinct()
    # a file's filter is one row of ``bits``: small beside the values
    masks = _positions(each.join(bits, ["file", "column"]), "v", "column", "file").groupBy("column", "bits", "file", "word").agg(F.bit_or("mask").alias("mask"))
    masks.sortWithinPartitions("column", "bits", "word").write.parquet(f"{path}.bloom")


def _rows(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    """The rows of some of a table's files; the others are not even listed."""
    schema = spark.read.parquet(f"{path}.files").schema["schema"].dataType
    return spark.read.schema(schema).option("basePath", path).parquet(*files) if files else spark.createDataFrame([], schema)


def files_in_ranges(spark: SparkSession, path: str, ranges: list[tuple[int, int]]) -> list[str]:
    """Files that may hold a key in one of the ranges, ends included."""
    if not ranges:
        return []
    spans = spark.createDataFrame(ranges, "first long, last long")
    files = spark.read.parquet(f"{path}.files")
    hit = files.join(F.broadcast(spans), (F.col("least") <= F.col("last")) & (F.col("first") <= F.col("greatest")), "left_semi")  # as many spans as the caller allows
    return sorted(r[0] for r in hit.select("file").collect())


def may_hold(spark: SparkSession, path: str, column: str, values: DataFrame) -> DataFrame:
    """(value, file) of the values (value) of which a file's filter has every bit set."""
    asked = values.select("value").where("value IS NOT NULL").distinct().withColumn("text", F.col("value").cast("string"))
    masks = spark.read.parquet(f"{path}.bloom").where(F.col("column") == column)
    sizes = masks.select("bits").distinct()  # a few powers of two
    at = _positions(asked.crossJoin(F.broadcast(sizes)), "text", "value").withColumnRenamed("mask", "bit").distinct()
    need = at.groupBy("value", "bits").agg(F.count(F.lit(1)).alias("need"))
    hit = at.join(masks.select("bits", "word", "file", "mask"), ["bits", "word"]).where(F.col("mask").bitwiseAND(F.col("bit")) != 0)
    found = hit.groupBy("value", "bits", "file").agg(F.count(F.lit(1)).alias("have")).join(need, ["value", "bits"])
    return found.where("have = need").select("value", "file")


def false_positives(spark: SparkSession, path: str, column: str, values: DataFrame) -> DataFrame:
    """One row: pairs of a value and a file asked, those that the filters let through, those of them that hold no
    row, and those that hold one though the filters say no (never any).
    """
    through = may_hold(spark, path, column, values).withColumn("through", F.lit(True))
    there = spark.read.parquet(path).select(F.col(column).alias("value"), F.col("_metadata.file_path").alias("file"))
    held = there.join(values.select("value").distinct(), "value", "left_semi").distinct().withColumn("held", F.lit(True))
    both = through.join(held, ["value", "file"], "full")
    n_values = values.where("value IS NOT NULL").select(F.count_distinct("value").alias("v"))
    n_files = spark.read.parquet(f"{path}.files").agg(F.count(F.lit(1)).alias("f"))
    counts = both.agg(F.count_if("through").alias("passed"), F.count_if(F.col("through") & F.col("held").isNull()).alias("false_positives"), F.count_if(F.col("held") & F.col("through").isNull()).alias("missed"))
    return counts.crossJoin(n_values).crossJoin(n_files).select((F.col("v") * F.col("f")).alias("pairs"), "passed", "false_positives", "missed")  # one row each


def read_box(spark: SparkSession, path: str, point: str, low: tuple, high: tuple, most: int = RANGES) -> DataFrame:
    """Rows of a table along the Morton curve whose point lies in a half-open box: only files whose codes
    meet the box's ranges are read, and in them, by the codes' statistics, only the row groups that do.
    """
    whole = tuple(math.ceil(v) for v in low), tuple(math.ceil(v) - 1 for v in high)
    if max(whole[1]) >> _AXIS_BITS or min(whole[0]) < 0:
        raise ValueError(f"beyond the {_AXIS_BITS} bits of a code: {low}, {high}")
    ranges = morton_ranges(*whole, most)
    rows = _rows(spark, path, files_in_ranges(spark, path, ranges))
    code, within = F.col(f"{point}_morton"), F.lit(False)
    for first, last in ranges:
        within = within | code.between(first, last)
    if ranges:
        rows = rows.where(code.between(ranges[0][0], ranges[-1][1])).where(within)
    for a, lo, hi in zip(AXES, low, high, strict=True):
        rows = rows.where((F.col(f"{point}_{a}") >= lo) & (F.col(f"{point}_{a}") < hi))
    return rows


def read_values(spark: SparkSession, path: str, column: str, values: DataFrame) -> DataFrame:
    """Rows whose column is one of the values (value): only files whose filters let one through are read."""
    files = sorted(r[0] for r in may_hold(spark, path, column, values).select("file").distinct().collect())
    return _rows(spark, path, files).join(values.select(F.col("value").alias(column)).distinct(), column, "left_semi")
