"""Points, grids, codes and text forms as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The steps that spread 21 bits so that two free bits follow each.
_SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def _spread(c: Column) -> Column:
    v = c.cast("long").bitwiseAND(F.lit(0x1FFFFF))
    for shift, mask in _SPREAD:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton(x: Column, y: Column, z: Column) -> Column:
    """Interleaved low 21 bits of each axis, x lowest; null if any axis is null."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1)).bitwiseOR(F.shiftleft(_spread(z), 2))


def scaled(c: Column, scale: float) -> Column:
    """A coordinate in units of ``scale``, rounded down."""
    return F.floor(c / F.lit(float(scale))).cast("long")


def chunk_of(c: Column, offset: float, resolution: float, size: float) -> Column:
    """The chunk along one axis that holds a coordinate given in nm."""
    return F.floor((c / F.lit(float(resolution)) - F.lit(float(offset))) / F.lit(float(size))).cast("long")


def cell_number(x: Column, y: Column, z: Column, ny: int, nz: int) -> Column:
    """Number of a grid cell, x first and z last varying."""
    return (x * F.lit(ny) + y) * F.lit(nz) + z


def cell_place(number: Column, ny: int, nz: int) -> tuple[Column, Column, Column]:
    """The inverse of ``cell_number``."""
    return (
        F.floor(number / F.lit(ny * nz)).cast("long"),
        F.pmod(F.floor(number / F.lit(nz)).cast("long"), F.lit(ny)),
        F.pmod(number, F.lit(nz)),
    )


def point_text(x: Column, y: Column, z: Column) -> Column:
    return F.format_string("POINTZ(%d %d %d)", x, y, z)


def drawn(key: Column, seed: int) -> Column:
    """A number from 0 to 2**32 - 1 that stands for a key and a seed; null keys have one, too."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def sample_value(x: Column, y: Column, z: Column) -> Column:
    """A row's place in a deterministic sample: weighted character codes of its point's MD5."""
    h = F.md5(F.format_string("POINT Z (%d %d %d)", x, y, z).cast("binary"))
    return sum((F.ascii(F.substring(h, i + 1, 1)) * w for i, w in enumerate((1000, 100, 10, 1))), F.lit(0))


def epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def parse_time(text: Column) -> Column:
    """A stored time in any of the usual forms, as UTC; null if none fits."""
    forms = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms])


def parse_bool(text: Column) -> Column:
    return text == F.lit("t")


def parse_point(text: Column) -> Column:
    """An array of three ints from "[x, y, z]" text; null unless there are exactly three numbers."""
    parts = F.split(F.regexp_replace(text, r"[\[\]()\s]", ""), ",")
    nums = F.transform(parts, lambda p: p.try_cast("double").try_cast("int"))
    return F.when((F.size(parts) == 3) & F.forall(nums, lambda v: v.isNotNull()), nums)


def range_bucket(c: Column, cuts: list) -> Column:
    """Bucket by cut points: right-closed, so a value equal to a cut lies below it; null stays null.

    Without cuts every row, null ones too, is in bucket 0. Few cuts are a sum of comparisons; in many
    the bucket is searched by halves, so a row costs the logarithm of their number.
    """
    if not cuts:
        return F.lit(0)
    n = len(cuts)
    if n <= 64:
        return sum(((c > F.lit(x)).cast("int") for x in cuts[1:]), (c > F.lit(cuts[0])).cast("int"))
    table = F.array(*map(F.lit, cuts))
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(table, at + step - 1) < c), at + step).otherwise(at))
    return F.when(c.isNotNull(), found)


def hash_bucket(c: Column, n: int) -> Column:
    """Bucket by a digest of the value's text, which other engines have, too; null values are in bucket 0."""
    if n <= 1:
        return F.lit(0)
    return F.coalesce(F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long") % n, F.lit(0)).cast("int")


def rounded(c: Column) -> Column:
    """A coordinate as queries give it: to the nearest, halves to even."""
    return F.rint(c).cast("int")


def truncated(c: Column) -> Column:
    """A coordinate as exports and ingestion give it."""
    return c.cast("int")


def label(form: str, *cols: Column) -> Column:
    """A row's label by a format of ``%s`` places."""
    return F.format_string(form, *[c.cast("string") for c in cols])


def _wkb(values: pd.Series) -> pd.DataFrame:
    """Points of a batch: those with the same header and length are decoded from one buffer."""
    rows = [None if b is None else bytes(b) for b in values]
    alike: dict[tuple[int, bytes], list[int]] = {}
    for i, b in enumerate(rows):
        if b is not None and len(b) >= 21:
            alike.setdefault((len(b), b[:5]), []).append(i)
    xyz = np.zeros((len(rows), 3), np.int64)
    known = np.zeros(len(rows), bool)
    for (size, head), at in alike.items():
        order = "<" if head[0] == 1 else ">"
        kind = int.from_bytes(head[1:5], "little" if order == "<" else "big")
        start = 9 if kind & 0x20000000 else 5  # a reference system comes first
        n = 3 if kind & 0x80000000 or kind // 1000 % 10 in (1, 3) else 2
        if start + 8 * n > size:
            continue
        raw = np.frombuffer(b"".join([rows[i] for i in at]), np.uint8).reshape(len(at), size)
        numbers = np.ascontiguousarray(raw[:, start : start + 8 * n]).view(f"{order}f8")
        fine = np.isfinite(numbers).all(axis=1)
        xyz[at, :n] = np.where(fine[:, None], numbers, 0)
        known[at] = fine
    out = pd.DataFrame(xyz, columns=["x", "y", "z"]).astype("Int32")
    return out.where(pd.Series(known), pd.NA)


@F.pandas_udf(T.StructType([T.StructField(a, T.IntegerType()) for a in "xyz"]))
def wkb_point(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Integer coordinates, truncated, of points in well-known binary form; nulls stay."""
    for v in values:
        yield _wkb(v)


def point_wkb(x: Column, y: Column, z: Column) -> Column:
    """Well-known binary of a point, big-endian: built of hexadecimal digits, without Python."""

    def eight(c: Column) -> Column:
        v = c.cast("long")
        # an integer below 2**53 as a double: exponent from its length in bits, mantissa shifted up
        bits = F.length(F.bin(F.abs(v)))
        mantissa = F.shiftleft(F.abs(v).bitwiseAND(F.expr("9223372036854775807")), 0)
        top = F.pow(F.lit(2.0), bits - 1).cast("long")
        frac = (mantissa - top) * F.pow(F.lit(2.0), F.lit(53) - bits).cast("long")
        word = F.shiftleft((bits + 1022).cast("long"), 52) + frac
        word = F.when(v == 0, F.lit(0)).otherwise(F.when(v < 0, word.bitwiseOR(F.expr("-9223372036854775808"))).otherwise(word))
        return F.lpad(F.hex(word), 16, "0")

    return F.unhex(F.concat(F.lit("00000003E9"), eight(x), eight(y), eight(z)))
