"""A volume of supervoxels as compressed blocks, and lookups that decode each block they need once.

A block of 64 x 64 x 64 voxels is keyed by the Morton code of its place and holds its supervoxels as one
compressed array; places without a supervoxel are 0. One with few of them holds their places and numbers. The blocks lie in buckets by their key, so that
points, dealt to their blocks, come to them: the shuffle carries points and keys, never voxels.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import bucketed

#: Bits of a block's edge.
BITS = 6
SIZE = 1 << (3 * BITS)
#: Voxels below which a block is stored by places.
SPARSE = SIZE // 8
#: Voxels below which a block is not compressed: many such blocks are written and looked up together.
FEW = 256
#: A voxel of a block that is not compressed.
_RAW = np.dtype([("at", "<i4"), ("sv", "<i8")])
#: Points that are looked up with one decoding of their block.
PER_PART = 65_536


def _place(axes: list[Column]) -> tuple[Column, Column]:
    """The block of a voxel, and its place there."""
    block = scalar.morton(*[F.shiftright(a, BITS) for a in axes])
    inside = [a.bitwiseAND(F.lit((1 << BITS) - 1)) for a in axes]
    return block, inside[0].bitwiseOR(F.shiftleft(inside[1], BITS)).bitwiseOR(F.shiftleft(inside[2], 2 * BITS))


def _encoded(at: np.ndarray, sv: np.ndarray) -> bytes:
    """A block's bytes: a letter for its form, then what is compressed."""
    if len(at) < SPARSE:
        order = np.argsort(at)
        return b"S" + zlib.compress(at[order].astype("<i4").tobytes() + sv[order].astype("<i8").tobytes(), 1)
    whole = np.zeros(SIZE, "<i8")
    whole[at] = sv
    return b"D" + zlib.compress(whole.tobytes(), 1)


def _looked_up(data: bytes, at: np.ndarray) -> np.ndarray:
    """Supervoxels at places of a block."""
    raw = zlib.decompress(data[1:])
    if data[:1] == b"D":
        return np.frombuffer(raw, "<i8")[at]
    n = len(raw) // 12
    places, sv = np.frombuffer(raw, "<i4", n), np.frombuffer(raw, "<i8", n, 4 * n)
    where = np.minimum(np.searchsorted(places, at), n - 1)
    return np.where(places[where] == at, sv[where], 0)


def _packed(at: np.ndarray, sv: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The bytes of many small blocks, one below another: a letter, then the voxels by place."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((at, row))
    voxels = np.empty(len(at), _RAW)
    voxels["at"], voxels["sv"] = at[order], sv[order]
    ends = np.cumsum(1 + sizes * _RAW.itemsize)
    starts = np.concatenate([[0], ends]).astype("<i4")
    raw = np.full(starts[-1], ord("R"), np.uint8)
    body = np.ones(len(raw), bool)
    body[starts[:-1]] = False
    raw[body] = voxels.view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(starts), pa.py_buffer(raw)])


def _looked_up_packed(data: pa.Array, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Supervoxels at places, so many for each of the small blocks one below another."""
    starts = np.frombuffer(data.buffers()[1], "<i4", len(data) + 1, 4 * data.offset)
    raw = np.frombuffer(data.buffers()[2], np.uint8)[starts[0] : starts[-1]]
    body = np.ones(len(raw), bool)
    body[starts[:-1] - starts[0]] = False
    voxels = np.ascontiguousarray(raw[body]).view(_RAW)
    row = np.repeat(np.arange(len(data), dtype=np.int64), (np.diff(starts) - 1) // _RAW.itemsize)
    places = row * SIZE + voxels["at"]  # ascending: blocks one below another, voxels by place
    asked = np.repeat(np.arange(len(data), dtype=np.int64), sizes) * SIZE + at
    where = np.minimum(np.searchsorted(places, asked), len(places) - 1)
    return np.where(places[where] == asked, voxels["sv"][where], 0)


def blocks(voxels: DataFrame) -> DataFrame:
    """(block, data) of voxels (vx, vy, vz, supervoxel_id); of several at one place the largest counts."""
    block, at = _place([F.col("vx"), F.col("vy"), F.col("vz")])
    rows = voxels.where("supervoxel_id IS NOT NULL AND vx IS NOT NULL AND vy IS NOT NULL AND vz IS NOT NULL")
    rows = rows.groupBy(block.alias("block"), at.cast("int").alias("at")).agg(F.max("supervoxel_id").alias("sv"))
    held = rows.groupBy("block").agg(F.collect_list(F.struct("at", "sv")).alias("v"))  # at most the places of a block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.asarray(b.column(1).value_lengths())
            for few in (True, False):
                some = b.filter(pa.array((sizes <= FEW) == few))
                if not some.num_rows:
                    continue
                v = some.column(1).flatten()
                at, sv, n = np.asarray(v.field("at")), np.asarray(v.field("sv")), sizes[(sizes <= FEW) == few]
                if few:
                    data = _packed(at, sv, n)
                else:
                    ends = np.cumsum(n)
                    data = pa.array([_encoded(at[e - k : e], sv[e - k : e]) for e, k in zip(ends, n, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(0), data], ["block", "data"])

    return held.mapInArrow(run, "block long, data binary")


def write(voxels: DataFrame, path: str, buckets: int) -> None:
    """Write a volume's blocks in buckets by their key."""
    bucketed.create(blocks(voxels), path, buckets, "block")


def supervoxels(spark: SparkSession, points: DataFrame, path: str, buckets: int) -> DataFrame:
    """(id, type, supervoxel_id) of points (id, type, vx, vy, vz) in a volume; 0 where it has none.

    A block's points are dealt to parts of about ``PER_PART``, a row each, so a block that very many points
    fall into is several rows, and each part decodes its block once.
    """
    block, at = _place([F.col("vx"), F.col("vy"), F.col("vz")])
    rows = points.select("id", "type", block.alias("block"), at.cast("int").alias("at"))
    parts = rows.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / PER_PART).alias("parts"))
    dealt = rows.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    held = dealt.groupBy("block", "part").agg(F.collect_list(F.struct("id", "type", "at")).alias("p"))
    with_data = held.join(bucketed.read(spark, path, buckets, "block"), "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column(1)
            first = np.asarray(pc.fill_null(pc.binary_slice(data, 0, 1), b"").cast(pa.string()).to_numpy(zero_copy_only=False))
            for kind in np.unique(first.astype("U1")).tolist():
                some = b.filter(pa.array(first == kind))
                p, sizes = some.column(0).flatten(), np.asarray(some.column(0).value_lengths())
                at = np.asarray(p.field("at"))
                if kind == "":  # no such block
                    found = np.zeros(len(at), np.int64)
                elif kind == "R":
                    found = _looked_up_packed(some.column(1), at, sizes)
                else:
                    ends = np.cumsum(sizes)
                    found = np.concatenate([_looked_up(d.as_py(), at[e - k : e]) for d, e, k in zip(some.column(1), ends, sizes, strict=True)])
                yield pa.RecordBatch.from_arrays([p.field("id"), p.field("type"), pa.array(found.astype(np.int64))], ["id", "type", "supervoxel_id"])

    return with_data.select("p", "data").mapInArrow(run, "id long, type string, supervoxel_id long")
