"""Centroid clustering of integer vectors, with centroids filtered in a rotated space.

Vectors become integers (``floor(64 * x)``) once. The scatter matrix of all of them, summed by Spark,
gives the principal axes. What is stored of a vector is its integers, its coordinates along the
leading axes and the norm of the rest. For a centroid rotated alike, the squared distance of leading
coordinates plus the squared difference of the rests' norms is never more than the true squared
distance. So a vector measures, in integers, the centroid of the smallest bound, and then only those
whose bound is not above that distance; a slack far beyond rounding errors keeps the filter exact.

Each round a task sums its vectors by centroid and sends a row a centroid to the aggregation; only
centroids (``k`` rows) come to the driver.

Defined cases: vectors with another number of components, a null array, or a null or non-finite
component are left out; components beyond 2**24 in size count as 2**24, so that distances fit a long;
a null vec_id is assigned but starts no centroid; repeated rows count as often as they occur (copies
of a starting vector are several centroids, of which the first takes all rows); with fewer than ``k``
vectors each is a centroid; no vectors give no rows; sums beyond a long are its largest value; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Components of a vector, and what they are multiplied by before they are rounded down.
SIZE = 64
SCALE = 64
#: Largest component of an integer vector.
MOST = 1 << 24
#: Leading coordinates that are stored of a rotated vector.
LEAD = 8
CENTROIDS = 16
ROUNDS = 3
_BLOCK = 8192
_LONG = (1 << 63) - 1


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), kind).reshape(len(column), width)


def whole_numbers(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the vectors that count, as integers."""
    e = F.col("embedding")
    inside = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), np.float64, size)
            with np.errstate(over="ignore"):
                v = np.clip(np.floor(scale * x), -MOST, MOST).astype(np.int32)
            ends = pa.array(np.arange(0, v.size + 1, size, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], ["vec_id", "v"])

    return kept.where(F.coalesce((F.size(e) == size) & inside, F.lit(False))).mapInArrow(run, "vec_id long, v array<int>")


def axes(numbers: DataFrame, lead: int = LEAD, size: int = SIZE) -> np.ndarray:
    """The leading principal axes (rows), from the sums and products of all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(size), np.zeros((size, size))
        for b in batches:
            x = _matrix(b.column(0), np.float64, size)
            n, total, products = n + len(x), total + x.sum(axis=0), products + x.T @ x
        if n:
            i, j = np.divmod(np.arange(size * (size + 1)), size)  # a last row of sums
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.concatenate([products, total[None]]).ravel()), pa.array(np.full(len(i), n), pa.int64())], ["i", "j", "x", "n"])

    parts = numbers.select("v").mapInArrow(run, "i int, j int, x double, n long")
    rows = parts.groupBy("i", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()  # size * (size + 1) rows
    if not rows:
        return np.zeros((lead, size))
    sums = np.zeros((size + 1, size))
    for r in rows:
        sums[r["i"], r["j"]] = r["x"]
    mean = sums[size] / rows[0]["n"]
    _, vectors = np.linalg.eigh(sums[:size] / rows[0]["n"] - np.outer(mean, mean))
    return vectors[:, ::-1][:, :lead].T


def rotated(v: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates along the axes, and the norm of what they leave."""
    x = v.astype(np.float64)
    lead = x @ axes.T
    rest = x - lead @ axes
    return lead, np.sqrt((rest * rest).sum(axis=1))


def with_rotation(numbers: DataFrame, axes: np.ndarray, size: int = SIZE) -> DataFrame:
    """(vec_id, v, lead, rest) of integer vectors."""
    width = len(axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lead, rest = rotated(_matrix(b.column(1), np.int64, size), axes)
            ends = pa.array(np.arange(0, lead.size + 1, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, pa.array(lead.ravel())), pa.array(rest)], ["vec_id", "v", "lead", "rest"])

    return numbers.mapInArrow(run, "vec_id long, v array<int>, lead array<double>, rest double")


def nearest(v: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid of each vector (the smaller of equals), squared distance, and how many distances were measured."""
    c_lead, c_rest = rotated(centroids, axes)
    bound = np.zeros((len(v), len(centroids)))
    for d in range(lead.shape[1]):
        bound += np.square(lead[:, d, None] - c_lead[None, :, d])
    bound += np.square(rest[:, None] - c_rest[None, :])
    v_norm = np.square(lead).sum(axis=1) + rest * rest
    c_norm = np.square(c_lead).sum(axis=1) + c_rest * c_rest
    bound -= 1e-9 * (v_norm[:, None] + c_norm[None, :]) + 1e-3  # far more than rounding can amount to
    rows = np.arange(len(v))
    best = bound.argmin(axis=1)
    least = np.square(v - centroids[best]).sum(axis=1)
    measured = len(v)
    open_ = bound <= least[:, None]
    open_[rows, best] = False
    for k in np.flatnonzero(open_.any(axis=0)):
        at = np.flatnonzero(open_[:, k] & (bound[:, k] <= least))
        d = np.square(v[at] - centroids[k]).sum(axis=1)
        measured += len(at)
        better = (d < least[at]) | ((d == least[at]) & (k < best[at]))
        best[at[better]], least[at[better]] = k, d[better]
    return best, least, measured


def _blocks(b: pa.RecordBatch, size: int, width: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    for at in range(0, b.num_rows, _BLOCK):
        s = b.slice(at, _BLOCK)
        yield s.column(0), _matrix(s.column(1), np.int64, size), _matrix(s.column(2), np.float64, width), np.asarray(s.column(3))


def sums_by_centroid(stored: DataFrame, centroids: np.ndarray, axes: np.ndarray, size: int = SIZE) -> DataFrame:
    """(cluster, n, total) of the vectors nearest to each centroid, componentwise; no row for a centroid without any."""
    width = len(axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), size), np.int64)
        for b in batches:
            for _, v, lead, rest in _blocks(b, size, width):
                best, _, _ = nearest(v, lead, rest, centroids, axes)
                n += np.bincount(best, minlength=len(centroids))
                np.add.at(total, best, v)
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(n[k]), pa.array(total[k].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = stored.mapInArrow(run, "cluster int, n long, total array<long>")
    each = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(size)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *each).select("cluster", "n", F.array(*[f"t{i}" for i in range(size)]).alias("total"))


def assigned(stored: DataFrame, centroids: np.ndarray, axes: np.ndarray, size: int = SIZE) -> DataFrame:
    """(vec_id, cluster, distance, measured) of every vector; ``measured`` is a batch's number of measured
    distances, given with its first row.
    """
    width = len(axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, v, lead, rest in _blocks(b, size, width):
                best, least, measured = nearest(v, lead, rest, centroids, axes)
                counts = np.zeros(len(v), np.int64)
                counts[:1] = measured
                yield pa.RecordBatch.from_arrays([ids, pa.array(best, pa.int32()), pa.array(least), pa.array(counts)], ["vec_id", "cluster", "distance", "measured"])

    return stored.mapInArrow(run, "vec_id long, cluster int, distance long, measured long")


def first_centroids(stored: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The vectors of the ``k`` smallest digests of ``1:<vec_id>``, in their order."""
    digest = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = stored.where("vec_id IS NOT NULL").select(digest.alias("d"), "v").orderBy("d", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), SIZE)


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, lead: int = LEAD) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, measured) of every vector that counts, and the final centroids."""
    numbers = written(whole_numbers(vectors), "centroids-numbers")
    rotation = axes(numbers, lead)
    stored = written(with_rotation(numbers, rotation), "centroids-stored")
    centroids = first_centroids(stored, k)
    if not len(centroids):
        return stored.limit(0).selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS measured"), centroids
    for _ in range(rounds):
        moved = centroids.copy()
        for r in sums_by_centroid(stored, centroids, rotation).collect():  # a row a centroid
            moved[r["cluster"]] = [int(t) // r["n"] for t in r["total"]]
        centroids = moved
    return written(assigned(stored, centroids, rotation), "centroids-assigned"), centroids


def op12_rotated_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of ``embeddings`` after three rounds, with each cluster's inertia and centroid."""
    found, centroids = clustered(table(spark, sf_dir, "embeddings"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    names = spark.createDataFrame(list(enumerate(digests)), "cluster int, centroid_sha256 string")
    whole = lambda c: F.least(c, F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    by = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("s")).join(F.broadcast(names), "cluster")
    total = by.agg(F.sum("s").alias("all"))
    sums = by.crossJoin(F.broadcast(total)).select("cluster", whole(F.col("s")).alias("cluster_inertia"), whole(F.col("all")).alias("inertia"), "centroid_sha256")
    # a row a centroid
    return found.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The rounds as a chain of SQL tables: (vec_id, i, v) of components, (c, i, v) of centroids."""
    parts = [
        f"""whole AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE})""",
        f"comp AS (SELECT r, i, v[i] AS v FROM whole, generate_series(1, {SIZE}) g(i))",
        f"""start AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM whole ORDER BY sha256('1:' || vec_id) LIMIT {CENTROIDS})""",
        f"cent0 AS (SELECT c, i, v[i] AS v FROM start, generate_series(1, {SIZE}) g(i))",
    ]
    for k in range(ROUNDS + 1):
        parts.append(f"""near{k} AS (SELECT r, c, d FROM (SELECT r, c, d, row_number() OVER (PARTITION BY r ORDER BY d, c) AS place FROM
 (SELECT comp.r, m.c, CAST(sum((comp.v - m.v) * (comp.v - m.v)) AS BIGINT) AS d FROM comp JOIN cent{k} m USING (i) GROUP BY ALL)) WHERE place = 1)""")
        if k < ROUNDS:
            parts.append(f"""cent{k + 1} AS (SELECT o.c, o.i, coalesce(n.v, o.v) AS v FROM cent{k} o LEFT JOIN
 (SELECT c, i, CAST(floor(CAST(sum(comp.v) AS DOUBLE) / count(*)) AS BIGINT) AS v FROM near{k} JOIN comp USING (r) GROUP BY c, i) n USING (c, i))""")
    last = f"""SELECT w.vec_id, CAST(n.c AS INTEGER) AS cluster, n.d AS distance, CAST(sum(n.d) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia,
 CAST(sum(n.d) OVER () AS BIGINT) AS inertia, s.h AS centroid_sha256 FROM near{ROUNDS} n JOIN whole w USING (r)
 JOIN (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS h FROM cent{ROUNDS} GROUP BY c) s ON s.c = n.c"""
    return "WITH " + ",\n".join(parts) + "\n" + last


OP12_SQL = _sql()
