"""Near copies by SimHash, found by deletion variants of two segments.

A fingerprint of 64 bits is cut into two segments. Of two fingerprints that differ in at most three
bits one segment differs in at most one: it is equal, or equal once that bit is left out. So each
distinct fingerprint is indexed under either segment as it is and under each of its variants with one
bit as a wildcard; an equality join of these keys finds every pair, and the bits tell whether it links.

A variant's bucket pairs only fingerprints that differ in the wildcard, so nobody meets twice under
one segment. A bucket whose pairs would exceed ``SMALL`` a member is cut further instead: the other
segment of its members is cut in two again, with the same argument for what is left of the three bits,
until eight bits are free, where a member has at most 2**8 partners. So work is bounded for each
member of a group of any size and no link is lost.

Defined cases: a null or blank text has fingerprint 0, which links like any other; texts with fewer
words than a shingle are one shingle; repeated shingles count as often as they occur; rows that share
a doc_id are one document, linked with whatever any of its rows links with; a null doc_id is its own
document with a null component, as in the other near-copy operator; repeated rows all come back; long
texts are hashed block by block; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import small_or_shuffled, table, written
from .components import components
from .neardup import HOT, looked_up

WIDTH = 3
SEED = 42
#: Bits in which linked fingerprints may differ: one of two segments differs in half of them at most.
BITS = 3
#: Partners of a bucket's member up to which its pairs are made at once.
SMALL = 32
#: Free bits from which on a bucket is not cut further.
LEAST = 8
_BLOCK = 65_536


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """A text's fingerprint as a signed number: bits set in over half of the hashes of its word shingles."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    k = min(width, n)
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[: n - k + 1].tolist()
    ends = (ends[k - 1 :] - 1).tolist()
    count = np.zeros(64, np.int64)
    for at in range(0, len(starts), _BLOCK):
        some = [whole[s:e] for s, e in zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK], strict=True)]
        h = np.fromiter(map(xxh64_intdigest, some, repeat(SEED)), np.uint64, len(some))
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * count > len(starts)).astype(np.uint8), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t.as_py(), width) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def variants(rows: DataFrame, free: int) -> DataFrame:
    """The next keys of bucketed rows (key, fp, at, wild, flag) with ``free`` bits free from bit ``at`` on.

    ``wild`` counts the wildcards that a bucket has used; its pairs take one member of either ``flag``
    (without wildcards all members have flag 0 and any two are a pair). A free half is taken as it is, and
    while two bits or more may still differ, with each of its bits as the wildcard.
    """
    half = free // 2
    of = rows.select("key", "fp", "at", "wild", "flag", F.explode(F.array(F.lit(0), F.lit(half))).alias("h"))
    of = of.withColumn("start", F.col("at") + F.col("h")).withColumn("part", F.expr(f"shiftrightunsigned(fp, start) & {(1 << half) - 1}L"))
    last = F.when(F.lit(BITS) - F.col("wild") >= 2, half).otherwise(0)
    each = of.withColumn("i", F.explode(F.sequence(F.lit(0), last)))
    bit = F.expr("CASE WHEN i > 0 THEN shiftrightunsigned(part, i - 1) & 1L ELSE 0L END")
    each = each.withColumn("bit", bit).withColumn("seen", F.expr("CASE WHEN i > 0 THEN part - shiftleft(bit, i - 1) ELSE part END"))
    # partners differ in every wildcard, so their flags and this bit are alike or unlike together
    alike = F.when((F.col("wild") > 0) & (F.col("i") > 0), F.col("flag").bitwiseXOR(F.col("bit"))).otherwise(0)
    return each.select(
        F.xxhash64("key", "start", "i", "seen", alike).alias("key"),
        "fp",
        (F.col("at") + (F.lit(half) - F.col("h"))).cast("int").alias("at"),
        (F.col("wild") + (F.col("i") > 0).cast("int")).alias("wild"),
        F.when((F.col("wild") == 0) & (F.col("i") > 0), F.col("bit")).otherwise(F.col("flag")).alias("flag"),
    )


def pairs(fps: DataFrame, small: int = SMALL) -> DataFrame:
    """(a, b) of distinct fingerprints (fp) that differ in at most ``BITS`` bits; a pair may come twice."""
    start = fps.select(F.lit(0).cast("long").alias("key"), "fp", F.lit(0).alias("at"), F.lit(0).alias("wild"), F.lit(0).cast("long").alias("flag"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS
    out, rows, free = None, start, 64
    while True:
        rows, free = variants(rows, free), free // 2
        held = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("flag").alias("n1"), F.max("wild").alias("wild"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        alive = (F.col("n") > 1) & ((F.col("wild") == 0) | ((F.col("n1") > 0) & (F.col("n1") < F.col("n"))))
        held = written(held.where(alive), "simhash-buckets")
        found = held.where("n = 2").select("a", "b").where(close)
        more = held.where("n > 2").withColumn("most", F.when(F.col("wild") == 0, F.col("n")).otherwise(F.least("n1", F.col("n") - F.col("n1"))))
        large = F.lit(False) if free <= LEAST else F.col("most") > small
        keys = more.select("key", large.alias("large"))
        rows = written(rows.join(small_or_shuffled(keys), "key"), "simhash-rows")
        left = rows.where("NOT large").select("key", "wild", "flag", F.col("fp").alias("a"))
        right = left.select("key", F.col("flag").alias("other"), F.col("a").alias("b"))
        opposite = F.expr("CASE WHEN wild = 0 THEN a < b ELSE flag = 0 AND other = 1 END")
        found = found.unionByName(left.join(right, "key").where(opposite & close).select("a", "b"))
        out = found if out is None else out.unionByName(found)
        rows = rows.where("large").drop("large")
        if free <= LEAST or not rows.limit(1).count():
            return out


def near_copies(docs: DataFrame, width: int = WIDTH, small: int = SMALL) -> DataFrame:
    """A row a document: doc_id, fp, component_id (smallest doc_id reachable), kept."""
    sig = written(fingerprints(docs, width), "simhash-fingerprints")
    rows = sig.where("doc_id IS NOT NULL")
    hot = F.count(F.lit(1)) > HOT * rows.count()
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("doc"), hot.alias("hot")), "simhash-nodes")
    # rows that share a doc_id are one document: their fingerprints are linked
    first = rows.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z")
    same = rows.join(first, "doc_id").where("fp <> a").select("a", F.col("fp").alias("b"))
    labels = components(written(pairs(nodes.select("fp"), small).unionByName(same), "simhash-links")).withColumnRenamed("id", "fp")
    hot = F.count(F.lit(1)) > HOT * labels.count()
    roots = labels.join(nodes.select("fp", "doc"), "fp").groupBy("component").agg(F.min("doc").alias("root"), hot.alias("hot"))
    root_of = looked_up(labels, written(roots, "simhash-roots"), ["component"]).select("fp", "root")
    found = nodes.join(root_of, "fp", "left").select("fp", F.coalesce("root", "doc").alias("component_id"), "hot")
    known = looked_up(rows, written(found, "simhash-found"), ["fp"]).select("doc_id", "fp", "component_id")
    alone = sig.where("doc_id IS NULL").select("doc_id", "fp", F.lit(None).cast("long").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def op11_deletion_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies in ``documents``: fingerprints of three-word shingles within three bits."""
    found = near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
