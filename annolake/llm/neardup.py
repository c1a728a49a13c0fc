"""Near copies by MinHash with tensored banding.

Two small collections of hash tuples stand for each document. A table key is a pair of one tuple
from each, so ``tables[0] * tables[1]`` tables need only ``tables[0] + tables[1]`` tuples. Two
documents whose sets have similarity s meet with probability
``(1 - (1 - s**r)**m) * (1 - (1 - s**q)**n)``: at 0.8 and the defaults all but 0.0004 do, at 0.85
all but 0.00003. Every link is confirmed on the full sets.

Rows with equal sets are one node. A shingle that no other candidate node has is in no
intersection, so each node's number of own shingles bounds its similarity with any other, exactly.
In a table, a node is first compared only with the node of its bucket that has the least share of
own shingles - in a group of edited copies the one nearest their source. A node whose own shingles
rule out a link with every size that its bucket holds leaves it before that. In buckets whose nodes did
not join into one component, those outside the largest component are then compared with the nodes
of other components, as far as a tighter bound allows a link: two sets share no more than the
smaller number of frequent shingles and the common rare ones, of which a bitmap of rare shingles
tells the most there can be. So large groups cost a row a member and no link is lost.

What is known of a bucket is aggregated before it is shuffled and joined back to its rows, so a
bucket with very many nodes is no single task: adaptive execution splits such a key's rows. Rows find
the node of their set, and nodes the root of their component, without a hot key in a shuffle: the
fewer than 1 / ``HOT`` sets or components that hold more than that share of them are broadcast.

Defined cases: null and blank texts have no set and link with nothing; a text with fewer words than
a shingle is one shingle of the whole; rows that share a doc_id are one document, which links with
whatever any of its rows links with (``n_shingles`` is the row's own); a null doc_id is its own
document with a null component and is kept; of equal sets or shares the smaller id leads; repeated
rows are all kept or all not; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import bounded, small_or_shuffled, table, written
from .components import components

#: Tuples in either collection, and minhashes in a tuple of either.
TABLES = (12, 12)
TUPLE = (3, 3)
_BLOCK = 4096
#: Nodes that have a shingle up to which it counts as rare.
RARE = 64
#: 64-bit words of a node's bitmap of rare shingles.
WORDS = 4
#: A key with more than this share of a table's rows is hot; there are fewer such keys than 1 / HOT.
HOT = 0.001


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    k = min(width, n)
    acc = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        acc = (acc ^ h[i : n - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    return np.unique(acc)


def _multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    for shift in (32, 29):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
    return x[:count] | np.uint64(1), x[count:]


def _tuples(s: np.ndarray, tables: tuple[int, int], sizes: tuple[int, int]) -> tuple[list[int], list[int]]:
    """The two collections of a set: each entry folds a few minhashes into one number."""
    count = tables[0] * sizes[0] + tables[1] * sizes[1]
    mul, add = _multipliers(count)
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), _BLOCK):
        least = np.minimum(least, (s[at : at + _BLOCK, None] * mul + add).min(axis=0))
    out, at = [], 0
    for n, r in zip(tables, sizes, strict=True):
        part = least[at : at + n * r].reshape(n, r)
        acc = np.zeros(n, np.uint64)
        for i in range(r):
            acc = (acc ^ part[:, i]) * np.uint64(0x9E3779B97F4A7C15)
            acc ^= acc >> np.uint64(31)
        out.append(acc.view(np.int64).tolist())
        at += n * r
    return out[0], out[1]


def signatures(docs: DataFrame, width: int, tables: tuple[int, int] = TABLES, sizes: tuple[int, int] = TUPLE) -> DataFrame:
    """doc_id, h (the text's hash), n_shingles, a fingerprint of the set, and the two collections (null without a set)."""
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, f1, f2, left, right = [], [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, width)
                n.append(len(s))
                mixed = (s ^ (s >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                f1.append(int(mixed.sum(dtype=np.uint64).view(np.int64)) if len(s) else None)
                f2.append(int(np.bitwise_xor.reduce(mixed * mixed).view(np.int64)) if len(s) else None)
                x, y = _tuples(s, tables, sizes) if len(s) else (None, None)
                left.append(x)
                right.append(y)
            cols = [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(left, kind), pa.array(right, kind)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "h", "n_shingles", "f1", "f2", "left", "right"])

    schema = "doc_id long, h long, n_shingles long, f1 long, f2 long, left array<long>, right array<long>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    return rows.mapInArrow(run, schema)


def _bits(tables: tuple[int, int]) -> int:
    """Low bits of a key that hold its table's number."""
    return max(1, (tables[0] * tables[1] - 1).bit_length())


def buckets(nodes: DataFrame, tables: tuple[int, int] = TABLES) -> DataFrame:
    """(key, id, n) of every table bucket that holds two or more nodes; a key ends in its table's number."""
    left = nodes.select("id", "n", "right", F.posexplode("left").alias("i", "x"))
    pairs = left.select("id", "n", "i", "x", F.posexplode("right").alias("j", "y"))
    number = (F.col("i") * tables[1] + F.col("j")).cast("long")
    keys = pairs.select(F.shiftleft(F.xxhash64("i", "j", "x", "y"), _bits(tables)).bitwiseOR(number).alias("key"), "id", "n")
    shared = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    return keys.join(shared, "key", "left_semi").select("key", "id", "n")


def shingles(texts: DataFrame, width: int) -> DataFrame:
    """(id, s): a row a node and shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                sets = [shingle_set(t, width).view(np.int64) for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "s"])

    return texts.select("id", "text").mapInArrow(run, "id long, s array<long>").select("id", F.explode("s").alias("s"))


def own_shingles(texts: DataFrame, width: int) -> DataFrame:
    """(id, own): how many of a node's shingles no other node has; nodes without any are left out."""
    once = shingles(texts, width).groupBy("s").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("id")).where("k = 1")
    return once.groupBy("id").agg(F.count(F.lit(1)).alias("own"))


def rare_shingles(texts: DataFrame, width: int, most: int = RARE) -> DataFrame:
    """(id, few, rare, b0, b1, ...): how many of a node's shingles at most ``most`` nodes have, how many
    of those two or more have, and a bitmap of the latter by their hash.
    """
    each = shingles(texts, width)
    often = each.groupBy("s").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= most)
    bit = F.pmod(F.xxhash64("s"), F.lit(64 * WORDS))
    one = F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")
    rows = each.join(often, "s").withColumn("bit", bit).withColumn("one", one)
    bits = [F.coalesce(F.bit_or(F.when((F.col("k") > 1) & (F.floor(F.col("bit") / 64) == w), F.col("one"))), F.lit(0)).alias(f"b{w}") for w in range(WORDS)]
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("few"), F.count_if(F.col("k") > 1).alias("rare"), *bits)


def may_link(n: str, own: str, m: str, other: str, percent: int) -> Column:
    """Whether two sets of sizes n and m with so many shingles of their own can reach the similarity."""
    shared = F.least(F.col(n) - F.col(own), F.col(m) - F.col(other))
    return 100 * shared >= percent * (F.col(n) + F.col(m) - shared)


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity, each with ``linked``."""
    cols = "a long, b long, linked boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}

        def of(i: int, t: str) -> np.ndarray:
            if i not in sets:
                if len(sets) >= 64:
                    sets.clear()
                sets[i] = shingle_set(t, width)
            return sets[i]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            linked = []
            for i, j, s, t in zip(a, b, batch.column(2), batch.column(3), strict=True):
                x = sets[i] if i in sets else of(i, s.as_py())
                y = sets[j] if j in sets else of(j, t.as_py())
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    first = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("s")), "a")
    both = first.join(texts.select(F.col("id").alias("b"), F.col("text").alias("t")), "b")
    return both.select("a", "b", "s", "t").mapInArrow(run, cols)


def looked_up(rows: DataFrame, keyed: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` joined with ``keyed``, a row a key, whose ``hot`` tells the keys of more than ``HOT`` of all rows.

    Those, fewer than 1 / ``HOT``, are broadcast, and their rows stay where they are; the others are shuffled.
    """
    hot, rest = F.broadcast(keyed.where("hot").drop("hot")), keyed.where("NOT hot").drop("hot")
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(rest, on))


def near_copies(docs: DataFrame, width: int = 5, percent: int = 80, tables: tuple[int, int] = TABLES, sizes: tuple[int, int] = TUPLE) -> DataFrame:
    """A row a document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept.

    Documents link where ``100 * intersection >= percent * union`` of their ``width``-word shingles.
    """
    sig = written(signatures(bounded(docs), width, tables, sizes), "minhash-signatures")
    has_set = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    sets = sig.where(has_set)
    same_set = ["n_shingles", "f1", "f2"]
    hot = F.count(F.lit(1)) > HOT * sets.count()
    groups = sets.groupBy(*same_set).agg(F.min(F.struct("doc_id", "h", "left", "right")).alias("m"), hot.alias("hot"))
    nodes = written(
        groups.select(F.monotonically_increasing_id().alias("id"), *same_set, "hot", F.col("m.doc_id").alias("doc"), "m.h", "m.left", "m.right"), "minhash-nodes"
    )
    links = node_links(docs, nodes.withColumnRenamed("n_shingles", "n"), width, percent, tables)
    # rows that share a doc_id are one document: their nodes are linked
    of_row = looked_up(sets.select("doc_id", *same_set), nodes.select("id", *same_set, "hot"), same_set)
    of_row = written(of_row.select("doc_id", "n_shingles", "id"), "minhash-rows")
    shared = of_row.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z")
    both = of_row.join(shared, "doc_id").where("id <> a").select("a", F.col("id").alias("b"))
    labels = components(written(links.union(both), "minhash-links"))
    hot = F.count(F.lit(1)) > HOT * labels.count()
    roots = labels.join(nodes.select("id", "doc"), "id").groupBy("component").agg(F.min("doc").alias("root"), hot.alias("hot"))
    root_of = looked_up(labels, written(roots, "minhash-roots"), ["component"]).select("id", "root")
    found = nodes.select("id", "doc", "hot").join(root_of, "id", "left").select("id", F.coalesce("root", "doc").alias("component_id"), "hot")
    known = looked_up(of_row, written(found, "minhash-found"), ["id"]).select("doc_id", "n_shingles", "component_id")
    known = written(known, "minhash-known")
    # rows without a set: of a document that has other rows, or by themselves
    of_doc = known.groupBy("doc_id").agg(F.min("component_id").alias("c"))
    rest = sig.where(~has_set | F.col("doc_id").isNull()).select("doc_id", "n_shingles").join(of_doc, "doc_id", "left")
    out = known.unionByName(rest.select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def node_links(docs: DataFrame, nodes: DataFrame, width: int, percent: int, tables: tuple[int, int]) -> DataFrame:
    """Links (a, b) of nodes (id, n, doc, h, left, right) that give the components of all of them."""
    found = written(buckets(nodes, tables), "minhash-buckets")
    ids = written(nodes.select("id", "doc", "h").join(found.select("id").distinct(), "id", "left_semi"), "minhash-ids")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("h"), "text")
    texts = written(whole.join(small_or_shuffled(ids), ["doc", "h"]).groupBy("id").agg(F.min("text").alias("text")), "minhash-texts")
    own = small_or_shuffled(written(own_shingles(texts, width), "minhash-own"))
    with_own = written(found.join(own, "id", "left").select("key", "id", "n", F.coalesce("own", F.lit(0)).alias("own")), "minhash-own-rows")
    lead = with_own.groupBy("key").agg(
        F.min(F.struct((F.col("own") / F.col("n")).alias("share"), "id", "n", "own")).alias("lead"),
        F.min("n").alias("least"),
        F.max(100 * F.col("n") - (100 + percent) * F.col("own")).alias("most"),
    )
    lead = lead.select("key", "least", "most", F.col("lead.id").alias("leader"), F.col("lead.n").alias("m"), F.col("lead.own").alias("other"))
    # a node whose own shingles leave no room for a link with any size of its bucket is settled there
    room = ((100 + percent) * (F.col("n") - F.col("own")) >= percent * (F.col("n") + F.col("least"))) & (F.col("most") >= percent * F.col("n"))
    unsettled = written(with_own.join(lead, "key").where(room).drop("least", "most"), "minhash-unsettled")
    led = unsettled.where("id <> leader").where(may_link("n", "own", "m", "other", percent))
    pairs = led.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    tested = written(confirmed(pairs, texts, width, percent), "minhash-tested")
    links = tested.where("linked").select("a", "b")
    # buckets of more than one component: their nodes across components, not tested yet
    lab = unsettled.join(components(links), "id", "left").withColumn("c", F.coalesce("component", "id"))
    lab = written(lab.select("key", "id", "n", "c"), "minhash-labelled")
    parts = lab.groupBy("key", "c").agg(F.count(F.lit(1)).alias("k"))
    tops = parts.groupBy("key").agg(F.max_by("c", F.struct("k", "c")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    mixed = written(lab.join(tops.select("key", "top"), "key"), "minhash-mixed")
    some = written(mixed.select("id").distinct(), "minhash-ids")
    rare = written(rare_shingles(texts.join(small_or_shuffled(some), "id", "left_semi"), width), "minhash-rare")
    bits = [f"b{w}" for w in range(WORDS)]
    full = mixed.join(rare, "id", "left").select("key", "id", "n", "c", "top", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("few", "rare", *bits)])
    set_bits = sum((F.bit_count(x) for x in bits), F.lit(0))
    full = full.select("key", "id", "n", "c", "top", (F.col("n") - F.col("few")).alias("often"), "rare", (F.col("rare") - set_bits).alias("hidden"), *bits)
    # a pair meets in every table of a common left and a common right tuple: it is taken in the first
    tuples = written(nodes.select("id", "left", "right").join(small_or_shuffled(some), "id", "left_semi"), "minhash-tuples")
    full = written(full.join(tuples, "id"), "minhash-full")
    table = F.col("key").bitwiseAND(F.lit(2 ** _bits(tables) - 1))
    place = {"left": F.floor(table / tables[1]), "right": table % tables[1]}
    first = [F.array_position(F.zip_with(x, f"{x}2", lambda a, b: a == b), F.lit(True)) == at + 1 for x, at in place.items()]
    other = full.select("key", *[F.col(x).alias(f"{x}2") for x in full.columns if x not in ("key", "top")])
    # rare shingles that share a bit with another of their node are hidden: all of them may be common
    common = sum((F.bit_count(F.col(x).bitwiseAND(F.col(f"{x}2"))) for x in bits), F.lit(0))
    shared = F.least("often", "often2") + F.least("rare", "rare2", common + F.least("hidden", "hidden2"))
    strays = full.where("c <> top").join(other, "key").where("c <> c2 AND (c2 = top OR id < id2)")
    cross = strays.where((100 * shared >= percent * (F.col("n") + F.col("n2") - shared)) & first[0] & first[1])
    pairs = cross.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()
    rest = confirmed(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"), texts, width, percent)
    return links.union(rest.where("linked").select("a", "b"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, 0.8."""
    gone = written(near_copies(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct(), "minhash-gone")
    return docs.join(small_or_shuffled(gone), docs["doc_id"] == gone["gone_id"], "left_anti")


def op3_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies in ``documents``: two-word shingles, 0.8."""
    return near_copies(table(spark, sf_dir, "documents"), width=2)
