"""Prefix trie of conversations by ROLLUP over positional turn columns.

A turn is a struct of a 120-bit digest of its role and text and its number of words. A conversation is
cut into blocks of ``BLOCK`` turns, a row each, with a column for each place and a key of all turns
before the block: an exclusive-or of the earlier blocks' hashes, two lanes of 64 bits. Grouping by
block, key and a ROLLUP of the places gives every prefix of every block in one aggregation, and
grouping_id tells its depth, so conversations of any length cost one pass and no loop.

Sums over a subtree need no walk from the leaves either. A node belongs to its smallest member, and
of a member's path the nodes that belong to it are the lower end. So what a subtree's distinct nodes
sum up to is what its members own, less what the smallest member owns above the node: a first rollup
finds owners, a second one adds what they own.

Places of turns are counted in two levels, ranges of (conversation, turn) and rows inside one, and
likewise the keys of blocks, so that a conversation of very many turns is no single task. Children
find a parent that very many share by a broadcast of the few such nodes. The ids of conversations that
end in one node are joined to texts by ranges first; only those texts meet in the node's digest,
one after another.

Defined cases: rows without a conv_id are no conversation's; a null turn comes first; turns of one
number are ordered by a digest of role and text; a repeated row is one more turn; null role and null
text are empty; long texts are digested where they lie; an empty table gives no node; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .neardup import HOT, looked_up

#: Turns of a block, a column each.
BLOCK = 8
#: Blocks of a conversation whose keys are summed at once.
SUPER = 1024
#: Ids that are joined to one text before they are shuffled to their node.
RUN = 4096
_NODE = ["depth", "q1", "q2"]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, t) of every turn; t: digest in two numbers (a, b) and words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    half = lambda at: F.conv(F.substring(said, at, 15), 16, 10).cast("long")
    words = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    rows = conversations.where("conv_id IS NOT NULL")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.struct(half(1).alias("a"), half(16).alias("b"), words.alias("words")).alias("t"))


def placed(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, t) of (conv_id, turn, t): places from 1 in the order of turns, nulls first."""
    spark = rows.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = written(rows.repartitionByRange(parts, "conv_id", "turn", "t").withColumn("part", F.spark_partition_id()), "trie-ranges")
    each = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    # conversations of more than one range: fewer than ranges, and their rows here fewer than twice as many
    over = each.groupBy("conv_id").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("conv_id")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = each.join(F.broadcast(over), "conv_id").select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "t"))
    at = dealt.withColumn("inside", inside).join(F.broadcast(base), ["conv_id", "part"], "left")
    return at.select("conv_id", (F.col("inside") + F.coalesce("base", F.lit(0))).alias("pos"), "t")


def with_shared_heads(rows: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations of which all but each ``every``-th begin with turns of that one: (conv_id, depth, t) and (conv_id, len).

    Conversation c takes the first h turns of c - c % every and goes on with its own after its first h,
    h being the CRC of its number by ``heads``.
    """
    known = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    known = known.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"))
    first = rows.where((F.col("conv_id") % every == 0) & (F.col("pos") < heads)).groupBy(F.col("conv_id").alias("base"))
    first = first.agg(*[F.max(F.when(F.col("pos") == i, F.col("t"))).alias(f"t{i}") for i in range(1, heads)])
    first = first.select("base", F.array_compact(F.array(*[f"t{i}" for i in range(1, heads)])).alias("head"))
    convs = known.join(first, "base", "left").withColumn("head", F.slice("head", 1, F.col("h").cast("int")))
    convs = convs.withColumn("k", F.greatest(F.lit(0), F.coalesce(F.size("head"), F.lit(0))).cast("long"))
    convs = written(convs.select("conv_id", "h", "k", "head", (F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("len")), "trie-conversations")
    own = rows.join(convs.select("conv_id", "h", "k"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "t")
    head = convs.select("conv_id", F.posexplode("head").alias("i", "t")).select("conv_id", (F.col("i") + 1).cast("long").alias("depth"), "t")
    return own.unionByName(head), convs.select("conv_id", "len")


def _hashes(size: int, s: Column) -> list[Column]:
    """Two lanes that stand for a block's first ``s`` turns."""
    depth = (F.col("b") * size + s).cast("long")
    return [F.xxhash64(F.lit(lane), "b", depth, *[F.when(s > i, F.col(f"t{i}")) for i in range(size)]) for lane in (1, 2)]


def _key(size: int, s: Column) -> list[Column]:
    """The key of the node that a block's first ``s`` turns lead to."""
    return [F.when(s > 0, F.col(p).bitwiseXOR(h)).otherwise(F.col(p)) for p, h in zip(("p1", "p2"), _hashes(size, s), strict=True)]


def blocks(rows: DataFrame, convs: DataFrame, size: int = BLOCK) -> DataFrame:
    """A row a block of a conversation: conv_id, b, t0 ..., p1 and p2 (key of the turns before), before
    (their words), words (of the block), len (turns of the conversation); a turnless one has an empty block.
    """
    each = rows.select("conv_id", F.expr(f"(depth - 1) DIV {size}").alias("b"), F.expr(f"CAST((depth - 1) % {size} AS INT)").alias("slot"), "t")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("b"), F.lit(-1).alias("slot"), F.lit(None).cast(rows.schema["t"].dataType).alias("t"))
    places = [F.max(F.when(F.col("slot") == i, F.col("t"))).alias(f"t{i}") for i in range(size)]
    wide = each.unionByName(root).groupBy("conv_id", "b").agg(*places, F.coalesce(F.sum("t.words"), F.lit(0)).alias("words"))
    h1, h2 = _hashes(size, F.lit(size))
    wide = written(wide.join(convs, "conv_id").withColumns({"h1": h1, "h2": h2, "sup": F.expr(f"b DIV {SUPER}")}), "trie-blocks")
    long = F.col("len") > size
    sums = {"s1": F.bit_xor("h1"), "s2": F.bit_xor("h2"), "s3": F.sum("words")}
    far = wide.where(long).groupBy("conv_id", "sup").agg(*[x.alias(c) for c, x in sums.items()])
    before = Window.partitionBy("conv_id").orderBy("sup").rowsBetween(Window.unboundedPreceding, -1)
    far = far.select("conv_id", "sup", F.bit_xor("s1").over(before).alias("s1"), F.bit_xor("s2").over(before).alias("s2"), F.sum("s3").over(before).alias("s3"))
    before = Window.partitionBy("conv_id", "sup").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    near = wide.where(long).withColumns({"p1": F.bit_xor("h1").over(before), "p2": F.bit_xor("h2").over(before), "before": F.sum("words").over(before)})
    both = near.join(far, ["conv_id", "sup"])
    add = {c: F.coalesce(c, F.lit(0)) for c in ("p1", "p2", "before", "s1", "s2", "s3")}
    both = both.withColumns({"p1": add["p1"].bitwiseXOR(add["s1"]), "p2": add["p2"].bitwiseXOR(add["s2"]), "before": add["before"] + add["s3"]}).drop("s1", "s2", "s3")
    short = wide.where(~long).withColumns({c: F.lit(0).cast("long") for c in ("p1", "p2", "before")})
    return short.unionByName(both).drop("h1", "h2", "sup")


def rolled(rows: DataFrame, size: int, sums: str) -> DataFrame:
    """A row a node: its depth and key, its parent's key (u1, u2), w (words of its turn), above (words of the
    turns before it), and ``sums`` over its members.
    """
    places = [f"t{i}" for i in range(size)]
    cols = ", ".join(places)
    sql = f"SELECT b, p1, p2, {cols}, CAST({size} - bit_count(grouping_id()) AS INT) AS s, min(before) AS before, {sums} FROM {{rows}} GROUP BY b, p1, p2, ROLLUP({cols})"
    every = rows.sparkSession.sql(sql, rows=rows)
    # the block itself is the node that the block before it ends in; only the first has its own, the root
    there = F.when(F.col("s") == 0, F.col("b") == 0).otherwise(F.get(F.array(*places), F.col("s") - 1).isNotNull())
    q, u = _key(size, F.col("s")), _key(size, F.col("s") - 1)
    words = [F.when(F.col("s") - 1 > i, F.col(f"t{i}.words")).otherwise(0) for i in range(size)]
    own = [c for c in every.columns if c not in ("b", "p1", "p2", "s", "before", *places)]
    return every.where(there).select(
        (F.col("b") * size + F.col("s")).cast("long").alias("depth"), q[0].alias("q1"), q[1].alias("q2"), u[0].alias("u1"), u[1].alias("u2"),
        F.coalesce(F.get(F.array(*places), F.col("s") - 1)["words"], F.lit(0)).alias("w"), (F.col("before") + sum(words, F.lit(0))).alias("above"), *own,
    )


def ends(rows: DataFrame, size: int) -> DataFrame:
    """(depth, q1, q2, conv_id): the node in which each conversation ends."""
    last = rows.where(F.col("b") == F.greatest(F.lit(0), F.expr(f"(len - 1) DIV {size}")))
    q = _key(size, F.col("len") - F.col("b") * size)
    return last.select(F.col("len").alias("depth"), q[0].alias("q1"), q[1].alias("q2"), "conv_id")


def ends_digest(ended: DataFrame) -> DataFrame:
    """(depth, q1, q2, ends_sha256) of the ids that end in each node, ascending and joined by commas.

    Ids are joined to texts where a range of them lies. A digest takes its texts in order and keeps only
    its state; that one sequence is all of a node that meets in a task.
    """
    parts = max(8, int(ended.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, out = None, [], []
        for b in batches:
            for *at, i in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if at != node or len(ids) >= RUN:
                    if ids:
                        out.append((*node, ids[0], ",".join(map(str, ids))))
                    node, ids = at, []
                ids.append(i)
            yield _batch(out, ["depth", "q1", "q2", "first", "ids"])
            out = []
        if ids:
            yield _batch([(*node, ids[0], ",".join(map(str, ids)))], ["depth", "q1", "q2", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for b in batches:
            for *at, _, ids in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if at != node:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = at, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _batch(out, ["depth", "q1", "q2", "ends_sha256"])
            out = []
        if node:
            yield _batch([(*node, state.hexdigest())], ["depth", "q1", "q2", "ends_sha256"])

    dealt = ended.select(*_NODE, "conv_id").repartitionByRange(parts, *_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id")
    joined = dealt.mapInArrow(runs, "depth long, q1 long, q2 long, first long, ids string")
    return joined.repartition(parts, *_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(digests, "depth long, q1 long, q2 long, ends_sha256 string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"ids": pa.string(), "ends_sha256": pa.string()}
    cols = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, cols, strict=True)], names)


def prefix_trie(rows: DataFrame, convs: DataFrame, size: int = BLOCK) -> DataFrame:
    """A row a node of the trie of conversations (conv_id, depth from 1, t), all of them in ``convs`` (conv_id, len).

    conv_id (smallest member), depth, q1 and q2 (the node's key), parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256.
    """
    cut = written(blocks(rows, convs, size), "trie-cut")
    nodes = written(rolled(cut, size, "min(conv_id) AS conv_id, max(len) AS longest"), "trie-owners")
    # what a conversation owns, and the words of its path above that
    own = nodes.groupBy("conv_id").agg(F.sum("w").alias("owned"), F.count_if(F.col("longest") == F.col("depth")).alias("leaves"), F.min("above").alias("unowned"))
    total = cut.groupBy("conv_id").agg(F.sum("words").alias("total"))
    of_conv = total.join(own, "conv_id", "left").fillna(0, ["owned", "leaves", "unowned"])
    sums = "min(conv_id) AS conv_id, count(*) AS n_convs, sum(total) AS total, sum(owned) AS owned, sum(leaves) AS n_leaves, min_by(unowned, conv_id) AS unowned"
    nodes = rolled(cut.join(of_conv, "conv_id"), size, sums)
    saved = F.col("total") - F.col("n_convs") * F.col("above") - F.col("owned") + F.col("above") - F.col("unowned")
    nodes = written(nodes.select(*_NODE, "u1", "u2", "conv_id", "n_convs", "n_leaves", saved.alias("saved_tokens")), "trie-sums")
    up = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("u1").alias("q1"), F.col("u2").alias("q2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(up, _NODE, "left").fillna(0, ["n_children"]).join(ends_digest(ends(cut, size)), _NODE, "left")
    nodes = written(nodes.fillna(hashlib.sha256().hexdigest(), ["ends_sha256"]), "trie-nodes")
    count = nodes.count()
    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("q1").alias("u1"), F.col("q2").alias("u2"), F.col("conv_id").alias("parent_conv_id"), (F.col("n_children") > HOT * count).alias("hot"))
    below = looked_up(nodes.where("depth > 0"), parents, ["depth", "u1", "u2"])
    root = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    cols = ["conv_id", *_NODE, "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return below.select(*cols).unionByName(root.select(*cols))


def op13_prefix_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of ``conversations`` whose heads are shared by twenties."""
    rows, convs = with_shared_heads(placed(turns(table(spark, sf_dir, "conversations"))))
    return prefix_trie(rows, convs).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
 lambda c, x: list_reduce(list_prepend(xor(c, x), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))))"""

OP13_SQL = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, 0 AS sec, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h
), path AS (
  SELECT c.conv_id, coalesce(q.p, []) AS p FROM c LEFT JOIN (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY sec, pos) AS p FROM r GROUP BY conv_id) q USING (conv_id)
), member AS (SELECT conv_id, d, p[1:d] AS pre, len(p) AS ends FROM path, generate_series(0, len(p)) g(d)
), node AS (
  SELECT d, pre, min(conv_id) AS conv_id, count(*) AS n_convs, max(ends) = d AS leaf, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends = d), '') AS ids,
    CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(pre[d].text, '[^\x20\x09-\x0D]+')) END AS words
  FROM member GROUP BY d, pre
), below AS (
  SELECT k, v.pre[1:k] AS pre, sum((n_convs - 1) * words) AS saved, count(*) FILTER (leaf) AS leaves, count(*) FILTER (v.d = k + 1) AS children
  FROM node v, generate_series(0, v.d) g(k) GROUP BY ALL
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, CAST(b.children AS BIGINT) AS n_children, CAST(b.leaves AS BIGINT) AS n_leaves,
  CAST(b.saved AS BIGINT) AS saved_tokens, sha256(n.ids) AS ends_sha256
FROM node n JOIN below b ON b.k = n.d AND b.pre = n.pre LEFT JOIN node u ON u.d = n.d - 1 AND u.pre = n.pre[1:n.d - 1]
"""
