"""Minimum-cost-flow resharding: the block transfers that move the fewest bytes.

A table lies in old shards. Given each new shard's capacity, a minimum-cost flow on the shards
(staying costs nothing, moving costs one a byte) says how many bytes go from where to where. The
flow has a node a shard, never one a document, so solving it on the driver is bounded by the number
of shards. Documents are grouped into blocks by a hash within their old shard; blocks are laid end
to end and cut where the flow says so. A block inside one interval moves whole; only the few blocks
that hold a cut are split, document by document.

A second, smaller flow then evens out what the cuts left over with the smallest documents of the
shards that are too full.

Only files of shards that lose or gain documents are rewritten, into a folder of their own: the old
files stay as they are until all is there, so a lost executor or a stopped job costs no data.

Defined cases: a null text counts as no bytes (size 1); a null or out-of-range old shard becomes
shard 0; capacities that hold less than there is are an error; repeated rows are placed one by one;
of rows of equal size those with the smaller hash come first; an empty table gives no rows; a
table's own columns named ``shard`` or ``slot`` give way to the plan's, others are carried as they are.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, written

#: Blocks an old shard is cut into; the block totals (shards x blocks rows) stay small at any input.
BLOCKS = 1024
#: Blocks that rows of about one size in one shard are dealt to.
SALT = 64


def solve_flow(supply: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from old shard i to new shard j, moving as few as possible.

    Transport network source -> old -> new -> sink with cost 0 on i -> i and 1 elsewhere, solved by
    cheapest augmenting paths; costs are 0 and 1 only, so a deque serves as the queue.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError(f"the new shards take {sum(capacity)} bytes of {sum(supply)}")
    flow: dict[tuple[int, int], int] = {}
    left, room = list(supply), list(capacity)
    for i in range(min(n, m)):
        stay = min(left[i], room[i])
        if stay:
            flow[i, i] = stay
            left[i] -= stay
            room[i] -= stay
    while True:
        # cheapest path from a shard with bytes left to one with room, through moves already made
        cost = {("old", i): 0 for i in range(n) if left[i]}
        back: dict[tuple[str, int], tuple[str, int]] = {}
        queue = deque(cost)
        while queue:
            node = queue.popleft()
            side, i = node
            if side == "old":
                steps = [(("new", j), 0 if i == j else 1) for j in range(m)]
            else:
                steps = [(("old", k), 0 if k == i else -1) for k in range(n) if flow.get((k, i))]
            for to, c in steps:
                if cost[node] + c < cost.get(to, 1 << 60):
                    cost[to] = cost[node] + c
                    back[to] = node
                    queue.append(to)
        ends = [(cost["new", j], j) for j in range(m) if room[j] and ("new", j) in cost]
        if not ends:
            return flow
        path = [("new", min(ends)[1])]
        while path[-1] in back:
            path.append(back[path[-1]])
        path.reverse()
        pushed = min(left[path[0][1]], room[path[-1][1]])
        pairs = list(zip(path, path[1:], strict=False))
        for a, b in pairs:
            if a[0] == "new":
                pushed = min(pushed, flow[b[1], a[1]])
        for a, b in pairs:
            key = (a[1], b[1]) if a[0] == "old" else (b[1], a[1])
            flow[key] = flow.get(key, 0) + (pushed if a[0] == "old" else -pushed)
            if not flow[key]:
                del flow[key]
        left[path[0][1]] -= pushed
        room[path[-1][1]] -= pushed


def intervals(flow: dict[tuple[int, int], int], n_old: int) -> list[tuple[int, int, int, int]]:
    """Per old shard the byte intervals (old, new, from, to); what stays comes first."""
    out = []
    for i in range(n_old):
        at = 0
        for j, b in sorted(((j, b) for (k, j), b in flow.items() if k == i), key=lambda x: (x[0] != i, x[0])):
            out.append((i, j, at, at + b))
            at += b
    return out


def _ends(rows: DataFrame, old: str, cuts: list[tuple[int, int, int, int]]) -> DataFrame:
    """A row a shard: where its intervals end, and the new shard of each. As many rows as shards."""
    by: dict[int, list[tuple[int, int]]] = {}
    for i, j, _, to in cuts:
        by.setdefault(i, []).append((to, j))
    return rows.sparkSession.createDataFrame(list(by.items()), f"{old} int, ends array<struct<upto:long,dest:int>>")


def _totals(rows: DataFrame, shard: str, n: int) -> list[int]:
    """Bytes in each shard: n numbers."""
    got = {r[0]: r[1] for r in rows.groupBy(shard).agg(F.sum("size")).collect()}
    return [int(got.get(i) or 0) for i in range(n)]


def _cut(rows: DataFrame, old: str, block: Column, order: list[Column], cuts: list) -> DataFrame:
    """``rows`` with ``dest``: blocks end to end in each old shard, cut at the flow's intervals.

    Two-level prefix sums: block totals first, then rows inside a block, so that no task sees more
    of a hot shard than a block. A row goes where the middle of its bytes lies.
    """
    b = rows.withColumn("block", block)
    sums = b.groupBy(old, "block").agg(F.sum("size").alias("block_size"))
    upto = Window.partitionBy(old).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    at = sums.select(old, "block", F.coalesce(F.sum("block_size").over(upto), F.lit(0)).alias("block_at"))
    inside = Window.partitionBy(old, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = b.withColumn("upto", F.sum("size").over(inside)).join(at, [old, "block"])  # rows lie by these keys already
    middle = F.col("block_at") + F.col("upto") - F.floor((F.col("size") + 1) / 2)
    # the first interval that ends beyond the row's middle; beyond all, the last one
    at = F.filter("ends", lambda x: x["upto"] > F.col("middle"))
    dest = F.coalesce(F.get(at, F.lit(0))["dest"], F.element_at("ends", -1)["dest"], F.col(old))
    placed = placed.withColumn("middle", middle).join(F.broadcast(_ends(rows, old, cuts)), old, "left")
    return placed.withColumn("dest", dest).drop("block", "upto", "block_at", "middle", "ends")


def plan(docs: DataFrame, old_shard: Column, capacities: list[int] | int, old_shards: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Where each document goes: doc_id, size, text_crc32, old_shard, shard, slot.

    ``capacities``: bytes each new shard takes, or a number of shards of equal size; ``old_shards``:
    how many there are now, as many as new ones if not given. ``slot`` counts from 0 without gaps in
    each new shard. Rows keep their shard where the flow lets them.
    """
    n_new = capacities if isinstance(capacities, int) else len(capacities)
    n_old = max(n_new, old_shards or 0)
    old = old_shard.cast("int")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(old.between(0, n_old - 1), old).otherwise(0).alias("old_shard"),
    )
    rows = written(rows, "shard-sizes")
    supply = _totals(rows, "old_shard", n_old)
    total = sum(supply)
    if isinstance(capacities, int):
        capacities = [total // n_new + (j < total % n_new) for j in range(n_new)]
    cuts = intervals(solve_flow(supply, capacities), n_old)
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    hashed = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(BLOCKS))
    placed = written(_cut(rows, "old_shard", hashed, order, cuts), "shard-placed")
    # what the cuts left over, smallest documents of a shard first: they move, so they lie last
    got = _totals(placed, "dest", n_new)
    rest = intervals(solve_flow(got, capacities), n_new)
    size_class = F.greatest(F.lit(0), F.lit(255) - F.floor(F.log2(F.col("size")) * 8).cast("int"))
    by_size = size_class * SALT + F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SALT))  # many rows may be of one size
    even = _cut(placed.withColumnRenamed("dest", "first"), "first", by_size, [F.col("size").desc(), *order], rest)
    return number(even.drop("first").withColumnRenamed("dest", "shard"))


def number(rows: DataFrame) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, ... in each shard, by blocks of a hash of the document."""
    b = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(BLOCKS)))
    upto = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = b.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("shard", "block", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    slot = (F.col("base") + F.row_number().over(inside) - 1).cast("long")
    return b.join(base, ["shard", "block"]).withColumn("slot", slot).drop("block", "base")


def store(docs: DataFrame, shard: Column, out: str) -> DataFrame:
    """Write documents as ``out/shard=N`` folders, as they lie in the tasks; the table read back."""
    rows = docs.select(*[c for c in docs.columns if c not in ("shard", "slot")], shard.cast("int").alias("shard"))
    rows.write.option("compression", "zstd").partitionBy("shard").parquet(out)
    return docs.sparkSession.read.schema(rows.schema).parquet(out)


#: Copies of one row, and places of a shard, that are numbered and joined together.
RUN = 256


def _copies(keyed: DataFrame, target: DataFrame) -> DataFrame:
    """(document, shard, slot) of repeated rows: which copy goes where.

    Equal rows are counted, not numbered; rows of one doc_id and text that differ elsewhere follow one
    another by a digest. The plan's places are numbered by runs of slots, and both meet by runs of
    numbers, so a row that is repeated without end is dealt to many tasks, its text once a run.
    """
    digest = F.sha2(F.to_json("document"), 256)
    kinds = written(keyed.groupBy("own_id", "own_crc", "document").agg(F.count(F.lit(1)).alias("n")).withColumn("digest", digest), "shard-copies")
    own, block = ["own_id", "own_crc"], F.substring("digest", 1, 3)
    sums = kinds.groupBy(*own, block.alias("block")).agg(F.sum("n").alias("in_block"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("in_block").over(before(Window.partitionBy(*own).orderBy("block"))), F.lit(0)))
    base = sums.select(F.col("own_id").alias("s_id"), F.col("own_crc").alias("s_crc"), "block", "base")
    inside = F.coalesce(F.sum("n").over(before(Window.partitionBy(*own, block).orderBy("digest"))), F.lit(0))
    first = kinds.withColumn("inside", inside).join(base, F.col("own_id").eqNullSafe(F.col("s_id")) & (F.col("own_crc") == F.col("s_crc")) & (block == F.col("block")))
    first = first.withColumn("first", F.col("base") + F.col("inside")).withColumn("end", F.col("first") + F.col("n"))
    runs = F.sequence(F.floor(F.col("first") / RUN), F.floor((F.col("end") - 1) / RUN))
    ranges = first.select(*own, "document", "first", "end", F.explode(runs).alias("own_run"))
    same = ["doc_id", "text_crc32"]
    places = target.withColumn("at", F.floor(F.col("slot") / RUN))
    held = places.groupBy(*same, "shard", "at").agg(F.count(F.lit(1)).alias("held"))
    held = held.withColumn("base", F.coalesce(F.sum("held").over(before(Window.partitionBy(*same).orderBy("shard", "at"))), F.lit(0)))
    held = held.select(F.col("doc_id").alias("h_id"), F.col("text_crc32").alias("h_crc"), F.col("shard").alias("h_shard"), F.col("at").alias("h_at"), "base")
    there = F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_crc32") == F.col("h_crc")) & (F.col("shard") == F.col("h_shard")) & (F.col("at") == F.col("h_at"))
    number = F.row_number().over(Window.partitionBy(*same, "shard", "at").orderBy("slot")) - 1
    numbered = places.withColumn("number", number).join(held, there).withColumn("copy", F.col("base") + F.col("number")).withColumn("run", F.floor(F.col("copy") / RUN))
    meets = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_crc") == F.col("text_crc32")) & (F.col("own_run") == F.col("run"))
    return numbered.join(ranges, meets & (F.col("copy") >= F.col("first")) & (F.col("copy") < F.col("end"))).select("document", "shard", "slot")


def rewrite(docs: DataFrame, placed: DataFrame, out: str, affected: list[int] | None = None) -> str:
    """Write documents as ``out/shard=N`` folders by a plan; with ``affected``, only those shards.

    Documents join the plan on doc_id and text_crc32. Only folders of affected shards are replaced.
    """
    # a document's columns as one, so that none of its names clashes with the plan's
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    keyed = docs.select(F.struct(*names).alias("document"), F.col("doc_id").alias("own_id"), crc.alias("own_crc"))
    target = placed.select("doc_id", "text_crc32", "shard", "slot")

    def joined(rows: DataFrame, places: DataFrame) -> DataFrame:
        on = [F.col("own_id").eqNullSafe(F.col("doc_id")), F.col("own_crc") == F.col("text_crc32")]
        return rows.join(places, on).select("document", "shard", "slot")

    def some(places: DataFrame) -> DataFrame:
        return places if affected is None else places.where(F.col("shard").isin(affected))

    repeated = written(placed.groupBy("doc_id", "text_crc32").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("r_id"), F.col("text_crc32").alias("r_crc")), "shard-repeated")
    if repeated.limit(1).count():
        own = F.col("own_id").eqNullSafe(F.col("r_id")) & (F.col("own_crc") == F.col("r_crc"))
        place = F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_crc32") == F.col("r_crc"))
        once = joined(keyed.join(repeated, own, "left_anti"), some(target.join(repeated, place, "left_anti")))
        # copies are numbered over all their places, then those of affected shards are taken
        rows = once.unionAll(some(_copies(keyed.join(repeated, own, "left_semi"), target.join(repeated, place, "left_semi"))))
    else:
        rows = joined(keyed, some(target))
    files = rows.select("document.*", "shard", "slot").write.option("partitionOverwriteMode", "dynamic").option("compression", "zstd").mode("overwrite")
    files.partitionBy("shard").parquet(out)
    return out


def affected(placed: DataFrame) -> list[int]:
    """Shards that lose or gain documents: those whose files must be rewritten."""
    moved = placed.where(F.col("old_shard") != F.col("shard"))
    both = moved.select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct()
    return sorted(r[0] for r in both.collect())


def reshard(stored: DataFrame, capacities: list[int] | int, out: str, old_shards: int | None = None) -> tuple[DataFrame, DataFrame, list[int]]:
    """Move a stored table (doc_id, text, ..., shard) to new shards: the rewritten files, as a table,
    the plan of all rows, and which shards were rewritten. Files of other shards stay where they are
    and are not read beyond the columns that the plan needs.
    """
    placed = written(plan(stored, F.col("shard"), capacities, old_shards), "shard-plan")
    changed = affected(placed)
    some = stored.where(F.col("shard").isin(changed))  # what moves lies in shards that change
    rewrite(some, placed.where(F.col("shard").isin(changed)), out, changed)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema if f.name not in ("shard", "slot")]
    files = stored.sparkSession.read.schema(", ".join([*kinds, "slot long", "shard int"])).parquet(out)
    return files, placed, changed


def op1_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents``, stored in 16 shards by source, moved to 16 of equal size, and read back.

    Law ``bytes``. Old shards lie by a hash of the source, so a hot source fills one of them. Rows
    of rewritten shards are read from the new files; shards that stay as they are keep their files.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    source = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(16))
    stored = store(docs.select("doc_id", "text", "source"), source, shared_dir(spark, "old-shards"))
    files, placed, changed = reshard(stored.select("doc_id", "text", "shard"), 16, shared_dir(spark, "shards"))
    moved = files.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        "shard",
        "slot",
    )
    stayed = placed.where(~F.col("shard").isin(changed)).select(*moved.columns)
    every = moved.unionByName(stayed)
    return every.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
