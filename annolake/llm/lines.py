"""Cross-site lines by distinct-site spread, with DataFrame functions only.

Each distinct line's sites go into a HyperLogLog sketch; sketches merge by aggregation, so a line
costs the same however often it occurs. Lines whose estimate is farther from the threshold than
the sketch's error are decided by it; the others get an exact distinct count. Lines on at least
``sites`` sites are boilerplate: they are removed wherever they occur, but for the document with
the smallest doc_id among those that hold the line.

Defined cases: lines are compared without spaces around them; blank lines are never removed; a null
source is a site of its own; a null text stays null; rows that share a doc_id are one document; a
null doc_id counts for spread but its text stays; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, small_or_shuffled, table, written

#: Sites from which on a line is boilerplate.
SITES = 8
#: Logarithm of a sketch's size: 2**10 registers, a relative error of 1.04 / 2**5.
LG_K = 10
#: Estimates within this many errors of the threshold are counted exactly.
ERRORS = 4


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def spread(docs: DataFrame, sites: int = SITES, lg_k: int = LG_K) -> DataFrame:
    """(line, first_doc) of the lines on at least ``sites`` sites; ``line`` is the line's hash."""
    rows = docs.select("doc_id", F.coalesce(F.xxhash64("source"), F.lit(0)).alias("site"), F.explode(F.split("text", "\n")).alias("l"))
    rows = rows.where(F.length(F.trim("l")) > 0).select("doc_id", "site", _key(F.col("l")).alias("line"))
    # a hot line is a row a site from here on
    on = written(rows.groupBy("line", "site").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")), "line-sites")
    sketched = on.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min("first_doc").alias("first_doc"), F.sum("n").alias("n"))
    # a line cannot be on more sites than it has places
    judged = written(
        sketched.where(F.col("n") >= sites).select("line", "first_doc", F.hll_sketch_estimate("sketch").alias("estimate")), "line-estimates"
    )
    band = max(1.0, ERRORS * 1.04 / 2 ** (lg_k / 2) * sites)
    near = F.abs(F.col("estimate") - sites) <= band
    clear = judged.where(~near & (F.col("estimate") > sites)).select("line", "first_doc")
    close = judged.where(near).select("line", "first_doc")
    exact = on.join(small_or_shuffled(close.select("line")), "line", "left_semi").groupBy("line").agg(F.count_distinct("site").alias("sites"))
    return clear.unionByName(close.join(exact.where(F.col("sites") >= sites).select("line"), "line", "left_semi"))


#: Parts that a shared line's occurrences are dealt to where lines are joined by a shuffle.
SALT = 64


def _shared(lines: DataFrame, bad: DataFrame, most: int | None = None) -> DataFrame:
    """``lines`` that are in ``bad``: by a broadcast up to a number of lines, beyond it by a shuffle that
    deals each line, hot by definition, to ``SALT`` parts.
    """
    most = BROADCAST_IDS if most is None else most
    if bad.count() <= most:
        return lines.join(F.broadcast(bad), "line")
    dealt = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int"))
    copies = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return dealt.join(copies, ["line", "salt"]).drop("salt")


def without_shared(docs: DataFrame, sites: int = SITES, lg_k: int = LG_K, counts: bool = False) -> DataFrame:
    """The rows of ``docs`` with their text freed of boilerplate lines; with ``counts``, also all_lines and removed_lines."""
    bad = written(spread(docs, sites, lg_k), "lines-shared").select(F.col("line"), F.col("first_doc").alias("stays_in"))
    lines = docs.where("doc_id is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    hit = _shared(lines.select("doc_id", _key(F.col("l")).alias("line")), bad).where("doc_id <> stays_in")
    of_doc = written(hit.groupBy(F.col("doc_id").alias("hit_id")).agg(F.collect_set("line").alias("hit_lines")), "lines-hit")
    # the same plan at every size: hits grow with the documents
    joined = docs.join(of_doc.hint("merge"), docs["doc_id"] == of_doc["hit_id"], "left")
    all_lines = F.split(docs["text"], "\n")
    kept = F.filter(all_lines, lambda x: ~F.array_contains(of_doc["hit_lines"], _key(x)) | (F.length(F.trim(x)) == 0))
    was_hit = of_doc["hit_id"].isNotNull()
    text = F.when(was_hit, F.array_join(kept, "\n")).otherwise(docs["text"])
    removed = F.when(was_hit, F.size(all_lines) - F.size(kept)).otherwise(0).cast("long")
    out = [text.alias("text") if c == "text" else docs[c] for c in docs.columns]
    if counts:
        out += [removed.alias("removed_lines"), F.when(docs["text"].isNull(), 0).otherwise(F.size(all_lines)).cast("long").alias("all_lines")]
    return joined.select(*out)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without cross-site lines."""
    return without_shared(docs)


def op8_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without cross-site lines: counts and a digest of what is left of each text."""
    out = without_shared(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), counts=True)
    return out.select(
        "doc_id",
        F.col("all_lines").alias("n_lines"),
        F.col("removed_lines").alias("n_removed"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


OP8_SQL = f"""
WITH l AS (
  SELECT doc_id, source, pos, string_split(text, chr(10))[pos] AS line
  FROM (SELECT doc_id, source, text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos FROM documents)
), shared AS (
  SELECT trim(line, ' ') AS key, min(doc_id) AS stays_in FROM l WHERE trim(line, ' ') <> ''
  GROUP BY 1 HAVING count(DISTINCT coalesce(source, chr(0))) >= {SITES}
), marked AS (
  SELECT l.doc_id, l.pos, l.line, s.key IS NOT NULL AND l.doc_id <> s.stays_in AS gone
  FROM l LEFT JOIN shared s ON trim(l.line, ' ') = s.key
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
  CAST(length(coalesce(k.kept, '')) AS BIGINT) AS kept_chars, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
