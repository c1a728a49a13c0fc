"""Benchmark leaks: rare words as seeds, then local alignment.

An alignment (Smith-Waterman: 2 a match, -1 a mismatch or gap) is kept if its score over that of the
item's own reaches ``LEAST``. So it must match a fixed number of the item's words in a stretch of a
bounded length; of any choice of the item's places all but a bounded number must be matched too. The
seeds are the places of the item's rarest words, as many as leave out only common ones. Runs of
matches are parted by a mismatch or gap at least, so a score is at most one more than the matched
words and matched pairs of neighbours. Documents that hold too few of an item's seeds and pairs
cannot align with it; in the others the stretches with enough of its words and pairs are aligned.
These bounds lose nothing: what full alignment of every document with every item finds is found,
whatever was edited and however often an item leaked.

The benchmark is taken in blocks of at most ``BLOCK_WORDS`` words, each a bounded query set against
all documents; documents are never shuffled.

Defined cases: null and blank texts hold no leak; items without words match nothing; items of fewer than
``N`` words match only as a whole; a repeated item or document row gets rows of its own; no documents
or no benchmark give no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import alnum_words, bounded, small_or_shuffled, table, written

N = 3
SPREAD = 4
LEAST = 0.5
#: Words of a block of items, each of which is two passes over the documents; its index is sent as about 47 MB.
BLOCK_WORDS = 1_000_000
MATCH, MISS, GAP = 2, -1, -1


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def pairs(h: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words."""
    return (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int, int]:
    """Best local alignment: score, and where it begins and ends in a and in b (ends exclusive).

    A row at a time; gaps along a row are a running maximum. The beginning is the end of the best
    alignment of both parts read backwards.
    """

    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
        steps = np.arange(len(b)) * -GAP
        row, top, at = np.zeros(len(b) + 1, np.int64), 0, (0, 0)
        for i, x in enumerate(a):
            new = np.maximum(0, np.maximum(row[:-1] + np.where(b == x, MATCH, MISS), row[1:] + GAP))
            new = np.maximum.accumulate(new + steps) - steps
            row = np.concatenate(([0], new))
            k = int(new.argmax())
            if new[k] > top:
                top, at = int(new[k]), (i + 1, k + 1)
        return top, *at

    score, i, j = best(a, b)
    if not score:
        return 0, 0, 0, 0, 0
    _, di, dj = best(a[:i][::-1], b[:j][::-1])
    return score, i - di, i, j - dj, j


class Items:
    """A block of items: word hashes, and what an alignment of a score from ``least`` must hold."""

    def __init__(self, rows: list[tuple[int, str]], least: float = LEAST):
        self.ids = [i for i, _ in rows]
        self.grams = [hashes(alnum_words(t)) for _, t in rows]
        self.least = [least if len(g) >= N else 1.0 for g in self.grams]
        self.need = [x * MATCH * len(g) for x, g in zip(self.least, self.grams, strict=True)]
        #: Matches that the score takes, and the document's words that it may span.
        self.matches = [min(len(g), max(1, math.ceil(n / MATCH - 1e-9))) for n, g in zip(self.need, self.grams, strict=True)]
        self.span = [len(g) + int((MATCH * len(g) - n) / -max(MISS, GAP) + 1e-9) for n, g in zip(self.need, self.grams, strict=True)]
        #: Seeds that must be matched: half of the matches, so that the commonest words are no seeds.
        self.enough = [max(1, m // 2) for m in self.matches]

    def all(self) -> np.ndarray:
        return np.unique(np.concatenate([np.empty(0, np.uint64), *self.grams]))

    def seeds(self, count: dict[int, int]) -> dict[int, list[tuple[int, int]]]:
        """Seed word -> (item, place): the item's rarest places, equals spread over it.

        At most ``len - matches`` places stay unmatched, so ``enough`` of these are matched.
        """
        out = defaultdict(list)
        for k, g in enumerate(self.grams):
            df = [count.get(x, 0) for x in g.tolist()]
            chosen = sorted(range(len(df)), key=lambda p: (df[p], p % SPREAD, p))[: len(df) - self.matches[k] + self.enough[k]]
            for p in sorted(chosen):
                out[int(g[p])].append((k, p))
        return out


class Places:
    """Sorted keys, and for each the items that hold it, with at how many places.

    ``key`` and ``item`` run side by side, an entry a place; ``keys`` are the sorted keys if there are
    more than those.
    """

    def __init__(self, key: np.ndarray, item: np.ndarray, keys: np.ndarray | None = None):
        order = np.lexsort((item, key))
        key, item = key[order], item[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (item[1:] != item[:-1])
        at = new.nonzero()[0]
        self.item = item[at]
        self.times = np.diff(np.append(at, len(key)))
        self.keys = np.unique(key) if keys is None else keys
        self.first = np.append(np.searchsorted(key[at], self.keys), len(at))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where h holds keys, and which."""
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        where = (self.keys[at] == h).nonzero()[0]
        return where, at[where]

    def held(self, keys: np.ndarray, n_items: int) -> np.ndarray:
        """How many places of each item hold one of the keys."""
        keys = np.unique(keys)
        low = self.first[keys]
        n = self.first[keys + 1] - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.item[at], self.times[at], n_items)


class Index:
    """Seeds and pairs of a block's items."""

    def __init__(self, items: Items, seeds: dict[int, list[tuple[int, int]]]):
        words = items.all()
        places = [(w, k) for w, at in seeds.items() for k, _ in at]
        self.words = Places(np.array([w for w, _ in places], np.uint64), np.array([k for _, k in places], np.int64), words)
        self.own = [np.unique(np.searchsorted(words, g)) for g in items.grams]
        self.pairs = [pairs(g) for g in items.grams]
        self.pair = Places(np.concatenate([np.empty(0, np.uint64), *self.pairs]), np.repeat(np.arange(len(self.pairs)), [len(g) for g in self.pairs]))
        self.enough = np.array(items.enough)
        seeded = np.array(items.enough) - items.matches + [len(g) for g in items.grams]
        #: The score's bound without seeds and pairs: words that are no seeds count as matched.
        self.rest = 1 + (MATCH - 1) * (np.array([len(g) for g in items.grams]) - seeded)
        self.need = np.array(items.need) - 1e-9

    def candidates(self, words: np.ndarray, doc_pairs: np.ndarray) -> list[int]:
        """Items with enough seeds and pairs among those of a document."""
        seeds = self.words.held(words, len(self.need))
        if not (seeds >= self.enough).any():
            return []
        both = (MATCH - 1) * seeds + self.pair.held(self.pair.find(doc_pairs)[1], len(self.need))
        return ((seeds >= self.enough) & (both + self.rest >= self.need)).nonzero()[0].tolist()


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in ascending order, in blocks of at most ``BLOCK_WORDS`` words (one item at least)."""
    now, size = [], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        n = len(alnum_words(r[1]))
        if now and size + n > BLOCK_WORDS:
            yield now
            now, size = [], 0
        if n:
            now.append((r[0], r[1]))
            size += n
    if now:
        yield now


def frequencies(docs: DataFrame, items: Items) -> dict[int, int]:
    """In how many documents each word of the block occurs: at most a row a word."""
    known = items.all()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(known), np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                h = hashes(list(set(alnum_words(t))))
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                count[at[known[at] == h]] += 1
        hit = count.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype("i8")), pa.array(count[hit])], ["gram", "n"])

    got = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(known[got["gram"].to_numpy()].tolist(), got["n"].to_pylist(), strict=True))


def leaks_of(h: np.ndarray, items: Items, index: Index) -> list[tuple]:
    """(item, score, matched from, to in the item, from, to in the document) of one document."""
    known, held = index.words.find(h)
    out = []
    for k in index.candidates(held, pairs(h)):
        item, need, best = items.grams[k], items.need[k], None
        on = known[np.isin(held, index.own[k])]
        more = items.matches[k] - 1
        if len(on) <= more:
            continue
        # an alignment begins with a match, and so many more follow within its span
        starts = on[: len(on) - more]
        merged: list[list[int]] = []
        for s in starts[on[more:] - starts < items.span[k]].tolist():
            e = min(len(h), s + items.span[k])
            if merged and s <= merged[-1][1]:
                merged[-1][1] = e
            else:
                merged.append([s, e])
        for s, e in merged:
            w = h[s:e]
            words = int(np.isin(item, w).sum())  # no alignment can score more than these bounds
            if MATCH * words < need or (MATCH - 1) * words + int(np.isin(index.pairs[k], pairs(w)).sum()) + 1 < need:
                continue
            score, i0, i1, j0, j1 = align(item, w)
            if score >= need and (best is None or score > best[1]):
                best = (k, score, i0, i1, s + j0, s + j1)
        if best:
            out.append((best[0], best[1] / (MATCH * len(item)), *best[2:]))
    return out


COLUMNS = "doc_id long, item_id long, score double, item_from long, item_to long, doc_from long, doc_to long"


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """A row for each document and item that align: score from ``least`` to 1, and word spans."""
    spark = docs.sparkSession
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in blocks(benchmark):
        items = Items(block, least)
        index = Index(items, items.seeds(frequencies(rows, items)))

        def run(batches: Iterator[pa.RecordBatch], items: Items = items, index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    found += [(i, items.ids[k], *rest) for k, *rest in leaks_of(hashes(alnum_words(t)), items, index)]
                cols = list(zip(*found, strict=True)) or [()] * 7
                kinds = [pa.int64()] * 2 + [pa.float64()] + [pa.int64()] * 4
                names = [c.split()[0] for c in COLUMNS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        got = rows.mapInArrow(run, COLUMNS)
        out = got if out is None else out.unionAll(got)
    return spark.createDataFrame([], COLUMNS) if out is None else out


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    bad = written(leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("gone_id")).distinct(), "leaks")
    return docs.join(small_or_shuffled(bad), docs["doc_id"] == bad["gone_id"], "left_anti")


def op6_seeded_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold copies, edited or not, of benchmark items."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
