"""A toxicity classifier regularised by counterfactuals.

Words, and the first letters of long words, feed a logistic model. Besides the labels' loss it is
trained on pairs of sentences taken from the labelled rows: a sentence that names an identity group,
and the same sentence with the group swapped for another or left out; and a sentence that names
none, with one group and with another put in after its first article (or at its beginning), and
without. The squared change of the score is added to the loss, so that naming a group does not by
itself raise a score. Each distinct change counts once, however many sentences show it: a group that
few rows name is held as firmly as one that many do.

It is fitted on the driver from a bounded sample of labelled rows (``SAMPLE`` rows of at most
``FEATURES`` features and those of group terms, rows whose hashed doc_id is smallest; of each row at
most ``SENTENCES`` sentences, cut to ``WINDOW`` words, so at most ``SAMPLE * SENTENCES * 3`` pairs).
Spark extracts the features and counts the pairs, and every whole text is scored in tasks.

Defined cases: a null text is an empty one and gets the score of no evidence; rows without a label
are not learnt from; without any toxic and any other label, the share of toxic labels is the score
of all; equal texts get equal scores; repeated label rows count once each; of sentences or features
that tie, those with the smaller hash or name come first; an empty table gives no rows; other
columns, of whatever name, are no input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import alnum_words, bounded, table, written

#: Most labelled rows that the model is fitted on.
SAMPLE = 16_000
#: Most features it keeps: those whose share differs most between the two labels.
FEATURES = 4_000
#: Most sentences of a row that counterfactuals are made of, and most words of one.
SENTENCES = 2
WINDOW = 64
#: Weight of the score changes between counterfactual sentences.
SWAP_PENALTY = 1.0
THRESHOLD = 0.3
STEM = 5

# Terms that name groups, by language and kind; swaps stay within a kind.
IDENTITY_TERMS = (
    ("en", "women men girls boys woman man girl boy"),
    ("en", "muslims christians jews hindus buddhists atheists muslim christian jewish hindu buddhist atheist"),
    ("en", "black white asian latino african arab european"),
    ("en", "gay lesbian straight transgender bisexual queer"),
    ("en", "immigrants refugees foreigners natives"),
    ("de", "frauen männer mädchen jungen muslime christen juden"),
    ("fr", "femmes hommes filles garçons musulmans chrétiens juifs"),
    ("es", "mujeres hombres niñas niños musulmanes cristianos judíos"),
)
# Articles, by language; a group is put in after the first of a sentence.
ARTICLES = {"en": "the a an these those", "de": "der die das den dem ein eine einen", "fr": "le les des un une du", "es": "el los las una unos unas"}
_KIND = {w.encode(): k for k, (_, line) in enumerate(IDENTITY_TERMS) for w in line.split()}
_OF_KIND = [[w.encode() for w in line.split()] for _, line in IDENTITY_TERMS]
_KINDS_OF = {x: [k for k, (y, _) in enumerate(IDENTITY_TERMS) if y == x] for x in ARTICLES}
_ARTICLE = {w.encode(): x for x, line in ARTICLES.items() for w in line.split()}
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def features(words: list[bytes]) -> set[bytes]:
    """Distinct words, and beginnings of those longer than ``STEM`` (with a star)."""
    found = set(words)
    return found | {w[:STEM] + b"*" for w in found if len(w) > STEM}


def sentences(text: str, most: int = SENTENCES) -> list[list[bytes]]:
    """A few sentences of a text, those that name groups first, long ones around the first group or article."""
    out = []
    for s in _SENTENCE.split(text):
        words = alnum_words(s)
        if not words:
            continue
        at = next((i for i, w in enumerate(words) if w in _KIND), -1)
        named = at >= 0
        if not named:
            at = next((i for i, w in enumerate(words) if w in _ARTICLE), 0)
        start = max(0, min(at - WINDOW // 2, len(words) - WINDOW))
        words = words[start : start + WINDOW]
        out.append((not named, xxh3_64_intdigest(b" ".join(words)), words))
    return [w for _, _, w in sorted(out)[:most]]


def swaps(words: list[bytes]) -> list[list[bytes]]:
    """The sentence with its groups left out, and with the next and last of their kinds."""
    out = [[w for w in words if w not in _KIND]]
    for step in (1, -1):
        out.append([_OF_KIND[k][(_OF_KIND[k].index(w) + step) % len(_OF_KIND[k])] if (k := _KIND.get(w)) is not None else w for w in words])
    return out


def inserted(words: list[bytes]) -> list[list[bytes]]:
    """A sentence that names no group with one, and with the next of its kind, put in."""
    at = next((i for i, w in enumerate(words) if w in _ARTICLE), None)
    language = "en" if at is None else _ARTICLE[words[at]]
    h = xxh3_64_intdigest(b" ".join(words))
    terms = _OF_KIND[_KINDS_OF[language][h % len(_KINDS_OF[language])]]
    i = (h >> 8) % len(terms)
    slot = 0 if at is None else at + 1
    return [[*words[:slot], terms[(i + step) % len(terms)], *words[slot:]] for step in (0, 1)]


def counterfactuals(words: list[bytes]) -> list[tuple[list[bytes], list[bytes]]]:
    """Pairs of sentences whose scores should not differ."""
    if any(w in _KIND for w in words):
        return [(words, x) for x in swaps(words)]
    one, other = inserted(words)
    return [(one, other), (one, words), (other, words)]


class Model:
    """Weights by feature, and a constant; ``pairs``: how many pairs of sentences it was held to."""

    def __init__(self, weights: dict[bytes, float], constant: float, pairs: int = 0):
        self.weights, self.constant, self.pairs = weights, constant, pairs
        self.known = frozenset(weights)

    def score(self, text: str | None) -> float:
        found = self.known & features(alnum_words(text))
        z = self.constant + sum(self.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def solve(names: list[bytes], rows: list[tuple[list[int], int]], changes: list[list[int]], penalty: float = SWAP_PENALTY, rounds: int = 300) -> Model:
    """Fit by gradient steps with momentum on the sum of both losses, weights held small.

    ``rows``: numbers of a row's features, and its label. ``changes``: for each distinct change
    between paired sentences the features that only the first has as number + 1, those that only
    the second has negated.
    """
    n, toxic = len(rows), sum(y for _, y in rows)
    share = (toxic + 0.5) / (n + 1)
    constant = float(np.log(share / (1 - share)))
    if not toxic or toxic == n:
        return Model({}, constant)
    row = np.repeat(np.arange(n), [len(f) for f, _ in rows])
    col = np.array([k for f, _ in rows for k in f], int)
    y = np.array([y for _, y in rows], float)
    pair = np.repeat(np.arange(len(changes)), [len(c) for c in changes])
    signed = np.array([k for c in changes for k in c], int)
    turned, sign = np.abs(signed) - 1, np.sign(signed).astype(float)
    w, bias = np.zeros(len(names)), constant
    m, v, mb, vb = np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = bias + np.bincount(row, w[col], n)
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = np.bincount(col, err[row], len(names)) + 1e-4 * w
        if len(changes):
            d = np.bincount(pair, sign * w[turned], len(changes))
            g += penalty * 2 * np.bincount(turned, sign * d[pair], len(names))
        gb = err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05 * min(1.0, 2 * (1 - step / (rounds + 1)))  # smaller in the second half, to settle
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-3}, float(bias))


def strong_features(made: DataFrame, n: int, toxic: int) -> list[bytes]:
    """Features whose share differs most between the labels, counted by Spark, and those of group terms."""
    seen = made.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("k"), F.sum("y").alias("t"))
    p = F.col("k") / n
    gap = F.abs(F.col("t") / toxic - (F.col("k") - F.col("t")) / (n - toxic))
    apart = gap / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / toxic + 1 / (n - toxic)))
    strong = seen.where("k >= 3").withColumn("apart", apart).where("apart > 3.5").orderBy(F.desc("apart"), "f").limit(FEATURES)
    return sorted({bytes(r[0]) for r in strong.select("f").collect()} | features(list(_KIND)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, penalty: float = SWAP_PENALTY) -> Model:
    """Fit on the bounded sample. Tasks make features of whole texts; the driver gets, for each
    sampled row, the numbers of the kept features that it has.
    """
    own = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y"))
    own = own.where(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(4)) != 2)
    own = own.orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    rows = bounded(docs).select("doc_id", "text").join(F.broadcast(own), docs["doc_id"] == F.col("id")).select("text", "y")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.list_(pa.binary()), pa.int32(), pa.list_(pa.binary())]
        for b in batches:
            f, s = [], []
            for t in b.column(0).to_pylist():
                f.append(sorted(features(alnum_words(t))))
                s.append([b" ".join(x) for x in sentences(t or "")])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((f, b.column(1), s), kinds, strict=True)], ["f", "y", "s"])

    made = written(rows.mapInArrow(featured, "f array<binary>, y int, s array<binary>"), "toxicity-features")
    n, toxic = made.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not toxic or toxic == n:
        return solve([], [([], 1)] * toxic + [([], 0)] * (n - toxic), [])
    names = strong_features(made, n, toxic)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {f: k for k, f in enumerate(names)}
        for b in batches:
            ids = [[number[x] for x in f if x in number] for f in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), b.column(1)], ["ids", "y"])

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {f: k for k, f in enumerate(names)}
        for b in batches:
            out = []
            for words in (x.split(b" ") for s in b.column(0).to_pylist() for x in s):
                for one, other in counterfactuals(words):
                    here, there = features(one), features(other)
                    change = [number[x] + 1 for x in here - there if x in number] + [-number[x] - 1 for x in there - here if x in number]
                    if change:
                        out.append(sorted(change))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32()))], ["change"])

    got = sorted(map(tuple, made.select("f", "y").mapInArrow(numbered, "ids array<int>, y int").collect()))
    changes = made.select("s").mapInArrow(turned, "change array<int>").groupBy("change").agg(F.count(F.lit(1)).alias("k")).collect()
    model = solve(names, got, sorted(list(r[0]) for r in changes), penalty)
    model.pairs = sum(r[1] for r in changes)
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    weights, constant = model.weights, model.constant

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(weights, constant)
        for b in batches:
            scores = [m.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return bounded(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; rows are judged where they lie, without a join."""
    model = train(docs, table(spark, sf_dir, "labels"))
    weights, constant = model.weights, model.constant
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(weights, constant)
        for b in batches:
            yield b.filter(pa.array([m.score(t) < THRESHOLD for t in b.column(at).to_pylist()], pa.bool_()))

    return bounded(docs).mapInArrow(run, docs.schema)


def op5_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
