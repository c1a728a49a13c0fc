"""Short licence notices, also with errors.

A notice of which at most k letters are changed, added or missing holds one of its k + 1 pieces
unchanged, so exact search for all notices' pieces (one Aho-Corasick pass) finds every place that
may hold one; there the regex library's bounded-error matching decides, and tells the span. The
words that tell one licence from another must match within a bound of their own, so that "released
under the bsd license" is no misspelt "mit license". The plain phrases are notices, too, but for "cc by",
too short for errors; "mit license" takes one, as two would find the German words for "with lens". Where notices overlap, the one with the most
matched letters counts. Texts are compared as words of ASCII letters and digits and of all other
characters, lowered, joined by one space.

Places that cannot match are left out before the regex library is asked: k errors break at most 2k
of a notice's pairs of neighbouring letters. Work is linear in a text's length and its candidates.

Defined cases: a null text is an empty one; a text without words has no label and score 0; equal
texts and repeated rows get equal results; of overlapping notices with equally many matched letters
the first of the list counts; an empty table gives no rows; texts are searched whole; other columns
are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import alnum_words, bounded, table

# Phrases whose plain places are counted.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices searched for with errors: text, label, errors allowed, the words that tell
# the licence apart (all of it where empty), and errors allowed in these.
NOTICES = (
    ("licensed under the gnu general public license", "gpl", 4, "gnu general", 1),
    ("gnu general public license", "gpl", 2, "gnu general", 1),
    ("apache license", "apache", 2, "apache", 1),
    ("mit license", "mit", 1, "mit", 0),
    ("gnu lesser general public license", "lgpl", 3, "lesser", 1),
    ("gnu affero general public license", "agpl", 3, "affero", 1),
    ("licensed under the apache license version 2 0", "apache", 4, "apache", 1),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6, "", 0),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 6, "", 0),
    ("redistribution and use in source and binary forms", "bsd", 4, "", 0),
    ("mozilla public license", "mpl", 2, "mozilla", 1),
    ("creative commons attribution", "cc-by", 2, "attribution", 1),
    ("creative commons attribution noncommercial", "cc-by-nc", 3, "noncommercial", 2),
    ("creative commons attribution sharealike", "cc-by-sa", 3, "sharealike", 2),
    ("creative commons attribution noderivatives", "cc-by-nd", 3, "noderivatives", 2),
    ("this work is licensed under cc by", "cc-by", 3, "cc by", 0),
    ("licensed under cc by nc", "cc-by-nc", 2, "cc by nc", 0),
    ("licensed under cc by sa", "cc-by-sa", 2, "cc by sa", 0),
    ("licensed under cc by nd", "cc-by-nd", 2, "cc by nd", 0),
    ("this is free and unencumbered software released into the public domain", "unlicense", 6, "unencumbered", 1),
    ("boost software license version 1 0", "boost", 3, "boost", 1),
    ("eclipse public license", "epl", 2, "eclipse", 1),
)
# Names that stand in "released under the ... license", and errors allowed in them.
NAMED = (("mit", "mit", 0), ("bsd", "bsd", 0), ("isc", "isc", 0), ("gpl", "gpl", 0), ("lgpl", "lgpl", 0), ("agpl", "agpl", 0), ("apache", "apache", 1), ("zlib", "zlib", 0))
NOTICES += tuple((f"{lead} under the {name} license", label, 3, name, errors) for lead in ("released", "licensed", "distributed") for name, label, errors in NAMED)


#: Windows of each notice whose result is remembered: shared lines and repeated near hits are matched once.
MEMORY = 4096


class Notice:
    """One notice: its pieces with their places, what a place must hold, and the bounded-error pattern."""

    def __init__(self, said: str, label: str, errors: int, name: str = "", name_errors: int = 0):
        self.said, self.label, self.errors = said.encode(), label, errors
        n, k = len(self.said), errors + 1
        at = [n * i // k for i in range(k + 1)]
        self.pieces = [(self.said[a:b], a) for a, b in zip(at, at[1:], strict=False)]
        self.pattern = regex.compile(b"(?b)(?:" + regex.escape(self.said) + b"){e<=%d}" % errors)
        self.pairs = [self.said[i : i + 2] for i in range(n - 1)]
        self.seen: dict[bytes, tuple[int, int, int] | None] = {}
        self.name = name.encode()
        m = len(self.name)
        cut = [m * i // (name_errors + 1) for i in range(name_errors + 2)]
        self.name_pieces = [self.name[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        self.name_pattern = regex.compile(b"(?<![^ ])(?:" + regex.escape(self.name) + b"){e<=%d}(?![^ ])" % name_errors)

    def match(self, w: bytes) -> tuple[int, int, int] | None:
        """(from, to, errors) of the best match that begins in a window's first 2k + 1 places after the letter
        before it, if its name is right.
        """
        if len(w) <= len(self.said) - self.errors or not any(p in w for p in self.name_pieces):
            return None
        held = {w[i : i + 2] for i in range(len(w) - 1)}
        if sum(p not in held for p in self.pairs) > 2 * self.errors:
            return None
        best = None
        for s in range(1, 2 * self.errors + 2):
            m = self.pattern.match(w, s)
            if m and (best is None or sum(m.fuzzy_counts) < best[2]) and self.named(w, *m.span()):
                best = (*m.span(), sum(m.fuzzy_counts))
        return best

    def named(self, w: bytes, s: int, e: int) -> bool:
        """Whether the words that a match touches hold the name as words of their own."""
        a, b = w.rfind(b" ", 0, s + 1) + 1, w.find(b" ", e - 1)
        return not self.name or self.name_pattern.search(w, a, b if b >= 0 else len(w)) is not None

    def at(self, joined: bytes, places: set[int]) -> list[tuple[int, int, int]]:
        """Non-overlapping matches at places where the notice may begin."""
        out: list[tuple[int, int, int]] = []
        done = 0
        for p in sorted(places):
            s = max(0, p - self.errors, done)
            w = (joined[s - 1 : s] or b" ") + joined[s : p + len(self.said) + self.errors + 1]
            if w not in self.seen:
                if len(self.seen) >= MEMORY:
                    self.seen.clear()
                self.seen[w] = self.match(w)
            m = self.seen[w]
            if m:
                out.append((s + m[0] - 1, s + m[1] - 1, m[2]))
                done = s + m[1] - 1
        return out


class Notices:
    """All notices and the automaton of their pieces."""

    def __init__(self, rows: tuple = NOTICES):
        self.all = [Notice(*x) for x in rows]
        of = defaultdict(list)
        for k, x in enumerate(self.all):
            for piece, at in x.pieces:
                of[piece.decode()].append((k, at + len(piece) - 1))
        self.pieces = ahocorasick.Automaton()
        for piece, where in of.items():
            self.pieces.add_word(piece, where)
        self.pieces.make_automaton()

    def find(self, joined: bytes) -> list[tuple[str, int, int, float]]:
        """(label, from, to, likeness), in order; of overlapping ones that with the most matched letters."""
        places = defaultdict(set)
        for end, where in self.pieces.iter(joined.decode("latin-1")):
            for k, last in where:
                places[k].add(end - last)
        found = []
        for k, at in places.items():
            x = self.all[k]
            found += [(errors - len(x.said), k, s, e, errors) for s, e, errors in x.at(joined, at)]
        starts: list[int] = []  # of the matches taken, which do not overlap
        ends: list[int] = []
        out = []
        for _, k, s, e, errors in sorted(found):
            i = bisect_right(starts, s)
            if (i and ends[i - 1] > s) or (i < len(starts) and starts[i] < e):
                continue
            starts.insert(i, s)
            ends.insert(i, e)
            out.append((self.all[k].label, s, e, 1 - errors / len(self.all[k].said)))
        return sorted(out, key=lambda x: x[1])


_NOTICES: list[Notices] = []


def notices() -> Notices:
    if not _NOTICES:
        _NOTICES.append(Notices())
    return _NOTICES[0]


def places(padded: bytes, phrase: bytes) -> list[int]:
    """Offsets of a phrase's whole words in a text of words that a space surrounds."""
    out, p = [], padded.find(b" " + phrase + b" ")
    while p >= 0:
        out.append(p)
        p = padded.find(b" " + phrase + b" ", p + 1)
    return out


def scan(text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, float]]]:
    """Number of words, base (first word, label), and notices (label, first word, last, likeness)."""
    words = alnum_words(text)
    joined = b" ".join(words)
    padded = b" " + joined + b" "
    plain = [(p, label) for phrase, label in BASE.items() for p in places(padded, phrase.encode())]
    found = notices().find(joined)
    if not plain and not found:
        return len(words), [], []
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    base = [(bisect_left(starts, p), label) for p, label in plain]
    return len(words), base, [(label, bisect_right(starts, s) - 1, bisect_right(starts, max(s, e - 1)) - 1, like) for label, s, e, like in found]


COLUMNS = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "notices array<struct<label:string,first_word:long,last_word:long,likeness:double>>"
)


def scan_licences(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row a document: plain phrases, labels, the best likeness of a notice, and notices' spans."""
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("likeness", pa.float64())])
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from annolake.llm.licences import scan

        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, base, found = scan(t)
                at = [p for p, _ in base]
                labels = sorted({x for _, x in base})
                more = sorted({*labels, *(x[0] for x in found)})
                score = 1.0 if base else max((x[3] for x in found), default=0.0)
                spans = [dict(zip(("label", "first_word", "last_word", "likeness"), x, strict=True)) for x in found]
                rows.append((i, n, len(base), min(at, default=None), max(at, default=None), ",".join(labels), ",".join(more), score, spans))
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return bounded(docs).select("doc_id", text).mapInArrow(run, COLUMNS)


def op9_fuzzy_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every whole text of ``documents``."""
    return scan_licences(table(spark, sf_dir, "documents"))
