"""Personal data under disguise, with spans of the source text.

Finite transducers rewrite a text step by step - character references, characters that do not show,
look-alike letters, spelled digits, letters for digits, spelled "at" and "dot" - and each keeps the segments it changed, so that a span found in the
last text maps back through every step to characters of the first. Plain detection runs on the
source text; what only shows after rewriting is added to it, also where it is a wider form of a
plain one. White space around a disguised sign counts up to ``GAP`` characters.

Defined cases: a null text is an empty one; an empty text has no spans; texts are read whole, in
time linear in their length; equal and repeated rows get equal results; of spans that begin together
the kinds come in their order; an empty table gives no rows; other columns, of whatever name, are
not read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit before the first one would itself begin the match, so looking back changes nothing
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def _emails(t: str) -> Iterator[tuple[int, int]]:
    """Leftmost emails, one "@" after another: what precedes it is read back to the last match."""
    end = 0
    at = t.find("@")
    while at >= 0:
        start = at
        while start > end and t[start - 1] in _LOCAL:
            start -= 1
        m = start < at and _DOMAIN.match(t, at + 1)
        if m:
            end = m.end()
            yield start, end
        at = t.find("@", max(at + 1, end))


def detect(t: str) -> list[tuple[int, int, str]]:
    """(start, kind's number, end) of the plain identifiers in a text, sorted."""
    out = [(s, 0, e) for s, e in _emails(t)]
    if "." in t:
        for m in _IP.finditer(t):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in t:
        for m in _PHONE.finditer(t):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# Look-alikes of Latin letters and marks, in pairs of look-alike and letter.
_LOOK_ALIKES = (
    "аa вb сc еe нh іi јj кk мm оo рp ѕs тt уy хx ԁd ԛq ԝw ӏl пn гr АA ВB СC ЕE НH ІI ЈJ КK МM ОO РP ЅS ТT УY ХX "
    "αa βb εe ιi κk νv οo ρp τt υu χx ηn γy ΑA ΒB ΕE ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ΖZ "
    "օo ոn սu հh ցg զq ıi ɑa ɡg ᴀa ʙb ᴄc ᴅd ᴇe ɢg ʜh ɪi ᴊj ᴋk ʟl ᴍm ɴn ᴏo ᴘp ʀr ᴛt ᴜu ᴠv ᴡw ʏy ᴢz ․. 。. ‐- ‑- −-"
)


def _variants() -> Iterator[tuple[str, str]]:
    """Characters that are an ASCII one in another font, width or circle, or another script's decimal digit."""
    for n in range(0x80, 0x20000):
        c = chr(n)
        if unicodedata.category(c) == "Nd":
            yield c, str(unicodedata.digit(c))
        elif unicodedata.decomposition(c).startswith(("<font>", "<wide>", "<small>", "<circle>")):
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and "!" <= plain <= "~":
                yield c, plain


LOOK_ALIKES = dict(_variants()) | {p[0]: p[1] for p in _LOOK_ALIKES.split(" ")}
_LOOK_ALIKE = frozenset(LOOK_ALIKES)
# Characters that do not show, and marks that only change how the one before is drawn.
_UNSEEN = re.compile("[\u00ad\u034f\u061c\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u20e3\ufe00-\ufe0f\ufeff\U000e0000-\U000e0fff]+")
# Letters that stand for digits.
_FOR_DIGITS = {"O": "0", "o": "0", "l": "1", "I": "1"}
_BESIDE = re.compile(r"[0-9][OolI]|[OolI][0-9]")
_MIXED = re.compile(r"(?<![A-Za-z0-9])[0-9OolI][0-9OolI .()-]{5,}[0-9OolI](?![A-Za-z0-9])")

# The digits' names in English, German, French and Spanish.
_NAMES = {
    "0": "zero oh null zéro cero",
    "1": "one eins un uno",
    "2": "two zwei deux dos",
    "3": "three drei trois tres",
    "4": "four vier quatre cuatro",
    "5": "five fünf cinq cinco",
    "6": "six sechs seis",
    "7": "seven sieben sept siete",
    "8": "eight acht huit ocho",
    "9": "nine neun neuf nueve",
}
DIGIT_NAMES = {name: d for d, names in _NAMES.items() for name in names.split()}
_NAME = "(?:" + "|".join(sorted(DIGIT_NAMES, key=len, reverse=True)) + ")"
_TIMES = {"double": 2, "triple": 3}
_UNIT = rf"(?:(?:(?:double|triple)[\s-]+)?{_NAME}(?![^\W_])|[0-9]+)"
_SPELLED = re.compile(rf"(?<![^\W_])(?:plus[\s-]+|\+\s*)?(?:(?:{_UNIT})(?:[\s,.-]{{1,3}}{_UNIT}){{3,}})")  # of lowered text
_PLUS = re.compile(r"plus[\s-]+", re.I)
_TOKEN = re.compile(rf"(?:(?P<times>double|triple)[\s-]+)?(?P<name>{_NAME})(?![^\W_])|[0-9]+|(?P<gap>[\s,.-]+)|(?P<plus>\+\s*)", re.I)
#: Most white space on a side of a disguised sign, and inside its brackets.
GAP = 3
_S0, _S1 = rf"\s{{0,{GAP}}}", rf"\s{{1,{GAP}}}"
# Names of both signs in English, German, French and Spanish; the shortest German one only in brackets.
_AT_NAMES, _DOT_NAMES = "at|arobase|arroba", "dot|punkt|point|punto"
_AT = rf"(?:{_S0}[\[({{<]{_S0}(?:{_AT_NAMES}|ät|@){_S0}[\])}}>]{_S0}|{_S1}(?:{_AT_NAMES}){_S1})"
_DOT = rf"(?:{_S0}[\[({{<]{_S0}(?:{_DOT_NAMES}|\.){_S0}[\])}}>]{_S0}|{_S1}(?:{_DOT_NAMES}){_S1})"
_AT_SIGN = re.compile(rf"{_AT}|{_S0}@{_S0}", re.I)
_AT_CORE = re.compile(rf"@|(?<![^\W_])(?:{_AT_NAMES}|ät)(?![^\W_])")  # of lowered text
_APART = re.compile(r"\s+@\s+")
_DOT_OR_POINT = re.compile(rf"(?:{_DOT}|\.)", re.I)
_DOT_SIGN = re.compile(_DOT, re.I)
# Usual endings; only before one of these a dot may stand apart, or all signs be bare words.
_ENDINGS = "com|org|net|edu|gov|io|co|uk|de|fr|es|eu|info|biz|ca|au|nl|ch|se|pl|jp|cn|br|ru|tv|app|dev|ai"
_ENDING = re.compile(_ENDINGS, re.I)
_APART_DOT = re.compile(rf"{_S1}\.{_S1}(?=(?:{_ENDINGS})(?![A-Za-z0-9-]))", re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_LONGEST_DOT = 4 * GAP + 7  # characters: four gaps, brackets, the longest name
_JOINED = re.compile(r"(?<=[a-z0-9])([_-])at\1[a-z0-9]+(?:\1dot\1[a-z0-9]+)+(?![a-z0-9]|\1)")  # of lowered text
_JOINED_DOT = re.compile(r"[_-]dot[_-]")
# References by name.
_NAMED = {"commat": "@", "period": ".", "plus": "+", "hyphen": "-", "dash": "-"}
_REFERENCE = re.compile(r"&(?:#([0-9]{2,3})|#[xX]([0-9a-fA-F]{2})|(" + "|".join(_NAMED) + "));")
_POINTS = re.compile(rf"(?<![0-9])[0-9]++(?:(?:{_DOT}|\.)[0-9]++){{3}}", re.I)
_PIECES = ("at", "@")


class Step:
    """A text after one transducer, and the segments it changed: (start, end, source start, end)."""

    def __init__(self, source: str, changes: list[tuple[int, int, str]]):
        out, at, self.segments = [], 0, []
        length = 0
        for s, e, new in changes:
            out += [source[at:s], new]
            length += s - at
            self.segments.append((length, length + len(new), s, e))
            length += len(new)
            at = e
        out.append(source[at:])
        self.text = "".join(out)
        self.starts = [x[0] for x in self.segments]

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source characters of a span, widened to whole segments; whether it holds one."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        touched = j > i
        if i < 0:
            s = start
        else:
            a, b, c, d = self.segments[i]
            inside = start < b
            touched |= inside
            s = c if inside else start - b + d
        if j < 0:
            e = end
        else:
            a, b, c, d = self.segments[j]
            e = d if end - 1 < b else end - b + d
        return s, e, touched


def references(t: str) -> list[tuple[int, int, str]]:
    """Character references of printable ASCII characters."""
    out = []
    for m in _REFERENCE.finditer(t) if "&" in t else ():
        c = _NAMED[m[3]] if m[3] else chr(int(m[1]) if m[1] else int(m[2], 16))
        if " " <= c <= "~":
            out.append((m.start(), m.end(), c))
    return out


def lowered(t: str) -> str:
    """A text in lower case, character by character: the few letters that would become two stay."""
    low = t.lower()
    return low if len(low) == len(t) else "".join(c if len(c.lower()) > 1 else c.lower() for c in t)


def unseen(t: str) -> list[tuple[int, int, str]]:
    """Characters that do not show are left out."""
    return [] if t.isascii() else [(m.start(), m.end(), "") for m in _UNSEEN.finditer(t)]


def look_alikes(t: str) -> list[tuple[int, int, str]]:
    if t.isascii() or _LOOK_ALIKE.isdisjoint(t):
        return []
    return [(i, i + 1, LOOK_ALIKES[c]) for i, c in enumerate(t) if c in _LOOK_ALIKE]


def spelled_digits(t: str) -> list[tuple[int, int, str]]:
    """Runs of four or more digits of which three or more are spelled; gaps shrink to a space."""
    out = []
    for m in _SPELLED.finditer(lowered(t)):
        at, found, names = m.start(), [], 0
        plus = _PLUS.match(t, at)
        if plus:
            found.append((at, plus.end(), "+"))
            at = plus.end()
        while at < m.end() and (x := _TOKEN.match(t, at, m.end())):
            if x["name"]:
                times = _TIMES[x["times"].lower()] if x["times"] else 1
                names += times
                found.append((x.start(), x.end(), DIGIT_NAMES[x["name"].lower()] * times))
            elif x["gap"] and x["gap"] != " ":
                found.append((x.start(), x.end(), " "))
            elif x["plus"] and x["plus"] != "+":
                found.append((x.start(), x.end(), "+"))
            at = x.end()
        if names >= 3:
            out += found
    return out


def letters_for_digits(t: str) -> list[tuple[int, int, str]]:
    """Letters that look like digits, in numbers of which at most a third is such letters."""
    out = []
    for m in _MIXED.finditer(t) if _BESIDE.search(t) else ():
        at = [i for i in range(m.start(), m.end()) if t[i] in _FOR_DIGITS]
        if at and 2 * len(at) <= sum("0" <= c <= "9" for c in m[0]):
            out += [(i, i + 1, _FOR_DIGITS[t[i]]) for i in at]
    return out


def joined_addresses(t: str) -> list[tuple[int, int, str]]:
    """"at" and "dot" between hyphens or low lines, before a usual ending."""
    low = lowered(t)
    if not _JOINED_DOT.search(low):
        return []
    out = []
    for m in _JOINED.finditer(low):
        if _ENDING.fullmatch(low, m.end() - len(re.split("[_-]", m[0])[-1]), m.end()):
            out += [(m.start(), m.start() + 4, "@"), *[(d.start(), d.end(), ".") for d in _JOINED_DOT.finditer(low, m.start() + 4, m.end())]]
    return out


def _signs(t: str) -> Iterator[re.Match]:
    """Places that may be an "at", from left to right, with the space and brackets around them."""
    done = 0
    for core in _AT_CORE.finditer(lowered(t)):
        if core.start() < done:
            continue
        for s in range(max(done, core.start() - 2 * GAP - 1), core.start() + 1):
            m = _AT_SIGN.match(t, s)
            if m and m.end() >= core.end():
                done = m.end()
                yield m
                break


def spelled_addresses(t: str) -> list[tuple[int, int, str]]:
    """Disguised "at" and "dot" of whole addresses.

    A bare "at" counts only if a disguised "dot" follows, so "look at example.com" stays as it is; an
    "@" without spaces on both sides if one follows, or one in brackets stands before it.
    """
    out, done = [], 0
    for m in _signs(t):
        if m.start() < done or m.start() == 0 or t[m.start() - 1] not in _LOCAL:
            continue
        label, dots, end = _LABEL.match(t, m.end()), [], 0
        apart = _APART.fullmatch(m[0])  # then dots may stand apart too
        while label:
            end = label.end()
            dot = _DOT_OR_POINT.match(t, end) or (apart and _APART_DOT.match(t, end))
            label = dot and _LABEL.match(t, dot.end())
            if label:
                dots.append((dot.start(), dot.end()))
        if not dots:
            continue
        spelled = [d for d in dots if t[d[0] : d[1]] != "."]
        bracketed = any(b in t[m.start() : end] for b in "[({<")
        if "@" not in m[0] and not bracketed and not _ENDING.fullmatch(t, max(e for _, e in dots), end):
            continue  # words that happen to follow one another
        disguised = spelled or apart or any(b in m[0] for b in "[({<")
        if not disguised and m[0] != "@":
            continue
        before, at = [], m.start()
        while True:  # the local part's own disguised dots
            while at > done and t[at - 1] in _LOCAL:
                at -= 1
            dot = next((s for s in range(max(done, at - _LONGEST_DOT), at) if _DOT_SIGN.fullmatch(t, s, at)), done)
            if dot <= done or t[dot - 1] not in _LOCAL or t[dot - 1] == ".":
                break
            if not disguised and not any(b in t[dot:at] for b in "[({<"):
                break  # in a plain address a bare word "dot" is a word
            before.insert(0, (dot, at, "."))
            at = dot
        if not disguised and not before:
            continue
        out += before + [(m.start(), m.end(), "@")] + [(a, b, ".") for a, b in spelled]
        done = end
    return out


def spelled_points(t: str) -> list[tuple[int, int, str]]:
    """Disguised dots between four groups of digits."""
    return [(d.start(), d.end(), ".") for m in _POINTS.finditer(t) for d in _DOT_SIGN.finditer(t, m.start(), m.end())]


TRANSDUCERS = (references, unseen, look_alikes, spelled_digits, letters_for_digits, joined_addresses, spelled_addresses, spelled_points)


def added(t: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Identifiers that show only after rewriting, as spans of the source. One that touches a base
    span counts only if it holds it, and more, and is of its kind.
    """
    steps, now = [], t
    for f in TRANSDUCERS:
        changes = f(now)
        if changes:
            steps.append(Step(now, changes))
            now = steps[-1].text
    if not steps:
        return []
    taken = sorted((s, e, k) for s, k, e in base)
    out = []
    for s, kind, e in detect(now):
        touched = False
        for step in reversed(steps):
            s, e, hit = step.back(s, e)
            touched |= hit
        if not touched:
            continue
        # base spans of different kinds may overlap, but those of one kind do not: few lie before s
        k = bisect_right(taken, (s, -1, -1))
        near = taken[max(0, k - len(KINDS)) : k]
        while k < len(taken) and taken[k][0] < e:
            near.append(taken[k])
            k += 1
        if all(b <= s or (a >= s and b <= e and b - a < e - s and of == kind) for a, b, of in near):
            out.append((s, kind, e))
    return out


def spans(t: str) -> tuple[list, list]:
    base = detect(t)
    return base, added(t, base)


def _said(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, counts of plain identifiers, their digest, all spans, and how many were disguised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                base, more = spans(t or "")
                counts = [0] * 4
                for _, k, _ in base:
                    counts[k] += 1
                rows.append((i, *counts, hashlib.sha256(_said(base).encode()).hexdigest(), _said(sorted(base + more)), len(more)))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return bounded(docs).select("doc_id", text).mapInArrow(run, schema)


def op2_deobfuscated_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``, plain and disguised."""
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
