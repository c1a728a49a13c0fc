"""Exact piece encoding by backtracking, and decoding.

Merging pieces by score is a local rule: a cut of a text into pieces is what merging gives if and
only if every two neighbours stay apart when their joined text is merged anew. So no queue of
merges is needed: an Aho-Corasick automaton tells the longest piece at each place, the encoder
takes it, checks it against its left neighbour, falls back to the next shorter piece, and marks in a
bitfield the places from which no way leads on, so that none is tried twice.

Texts fall apart at characters that no longer piece holds, and before a word's space mark; the
parts are encoded once each and remembered in a table of bounded size. Runs of spaces, whose pieces
tie in score, are merged directly.

Defined cases: a null text is an empty one and gives the begin and end ids only; unknown characters
become their bytes; texts of any length are encoded whole, in linear time.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded, table

MARK = "▁"
BEGIN, END = 1, 2
#: Entries either half of the memory of parts holds, and the memory of neighbours.
MEMORY = 400_000
_BYTES = re.compile(r"<0x([0-9A-F]{2})>\Z")


class PieceCodec:
    """Encoder and decoder of one vocabulary file of merge type with byte fallback."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte_id = {}
        self.rank: dict[str, tuple[float, int]] = {}
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_id[int(_BYTES.match(p)[1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.rank[p] = (-sp.get_score(i), i)
        self.id_of = {p: i for p, (_, i) in self.rank.items()}
        longer = [p for p in self.rank if len(p) > 1]
        self.joined = {c for p in longer for c in p}
        self.known = frozenset(p for p in self.rank if len(p) == 1)
        self.side_by_side = frozenset(p[k : k + 2] for p in longer for k in range(len(p) - 1))
        if any(MARK in p.lstrip(MARK) for p in longer):
            raise ValueError("a piece holds a space mark after a letter: texts do not fall apart at words")
        self.automaton = ahocorasick.Automaton()
        for p, (_, i) in self.rank.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.length = [len(p) for p in self.pieces]
        self.shorter: dict[int, int] = {}
        self.apart: dict[int, bool] = {}
        self.logs: dict[int, tuple[list, list, bool]] = {}
        edge = "".join(map(re.escape, (c for c in "\n\t\r" if c not in self.joined)))
        self._parts = re.compile(rf"[{edge}]+|{MARK}*[^{MARK}{edge}]+|{MARK}+" if edge else rf"{MARK}*[^{MARK}]+|{MARK}+")
        # a mark or comma or full stop begins a part, but after characters it may merge with
        before = "".join(c for c in map(chr, range(48, 592)) if c.isalnum() and c + "," not in self.side_by_side and c + "." not in self.side_by_side)
        plain = all(c not in self.joined for c in "\n\0")
        self._odd = re.compile(rf"{MARK}{MARK}|{MARK}\Z|\0|[^{before}\n][.,]" if plain else "").search
        self.memory = _Memory(self)
        self._text = [p.replace(MARK, " ") for p in self.pieces]
        self._high = np.zeros(len(self.pieces), bool)
        for b, i in self.byte_id.items():
            self._text[i] = chr(b) if b < 128 else ""
            self._high[i] = b >= 128
        self._text[BEGIN] = self._text[END] = ""

    def merged(self, s: str) -> list[int]:
        """The pieces of ``s`` by merging the best pair again and again; a queue keeps the pairs."""
        chars: list[str | None] = list(s)
        n = len(chars)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            if p := self.rank.get(s[i : i + 2]):
                queue.append((p[0], i, i + 1, s[i : i + 2]))
        heapq.heapify(queue)
        while queue:
            _, i, j, p = heapq.heappop(queue)
            if chars[i] is None or after[i] != j or chars[j] is None or chars[i] + chars[j] != p:
                continue
            chars[i], chars[j] = p, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := self.rank.get(chars[a] + chars[b])):
                    heapq.heappush(queue, (r[0], a, b, chars[a] + chars[b]))
        out = []
        for c in chars:
            if c is not None:
                if c in self.id_of:
                    out.append(self.id_of[c])
                else:
                    out += [self.byte_id[b] for b in c.encode("utf-8", "surrogatepass")]
        return out

    def _log(self, piece: int) -> tuple[list, list, bool]:
        """How merging makes a piece of its characters: its last and first part after each merge.

        Two lists of (rank of the merge that comes next, part now), and whether the piece comes out.
        """
        s = self.pieces[piece]
        parts, ends, rank = list(s), [], self.rank
        while True:
            best = None
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r and (best is None or r[0] < best[0]):
                    best = (r[0], i)
            ends.append((best[0] if best else float("inf"), parts[-1], parts[0]))
            if best is None:
                return [x[:2] for x in ends], [(x[0], x[2]) for x in ends], len(parts) == 1
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _fits(self, left: int, right: int) -> bool:
        """Whether two neighbours stay apart when their text is merged anew.

        Both are merged side by side, best merge first, by what each does on its own; they do not
        stay apart if at some point the best merge is one across the border.
        """
        if len(self.apart) >= MEMORY:
            self.apart.clear()
        logs = self.logs
        for p in (left, right):
            if p >= 0 and p not in logs:
                logs[p] = self._log(p)
        known = logs[right][2] and (left < 0 or logs[left][2])
        if left >= 0 and known:
            x, y, rank = logs[left][0], logs[right][1], self.rank
            i = j = 0
            while True:
                (p, a), (q, b) = x[i], y[j]
                r = rank.get(a + b)
                if r and r[0] < p and r[0] <= q:
                    known = False
                    break
                if p <= q:
                    if i + 1 == len(x):
                        break
                    i += 1
                else:
                    j += 1
        self.apart[left << 32 | right] = known
        return known

    def _shorter(self, piece: int) -> int:
        """The longest piece that begins ``piece`` and is shorter, or -1."""
        got = self.shorter.get(piece)
        if got is None:
            p = self.pieces[piece]
            got = next((self.id_of[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.id_of), -1)
            self.shorter[piece] = got
        return got

    def backtracked(self, s: str) -> list[int]:
        """The pieces of ``s``, all of whose characters are pieces, by longest match and backtracking."""
        n = len(s)
        longest = [0] * (n + 1)
        for end, (k, i) in self.automaton.iter(s):
            longest[end - k + 1] = i  # later ends come later: the longest stays
        failed = 0  # a bit for each place from which no way leads on
        length, apart, shorter = self.length, self.apart, self.shorter
        out: list[int] = []
        at, piece, left = 0, longest[0], -1
        while at < n:
            while piece >= 0:
                end = at + length[piece]
                if not failed >> end & 1:
                    fits = apart.get(left << 32 | piece)
                    if fits or fits is None and self._fits(left, piece):
                        break
                piece = shorter[piece] if piece in shorter else self._shorter(piece)
            if piece >= 0:
                out.append(piece)
                left, at, piece = piece, end, longest[end]
            else:
                if not out:
                    return self.merged(s)
                failed |= 1 << at
                last = out.pop()
                at -= length[last]
                left = out[-1] if out else -1
                piece = self._shorter(last)
        return out

    def part(self, s: str) -> list[int]:
        """The pieces of a part without a space mark after a letter."""
        if s.startswith(MARK * 2):
            return self.merged(s)
        if self.known.issuperset(s):
            return self.backtracked(s)
        out: list[int] = []
        at = 0
        for k, c in enumerate(s):
            if c not in self.known:
                if k > at:
                    out += self.backtracked(s[at:k])
                out += [self.byte_id[b] for b in c.encode("utf-8", "surrogatepass")]
                at = k + 1
        if at < len(s):
            out += self.backtracked(s[at:])
        return out

    def cut(self, s: str) -> list[str]:
        """``s`` cut between characters that stand side by side in no piece: no merge gets across."""
        side, out, at = self.side_by_side, [], 0
        for k in range(1, len(s)):
            if s[k - 1 : k + 1] not in side:
                out.append(s[at:k])
                at = k
        out.append(s[at:])
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, begin and end included, as unsigned 32-bit integers."""
        return np.frombuffer(self.packed(text), "<u4")

    def packed(self, text: str) -> bytes:
        """The same as little-endian bytes."""
        if not text:
            return b"\1\0\0\0\2\0\0\0"
        marked = MARK + text.replace(" ", MARK)
        if self._odd(marked):
            parts = self._parts.findall(marked)
        else:
            parts = marked.replace(MARK, "\0" + MARK).replace("\n", "\0\n").replace(",", "\0,").replace(".", "\0.").split("\0")
        return b"\1\0\0\0" + b"".join(map(self.memory.__getitem__, parts)) + b"\2\0\0\0"

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, marks as spaces, bytes read as UTF-8, the first mark gone."""
        text = self._text
        if not self._high[ids].any():
            s = "".join([text[i] for i in ids.tolist()])
        else:
            out, held = [], bytearray()
            of_byte = {i: b for b, i in self.byte_id.items()}
            for i in ids.tolist():
                if i in of_byte:
                    held.append(of_byte[i])
                    continue
                if held:
                    out.append(_utf8(bytes(held)))
                    held.clear()
                out.append(text[i])
            out.append(_utf8(bytes(held)))
            s = "".join(out)
        first = next((i for i in ids.tolist() if i not in (BEGIN, END)), None)
        return s[1:] if first is not None and self.pieces[first].startswith(MARK) else s


def _utf8(b: bytes) -> str:
    """Bytes as text; each byte that is not part of a character becomes a replacement mark."""
    out, at = [], 0
    while at < len(b):
        for k in (1, 2, 3, 4):
            try:
                out.append(b[at : at + k].decode())
                at += k
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


class _Memory(dict):
    """Packed ids of parts seen; when full, what was kept becomes the older half and is asked first."""

    def __init__(self, codec: PieceCodec):
        super().__init__()
        self.codec = codec
        self.older: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        got = self.older.get(part)
        if got is None:
            cut = self.codec.cut(part)
            if len(cut) > 1:
                got = b"".join([self[x] for x in cut])
            else:
                ids = self.codec.part(part) if part else []
                got = struct.pack(f"<{len(ids)}I", *ids)
        if len(part) <= 64:
            if len(self) >= MEMORY:
                self.older = dict(self)
                self.clear()
            self[part] = got
        return got


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """The codec of a vocabulary file, one in each Python worker."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode_texts(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """doc_id, ids, and the text that the ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from annolake.llm import pieces

        c = pieces.codec(model)
        for b in batches:
            ids = [c.encode(t or "") for t in b.column(1).to_pylist()]
            cols = [b.column(0), pa.array([x.astype("i4") for x in ids], pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "decoded"])

    return bounded(docs).select("doc_id", text).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from annolake.llm import pieces

        c = pieces.codec(model)
        for b in batches:
            n, ids_hex, text_hex = [], [], []
            for t in b.column(1).to_pylist():
                packed = c.packed(t or "")
                n.append(len(packed) // 4)
                ids_hex.append(hashlib.sha256(packed).hexdigest())
                decoded = c.decode(np.frombuffer(packed, "<u4"))
                text_hex.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return bounded(docs).select("doc_id", text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and digests of the documents that are left."""
    return digests(docs, model_path())


def op4_backtracking_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` as piece ids and back."""
    return digests(table(spark, sf_dir, "documents"), model_path())
