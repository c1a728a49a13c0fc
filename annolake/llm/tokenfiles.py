"""Token ids in flat binary files, with 64-bit document offsets, read memory-mapped.

One folder holds, for each part: ``N.bin`` ids one after another as unsigned integers (16 bits if
the vocabulary allows, else 32), ``N.idx`` 64-bit offsets of the documents in it and its end, and
``N.doc`` their 64-bit ids. ``parts`` is a table of the parts in order with their counts; a part's
base, the number of ids before it, is a prefix sum of the counts. Parts hold ascending ranges of
doc_id, so start = base + offset. The number of parts follows from the texts' bytes, so a part is
about ``PART_BYTES`` of text at any input, and parts are read in ranges of documents.

A file is written under a name of its own by each attempt, and only attempts that the parts table
names count, so retries leave no double rows. Texts are encoded in pre-tokens, which are kept in a
memory of bounded size.

Defined cases: a null text is an empty one and has the end id only; a null doc_id sorts first;
repeated rows are kept and lie next to each other, in several parts if there are many; documents
that share a doc_id lie in the order of their texts' hashes; an empty table gives an empty parts
table; other columns, of whatever name, are not read. A vocabulary file with a normaliser, another
pre-tokenizer or another model is refused.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import RangeReader, bounded, filesystem, shared_dir, table, written

END_ID = 2
#: Entries either half of the memory of encoded words holds.
MEMORY = 400_000
NO_ID = -(1 << 63)
#: Bytes of text that a part is meant for.
PART_BYTES = 1 << 30
#: Documents of a part that one task reads.
READ_DOCS = 1 << 16
#: Rows (documents) of one written or read batch.
BATCH = 512

# Fixed value: the pre-token pattern of byte-level vocabularies of this kind.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class WordEncoder:
    """Encodes texts with the tokenizers library, pre-token by pre-token.

    A pre-token begins at a single space between two other characters, at a single line feed between
    two others and after it, and at a comma or full stop that follows a letter or digit. Texts fall
    apart at such places; those with other white space or marks are split by the pattern.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        _refuse_others(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.split = regex.compile(PRE_TOKEN).findall
        self.odd = regex.compile(r"\s\s|[^\S \n]|^\s|\s$|[^\p{L}\p{N}\n][.,]|\x00|'").search
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.parts = _Parts(self)
        self.letters = _byte_letters()
        self.pack = "H" if self.kind.itemsize == 2 else "I"

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned integers of ``kind``."""
        if not text:
            return b""
        if any(s in text for s in self.special):  # the library takes these out before all else
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        if self.odd(text):
            parts = self.split(text)
        else:
            cut = text.replace(" ", "\0 ").replace("\n", "\0\n").replace(",", "\0,").replace(".", "\0.")
            parts = cut.split("\0")
        return b"".join(map(self.parts.__getitem__, parts))

    def part(self, part: str) -> bytes:
        """Ids of a part: of its one pre-token if it is a word, else of each of its pre-tokens."""
        if not part:
            return b""
        tokens = [part] if part[0] == " " and part[1:].isalpha() else self.split(part)
        ids = []
        for t in tokens:
            letters = t.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
            ids += [x.id for x in self.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}{self.pack}", *ids)


def _refuse_others(path: str) -> None:
    """Only byte-level pair encoding with the usual pattern is encoded pre-token by pre-token."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    pre, model = said.get("pre_tokenizer") or {}, said.get("model") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if said.get("normalizer") or not plain or model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges"):
        raise ValueError(f"{path}: not a byte-level vocabulary of pairs with the usual pre-tokens")


class _Parts(dict):
    """Ids of parts seen; when full, what was kept becomes the older half and is asked before encoding."""

    def __init__(self, encoder: WordEncoder):
        super().__init__()
        self.encoder = encoder
        self.older: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        got = self.older.get(part)
        if got is None:
            got = self.encoder.part(part)
        if len(part) <= 64:
            if len(self) >= MEMORY:
                self.older = dict(self)
                self.clear()
            self[part] = got
        return got


def _byte_letters() -> dict[int, int]:
    """The letter for each byte in byte-level vocabularies: printable ones stay, others follow 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of a vocabulary file, one in each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write(docs: DataFrame, vocabulary: str, out: str, end_id: int = END_ID, parts: int | None = None) -> DataFrame:
    """Write token files to ``out`` (a folder all executors reach); the parts table, with bases."""
    spark = docs.sparkSession
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("at"))
    if parts is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(-(-size // PART_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # the parts are numbered in the order of their ranges; many rows of one doc_id may be several parts
    ordered = rows.repartitionByRange(parts, "doc_id", "h", "at").sortWithinPartitions("doc_id", "h", "at")
    numbered = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from annolake.llm import tokenfiles

        enc = tokenfiles.encoder(vocabulary)
        fs, folder = filesystem(out)
        fs.create_dir(folder, recursive=True)
        name, part, tokens, docs_ = uuid.uuid4().hex, None, 0, 0
        end = np.array([end_id], enc.kind).tobytes()
        files = {}
        for b in batches:
            if not b.num_rows:
                continue
            if part is None:
                part = b.column(0)[0].as_py()
                files = {k: fs.open_output_stream(f"{folder}/{name}.{k}") for k in ("bin", "idx", "doc")}
                files["idx"].write(np.zeros(1, "<u8").tobytes())
            for at in range(0, b.num_rows, BATCH):
                some = b.slice(at, BATCH)
                ids = [enc.encode(t or "") + end for t in some.column(2).to_pylist()]
                sizes = np.array([len(x) // enc.kind.itemsize for x in ids], "<u8")
                files["bin"].write(b"".join(ids))
                files["idx"].write((np.cumsum(sizes, dtype="<u8") + np.uint64(tokens)).tobytes())
                files["doc"].write(np.array(some.column(1).fill_null(NO_ID), "<i8").tobytes())
                tokens += int(sizes.sum())
                docs_ += len(ids)
        for f in files.values():
            f.close()
        if part is not None:
            cols = [[part], [name], [enc.kind.itemsize], [docs_], [tokens]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
                ["part", "name", "width", "n_docs", "n_tokens"],
            )

    made = written(numbered.mapInArrow(run, "part int, name string, width int, n_docs long, n_tokens long"), "token-parts")
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    return made.withColumn("base", F.coalesce(F.sum("n_tokens").over(upto), F.lit(0)).cast("long"))


def read(parts: DataFrame, folder_uri: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in token files, memory-mapped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(folder_uri)
        for b in batches:
            for p in b.to_pylist():
                kind = np.dtype("<u2" if p["width"] == 2 else "<u4")
                idx, doc, ids = (RangeReader(fs, f"{folder}/{p['name']}.{k}") for k in ("idx", "doc", "bin"))
                end = min(p["first"] + READ_DOCS, p["n_docs"])
                for at in range(p["first"], end, BATCH):
                    n = min(BATCH, end - at)
                    cut = idx.numbers(np.dtype("<u8"), at, n + 1).astype("i8")
                    tokens = ids.numbers(kind, int(cut[0]), int(cut[-1] - cut[0]))
                    inner = (cut - cut[0]).tolist()
                    crc = [zlib.crc32(tokens[x:y].astype("<u4").tobytes()) for x, y in zip(inner, inner[1:], strict=False)]
                    own = doc.numbers(np.dtype("<i8"), at, n)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(own, pa.int64(), mask=own == NO_ID),
                            pa.array(cut[:-1] + p["base"], pa.int64()),
                            pa.array(np.diff(cut), pa.int64()),
                            pa.array(crc, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    ranges = parts.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(READ_DOCS).cast("long"))))
    n = ranges.count()  # a row a part and range
    spread = ranges.repartitionByRange(max(1, n), "part", "first") if n else ranges
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as token files in ascending doc_id order, read back."""
    out = shared_dir(spark, "token-files")
    parts = write(table(spark, sf_dir, "documents"), vocabulary_path(), out)
    return read(parts, out)
