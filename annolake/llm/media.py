"""ISO media containers as columns: boxes, sample tables, codec, duration, keyframe byte ranges.

``container`` stores bytes as raw 8-bit samples of one track; ``describe`` walks nested boxes of any
such file and decodes its sample tables, never the payload. Samples are given as byte ranges by
joining sample sizes, samples a chunk and chunk offsets; samples of movie fragments by their runs,
with the defaults of the fragment and of the movie. Times come from the time tables or runs, the
order of showing from composition offsets, and what is shown of a track from its edit list.

A media column is a table of its own: it is written, and what is told of it is read from there.

Defined cases: a null text is an empty one, stored as one block of filler; bytes that are no
container give no track; truncated boxes end the walk; tables that disagree are cut to the
shortest; equal texts and repeated rows give equal files; an empty table gives no rows; other
columns, of whatever name, are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded, table, written

SAMPLE = 576
FILLER = b"\xff"
#: Samples a chunk, and samples from one keyframe to the next, of the files written here.
IN_CHUNK, IN_GROUP = 64, 25
SCALE = 1000
CODEC = b"raw "
#: Boxes that hold boxes.
HOLDERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"moof", b"traf", b"mvex"))
#: Bit of a fragment's sample that depends on others.
NO_KEY = 0x10000


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24), *parts)


def container(data: bytes) -> bytes:
    """A file with one track of raw samples of ``SAMPLE`` bytes that hold ``data``, padded.

    ``data`` is padded with filler to a positive multiple of the sample's size.
    """
    payload = data + FILLER * (-len(data) % SAMPLE if data else SAMPLE)
    n = len(payload) // SAMPLE
    chunks = -(-n // IN_CHUNK)
    wide = len(payload) > 0xF0000000

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * (IN_CHUNK * SAMPLE)
        runs = [(1, IN_CHUNK)] if chunks > 1 else []
        last = n - (chunks - 1) * IN_CHUNK
        if not runs or last != IN_CHUNK:
            runs.append((chunks, last))
        keys = np.arange(1, n + 1, IN_GROUP)
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), _box(CODEC, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, SCALE << 16))),
            _full(b"stts", struct.pack(">III", 1, n, 1)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", a, b, 1) for a, b in runs]),
            _full(b"stsz", struct.pack(">II", SAMPLE, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url "))), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, SCALE, n, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"soun", bytes(13)), minf)
        tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(60))
        mvhd = _full(b"mvhd", struct.pack(">IIIII", 0, 0, SCALE, n, 0x10000), bytes(80))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    head = len(ftyp) + len(moov(0)) + (16 if wide else 8)
    if wide:
        mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload))
    else:
        mdat = struct.pack(">I4s", 8 + len(payload), b"mdat")
    return b"".join((ftyp, moov(head), mdat, payload))


def boxes(data: memoryview, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, where its body begins, where it ends) of the boxes in a range."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if body + 8 > end:
                return
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            return
        yield kind, body, start + size
        start += size


def walk(data: memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """The same for nested boxes, with the path of kinds that leads to each; at most 16 deep."""
    for kind, body, stop in boxes(data, start, end):
        yield (*path, kind), body, stop
        if kind in HOLDERS and len(path) < 16:
            yield from walk(data, body, stop, (*path, kind))


def _numbers(data: memoryview, at: int, stop: int, kind: str, width: int = 1) -> np.ndarray:
    """The entries of a table box: a count, then rows of ``width`` numbers."""
    if at + 8 > stop:
        return np.empty((0, width), np.int64)
    n = struct.unpack_from(">I", data, at + 4)[0]
    size = np.dtype(kind).itemsize * width
    n = min(n, (stop - at - 8) // size)
    return np.frombuffer(data, kind, n * width, at + 8).astype(np.int64).reshape(n, width)


def tracks(data: bytes) -> list[dict]:
    """Each track's codec, scale, duration, edits, and its samples' byte ranges, times and keyframes."""
    view, out = memoryview(data), []
    movie: dict = {"defaults": {}}
    top = 0  # where the box at the top level begins
    for path, at, stop in walk(view):
        kind = path[-1]
        if path == (b"moof",):
            movie["moof"] = top
        if len(path) == 1:
            top = stop
        if kind == b"trak":
            out.append({"fragments": []})
        elif kind == b"mvhd" and stop - at >= 24:
            movie["scale"] = struct.unpack_from(">I", view, at + (20 if view[at] == 1 else 12))[0]
        elif kind == b"trex" and stop - at >= 24:
            number, _, *values = struct.unpack_from(">IIIII", view, at + 4)
            movie["defaults"][number] = values
        elif kind in (b"tfhd", b"tfdt", b"trun") and b"traf" in path:
            _fragment(kind, view, at, stop, movie, out)
        elif out and b"trak" in path[:-1]:
            _of_track(kind, view, at, stop, out[-1])
    for t in out:
        _finish(t, movie)
    return out


def _of_track(kind: bytes, view: memoryview, at: int, stop: int, t: dict) -> None:
    """Take up one box of a track."""
    if kind == b"tkhd" and stop - at >= 24:
        t["number"] = struct.unpack_from(">I", view, at + (20 if view[at] == 1 else 12))[0]
    elif kind == b"mdhd" and stop - at >= 24:
        wide = view[at] == 1
        t["scale"], t["duration"] = struct.unpack_from(">IQ" if wide else ">II", view, at + (20 if wide else 12))
    elif kind == b"hdlr" and stop - at >= 12:
        t["handler"] = bytes(view[at + 8 : at + 12]).decode("latin-1")
    elif kind == b"elst":
        # duration and place in the media of each edit (32 or 64 bits), then 32 bits of rate
        form = ">qqI" if stop > at and view[at] == 1 else ">IiI"
        n = min(struct.unpack_from(">I", view, at + 4)[0], (stop - at - 8) // struct.calcsize(form)) if at + 8 <= stop else 0
        rows = struct.iter_unpack(form, view[at + 8 : at + 8 + n * struct.calcsize(form)])
        t["edits"] = np.array([x[:2] for x in rows], np.int64).reshape(-1, 2)
    elif kind == b"stsd":
        t["codec"] = next((k.decode("latin-1") for k, _, _ in boxes(view, at + 8, stop)), "")
    elif kind == b"stts":
        t["steps"] = _numbers(view, at, stop, ">u4", 2)
    elif kind == b"ctts":
        t["shifts"] = _numbers(view, at, stop, ">i4", 2)
    elif kind == b"stss":
        t["keys"] = _numbers(view, at, stop, ">u4")[:, 0]
    elif kind == b"stsc":
        t["runs"] = _numbers(view, at, stop, ">u4", 3)
    elif kind == b"stsz" and stop - at >= 12:
        size, n = struct.unpack_from(">II", view, at + 4)
        # a count without a table is bounded by the file: samples of one size lie in it
        t["sizes"] = np.full(min(n, len(view) // size + 1), size, np.int64) if size else _numbers(view, at + 4, stop, ">u4")[:, 0]
    elif kind == b"stz2" and stop - at >= 12:
        width, n = view[at + 7], struct.unpack_from(">I", view, at + 8)[0]
        raw = np.frombuffer(view[at + 12 : stop], np.uint8)
        if width == 4:
            raw = np.stack((raw >> 4, raw & 15), 1).reshape(-1)
        elif width == 16:
            raw = raw[: len(raw) // 2 * 2].view(">u2")
        t["sizes"] = raw[:n].astype(np.int64)
    elif kind in (b"stco", b"co64"):
        t["chunks"] = _numbers(view, at, stop, ">u4" if kind == b"stco" else ">u8")[:, 0]


def _fragment(kind: bytes, view: memoryview, at: int, stop: int, movie: dict, out: list[dict]) -> None:
    """Take up a box of a movie fragment: its header's defaults, its time, or one run of samples."""
    if stop - at < 8:
        return
    flags = struct.unpack_from(">I", view, at)[0] & 0xFFFFFF
    if kind == b"tfhd":
        number = struct.unpack_from(">I", view, at + 4)[0]
        now = {"track": next((t for t in out if t.get("number") == number), None), "at": movie["moof"], "time": None}
        values, p = list(movie["defaults"].get(number, (0, 0, 0))), at + 8
        for bit, form in ((0x1, ">q"), (0x2, ">I"), (0x8, ">I"), (0x10, ">I"), (0x20, ">I")):
            if flags & bit and p + struct.calcsize(form) <= stop:
                x = struct.unpack_from(form, view, p)[0]
                p += struct.calcsize(form)
                if bit == 0x1:
                    now["at"] = x
                elif bit > 0x2:
                    values[(0x8, 0x10, 0x20).index(bit)] = x
        now["values"], now["base"] = values, now["at"]
        movie["now"] = now
        return
    now = movie.get("now")
    if now is None or now["track"] is None:
        return
    if kind == b"tfdt":
        wide = view[at] == 1
        if stop - at >= (12 if wide else 8):
            now["time"] = struct.unpack_from(">q" if wide else ">I", view, at + 4)[0]
        return
    n, p = struct.unpack_from(">I", view, at + 4)[0], at + 8
    if flags & 0x1 and p + 4 <= stop:
        now["at"] = now["base"] + struct.unpack_from(">i", view, p)[0]
        p += 4
    first = struct.unpack_from(">I", view, p)[0] if flags & 0x4 and p + 4 <= stop else None
    p += 4 * bool(flags & 0x4)
    given = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
    # runs without columns are bounded by the file
    n = min(n, max(0, stop - p) // (4 * len(given)) if given else len(view) // max(1, now["values"][1]) + 1)
    table = np.frombuffer(view, ">u4", n * len(given), p).astype(np.int64).reshape(n, len(given)) if given and n else np.empty((n, len(given)), np.int64)
    column = {bit: table[:, i] for i, bit in enumerate(given)}
    length, size, marks = (column.get(bit, np.full(n, x, np.int64)) for bit, x in zip((0x100, 0x200, 0x400), now["values"], strict=True))
    if first is not None and n:
        marks = np.concatenate(([first], marks[1:]))
    start = now["at"] + np.cumsum(size) - size
    shift = column.get(0x800, np.zeros(n, np.int64)).astype(np.uint32).view(np.int32).astype(np.int64)
    now["track"]["fragments"].append((np.stack((start, start + size), 1), length, shift, (marks & NO_KEY) == 0, now["time"]))
    now["at"] += int(size.sum())
    now["time"] = None  # later runs of the fragment follow on


def _finish(t: dict, movie: dict) -> None:
    """Samples of the tables, then those of the fragments: ranges, times, composition, keyframes."""
    ranges = _ranges(t)
    n = len(ranges)

    def spread(rows: np.ndarray | None) -> np.ndarray:
        """A table of (count, value) as a value a sample, as many as there are samples."""
        if rows is None or not len(rows):
            return np.zeros(n, np.int64)
        upto = np.minimum(np.cumsum(np.minimum(rows[:, 0], n)), n)
        out = np.repeat(rows[:, 1], np.diff(upto, prepend=0))
        return np.concatenate((out, np.full(n - len(out), rows[-1, 1])))

    length, shift = spread(t.get("steps")), spread(t.get("shifts"))
    key = np.ones(n, bool)
    if "keys" in t:
        key = np.zeros(n, bool)
        key[t["keys"][(t["keys"] >= 1) & (t["keys"] <= n)] - 1] = True
    time = np.cumsum(length) - length
    end = int(length.sum())
    parts = [(ranges, time, length, shift, key)]
    for r, d, c, k, begin in t.pop("fragments"):
        begin = end if begin is None else begin
        parts.append((r, begin + np.cumsum(d) - d, d, c, k))
        end = begin + int(d.sum())
    t["ranges"], t["times"], t["lengths"], shift, key = (np.concatenate(x) for x in zip(*parts, strict=True))
    t["shown"] = t["times"] + shift
    t["key_ranges"] = t["ranges"][key]
    # a fragmented file's header may not know how long it gets
    t["duration"] = max(t.get("duration", 0) if t.get("duration") != (1 << 32) - 1 else 0, end)
    if movie.get("scale") and len(t.get("edits", ())):
        t["presented"] = float(t["edits"][:, 0].sum()) / movie["scale"]


def _ranges(t: dict) -> np.ndarray:
    """(from, to) of each sample: chunk offsets, samples a chunk, and sizes put together."""
    chunks, runs, sizes = t.get("chunks", np.empty(0, np.int64)), t.get("runs", np.empty((0, 3), np.int64)), t.get("sizes", np.empty(0, np.int64))
    if not len(chunks) or not len(runs):
        return np.empty((0, 2), np.int64)
    first = np.clip(runs[:, 0] - 1, 0, len(chunks))
    each = np.repeat(runs[:, 1], np.diff(np.append(first, len(chunks)).clip(min=first[0])).clip(min=0))
    chunk = np.repeat(np.arange(len(each)) + first[0], each)[: len(sizes)]
    sizes = sizes[: len(chunk)]
    upto = np.cumsum(sizes) - sizes
    begins = np.searchsorted(chunk, np.arange(len(chunks)))
    start = chunks[chunk] + upto - upto[np.minimum(begins, len(upto) - 1)][chunk] if len(chunk) else upto
    return np.stack((start, start + sizes), 1)


def describe(data: bytes) -> dict:
    """Codec, seconds, and sample and keyframe ranges of the first track, and what each track is."""
    found = tracks(data)
    t = found[0] if found else {"ranges": np.empty((0, 2), np.int64), "key_ranges": np.empty((0, 2), np.int64)}
    each = [
        {
            "codec": x.get("codec", "").strip(),
            "handler": x.get("handler", ""),
            "duration_s": x["duration"] / x["scale"] if x.get("scale") else 0.0,
            "presented_s": x.get("presented"),
            "n_samples": len(x["ranges"]),
            "n_keyframes": len(x["key_ranges"]),
        }
        for x in found
    ]
    first = each[0] if each else {"codec": "", "duration_s": 0.0}
    return {"codec": first["codec"], "seconds": first["duration_s"], "tracks": each, "ranges": t["ranges"], "key_ranges": t["key_ranges"]}


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, and the text's bytes in a container, as a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in some.column(1).to_pylist()]
                cols = [some.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([container(x) for x in raw], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "media"])

    return bounded(docs).select("doc_id", text).mapInArrow(run, "doc_id long, n_bytes long, media binary")


FACTS = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, codec string, duration_s double, n_samples long, n_keyframes long, "
    "keyframes array<struct<first:long,after:long>>, "
    "tracks array<struct<codec:string,handler:string,duration_s:double,presented_s:double,n_samples:long,n_keyframes:long>>"
)


def facts(media: DataFrame) -> DataFrame:
    """What a column of containers holds: sample tables decoded, the payload read back by its ranges."""
    names = [c.split(" ")[0] for c in FACTS.rsplit(", keyframes", 1)[0].split(", ")] + ["keyframes", "tracks"]
    span = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))
    number, text = pa.int64(), pa.string()
    track = pa.list_(
        pa.struct([("codec", text), ("handler", text), ("duration_s", pa.float64()), ("presented_s", pa.float64()), ("n_samples", number), ("n_keyframes", number)])
    )
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), span, track]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, n, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                d = describe(m)
                r, keys = d["ranges"], d["key_ranges"]
                if len(r) and (r[1:, 0] == r[:-1, 1]).all():
                    payload = memoryview(m)[int(r[0, 0]) : int(r[-1, 1])]
                else:
                    payload = b"".join([m[x:y] for x, y in r.tolist()])
                said = hashlib.sha256(keys.astype("<i8").tobytes()).hexdigest()[:16]
                feature = f"codec={d['codec']};duration={d['seconds']:.3f};samples={len(r)};keyframes={len(keys)};ranges={said}"
                spans = [{"first": x, "after": y} for x, y in keys.tolist()]
                rows.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature, d["codec"], d["seconds"], len(r), len(keys), spans, d["tracks"]))
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FACTS)


def op7_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` as a media column, and what its containers say."""
    return facts(written(store(table(spark, sf_dir, "documents")), "media", compression="zstd"))
