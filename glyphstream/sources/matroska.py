"""Matroska containers as tables: their tracks' description, and graphic subtitle tracks as raw streams (RFC 9559).

A file is walked by element headers; only track entries and blocks of wanted tracks are read, so memory is bounded by the subtitles. Large files
are cut at clusters, which their cues or a walk over the headers tell, and read by several tasks (see ``containers``, the data source).
Paths are opened in the workers: mounted ones directly, others by the file system that their scheme names.
"""

from __future__ import annotations

import bz2
import json
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame

from glyphstream.sources.files import local

#: Fixed values of the format: element identifiers, track types, block header flags, content encodings.
SEGMENT, CLUSTER, BLOCK_GROUP = 0x18538067, 0x1F43B675, 0xA0
INFO, TIMESTAMP_SCALE, TRACKS, TRACK_ENTRY = 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE
TIMESTAMP, SIMPLE_BLOCK, BLOCK = 0xE7, 0xA3, 0xA1
NUMBER, TYPE, CODEC_ID, NAME, LANGUAGE, LANGUAGE_BCP47 = 0xD7, 0x83, 0x86, 0x536E, 0x22B59C, 0x22B59D
ENABLED, DEFAULT, FORCED = 0xB9, 0x88, 0x55AA
ENCODINGS, ENCODING, COMPRESSION, ALGORITHM, SETTINGS, ENCRYPTION = 0x6D80, 0x6240, 0x5034, 0x4254, 0x4255, 0x5035
SEEK_HEAD, SEEK, SEEK_ID, SEEK_POSITION = 0x114D9B74, 0x4DBB, 0x53AB, 0x53AC
CUES, CUE_POINT, CUE_TRACK_POSITIONS, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB7, 0xF1
KINDS = {1: "video", 2: "audio", 17: "subtitles"}
LACING, XIPH, FIXED, EBML = 0x06, 0x02, 0x04, 0x06
PGS_CODEC, PGS_NAME = "S_HDMV/PGS", "HDMV PGS"
ZLIB, BZLIB, STRIPPED = 0, 1, 3
DEFAULT_SCALE = 1_000_000


def opened(path: str) -> BinaryIO:
    """A seekable reader of the path."""
    if "://" in path and not path.startswith("file:"):
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path)
        return system.open_input_file(at)
    return open(local(path), "rb")


def _header(f: BinaryIO) -> tuple[int, int | None] | None:
    """(identifier, size) of the next element; size is None if unknown. None at the file's end, and for a header that is cut."""
    first = f.read(1)
    if not first or not first[0]:
        return None
    more = 8 - first[0].bit_length()
    ident = int.from_bytes(first + f.read(more), "big")
    first = f.read(1)
    if not first or not first[0]:
        return None
    more = 8 - first[0].bit_length()
    rest = f.read(more)
    if len(rest) < more:
        return None
    size = (first[0] & (1 << (7 - more)) - 1) << 8 * more | int.from_bytes(rest, "big")
    return ident, None if size == (1 << 7 * (more + 1)) - 1 else size


def _children(data: bytes) -> Iterator[tuple[int, bytes]]:
    import io

    f = io.BytesIO(data)
    while (head := _header(f)) is not None:
        yield head[0], f.read(head[1] if head[1] is not None else -1)


def _walk(f: BinaryIO, end: int | None = None) -> Iterator[tuple[int, int | None]]:
    """(identifier, size) of elements that begin before end; containers of blocks are entered, the rest is passed over unless the caller reads it."""
    while (end is None or f.tell() < end) and (head := _header(f)) is not None:
        ident, size = head
        if ident in (SEGMENT, CLUSTER, BLOCK_GROUP):
            continue
        if size is None:
            raise ValueError(f"element 0x{ident:x} of unknown size")
        after = f.tell() + size
        yield ident, size
        f.seek(after)


def _entry(data: bytes) -> dict:
    of: dict[int, bytes] = {}
    for ident, body in _children(data):
        of[ident] = body
    number = lambda k, default=0: int.from_bytes(of[k], "big") if k in of else default
    text = lambda k: of[k].rstrip(b"\0").decode("utf-8", "replace") if k in of else None
    codec = text(CODEC_ID) or ""
    encodings: list[tuple[int, bytes] | None] = []
    for ident, body in _children(of.get(ENCODINGS, b"")):
        if ident == ENCODING:
            parts = dict(_children(body))
            packed = dict(_children(parts.get(COMPRESSION, b"")))
            encodings.append(None if ENCRYPTION in parts else (int.from_bytes(packed.get(ALGORITHM, b""), "big"), packed.get(SETTINGS, b"")))
    shown = {"codec_id": codec, "number": number(NUMBER), "language": text(LANGUAGE) or "eng", "language_ietf": text(LANGUAGE_BCP47), "track_name": text(NAME), "default_track": bool(number(DEFAULT, 1)), "enabled_track": bool(number(ENABLED, 1)), "forced_track": bool(number(FORCED))}
    return {"type": KINDS.get(number(TYPE), "other"), "codec": PGS_NAME if codec == PGS_CODEC else codec, "properties": shown, "encodings": encodings}


def entries(f: BinaryIO) -> list[dict]:
    """Tracks in the order of the file; identifiers count from 0."""
    return head(f)["tracks"]


def _unpacked(frame: bytes, encodings: list) -> bytes:
    for encoding in reversed(encodings):
        if encoding is None:
            raise ValueError("an encrypted track")
        how, settings = encoding
        if how == ZLIB:
            frame = zlib.decompress(frame)
        elif how == BZLIB:
            frame = bz2.decompress(frame)
        elif how == STRIPPED:
            frame = settings + frame
        else:
            raise ValueError(f"compression {how} is not supported")
    return frame


def _with_headers(frame: bytes, ticks: int) -> bytes:
    """Segments of a block, each with the header it has in a raw stream."""
    out, at = [], 0
    head = b"PG" + (ticks & 0xFFFFFFFF).to_bytes(4, "big") + bytes(4)
    while at + 3 <= len(frame):
        end = at + 3 + int.from_bytes(frame[at + 1 : at + 3], "big")
        out += [head, frame[at:end]]
        at = end
    return b"".join(out)


def _number(data: bytes, at: int) -> tuple[int, int, int]:
    """(value, bytes used, value of all ones) of a variable-length number."""
    if at >= len(data) or not data[at]:
        raise ValueError("a laced block is cut short")
    used = 9 - data[at].bit_length()
    ones = (1 << 7 * used) - 1
    return int.from_bytes(data[at : at + used], "big") & ones, used, ones


def frames(data: bytes, lacing: int) -> list[bytes]:
    """The frames of a block's content: one without lacing; else a count less one, and the sizes of all but the last (Xiph's and EBML's), or equal ones."""
    if not lacing:
        return [data]
    if not data:
        raise ValueError("a laced block is cut short")
    n, at, sizes = data[0] + 1, 1, []
    if lacing == FIXED:
        if (len(data) - 1) % n:
            raise ValueError("a block's frames aren't of one size")
        sizes = [(len(data) - 1) // n] * (n - 1)
    for k in range(n - 1 if lacing != FIXED else 0):
        if lacing == XIPH:
            end = next((i for i in range(at, len(data)) if data[i] != 255), len(data) - 1)
            sizes.append(sum(data[at : end + 1]))
            at = end + 1
        else:
            value, used, ones = _number(data, at)
            sizes.append(value if k == 0 else sizes[-1] + value - (ones >> 1))
            at += used
    if min(sizes, default=0) < 0 or at + sum(sizes) > len(data):
        raise ValueError("a laced block is cut short")
    out = []
    for size in sizes:
        out.append(data[at : at + size])
        at += size
    return [*out, data[at:]]


def _elements(f: BinaryIO) -> Iterator[tuple[int, int, int | None]]:
    """(offset, identifier, size) of a segment's elements; clusters are passed over by their size, or entered where that is unknown."""
    while True:
        at = f.tell()
        head = _header(f)
        if head is None:
            return
        ident, size = head
        after = f.tell() + (size or 0)
        yield at, ident, size
        if ident == SEGMENT or size is None and ident in (CLUSTER, BLOCK_GROUP):
            f.seek(after - (size or 0))
        elif size is None:
            raise ValueError(f"element 0x{ident:x} of unknown size")
        else:
            f.seek(after)


def head(f: BinaryIO) -> dict:
    """What stands before the clusters: tracks (see entries), scale, base (where positions count from), first (the first cluster's offset or None), and cues (its offset or None)."""
    out = {"tracks": None, "scale": DEFAULT_SCALE, "base": 0, "first": None, "cues": None}
    f.seek(0)
    for at, ident, size in _elements(f):
        if ident == SEGMENT:
            out["base"] = f.tell()
        elif ident == SEEK_HEAD:
            for kind, body in _children(f.read(size)):
                to = dict(_children(body)) if kind == SEEK else {}
                if int.from_bytes(to.get(SEEK_ID, b""), "big") == CUES:
                    out["cues"] = out["base"] + int.from_bytes(to.get(SEEK_POSITION, b""), "big")
        elif ident == INFO:
            out["scale"] = int.from_bytes(dict(_children(f.read(size))).get(TIMESTAMP_SCALE, DEFAULT_SCALE.to_bytes(4, "big")), "big")
        elif ident == TRACKS:
            out["tracks"] = [{"id": n} | _entry(body) for n, body in enumerate(body for k, body in _children(f.read(size)) if k == TRACK_ENTRY)]
        elif ident == CLUSTER and out["first"] is None:
            out["first"] = at
        if out["first"] is not None and out["tracks"] is not None:
            break
    if out["tracks"] is None:
        raise ValueError("no tracks element")
    return out


def seek_points(f: BinaryIO) -> tuple[list[int], str]:
    """Offsets of clusters in order, the first one included: those that the cues name, or all by a walk over the headers; and which of both."""
    h = head(f)
    if h["first"] is None:
        return [], "walk"
    if h["cues"] is not None:
        f.seek(h["cues"])
        found = _header(f)
        if found is not None and found[0] == CUES and found[1] is not None:
            points = {h["first"]}
            for kind, body in _children(f.read(found[1])):
                for inner, where in _children(body) if kind == CUE_POINT else ():
                    if inner == CUE_TRACK_POSITIONS:
                        points |= {h["base"] + int.from_bytes(x, "big") for k, x in _children(where) if k == CUE_CLUSTER_POSITION}
            if all(_is_cluster(f, at) for at in points):
                return sorted(points), "cues"
    f.seek(h["first"])
    return [at for at, ident, _ in _elements(f) if ident == CLUSTER], "walk"


def _is_cluster(f: BinaryIO, at: int) -> bool:
    f.seek(at)
    return f.read(4) == CLUSTER.to_bytes(4, "big")


def length(f: BinaryIO) -> int:
    return f.seek(0, 2)


def cuts(f: BinaryIO, split: int) -> list[tuple[int, int]]:
    """Ranges (start, end) of a file's bytes, each from one cluster to another and of about split bytes; small files have one from 0, without being read."""
    size = length(f)
    if size <= split:
        return [(0, size)]
    starts = [0]
    for at in seek_points(f)[0]:
        if at - starts[-1] >= split:
            starts.append(at)
    return list(zip(starts, [*starts[1:], size]))


def part(f: BinaryIO, wanted: set[int], start: int = 0, end: int | None = None, told: dict | None = None) -> dict[int, bytes]:
    """Raw stream of each wanted track (by identifier) from the clusters of a range (see cuts). ValueError for encrypted blocks."""
    told = told or head(f)
    of = {t["properties"]["number"]: (t["id"], t["encodings"]) for t in told["tracks"] if t["id"] in wanted}
    out: dict[int, list[bytes]] = {k: [] for k in wanted}
    f.seek(max(start, told["first"] if told["first"] is not None else length(f)))
    base = 0
    for ident, size in _walk(f, end):
        if ident == TIMESTAMP:
            base = int.from_bytes(f.read(size), "big")
        elif ident in (SIMPLE_BLOCK, BLOCK):
            first = f.read(1)
            more = 8 - first[0].bit_length() if first and first[0] else 0
            block = first + f.read(more + 3)
            number = int.from_bytes(block[: more + 1], "big") & (1 << 7 * (more + 1)) - 1
            if number not in of:
                continue
            track, encodings = of[number]
            at = base + int.from_bytes(block[more + 1 : more + 3], "big", signed=True)
            for frame in frames(f.read(size - len(block)), block[-1] & LACING):
                out[track].append(_with_headers(_unpacked(frame, encodings), max(at, 0) * told["scale"] * 9 // 100_000))
    return {k: b"".join(v) for k, v in out.items()}


def streams(f: BinaryIO, wanted: set[int]) -> dict[int, bytes]:
    """Raw stream of each wanted track of a whole file; the frames of a laced block share its time."""
    return part(f, wanted)


def spread(files: DataFrame) -> DataFrame:
    """files by path over a stated number of partitions, which adaptive execution leaves as they are: their rows are few, the work behind them isn't."""
    return files.repartition(4 * files.sparkSession.sparkContext.defaultParallelism, "path")


def seek_table(files: DataFrame) -> DataFrame:
    """(path, number, offset, size, source, error) of files (path): the clusters at which each can be entered, told by cues or a walk."""

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                try:
                    with opened(path) as f:
                        at, source = seek_points(f)
                        rows = [(path, k, x, y - x, source, None) for k, (x, y) in enumerate(zip(at, [*at[1:], length(f)]))]
                except (OSError, ValueError) as e:
                    rows = [(path, None, None, None, None, f"{type(e).__name__}: {e}")]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["path", "number", "offset", "size", "source", "error"])

    return spread(files.select("path")).mapInArrow(run, "path string, number long, offset long, size long, source string, error string")


def described(files: DataFrame) -> DataFrame:
    """(path, json, error) of files (path): the description that functions.tracks.parsed reads; a file that can't be read has an error instead."""

    def run(batches):
        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                try:
                    with opened(path) as f:
                        rows.append((path, json.dumps({"tracks": [{k: v for k, v in t.items() if k != "encodings"} for t in entries(f)]}), None))
                except (OSError, ValueError) as e:
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["path", "json", "error"])

    return spread(files.select("path")).mapInArrow(run, "path string, json string, error string")
