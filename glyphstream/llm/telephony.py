"""Media columns: telephony audio.

Bytes are kept as the samples of a WAVE container in one of three codecs, mu-law, A-law (a byte a sample) or IMA ADPCM (blocks of ``UNIT`` bytes),
set by the payload's checksum; the container is lossless for any payload. It is read back by parsing it and expanded: mu-law and
A-law through 256-entry tables, ADPCM by stepping through the samples of all blocks at once, vectorised across the blocks of many documents.
The expanded PCM is resampled linearly (8 to 16 kHz) and stored beside the media as 16-bit little-endian PCM.
Samples are worked out ``BLOCK_BYTES`` of media at a time, so that a very long text needs no more than its own bytes and results.

Defined results: null and empty texts are one payload unit of padding; equal bytes give equal values wherever they
stand; sums are of whole numbers of any size; an empty table gives no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphstream.llm._common import Scratch, lean, read_table

UNIT = 576
RATE = 8000
MULAW, ALAW, ADPCM = 7, 6, 17
KINDS = (MULAW, ALAW, ADPCM)
NAMES = {MULAW: "mulaw", ALAW: "alaw", ADPCM: "adpcm"}
#: Media bytes that are decoded at once, and payload bytes of a group of documents.
BLOCK_BYTES = UNIT * 4096
#: Resampled rate over the media's.
UP, DOWN = 2, 1
#: Fixed values of IMA ADPCM: the index's change by code, and the step sizes.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exp, low = (code >> 4) & 7, (code & 15) << 4
    size = np.where(exp == 0, low + 8, (low + 0x108) << np.maximum(exp - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


_TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def kind_of(data: bytes) -> int:
    """The codec that a payload is stored in: its checksum sets it, so equal payloads are stored alike."""
    return KINDS[zlib.crc32(data) % len(KINDS)]


def wave(samples: bytes, kind: int = MULAW, rate: int = RATE, block: int | None = None) -> bytes:
    """A mono WAVE file with the samples (or blocks) as they are; odd lengths get the format's pad byte."""
    block = block or (UNIT if kind == ADPCM else 1)
    per_block = 2 * (block - 4) + 1 if kind == ADPCM else 1
    form = struct.pack("<HHIIHH", kind, 1, rate, rate * block // per_block, block, 4 if kind == ADPCM else 8)
    form += struct.pack("<HH", 2, per_block) if kind == ADPCM else struct.pack("<H", 0)
    fact = struct.pack("<4sII", b"fact", 4, len(samples) // block * per_block)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(form)) + form + fact + struct.pack("<4sI", b"data", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def parse_wave(media: bytes) -> tuple[int, int, bytes]:
    """(kind, block, data) of a WAVE file; ValueError if it isn't one."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, kind, block = 12, None, 1
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            if size < 16 or len(media) < at + 24:
                raise ValueError("a WAVE file's format is cut short")
            kind, block = struct.unpack_from("<H", media, at + 8)[0], struct.unpack_from("<H", media, at + 20)[0]
        elif name == b"data":
            if kind is None or len(media) < at + 8 + size:
                raise ValueError("a WAVE file without format, or cut short")
            if kind not in KINDS or kind == ADPCM and block < 5:
                raise ValueError(f"codec {kind} with blocks of {block} isn't known")
            return kind, block, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAVE file without data")


def decode_adpcm(data: bytes, block: int) -> np.ndarray:
    """PCM (blocks x samples) of mono IMA ADPCM; a short last block is decoded as if zeros followed."""
    raw = np.frombuffer(data + b"\0" * (-len(data) % block), np.uint8).reshape(-1, block)
    value = raw[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.clip(raw[:, 2].astype(np.int32), 0, 88)
    codes = np.empty((2 * (block - 4), len(raw)), np.uint8)
    codes[0::2], codes[1::2] = (raw[:, 4:] & 15).T, (raw[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, len(raw)), np.int16)
    out[0] = value
    for k, code in enumerate(codes, 1):
        step = STEPS[index]
        diff = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -diff, diff), -32768, 32767)
        index = np.clip(index + INDEX_STEP[code], 0, 88)
        out[k] = value
    return out.T


def expand(kind: int, data: bytes, block: int = 1) -> np.ndarray:
    return decode_adpcm(data, block).reshape(-1) if kind == ADPCM else _TABLES[kind][np.frombuffer(data, np.uint8)]


def expanded(kind: int, data: bytes, block: int = 1, size: int = BLOCK_BYTES):
    """expand() in parts of about ``size`` bytes of media."""
    step = max(block, size // block * block)
    for at in range(0, len(data), step):
        yield expand(kind, data[at : at + step], block)


def resampled(parts, num: int = UP, den: int = DOWN):
    """Linear resampling by num/den of PCM that comes in parts, in whole numbers (exact on every machine); the last sample is held."""

    def between(x, out, base):
        at = out * den
        i, part = at // num - base, at % num
        return ((x[i] * (num - part) + x[np.minimum(i + 1, len(x) - 1)] * part) // num).astype(np.int16)

    x, base, done = np.zeros(0, np.int64), 0, 0
    for part in parts:
        x = np.concatenate([x, part.astype(np.int64)])
        end = -(-(base + len(x) - 1) * num // den)  # outputs that lie before the last sample known
        if end > done:
            if (num, den) == (2, 1):
                out = np.empty(end - done, np.int16)
                out[0::2], out[1::2] = x[:-1], (x[:-1] + x[1:]) >> 1
                yield out
            else:
                yield between(x, np.arange(done, end, dtype=np.int64), base)
            done = end
        cut = min(done * den // num - base, len(x) - 1)
        x, base = x[cut:], base + cut
    end = (base + len(x)) * num // den
    if end > done:
        yield between(x, np.arange(done, end, dtype=np.int64), base)


def resample(pcm: np.ndarray, num: int = UP, den: int = DOWN) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int16), *resampled([pcm], num, den)]) if len(pcm) else pcm


def payload(text: str | None, unit: int = UNIT) -> tuple[bytes, int]:
    """UTF-8 bytes padded with 255 up to a positive multiple of the unit, and their number before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * ((-len(raw)) % unit if raw else unit), len(raw)


class Heard:
    """Features of PCM that comes in parts: samples, energy, sign changes and peak, in whole numbers only."""

    def __init__(self):
        self.n = self.energy = self.turns = self.peak = 0
        self.last = None

    def add(self, parts):
        """The parts again, noted as they pass."""
        for pcm in parts:
            wide, low = pcm.astype(np.int64), pcm < 0
            self.n += len(pcm)
            self.energy += int(np.dot(wide, wide))
            self.turns += int(np.count_nonzero(low[1:] != low[:-1])) + int(self.last is not None and self.last != low[0])
            self.peak = max(self.peak, int(wide.max()), -int(wide.min()))
            self.last = low[-1]
            yield pcm

    def __str__(self):
        return f"samples={self.n};energy={self.energy // max(self.n, 1)};turns={self.turns};peak={self.peak}"


def transcode(media: bytes, num: int = UP, den: int = DOWN) -> bytes:
    """The stored form of a telephony column: 16-bit little-endian PCM, resampled, of a mu-law, A-law or ADPCM WAVE file."""
    kind, block, data = parse_wave(media)
    return b"".join(x.astype("<i2").tobytes() for x in resampled(expanded(kind, data, block), num, den))


def pcm_column(media: DataFrame, column: str = "media", num: int = UP, den: int = DOWN) -> DataFrame:
    """``media`` with pcm (binary) and error (string) columns in place of others of those names; null media gives nulls, a bad file its error."""

    def one(value):
        if value is None:
            return None, None
        try:
            return transcode(value, num, den), None
        except (ValueError, KeyError, struct.error) as e:
            return None, str(e) or type(e).__name__

    def run(batches):
        for b in batches:
            got = [one(x.as_py()) for x in b.column(b.schema.get_field_index(column))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in got], pa.binary()), pa.array([e for _, e in got], pa.string())], names=[*b.schema.names, "pcm", "error"])

    kept = media.drop("pcm", "error")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "pcm binary", "error string"])
    return kept.mapInArrow(lean(run), schema)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, pcm_bytes long, pcm_sha256 string"


def _groups(part: pa.RecordBatch):
    """Documents (doc_id, payload, bytes before padding) in groups of about BLOCK_BYTES."""
    group, size = [], 0
    for doc_id, text in zip(part.column(0), part.column(1)):
        group.append((doc_id.as_py(), *payload(text.as_py())))
        size += len(group[-1][1])
        if size >= BLOCK_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def _told(group, keep_media: bool):
    """Rows of SCHEMA (with media and pcm) of a group; its ADPCM blocks are decoded together."""
    yield from _read([(doc_id, n, wave(data, kind_of(data))) for doc_id, data, n in group], keep_media)


def _read(group, keep_media: bool):
    """Rows of SCHEMA (with media and pcm) of media files (doc_id, bytes before padding, file)."""
    files = [media for _, _, media in group]
    back = [parse_wave(m) for m in files]
    together = [i for i, (kind, _, data) in enumerate(back) if kind == ADPCM and len(data) < BLOCK_BYTES]
    ends = np.cumsum([0] + [len(back[i][2]) // UNIT for i in together])
    pcm = decode_adpcm(b"".join(back[i][2] for i in together), UNIT) if together else None
    own = {i: pcm[a:b].reshape(-1) for i, a, b in zip(together, ends, ends[1:])}
    for i, ((doc_id, n, media), (kind, block, data)) in enumerate(zip(group, back)):
        heard, digest, size, kept = Heard(), hashlib.sha256(), 0, []
        for x in resampled(heard.add([own.pop(i)] if i in own else expanded(kind, data, block))):
            raw = x.astype("<i2").tobytes()
            digest.update(raw)
            size += len(raw)
            if keep_media:
                kept.append(raw)
        row = (doc_id, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), str(heard), NAMES[kind], size, digest.hexdigest())
        yield (*row, media, b"".join(kept)) if keep_media else row


def stored(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """Each text's payload as a stored WAVE file (media), read back, and its resampled PCM (pcm); see SCHEMA for what is told of them."""
    i, s, y = pa.int64(), pa.string(), pa.binary()
    kinds = [i, i, i, s, i, i, s, s, s, i, s] + [y, y] * keep_media
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["media", "pcm"] * keep_media

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                for group in _groups(batch.slice(k, 1024)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*_told(group, keep_media)), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), SCHEMA + ", media binary, pcm binary" * keep_media)


def media_of(docs: DataFrame, slices: int = 1) -> DataFrame:
    """(doc_id, n_bytes, media, slice): each text's payload as a WAVE file; slice is one of slices, by the file's checksum."""
    names, kinds = ["doc_id", "n_bytes", "media", "slice"], [pa.int64(), pa.int64(), pa.binary(), pa.int32()]

    def run(batches):
        for batch in batches:
            for group in _groups(batch):
                rows = [(doc_id, n, media := wave(data, kind_of(data)), zlib.crc32(media) % slices) for doc_id, data, n in group]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, n_bytes long, media binary, slice int")


def heard(media: DataFrame) -> DataFrame:
    """SCHEMA without what is told of the PCM, and pcm itself, of media (doc_id, n_bytes, media) as they are read; ValueError for a file that isn't whole."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    i, s, y = pa.int64(), pa.string(), pa.binary()
    kinds = [i, i, i, s, i, i, s, s, s, y]

    def run(batches):
        for batch in batches:
            group, size = [], 0
            for k, row in enumerate(zip(*(batch.column(c) for c in range(3))), 1):
                group.append(tuple(x.as_py() for x in row))
                size += len(group[-1][2])
                if size >= BLOCK_BYTES or k == batch.num_rows:
                    rows = [(*r[:9], r[-1]) for r in _read(group, True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[*names[:9], "pcm"])
                    group, size = [], 0

    return media.select("doc_id", "n_bytes", "media").mapInArrow(lean(run), ", ".join([*SCHEMA.split(", ")[:9], "pcm binary"]))


#: Slices in which the query stores PCM, which is some ten times the text before compression: one slice at a time is on disk beside the media.
SLICES = 4


def digests(docs: DataFrame, scratch: Scratch, slices: int = SLICES) -> DataFrame:
    """SCHEMA of docs: media are stored in a table, PCM is made from the table's rows and stored too, and both are told of as they are read back."""
    at = scratch.keep(media_of(docs, slices), partition="slice")
    told = None
    for k in range(slices):
        pcm = scratch.keep(heard(at.where(F.col("slice") == k)))
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        own = scratch.keep(pcm.withColumns({"pcm_bytes": F.octet_length("pcm").cast("long"), "pcm_sha256": F.sha2("pcm", 256)}).select(*names))
        scratch.drop(pcm)
        told = own if told is None else told.unionByName(own)
    scratch.drop(at)
    return told


def op5_telephony(spark, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"), Scratch(spark))
