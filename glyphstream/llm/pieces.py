"""SentencePiece encoding with offsets, and decoding.

A text is normalised by the longest prefixes that the model's compiled character map holds (a double-array trie over bytes);
every normalised byte keeps the source byte at which its rule began. The normalised text is cut where no piece of the
vocabulary can reach across, the library merges each part under the model's own scores, and a piece's length in normalised bytes
is carried back through the alignment to a span of bytes of the original text. Rows don't move between tasks; a text is read a part at a time.

Defined results: a null or empty text has no pieces and decodes to the empty text; equal rows are encoded each; rows of an empty table:
none; other columns are not looked at. Bytes that are not UTF-8 count as U+FFFD. Long texts give the same pieces as in one go; where a vocabulary
has pieces over inner word marks, and for a word without an end, the whole text or word is in memory.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphstream.llm._common import lean, read_table

MODEL = "piece_bpe_32k.model"
MARK = "▁"
_MARK = MARK.encode()
#: Bytes of a text that are read at a time.
PART = 1 << 18
UNKNOWN, BYTE, USER = 2, 6, 4  # types of pieces in the model's format


class Charmap:
    """A compiled character map: the size of the trie's bytes, the trie's units, then zero-ended replacements."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little") if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).astype(np.int64) if size else np.zeros(0, np.int64)
        self.texts = compiled[4 + size :]
        self.longest = 256  # bytes of a key that are followed at most; real keys are a few characters

    def _step(self, unit: np.ndarray) -> np.ndarray:
        """How far a unit's children are from it."""
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest_prefixes(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, place of the replacement) of the longest key at each of those places; length 0 where none begins."""
        length, value = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        if not len(self.units):
            return length, value
        alive = np.arange(len(at))
        node = np.full(len(at), self._step(self.units[:1])[0])
        for k in range(self.longest):
            inside = at[alive] + k < len(data)
            alive, node = alive[inside], node[inside]
            byte = data[at[alive] + k].astype(np.int64)
            node = node ^ byte
            fits = node < len(self.units)
            alive, node, byte = alive[fits], node[fits], byte[fits]
            unit = self.units[node]
            fits = (unit & 0x800000FF) == byte
            alive, node, unit = alive[fits], node[fits], unit[fits]
            if not len(alive):
                break
            node = node ^ self._step(unit)
            leaf = (unit >> 8) & 1 == 1
            length[alive[leaf]] = k + 1
            value[alive[leaf]] = self.units[node[leaf]] & 0x7FFFFFFF
        return length, value

    def replacement(self, value: int) -> bytes:
        return self.texts[value : self.texts.index(b"\0", value)]

    def mapped(self, data: bytes, stop: int) -> tuple[bytes, np.ndarray, int]:
        """(normalised bytes, source byte of each, source bytes used): greedy from the left, rules that begin before stop."""
        b = np.frombuffer(data, np.uint8)
        if not len(self.units) and len(data) <= stop:  # no rules: every character stands for itself
            return data, np.arange(len(b)) if data.isascii() else np.maximum.accumulate(np.where((b & 0xC0) != 0x80, np.arange(len(b)), 0)), len(b)
        starts = np.flatnonzero((b & 0xC0) != 0x80)
        size = np.diff(starts, append=len(b))
        length, value = self.longest_prefixes(b, starts)
        parts, kept, out, done, covered = [], np.ones(len(starts), bool), size.copy(), 0, 0
        for k in np.flatnonzero(length):
            at = int(starts[k])
            if at < covered:
                continue
            if at >= stop:
                break
            new, covered = self.replacement(int(value[k])), at + int(length[k])
            parts += (data[done:at], new)
            done, out[k] = covered, len(new)
            kept[k + 1 : np.searchsorted(starts, covered)] = False
        end = max(covered, int(starts[np.searchsorted(starts, stop)]) if stop <= (starts[-1] if len(starts) else -1) else len(b))
        kept[np.searchsorted(starts, end) :] = False
        parts.append(data[done:end])
        return b"".join(parts), np.repeat(starts[kept], out[kept]), end


class Model:
    """A model's normaliser, stretches and pieces; the merges are the library's."""

    def __init__(self, proto: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto.FromString(proto)
        spec, own = m.normalizer_spec, m.trainer_spec
        if own.treat_whitespace_as_suffix or any(p.type == USER for p in m.pieces):
            raise ValueError("models with word marks at the end or pieces of the user's own are not supported")
        self.charmap, self.prefix, self.squeeze, self.escape = Charmap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.whole = SentencePieceProcessor(model_proto=proto)
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = b"", False, False, False
        self.bare = SentencePieceProcessor(model_proto=m.SerializeToString())
        self.unknown = next(k for k, p in enumerate(m.pieces) if p.type == UNKNOWN)
        self.length = np.array([1 if p.type == BYTE else len(p.piece.encode()) for p in m.pieces], np.int64)
        self.decimal = [f"{k}," for k in range(len(m.pieces))]
        normal = [p.piece for p in m.pieces if p.type == 1]
        self.first = next(k for k, p in enumerate(m.pieces) if p.type == 1 and p.piece.isascii() and p.piece.isalpha())
        self.cuts = not any(re.search(f"[^{MARK}]{MARK}", p) for p in normal)

    def normalised(self, data: bytes):
        """Parts (bytes, source byte of each and of what follows, whether it is the last) of a text's normalised form."""
        at, pending, space, began = 0, None, self.squeeze, False
        while at < len(data):
            piece = data[at : at + PART + self.charmap.longest + 4]
            text, align, used = self.charmap.mapped(piece, PART)
            b, align = np.frombuffer(text, np.uint8), align + at
            if self.squeeze:
                blank = b == 32
                drop = blank & np.r_[space, blank[:-1]] if len(b) else blank
                b, align, space = b[~drop], align[~drop], bool(blank[-1]) if len(b) else space
            text = b.tobytes()
            if self.escape:
                align = np.repeat(align, (b == 32) * (len(_MARK) - 1) + 1)
                text = text.replace(b" ", _MARK)
            if not began and (len(align) or not self.squeeze):
                began = True
                if self.prefix:
                    mark = _MARK if self.escape else b" "
                    text, align = mark + text, np.r_[np.full(len(mark), align[0] if len(align) and self.squeeze else 0), align]
            at += used
            if pending is not None:
                yield *pending, False
            pending = (text, np.r_[align, at])
        if pending is not None:
            yield *pending, True

    def _cut(self, data: bytes) -> int:
        """The last place in normalised bytes that no piece can span, 0 if there is none: a mark after something else."""
        at = data.rfind(_MARK) if self.cuts else 0
        while at > 0 and data.endswith(_MARK, 0, at):
            at -= len(_MARK)
        return max(at, 0)

    def _sizes(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Normalised bytes of each piece."""
        if (ids == self.unknown).any():  # a model without byte pieces: its unknown runs have any length
            return np.array([len(p.surface.encode()) for p in self.bare.encode(text, return_type="proto").pieces], np.int64)
        return self.length[ids]

    def pieces(self, text: bytes):
        """Parts (ids, begins, ends) of a text's pieces, begins and ends as bytes of the text."""
        rest, rest_align = b"", np.zeros(0, np.int64)
        for data, align, last in self.normalised(_utf8(text)):
            if rest:
                data, align = rest + data, np.r_[rest_align, align]
            if last and self.squeeze:
                while data.endswith(_MARK if self.escape else b" "):
                    data, align = data[: -len(_MARK if self.escape else b" ")], align[: -len(_MARK if self.escape else b" ")]
            cut = len(data) if last else self._cut(data)
            rest, rest_align = data[cut:], align[cut:-1]
            if cut:
                text = data[:cut].decode()
                ids = self.bare.encode(text)
                sizes = self._sizes(text, np.array(ids, np.int32))
                end = np.cumsum(sizes)
                yield ids, align[end - sizes], align[end]

    def decoded(self, ids: list[int], first: bool) -> str:
        """The library's text of a part's pieces; a later part keeps its leading mark."""
        if first:
            return self.whole.decode(ids)
        return self.whole.decode([self.first, *ids])[len(self.whole.decode([self.first])) :]


def _utf8(text: bytes) -> bytes:
    try:
        text.decode()
        return text
    except UnicodeDecodeError:
        return text.decode("utf-8", "replace").encode()


@functools.cache
def model(at: str = MODEL) -> Model:
    if "/" not in at:
        import public_tokenizers as known

        at = known.path(at)
    with open(at, "rb") as file:
        return Model(file.read())


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8").alias("_text"))


def encoded(docs: DataFrame, at: str = MODEL) -> DataFrame:
    """(doc_id, part, ids, begins, ends, n_bytes) of docs (doc_id, text): a row for each part of a text, at least one; spans are bytes of the text's UTF-8."""

    def run(batches):
        m = model(at)
        for b in batches:
            for doc, text in zip(b.column(0), b.column(1)):
                text = text.as_py()
                for k, (ids, begin, end) in enumerate(chain(m.pieces(text), () if text else [(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))])):
                    yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()], pa.int64()), pa.array([k], pa.int32()), pa.array([ids], pa.list_(pa.int32())), pa.array([begin], pa.list_(pa.int64())), pa.array([end], pa.list_(pa.int64())), pa.array([len(text)], pa.int64())], names=["doc_id", "part", "ids", "begins", "ends", "n_bytes"])

    return _texts(docs).mapInArrow(lean(run), "doc_id long, part int, ids array<int>, begins array<long>, ends array<long>, n_bytes long")


def digests(docs: DataFrame, at: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32) of each row: pieces, decoded text and spans, hashed part by part.

    spans_crc32: of (begin, end) of all pieces in order, as little-endian 64-bit.
    """

    def run(batches):
        m = model(at)
        for b in batches:
            out = []
            for doc, text in zip(b.column(0), b.column(1)):
                n, crc, of_ids, of_text, comma = 0, 0, hashlib.sha256(), hashlib.sha256(), b""
                for ids, begin, end in m.pieces(text.as_py()):
                    of_ids.update(comma + "".join(map(m.decimal.__getitem__, ids)).encode()[:-1])
                    of_text.update(m.decoded(ids, n == 0).encode())
                    crc = zlib.crc32(np.column_stack([begin, end]).astype("<i8").tobytes(), crc)
                    n, comma = n + len(ids), b","
                out.append((doc.as_py(), n, of_ids.hexdigest(), of_text.hexdigest(), crc))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])

    return _texts(docs).mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")


def op12_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))
