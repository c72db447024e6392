"""Chunks of documents, and counting of hashes across chunks.

A chunk holds some megabytes of whole documents in one row. Its distinct hashes travel to hash buckets as sorted,
delta-coded, compressed runs (one row for each chunk and bucket, so a hash is sent once a chunk however often it
repeats), and what a bucket finds out about them travels back in the same order. Chunks stay in a table bucketed by
chunk, so the texts don't move when answers are joined to them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphstream.llm._common import Scratch, lean, parallelism, release

CHUNK_BYTES = 4 << 20
#: Bits of a chunk's number within its partition.
CHUNK_BITS = 18
#: Hashes to a bucket, about: a reducing task's memory follows the first, not the input. Small inputs get buckets of the second at
#: least, as a row travels for each chunk and bucket.
BUCKET_HASHES, LEAST_HASHES = 1_500_000, 150_000

_SCHEMA = "chunk long, docs binary, ends binary, blob binary, n_bytes long"
_TYPES = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
_NAMES = ["chunk", "docs", "ends", "blob", "n_bytes", "rest"]


def _squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def pack_chunks(docs: DataFrame, chunk_bytes: int | None = None, whole: bool = False) -> DataFrame:
    """Chunks (chunk, docs, ends, blob, n_bytes[, rest]) of docs (doc_id long, text) in the order of its partitions; null text is empty.

    whole: rest holds the rows' other columns (and which texts are null), for unpack_rows().
    """
    chunk_bytes = chunk_bytes or CHUNK_BYTES
    own = [c for c in docs.columns if c.lower() != "text"] if whole else []

    def run(batches):
        number = TaskContext.get().partitionId() << CHUNK_BITS
        last = number + (1 << CHUNK_BITS) - 1
        ids, ends, parts, slices, size = [], [], [], [], 0

        def row():
            if number > last:
                raise OverflowError(f"a partition of more than {1 << CHUNK_BITS} chunks: read the table in smaller partitions")
            null = np.packbits([i is None for i in ids]).tobytes()
            values = [number, np.array([i or 0 for i in ids], "<i8").tobytes() + null, np.array(ends, "<i8").tobytes(), _squeezed(b"".join(parts)), size]
            if whole:
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, slices[0].schema) as writer:
                    for x in slices:
                        writer.write_batch(x)
                values.append(_squeezed(out.getvalue().to_pybytes()))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _TYPES)], names=_NAMES[: len(values)])

        for b in batches:
            rest = pa.RecordBatch.from_arrays([b.column(1).is_null(), *b.columns[2:]], names=[f"c{k}" for k in range(b.num_columns - 1)])
            since = 0
            for k, (doc_id, text) in enumerate(zip(b.column(0), b.column(1)), 1):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass") + b"\n"
                ids.append(doc_id.as_py())
                parts.append(data)
                size += len(data)
                ends.append(size)
                if size >= chunk_bytes:
                    slices.append(rest.slice(since, k - since))
                    since = k
                    yield row()
                    number, ids, ends, parts, slices, size = number + 1, [], [], [], [], 0
            if since < b.num_rows:
                slices.append(rest.slice(since))
        if ids:
            yield row()

    text = next((c for c in docs.columns if c.lower() == "text"))
    columns = [F.col("doc_id").cast("long").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"), *(F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(own))]
    return docs.select(*columns).mapInArrow(lean(run), _SCHEMA + ", rest binary" * whole)


def unpack(docs: bytes, ends: bytes, blob: bytes) -> tuple[pa.Array, np.ndarray, bytes]:
    """(doc_ids, ends, bytes of the texts, a line end after each)."""
    n = len(ends) // 8
    null = np.unpackbits(np.frombuffer(docs, np.uint8, offset=8 * n), count=n).astype(bool)
    return pa.array(np.frombuffer(docs, "<i8", n), mask=null), np.frombuffer(ends, "<i8"), zstandard.ZstdDecompressor().decompress(blob)


def unpack_rows(row: dict, at: np.ndarray, schema, text: int) -> pa.RecordBatch:
    """The rows at those places of a chunk packed whole, with the columns they had; text: the place of the text column."""
    _, ends, data = unpack(row["docs"], row["ends"], row["blob"])
    rest = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(row["rest"])).read_all().take(pa.array(at)).combine_chunks()
    begin = np.r_[0, ends[:-1]]
    null = rest.column(0).to_pylist()
    texts = [None if gone else data[begin[k] : ends[k] - 1] for k, gone in zip(at, null)]
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rest.columns[1:]]
    columns.insert(text, pa.array(texts, pa.binary()).cast(pa.string()))
    return pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])


def store(scratch: Scratch, chunks: DataFrame) -> DataFrame:
    return scratch.bucketed(chunks, "chunk", parallelism(scratch.spark))


def planes(values: np.ndarray) -> bytes:
    """Compressed bytes of unsigned whole numbers, place by place: high places are mostly zeros."""
    v = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=1).compress(v.view(np.uint8).reshape(-1, v.itemsize).T.tobytes())


def from_planes(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def sorted_runs(hashes: np.ndarray, buckets: int):
    """(bucket, from, to) of sorted 64-bit hashes; buckets are ranges of the hash."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cut = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip(np.r_[0, cut], np.r_[cut, len(hashes)]):
        if b > a:
            yield int(bucket[a]), int(a), int(b)


def delta(sorted_values: np.ndarray) -> bytes:
    return planes(np.diff(sorted_values, prepend=np.uint64(0)))


def undelta(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


SENT = "chunk long, bucket int, n long, hashes binary, extra binary"


def sent_rows(chunk: int, hashes: np.ndarray, extra: np.ndarray | None, buckets: int) -> pa.RecordBatch:
    """A chunk's sorted distinct hashes, and a value for each, as rows of SENT."""
    rows = [(chunk, k, b - a, delta(hashes[a:b]), planes(extra[a:b]) if extra is not None else b"") for k, a, b in sorted_runs(hashes, buckets)]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    columns = zip(*rows) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["chunk", "bucket", "n", "hashes", "extra"])


def answered(sent: DataFrame, answer, extra_kind=None) -> DataFrame:
    """Answers (chunk, answers: array of (bucket, data)) to rows of SENT.

    answer(hashes, extra, chunk) gets a bucket's hashes in order (equal ones by chunk) and returns a value for each.
    """

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        n = pdf["n"].to_numpy()
        h = np.concatenate([undelta(x) for x in pdf["hashes"]])
        extra = np.concatenate([from_planes(x, extra_kind) for x in pdf["extra"]]) if extra_kind is not None else None
        order = np.argsort(h, kind="stable")
        got = np.asarray(answer(h[order], None if extra is None else extra[order], np.repeat(np.arange(len(n)), n)[order]))
        back = np.empty_like(got)
        back[order] = got
        ends = np.cumsum(n)
        pack = (lambda x: zstandard.ZstdCompressor(level=1).compress(np.packbits(x).tobytes())) if got.dtype == bool else planes
        out = pd.DataFrame({"chunk": pdf["chunk"].to_numpy(), "bucket": pdf["bucket"].to_numpy(), "n": n, "data": [pack(back[e - k : e]) for e, k in zip(ends, n)]})
        del h, extra, order, got, back
        release()
        return out

    told = sent.groupBy("bucket").applyInPandas(reduce, "chunk long, bucket int, n long, data binary")
    return told.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "n", "data"))).alias("answers"))


def answers_bits(answers) -> np.ndarray:
    """Boolean answers to a chunk's sorted distinct hashes, from the joined column."""
    parts = [np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(a["data"]), np.uint8), count=a["n"]).astype(bool) for a in answers or ()]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def answers_values(answers, kind) -> np.ndarray:
    parts = [from_planes(a["data"], kind) for a in answers or ()]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def bucket_count(spark, hashes: int) -> int:
    return max(1, -(-hashes // BUCKET_HASHES), min(parallelism(spark), -(-hashes // LEAST_HASHES)))
