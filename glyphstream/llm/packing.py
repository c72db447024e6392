"""Packing: concatenate and cut.

Pass one tokenises every document once and writes its ids, in the order of the input's partitions, with each
partition's running total. The totals' prefix sums (one row for each partition) give every document its global
offset; pass two cuts the global stream into windows of ``seq_len`` and returns a boundary record (piece) for
each part of a document in a window. No document is moved between tasks, so no key can be hot.

Defined results: a null or empty text is the separator alone; equal rows are packed each; an empty table gives
no pieces; other columns of the input are not looked at.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphstream.llm._common import Scratch, lean, read_table

SEQ_LEN = 1024
SEPARATOR = 0
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: Partition totals up to this many rows (16 bytes each) are broadcast; beyond it they are joined by shuffle.
MAX_BROADCAST_PARTS = 1_000_000
#: Partitions whose totals are summed in one group beyond that.
GROUP_PARTS = 4096
#: Texts with other characters, or special-token strings, are left to the full tokenizer; both give the same ids here.
_PLAIN = re.compile(r"[\t\n\x20-\x7e¡-ɏ‐-‧€]*\Z")


def _at(name: str) -> str:
    import public_tokenizers as known

    return name if "/" in name else known.path(name)


@functools.cache
def _full(tokenizer: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(_at(tokenizer))


@functools.cache
def _fast(ranks: str):
    import public_tokenizers as known
    import tiktoken

    with open(_at(ranks), "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=known.PATTERN, mergeable_ranks=table, special_tokens={})


def encode(text: str | None, tokenizer: str = TOKENIZER, ranks: str | None = RANKS) -> list[int]:
    """Token ids of a text, without special tokens; ``ranks`` is the same vocabulary in a faster encoder's form."""
    if not text:
        return []
    if ranks is not None and _PLAIN.match(text) and "<|endoftext|>" not in text:
        return _fast(ranks).encode_ordinary(text)
    return _full(tokenizer).encode(text, add_special_tokens=False).ids


def tokenised(docs: DataFrame, tokenizer: str = TOKENIZER, ranks: str | None = RANKS, separator: int = SEPARATOR) -> DataFrame:
    """(doc_id, part, before, doc_tokens, ids): ids as little-endian unsigned 32-bit, before = tokens of the partition's earlier documents."""

    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            doc, n, at, out = [], [], [], []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = np.array([*encode(text.as_py(), tokenizer, ranks), separator], "<u4")
                doc.append(doc_id.as_py())
                n.append(len(ids))
                at.append(before)
                out.append(ids.tobytes())
                before += len(ids)
                if sum(n) > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array([part] * len(n), pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "part", "before", "doc_tokens", "ids"])
                    doc, n, at, out = [], [], [], []
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array([part] * len(n), pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "part", "before", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, part int, before long, doc_tokens long, ids binary")


def _bases(totals: DataFrame) -> DataFrame:
    """(part, base) from (part, total) of any number of parts: prefix sums within groups of parts, and of the groups' sums."""
    group = F.floor(F.col("part") / GROUP_PARTS)
    at, rows = 0, [(-1, 0)]
    for g, total in sorted(map(tuple, totals.groupBy(group).agg(F.sum("total")).collect())):  # a row for GROUP_PARTS parts
        rows.append((g, at))
        at += total
    before = F.broadcast(totals.sparkSession.createDataFrame(rows, "grp long, before long"))
    own = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    return totals.withColumn("grp", group).join(before, "grp").select("part", (F.col("before") + F.sum("total").over(own) - F.col("total")).alias("base"))


def pack(docs: DataFrame, seq_len: int = SEQ_LEN, tokenizer: str = TOKENIZER, ranks: str | None = RANKS, separator: int = SEPARATOR) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of the packed sequences of ``docs``.

    Every sequence but the last is full; the last one's rest is padding.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    first = scratch.keep(tokenised(docs, tokenizer, ranks, separator))
    totals = first.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    bases = sorted(map(tuple, totals.limit(MAX_BROADCAST_PARTS + 1).collect()))
    if len(bases) > MAX_BROADCAST_PARTS:
        placed = first.join(_bases(scratch.keep(totals)), "part")
    else:
        at, rows = 0, []
        for part, total in bases:
            rows.append((part, at))
            at += total
        placed = first.join(F.broadcast(spark.createDataFrame(rows, "part int, base long")), "part")
    g = F.col("base") + F.col("before")
    whole = F.floor(g / seq_len)
    window = placed.select("doc_id", "doc_tokens", "ids", g.alias("g"), whole.alias("w0"), F.floor((g + F.col("doc_tokens") - 1) / seq_len).alias("w1"))

    def piece(w):
        start = F.greatest(w * seq_len - F.col("g"), F.lit(0)).cast("long")
        length = F.least((w + 1) * seq_len - F.col("g"), F.col("doc_tokens")).cast("long") - start
        part = F.substring(F.col("ids"), (start * 4 + 1).cast("int"), (length * 4).cast("int"))
        return F.struct(start.alias("start"), length.alias("length"), part.alias("ids"), F.crc32(part).alias("ids_crc32"), w.cast("long").alias("sequence_id"), (F.col("g") + start - w * seq_len).cast("long").alias("offset"))

    return window.select("doc_id", "doc_tokens", F.inline(F.transform(F.sequence("w0", "w1"), piece)))


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
