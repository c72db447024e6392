"""Substring dedup: level-wise doubling.

Windows of a quarter of the length are counted first. A window of twice a length can only repeat if both its halves do, so
only windows of two repeated halves go to the next level, until the full length is reached or no candidates survive. At
each level a chunk sends its candidates' distinct hashes (48 bits; at the full length 64 and 32 more of a second hash) to
hash buckets and gets a bit back for each. Chunks hold ranges of the documents' order, so at the full length the bit "an
earlier chunk has this window" and the order within the chunk settle which windows started earlier.

Defined results: null and empty texts have no words; documents are taken in the order of doc_id (null first), rows of one
doc_id in the order of a hash of their texts, each row as a document of its own (so rows of one doc_id are spread over tasks); an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphstream.llm import _chunks as C
from glyphstream.llm._common import Scratch, lean, parallelism, read_table, window_hashes, word_hashes

WINDOW = 20
_LOW = ~np.uint64(0xFFFF)


def levels(window: int) -> list[int]:
    """Lengths tested, up to the window: doubled from the smallest whole part that is at least 4, or from the window itself."""
    out = [window]
    while out[0] % 2 == 0 and out[0] // 2 >= 4:
        out.insert(0, out[0] // 2)
    return out


class ChunkWords:
    """A chunk's words: hashes, documents, and which windows are candidates at each level."""

    def __init__(self, docs: bytes, ends: bytes, blob: bytes):
        self.docs, self.ends, self.data = C.unpack(docs, ends, blob)
        self.words, start, _ = word_hashes(self.data)
        self.doc = np.searchsorted(self.ends, start, side="right")
        self.n_words = np.bincount(self.doc, minlength=len(self.docs))

    def whole(self, size: int) -> np.ndarray:
        """Starts whose window of that size lies in one document."""
        n = max(len(self.words) - size + 1, 0)
        return self.doc[:n] == self.doc[size - 1 : size - 1 + n]

    def level(self, size: int, halves: np.ndarray | None, last: bool):
        """(starts of candidates, sorted distinct hashes, position of each candidate's among them, second hash, first of its like)."""
        may = self.whole(size)
        if halves is not None:
            n, half = len(may), size // 2
            may &= halves[:n] & halves[half : half + n]
        at = np.flatnonzero(may)
        h = window_hashes(self.words, size)[at]
        if not last:
            h &= _LOW
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        second = (window_hashes(self.words, size, 1)[at][first] >> np.uint64(32)).astype(np.uint32) if last else None
        return at, distinct, inverse, second, first

    def repeated(self, size: int, halves: np.ndarray | None, answers) -> np.ndarray:
        """Per word: does the window that starts there occur again (in the chunk or elsewhere)?"""
        at, distinct, inverse, _, _ = self.level(size, halves, False)
        yes = C.answers_bits(answers) | (np.bincount(inverse, minlength=len(distinct)) > 1)
        out = np.zeros(len(self.words), bool)
        out[at] = yes[inverse]
        return out

    def removed(self, size: int, halves: np.ndarray | None, answers) -> np.ndarray:
        """Per word: is it in a window that starts earlier too?"""
        at, _, inverse, _, first = self.level(size, halves, True)
        again = C.answers_bits(answers)[inverse] | (first[inverse] != np.arange(len(at)))
        cover = np.zeros(len(self.words) + 1, np.int32)
        np.add.at(cover, at[again], 1)
        np.subtract.at(cover, at[again] + size, 1)
        return np.cumsum(cover[:-1]) > 0


def _elsewhere(h, extra, chunk):
    same = h[1:] == h[:-1]
    return np.r_[False, same] | np.r_[same, False]


def _earlier(h, extra, chunk):
    return np.r_[False, (h[1:] == h[:-1]) & (extra[1:] == extra[:-1])]


def _decided(words: ChunkWords, sizes: list[int], answers: list) -> np.ndarray | None:
    halves = None
    for size, a in zip(sizes, answers):
        halves = words.repeated(size, halves, a)
    return halves


def dedup(docs: DataFrame, window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) of docs (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = slim.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order, "text")
    chunks = C.store(scratch, C.pack_chunks(ordered))
    total = chunks.agg(F.sum("n_bytes")).head()[0] or 0
    buckets = C.bucket_count(spark, total // 6)
    sizes = levels(window)
    joined, answers = chunks.drop("n_bytes"), []
    for k, size in enumerate(sizes):
        last = k + 1 == len(sizes)

        def send(batches, k=k, size=size, last=last):
            for b in batches:
                for row in b.to_pylist():
                    words = ChunkWords(row["docs"], row["ends"], row["blob"])
                    halves = _decided(words, sizes[:k], [row[f"a{i}"] for i in range(k)])
                    _, distinct, _, second, _ = words.level(size, halves, last)
                    yield C.sent_rows(row["chunk"], distinct, second, buckets)

        sent = joined.mapInArrow(lean(send), C.SENT)
        told = scratch.keep(C.answered(sent, _earlier if last else _elsewhere, np.uint32 if last else None))
        scratch.tidy()
        answers.append(told)
        joined = joined.join(told.withColumnRenamed("answers", f"a{k}"), "chunk", "left")

    def finish(batches):
        for b in batches:
            for row in b.to_pylist():
                words = ChunkWords(row["docs"], row["ends"], row["blob"])
                halves = _decided(words, sizes[:-1], [row[f"a{i}"] for i in range(len(sizes) - 1)])
                gone = words.removed(window, halves, row[f"a{len(sizes) - 1}"])
                at = np.r_[0, np.cumsum(words.n_words)]
                n_gone = np.diff(np.r_[0, np.cumsum(gone)][at])
                begin, digests, texts = 0, [], []
                for i, end in enumerate(words.ends):
                    own = words.data[begin:end].split()
                    begin = end
                    if n_gone[i]:
                        own = itertools.compress(own, ~gone[at[i] : at[i + 1]])
                    text = b" ".join(own)
                    digests.append(hashlib.sha256(text).hexdigest())
                    if keep_text:
                        texts.append(text.decode("utf-8", "surrogatepass"))
                columns = [words.docs, pa.array(words.n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(texts, pa.string())] if keep_text else [])], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + keep_text])

    done = joined.mapInArrow(lean(finish), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)
    if not keep_text:  # a few numbers a document take the place of the chunks
        done = scratch.keep(done)
        scratch.drop(chunks, *answers)
    return done


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(read_table(spark, sf_dir, "documents"), keep_text=False)
