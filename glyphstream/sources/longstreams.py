"""Segments of raw streams too long for one task, split speculatively.

A segment's place is known only from the one before it. So each range of a file takes every place that could be a head for one, and follows
its chain of length fields to the first place beyond the range: one row (entry, exit, segments between) for each guess. Which guesses are right is found by pointer doubling:
reached places are joined with hops of 1, 2, 4, ... ranges, so that the rounds grow with the logarithm of the ranges. Then each range reads its
segments from its true entry. The rows are those of pgs.segments().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphstream.sources import matroska, pgs
from glyphstream.sources.kept import Kept

SPLIT = 64 << 20

_GUESS = "track_id string, entry long, exit long, n long"


def ranges(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """(path, start, end) of files (path), dealt over a stated number of tasks; a file that can't be opened has one row with null ends."""

    def run(batches):
        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                try:
                    with matroska.opened(path) as f:
                        size = matroska.length(f)
                    rows += [(path, k, min(k + split, size)) for k in range(0, max(size, 1), split)]
                except OSError:
                    rows.append((path, None, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "start", "end"])

    found = matroska.spread(files.select("path")).mapInArrow(run, "path string, start long, end long")
    return found.repartition(4 * files.sparkSession.sparkContext.defaultParallelism, "path", "start")


def guesses(data: bytes, start: int, end: int) -> list[tuple[int, int | None, int]]:
    """(entry, exit, n) for each place in [start, end) of data (from start, with what follows for a header) that looks like a head; exit is null where the chain ends at an unknown type."""
    b = np.frombuffer(data, np.uint8)
    stop = min(end - start, len(b) - pgs.HEADER + 1)
    at = np.flatnonzero((b[: max(stop, 0)] == 0x50) & (b[1 : max(stop, 0) + 1] == 0x47))
    following = at + pgs.HEADER + (b[at + 11].astype(np.int64) << 8) + b[at + 12]
    known = np.isin(b[at + 10], list(pgs.TYPES))
    out: dict[int, tuple[int | None, int]] = {}
    for p, q, ok in zip(at[::-1].tolist(), following[::-1].tolist(), known[::-1].tolist()):
        if not ok:
            out[p] = None, 1
        elif q < end - start:
            to, n = out.get(q, (None, 0))
            out[p] = to, n + 1
        else:
            out[p] = q + start, 1
    return [(p + start, to, n) for p, (to, n) in out.items()]


def segments(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """pgs.SEGMENTS of raw streams by path (files: path), which is their track_id; a file that can't be read has its error as its one row."""
    tables = Kept(files.sparkSession)
    parts = tables.keep(ranges(files, split))

    def guess(batches):
        for b in batches:
            rows = []
            for path, start, end in zip(*(c.to_pylist() for c in b.columns)):
                if start is not None:
                    try:
                        with matroska.opened(path) as f:
                            f.seek(start)
                            rows += [(path, *g) for g in guesses(f.read(end - start + pgs.HEADER), start, end)]
                    except OSError:
                        pass  # the reading task meets it again
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=[c.split()[0] for c in _GUESS.split(", ")])

    hops = tables.keep(parts.mapInArrow(guess, _GUESS).where("exit IS NOT NULL"))
    reached = tables.keep(parts.groupBy("path").agg(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("before")).withColumnRenamed("path", "track_id"))
    while True:
        on = (F.col("r.track_id") == F.col("h.track_id")) & (F.col("r.at") == F.col("h.entry"))
        further = reached.alias("r").join(hops.alias("h"), on).select("r.track_id", F.col("h.exit").alias("at"), (F.col("r.before") + F.col("h.n")).alias("before"))
        before, reached = reached, tables.keep(reached.unionByName(further))
        twice = hops.alias("a").join(hops.alias("b"), (F.col("a.track_id") == F.col("b.track_id")) & (F.col("a.exit") == F.col("b.entry")))
        old, hops = hops, tables.keep(twice.select("a.track_id", "a.entry", "b.exit", (F.col("a.n") + F.col("b.n")).alias("n")))
        tables.drop(before, old)
        if hops.isEmpty():
            break

    entered = reached.withColumn("start", F.floor(F.col("at") / split) * split)
    todo = parts.join(entered.select(F.col("track_id").alias("path"), "start", "at", "before"), ["path", "start"]).select("path", "end", "at", "before")
    broken = parts.where("start IS NULL").select("path", F.lit(None).cast("long").alias("end"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("before"))
    names = [c.split()[0] for c in pgs.SEGMENTS.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string()]

    def read(batches):
        for b in batches:
            for path, end, at, seq in zip(*(c.to_pylist() for c in b.columns)):
                rows = []
                try:
                    with matroska.opened(path) as f:
                        while end is None or at < end:
                            f.seek(at)
                            found = next(pgs.split(f.read(pgs.HEADER + 0xFFFF)), None)
                            if found is None:
                                break
                            rows.append((path, seq, at, *found[1:]))
                            at, seq = at + pgs.HEADER + found[4], seq + 1
                            if found[-1]:
                                break
                            if len(rows) == 1000:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                                rows = []
                except OSError as e:
                    rows.append((path, seq, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return todo.unionByName(broken).repartition(4 * files.sparkSession.sparkContext.defaultParallelism, "path", "at").mapInArrow(read, pgs.SEGMENTS)
