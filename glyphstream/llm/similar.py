"""N-gram Jaccard join: adaptive multi-match prefixes.

A document is its set of distinct word shingles. Copies of one set are one class, and only a representative is compared.
Shingles are ordered rarest first by exact counts over all representatives. A document of n shingles that links with
another shares at least o = ceil(threshold * n) of them, so both contain l common shingles among the first n - o + l. Each
document picks the l with the least estimated cost (its prefix's postings, plus the candidates that l matches leave); a pair
must then share min(l_x, l_y) prefix shingles before it is verified on the whole sets.

Pairs inside large groups of near copies are not all made: documents of large groups are compared in rounds, first against a
few of the group (chosen by hash), then against eight times as many, and so on up to all; a round skips pairs that earlier rounds'
links have already connected. Every pair of representatives is thus verified or known to be in one component.

Defined results: a text with fewer words than a shingle is its whole word sequence as one shingle; null and empty texts have an
empty set and link with nothing; component_id is the smallest doc_id reachable (null doc_ids count only where there is no other);
rows of one doc_id are documents of their own; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphstream.llm import _chunks as C
from glyphstream.llm._common import Scratch, lean, mix, read_table, window_hashes, word_hashes
from glyphstream.llm._graph import components

SHINGLE = 5
PERCENT = 75
MAX_MATCHES = 4
#: Estimated cost of a candidate against that of a posting.
VERIFY_COST = 4.0
#: Hubs of a large group in the first round, and the growth of their number from round to round.
HUBS, GROWTH = 4, 8
SMALL_GROUP = 32
#: Rows of one token to a join key at most, about.
SALT_ROWS = 4_000
_LOW = ~np.uint64(0xFFFF)


class ChunkSets:
    """The shingle sets of a chunk's documents: sorted distinct 64-bit hashes each."""

    def __init__(self, docs: bytes, ends: bytes, blob: bytes, size: int):
        self.docs, ends, data = C.unpack(docs, ends, blob)
        words, start, _ = word_hashes(data, lower=True)
        doc = np.searchsorted(ends, start, side="right")
        at = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(self.docs)))]
        shingles = window_hashes(words, size)
        self.sets = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= size:
                self.sets.append(np.unique(shingles[a : b - size + 1]))
            elif b > a:
                self.sets.append(window_hashes(words[a:b], b - a, 100 + b - a))
            else:
                self.sets.append(np.zeros(0, np.uint64))


def row_keys(docs: bytes, ends: bytes, blob: bytes) -> list[bytes]:
    """16 bytes for each of a chunk's rows that tell its doc_id and text from any other's."""
    ids, ends, data = C.unpack(docs, ends, blob)
    out = []
    for doc_id, a, b in zip(ids.to_pylist(), [0, *ends[:-1].tolist()], ends.tolist()):
        h = hashlib.md5(b":" if doc_id is None else b"%d:" % doc_id)
        h.update(memoryview(data)[a : b - 1])
        out.append(h.digest())
    return out


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    return tuple(int(np.sum(mix(s, seed), dtype=np.uint64).astype(np.int64)) for seed in (3, 4))


def matches_wanted(df: np.ndarray, n: int, least: int, most: int = MAX_MATCHES) -> int:
    """The number l of prefix matches with the least estimated cost; df: of the shingles in order, rarest first."""
    posts = np.cumsum((df - 1).astype(np.float64))
    cost = [posts[n - least + k - 1] * (1 + VERIFY_COST / k) + k for k in range(1, min(most, least) + 1)]
    return int(np.argmin(cost)) + 1


def linked(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs (doc_id, text), a row each."""
    scratch = Scratch(docs.sparkSession)
    chunks = C.store(scratch, C.pack_chunks(docs))
    rows, named = _grouped(scratch, chunks, size, percent)
    scratch.drop(chunks)
    # Kept, so that the partitions of a large component can be split in the join.
    least = scratch.keep(named.groupBy("comp").agg(F.min("first_doc").alias("component_id")))
    by_set = scratch.keep(named.join(least, "comp").select("s1", "s2", "n", "component_id"))
    scratch.drop(named, least)
    return rows.join(by_set, ["s1", "s2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _grouped(scratch: Scratch, chunks: DataFrame, size: int = SHINGLE, percent: int = PERCENT, keyed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Kept rows (doc_id, node, n, s1, s2) of chunked documents, and their distinct sets (s1, s2, n, node, first_doc, comp), comp being one node of the component.

    keyed: rows have their row_keys() as key too, and sets first_row (no_id, doc_id, key, node), the smallest of their rows.
    """
    spark = scratch.spark
    chunks = chunks.select("chunk", "docs", "ends", "blob")
    key = lambda chunk, k: (chunk << 22) | k

    def sign(batches):
        for b in batches:
            for row in b.to_pylist():
                c = ChunkSets(row["docs"], row["ends"], row["blob"], size)
                n = [len(s) for s in c.sets]
                sig = np.array([signature(s) for s in c.sets], np.int64).reshape(-1, 2)
                own = [pa.array(row_keys(row["docs"], row["ends"], row["blob"]), pa.binary())] if keyed else []
                yield pa.RecordBatch.from_arrays([c.docs, pa.array(np.arange(len(n), dtype=np.int64) + key(row["chunk"], 0)), pa.array(n, pa.int64()), pa.array(sig[:, 0]), pa.array(sig[:, 1]), *own], names=["doc_id", "node", "n", "s1", "s2"] + ["key"] * keyed)

    rows = scratch.keep(chunks.mapInArrow(lean(sign), "doc_id long, node long, n long, s1 long, s2 long" + ", key binary" * keyed))
    first_row = [F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "node")).alias("first_row")] if keyed else []
    classes = scratch.keep(rows.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("node").alias("node"), F.min("doc_id").alias("first_doc"), *first_row))
    own = classes.groupBy(F.shiftright("node", 22).alias("chunk")).agg(F.collect_list(F.col("node").bitwiseAND((1 << 22) - 1).cast("int")).alias("own"))
    total = classes.agg(F.sum("n")).head()[0] or 0
    buckets = C.bucket_count(spark, total)
    chosen = chunks.join(own, "chunk")

    def of_chunk(row):
        c = ChunkSets(row["docs"], row["ends"], row["blob"], size)
        own = np.sort(np.array(row["own"]))
        sets = [c.sets[k] for k in own]
        every = np.concatenate(sets)
        distinct, inverse, n = np.unique(every & _LOW, return_inverse=True, return_counts=True)
        return own, sets, every, distinct, inverse, n

    def count(batches):
        for b in batches:
            for row in b.to_pylist():
                _, _, _, distinct, _, n = of_chunk(row)
                yield C.sent_rows(row["chunk"], distinct, n.astype(np.uint32), buckets)

    def summed(h, extra, chunk):
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        return np.repeat(np.add.reduceat(extra, first).astype(np.uint32), np.diff(np.r_[first, len(h)]))

    told = scratch.keep(C.answered(chosen.mapInArrow(lean(count), C.SENT), summed, np.uint32))
    scratch.tidy()

    def prefixes(batches):
        for b in batches:
            for row in b.to_pylist():
                own, sets, every, distinct, inverse, _ = of_chunk(row)
                df = C.answers_values(row["answers"], np.uint32)[inverse]
                out, at = [], 0
                for k, s in zip(own.tolist(), sets):
                    d, n, least = df[at : at + len(s)], len(s), -(-percent * len(s) // 100)
                    at += len(s)
                    shared = d > 1
                    alone = n - int(np.count_nonzero(shared))
                    if alone > n - least:
                        continue  # its whole shortest prefix is its own
                    order = np.lexsort((s, s & _LOW, d))
                    want = matches_wanted(d[order], n, least)
                    out.append((key(row["chunk"], k), n, want, alone, s[order[alone : n - least + want]].astype(np.int64), s[shared].tobytes()))
                columns = zip(*out) if out else [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["node", "n", "l", "alone", "prefix", "shared"])

    docs_with = scratch.keep(chosen.join(told, "chunk").mapInArrow(lean(prefixes), "node long, n long, l int, alone long, prefix array<long>, shared binary"))
    scratch.drop(told)
    links, parts = _links(scratch, docs_with, percent)
    scratch.drop(docs_with)
    comp = components(links, scratch)
    named = scratch.keep(classes.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    scratch.drop(classes, comp, *parts)
    scratch.tidy()
    return rows, named


def _links(scratch: Scratch, docs: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Verified links (x, y) that connect what all links connect, and the kept tables they are read from; from (node, n, l, alone, prefix, shared).

    A pair shares at least half = ceil(2t / (1 + t) * n) shingles, n the smaller size, so the smaller document's common shingles begin within
    its first n - half + l; only these (short) are matched on its side.
    """
    half = F.floor((2 * percent * F.col("n") + 99 + percent) / (100 + percent)).cast("long")
    posts = docs.select("node", "n", "l", "alone", F.posexplode("prefix").alias("pos", "token"))
    posts = posts.select("node", "n", "l", "token", (F.col("alone") + F.col("pos") < F.col("n") - half + F.col("l")).alias("short"))
    groups = posts.groupBy("token").agg(F.count("*").alias("g"), F.min("node").alias("first")).where("g > 1")
    shared = scratch.keep(posts.join(groups, "token"))
    posts = shared
    # The first of a large group is often what the others were copied from, so it is a hub from the start.
    largest = posts.groupBy("node").agg(F.when(F.max((F.col("node") == F.col("first")) & (F.col("g") > SMALL_GROUP)), 1).otherwise(F.max("g")).alias("most"))
    posts = posts.drop("first")
    u = F.pmod(F.xxhash64("node"), F.lit(1 << 40)) / float(1 << 40)
    turn = F.when(F.col("most") <= SMALL_GROUP, 0).otherwise(F.greatest(F.lit(0), F.ceil(F.log(u * F.col("most") / HUBS) / F.log(F.lit(float(GROWTH)))))).cast("int")
    posts = scratch.keep(posts.join(largest.select("node", F.coalesce(turn, F.lit(0)).alias("turn")), "node"))
    scratch.drop(shared)
    scratch.tidy()
    last = posts.agg(F.max("turn")).head()[0] or 0
    sets = docs.select("node", "shared")
    found, comp, parts = None, None, []
    for turn in range(last + 1):
        p = posts.where(F.col("turn") >= turn)
        if comp is not None:
            p = scratch.keep(p.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
            # Tokens whose documents are all connected by now have no pair left.
            several = scratch.keep(p.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("token"))
            named, p = p, scratch.keep(p.join(several, "token", "left_semi"))
            scratch.drop(comp, several, named)
        else:
            p = p.withColumn("comp", F.col("node"))
        salts = F.ceil(F.col("g") / SALT_ROWS)
        hubs = p.where(F.col("turn") == turn).select(F.col("token").alias("hub_token"), F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("l").alias("hub_l"), F.col("comp").alias("hub_comp"), F.col("short").alias("hub_short"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("hub_salt"))
        p = p.withColumn("salt", F.pmod(F.xxhash64("node"), salts))
        near = (F.col("comp") != F.col("hub_comp")) & ((F.col("turn") > turn) | (F.col("node") > F.col("hub"))) & (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
        near = near & (F.col("short") | (F.col("n") > F.col("hub_n"))) & (F.col("hub_short") | (F.col("hub_n") > F.col("n")))
        pairs = p.join(hubs, (F.col("token") == F.col("hub_token")) & (F.col("salt") == F.col("hub_salt")) & near).groupBy(F.col("node").alias("x"), F.col("hub").alias("y")).agg(F.count("*").alias("same"), F.first("n").alias("n_x"), F.first("hub_n").alias("n_y"), F.first(F.least("l", "hub_l")).alias("want"))
        pairs = pairs.where("same >= want").select("x", "y", "n_x", "n_y")
        both = pairs.join(sets.select(F.col("node").alias("x"), F.col("shared").alias("a")), "x").join(sets.select(F.col("node").alias("y"), F.col("shared").alias("b")), "y")

        def verify(batches):
            for b in batches:
                x, y, n = b.column("x"), b.column("y"), b.column("n_x").to_numpy() + b.column("n_y").to_numpy()
                hit = np.zeros(b.num_rows, bool)
                for i in range(b.num_rows):
                    s, t = (np.frombuffer(b.column(c)[i].as_buffer(), np.uint64) for c in ("a", "b"))
                    if len(t) < len(s):
                        s, t = t, s
                    if len(s):
                        same = int(np.count_nonzero(t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s))
                        hit[i] = 100 * same >= percent * (int(n[i]) - same)
                keep = pa.array(hit)
                yield pa.RecordBatch.from_arrays([x.filter(keep), y.filter(keep)], names=["x", "y"])

        new = scratch.keep(both.select("x", "y", "n_x", "n_y", "a", "b").mapInArrow(lean(verify), "x long, y long"))
        parts.append(new)
        found = new if found is None else found.union(new)
        scratch.drop(p)
        scratch.tidy()
        if turn < last:
            comp = components(found, scratch)
    scratch.drop(posts)
    return found, parts


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each group of rows that link, directly or through others: one of the group's smallest doc_id.

    Rows of one doc_id, or without one, are documents of their own: they go only where their texts link. Of a group's rows with its
    smallest doc_id the one whose row_keys() entry is smallest stays. Texts without words link with nothing, so their rows all stay. Rows wait in
    their chunks, where the decision comes to them, and don't move.
    """
    scratch = Scratch(docs.sparkSession)
    chunks = C.store(scratch, C.pack_chunks(docs, whole=True))
    rows, named = _grouped(scratch, chunks, keyed=True)
    stay = named.groupBy("comp").agg(F.min("first_row").alias("first_row")).select("first_row.node").union(rows.where("n = 0").select("node"))
    own = stay.groupBy(F.shiftright("node", 22).alias("chunk")).agg(F.collect_list(F.col("node").bitwiseAND((1 << 22) - 1).cast("int")).alias("own"))
    own = scratch.keep(own)
    scratch.drop(rows, named)
    schema = docs.schema
    text = next(k for k, c in enumerate(docs.columns) if c.lower() == "text")

    def rebuilt(batches):
        for b in batches:
            for row in b.to_pylist():
                yield C.unpack_rows(row, np.sort(np.array(row["own"])), schema, text)

    return chunks.drop("n_bytes").join(own, "chunk").mapInArrow(lean(rebuilt), schema)


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return linked(read_table(spark, sf_dir, "documents"))
