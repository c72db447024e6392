"""Approximate nearest neighbours: inverted multi-index.

Each half of a vector is quantised by its own k-means centroids, fitted on at most ``train_rows`` rows; a cell is a pair of
centroids. There are about as many cells as rows (the square root of the rows as centroids of a half), up to ``centroids`` squared.
A query visits cells by growing sum of the two halves' distances (multi-sequence traversal with a heap) until the visited
cells hold a share of all rows. That share is learned with the index: on the sample, the share within which ``find``
of its rows' true neighbours lie. It is small where vectors cluster and large where they are spread evenly; there is no floor and no switch.

The traversal leaves one number, the sum at which the query stops. Queries, ``query_rows`` at a time, are broadcast with it; entries stay where
they are, sorted by cell, and each task reranks the entries of a cell against the queries that reach it, by exact distance.

Defined results: vectors are compared with those of their own length only, each length having its own index; rows whose
vector is null, empty, zero, or holds null or non-finite components take no part, nor do rows without vec_id; repeated rows of a query (equal vec_id
and vector) are one query; different vectors under one vec_id are queries of their own, told apart by ``variant`` (0, 1, ...; in the vectors' order);
rows with the query's vec_id are its own; repeated candidates are ranked each; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphstream.llm._common import Scratch, lean, read_table

K_NEAREST = 10
#: Centroids of a half at most.
CENTROIDS = 256
TRAIN_ROWS = 16_384
#: Share of the sample's true neighbours that the visited cells must hold, and rows of the sample that are asked.
FIND, ASKED = 0.95, 256
#: Queries broadcast at once (64 components: 16 MB).
QUERY_ROWS = 16_384
QUERY_EVERY = 100

_RESULT = "query_id long, variant int, rank int, vec_id long, score double"


def usable(df: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0))
    return rows.where(F.coalesce(F.forall("v", finite) & F.exists("v", lambda x: x != 0), F.lit(False)))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """At most k centroids of rows; rows without components have one."""
    if not x.shape[1]:
        return np.zeros((1, 0))
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, c).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        for d in range(x.shape[1]):
            s = np.bincount(near, x[:, d], len(c))
            c[n > 0, d] = s[n > 0] / n[n > 0]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances up to a term of x alone."""
    return (c * c).sum(axis=1) - 2 * x @ c.T


class MultiIndex:
    """Centroids of both halves, and the share of all rows that a query visits."""

    def __init__(self, sample: np.ndarray, centroids: int, k: int = K_NEAREST, find: float = FIND):
        self.cut = (sample.shape[1] + 1) // 2
        self.halves = [kmeans(p, centroids) for p in self.parts(sample)]
        self.width = len(self.halves[1])
        self.share = self._share(sample, k, find)

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.cut], x[:, self.cut :]

    def pairs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid of each half of the rows."""
        return tuple(nearest(p, c).argmin(axis=1) for p, c in zip(self.parts(x), self.halves))

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.pairs(x)
        return a * self.width + b

    def distances(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of rows to the centroids, by half; the same numbers wherever they are worked out."""
        return tuple(np.stack([((p - z) ** 2).sum(axis=1) for z in c], axis=1) for p, c in zip(self.parts(q), self.halves))

    def _share(self, x: np.ndarray, k: int, find: float) -> float:
        asked = np.arange(0, len(x), max(1, len(x) // ASKED))[:ASKED]
        da, db = self.distances(x[asked])
        a, b = self.pairs(x)
        norms, need = (x * x).sum(axis=1), []
        for n, i in enumerate(asked.tolist()):
            d = norms - 2 * x @ x[i]
            d[i] = np.inf
            near = np.argpartition(d, k)[:k] if len(x) > k + 1 else np.flatnonzero(np.isfinite(d))
            sums = da[n][a] + db[n][b]
            need += (np.searchsorted(np.sort(sums), sums[near], side="right") / len(x)).tolist()
        return float(np.quantile(need, find)) if need else 1.0

    def stop(self, da: np.ndarray, db: np.ndarray, counts: np.ndarray, budget: float) -> float:
        """The sum of the halves' distances at which the cells visited by growing sum hold ``budget`` rows."""
        oa, ob = np.argsort(da, kind="stable").tolist(), np.argsort(db, kind="stable").tolist()
        sa, sb = da[oa].tolist(), db[ob].tolist()
        held, at, heap, width = 0, -np.inf, [(sa[0] + sb[0], 0, 0)], self.width
        pop, push = heapq.heappop, heapq.heappush
        while heap and held < budget:
            at, i, j = pop(heap)
            held += counts[oa[i] * width + ob[j]]
            if j + 1 < len(sb):
                push(heap, (sa[i] + sb[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(sa):
                push(heap, (sa[i + 1] + sb[0], i + 1, 0))
        return at


class Asked:
    """A block of queries against runs of entries of one cell; keeps each query's best so far."""

    def __init__(self, index: MultiIndex, no: np.ndarray, ids: np.ndarray, q: np.ndarray, stops: np.ndarray, k: int):
        self.no, self.ids, self.q, self.stops, self.k = no, ids, q, stops, k
        self.da, self.db = index.distances(q)
        self.width, self.norms = index.width, (q * q).sum(axis=1)
        self.limit = np.full(len(q), np.inf)
        self.best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # query's place, vec_id, squared distance

    def cell(self, cell: int, ids: np.ndarray, x: np.ndarray, out: list) -> None:
        a, b = divmod(cell, self.width)
        mine = np.flatnonzero(self.da[:, a] + self.db[:, b] <= self.stops)
        if not len(mine):
            return
        norms = (x * x).sum(axis=1)
        about = norms[None, :] + self.norms[mine, None] - 2 * self.q[mine] @ x.T
        slack = 1e-9 * (norms.max() + self.norms[mine])
        i, j = np.nonzero((about <= (self.limit[mine] + slack)[:, None]) & (self.ids[mine, None] != ids[None, :]))
        for s in range(0, len(i), 1 << 16):  # exactly, some at a time
            p, r = mine[i[s : s + (1 << 16)]], j[s : s + (1 << 16)]
            out.append((p, ids[r], ((x[r] - self.q[p]) ** 2).sum(axis=1)))

    def settle(self, out: list) -> None:
        """Keep the k best of each query, ties by vec_id."""
        p, v, d = (np.concatenate([a, *b]) for a, b in zip(self.best, zip(*out)))
        order = np.lexsort((v, d, p))
        p, v, d = p[order], v[order], d[order]
        first = np.searchsorted(p, p)
        top = np.arange(len(p)) - first < self.k
        self.best = [p[top], v[top], d[top]]
        full = np.arange(len(p)) - first == self.k - 1
        self.limit[p[full]] = d[full]


def _centroids(rows: int, most: int) -> int:
    return max(1, min(most, round(rows**0.5)))


def search(df: DataFrame, queries: DataFrame, k: int = K_NEAREST, centroids: int = CENTROIDS, train_rows: int = TRAIN_ROWS, find: float = FIND, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, variant, rank, vec_id, score) for ``queries`` (rows of the form of df) against all rows of df (vec_id, embedding)."""
    spark = df.sparkSession
    rows, asked = usable(df), usable(queries).groupBy("vec_id", "v").count()
    asked = asked.select(F.col("vec_id").alias("query_id"), "v", (F.row_number().over(Window.partitionBy("vec_id").orderBy(F.size("v"), "v")) - 1).alias("variant"))
    out = None
    for (length,) in sorted(map(tuple, asked.select(F.size("v")).distinct().collect())):  # a query's candidates are of its length
        one = _search(rows.where(F.size("v") == length), asked.where(F.size("v") == length), k, centroids, train_rows, find, query_rows)
        out = one if out is None else out.union(one)
    return spark.createDataFrame([], _RESULT) if out is None else out


def _search(rows: DataFrame, asked: DataFrame, k: int, centroids: int, train_rows: int, find: float, query_rows: int) -> DataFrame:
    spark = rows.sparkSession
    scratch = Scratch(spark)
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(train_rows).select("v").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], _RESULT)
    index = MultiIndex(matrix(sample.column(0).combine_chunks()), _centroids(total, centroids), k, find)
    del sample
    kind = rows.schema["v"].dataType.simpleString()

    def assign(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(index.cells(matrix(b.column(1))).astype(np.int32))], names=["vec_id", "v", "cell"])

    # Sorted within the input's partitions: a task meets a cell's entries together, and no cell, however full, meets in one task.
    entries = scratch.keep(rows.mapInArrow(lean(assign), f"vec_id long, v {kind}, cell int").sortWithinPartitions("cell"))
    counts = np.zeros(len(index.halves[0]) * index.width, np.int64)
    for r in entries.groupBy("cell").count().collect():  # centroids squared at most
        counts[r[0]] = r[1]
    budget = index.share * total

    def traverse(batches):
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                da, db = index.distances(matrix(part.column(2)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([index.stop(x, y, counts, budget) for x, y in zip(da, db)], pa.float64())], names=["query_id", "variant", "v", "stop"])

    parts = max(1, asked.count() // 64)
    probes = scratch.keep(asked.select("query_id", "variant", "v").repartition(min(parts, spark.sparkContext.defaultParallelism * 8), "query_id", "variant").mapInArrow(lean(traverse), f"query_id long, variant int, v {kind}, stop double"))
    blocks = max(1, -(-probes.count() // query_rows))
    near = None
    for block in range(blocks):
        one = _rerank(spark, index, entries, probes.where(F.pmod(F.xxhash64("query_id", "variant"), F.lit(blocks)) == block), k)
        near = one if near is None else near.union(one)
    near = scratch.keep(near)
    scratch.drop(entries, probes)
    w = Window.partitionBy("query_id", "variant").orderBy("score", "vec_id")
    return near.select("query_id", "variant", F.row_number().over(w).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _rerank(spark, index: MultiIndex, entries: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """The k nearest of each task's entries for every query of a block (of a size that is bounded by query_rows, about)."""
    got = probes.orderBy("query_id", "variant").toArrow().combine_chunks()
    if not got.num_rows:
        return spark.createDataFrame([], "query_id long, variant int, vec_id long, score double")
    ids, variant, stops = (got.column(c).to_numpy() for c in ("query_id", "variant", "stop"))
    v = got.column("v").combine_chunks() if isinstance(got.column("v"), pa.ChunkedArray) else got.column("v")
    sent = spark.sparkContext.broadcast((index, ids, variant, matrix(v), stops))

    def run(batches):
        index, ids, variant, q, stops = sent.value
        sides = [Asked(index, np.arange(a, min(a + 1024, len(q))), ids[a : a + 1024], q[a : a + 1024], stops[a : a + 1024], k) for a in range(0, len(q), 1024)]
        for b in batches:
            if not b.num_rows:
                continue
            cell, own, x = b.column(2).to_numpy(), b.column(0).to_numpy(), matrix(b.column(1))
            cuts = np.flatnonzero(np.diff(cell)) + 1
            for side in sides:
                out: list = []
                for s, e in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(cell)].tolist()):
                    side.cell(int(cell[s]), own[s:e], x[s:e], out)
                    if len(out) > 512:
                        side.settle(out)
                        out = []
                if out:
                    side.settle(out)
        for side in sides:
            p, vec, d = side.best
            at = side.no[p]
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(variant[at]), pa.array(vec), pa.array(np.sqrt(d))], names=["query_id", "variant", "vec_id", "score"])

    return entries.select("vec_id", "v", "cell").mapInArrow(lean(run), "query_id long, variant int, vec_id long, score double")


def op4_inverted_multi_index(spark, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % QUERY_EVERY == 0)).select("query_id", "rank", "vec_id", "score", "variant")
