"""Centroid clustering: delta Lloyd.

Vectors are turned into whole numbers once and kept in blocks, one row for some thousands of them, in a table bucketed by block. What a round
finds (each vector's owner and distance) is a table of the same buckets, so that a round joins a block with its last assignment
without moving either. A round compares a vector with the centroids that changed alone, or with all where its own owner changed;
a block then hands on only the signed sums of vectors that went from one centroid to another, which are added to the global sums. All arithmetic is on whole numbers.

Defined results: vectors that are null, of another number of components, or that hold null or non-finite components take no part; components beyond +-2^27
after scaling count as that bound, so that a distance fits into a long; fewer vectors than k give as many centroids; a null vec_id hashes as the empty string, and
of equal hashes the smaller vector comes first; equal rows are vectors each; an empty table gives no rows. An inertia beyond a long is null. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphstream.llm._common import Scratch, lean, parallelism, read_table

DIM, K, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
#: Vectors to a block.
BLOCK = 4096
BOUND = 1 << 27
#: Components up to this keep every product and sum below 2^53, so that distances by matrix products of doubles are exact.
EXACT = 1 << 22

_STATE = "block long, owner array<int>, distance array<long>, transfers array<struct<cluster:int,n:long,sums:array<long>>>"
_TRANSFERS = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))


def blocks(vectors: DataFrame, dim: int = DIM, scale: int = SCALE, size: int = BLOCK) -> DataFrame:
    """(block, ids, data) of vectors (vec_id, embedding): data holds a block's scaled components as little-endian 32-bit, vector by vector."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        ids, parts, held = [], [], 0
        for b in batches:
            fits = pc.fill_null(pc.equal(pc.list_value_length(b.column(1)), dim), False)
            own, lists = b.column(0).filter(fits), b.column(1).filter(fits)
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            finite = np.isfinite(x).all(axis=1)
            own, x = own.filter(pa.array(finite)), x[finite]
            q = np.clip(np.floor(np.clip(x, -BOUND, BOUND) * scale), -BOUND, BOUND).astype("<i4")
            ids.append(own)
            parts.append(q)
            held += len(q)
            while held >= size:
                ids, parts = [pa.concat_arrays(ids)], [np.concatenate(parts)]
                yield _block(number, ids[0][:size], parts[0][:size])
                number, ids, parts, held = number + 1, [ids[0][size:]], [parts[0][size:]], held - size
        if held:
            yield _block(number, pa.concat_arrays(ids), np.concatenate(parts))

    cast = vectors.select(F.col("vec_id").cast("long").alias("_id"), F.col("embedding").cast("array<double>").alias("_vector"))
    return cast.mapInArrow(lean(run), "block long, ids array<long>, data binary")


def _block(number: int, ids: pa.Array, q: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([q.tobytes()], pa.binary())], names=["block", "ids", "data"])


def seeds(kept: DataFrame, k: int = K, dim: int = DIM, seed: int = SEED) -> list[list[int]]:
    """The vectors with the k smallest hashes of seed and vec_id; each block hands on k at most."""

    def run(batches):
        for b in batches:
            for ids, data in zip(b.column(0), b.column(1)):
                q = np.frombuffer(data.as_py(), "<i4").reshape(-1, dim)
                hashed = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), row) for row, i in enumerate(ids.as_py()))
                last = hashed[min(k, len(hashed)) - 1][0]  # all vectors of equal hashes go on, up to k of the smallest
                first = sorted((h, q[row].tolist()) for h, row in hashed if h <= last)[:k]
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in first], pa.string()), pa.array([v for _, v in first], pa.list_(pa.int32()))], names=["hash", "q"])

    rows = kept.select("ids", "data").mapInArrow(lean(run), "hash string, q array<int>").orderBy("hash", "q").limit(k).collect()
    return [list(r.q) for r in rows]


def distances(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number vectors to centroids."""
    if max(np.abs(q).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        x, c = q.astype(np.float64), centroids.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    x = q.astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def reassigned(q: np.ndarray, owner: np.ndarray | None, distance: np.ndarray | None, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, distance) under centroids of which those changed since owner and distance were found; ties go to the smaller number."""
    if owner is None:
        d = distances(q, centroids)
        best = d.argmin(axis=1)
        return best.astype(np.int32), d[np.arange(len(q)), best]
    owner, distance = owner.copy(), distance.copy()
    if not len(changed):
        return owner, distance
    lost = np.isin(owner, changed)
    if lost.any():
        owner[lost], distance[lost] = reassigned(q[lost], None, None, centroids, changed)
    stay = np.flatnonzero(~lost)
    if len(stay):
        d = distances(q[stay], centroids[changed])
        best = d.argmin(axis=1)
        d, best = d[np.arange(len(stay)), best], changed[best]
        nearer = (d < distance[stay]) | (d == distance[stay]) & (best < owner[stay])
        owner[stay[nearer]], distance[stay[nearer]] = best[nearer], d[nearer]
    return owner, distance


def transfers(q: np.ndarray, before: np.ndarray | None, after: np.ndarray) -> list[dict]:
    """Signed counts and sums of the vectors that went to or left each centroid."""
    went = np.ones(len(q), bool) if before is None else before != after
    x, to = q[went].astype(np.int64), after[went]
    left = np.full(len(to), -1) if before is None else before[went]
    out = []
    for c in np.unique(np.r_[to, left]):
        if c >= 0:
            out.append({"cluster": int(c), "n": int((to == c).sum() - (left == c).sum()), "sums": (x[to == c].sum(axis=0) - x[left == c].sum(axis=0)).tolist()})
    return out


def assign(kept: DataFrame, state: DataFrame | None, centroids: list[list[int]], changed: list[int], dim: int = DIM) -> DataFrame:
    """The next _STATE of kept blocks."""
    c, new = np.array(centroids, np.int64).reshape(-1, dim), np.array(changed, np.int32)

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                q = np.frombuffer(b.column(1)[row].as_py(), "<i4").reshape(-1, dim)
                old = [b.column(k)[row].values.to_numpy() for k in (2, 3)] if b.num_columns > 2 else [None, None]
                owner, distance = reassigned(q, *old, c, new)
                whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, 1), whole(owner), whole(distance), pa.array([transfers(q, old[0], owner)], _TRANSFERS)], names=["block", "owner", "distance", "transfers"])

    joined = kept.select("block", "data") if state is None else kept.select("block", "data").join(state.select("block", "owner", "distance").hint("shuffle_hash"), "block")  # a bucket's state in memory, the vectors unsorted
    return joined.mapInArrow(lean(run), _STATE)


def cluster(vectors: DataFrame, scratch: Scratch, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(rows (vec_id, cluster, distance), centroids) after so many rounds and a last assignment. The driver holds k x dim numbers."""
    n = parallelism(scratch.spark)
    made = scratch.keep(blocks(vectors, dim, scale))
    kept = scratch.bucketed(made.repartition(n, "block"), "block", n)
    scratch.drop(made)
    centroids = seeds(kept, k, dim, seed)
    counts, sums = [0] * len(centroids), [[0] * dim for _ in centroids]
    state, changed = None, list(range(len(centroids)))
    for turn in range(rounds + 1):
        if not changed and state is not None:  # nothing to compare: every later round would find the same
            break
        before, state = state, scratch.bucketed(assign(kept, state, centroids, changed, dim), "block", n)
        scratch.drop(before)
        if turn == rounds:
            break
        gone = state.select(F.inline("transfers")).select("cluster", "n", F.posexplode("sums").alias("at", "v"))
        exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).cast("decimal(38,0)")
        for r in gone.groupBy("cluster", "at").agg(exact("n").alias("n"), exact("v").alias("v")).collect():
            sums[r.cluster][r.at] += int(r.v)
            counts[r.cluster] += int(r.n) if r.at == 0 else 0
        new = [[s // counts[c] for s in sums[c]] if counts[c] else centroids[c] for c in range(len(centroids))]
        changed = [c for c in range(len(new)) if new[c] != centroids[c]]
        centroids = new
    rows = kept.select("block", "ids").join(state.select("block", "owner", "distance").hint("shuffle_hash"), "block")
    return rows.select(F.inline(F.arrays_zip("ids", "owner", "distance"))).select(F.col("ids").alias("vec_id"), F.col("owner").alias("cluster"), "distance"), centroids


def op13_delta_lloyd(spark, sf_dir: str) -> DataFrame:
    """Each vector's cluster and distance, with its cluster's and the whole inertia and its centroid's digest."""
    rows, centroids = cluster(read_table(spark, sf_dir, "embeddings"), Scratch(spark))
    total = {r.cluster: int(r.t) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("t")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    told = [(c, fits(total.get(c, 0)), fits(sum(total.values())), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    return rows.join(F.broadcast(spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
