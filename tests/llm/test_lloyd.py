"""Delta Lloyd against plain Lloyd on Python's whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from glyphstream.llm import lloyd
from glyphstream.llm._common import Scratch


def plain(rows, dim, k=16, rounds=3, seed=1):
    """(sorted (vec_id, cluster, distance), centroids) of rows (vec_id, vector), all against all in each round."""
    kept = [(i, [max(-lloyd.BOUND, min(lloyd.BOUND, math.floor(64 * x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), q) for i, q in kept)
    centroids = [q for _, q in order[:k]]
    for turn in range(rounds + 1):
        own = [min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(centroids)) for _, q in kept]
        if turn < rounds:
            for n in range(len(centroids)):
                mine = [q for (_, q), (_, o) in zip(kept, own) if o == n]
                if mine:
                    centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted((i if i is not None else -1, c, d) for (i, _), (d, c) in zip(kept, own)), centroids


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    base = rng.normal(0, 0.2, (5, 8)).astype(np.float32)
    out = [(i, (base[i % 5] + rng.normal(0, 0.1, 8)).astype(np.float32).tolist()) for i in range(400)]
    out += [(400 + i, base[0].tolist()) for i in range(200)]  # a large group of equal vectors
    out += [(7, out[7][1]), (7, out[9][1]), (None, out[3][1])]  # repeated and null ids
    out += [(900, None), (901, []), (902, [0.5] * 7), (903, [0.5] * 9), (904, [0.5] * 7 + [None]), (905, [0.5] * 7 + [float("nan")]), (906, [0.5] * 7 + [float("inf")]), (907, [0.0] * 8)]
    return out


@pytest.mark.parametrize("size", [16, 4096])
def test_rounds(spark, rows, monkeypatch, size):
    monkeypatch.setattr(lloyd, "blocks", lambda v, dim, scale, f=lloyd.blocks: f(v, dim, scale, size))
    vectors = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, block int, owner string").repartition(5)
    got, centroids = lloyd.cluster(vectors, Scratch(spark), dim=8)
    want, final = plain(rows, 8)
    assert centroids == final
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance) for r in got.collect()) == want


def test_few_none_and_huge(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, [0.1, 0.2]), (2, [0.1, 0.2])], [(1, [1e300, -1e300]), (2, [-1e300, 1e300]), (3, [3e5, 1.0]), (4, [-3.0, 2e4])]):
        got, centroids = lloyd.cluster(spark.createDataFrame(rows, schema), Scratch(spark), dim=2, k=2)
        want, final = plain(rows, 2, k=2)
        assert centroids == final and sorted(tuple(r) for r in got.collect()) == want


def test_only_changed_centroids_are_compared(rows, monkeypatch):
    """A round looks at changed centroids alone, and at all for vectors whose owner changed; the result is that of a full round."""
    q = np.array([np.floor(64 * np.array(v)) for _, v in rows[:400]], np.int32)
    c = q[:6].astype(np.int64)
    owner, distance = lloyd.reassigned(q, None, None, c, np.arange(6))
    moved = c.copy()
    moved[2] += 5
    seen = []
    monkeypatch.setattr(lloyd, "distances", lambda x, y, f=lloyd.distances: seen.append((len(x), len(y))) or f(x, y))
    got = lloyd.reassigned(q, owner, distance, moved, np.array([2]))
    assert seen == [((owner == 2).sum(), 6), ((owner != 2).sum(), 1)]
    full = lloyd.reassigned(q, None, None, moved, np.arange(6))
    assert all((a == b).all() for a, b in zip(got, full))
    told = {t["cluster"]: t for t in lloyd.transfers(q, owner, got[0])}
    for k in range(6):
        t = told.get(k, {"n": 0, "sums": [0] * 8})
        assert t["n"] == (got[0] == k).sum() - (owner == k).sum() and (q[got[0] == k].sum(axis=0) - q[owner == k].sum(axis=0)).tolist() == t["sums"]


def test_repeated_runs_agree_and_blocks_fill(spark):
    vectors = spark.range(1000).selectExpr("id AS vec_id", "array(id % 7 / 7.0D, id % 11 / 11.0D) AS embedding").repartition(3)
    assert sorted(r.n for r in lloyd.blocks(vectors, 2, 64, 100).selectExpr("size(ids) n").collect())[-9:] == [100] * 9
