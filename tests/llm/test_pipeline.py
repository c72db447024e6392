"""The corpus pipeline, stage by stage, on small tables that hold what each stage is to find."""

import os
import re
import zlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest

import corpus_pipeline
from glyphstream.llm import mixing, packing
from glyphstream.llm._common import Scratch, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(31)
    words = ["river", "house", "green", "stone", "walk", "light", "about", "never", "under", "water"] + ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(200)]
    good = lambda n: " ".join(str(w) for w in rng.choice(words, n))
    bad = lambda: " ".join(str(w) for w in rng.choice(["BUY!!", "NOW%%", "$$$", "###", "***"], 40))
    rows = []
    for i in range(160):
        text = bad() if i % 8 == 7 else good(int(rng.integers(20, 120)))
        rows.append([i, text, "en", "abc"[i % 3], 1])
    for i in range(100, 107):  # copies, exact and near, of good documents
        if i % 8 != 7:
            rows[i][1] = rows[i - 100][1] if i % 2 else rows[i - 100][1] + " end"
    rows[33][1] += " password = hunter2hunter2 and more"
    rows += [[200, None, None, None, None], [201, "", "en", "a", 0], [None, good(50), "en", "b", 2], [2, good(60), "en", None, 3]]
    spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 0 if i % 8 == 7 else 1, 0) for i in range(0, 160) if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def _sets(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, held[-1], sf_dir)
        if k < 4:
            assert out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        held.append(spark.read.parquet(f"{tmp_path}/{k}"))
    rows = [[tuple(r) for r in d.collect()] for d in held[:5]]
    key = lambda r: tuple(map(repr, r))
    # quality: the junk goes, all else stays
    assert sorted((r for r in rows[1] if r[1]), key=key) == sorted((r for r in rows[0] if r[1] and "!!" not in r[1]), key=key)  # (texts without a word go either way)
    # near duplicates: brute force over all pairs; of each group one row of its smallest doc_id
    left = rows[1]
    sets, group = [_sets(r[1]) for r in left], list(range(len(left)))
    for a in range(len(left)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    smallest = {}
    for r, g in zip(left, group):
        smallest[g] = min(smallest.get(g, (True, 0)), (r[0] is None, r[0] or 0))
    assert len(rows[2]) == len(smallest) < len(left) and sorted((r[0] is None, r[0] or 0) for r in rows[2]) == sorted(smallest.values())
    assert set(rows[2]) <= set(left)
    # secrets: the planted one is replaced, other rows are as they were
    changed = {r[0]: r for r in set(rows[3]) - set(rows[2])}
    assert list(changed) == [33] and "[SECRET] and more" in changed[33][1] and changed[33][4] == len(changed[33][1]) and len(rows[3]) == len(rows[2])
    # mixing: each row as often as mix() says
    want = {}
    for r in mixing.mix(held[3]).collect():
        want[r.doc_id, r.size, r.source] = want.get((r.doc_id, r.size, r.source), 0) + (r.copies if r.size else 1)
    got = {}
    for r in rows[4]:
        k = (r[0], len((r[1] or "").split()), r[3])
        got[k] = got.get(k, 0) + 1
    assert got == {k: n for k, n in want.items() if n} and max(got.values()) > 1
    # packing: every id of every row in exactly one piece
    pieces = held[5].collect()
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in pieces)
    assert sum(r.length for r in pieces) == sum(len(packing.encode(r[1])) + 1 for r in rows[4])
    places = sorted((r.sequence_id * packing.SEQ_LEN + r.offset, r.length) for r in pieces)
    assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))


def test_run_deletes_what_it_kept_and_nothing_else(spark, sf_dir):
    """Other queries' tables, made before or meanwhile in another thread, stay; what the stages but the last kept for themselves goes."""
    at = shared_dir(spark).removeprefix("file://")
    other, before = Scratch(spark), set(os.listdir(at))
    table = other.keep(spark.range(10).toDF("x"))
    meanwhile = []
    with ThreadPoolExecutor(1) as pool, Scratch.within(spark) as inner:
        meanwhile.append(pool.submit(lambda: Scratch(spark).keep(spark.range(7).toDF("x"))).result())
        own = Scratch(spark)
        assert inner == [own.root]
    assert not os.path.exists(own.root.removeprefix("file://")) and meanwhile[0].count() == 7
    between = set(os.listdir(at))
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 100 and set(out.columns) >= {"doc_id", "ids", "sequence_id", "offset"}
    assert not any(t.name.startswith("glyphstream") for t in spark.catalog.listTables())
    assert len({n for n in set(os.listdir(at)) - between if n.startswith("scratch-")}) <= 2  # run()'s own, and the last stage's, which the result reads
    assert table.count() == 10 and meanwhile[0].count() == 7 and before <= set(os.listdir(at))


def test_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
