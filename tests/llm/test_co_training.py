"""What each view hands over, and how views are combined, against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphstream.llm import quality

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["river", "stone", "BUY", "!!", "x9"], 1 + i % 30)), f"s{i % 3}", ("en", "fr", None)[i % 3], i % 50) for i in range(300)]
    rows += [rows[7], rows[7], (7, "another text", "s1", "en", 3), (None, "nobody's", "s1", "en", 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 300, 5)], "doc_id long, quality int")


def by_one(size, column, middle, slope):
    """A view by one feature: sure of what is far from a middle."""
    view = quality.Logistic()
    view.mean, view.scale, view.w = np.zeros(size), np.ones(size), np.zeros(size + 1)
    view.w[column], view.w[-1] = slope, -middle * slope
    return view


def test_each_view_gives_what_it_is_surest_of(spark, docs, labels, monkeypatch):
    """Selection over all unlabelled documents, twice, against a sort in memory: no document twice, none with a label, none below the bound, ties by hash."""
    views = [by_one(quality.PAIRS + 16, 1024, 0.4, 9.0), by_one(quality.META, 1, 0.5, 8.0)]
    calls = []

    def co_train(xs, y, pick, rounds):
        calls.append([len(y), *xs])
        for _ in range(2):
            calls.append(list(pick(views, 0.7)))

    monkeypatch.setattr(quality, "co_train", co_train)
    quality.fit(docs, labels, per_round=40, confident=0.6)
    rows = [tuple(r) for r in docs.collect()]
    hashed = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().collect()}
    known = {r.doc_id for r in labels.collect()}
    features = [[x[0] for x in quality._rows(quality.pa.RecordBatch.from_pydict(dict(zip([c.split()[0] for c in SCHEMA.split(", ")], [[v] for v in r]))))] for r in rows]
    assert calls[0][0] == len(known)  # a row a labelled id, however many rows it has
    taken, least = set(), math.log(0.6 / 0.4)
    for got in calls[1:]:
        for giver, (xs, given) in enumerate(got):
            chosen = {}
            for label, n, sign in ((1.0, 28, 1), (0.0, 12, -1)):
                logits = [(round(float(views[giver].logit(f[giver][None])[0]), 9) * sign, r[0]) for r, f in zip(rows, features) if r[0] is not None and r[0] not in known]
                order = [i for v, i in sorted(logits, key=lambda x: (-x[0], hashed[x[1]], x[1])) if v >= least]
                own = [i for i in dict.fromkeys(order) if i not in taken and i not in chosen][:n]
                chosen |= dict.fromkeys(own, label)
            taken |= set(chosen)
            assert sorted(given.tolist()) == sorted(chosen.values()) and len(given) > 0
            best = {i: min((f[0].tobytes(), f[1].tobytes()) for r, f in zip(rows, features) if r[0] == i) for i in chosen}
            assert sorted((c.tobytes(), m.tobytes(), t) for c, m, t in zip(*xs, given)) == sorted((*best[i], t) for i, t in chosen.items())


def test_a_view_that_knows_nothing_is_not_sure():
    """Sureness is judged on held-out rows: a view of noise, however large its logits, is calibrated down and given no say."""
    rng = np.random.default_rng(2)
    y = (rng.random(400) < 0.8).astype(float)
    good = np.c_[y * 2 - 1 + rng.normal(0, 0.3, 400), rng.normal(0, 1, 400)].astype(np.float32)
    noise = rng.normal(0, 1, (400, 60)).astype(np.float32)
    fresh = [np.c_[np.linspace(-2, 2, 200), np.zeros(200)].astype(np.float32), rng.normal(0, 1, (200, 60)).astype(np.float32)]
    seen = []

    def pick(views, share):
        seen.append([np.abs(v.logit(x)).max() for v, x in zip(views, fresh)])
        none = [x[:0] for x in fresh], np.zeros(0)
        return [([x[:5] for x in fresh], np.zeros(5)), none]

    m = quality.co_train([good, noise], y, pick, rounds=2)
    assert all(a > 3 for a, _ in seen) and all(b < math.log(0.95 / 0.05) for _, b in seen) and m.given == [(0, 5), (0, 0)] * 2


def test_scores_are_the_plain_combination(spark, docs, labels):
    model = quality.fit(docs, labels, rounds=1, per_round=20)
    got = {(r.doc_id, r.p_content, r.p_metadata, r.score) for r in quality.score(docs, model).collect()}
    want = set()
    for r in docs.collect():
        xs = quality._rows(quality.pa.RecordBatch.from_pydict(dict(zip([c.split()[0] for c in SCHEMA.split(", ")], [[v] for v in r]))))
        z = []
        for view, (a, b), x in zip(model.views, model.calibration, xs):
            raw = sum(min(8.0, max(-8.0, (float(v) - float(m)) / float(s))) * float(w) for v, m, s, w in zip(x[0], view.mean, view.scale, view.w)) + float(view.w[-1])
            z.append(a * max(-30.0, min(30.0, raw)) + b)
        z.append(z[0] * model.combined[0] + z[1] * model.combined[1] + model.combined[2])
        want.add((r.doc_id, *(1 / (1 + math.exp(-v)) for v in z)))
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=lambda x: (x[0] or -1, x[3])), sorted(want, key=lambda x: (x[0] or -1, x[3]))):
        assert a[0] == b[0] and max(abs(x - y) for x, y in zip(a[1:], b[1:])) < 1e-4
