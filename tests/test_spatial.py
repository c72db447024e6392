"""Points in rectangles and acceptance of words as joins, against all pairs and against the operator on one page in memory."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glyphstream.operators import recognise, spatial


def pairs(points, places):
    return sorted((p[0], q[1], p[3]) for p in points for q in places if p[0] == q[0] and None not in (*p[:3], *q[2:]) and q[2] <= p[1] <= q[4] and q[3] <= p[2] <= q[5])


def drawn(seed, pages, n, m, hot=False):
    """Points (page, y, x, id) and places (page, place, y0, x0, y1, x1): sizes from 0 to thousands, edges on points, empty and inverted places, nulls."""
    rng = np.random.default_rng(seed)
    points = [(int(rng.integers(pages)), int(rng.integers(-50, 400)), int(rng.integers(-50, 400)), k) for k in range(n)]
    if hot:
        points += [(0, 64, 64, n + k) for k in range(n)]
    places = []
    for k in range(m):
        y, x, h, w = int(rng.integers(-60, 400)), int(rng.integers(-60, 400)), int(rng.choice([0, 1, 3, 15, 16, 64, 1000])), int(rng.choice([0, 2, 4, 255, 5000]))
        places.append((int(rng.integers(pages)), k, y, x, y + h, x + w))
    places += [] if hot else [(0, m, 64, 64, 64, 64), (0, m + 1, 64, 64, 63, 64), (0, m + 2, None, 0, 9, 9), (0, m + 3, -(1 << 40), 0, 1 << 40, 10)]
    return points + [(0, None, 3, -1), (None, 3, 3, -2)], places


def rows(spark, points, places):
    return spark.createDataFrame(points, "page int, y int, x int, id int"), spark.createDataFrame(places, "page int, place long, y0 long, x0 long, y1 long, x1 long")


@pytest.mark.parametrize("pages, n, m", [(1, 400, 60), (7, 600, 90), (3, 0, 5), (2, 50, 0)])
def test_contained(spark, pages, n, m):
    points, places = drawn(pages + n, pages, n, m)
    got = spatial.contained(*rows(spark, points, places), "page")
    assert got.columns == ["page", "y", "x", "id", "place", "y0", "x0", "y1", "x1"]
    assert sorted((r.page, r.place, r.id) for r in got.collect()) == pairs(points, places)


def test_places_go_to_four_cells_at_most_and_fractions_count(spark):
    d = spark.createDataFrame([(0, 0, a, b, a + h, b + w) for a in (-7.5, 0.0, 3.99, 63.9) for b in (0.0, 15.5) for h in (0.0, 0.5, 4.0, 15.0, 16.0, 1e12) for w in (0.25, 63.0)], "page int, place int, y0 double, x0 double, y1 double, x1 double")
    d = d.withColumn("place", F.monotonically_increasing_id())
    level = {k: spatial._level(F.col(f"{k}1") - F.col(f"{k}0")) for k in "yx"}
    cells = [spatial._cell(F.col(f"{k}1"), level[k]) - spatial._cell(F.col(f"{k}0"), level[k]) for k in "yx"]
    assert max(d.select(F.max(cells[0]), F.max(cells[1])).first()) == 1
    points = spark.createDataFrame([(0, y, x, 1) for y in (-7.5, -7.4, 0.0, 3.99, 4.49, 4.5, 19.0, 1e11) for x in (0.0, 0.25, 0.26, 15.5, 63.0)], "page int, y double, x double, id int")
    want = sum(r.y0 <= p.y <= r.y1 and r.x0 <= p.x <= r.x1 for r in d.collect() for p in points.collect())
    assert spatial.contained(points, d, "page").count() == want


def test_a_hot_cell_is_split(spark):
    """With places too many to broadcast, adaptive execution deals a cell that half of all points lie in to several tasks."""
    points, places = drawn(5, 3, 30_000, 0, hot=True)
    places += [(k % 3, k, 3 * k, 5 * k, 3 * k + 15, 5 * k + 15) for k in range(40)]
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionFactor")}
    for k, v in zip(was, ("-1", "8k", "8k", "1.1")):
        spark.conf.set(k, v)
    try:
        got = spatial.contained(*rows(spark, points, places), "page")
        found = sorted((r.page, r.place, r.id) for r in got.collect())
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan and "Python" not in plan
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    by_page = {}
    for q in places:
        by_page.setdefault(q[0], []).append(q)
    assert found == sorted((p[0], q[1], p[3]) for p in points if None not in p for q in by_page.get(p[0], ()) if None not in q and q[2] <= p[1] <= q[4] and q[3] <= p[2] <= q[5])


@pytest.mark.parametrize("confidence", [0, 40, 90])
def test_accepted_is_accept_on_each_page(spark, confidence):
    rng = np.random.default_rng(confidence)
    words, places = [], []
    for page in range(5):
        for k in range(120 if page else 0):
            line = int(rng.integers(12))
            words.append((f"p{page}", int(rng.choice([5, 5, 5, 4])), 1, int(rng.integers(2)), 1, line, k, int(rng.integers(300)), line * 20, 7, 11, str(float(rng.integers(-1, 100))), str(rng.choice(["a", "b", " c", "d　", "", "e f", "é"]))))
        for k in range(9):
            y, x = int(rng.integers(0, 220)), int(rng.integers(0, 250))
            places.append((f"p{page}", k, y, x, y + int(rng.integers(0, 60)), x + int(rng.integers(0, 200))))
    columns = ["page", "level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text"]
    w = spark.createDataFrame(words, ", ".join(f"{c} {'string' if c in ('page', 'conf', 'text') else 'long'}" for c in columns)).repartition(3)
    p = spark.createDataFrame(places, "page string, place long, y0 long, x0 long, y1 long, x1 long").repartition(2)
    out = recognise.accepted(w, p, "page", confidence)
    got = {(r.page, r.place): r.text for r in out.collect()}
    frame, boxes = pd.DataFrame(words, columns=columns), pd.DataFrame(places, columns=["page", "place", "y0", "x0", "y1", "x1"])
    want = {}
    for page, own in boxes.groupby("page"):
        texts = recognise.accept(frame[frame["page"] == page], own[["y0", "x0", "y1", "x1"]].reset_index(drop=True), confidence)
        want |= {(page, k): t for k, t in zip(own["place"], texts)}
    assert got == want and len(got) == 45
    if confidence == 90:
        assert None in want.values() and any(want.values())
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString() and "Pandas" not in out._jdf.queryExecution().executedPlan().toString()


def drawn_words(spark, pages, n):
    words = [(q, 5, 1, 1, 1, k // 8, k, k % 8 * 10, k // 8 * 20, 1, 1, float((q * 31 + k * 7) % 100), f"w{(q + k) % 53}") for q in range(pages) for k in range(n * (1 + 9 * (q == 0)))]
    places = [(q, k, k * 100, 0, k * 100 + 99, 100) for q in range(pages) for k in range(n // 8)] + [(0, 9999, 9, 9, 0, 0), (pages, 1, 0, 0, 9, 9), (None, 7, 0, 0, 9, 9)]
    columns = "page long, level int, page_num int, block_num int, par_num int, line_num long, word_num long, left long, top long, width int, height int, conf double, text string"
    return spark.createDataFrame([*words, (None, *words[0][1:])], columns), spark.createDataFrame(places, "page long, place long, y0 long, x0 long, y1 long, x1 long")


def exchanges(d):
    """Shuffles of d's final plan."""
    plan = d._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def test_whole_pages_are_shuffled_once(spark):
    w, p = drawn_words(spark, 6, 60)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = recognise.accepted(w, p, "page", 20)
        assert len(out.collect()) == p.count()
        assert exchanges(out) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_crowded_pages_give_what_whole_ones_give(spark, monkeypatch):
    w, p = drawn_words(spark, 6, 60)
    key = lambda d: sorted(map(tuple, d.collect()), key=str)
    want = key(recognise.accepted(w, p, "page", 20))
    assert len({t for *_, t in want}) > 3 and None in {t for *_, t in want}
    monkeypatch.setattr(recognise, "TASK_WORDS", 100)
    assert key(recognise.accepted(w, p, "page", 20)) == want
    for limit in (500, 1):
        monkeypatch.setattr(recognise, "PAGE_WORDS", limit)
        assert key(recognise.accepted(w, p, "page", 20)) == want
