"""The cascade over all tracks, page by page, against the one of a track in memory."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glyphstream.functions import rle
from glyphstream.operators import recognise
from glyphstream.sources import pgs
from glyphstream.sources.kept import Kept

LUMA = {1: 235, 2: 16}
COLUMNS = ["level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text"]


def _made():
    def recognise(sheet, options):
        """One word for each image: its colour run's length is its text and how sure that is. It looks at the page alone."""
        ink = sheet == 0
        edge = ink & ~np.pad(ink, ((0, 0), (1, 0)))[:, :-1] & ~np.pad(ink, ((1, 0), (0, 0)))[:-1]
        rows = []
        for k, (y, x) in enumerate(zip(*np.nonzero(edge))):
            run = int(np.argmin(np.append(ink[y, x:], False)))
            if options.language == "xx":
                raise RuntimeError("no such language")
            rows.append((5, 1, 1, 1, int(y), k, int(x), int(y), 0, 0, 40 + (run * 37) % 60, f"w{run % 23}"))
        return pd.DataFrame(rows, columns=COLUMNS)

    return recognise  # a nested function travels to the workers by value


recogniser = _made()


def items(n, track, language):
    """n coded images of one line with ink at its start, and some that can't be decoded or have no lines."""
    rows = []
    for k in range(n):
        long = 3 + (k * 7) % 61
        data = rle.encode([long, 2 + k % 5, 0], [2, 1, 0])
        error = "cut" if k % 50 == 49 else None
        rows.append((track, k, 1000 * k, 1000 * k + 500, (k * 13) % 90, (k * 29) % 700, b"" if k % 40 == 39 else data, None if k % 60 == 59 else bytes([0, 0]) + b"".join(bytes([e, v, 128, 128, 255]) for e, v in LUMA.items()), error, language))
    return rows


SCHEMA = "track_id string, item_id long, start_ms long, end_ms long, x_offset int, y_offset int, image_data binary, palette binary, error string, language string"


@pytest.fixture(scope="module")
def made(spark):
    rows = items(130, "a/b.en.sup", "en") + items(45, "c.sup#2", None) + items(30, "bad", "xx") + items(1, "one", "de")
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def sorted_rows(d):
    return sorted((tuple(r) for r in d.collect()), key=repr)


@pytest.mark.parametrize("page_items", [1000, 16])
def test_pages_give_what_tracks_give(spark, made, page_items):
    options = recognise.OcrOptions(page_items=page_items)
    want = sorted_rows(recognise.by_track(made, recogniser, options))
    got = recognise.by_pages(made, recogniser, options, Kept(spark))
    assert got.columns == [c.split()[0] for c in recognise.SUBTITLES.split(", ")]
    assert sorted_rows(got) == want
    passes = {r[5] for r in want}
    assert len(passes) > 2 and {r[6] for r in want} >= {None, "cut", "an image without a palette", "RuntimeError: no such language"}


def test_large_tracks_go_by_pages(spark, made, monkeypatch):
    """Only tracks larger than a page go through the loop, and the result doesn't tell which way a track went."""
    seen = []
    inner = recognise.by_pages
    monkeypatch.setattr(recognise, "by_pages", lambda d, *more: seen.append(sorted(r[0] for r in d.select("track_id").distinct().collect())) or inner(d, *more))
    options = recognise.OcrOptions(page_items=100)
    assert sorted_rows(recognise.recognised(made, recogniser, options)) == sorted_rows(recognise.by_track(made, recogniser, options))
    assert seen == [["a/b.en.sup"]]
    recognise.recognised(made, recogniser, recognise.OcrOptions(page_items=5000))
    assert len(seen) == 1


def test_pages_of_one_track_run_in_several_tasks(spark, tmp_path):
    from pyspark import TaskContext

    def noting(sheet, options):
        (tmp_path / f"{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}").touch()
        return recogniser(sheet, options)

    d = spark.createDataFrame(items(5000, "long", "en"), SCHEMA).repartition(4)
    got = recognise.recognised(d, noting, recognise.OcrOptions(page_items=500, confidence=1))
    assert got.where("text IS NOT NULL").count() == sum(k % 50 != 49 and k % 40 != 39 and k % 60 != 59 for k in range(5000))
    assert len({p.name.split("-")[0] for p in tmp_path.iterdir()}) >= 4


def test_no_tracks(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert recognise.by_pages(d, recogniser, recognise.OcrOptions(), Kept(spark)).count() == recognise.recognised(d, recogniser).count() == 0
    assert pgs.decode(d, pixels=False).columns == [*[c.split()[0] for c in SCHEMA.split(", ") if not c.startswith("error")], "height", "width", "error"]
    assert d.select(F.count("*")).first()[0] == 0


def test_each_image_is_decoded_once(spark, made):
    """Same rows as decoding each item's; as many images as there are different ones, null and empty data apart, whatever splits into them."""
    twice = made.unionByName(made.withColumn("track_id", F.concat(F.lit("again "), "track_id")))
    extra = spark.createDataFrame([("x", k, 0, 1, 0, 0, a, b, None, None) for k, (a, b) in enumerate([(b"\1", b"\0\0"), (b"\1\0", b"\0"), (None, None), (b"", None), (b"", b""), (None, b"")])], SCHEMA)
    d = twice.unionByName(extra)
    good = [(r.image_data, r.palette) for r in d.where("error IS NULL").collect()]
    assert pgs.distinct_images(d).count() == len(set(good)) < len(good) / 2
    for pixels in (True, False):
        one, each = pgs.decode_once(d, pixels), pgs.decode(d, pixels)
        assert one.columns == each.columns and sorted_rows(one) == sorted_rows(each)
