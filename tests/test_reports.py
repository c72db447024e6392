"""Reports of display sets, their dump, and the geometry of pages."""

import json

import numpy as np
import pandas as pd
from test_streams import CLEAR, START

from glyphstream.operators import recognise
from glyphstream.sources import pgs


def test_report_and_dump_of_display_sets(spark):
    """Counts by type and validity of each set; the dump has every header field, and nothing that is null. A set without an end is in neither."""
    odd = pgs.encoded(0x16, 9, b"\0\1\0\1\x10\0\3\x80\0\0\0") * 2 + pgs.encoded(0x80, 9, b"")
    d = spark.createDataFrame([("t", START + CLEAR + odd + pgs.encoded(0x17, 10, b"\1"))], "track_id string, content binary")
    sets = pgs.display_sets(pgs.segments(d))
    got = [tuple(r)[1:] for r in pgs.display_set_report(sets).orderBy("ds_index").collect()]
    assert [r[-1] for r in got] == [True, True, False] and [sum(r[1:-1]) for r in got] == [5, 3, 3]
    names = [c for c in pgs.display_set_report(sets).columns if c.startswith("n_")]
    assert dict(zip(names, got[0][1:-1])) == {"n_pds": 1, "n_ods": 1, "n_pcs": 1, "n_wds": 1, "n_end": 1} and dict(zip(names, got[2][1:-1]))["n_pcs"] == 2
    rows = [json.loads(r.json) for r in pgs.sets_json(sets).orderBy("ds_index").collect()]
    assert [len(r) for r in rows] == [5, 3, 3]
    pcs, wds, pds, ods, end = rows[0]
    assert pcs["pts"] == 90_000 and pcs["stype_name"] == "PCS" and pcs["pcs"]["composition_state"] == "EPOCH_START" and (pcs["pcs"]["width"], pcs["pcs"]["height"]) == (1920, 1080) and "wds" not in pcs
    assert wds["wds"]["num_windows"] == 1 and (wds["wds"]["x_offset"], wds["wds"]["y_offset"]) == (100, 900) and pds["pds"]["palette_id"] == 0
    assert ods["ods"]["sequence_type"] == "FIRST_AND_LAST" and (ods["ods"]["width"], ods["ods"]["height"]) == (2, 2) and set(end) == {"seq", "stype_name", "pts", "dts", "size"}


def test_gaps_and_pages():
    """Gaps follow the tallest image; a page shows each image where its place says, on white, with a border around all."""
    assert recognise.gaps([2]) == (30, 100) and recognise.gaps([7, 41, 40]) == (40, 110)
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 200)), int(rng.integers(1, 30)), int(rng.integers(1, 300))) for _ in range(25)]
    items = pd.DataFrame([(y, h, w, bytes(rng.choice([0, 255], h * w).astype(np.uint8))) for y, h, w in rows], columns=["y", "h", "w", "pixels"])
    places, shape = recognise.layout(items, recognise.gaps(items["h"]), 700)
    sheet = recognise.page(items, places, shape)
    shown = np.zeros(shape, bool)
    for p, (y, h, w), pixels in zip(places.itertuples(index=False), rows, items["pixels"]):
        assert (p.y1 - p.y0, p.x1 - p.x0) == (h, w) and not shown[p.y0 : p.y1, p.x0 : p.x1].any()
        assert sheet[p.y0 : p.y1, p.x0 : p.x1].tobytes() == pixels
        shown[p.y0 : p.y1, p.x0 : p.x1] = True
    assert (sheet[~shown] == 255).all() and not shown[: recognise.BORDER].any() and not shown[:, : recognise.BORDER].any() and not shown[-recognise.BORDER :].any() and not shown[:, -recognise.BORDER :].any()
    half, other = recognise.shelves(items, 100, 700)[:2]
    some, _ = recognise.arranged(items, [half, other], (30, 100))
    assert (some.drop(index=[*half, *other]) == 0).all().all() and (some.loc[half, "y0"] >= recognise.BORDER).all()
