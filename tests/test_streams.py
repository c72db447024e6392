import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glyphstream import api
from glyphstream.functions import rle, tracks
from glyphstream.operators import recognise
from glyphstream.plans import streams as plan_streams
from glyphstream.sources import files, pgs

START = bytes.fromhex(
    "504700015f900000000016000b0780043810000080000001504700015f900000000017000a01000064038400020002"
    "504700015f900000000014000c000001eb8080ff02108080ff504700015f9000000000150015000000c000000e0002"
    "000201000100000082010000504700015f9000000000800000"
)
CLEAR = bytes.fromhex("504700041eb00000000016000b0780043810000100000000504700041eb00000000017000a01000064038400020002504700041eb000000000800000")
LUMA = np.zeros(256, np.uint8)
LUMA[1], LUMA[2] = 235, 16


@pytest.mark.parametrize("code,runs", [("07", (1, 7)), ("0005", (5, 0)), ("004105", (261, 0)), ("008403", (4, 3)), ("00c10503", (261, 3)), ("0041", (256, 0))])
def test_runs(code, runs):
    assert [x[0] for x in rle.runs(bytes.fromhex(code))] == list(runs)


@pytest.mark.parametrize(
    "code,pixels",
    [("01000100000082010000", [[0, 255], [0, 0]]), ("0082010000008202", [[0, 0], [255, 255]]), ("010101000001", [[0, 0, 0], [0, 255, 255]]), ("01010101", [[0], [0], [0], [0]]), ("000001010000", [[0, 0]]), ("010000010000", [[0, 0]])],
)
def test_bitmap(code, pixels):
    assert rle.bitmap(bytes.fromhex(code), LUMA).tolist() == pixels


def test_bitmap_edges():
    assert rle.bitmap(b"", LUMA).shape == (0, 1)
    with pytest.raises(ValueError):
        rle.bitmap(b"\0\0", LUMA)


def test_stream_to_items(spark):
    cases = [("both", START + CLEAR), ("alone", START), ("junk", b"x" + START), ("tail", START + CLEAR + b"PG"), ("none", None)]
    d = spark.createDataFrame(cases, "track_id string, content binary")
    segs = pgs.segments(d)
    assert {r.track_id: r["count"] for r in segs.groupBy("track_id").count().collect()} == {"both": 8, "alone": 5, "tail": 8}
    got = pgs.decode(pgs.items(pgs.display_sets(segs))).orderBy("track_id").collect()
    assert [r.track_id for r in got] == ["both", "tail"]
    r = got[0]
    assert (r.start_ms, r.end_ms, r.x_offset, r.y_offset, r.height, r.width) == (1000, 3000, 100, 900, 2, 2)
    assert list(r.pixels) == [0, 255, 0, 0]


def test_layout():
    items = pd.DataFrame({"y": [900, 880, 50], "x": [100, 50, 80], "h": [40, 60, 50], "w": [300, 500, 400]})
    places, shape = recognise.layout(items, recognise.gaps([40, 60, 60]), 31744)
    assert places.values.tolist() == [[120, 100, 160, 400], [100, 515, 160, 1015], [205, 100, 255, 500]] and shape == (355, 1115)
    places, shape = recognise.layout(items, (45, 115), 620)
    assert places.values.tolist() == [[100, 100, 140, 400], [185, 100, 245, 600], [290, 100, 340, 500]] and shape == (440, 700)


def words(*rows):
    return pd.DataFrame([dict(level=lv, page_num=1, block_num=1, par_num=1, line_num=ln, word_num=k, left=10 * k, top=10, width=2, height=2, conf=c, text=t) for k, (lv, ln, c, t) in enumerate(rows)])


def test_accept():
    place = pd.DataFrame([[0, 0, 100, 100]])
    assert recognise.accept(words((5, 1, 90, "Hello"), (5, 1, 70, "world"), (5, 2, 80, "again")), place, 65) == ["Hello world\nagain"]
    assert recognise.accept(words((5, 1, 90, "Hello"), (5, 1, 40, "wrld")), place, 65) == [None]
    assert recognise.accept(words((5, 1, 40, "Hello"), (4, 1, 95, "Hello")), place, 65) == ["Hello"]
    assert recognise.accept(words((5, 1, "64.9", "a")), place, 65) == [None]
    assert recognise.accept(words((4, 1, 1, "a")), place, 65) == [""]


def test_rip(spark, tmp_path):
    (tmp_path / "a.en.sup").write_bytes(START + CLEAR)
    (tmp_path / "b.txt").write_text("x")
    found = api.scan_path(spark, [str(tmp_path), str(tmp_path / "gone")])
    assert files.report(found).collect()[0].asDict() == {"collected": 1, "filtered_out": 0, "discarded": 1}

    def recogniser(page, options):
        assert (page == 0).sum() == 3
        return pd.DataFrame([dict(level=5, page_num=1, block_num=1, par_num=1, line_num=1, word_num=1, left=101, top=101, width=0, height=0, conf=90, text="Hi!")])

    got = api.rip(spark, found, recogniser).collect()
    assert [r.srt for r in got] == ["1\n00:00:01,000 --> 00:00:03,000\nHi!\n"]


def test_paths_and_tracks(spark):
    d = spark.createDataFrame([("/a/x.eng.sup",), ("/a/x.pt-br.mkv",), ("/a/x.zzz.sup",), ("/a/x",)], "path string").select(files.path_parts(F.col("path")).alias("p"))
    got = d.select("p.*", files.render(F.col("p"), "srt").alias("srt")).collect()
    assert [(r.base_path, r.language, r.srt) for r in got] == [("/a/x", "en", "/a/x.en.srt"), ("/a/x", "pt-BR", "/a/x.pt-BR.srt"), ("/a/x.zzz", None, "/a/x.zzz.srt"), ("/a/x", None, "/a/x.srt")]
    j = '{"tracks": [{"id": 0, "type": "subtitles", "codec": "HDMV PGS", "properties": {"language": "por", "language_ietf": "pt-BR", "default_track": true, "enabled_track": true, "forced_track": true}}, {"id": 1, "type": "subtitles", "codec": "HDMV PGS", "properties": {"language": "eng"}}]}'
    t = tracks.parsed(spark.createDataFrame([("f", j)], "path string, json string"))
    assert [r[0] for r in t.select(tracks.sparse_json(F.col("track"))).collect()] == ['{"id":0,"type":"subtitles","codec":"HDMV PGS","language":"pt-BR","default":true}', '{"id":1,"type":"subtitles","codec":"HDMV PGS","language":"en","disabled":true}']
    assert [(r.track.id, r.number) for r in tracks.selected(t, "path").collect()] == [(0, 0)]


def test_every_language_of_iso_639_is_known(spark):
    codes = {"zh-hant": "zh-Hant", "sr_latn_rs": "sr-Latn-RS", "zh-hant-tw-x": None, "en-gb": "en-GB", "es-419": "es-419", "en-xx1": None, "nob": "nb", "nb": "nb", "nno": "nn", "fas": "fa", "per": "fa", "msa": "ms", "may": "ms", "ben": "bn", "tam": "ta", "tel": "te", "urd": "ur", "mkd": "mk", "mac": "mk", "sqi": "sq", "alb": "sq", "bos": "bs", "wel": "cy", "yue": "yue", "fil": "fil", "mul": "mul", "yue-hk": "yue-HK", "und": None, "qqq": None, "zzz": None, "xx": None}
    made = [(f"/a/x.{code}.sup", json.dumps({"tracks": [{"id": 0, "type": "subtitles", "codec": "HDMV PGS", "properties": {"language": code, "enabled_track": True}}]})) for code in codes]
    d = spark.createDataFrame(made, "path string, json string")
    assert {r.path: r.language for r in d.select("path", files.path_parts(F.col("path"))["language"].alias("language")).collect()} == {f"/a/x.{k}.sup": v for k, v in codes.items()}
    got = {r.path: r.track.language for r in tracks.selected(tracks.parsed(d), "path").collect()}
    assert got == {f"/a/x.{k}.sup": v for k, v in codes.items() if v}


PROPERTIES = ["language", "language_ietf", "track_name", "default_track", "enabled_track", "forced_track"]
PGS, TRACKS = "HDMV PGS", []
for kind, codec, ident, three, ietf, default in [
    ("subtitles", PGS, 0, "eng", "en", False), ("video", "HEVC/H.265/MPEG-H", 0, "eng", "en", False), ("audio", "TrueHD Atmos", 1, "eng", "en", True), ("audio", "AC-3 Dolby Surround EX", 2, "eng", "en", False), ("audio", "AC-3", 3, "ger", "de", False),
    ("audio", "DTS", 4, "por", "pt-BR", False), ("subtitles", PGS, 5, "eng", "en", False), ("subtitles", PGS, 6, "ger", "de", False), ("subtitles", PGS, 7, "por", "pt-BR", False),
]:
    TRACKS.append((kind, codec, ident, dict(zip(PROPERTIES, (three, ietf, None, default, True, False))), {"id": ident, "type": kind, "codec": codec, "language": ietf} | ({"default": True} if default else {})))


def test_tracks_of_a_disc(spark):
    made = [(k, json.dumps({"tracks": [{"id": ident, "type": kind, "codec": codec, "properties": {p: v for p, v in props.items() if v is not None} | {"uid": 6}}]})) for k, (kind, codec, ident, props, _) in enumerate(TRACKS)]
    d = tracks.parsed(spark.createDataFrame(made, "k int, json string"))
    got = {r.k: json.loads(r.track) for r in d.select("k", tracks.sparse_json(F.col("track")).alias("track")).collect()}
    assert got == {k: want for k, (*_, want) in enumerate(TRACKS)}


def test_names_of_tracks(spark):
    names = {"English (Forced)": ("en", "forced"), "Brazilian Portuguese": ("pt-BR", None), "Portuguese": ("pt-BR", None), "SDH": ("pt-BR", "hearing_impaired"), "French External v2.1": ("fr", "external"), "Director commentary": ("pt-BR", "commentary"), "CC": ("pt-BR", "closed_caption"), "Traditional Chinese": ("zh-Hant", None), "Descriptive": ("pt-BR", "descriptive")}
    made = [(n, json.dumps({"tracks": [{"id": 0, "type": "subtitles", "codec": PGS, "properties": {"language": "por", "language_ietf": "pt-BR", "track_name": n, "enabled_track": True}}]})) for n in names]
    got = {r.n: r.track for r in tracks.parsed(spark.createDataFrame(made, "n string, json string")).collect()}
    for n, (lang, flag) in names.items():
        assert got[n].language == lang and [k for k in tracks.NAMES if got[n][k]] == ([flag] if flag else [])
    assert got["French External v2.1"].version == "2.1" and got["CC"].version is None


def test_selection_numbers_and_first_of_a_language(spark):
    j = json.dumps({"tracks": [{"id": k, "type": "subtitles", "codec": PGS, "properties": {"language": lang, "enabled_track": on}} for k, (lang, on) in enumerate([("eng", False), ("eng", True), ("fre", True), ("eng", True), ("und", True)])]})
    t = tracks.parsed(spark.createDataFrame([("f", j)], "path string, json string"))
    chosen = lambda **kw: sorted((r.track.id, r.number) for r in tracks.selected(t, "path", files.ScanOptions(**kw)).collect())
    assert chosen() == [(1, 0), (2, 0)] and chosen(one_per_lang=False) == [(1, 0), (2, 0), (3, 1)] and chosen(languages=frozenset({"fr"})) == [(2, 0)]


def test_rules_by_tag_and_language(spark):
    from glyphstream.functions.srt import Rule, apply_rules, chosen

    rules = [("a", "1"), Rule("b", "2", languages=frozenset({"pt"})), Rule("c", "3", languages=frozenset({"pt-BR"})), Rule("d", "4", tags=frozenset({"x"}))]
    assert [r.pattern for r in chosen(rules)] == ["a", "b", "c"] and [r.pattern for r in chosen(rules, ["x"])] == ["d"]
    assert [r.pattern for r in chosen(rules, ["default", "x"], ["en"])] == ["a", "d"] and [r.pattern for r in chosen(rules, (), ["pt-PT"])] == ["a", "b"]
    d = spark.createDataFrame([("abcd", lang) for lang in ("pt", "pt-BR", "en", None)], "t string, lang string")
    assert [r[0] for r in d.select(apply_rules(F.col("t"), chosen(rules), F.col("lang"))).collect()] == ["12cd", "123d", "1bcd", "1bcd"]


def test_runs_of_any_bytes():
    """Against a walk byte by byte."""
    rng = np.random.default_rng(7)
    for n in [*range(8), 50, 400]:
        for _ in range(40):
            data = bytes(rng.choice([0, 0, 0, 1, 5, 0x40, 0x41, 0x80, 0x84, 0xC0, 0xC1, 255], n).astype(np.uint8))
            padded, at, want = data + bytes(3), 0, []
            while at < n:
                if padded[at]:
                    want.append((1, padded[at]))
                    at += 1
                    continue
                f, size, used = padded[at + 1], padded[at + 1] & 0x3F, 2
                if f & 0x40:
                    size, used = size << 8 | padded[at + 2], 3
                want.append((size, padded[at + used] if f & 0x80 else 0))
                at += used + (f >= 0x80)
            got = rle.runs(data)
            assert list(zip(got[0].tolist(), got[1].tolist())) == want
    lengths, colours = [1, 1, 63, 64, 300, 0, 5, 0], [7, 0, 2, 3, 0, 0, 9, 0]
    assert [x.tolist() for x in rle.runs(rle.encode(lengths, colours))] == [lengths, colours]


def test_inside_includes_edges_and_keeps_order():
    y, x = np.array([5, 0, 10, 5, 11, 5]), np.array([5, 0, 10, -1, 5, 5])
    places = pd.DataFrame([[0, 0, 10, 10], [5, 5, 5, 5], [20, 0, 30, 9]], columns=["y0", "x0", "y1", "x1"])
    at, of = recognise.inside(y, x, places)
    assert list(zip(at.tolist(), of.tolist())) == [(0, 0), (0, 1), (0, 2), (0, 5), (1, 0), (1, 5)]
    assert recognise.inside(y, x, places.iloc[:0])[0].tolist() == []


def _cascade(remaining):
    """Page widths, item counts and confidences of the passes when so many items are left after each."""
    n = remaining[0]
    items = pd.DataFrame({"item_id": range(n), "y": range(0, 2000 * n, 2000), "x": 0, "h": 2, "w": 40, "pixels": [b"\0" * 80] * n})
    seen, left = [], iter(remaining[1:])

    def words(sheet, options):
        keep = next(left, 0)
        places = recognise.layout(items.iloc[:keep], recognise.gaps([2]), 10**9) if keep else None
        seen.append(sheet.shape)
        rows = [dict(level=5, page_num=1, block_num=1, par_num=1, line_num=k, word_num=1, left=110, top=int(a), width=2, height=2, conf=1, text=f"w{k}") for k, a in enumerate(places[0]["y0"] if keep else [])]
        return pd.DataFrame(rows, columns=["level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text"])

    return recognise.cascade(items, words, recognise.OcrOptions()), seen


def test_cascade_goes_on_to_a_last_pass_that_takes_all():
    got, seen = _cascade([60, 45, 30, 10, 3])
    assert len(seen) == 4 and (got["passed"] == [4] * 10 + [3] * 20 + [2] * 15 + [1] * 15).all() and got["text"].notna().all()
    got, seen = _cascade([25, 0])
    assert len(seen) == 1 and (got["passed"] == 1).all()


def test_public_names():
    import glyphstream

    assert all(getattr(glyphstream, n) is not None for n in glyphstream.__all__) and files.ScanOptions().one_per_lang
    with pytest.raises(AttributeError):
        glyphstream.nothing


def python_stream(rows):
    """A user's events (ts, event_id, event_type) as bytes, set by set."""
    out = []
    for n, (_, event, kind) in enumerate(sorted(rows), 1):
        wide = 2 + event % 100
        image = rle.encode([wide, 0, wide, 0, wide, 0], [1, 0, 2, 0, 3, 0]) if event % 2 else None
        out.append(pgs.display_set(n * 90_000, 0x80 if kind == "signup" else 0, n % 65536, event % 1000, event % 700, image, plan_streams.LUMA, int(event % 5 != 0)))
    return b"".join(out)


def test_streams_of_events_are_made_without_python(spark):
    rows = [(k % 3, k * 7919 % 50, 1_000_000_007 * (k % 5) + k, ("signup", "click", "view")[k % 7 % 3]) for k in range(400)]
    d = spark.createDataFrame(rows, "user_id long, ts long, event_id long, event_type string")
    out = plan_streams.contents(d)
    assert {r.track_id: bytes(r.content) for r in out.collect()} == {str(u): python_stream([r[1:] for r in rows if r[0] == u]) for u in range(3)}
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString() and "Pandas" not in out._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="beyond the stream's time"):
        plan_streams.contents(spark.range(47_722).selectExpr("1L AS user_id", "id AS ts", "id AS event_id", "'view' AS event_type")).collect()


def test_display_sets_sort_segments_once(spark):
    segs = pgs.segments(spark.createDataFrame([("a", bytearray(START + CLEAR + START[:-13])), ("b", bytearray(CLEAR + b"PG" + bytes(11)))], "track_id string, content binary"))
    out = pgs.display_sets(segs)
    got = sorted((r.track_id, r.seq, r.ds_index, r.stype_name) for r in out.collect())
    assert got == [("a", k, int(k > 4), n) for k, n in enumerate(["PCS", "WDS", "PDS", "ODS", "END", "PCS", "WDS", "END"])] + [("b", 0, 0, "PCS"), ("b", 1, 0, "WDS"), ("b", 2, 0, "END"), ("b", 3, 1, None)]
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Sort [") == 1 and plan.count("Exchange ") == 1


def test_tasks_grow_with_the_events(spark, monkeypatch):
    d = spark.range(400).selectExpr("id % 40 AS user_id", "id AS ts", "id AS event_id", "'signup' AS event_type")
    few = sorted(map(str, plan_streams.decoded(d).collect()))
    monkeypatch.setattr(plan_streams, "TASK_EVENTS", 25)
    many = plan_streams.decoded(d)
    assert many.rdd.getNumPartitions() == 16 and sorted(map(str, many.collect())) == few
