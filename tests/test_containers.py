import argparse
import io
import zlib
from datetime import timedelta

import pandas as pd
import pytest
from test_streams import CLEAR, START

from glyphstream import __main__ as command
from glyphstream import api
from glyphstream.functions import ocr, tracks
from glyphstream.operators import subtitles
from glyphstream.sources import files, matroska, pgs
from glyphstream.streaming import ingest


def el(ident: int, body: bytes, unknown: bool = False) -> bytes:
    size = b"\x01" + b"\xff" * 7 if unknown else (len(body) | 1 << 56).to_bytes(8, "big")
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size + body


def num(ident: int, n: int) -> bytes:
    return el(ident, n.to_bytes(2, "big"))


def entry(number: int, kind: int, codec: str, language: bytes, *more: bytes) -> bytes:
    return el(matroska.TRACK_ENTRY, num(matroska.NUMBER, number) + num(matroska.TYPE, kind) + el(matroska.CODEC_ID, codec.encode()) + el(matroska.LANGUAGE_BCP47, language) + b"".join(more))


def frame(stream: bytes) -> bytes:
    return b"".join(bytes([kind]) + size.to_bytes(2, "big") + payload for _, kind, _, _, size, payload, _ in pgs.split(stream))


def container(unknown: bool = False, lacing: int = 0) -> bytes:
    packed = el(matroska.ENCODINGS, el(matroska.ENCODING, el(matroska.COMPRESSION, num(matroska.ALGORITHM, 0))))
    entries = entry(1, 1, "V_TEST", b"en") + entry(2, 17, matroska.PGS_CODEC, b"en") + entry(3, 17, matroska.PGS_CODEC, b"pt-BR", packed) + entry(4, 17, matroska.PGS_CODEC, b"en", num(matroska.ENABLED, 0))
    block = lambda n, at, data: bytes([0x80 | n]) + at.to_bytes(2, "big", signed=True) + bytes([lacing]) + data
    first = num(matroska.TIMESTAMP, 1500) + el(matroska.SIMPLE_BLOCK, block(1, 0, b"video")) + el(matroska.SIMPLE_BLOCK, block(2, -500, frame(START))) + el(matroska.BLOCK_GROUP, el(matroska.BLOCK, block(3, -500, zlib.compress(frame(START)))))
    second = num(matroska.TIMESTAMP, 3000) + el(matroska.SIMPLE_BLOCK, block(2, 0, frame(CLEAR))) + el(matroska.SIMPLE_BLOCK, block(3, 0, zlib.compress(frame(CLEAR))))
    info = el(matroska.INFO, el(matroska.TIMESTAMP_SCALE, (1_000_000).to_bytes(3, "big")))
    return el(0x1A45DFA3, b"\x42\x86\x81\x01") + el(matroska.SEGMENT, info + el(matroska.TRACKS, entries) + el(matroska.CLUSTER, first, unknown) + el(matroska.CLUSTER, second, unknown), unknown)


def without_decoding_times(stream: bytes) -> bytes:
    return b"".join(b"PG" + pts.to_bytes(4, "big") + bytes(4) + bytes([kind]) + size.to_bytes(2, "big") + payload for _, kind, pts, _, size, payload, _ in pgs.split(stream))


@pytest.mark.parametrize("unknown", [False, True])
def test_round_trip(unknown):
    got = matroska.streams(io.BytesIO(container(unknown)), {1, 2, 3})
    assert got == {1: without_decoding_times(START + CLEAR), 2: without_decoding_times(START + CLEAR), 3: b""}


def test_bad_containers():
    whole = container()
    for cut in range(0, len(whole), 7):
        try:
            matroska.streams(io.BytesIO(whole[:cut]), {1})
        except (ValueError, zlib.error):
            pass
    with pytest.raises(ValueError):
        matroska.streams(io.BytesIO(container(lacing=2)), {1})
    with pytest.raises(ValueError, match="no tracks"):
        matroska.entries(io.BytesIO(b"not a container"))


def test_laced_blocks():
    parts = [b"a" * 300, b"b" * 255, b"", b"d" * 7]
    xiph = bytes([3]) + b"\xff\x2d" + b"\xff\x00" + b"\x00" + b"".join(parts)
    # 300 in two bytes, then differences of -45 and -255, whose numbers are their values plus the bias of their width
    ebml = bytes([3]) + (0x4000 | 300).to_bytes(2, "big") + (0x4000 | -45 + 8191).to_bytes(2, "big") + (0x4000 | -255 + 8191).to_bytes(2, "big") + b"".join(parts)
    assert matroska.frames(xiph, matroska.XIPH) == parts and matroska.frames(ebml, matroska.EBML) == parts
    assert matroska.frames(bytes([2]) + b"aabbcc", matroska.FIXED) == [b"aa", b"bb", b"cc"] and matroska.frames(b"x", 0) == [b"x"]
    for data, how in ((b"", 2), (bytes([2]) + b"aabb", matroska.FIXED), (xiph[:200], matroska.XIPH), (ebml[:100], matroska.EBML), (bytes([1]), matroska.EBML)):
        with pytest.raises(ValueError):
            matroska.frames(data, how)


@pytest.mark.parametrize("lacing", [2, 4, 6])
def test_laced_stream(lacing):
    """A block of one laced frame, and the count of none before it, is read like a plain one."""
    data = bytes([0]) + frame(START)
    block = bytes([0x82]) + (0).to_bytes(2, "big") + bytes([lacing]) + data
    whole = el(matroska.SEGMENT, el(matroska.TRACKS, entry(2, 17, matroska.PGS_CODEC, b"en")) + el(matroska.CLUSTER, num(matroska.TIMESTAMP, 1000) + el(matroska.SIMPLE_BLOCK, block)))
    assert matroska.streams(io.BytesIO(whole), {0}) == {0: without_decoding_times(START)}


@pytest.fixture
def recogniser():
    def recognise(page, options):  # a nested function travels to the workers by value
        return pd.DataFrame([dict(level=5, page_num=1, block_num=1, par_num=1, line_num=1, word_num=1, left=101, top=101, width=0, height=0, conf=90, text=f"Hi {options.language}")])

    return recognise


def test_described(spark, tmp_path):
    (tmp_path / "m.mkv").write_bytes(container())
    (tmp_path / "bad.mkv").write_bytes(b"x")
    d = matroska.described(spark.createDataFrame([(str(tmp_path / n),) for n in ("m.mkv", "bad.mkv", "gone.mkv")], "path string"))
    assert sorted((r.path.split("/")[-1], r.error is None) for r in d.collect()) == [("bad.mkv", False), ("gone.mkv", False), ("m.mkv", True)]
    t = tracks.parsed(d.where("error IS NULL")).orderBy("track.id").collect()
    assert [(r.track.id, r.track.type, r.track.language, r.track.disabled) for r in t] == [(0, "video", "en", None), (1, "subtitles", "en", None), (2, "subtitles", "pt-BR", None), (3, "subtitles", "en", True)]


def test_rip_containers(spark, tmp_path, recogniser):
    (tmp_path / "m.mkv").write_bytes(container())
    (tmp_path / "a b.de.sup").write_bytes(START + CLEAR)
    scanned, options = api.scan_path(spark, [str(tmp_path)]), files.ScanOptions()
    text = "1\n00:00:01,000 --> 00:00:03,000\nHi {}\n"
    docs = api.rip(spark, scanned, recogniser)
    assert [r.error for r in subtitles.write_files(docs).collect()] == [None] * 3
    made = {p.name: p.read_text() for p in tmp_path.glob("*.srt")}
    assert made == {"m.en.srt": text.format("en"), "m.pt-BR.srt": text.format("pt-BR"), "a b.de.srt": text.format("de")}
    existing = files.made(spark, [str(tmp_path)])
    assert api.tracks(scanned, options, existing).count() == 0
    assert api.tracks(scanned, files.ScanOptions(overwrite=True), existing).count() == 3
    assert api.tracks(scanned, files.ScanOptions(overwrite=True, srt_age=timedelta(days=1)), existing).count() == 0


def test_scan_judges_containers_by_all_tracks(spark, tmp_path):
    (tmp_path / "m.mkv").write_bytes(container())
    (tmp_path / "x.de.sup").write_bytes(START)
    (tmp_path / "bad.mks").write_bytes(b"x")
    at = lambda *langs: {r.path.split("/")[-1]: (r.status, sorted(r.languages or [])) for r in api.scan_path(spark, [str(tmp_path), "/nowhere/at/all"], files.ScanOptions(languages=frozenset(langs))).collect()}
    assert at() == {"m.mkv": ("collected", ["en", "pt-BR"]), "x.de.sup": ("collected", ["de"]), "bad.mks": ("discarded", []), "all": ("discarded", [])}
    assert at("ja") == {"m.mkv": ("filtered_out", ["en", "pt-BR"]), "x.de.sup": ("filtered_out", ["de"]), "bad.mks": ("discarded", []), "all": ("discarded", [])}
    assert at("pt-BR", "de")["m.mkv"][0] == "collected"
    scanned = api.scan_path(spark, [str(tmp_path)], files.ScanOptions(age=timedelta(hours=1))).where("status = 'collected'")
    assert scanned.count() == 2 and scanned.where("age < INTERVAL 1 HOUR AND file_exists").count() == 2


def test_track_errors_reach_the_caller(spark, tmp_path, recogniser):
    """A stream with an unknown segment, one with a composition of no known state, one without images and one that the recogniser fails on."""
    (tmp_path / "good.en.sup").write_bytes(START + CLEAR)
    (tmp_path / "type.en.sup").write_bytes(START + CLEAR + pgs.encoded(0x33, 0, b"abc"))
    (tmp_path / "state.en.sup").write_bytes(START + CLEAR + pgs.display_set(400_000, 0x21, 1, 0, 0))
    (tmp_path / "none.en.sup").write_bytes(CLEAR)
    (tmp_path / "fail.fr.sup").write_bytes(START + CLEAR)

    def fails(page, options):
        if options.language == "fr":
            raise RuntimeError("out of ink")
        return recogniser(page, options)

    docs = api.rip(spark, api.scan_path(spark, [str(tmp_path)]), fails)
    got = {r.track_id.split("/")[-1].split(".")[0]: (r.srt is not None, r.error) for r in docs.collect()}
    assert got == {"good": (True, None), "type": (False, "unknown segment type 0x33"), "state": (False, "a composition of no known state"), "none": (False, "no subtitles in the track"), "fail": (False, "RuntimeError: out of ink")}
    done = {r.path.split("/")[-1]: (r.written, r.error is None) for r in subtitles.write_files(docs).collect()}
    assert done["good.en.srt"] == (True, True) and sum(w for w, _ in done.values()) == 1 and sum(ok for _, ok in done.values()) == 1
    again = subtitles.write_files(docs.where("error IS NULL"), overwrite=False).collect()
    assert [(r.written, r.error) for r in again] == [(False, None)]
    assert api.rip_pgs(spark, START + CLEAR, recogniser, "en") == "1\n00:00:01,000 --> 00:00:03,000\nHi en\n"
    with pytest.raises(ValueError, match="0x33"):
        api.rip_pgs(spark, START + CLEAR + pgs.encoded(0x33, 0, b""), recogniser)


def test_rejected_items_have_reasons(spark):
    late = pgs.display_set(9_000_000, 0x80, 1, 5, 5, b"\1\1\0\0", {1: 235})
    nowhere = pgs.display_set(90_000, 0x80, 2, 5, 5, b"\1\1\0\0", {1: 235}, windows=0) + pgs.display_set(180_000, 0, 3, 5, 5, windows=0)
    d = spark.createDataFrame([("first", CLEAR + START + CLEAR), ("open", late), ("nowhere", nowhere)], "track_id string, content binary")
    sets = pgs.display_sets(pgs.segments(d))
    assert {(r.track_id, r.reason) for r in pgs.rejected(sets).collect()} == {("first", "no image"), ("open", "no end"), ("nowhere", "no place")}
    assert [r.track_id for r in pgs.items(sets).collect()] == ["first"]


def test_kept_pages_and_words(spark, tmp_path, recogniser):
    import zlib as z

    import numpy as np

    from glyphstream.operators.recognise import OcrOptions, png

    (tmp_path / "a.en.sup").write_bytes(START + CLEAR)
    api.rip(spark, api.scan_path(spark, [str(tmp_path)]), recogniser, OcrOptions(keep=str(tmp_path / "kept"))).collect()
    assert sorted(p.name for p in (tmp_path / "kept").rglob("*.*") if p.is_file()) == ["1-1-6-1-65.json", "1-1-6-1-65.png"]
    data = png(np.arange(6, dtype=np.uint8).reshape(2, 3))
    at = data.index(b"IDAT")
    assert z.decompress(data[at + 4 : -16]) == b"\0\0\1\2\0\3\4\5"


def test_command(spark, tmp_path, capsys, recogniser):
    (tmp_path / "m.mks").write_bytes(container())
    assert command.main(["-l", "pt-br", str(tmp_path), str(tmp_path / "gone")], recogniser, spark) == 0
    assert capsys.readouterr().out == "1 subtitle collected from 1 file / 1 path ignored\n1 subtitle ripped from 1 file, 0 failed\n"
    assert [p.name for p in tmp_path.glob("*.srt")] == ["m.pt-BR.srt"]
    assert command.main(["-l", "ja", "-vv", str(tmp_path)], recogniser, spark) == 0
    out = capsys.readouterr().out
    assert "0 subtitles collected from 0 files / 1 file filtered out" in out and "m.mks: filtered out" in out
    assert command.main([str(tmp_path)], recogniser, spark) == 0
    assert "1 subtitle ripped" in capsys.readouterr().out
    (tmp_path / "bad.mkv").write_bytes(b"x")
    (tmp_path / "half.en.sup").write_bytes(START + CLEAR + pgs.encoded(0x33, 0, b""))
    assert command.main([str(tmp_path)], recogniser, spark) == 1
    out = capsys.readouterr().out
    assert "bad.mkv: ValueError: no tracks element" in out and "half.en.srt: unknown segment type 0x33" in out and "0 subtitles ripped from 2 files, 1 failed" in out
    rules = tmp_path / "rules.json"
    rules.write_text('[["Hi", "Ho"], {"pattern": "Ho", "replacement": "Ha", "tags": ["loud"], "languages": ["pt"]}]')
    assert command.main(["-c", str(rules), "-t", "quiet", str(tmp_path)], recogniser, spark) == 0
    assert capsys.readouterr().out == "no rules for quiet\n"
    (tmp_path / "half.en.sup").unlink()
    (tmp_path / "bad.mkv").unlink()
    assert command.main(["-f", "-c", str(rules), "-t", "default", "-t", "loud", "--keep-temp-files", str(tmp_path / "kept"), str(tmp_path)], recogniser, spark) == 0
    assert "Ha pt-BR" in (tmp_path / "m.pt-BR.srt").read_text() and "Ho en" in (tmp_path / "m.en.srt").read_text()
    assert (tmp_path / "kept" / "display_sets").is_dir() and list((tmp_path / "kept").rglob("*.png"))
    assert command.age("1w2d3h") == timedelta(days=9, hours=3) and command.age("") is None and command.language("eng") == "en" and command.language("zh-hant-tw") == "zh-Hant-TW"
    for f, bad in ((command.age, "3x"), (command.language, "qqq"), (command.rules, str(tmp_path / "none.json")), (command.workers, "51")):
        with pytest.raises(argparse.ArgumentTypeError):
            f(bad)
    with pytest.raises(SystemExit):
        command.main(["--version"])


def test_watch(spark, tmp_path, recogniser):
    (tmp_path / "in").mkdir()
    run = lambda: ingest.watch(spark, str(tmp_path / "in"), recogniser, str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination()
    (tmp_path / "in" / "a.en.sup").write_bytes(START + CLEAR)
    run()
    (tmp_path / "in" / "b.fr.sup").write_bytes(START + CLEAR)
    run()
    assert sorted(p.name for p in (tmp_path / "in").glob("*.srt")) == ["a.en.srt", "b.fr.srt"]
    assert [(r.batch, r.error) for r in spark.read.parquet(str(tmp_path / "log")).orderBy("batch").collect()] == [(0, None), (1, None)]


def test_words_of_the_program():
    got = ocr.words("\t".join(ocr.COLUMNS) + "\n5\t1\t1\t1\t1\t1\t10\t20\t30\t8\t96.87\t\"Hi\n")
    assert got.iloc[0].tolist() == [5, 1, 1, 1, 1, 1, 10, 20, 30, 8, "96.87", '"Hi']
    assert (ocr.trained_name("de"), ocr.trained_name("pt-BR"), ocr.trained_name(None)) == ("deu", "por", None)
