"""The container source and the file sink, against whole-file reading and against what a failed job must leave: nothing."""

import io
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_containers import container, el, entry, num

from glyphstream.functions import tracks
from glyphstream.operators import subtitles
from glyphstream.plans import streams
from glyphstream.sources import containers, files, filewriter, matroska


def long_container(clusters: int, cues: str | None = None, unknown: bool = False) -> bytes:
    """A file of so many clusters, with cues (of every third cluster) that are right, wrong or absent."""
    two = lambda n: n.to_bytes(2, "big")
    tracks = el(matroska.TRACKS, entry(1, 1, "V_TEST", b"en") + entry(2, 17, matroska.PGS_CODEC, b"en") + entry(3, 17, matroska.PGS_CODEC, b"fr"))
    made = []
    for k in range(clusters):
        blocks = b"".join(el(matroska.SIMPLE_BLOCK, bytes([0x80 | 1 + (k + j) % 3]) + two(j) + b"\0" + b"\x80" + two(len(x := bytes([k, j]) * (3 + k % 5))) + x) for j in range(4))
        made.append(el(matroska.CLUSTER, num(matroska.TIMESTAMP, 10 * k) + blocks, unknown))
    seek = lambda at: el(matroska.SEEK_HEAD, el(matroska.SEEK, el(matroska.SEEK_ID, matroska.CUES.to_bytes(4, "big")) + el(matroska.SEEK_POSITION, at.to_bytes(8, "big")))) if cues else b""
    before = len(seek(0)) + len(tracks)
    at = [before + sum(map(len, made[:k])) for k in range(clusters)]
    table = b"".join(el(matroska.CUE_POINT, el(matroska.CUE_TRACK_POSITIONS, el(matroska.CUE_CLUSTER_POSITION, (p + (cues == "wrong")).to_bytes(8, "big")))) for p in at[::3])
    return el(matroska.SEGMENT, seek(before + sum(map(len, made))) + tracks + b"".join(made) + (el(matroska.CUES, table) if cues else b""))


@pytest.mark.parametrize("cues, unknown", [(None, False), (None, True), ("right", False), ("wrong", False)])
def test_parts_are_the_whole(spark, tmp_path, cues, unknown):
    """Any cut of a file gives the streams of one walk, and a file that is cut is read by several tasks."""
    data = long_container(50, cues, unknown)
    f = io.BytesIO(data)
    whole = matroska.streams(f, {1, 2})
    points, source = matroska.seek_points(f)
    assert source == ("cues" if cues == "right" else "walk") and len(points) == (17 if cues == "right" else 50)
    assert all(data[p : p + 4] == matroska.CLUSTER.to_bytes(4, "big") for p in points)
    for split in (1, 300, 1000, len(data), 10 * len(data)):
        pieces = [matroska.part(f, {1, 2}, a, b) for a, b in matroska.cuts(f, split)]
        assert {k: b"".join(p[k] for p in pieces) for k in whole} == whole
    (tmp_path / "long.mkv").write_bytes(data)
    (tmp_path / "short.mkv").write_bytes(container())
    (tmp_path / "bad.mkv").write_bytes(b"x" * 5000)
    asked = spark.createDataFrame([(str(tmp_path / n), k) for n in ("long.mkv", "bad.mkv") for k in (1, 2)] + [(str(tmp_path / "short.mkv"), 1), (str(tmp_path / "gone.mkv"), 1)], "path string, id int")
    got = {(r.path.split("/")[-1], r.id): (r.content, r.error) for r in containers.demuxed(asked, split=1000).collect()}
    assert got["long.mkv", 1] == (whole[1], None) and got["long.mkv", 2] == (whole[2], None)
    assert got["short.mkv", 1] == (matroska.streams(io.BytesIO(container()), {1})[1], None)
    assert all(got[k][0] is None and got[k][1] for k in (("bad.mkv", 1), ("bad.mkv", 2), ("gone.mkv", 1))) and len(got) == 6
    containers.register(spark)
    parts = spark.read.format("matroska").option("splitBytes", 700).load(str(tmp_path / "long.mkv")).where("id = 1")
    assert parts.select(F.spark_partition_id()).distinct().count() >= 4
    table = matroska.seek_table(asked.select("path").distinct()).where("error IS NULL")
    assert {r.source for r in table.where(F.col("path").contains("long")).collect()} == {source} and table.where(F.col("path").contains("long")).count() == len(points)
    assert [r.content for r in containers.joined(parts).collect()] == [whole[1]]


def test_many_files_use_all_tasks(spark, tmp_path):
    data = container()
    for k in range(1000):
        (tmp_path / f"{k % 7}").mkdir(exist_ok=True)
        (tmp_path / f"{k % 7}" / f"{k}.mkv").write_bytes(data)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    containers.register(spark)
    rows = spark.read.format("matroska").option("parts", 64).load(str(tmp_path)).where("id = 1")
    held = Counter(r[0] for r in rows.select(F.spark_partition_id()).collect())
    assert len(held) == 64 and sum(held.values()) == 1000 and max(held.values()) - min(held.values()) <= 1
    paths = rows.select("path").repartition(1)
    assert matroska.described(paths).select(F.spark_partition_id()).distinct().count() == 4 * spark.sparkContext.defaultParallelism


def test_larger_files_weigh_more(tmp_path):
    for k in range(12):
        (tmp_path / f"{k}.mkv").write_bytes(b"\0" * (1_000_000 if k == 3 else 10_000))
    works = containers.Reader({"path": str(tmp_path), "parts": "4"}).partitions()
    assert sorted(len(w.ranges) for w in works) == [1, 3, 4, 4]


PREDICATES = ["type = 'subtitles'", "language = 'en' AND is_enabled", "language IN ('fr', 'pt-BR')", "id > 1 AND codec LIKE 'HDMV%'", "language <> 'en'", "name IS NULL AND NOT is_default", "path LIKE '%m.mkv' AND id >= 1", "language NOT IN ('en')", "id = 1 OR language = 'pt-BR'", "error IS NOT NULL", "type <=> NULL", "codec LIKE '%PGS' AND content IS NOT NULL", "NOT (language = 'en')", "is_enabled = false", "id <= 2 AND id < 2"]


def test_filters_are_pushed_and_mean_the_same(spark, tmp_path, monkeypatch):
    (tmp_path / "m.mkv").write_bytes(container())
    (tmp_path / "n.mkv").write_bytes(long_container(3))
    (tmp_path / "bad.mkv").write_bytes(b"x")
    containers.register(spark)
    load = lambda: spark.read.format("matroska").load(str(tmp_path))
    key = lambda d: sorted(map(repr, d.collect()))
    pushed = {p: key(load().where(p)) for p in PREDICATES}
    plan = load().where("type = 'subtitles' AND language = 'fr' AND id IN (1, 2)")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(type,subtitles)" in plan.replace(" ", "") and "EqualTo(language,fr)" in plan.replace(" ", "") and "In(id" in plan.replace(" ", "")
    every = spark.createDataFrame(load().collect(), containers.COLUMNS)
    for p in PREDICATES:
        assert key(every.where(p)) == pushed[p], p
    plain = spark.read.format("matroska").option("content", "false").load(str(tmp_path))
    assert {(r.path.split("/")[-1], r.id, r.language) for r in plain.where("content IS NULL AND error IS NULL").collect()} >= {("m.mkv", 2, "pt-BR"), ("n.mkv", 2, "fr")}
    reader = containers.Reader({"path": str(tmp_path / "m.mkv")})
    from pyspark.sql.datasource import EqualTo

    assert list(reader.pushFilters([EqualTo(("language",), "pt-BR")])) == []
    seen = []
    monkeypatch.setattr(matroska, "part", lambda f, wanted, *more: seen.append(wanted) or {k: b"" for k in wanted})
    list(reader.read(reader.partitions()[0]))
    assert seen == [{2}]  # the other tracks' blocks aren't read


def test_tags_of_tracks(spark):
    """A tag's variants, extensions and private parts don't hide its language; the older code stands in for a tag that isn't one."""
    tracks_ = [("en-US-x-foo", "ger"), ("sl-rozaj-biske", "eng"), ("de-1996", None), ("zh-Hant-TW", None), ("xx-what", "fre"), (None, "por"), ("en-a-bbb-x-c", None), ("qqq", None), ("", "")]
    d = spark.createDataFrame([(k, *t) for k, t in enumerate(tracks_)], "id int, tag string, code string")
    p = F.struct(F.col("code").alias("language"), F.col("tag").alias("language_ietf"), F.lit(None).cast("string").alias("track_name"), *(F.lit(True).alias(c) for c in ("default_track", "enabled_track", "forced_track")))
    d = d.select("id", tracks.described(F.struct("id", F.lit("subtitles").alias("type"), F.lit("x").alias("codec"), p.alias("properties")))["language"].alias("language")).orderBy("id")
    want = ["en-US", "sl", "de", "zh-Hant-TW", "fr", "pt", "en", None, None]
    assert [r.language for r in d.collect()] == want == [files.tag(t) or files.tag(c) for t, c in tracks_]


def test_tracks_left_out_have_reasons(spark, tmp_path):
    (tmp_path / "m.mkv").write_bytes(el(matroska.SEGMENT, el(matroska.TRACKS, entry(1, 1, "V_TEST", b"en") + entry(2, 17, "S_TEXT/UTF8", b"en") + entry(3, 17, matroska.PGS_CODEC, b"en") + entry(4, 17, matroska.PGS_CODEC, b"fr") + entry(5, 17, matroska.PGS_CODEC, b"de", num(matroska.ENABLED, 0)) + entry(6, 17, matroska.PGS_CODEC, b"qqq", el(matroska.LANGUAGE, b"qqq")))))
    d = tracks.parsed(matroska.described(spark.createDataFrame([(str(tmp_path / "m.mkv"),)], "path string")))
    options = files.ScanOptions(languages=frozenset({"en"}))
    got = {r.track.id: r.reason for r in tracks.left_out(d, options).collect()}
    assert got == {0: "no subtitles", 1: "not graphic", 3: "another language", 4: "disabled", 5: "no known language"}
    assert [r.track.id for r in tracks.selected(d, "path", options).collect()] == [2] and 3 not in {r.track.id for r in tracks.left_out(d).collect()}


def test_many_folders_of_raw_streams(spark, tmp_path, monkeypatch):
    """Both ways to the raw streams' bytes give the same rows."""
    from glyphstream import api

    for k in range(5):
        (tmp_path / f"d{k} [x]").mkdir()
        (tmp_path / f"d{k} [x]" / "a.en.sup").write_bytes(bytes([k + 1]) * (k + 1))
    chosen = api.tracks(api.scan_path(spark, [str(tmp_path)]))
    read = lambda: sorted((r.track_id.split("/")[-2], bytes(r.content), r.error) for r in api.contents(spark, chosen).collect())
    first = read()
    monkeypatch.setattr(files, "MOST_FOLDERS", 2)
    assert read() == first == [(f"d{k} [x]", bytes([k + 1]) * (k + 1), None) for k in range(5)]


def test_made_containers_are_read_back(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "assistant", "é" * 70_000), (1, 65, "assistant", None), (2, 3, None, "x")]
    made = streams.conversation_containers(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "/f").collect()
    got = {r.path: matroska.streams(io.BytesIO(r.content), {0, 1}) for r in made}
    assert {p: [len(v) for v in s.values()] for p, s in got.items()} == {"/f/1/1-0.mkv": [13 + 2, 3 * 13 + 140_000], "/f/1/1-1.mkv": [0, 13], "/f/2/2-0.mkv": [13 + 1, 0]}


def all_files(root) -> list[str]:
    return sorted(os.path.relpath(os.path.join(d, n), root) for d, _, names in os.walk(root) for n in names)


def test_files_appear_together(spark, tmp_path):
    rows = [(str(tmp_path / f"{k % 3}" / f"{k}.srt"), f"text {k}".encode()) for k in range(40)]
    d = spark.createDataFrame(rows, filewriter.SCHEMA).repartition(5)
    filewriter.save(d)
    assert len(all_files(tmp_path)) == 40 and all(open(p, "rb").read() == c for p, c in rows)
    filewriter.save(d.withColumn("content", F.lit(b"new")).limit(40), keep=True)
    assert all(open(p, "rb").read() == c for p, c in rows)
    filewriter.save(d.where(F.col("path").endswith("7.srt")).withColumn("content", F.lit(None).cast("binary")))
    assert all(open(p, "rb").read() == (b"" if p.endswith("7.srt") else c) for p, c in rows) and len(all_files(tmp_path)) == 40
    subtitles.save_files(spark.createDataFrame([(str(tmp_path / "a.srt"), "é", None), (str(tmp_path / "b.srt"), None, "bad"), (str(tmp_path / "c.srt"), "x", "bad")], "srt_path string, srt string, error string"))
    assert (tmp_path / "a.srt").read_text() == "é" and not (tmp_path / "b.srt").exists() and not (tmp_path / "c.srt").exists()


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    """A task fails after others have staged their files, and after its own first ones."""
    (tmp_path / "0").mkdir()
    (tmp_path / "0" / "0.srt").write_bytes(b"before")
    rows = [(str(tmp_path / f"{k % 3}" / f"{k}.srt"), k) for k in range(60)]
    d = spark.createDataFrame(rows, "path string, k long").repartition(4)
    failing = d.selectExpr("path", "cast(if(k = 37, raise_error('no'), 'x') AS binary) AS content")
    with pytest.raises(Exception, match="no"):
        filewriter.save(failing)
    assert all_files(tmp_path) == ["0/0.srt"] and (tmp_path / "0" / "0.srt").read_bytes() == b"before"
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert not [n for n in os.listdir(shared) if n.startswith("files-")]


def test_names_of_lost_workers_and_drivers_are_swept(tmp_path):
    from pyspark.sql import Row

    options = {"journal": str(tmp_path / "shared")}
    (tmp_path / "shared").mkdir()
    rows = [Row(path=str(tmp_path / "out" / f"{k}.srt"), content=b"x") for k in range(5)]
    w = filewriter.Writer(options, False)
    w.write(iter(rows))  # a worker that was lost: its message never arrives
    assert len(all_files(tmp_path / "out")) == 5
    w.commit([w.write(iter(rows[:2])), None])
    assert all_files(tmp_path / "out") == ["0.srt", "1.srt"]
    w = filewriter.Writer(options, False)
    w.write(iter(rows))
    w.abort([None])
    assert all_files(tmp_path / "out") == ["0.srt", "1.srt"] and not os.listdir(tmp_path / "shared")
    with pytest.raises(ValueError):
        filewriter.Writer(options, True)
