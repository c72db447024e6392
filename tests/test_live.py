"""Items of streams as they are written, against those of the whole streams."""

import random
import time

import pytest
from pyspark.sql import Row
from test_streams import CLEAR, START

from glyphstream.sources import pgs
from glyphstream.streaming import live

COLUMNS = ["track_id", "item_id", "start_ms", "end_ms", "x_offset", "y_offset", "image_data", "palette", "error"]


def made(seed):
    """A stream of random display sets: open ends near and far, sets without window or image, odd states, broken ends."""
    rng, out, pts = random.Random(seed), [], 0
    for n in range(rng.randint(0, 25)):
        pts += rng.choice([0, 90, 9_000, 90_000, 2_000_000])
        state = rng.choice([0x80, 0x80, 0x40, 0, 0, 0x10 if rng.random() < 0.1 else 0])
        image = b"\1\1\0\0" * rng.randint(0, 3) if rng.random() < 0.7 else None
        out.append(pgs.display_set(pts, state, n, rng.randint(0, 999), rng.randint(0, 999), image, {1: 16}, rng.choice([0, 1, 1])))
        if rng.random() < 0.1:
            out.append(pgs.encoded(0x15, pts, bytes([0, 0, 0, rng.choice([0, 0x40, 0x80, 0xC0])]) + b"xyzxyzxyz"))
        if rng.random() < 0.1:
            out.append(pgs.encoded(0x80, pts, b""))
    whole = b"".join(out)
    return rng.choice([whole, whole, whole + b"PG", whole + b"no segment at all", whole + pgs.encoded(0x33, 1, b"x") + START, whole + pgs.encoded(0x80, 1, b"abcd")[:-2], whole[: len(whole) - 9]])


def cuts(data, rng):
    at = sorted({0, *(rng.randrange(len(data) + 1) for _ in range(rng.randint(0, 30)))})
    return [(a, data[a:b]) for a, b in zip(at, [*at[1:], len(data)])]


def plain(rows):
    return sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in rows), key=repr)


def expected(spark, tracks):
    d = spark.createDataFrame(list(tracks.items()), "track_id string, content binary")
    return plain(pgs.items(pgs.display_sets(pgs.segments(d))).select(*COLUMNS).collect())


def test_any_cut_gives_the_items_of_the_whole(spark):
    """The state after each cut is written out and read again, as between two batches."""
    tracks, got = {f"t{k}": made(k) for k in range(150)} | {"two": START + CLEAR, "empty": b""}, []
    for name, data in tracks.items():
        for turn in range(3):
            rng, track, rows = random.Random(f"{name}{turn}"), live.Assembly(), []
            for _, part in [(0, data[k : k + 1]) for k in range(len(data))] if turn == 2 and len(data) < 600 else cuts(data, rng):
                rows += track.read(part)
                track = live.Assembly.of(track.values())
            rows += track.read(b"", last=True)
            if turn:
                assert rows == first, name
            first = rows
        got += [(name, *r) for r in first]
    assert plain(got) == expected(spark, tracks) and len(got) > 300


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    return tmp_path_factory.mktemp("live")


def start(spark, at, idle_ms=None, **trigger):
    chunks = spark.readStream.schema(live.CHUNKS).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    return live.items(chunks, idle_ms).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(**trigger).start()


def rows(spark, at):
    return plain(spark.read.schema(live.ITEMS).parquet(f"{at}/out").select(*COLUMNS).collect())


def test_batches_in_any_order_and_a_restart(spark, folders):
    """Ranges out of turn and twice over several batches, with a restart between; then a track's end is told."""
    at, rng = folders / "order", random.Random(7)
    tracks = {f"t{k}": made(k + 500) for k in range(12)} | {"two": START + CLEAR}
    parts = [(t, a, c) for t, data in tracks.items() for a, c in cuts(data, rng)]
    parts += [(t, len(data), None) for t, data in tracks.items()] + rng.sample(parts, 10) + [(None, 0, b"x"), ("two", None, b"x")]
    rng.shuffle(parts)
    for part in (parts[::2], parts[1::2]):
        spark.createDataFrame(part, live.CHUNKS).coalesce(1).write.mode("append").parquet(f"{at}/in")
        q = start(spark, at, availableNow=True)
        assert q.awaitTermination(60)
    assert rows(spark, at) == expected(spark, tracks)


def test_idle_tracks_end(spark, folders):
    """After the idle time a track gives its last item; one whose bytes are awaited an error; later bytes another."""
    at = folders / "idle"
    data = START + CLEAR
    add = lambda *rows: spark.createDataFrame(rows, live.CHUNKS).coalesce(1).write.mode("append").parquet(f"{at}/in")
    add(("a", 0, data), ("gap", 0, data[:50]), ("gap", 60, data[60:]))
    q = start(spark, at, idle_ms=1, processingTime="1 second")

    def comes(wanted):
        until = time.time() + 60
        while q.isActive and time.time() < until and rows(spark, at) != wanted:
            time.sleep(1)
        assert rows(spark, at) == wanted

    try:
        done = [*expected(spark, {"a": data}), ("gap", 0, *[None] * 6, live.MISSING)]
        comes(plain(done))
        add(("a", len(data), START))
        comes(plain([*done, ("a", *[None] * 7, live.LATE)]))
    finally:
        q.stop()


def test_a_batch_of_a_track_reads_and_writes_its_state_once(monkeypatch):
    calls = []

    class Value:
        now = None

        def get(self):
            calls.append("get")
            return self.now

        def update(self, value):
            calls.append("update")
            self.now = value

    class Handle:
        def getValueState(self, *_):
            return Value()

    content = pgs.display_set(90_000, 0x80, 1, 5, 6, b"\x01\x00\x00", {1: 235}) + pgs.display_set(180_000, 0, 2, 5, 6)
    own = live.Assembler(None, False)
    own.init(Handle())
    chunk = lambda at, c: Row(track_id="a", at=at, content=c)
    assert not list(own.handleInputRows(("a",), [chunk(20, content[20:]), chunk(len(content), None)], None))
    assert calls == ["get", "update"]
    assert [r.end_ms for r in own.handleInputRows(("a",), [chunk(0, content[:20])], None)] == [2000]
    assert calls == ["get", "update"] * 2
    assert [r.error for r in own.handleInputRows(("a",), [chunk(len(content), b"x")], None)] == [live.LATE]
