"""Speculative splitting of long streams against the cursor that reads one from its start."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphstream.sources import longstreams, pgs


def stream(seed: int, n: int) -> bytes:
    """Segments whose payloads are full of false heads, some of them whole segments with lengths that lead astray."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        kind = int(rng.choice(list(pgs.TYPES)))
        false = pgs.encoded(int(rng.choice([0x14, 0x80, 0x33])), 7, bytes(rng.integers(0, 256, rng.integers(0, 30), dtype=np.uint8)))
        payload = b"PG" * int(rng.integers(0, 4)) + false * int(rng.integers(0, 3)) + bytes(rng.integers(0x47, 0x51, rng.integers(0, 20), dtype=np.uint8))
        out.append(pgs.encoded(kind, k, payload, k + 1))
    return b"".join(out)


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    at = tmp_path_factory.mktemp("streams")
    whole = stream(1, 120)
    data = {"whole": whole, "cut": whole[:-5], "tail": whole + b"PG\0\0", "junk": whole + b"xx" + whole, "type": whole + pgs.encoded(0x33, 1, b"PGPG") + whole, "none": b"junk" + whole, "empty": b"", "one": pgs.encoded(0x80, 1, b""), "long": pgs.encoded(0x15, 1, b"PG" * 32_000) + whole}
    for name, content in data.items():
        (at / f"{name}.sup").write_bytes(content)
    return at, data


@pytest.mark.parametrize("split", [64, 1000, 1 << 20])
def test_segments_are_the_cursors(spark, made, split):
    at, data = made
    files = spark.createDataFrame([(str(at / f"{n}.sup"),) for n in [*data, "gone"]], "path string")
    got = {}
    for r in longstreams.segments(files, split).collect():
        got.setdefault(r.track_id.split("/")[-1].removesuffix(".sup"), []).append(tuple(r)[1:])
    assert len(got.pop("gone")) == 1
    names = [c.split()[0] for c in pgs.SEGMENTS.split(", ")][1:]
    want = {}
    for r in pgs.segments(spark.createDataFrame(list(data.items()), "track_id string, content binary")).collect():
        want.setdefault(r.track_id, []).append(tuple(r)[1:])
    assert len(names) == 8 and {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert "none" not in got and len(got["type"]) == 121 and got["long"][0]


def test_guesses_follow_chains_within_a_range():
    data = stream(3, 40)
    heads = [x[0] for x in pgs.split(data)]
    for start in range(0, len(data), 97):
        end = min(start + 97, len(data))
        told = {e: (x, n) for e, x, n in longstreams.guesses(data[start : end + pgs.HEADER], start, end)}
        inside = [h for h in heads if start <= h < end]
        assert set(inside) <= set(told)
        for k, h in enumerate(inside):
            after = [x for x in heads if x >= end]
            assert told[h] == (after[0] if after else len(data), len(inside) - k)


def test_a_long_stream_is_read_by_many_tasks(spark, made):
    at, data = made
    files = spark.createDataFrame([(str(at / "whole.sup"),)], "path string")
    d = longstreams.segments(files, 256).withColumn("task", F.spark_partition_id())
    assert d.select("task").distinct().count() >= 4 and d.count() == 120
