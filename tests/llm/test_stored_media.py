"""Telephony media and PCM as stored tables: what the query tells comes from the rows read back."""

import numpy as np
import pytest

from glyphstream.llm import _chunks, telephony
from glyphstream.llm._common import Scratch

ROWS = [(1, "hello " * 400, "m"), (2, None, "m"), (2, "", None), (None, "é漢" * 900, "m"), (3, "x" * 700_000, "m"), (4, "hello " * 400, "m")] + [(10 + k, f"text {k} " * k, "m") for k in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, media string").repartition(3)


def rows(df):
    return sorted((r[0] or 0, *r[1:]) for r in df.collect())


@pytest.mark.parametrize("slices", [1, 3])
def test_told_of_what_is_read_back(spark, docs, slices):
    got = telephony.digests(docs, Scratch(spark), slices)
    assert got.columns == [c.split()[0] for c in telephony.SCHEMA.split(", ")]
    assert rows(got) == rows(telephony.stored(docs, keep_media=False))
    assert telephony.digests(docs.limit(0), Scratch(spark), slices).count() == 0


def test_a_damaged_row_shows(spark, docs):
    """A flipped sample in the stored table changes what is told of its document and of no other; a file cut short is an error."""
    media = telephony.media_of(docs)

    def flipped(batches):
        for pdf in batches:
            pdf["media"] = [m[:-1] + bytes([m[-1] ^ 1]) if d == 3 else m for d, m in zip(pdf["doc_id"], pdf["media"])]
            yield pdf

    good, bad = (rows(telephony.heard(m).drop("pcm")) for m in (media, media.mapInPandas(flipped, media.schema)))
    assert [a for a, b in zip(good, bad) if a != b] == [r for r in good if r[0] == 3]
    short = spark.createDataFrame([(1, 5, telephony.wave(b"a" * telephony.UNIT, telephony.MULAW)[:-9])], "doc_id long, n_bytes long, media binary")
    with pytest.raises(Exception, match="ValueError"):
        telephony.heard(short).collect()


def test_pcm_is_the_stored_samples(docs):
    for r in telephony.heard(telephony.media_of(docs).where("doc_id < 3")).collect():
        text = next(t for d, t, _ in ROWS if d == r.doc_id)
        data = telephony.payload(text)[0]
        if r.doc_id == 1:
            assert bytes(r.pcm) == telephony.transcode(telephony.wave(data, telephony.kind_of(data))) and len(np.frombuffer(r.pcm, "<i2"))


def test_more_chunks_than_numbers_raise(spark, monkeypatch):
    monkeypatch.setattr(_chunks, "CHUNK_BITS", 1)
    d = spark.range(3).selectExpr("id AS doc_id", "'some words' AS text").coalesce(1)
    assert _chunks.pack_chunks(d, 100).count() == 1
    with pytest.raises(Exception, match="smaller partitions"):
        _chunks.pack_chunks(d, 1).collect()
