"""SentencePiece encoding against the library's own, whole texts at once."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from glyphstream.llm import pieces

TEXTS = ["", " ", "a", "  hello  world ▁▁ x", "naïve 漢字 😀\n\n\tfoo\r\n bar", "\n", "ＫＡＤＯＫＡＷＡ　ABC ㍿  é é", " x " * 10, "x" * 3000, "\0a\0", "<s>hi</s><unk>", "▁", "a▁b ▁ c", "  "]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    return TEXTS + ["".join(rng.choice("ab  \n\t▁é漢😀ﬁ㍿　①") for _ in range(rng.randrange(60))) for _ in range(200)]


def models():
    """The model as it is (no character map), and with the compiled map of NFKC under each choice of white space."""
    import public_tokenizers
    from sentencepiece import SentencePieceNormalizer, sentencepiece_model_pb2 as pb

    with open(public_tokenizers.path(pieces.MODEL), "rb") as file:
        own = file.read()
    yield own
    spec = pb.NormalizerSpec.FromString(SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_normalizer_spec())
    for squeeze in (True, False):
        for prefix in (True, False):
            m = pb.ModelProto.FromString(own)
            m.normalizer_spec.CopyFrom(spec)
            m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.escape_whitespaces = squeeze, prefix, True
            yield m.SerializeToString()


@pytest.mark.parametrize("part", [7, 1 << 18])
def test_ids_spans_and_text_are_the_librarys(texts, monkeypatch, part):
    monkeypatch.setattr(pieces, "PART", part)
    for m in map(pieces.Model, models()):
        for text in texts:
            got = list(m.pieces(text.encode()))
            want = m.whole.encode(text, return_type="proto").pieces
            assert [k for ids, _, _ in got for k in ids] == [p.id for p in want], text
            assert [(b, e) for _, begin, end in got for b, e in zip(begin, end)] == [(p.begin, p.end) for p in want], text
            assert "".join(m.decoded(ids, not k) for k, (ids, _, _) in enumerate(got)) == m.whole.decode([p.id for p in want])


def test_normalised_text_and_offsets_are_the_librarys(texts):
    from sentencepiece import SentencePieceNormalizer

    lib = SentencePieceNormalizer(rule_name="nmt_nfkc")
    m = next(x for k, x in enumerate(map(pieces.Model, models())) if k == 1)
    for text in texts:
        if text.strip(" 　▁\t\n"):
            data, align = zip(*[(d, a) for d, a, _ in m.normalised(text.encode())])
            plain = lib.normalize(text)
            assert b"".join(data).decode().rstrip("▁") == plain.rstrip("▁") and len(align[0]) == len(data[0]) + 1


def test_rows(spark, monkeypatch):
    """Null, empty, repeated and long texts, clashing columns; the query's columns against the library's."""
    monkeypatch.setattr(pieces, "PART", 1 << 18)
    rows = [(1, None, "x"), (1, "", "x"), (None, "one two", "y"), (2, "one two", "y"), (2, "one two", None), (3, "wörd 漢 " * 60_000, "z"), (4, "x" * 100_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(3)
    m = pieces.model()
    want = []
    for doc, text, _ in rows:
        p = m.whole.encode(text or "", return_type="proto").pieces
        ids = [x.id for x in p]
        spans = np.array([(x.begin, x.end) for x in p], "<i8").tobytes()
        want.append((doc or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(m.whole.decode(ids).encode()).hexdigest(), zlib.crc32(spans)))
    assert sorted((r.doc_id or 0, *r[1:]) for r in pieces.digests(docs).collect()) == sorted(want)
    parts = {}
    for r in sorted(pieces.encoded(docs).where("doc_id in (1, 3)").collect(), key=lambda r: r.part):
        assert len(r.ids) == len(r.begins) == len(r.ends)
        parts.setdefault((r.doc_id, r.n_bytes), []).extend(r.ids)
    assert parts[3, len(rows[5][1].encode())] == m.whole.encode(rows[5][1]) and parts[1, 0] == []
    assert pieces.digests(docs.limit(0)).count() == pieces.encoded(docs.limit(0)).count() == 0
