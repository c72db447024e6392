"""Secret scans of texts that are one very long token, or a million groups of one."""

from pyspark.sql import functions as F

from glyphstream.llm import secrets

N = 200_000
LONG = {
    "dashed": ("-".join(["abc"] * N), []),
    "dashed capitals": ("-".join(["AB"] * N), []),
    "broken dashes": ("-".join(["ab"] * (N // 2)) + "--" + "-".join(["ab"] * (N // 2)), []),
    "hex": ("0123456789abcdef" * (N // 4), [(0, 2, 4 * N)]),
    "access": ("AKIA" + "B7" * N, [(0, 1, 4 + 2 * N)]),
    "assign": ("token=" + "x.y-" * N, [(0, 0, 6 + 4 * N)]),
    "pads": ("z" * 30 + "=" * N, []),
    "pads after a name": ("token" + "=" * N, [(0, 0, 5 + N)]),
    "spaces": ("token" + " " * N + "=abcdefgh", [(0, 0, N + 14)]),
    "names": ("tokenpassword" * (N // 10), []),
    "letters": ("q" * N, []),
}


def _spans(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(len(texts))
    base = F.transform(F.filter("spans", lambda s: s["kind"] < 3), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    return {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.scan(d).select("doc_id", base.alias("spans")).collect()}


def test_long_tokens(spark):
    got = _spans(spark, [t for t, _ in LONG.values()])
    assert {name: got[k] for k, name in enumerate(LONG)} == {name: spans for name, (_, spans) in LONG.items()}


def test_a_million_groups(spark):
    assert _spans(spark, ["-".join(["abc"] * 1_000_000), "short"]) == {0: [], 1: []}


def test_long_tokens_are_redacted(spark):
    d = spark.createDataFrame([(1, "see " + "-".join(["abc"] * 200_000) + " and " + "deadbeef" * 100_000)], "doc_id long, text string")
    assert secrets.redact(d).select(F.length("text").alias("n")).first().n == 4 + 799_999 + 5 + 8
