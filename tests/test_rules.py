"""Cleaning rules against Python's one-after-another fold, and the default ones on what they are for."""

import re

import pytest
from pyspark.sql import functions as F

from glyphstream.functions.srt import DEFAULT_RULES, Rule, apply_rules, chosen


def folded(text, rules, language):
    for r in rules:
        if not r.languages or language and (language in r.languages or language.split("-")[0] in r.languages):
            text = re.sub(r.pattern, re.sub(r"\$(\d)", r"\\\1", r.replacement), text)
    return text


def test_many_rules_with_languages(spark):
    """Each such rule reads the text twice; forty of them don't make the plan forty times double."""
    rules = [Rule(f"{a}{b}", b, languages=frozenset({("en", "fr", "pt-BR")[k % 3]})) for k, (a, b) in enumerate((x, y) for x in "abcdef" for y in "ghijklm")][:40] + [Rule("z+", "y"), Rule("y", "", languages=frozenset({"en"}))]
    texts = ["agbhcidjekfl zz", "ag" * 30, "", "fm zzz agh bgh"]
    d = spark.createDataFrame([(t, x) for t in texts for x in ("en", "en-US", "fr", "pt-BR", "pt", None)], "text string, lang string")
    for r in d.withColumn("got", apply_rules(F.col("text"), rules, F.col("lang"))).collect():
        assert r.got == folded(r.text, rules, r.lang)
    assert d.select(apply_rules(F.lit(None).cast("string"), rules, F.col("lang")).alias("x")).first().x is None


@pytest.mark.parametrize(
    "language, text, want",
    [
        ("en", "| don't know, |", "I don't know, I"),
        ("en-US", "she wi|l ca|l", "she will call"),
        ("de", "a | b", "a | b"),
        ("en", "“No” , he said .", '"No", he said.'),
        ("fr", "Quoi  ?", "Quoi ?"),
        ("en", "it’s ''so''", "it's \"so\""),
        ("en", "_ ~ *\nReal line\n\n\nnext  \n  end", "\nReal line\nnext\nend"),
        ("en", "...", "..."),
        ("en", "in 2O15 or 10O", "in 2015 or 100"),
        (None, "plain", "plain"),
        ("en", "a​b﻿", "ab"),
    ],
)
def test_default_rules(spark, language, text, want):
    d = spark.createDataFrame([(text, language)], "text string, lang string")
    assert d.select(apply_rules(F.col("text"), chosen(DEFAULT_RULES), F.col("lang")).alias("t")).first().t == want
