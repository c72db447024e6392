"""Subtitle text: time stamps, cleaning rules chosen by tag and language, and rendered blocks."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphstream.sources.files import bound

DEFAULT_TAG = "default"


@dataclass(frozen=True)
class Rule:
    """A regular expression and what takes its place; without languages it holds for all. A language holds for its regions too."""

    pattern: str
    replacement: str = ""
    tags: frozenset[str] = frozenset({DEFAULT_TAG})
    languages: frozenset[str] = frozenset()


#: What recognisers of bitmaps commonly get wrong, and what a subtitle doesn't need: used where no rules are given.
DEFAULT_RULES = [
    Rule(r"[\u00ad\u200b\u200e\u200f\ufeff]"),  # invisible characters
    Rule(r"[\u2018\u2019\u201b\u0060\u00b4]", "'"),
    Rule(r"(?:''|[\u201c\u201d\u201f])", '"'),
    Rule(r"(?<![\p{L}\p{N}])\|(?=['\u0020]|\p{Ll}|$)", "I", languages=frozenset({"en"})),  # a bar read for a capital i
    Rule(r"(?<=\p{Ll})\|(?=\p{Ll})", "l", languages=frozenset({"en"})),
    Rule(r"\b([0-9]+)[oO](?=[0-9]|\b)", "$10"),
    Rule(r"(?m)^[^\p{L}\p{N}?!\u2026\u266a.-]+$"),  # lines of stray marks
    Rule(r"[ \t]+(?=[,.;:!?](?:[ \t\n]|$))", languages=frozenset({"en", "de", "es", "it", "pt", "nl", "sv", "da", "no", "nb", "fi", "pl"})),
    Rule(r"[ \t]{2,}", " "),
    Rule(r"(?m)^[ \t]+|[ \t]+$"),
    Rule(r"\n{2,}", "\n"),
]


def rule(value) -> Rule:
    """A Rule from a pair (pattern, replacement), or a mapping with the fields of Rule."""
    if isinstance(value, Rule):
        return value
    if isinstance(value, dict):
        return Rule(str(value["pattern"]), str(value.get("replacement", "")), frozenset(value.get("tags") or {DEFAULT_TAG}), frozenset(value.get("languages") or ()))
    pattern, put = value
    return Rule(str(pattern), str(put))


def chosen(rules: Iterable, tags: Iterable[str] = (), languages: Iterable[str] = ()) -> list[Rule]:
    """The rules of any of the tags (the default one where none is named), for any of the languages (all where none is named), in their order."""
    tags, asked = set(tags) or {DEFAULT_TAG}, set(languages)
    fits = lambda own: not own or not asked or any(x in own or x.split("-")[0] in own or any(y.split("-")[0] == x for y in own) for x in asked)
    return [r for r in map(rule, rules) if r.tags & tags and fits(r.languages)]


def srt_time(ms: Column) -> Column:
    part = lambda unit, mod: F.pmod(F.floor(ms / unit), F.lit(mod)).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000).cast("long"), part(60_000, 60), part(1000, 60), part(1, 1000))


def _where(own: Column, r: Rule):
    return lambda t: F.when(own, F.regexp_replace(t, r.pattern, r.replacement)).otherwise(t)


def apply_rules(text: Column, rules: Iterable, language: Column | None = None) -> Column:
    """Rules one after another; a rule with languages changes texts of those only."""
    for r in map(rule, rules):
        if not r.languages:
            text = F.regexp_replace(text, r.pattern, r.replacement)
        elif language is not None:
            own = F.coalesce(language.isin(*r.languages) | F.element_at(F.split(language, "-"), 1).isin(*r.languages), F.lit(False))
            # The text so far is bound: it occurs twice, and would double with each such rule.
            text = bound(text, _where(own, r))
    return text


def srt_block(idx: Column, start_ms: Column, end_ms: Column, text: Column) -> Column:
    return F.concat(idx.cast("string"), F.lit("\n"), srt_time(start_ms), F.lit(" --> "), srt_time(end_ms), F.lit("\n"), text, F.lit("\n"))
