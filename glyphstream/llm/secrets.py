"""Secret scans, with DataFrame functions alone.

Three patterns give the base spans. A randomness test battery adds more: every token is tested under the smallest encoding that
holds it (hex, dashed or not, base32, base36, each in either case, base64), whatever classes of characters it mixes, for a uniform
alphabet (chi-squared, over its symbols and over its classes: capitals, small letters, digits, signs), for runs above and below the
alphabet's middle and runs of one class, for serial correlation of neighbouring symbols, and for more of prose's common letters (hex: of
digits) than chance gives. The p-values are combined by Fisher's method into one score, which is low
for random tokens and high for structured ones.

"Structured" is the null hypothesis that a reported secret must reject. Its distribution is learned from the corpus: every document
makes one structured token out of its own words (joined as a path, slug, snake or camel case, or run together in one case; or its digits), of a length and form that a hash
of its text sets, and these are scored like any token. A candidate's p-value is the share of structured tokens of its encoding and length class that
look as random as it does; a share ``OTHERS`` of structured tokens (names of programs, say, in a corpus of prose) is taken to follow a fixed wider law. Within each length class the Benjamini-Hochberg
step over these p-values, in fine bins, settles which candidates are reported, so that at most a share ``fdr`` of a class's reports are structured
tokens. What is gathered is counts (encodings x classes x bins rows at most); texts never move, and spans are found where the text is.

Defined results: null and empty texts have no spans; equal rows are scanned each; spans are in code points with the end
exclusive; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphstream.llm._common import Scratch, read_table

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: Runs of this many code symbols are candidates of the battery.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: A candidate is tested if it has at least a third as many different symbols as symbols, or ten.
FEW, FEW_OF = 3, 30
FDR = 0.05
#: Bins of the p-values (a tenth of log p each), and of the scores (a quarter each).
BINS, SCORES = 200, 200
#: A fixed lognormal law of structured tokens' scores: the share of them that follow it, however many others are seen, and the observations it
#: counts for among those; the median score a symbol, and the deviation of its logarithm.
OTHERS, PRIOR, PRIOR_SCORE, PRIOR_SPREAD = 0.5, 20.0, 1.0, 0.8
#: Matches of one text that are put together at a time, so that its work grows with their number and not its square.
BLOCK = 256
#: Lengths at which a class of tokens begins.
CLASSES = (20, 24, 32, 48, 64, 128)
#: Lengths of the structured tokens that documents make: some of each class.
LENGTHS = (20, 22, 24, 28, 32, 40, 48, 56, 64, 96, 128, 160)
#: Alphabets of the encodings, in the order of their codes.
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: Letters that prose in Latin script has most of; in hex, counters and dates have digits.
COMMON, COMMON_HEX = "aeilnorstAEILNORST", "0123456789"
#: Capitals, small letters, digits and signs of an encoding's alphabet.
SHARES = {"hex": (0, 6, 10, 0), "base32": (26, 0, 6, 0), "base36": (26, 0, 10, 0), "base64": (26, 26, 10, 2)}
TESTS = 6

_SPANS = "array<struct<start:bigint,kind:int,stop:bigint,text:string>>"


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once: a lambda's argument is bound, a repeated column is not."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _found(text: Column, pattern: str, kind: int, may: Column, keep) -> Column:
    """Spans of a pattern's leftmost non-overlapping matches that ``keep(match)`` accepts; ``may``: whether there can be any.

    Matches and the gaps between them are listed; the running sum of their lengths is where each match starts. Lists grow by BLOCK matches at a time.
    """

    def step(state, z):
        start = state.at + F.length(z["gap"])
        stop = start + F.length(z["hit"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), z["hit"].alias("text"))
        return F.struct(stop.alias("at"), F.when(keep(z["hit"]), F.concat(state.out, F.array(span))).otherwise(state.out).alias("out"))

    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    empty = F.expr(f"cast(array() as {_SPANS})")

    def block(state, b):
        # The gap after the last match has no match: its step changes nothing that is read.
        begin = F.struct(state.at.alias("at"), empty.alias("out"))
        done = F.aggregate(b, begin, lambda x, z: F.when(z["hit"].isNull(), x).otherwise(step(x, z)))
        return _let(done, lambda x: F.struct(x["at"].alias("at"), F.concat(state.out, F.array(x["out"])).alias("out")))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as array<{_SPANS}>)").alias("out"))
    return F.when(may, _let(pairs, lambda p: F.aggregate(_blocks(p), start, block, lambda x: F.flatten(x.out)))).otherwise(empty)


def _blocks(items: Column) -> Column:
    """An array in slices of BLOCK items, in order."""
    last = F.greatest(F.ceil(F.size(items) / BLOCK) - 1, F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK)))


def base_spans(text: Column) -> Column:
    """Base spans of the three kinds, not yet in order. A run that has no match of the least length has none that is kept."""
    has = text.contains
    keyword = text.rlike(r"(?:[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[A-Za-z]*[\"']?\x20*[:=]")
    group2 = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= MIN_ASSIGN
    return F.concat(
        _found(text, ASSIGN, 0, (has("=") | has(":")) & keyword, group2),
        _found(text, ACCESS, 1, has("AKIA"), lambda m: F.length(m) >= MIN_ACCESS),
        # Longest runs only: a shorter one is dropped whole, so asking for the least length in the pattern changes nothing.
        _found(text, f"[0-9a-f]{{{MIN_HEX},}}", 2, text.rlike(f"[0-9a-f]{{{MIN_HEX}}}"), lambda m: F.lit(True)),
    )


def encoding(token: Column) -> Column:
    """The smallest encoding that holds a token: hex (upper or lower case, whole or in dashed groups), base32 or base36 (of one case), else base64."""
    t = F.rtrim(token, F.lit("="))
    # Possessive, so that the matcher neither goes back nor goes a level deeper for each group.
    hex_ = t.rlike("^(?:[0-9a-f]{2,}+(?:-[0-9a-f]{2,}+)*+|[0-9A-F]{2,}+(?:-[0-9A-F]{2,}+)*+)$")
    return F.when(hex_, "hex").when(t.rlike("^([A-Z2-7]+|[a-z2-7]+)$"), "base32").when(t.rlike("^([A-Z0-9]+|[a-z0-9]+)$"), "base36").otherwise("base64")


def _normal_tail(z: Column) -> Column:
    """P(|N| >= z), by a rational approximation of the error function (error below 2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.greatest(poly * F.exp(-x * x), F.lit(1e-300))


def battery(token: Column, kind: Column) -> Column:
    """Struct (p_uniform, p_runs, p_serial, p_common, p_class, p_switch, p, distinct) of a token under its encoding."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    alphabet = F.when(kind == "hex", ALPHABETS["hex"]).when(kind == "base32", ALPHABETS["base32"]).when(kind == "base36", ALPHABETS["base36"]).otherwise(ALPHABETS["base64"])
    bare = F.rtrim(token, F.lit("="))
    plain = F.when(kind == "hex", F.lower(F.translate(bare, "-", ""))).when(kind == "base64", F.translate(bare, "-_", "+/")).otherwise(F.upper(bare))
    listed = _let(alphabet, lambda a: F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.instr(a, c).cast("double") - 1))

    classes = F.translate(plain, ALPHABETS["base64"], "U" * 26 + "l" * 26 + "d" * 10 + "s" * 2)
    by_kind = lambda f: F.when(kind == "hex", f("hex")).when(kind == "base32", f("base32")).when(kind == "base36", f("base36")).otherwise(f("base64"))
    share_of = lambda k, c: SHARES[k][c] / sum(SHARES[k])
    alike = by_kind(lambda k: F.lit(sum(share_of(k, c) ** 2 for c in range(4))))

    def sums(codes, size):
        """What the tests need of the codes, each computed once."""
        n = F.size(codes).cast("double")
        middle = (size - 1) / 2
        counts = F.transform(F.array_distinct(codes), lambda d: F.size(F.filter(codes, lambda c: c == d)).cast("double"))
        pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        centred = _let(
            total(codes) / n,
            lambda m: F.struct(
                total(F.transform(codes, lambda c: (c - m) * (c - m))).alias("square"),
                F.aggregate(pairs, F.lit(0.0), lambda x, q: x + (q["a"] - m) * (q["b"] - m)).alias("lag"),
            ),
        )
        return F.struct(
            n.alias("n"),
            size.alias("size"),
            F.size(F.array_distinct(codes)).alias("distinct"),
            total(F.transform(counts, lambda c: c * c)).alias("counts2"),
            total(F.transform(codes, lambda c: F.when(c > middle, 1.0).otherwise(0.0))).alias("high"),
            F.aggregate(pairs, F.lit(1.0), lambda x, q: x + F.when((q["a"] > middle) != (q["b"] > middle), 1.0).otherwise(0.0)).alias("runs"),
            centred.alias("c"),
            (F.length(plain) - F.length(F.translate(plain, COMMON, ""))).cast("double").alias("letters"),
            (F.length(plain) - F.length(F.translate(plain, COMMON_HEX, ""))).cast("double").alias("digits"),
            F.array(*[(F.length(classes) - F.length(F.translate(classes, c, ""))).cast("double") for c in "Ulds"]).alias("classes"),
            (F.length(F.regexp_replace(classes, r"(.)\1*", "x")) - 1).cast("double").alias("switches"),
        )

    def ps(s):
        n, free = s["n"], s["size"] - 1
        chi = s["counts2"] * s["size"] / n - n
        # Wilson and Hilferty's cube root makes chi-squared normal.
        normal = lambda chi, free: (F.cbrt(F.greatest(chi, F.lit(0.0)) / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        above = lambda z: F.when(z <= 0, F.lit(1.0)).otherwise(_normal_tail(z) / 2)
        expected = lambda c: by_kind(lambda k: F.lit(share_of(k, c))) * n
        by_class = sum((F.when(expected(c) > 0, (F.element_at(s["classes"], c + 1) - expected(c)) ** 2 / F.greatest(expected(c), F.lit(1e-9))).otherwise(0.0) for c in range(4)), F.lit(0.0))
        switch = (s["switches"] - (n - 1) * (1 - alike)) / F.sqrt((n - 1) * alike * (1 - alike))
        mean = 2 * (n - s["high"]) * s["high"] / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        # Of a single-case alphabet half of COMMON are symbols.
        seen, share = F.when(kind == "hex", s["digits"]).otherwise(s["letters"]), F.when(kind == "hex", 10.0).when(kind == "base64", 18.0).otherwise(9.0) / s["size"]
        over = (seen - 0.5 - n * share) / F.sqrt(n * share * (1 - share))
        return F.struct(
            above(normal(chi, free)).alias("p_uniform"),
            F.when(var > 0, _normal_tail((s["runs"] - mean) / F.sqrt(var))).otherwise(F.lit(1e-12)).alias("p_runs"),
            F.when(s["c"]["square"] > 0, _normal_tail((s["c"]["lag"] / s["c"]["square"] + 1 / n) * F.sqrt(n))).otherwise(F.lit(1e-12)).alias("p_serial"),
            F.when(over > 0, _normal_tail(over) / 2).otherwise(1 - _normal_tail(over) / 2).alias("p_common"),
            above(normal(by_class, by_kind(lambda k: F.lit(sum(x > 0 for x in SHARES[k]) - 1.0)))).alias("p_class"),
            _normal_tail(switch).alias("p_switch"),
            s["distinct"].alias("distinct"),
        )

    def combined(p):
        names = ["p_uniform", "p_runs", "p_serial", "p_common", "p_class", "p_switch"]
        half = -sum((F.log(F.greatest(p[k], F.lit(1e-300))) for k in names), F.lit(0.0))
        # Chi-squared with two degrees of freedom a test.
        series = lambda h: sum((h**k / math.factorial(k) for k in range(1, TESTS)), F.lit(1.0))
        return F.struct(*(p[k].alias(k) for k in names), _let(half, lambda h: F.exp(-h) * series(h)).alias("p"), p["distinct"].alias("distinct"))

    return _let(listed, lambda codes: _let(sums(codes, F.length(alphabet).cast("double")), lambda s: _let(ps(s), combined)))


def _length_class(n: Column) -> Column:
    out = F.lit(0)
    for k, least in enumerate(CLASSES):
        out = F.when(n >= least, k).otherwise(out)
    return out


def score(p: Column) -> Column:
    """Fisher's statistic of the combined p-value, halved: low for random tokens, high for structured ones."""
    return -F.log(F.greatest(p, F.lit(1e-300)))


def _scored(token: Column, start: Column, kind_of: Column | None = None) -> Column:
    """A token's (start, stop, text, code, klass, score, distinct, size); code is its encoding."""
    kind = kind_of if kind_of is not None else encoding(token)

    def one(code):
        return _let(battery(token, code), lambda b: F.struct(start.alias("start"), (start + F.length(token)).alias("stop"), token.alias("text"), code.alias("code"), _length_class(F.length(token)).alias("klass"), score(b["p"]).alias("score"), b["distinct"].alias("distinct")))

    return _let(kind, one)


def looked_over(text: Column) -> Column:
    """Struct (base: the base spans of a text; tests: the battery's candidates that no base span touches and that have symbols enough, scored). Each part is worked out once."""
    free = lambda b: lambda c: ~F.exists(b, lambda x: (x["start"] < c["stop"]) & (c["start"] < x["stop"]))
    varied = lambda c: c["distinct"] * FEW >= F.least(c["stop"] - c["start"], F.lit(FEW_OF))
    found = _found(text, CANDIDATE, 3, text.rlike(r"[A-Za-z0-9+/_-]{20}"), lambda m: F.lit(True))
    # Most texts have no candidate: nothing more is done for them.
    tests = lambda b: _let(found, lambda f: F.when(F.size(f) > 0, F.filter(F.transform(F.filter(f, free(b)), lambda c: _scored(c["text"], c["start"])), varied)))
    return _let(base_spans(text), lambda b: F.struct(b.alias("base"), tests(b).alias("tests")))


def structured(text: Column) -> Column:
    """One structured token made of a text's own words or digits, from a place, in a form and of a length that its hash sets; null if it has too few.

    Forms: a path, a slug, snake case, camel case, all lower, all upper, digits alone.
    """

    def drawn(h):
        draw = lambda shift, n: F.pmod(F.shiftright(h, shift), F.lit(n)).cast("int")
        return F.struct(F.element_at(F.array(*[F.lit(n) for n in LENGTHS]), draw(3, len(LENGTHS)) + 1).alias("n"), draw(11, 7).alias("form"), F.shiftright(h, 17).alias("place"))

    def made(d):
        begin = F.pmod(d["place"], F.greatest(F.length(text) - 8 * d["n"], F.lit(1))).cast("int") + 1
        words = F.trim(F.regexp_replace(F.substring(text, begin, 8 * d["n"]), "[^A-Za-z0-9]+", " "))

        def formed(w):
            form, bare, joined = d["form"], F.translate(w, " ", ""), lambda mark: F.translate(w, " ", mark)
            return F.when(form == 0, joined("/")).when(form == 1, joined("-")).when(form == 2, joined("_")).when(form == 3, F.translate(F.initcap(w), " ", "")).when(form == 4, F.lower(bare)).when(form == 5, F.upper(bare)).otherwise(F.regexp_replace(w, "[^0-9]+", ""))

        return _let(_let(words, formed), lambda t: F.when(F.length(t) >= CLASSES[0], F.substring(t, F.lit(1), d["n"])))

    return _let(F.xxhash64(text), lambda h: _let(drawn(h), made))


def _score_bin(s: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(SCORES), F.ceil(s * 4).cast("int")))


def _p_bin(p: Column) -> Column:
    """0 (smallest p) to BINS: equal steps of log p; a bin's upper edge is exp((bin - BINS) / 10)."""
    return F.greatest(F.lit(0), F.least(F.lit(BINS), F.ceil(F.log(F.greatest(p, F.lit(1e-300))) * 10).cast("int") + BINS))


def looked_at(docs: DataFrame, *columns: Column) -> DataFrame:
    """columns of docs (text), with made: the scored structured token of a text or null, and looked: its looked_over()."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    made = _let(structured(text), lambda t: F.when(t.isNotNull(), _scored(t, F.lit(0).cast("long"))))
    return docs.select(*columns, made.alias("made"), looked_over(text).alias("looked"))


def slimmed(looked: DataFrame) -> DataFrame:
    """(made: a structured token, scored, or null; tests: the candidates, scored) of looked_at(), a row a document."""
    slim = lambda c: F.struct(c["code"].alias("code"), c["klass"].alias("klass"), (c["stop"] - c["start"]).cast("int").alias("size"), c["score"].alias("score"))
    none = F.expr("cast(array() as array<struct<code:string,klass:int,size:int,score:double>>)")
    return looked.select(_let(F.col("made"), lambda c: F.when(c.isNotNull(), slim(c))).alias("made"), F.coalesce(F.transform("looked.tests", slim), none).alias("tests"))


def tested(docs: DataFrame) -> DataFrame:
    """slimmed() of docs (text)."""
    return slimmed(looked_at(docs))


def null_counts(t: DataFrame) -> DataFrame:
    """(code, klass, upto: for each score bin, structured tokens of the encoding and class in bins up to it); at most a row for each encoding and class."""
    bins = t.where("made is not null").groupBy("made.code", "made.klass", _score_bin(F.col("made.score")).alias("bin")).agg(F.count("*").alias("n"))
    per = bins.groupBy("code", "klass").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("at"))
    each = F.transform(F.sequence(F.lit(0), F.lit(SCORES)), lambda k: F.coalesce(F.try_element_at("at", k), F.lit(0).cast("long")))
    grown = F.aggregate(each, F.struct(F.lit(0).cast("long").alias("sum"), F.expr("cast(array() as array<bigint>)").alias("out")), lambda s, n: F.struct((s["sum"] + n).alias("sum"), F.concat(s["out"], F.array(s["sum"] + n)).alias("out")), lambda s: s["out"])
    return per.select("code", "klass", grown.alias("upto"))


def p_structured(score: Column, size: Column, upto: Column) -> Column:
    """The share of structured tokens that look as random as a score, a share OTHERS of them being of the fixed law, which counts as PRIOR of the rest too; upto may be null (none seen)."""
    z = (F.log(PRIOR_SCORE * size) - F.log(F.greatest(score, F.lit(1e-9)))) / PRIOR_SPREAD
    law = F.when(z >= 0, _normal_tail(z) / 2).otherwise(1 - _normal_tail(z) / 2)
    seen = F.coalesce(F.try_element_at(upto, _score_bin(score) + 1), F.lit(0).cast("long"))
    every = F.coalesce(F.try_element_at(upto, F.lit(SCORES + 1)), F.lit(0).cast("long"))
    return OTHERS * law + (1 - OTHERS) * (PRIOR * law + seen) / (PRIOR + every)


def reported_bins(tests: DataFrame, nulls: DataFrame, fdr: float = FDR) -> DataFrame:
    """(klass, last_bin) by the Benjamini-Hochberg step: candidates of a class with p in bins up to last_bin are reported. At most a row a class."""
    own = tests.select(F.inline("tests")).join(F.broadcast(nulls), ["code", "klass"], "left")  # encodings x classes rows at most
    bins = own.groupBy("klass", _p_bin(p_structured(F.col("score"), F.col("size"), F.col("upto"))).alias("bin")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("klass").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    edge = F.exp((F.col("bin") - BINS) / 10.0)
    good = bins.select("klass", "bin", (edge * F.sum("n").over(Window.partitionBy("klass")) <= fdr * F.sum("n").over(upto)).alias("reported"))
    return good.where("reported").groupBy("klass").agg(F.max("bin").alias("last_bin"))


def limits(looked: DataFrame, scratch: Scratch, fdr: float = FDR) -> DataFrame:
    """One row (nulls: map of encoding and class to upto, last: map of class to last bin) from looked_at() of all documents."""
    t = scratch.keep(slimmed(looked))
    nulls = scratch.keep(null_counts(t))
    last = scratch.keep(reported_bins(t, nulls, fdr))
    one = nulls.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "code", "klass"), "upto"))).alias("nulls"))
    one = scratch.keep(one.crossJoin(F.broadcast(last.agg(F.map_from_entries(F.collect_list(F.struct("klass", "last_bin"))).alias("last")))))  # one row by one row
    scratch.drop(t, nulls, last)
    return one


def with_spans(docs: DataFrame, found: DataFrame, looked: Column) -> DataFrame:
    """docs with spans, of which looked is looked_over(): all spans (start, kind, stop, text), base ones and those the battery adds, by start, then kind. Rows don't move."""

    def random(c):
        p = p_structured(c["score"], c["stop"] - c["start"], F.try_element_at(F.col("nulls"), F.concat_ws(":", c["code"], c["klass"].cast("string"))))
        return _p_bin(p) <= F.coalesce(F.try_element_at("last", c["klass"]), F.lit(-1))

    span = lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["stop"].alias("stop"), c["text"].alias("text"))
    met = docs.join(F.broadcast(found))  # one row

    def every(x):
        more = F.when(F.size(x["tests"]) > 0, F.array_sort(F.concat(x["base"], F.transform(F.filter(x["tests"], random), span))))
        return F.coalesce(more, F.array_sort(x["base"]))

    return met.withColumn("spans", _let(looked, every)).drop("nulls", "last")


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """(doc_id, spans) of docs (doc_id, text). Texts are read once: what is found in each is kept, and judged when all are known."""
    scratch = Scratch(docs.sparkSession)
    kept = scratch.keep(looked_at(docs, F.col("doc_id").cast("long").alias("doc_id")))
    return with_spans(kept, limits(kept, scratch, fdr), F.col("looked")).select("doc_id", "spans")


def digest(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by a mark; overlapping spans are replaced together.

    What is left of the text is cut off piece by piece, BLOCK spans at a time from a piece of their own, so that a text of many spans isn't read from its start for each.
    """

    def step(state, s):
        gap = F.when(s["start"] > state.at, F.concat(F.substring(state.part, (state.at - state.base + 1).cast("int"), (s["start"] - state.at).cast("int")), F.lit(mark))).when(s["start"] == 0, F.lit(mark)).otherwise(F.lit(""))
        return F.struct(F.greatest(state.at, s["stop"]).alias("at"), F.concat(state.out, gap).alias("out"), state.part.alias("part"), state.base.alias("base"))

    def block(state, b):
        far = F.greatest(F.array_max(F.transform(b, lambda s: s["stop"])), state.at)
        part = F.substring(text, (state.at + 1).cast("int"), (far - state.at).cast("int"))
        begin = F.struct(state.at.alias("at"), F.lit("").alias("out"), part.alias("part"), state.at.alias("base"))
        return _let(F.aggregate(b, begin, step), lambda x: F.struct(x["at"].alias("at"), F.concat(state.out, F.array(x["out"])).alias("out")))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    done = F.aggregate(_blocks(spans), start, block, lambda s: F.concat(F.array_join(s.out, ""), F.substring(text, (s.at + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """docs, all columns, with every span found in a text replaced by a mark, and n_chars following where a text changed."""
    found = limits(looked_at(docs), Scratch(docs.sparkSession))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text = F.col("row.text").cast("string")
    new = redacted(text, F.col("spans"))
    columns = []
    for c in docs.columns:
        old, kind = F.col(f"row.`{c}`"), docs.schema[c].dataType
        columns.append((new.cast(kind) if c.lower() == "text" else F.when(F.size("spans") > 0, F.length(new)).otherwise(old).cast(kind) if c.lower() == "n_chars" else old).alias(c))
    return with_spans(own, found, looked_over(F.coalesce(text, F.lit("")))).select(*columns)


def op7_secret_scans(spark, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(digest(base).cast("binary"), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
