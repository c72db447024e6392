"""Mixing sources to target weights: entropy balancing, with DataFrame functions alone.

Every document i has a rate w_i, how often the mix takes it. The rates stay closest in entropy to taking each document once
(sum of w log w - w) under the sources' token constraints, sum of w_i x_i = target, where x_i is the document's words (its entry for its source, 0 for
others), and under w_i <= cap. The solution is an exponential tilt, w_i = min(cap, exp(lambda . x_i)); lambda minimises the convex dual, whose
gradient (words taken less target) and Hessian are summed over all documents in each step. As a document has words in one source only, the
Hessian is diagonal and a Newton step goes coordinate by coordinate, on the logarithm of the words taken; a bracket of the root guards it. Steps end
when no source's taken words differ from its target by more than ``TOLERANCE`` of it. Documents of a source with equal sizes share a term, so the
sums go over counts of (source, size); they are sums of decimals, the same in whatever order, so reruns agree to the last bit.

Rates become whole copies beside the row, without moving it: floor(w), and one more where a hash of the row, less the rate's fraction, is at most a
threshold. Thresholds are set for each source and size class (powers of two) from counts in ``BINS`` bins, large classes first, each
class making up for what the classes before it took too much or too little.

Defined results: null text is 0 words, which are never taken (a row without words is kept once by ``mixed``); null source is a source of its own,
last in order; rows equal in doc_id and text are taken alike; sources whose target is the cap take every document that often; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphstream.llm._common import Scratch, parallelism, read_table, word_count

CAP = 3
WEIGHTS = (1, 2, 3)
#: Share of its target by which a source's words may differ when the steps end, and steps at most (each at least halves a bracket).
TOLERANCE, MOST_STEPS = 1e-9, 200
#: Bins of a size class in which its threshold is looked for.
BINS = 2048
#: Sources up to this many (a rate and some thirty thresholds each) are broadcast; beyond it the rows meet them by a join.
MAX_BROADCAST_SOURCES = 10_000
_HASHES = 1 << 30


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, u) of docs (doc_id, text, source): words, and a whole number below 2**30 by hash of doc_id and text."""
    text = F.col("text").cast("string")
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), F.pmod(F.xxhash64(doc_id, text), F.lit(_HASHES)).alias("u"))


def targets(sizes: DataFrame, scratch: Scratch, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """Kept (source, source_size, n_docs, longest, square, target) from (source, size, n): n rows of a size.

    Weights go round by the sources' code-point order, null last: sources are ranked within ranges of that order, and the ranges' counts added up.
    A target stops at ``cap`` times its source's size; what is over is shared again by weight until none is above, so target = min(cap * size, level * weight).
    """
    size, n = F.col("size"), F.col("n")
    per = sizes.groupBy("source").agg(F.sum(size * n).alias("source_size"), F.sum("n").alias("n_docs"), F.max("size").alias("longest"), F.sum(size.cast("decimal(38,0)") * size * n).cast("double").alias("square"))
    order = [F.col("source").isNull(), F.col("source")]
    ranged = scratch.keep(per.repartitionByRange(min(64, parallelism(scratch.spark)), *order).withColumn("range", F.spark_partition_id()))
    before, at = {}, 0
    for r in sorted(ranged.groupBy("range").count().collect()):  # 64 at most
        before[r[0]], at = at, at + r[1]
    shift = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("range")) if before else F.lit(0)
    turn = (F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1 + shift) % len(weights)
    w = scratch.keep(ranged.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))).drop("range"))
    scratch.drop(ranged)
    level, full = 0.0, -1
    while True:  # ends when no further source is full
        over = F.col("weight") * F.lit(level) >= cap * F.col("source_size")
        s = w.agg(F.sum("source_size"), F.sum(F.when(over, F.col("source_size")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight"))), F.count_if(over)).head()
        if s[3] == full or not s[2]:
            break
        full, level = s[3], (s[0] - cap * s[1]) / s[2]
    capped = (cap * F.col("source_size")).cast("double")
    return w.select("source", "source_size", "n_docs", "longest", "square", F.least(capped, F.col("weight") * F.lit(level)).alias("target") if s[2] else capped.alias("target"))


def tilt(size: Column, lam: Column, scale: Column, cap: int) -> Column:
    """A document's rate: min(cap, exp(lambda x)), x being its words in units of ``scale``; a null lambda takes it at the cap."""
    x = size.cast("double") / scale
    return F.when(size == 0, F.lit(1.0)).when(lam.isNull(), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(lam * x, F.lit(700.0)))))


def balance(sizes: DataFrame, per: DataFrame, scratch: Scratch, cap: int = CAP) -> DataFrame:
    """Kept per with (scale, lam, off): the multipliers after Newton steps over sizes (source, size, n), and how far from its target a source is, as a share."""
    ratio = F.col("target") / F.nullif(F.col("source_size"), F.lit(0))
    # A source at the cap, or without words, needs no multiplier; x is in units of the mean size as words see it.
    free = (F.col("source_size") > 0) & (ratio < cap * (1 - 1e-12))
    state = per.withColumns({"scale": F.when(F.col("square") > 0, F.col("square") / F.col("source_size")).otherwise(F.lit(1.0)), "lam": F.when(free, F.log(ratio)), "lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double"), "off": F.lit(None).cast("double")})
    state = scratch.keep(state)
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    exact = lambda c: F.sum(c.cast("decimal(38,12)")).cast("double")
    for _ in range(MOST_STEPS):
        x = F.col("size").cast("double") / F.col("scale")
        w = tilt(F.col("size"), F.col("lam"), F.col("scale"), cap)
        terms = sizes.alias("h").join(state.select("source", "scale", "lam").where("lam is not null").alias("s"), same("h", "s")).select("h.source", (F.col("n") * w * x).alias("g"), (F.col("n") * F.when(w < cap, w * x * x).otherwise(0.0)).alias("h"))
        sums = terms.groupBy("source").agg(exact(F.col("g")).alias("g"), exact(F.col("h")).alias("h"))
        g, h, lam = F.col("g"), F.col("h"), F.col("lam")
        aim = F.col("target") / F.col("scale")
        lo, hi = F.when(g < aim, lam).otherwise(F.col("lo")), F.when(g >= aim, lam).otherwise(F.col("hi"))
        newton = F.when((g > 0) & (h > 0), lam - F.log(g / aim) * g / h)
        far = F.when(g < aim, F.greatest(2 * lam, lam + 1)).otherwise(F.least(2 * lam, lam - 1))  # while a side of the bracket is open
        middle = F.coalesce((lo + hi) / 2, far)
        inside = newton.isNotNull() & F.coalesce(newton > lo, F.lit(True)) & F.coalesce(newton < hi, F.lit(True))
        off = F.abs(g / aim - 1)
        step = F.when(off <= TOLERANCE, lam).otherwise(F.when(inside, newton).otherwise(middle))
        moved = state.alias("p").join(sums.alias("q"), same("p", "q"), "left").select("p.source", "source_size", "n_docs", "longest", "square", "target", "scale", F.when(g.isNotNull(), step).otherwise(lam).alias("lam"), lo.alias("lo"), hi.alias("hi"), off.alias("off"))
        last, state = state, scratch.keep(moved)
        scratch.drop(last)
        if (state.agg(F.max("off")).head()[0] or 0.0) <= TOLERANCE:
            break
    return state


def _class(size: Column) -> Column:
    """Size class: the number of binary digits of a size, 0 without words."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0)


def _fraction(rate: Column) -> Column:
    return rate - F.floor(rate)


def _bin(u: Column, rate: Column) -> Column:
    """0 to BINS - 1, growing with the hash less the rate's fraction; at a threshold in the middle a document is taken once more with the fraction's probability."""
    z = (u.cast("double") + 0.5) / _HASHES - _fraction(rate)
    return F.least(F.lit(BINS - 1), F.floor((z + 1) * (BINS // 2))).cast("int")


def thresholds(rated: DataFrame) -> DataFrame:
    """(source, last): for each size class in order the last bin that is taken once more, from (source, size, u, rate)."""
    some = rated.where((F.col("size") > 0) & (_fraction(F.col("rate")) > 0))
    fraction = (_fraction(F.col("rate")) * F.col("size")).cast("decimal(38,12)")
    bins = some.groupBy("source", _class(F.col("size")).alias("klass"), _bin(F.col("u"), F.col("rate")).alias("bin")).agg(F.sum("size").alias("mass"), F.sum(fraction).alias("want"))
    classes = bins.groupBy("source", "klass").agg(F.array_sort(F.collect_list(F.struct("bin", "mass"))).alias("bins"), F.sum("want").cast("double").alias("want"))  # BINS at most
    held = F.reverse(F.array_sort(F.collect_list(F.struct("klass", "want", "bins"))))  # 63 classes at most

    def search(state, b):
        taken = state.taken + b["mass"]
        off = F.abs(state.want - taken)
        better = off < state.off
        return F.struct(state.want.alias("want"), taken.alias("taken"), F.when(better, off).otherwise(state.off).alias("off"), F.when(better, b["bin"]).otherwise(state["last"]).alias("last"), F.when(better, taken).otherwise(state.best).alias("best"))

    def fold(state, c):
        want = state.carry + c["want"]
        begin = F.struct(want.alias("want"), F.lit(0).cast("long").alias("taken"), F.abs(want).alias("off"), F.lit(-1).alias("last"), F.lit(0).cast("long").alias("best"))
        found = F.aggregate(c["bins"], begin, search, lambda s: F.struct((s.want - s.best).alias("carry"), s["last"].alias("last")))
        return F.element_at(F.transform(F.array(found), lambda f: F.struct(f["carry"].alias("carry"), F.map_concat(state["out"], F.map_from_arrays(F.array(c["klass"]), F.array(f["last"]))).alias("out"))), 1)

    start = F.struct(F.lit(0.0).alias("carry"), F.expr("cast(map() as map<int,int>)").alias("out"))
    return classes.groupBy("source").agg(held.alias("held")).select("source", F.aggregate("held", start, fold, lambda s: s["out"]).alias("last"))


def _planned(sizes: DataFrame, scratch: Scratch, weights, cap: int) -> DataFrame:
    """Kept (source, source_size, target, scale, lam, off, last) from sized rows: all that a row needs to know its copies."""
    counts = scratch.keep(sizes.groupBy("source", "size").agg(F.count("*").alias("n")))
    per = targets(counts, scratch, weights, cap)
    state = balance(counts, per, scratch, cap)
    scratch.drop(counts)
    rated = _met(sizes, state.select("source", "scale", "lam"), state).withColumn("rate", tilt(F.col("size"), F.col("lam"), F.col("scale"), cap))
    plan = state.alias("s").join(thresholds(rated).alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")), "left")
    plan = scratch.keep(plan.select("s.source", "source_size", "target", "scale", "lam", "off", "last"))
    scratch.drop(state)
    return plan


def _met(rows: DataFrame, per: DataFrame, counted: DataFrame) -> DataFrame:
    """rows (with a column source) with per's columns for their source, in place of source."""
    per = per.withColumnRenamed("source", "_source")
    small = counted.count() <= MAX_BROADCAST_SOURCES
    return rows.join(F.broadcast(per) if small else per, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _copies(size: Column, u: Column, rate: Column) -> Column:
    more = (_fraction(rate) > 0) & (_bin(u, rate) <= F.coalesce(F.try_element_at(F.col("last"), _class(size)), F.lit(-1)))
    return F.when(size == 0, F.lit(0)).otherwise(F.floor(rate) + more.cast("int")).cast("int")


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken), a row for each row of docs (doc_id, text, source)."""
    scratch = Scratch(docs.sparkSession)
    sizes = scratch.keep(sized(docs))
    plan = _planned(sizes, scratch, weights, cap)
    met = _met(sizes, plan, plan).withColumn("rate", tilt(F.col("size"), F.col("lam"), F.col("scale"), cap))
    met = met.withColumn("copies", _copies(F.col("size"), F.col("u"), F.col("rate")))
    return met.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """docs, all columns, each row as often as the mix takes it (a row without words once). Rows stay in their partitions."""
    scratch = Scratch(docs.sparkSession)
    sizes = scratch.keep(sized(docs))
    plan = _planned(sizes, scratch, weights, cap)
    scratch.drop(sizes)
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text, doc_id = F.col("row.text").cast("string"), F.col("row.doc_id").cast("long")
    own = own.select("row", F.col("row.source").cast("string").alias("source"), word_count(text).alias("size"), F.pmod(F.xxhash64(doc_id, text), F.lit(_HASHES)).alias("u"))
    met = _met(own, plan, plan).withColumn("rate", tilt(F.col("size"), F.col("lam"), F.col("scale"), cap))
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(_copies(F.col("size"), F.col("u"), F.col("rate")))
    return met.withColumn("copies", copies).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
