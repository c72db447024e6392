"""Media files as a table: recursive scan with a status, path parts, age and language filters, and what is already ripped."""

from __future__ import annotations

import os
import re
import string
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphstream.sources.iso639 import ALPHA3

GLOB = "*.{[sS][uU][pP],[mM][kK][vVsS]}"
#: Folders of raw streams that the driver lists; beyond that many the workers open the files.
MOST_FOLDERS = 10_000


@dataclass(frozen=True)
class ScanOptions:
    languages: frozenset[str] = field(default_factory=frozenset)
    age: timedelta | None = None
    srt_age: timedelta | None = None
    overwrite: bool = False
    one_per_lang: bool = True
    now: datetime | None = None


#: A code: two or three letters, then a script of four letters and a region, each optional.
CODE = "([A-Za-z]{2,3})(?:[-_]([A-Za-z]{4}))?(?:[-_]([A-Za-z]{2}|[0-9]{3}))?"
#: What may follow in a whole IETF tag: variants, extensions, private use.
MORE = "(?:[-_](?:[A-Za-z0-9]{5,8}|[0-9][A-Za-z0-9]{3}))*(?:[-_][A-WYZa-wyz0-9](?:[-_][A-Za-z0-9]{2,8})+)*(?:[-_][Xx](?:[-_][A-Za-z0-9]{1,8})+)?"


def bound(value: Column, use) -> Column:
    """use(value), with a long expression evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _tables() -> str:
    """Codes and what they become, ``|eng=en|``, for each first letter, joined by commas."""
    known = ALPHA3 | {v: v for v in ALPHA3.values()}
    return ",".join("|" + "".join(f"{k}={v}|" for k, v in sorted(known.items()) if k[0] == first) for first in string.ascii_lowercase)


def language(code: Column, tag: bool = False) -> Column:
    """Canonical IETF tag of a code, null if unknown; with tag, variants, extensions and private parts may follow, and are left out."""
    whole = f"^{CODE}{MORE if tag else ''}$"
    extract = lambda k: F.regexp_extract(code, whole, k)
    more = lambda text: F.when(text != "", F.concat(F.lit("-"), text)).otherwise("")
    tables = F.split(F.lit(_tables()), ",")  # a constant

    def known(x):
        # of the codes with that first letter; 27 is none
        table = F.try_element_at(tables, F.when(x["low"] != "", F.ascii(x["low"]) - 96).otherwise(27))
        return bound(F.struct(table.alias("table"), F.instr(table, F.concat(F.lit("|"), x["low"], F.lit("="))).alias("at")), lambda y: F.when(y["at"] > 0, F.concat(F.substring_index(F.substr(y["table"], y["at"] + F.length(x["low"]) + 2, F.lit(4)), "|", 1), more(x["script"]), more(x["region"]))))

    return bound(F.struct(F.lower(extract(1)).alias("low"), F.initcap(extract(2)).alias("script"), F.upper(extract(3)).alias("region")), known)


def tag(code: str | None) -> str | None:
    """language(code, tag=True) of one code."""
    m = re.fullmatch(CODE + MORE, code or "")
    base = ALPHA3.get(m[1].lower(), m[1].lower() if m[1].lower() in ALPHA3.values() else None) if m else None
    return base and "-".join(x for x in (base, m[2] and m[2].title(), m[3] and m[3].upper()) if x)


def matches(options: ScanOptions, made: Column, languages: Column) -> Column:
    """Is a file new enough, and is one of its languages (an array) asked for? Files without a known language match only where none is."""
    keep = F.lit(True)
    if options.age is not None:
        keep = age(made, options) <= F.expr(f"INTERVAL {int(options.age.total_seconds())} SECONDS")
    if options.languages:
        keep &= F.coalesce(F.arrays_overlap(languages, F.array(*map(F.lit, sorted(options.languages)))), F.lit(False))
    return keep


def age(made: Column, options: ScanOptions = ScanOptions()) -> Column:
    """Time since a file was changed."""
    return (F.lit(options.now) if options.now else F.current_timestamp()) - made


def path_parts(path: Column) -> Column:
    """Struct (base_path, number, language, extension) of a path: extension, then a language code, are taken off the name's end."""
    stem = F.regexp_replace(path, r"\.[^./]+$", "")
    lang = language(F.nullif(F.regexp_extract(stem, r"\.([^./]+)$", 1), F.lit("")))
    extension = F.lower(F.nullif(F.regexp_extract(path, r"\.([^./]+)$", 1), F.lit("")))
    base = lambda x: F.when(x["lang"].isNull(), x["stem"]).otherwise(F.regexp_replace(x["stem"], r"\.[^./]+$", ""))
    return bound(F.struct(stem.alias("stem"), lang.alias("lang"), extension.alias("extension")), lambda x: F.struct(base(x).alias("base_path"), F.lit(0).alias("number"), x["lang"].alias("language"), x["extension"].alias("extension")))


def render(parts: Column, extension: str | None = None, number: Column | None = None, lang: Column | None = None) -> Column:
    """A path from parts, with overrides: base[-number][.language][.extension]."""
    n = parts["number"] if number is None else number
    ext = F.lit(extension) if extension else parts["extension"]
    return F.concat(parts["base_path"], F.when(n > 0, F.concat(F.lit("-"), n.cast("string"))).otherwise(""), F.coalesce(F.concat(F.lit("."), parts["language"] if lang is None else lang), F.lit("")), F.coalesce(F.concat(F.lit("."), ext), F.lit("")))


def scan(spark: SparkSession, roots: list[str], options: ScanOptions = ScanOptions()) -> DataFrame:
    """(path, modificationTime, length, parts, languages, status, age, file_exists): status is collected, filtered_out, or discarded (roots that aren't there).

    Age and languages are filters; a container's languages are those of its tracks, which api.scan_path() reads, so here only its age counts.
    """
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    there = [r for r in roots if path(r).getFileSystem(conf).exists(path(r))]
    gone = spark.createDataFrame([(r,) for r in roots if r not in there], "path string")
    found = None
    for r in there:
        part = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", GLOB).load(r).select("path", "modificationTime", "length")
        found = part if found is None else found.unionByName(part)
    none = gone.select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(None).cast("long").alias("length"))
    if found is None:
        found = none.where("false")
    d = found.withColumn("parts", path_parts(F.col("path")))
    own = F.when(F.col("parts.language").isNull(), F.expr("cast(array() as array<string>)")).otherwise(F.array("parts.language"))
    d = d.withColumn("languages", F.when(F.col("parts.extension") == "sup", own))
    anyhow = ScanOptions(age=options.age, now=options.now)
    keep = F.when(F.col("languages").isNull(), matches(anyhow, F.col("modificationTime"), F.col("languages"))).otherwise(matches(options, F.col("modificationTime"), F.col("languages")))
    d = d.withColumn("status", F.when(keep, "collected").otherwise("filtered_out"))
    gone = none.withColumn("parts", path_parts(F.col("path"))).withColumn("languages", F.lit(None).cast("array<string>")).withColumn("status", F.lit("discarded"))
    return d.unionByName(gone).withColumns({"age": age(F.col("modificationTime"), options), "file_exists": F.col("modificationTime").isNotNull()})


def made(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path, modificationTime) of the subtitle files in the folders of roots."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    out = spark.createDataFrame([], "path string, modificationTime timestamp")
    for r in roots:
        at = spark._jvm.org.apache.hadoop.fs.Path(r)
        system = at.getFileSystem(conf)
        if system.exists(at):
            folder = r if system.getFileStatus(at).isDirectory() else at.getParent().toString()
            found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[sS][rR][tT]").load(folder)
            out = out.unionByName(found.select("path", "modificationTime"))
    return out.groupBy("path").agg(F.max("modificationTime").alias("modificationTime"))


def report(scanned: DataFrame) -> DataFrame:
    return scanned.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("collected", "filtered_out", "discarded")))


def not_ripped(tracks: DataFrame, existing: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Tracks whose srt_path isn't in existing (path, modificationTime); with overwrite, also those whose file isn't newer than srt_age."""
    old = existing.select(F.col("path").alias("srt_path"), F.col("modificationTime").alias("_made"))
    d = tracks.join(old, "srt_path", "left")
    again = F.lit(options.overwrite)
    if options.srt_age is not None:
        now = F.lit(options.now) if options.now else F.current_timestamp()
        again &= F.col("_made") < now - F.expr(f"INTERVAL {int(options.srt_age.total_seconds())} SECONDS")
    return d.where(F.col("_made").isNull() | again).drop("_made")


def escaped(path: str) -> str:
    """A path whose pattern characters a reader takes as they are."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def opened(paths: DataFrame) -> DataFrame:
    """(path, content, error) of paths (path), each read by a worker."""
    import pyarrow as pa

    from glyphstream.sources.matroska import opened as reader

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                try:
                    with reader(path) as f:
                        content, error = f.read(), None
                except OSError as e:
                    content, error = None, f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([content], pa.binary()), pa.array([error], pa.string())], names=["path", "content", "error"])

    return paths.select("path").mapInArrow(run, "path string, content binary, error string")


def local(path: str) -> str:
    return os.path.normpath(path.removeprefix("file://").removeprefix("file:"))
