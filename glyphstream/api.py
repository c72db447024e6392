"""Scan media files and rip their subtitle tracks."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphstream.functions import tracks as metadata
from glyphstream.operators import recognise, subtitles
from glyphstream.sources import containers, files, matroska, pgs

CONTAINERS = ("mkv", "mks")


def scan_path(spark: SparkSession, paths: list[str], options: files.ScanOptions = files.ScanOptions()) -> DataFrame:
    """files.scan() with containers judged by their tracks: languages are those of all tracks, error is why one can't be read (it is discarded)."""
    found = files.scan(spark, paths, options)
    boxed = (F.col("status") == "collected") & F.col("parts.extension").isin(*CONTAINERS)
    read = matroska.described(found.where(boxed))
    every = metadata.parsed(read.where("error IS NULL")).groupBy("path").agg(F.first("all_languages").alias("_languages"))
    told = read.select("path", "error").join(every, "path", "left")
    d = found.join(told.dropDuplicates(["path"]), "path", "left")
    d = d.withColumn("languages", F.coalesce("languages", "_languages")).drop("_languages")
    wanted = files.matches(files.ScanOptions(languages=options.languages), F.col("modificationTime"), F.col("languages"))
    status = F.when(boxed & F.col("error").isNotNull(), "discarded").when(boxed & ~wanted, "filtered_out").otherwise(F.col("status"))
    return d.withColumn("status", status)


def tracks(scanned: DataFrame, options: files.ScanOptions = files.ScanOptions(), existing: DataFrame | None = None) -> DataFrame:
    """(path, id, language, number, track_id, srt_path): what is to be ripped of a scan's collected files; id is null for raw streams.

    existing (path, modificationTime) has the subtitle files made before; a track is skipped if the first file of its language is among them.
    """
    found = scanned.where("status = 'collected'").select("path", files.path_parts(F.col("path")).alias("parts"))
    todo = lambda d, lang: d.withColumn("srt_path", files.render(F.col("parts"), "srt", F.lit(0), lang))
    unmade = lambda d: d if existing is None else files.not_ripped(d, existing, options)
    raw = unmade(todo(found.where("parts.extension = 'sup'"), F.col("parts.language")))
    raw = raw.select("path", F.lit(None).cast("int").alias("id"), "parts.language", F.lit(0).alias("number"), F.col("path").alias("track_id"), "srt_path")
    inside = metadata.parsed(matroska.described(found.where(F.col("parts.extension").isin(*CONTAINERS))).where("error IS NULL"))
    inside = unmade(todo(inside.select("path", "track", files.path_parts(F.col("path")).alias("parts")), F.col("track.language")))
    chosen = metadata.selected(inside, "path", options)
    boxed = chosen.select("path", "track.id", "track.language", "number", F.concat_ws("#", "path", "track.id").alias("track_id"), files.render(F.col("parts"), "srt", F.col("number"), F.col("track.language")).alias("srt_path"))
    return raw.unionByName(boxed)


def unreadable(scanned: DataFrame) -> DataFrame:
    """(path, error) of the containers whose tracks can't be read."""
    return scanned.where("error IS NOT NULL").select("path", "error")


def contents(spark: SparkSession, chosen: DataFrame) -> DataFrame:
    """(track_id, content, error) of tracks(). Raw streams are read through the folders that hold them, whose files meet the tracks by path."""
    boxed = containers.demuxed(chosen.where("id IS NOT NULL")).select(F.concat_ws("#", "path", "id").alias("track_id"), "content", "error")
    plain = chosen.where("id IS NULL").select("path")
    folders = [r[0] for r in plain.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).distinct().limit(files.MOST_FOLDERS + 1).collect()]
    if not folders:
        return boxed
    if len(folders) > files.MOST_FOLDERS:  # then each worker opens its files itself
        return boxed.unionByName(files.opened(plain).select(F.col("path").alias("track_id"), "content", "error"))
    # Folder names may hold what a reader takes for a pattern.
    at = [files.escaped(f) for f in folders]
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.[sS][uU][pP]").load(at).join(plain, "path", "left_semi")
    return raw.select(F.col("path").alias("track_id"), "content", F.lit(None).cast("string").alias("error")).unionByName(boxed)


def texts(content: DataFrame, languages: DataFrame | None, recogniser: Callable, ocr: recognise.OcrOptions = recognise.OcrOptions(), rules: Iterable = (), tags: Iterable[str] = ()) -> DataFrame:
    """(track_id, srt, error) of content (track_id, content[, error]); languages (track_id, language) is told to the recogniser, and chooses rules."""
    items = pgs.items(pgs.display_sets(pgs.segments(content)))
    if languages is not None:
        items = items.join(languages.select("track_id", "language"), "track_id", "left")
    else:
        items = items.withColumn("language", F.lit(None).cast("string"))
    return subtitles.texts(recognise.recognised(items, recogniser, ocr), subtitles.chosen(rules, tags))


def rip(spark: SparkSession, scanned: DataFrame, recogniser: Callable, ocr: recognise.OcrOptions = recognise.OcrOptions(), rules: Iterable = (), options: files.ScanOptions = files.ScanOptions(), existing: DataFrame | None = None, tags: Iterable[str] = ()) -> DataFrame:
    """(track_id, srt_path, srt, error) of the collected files of a scan, a row a track; write them with operators.subtitles.write_files.

    A track that can't be ripped whole has its error and no srt; it doesn't stop the others. One without a single subtitle image is such a track too.
    """
    chosen = tracks(scanned, options, existing)
    done = texts(contents(spark, chosen), chosen, recogniser, ocr, rules, tags)
    d = chosen.select("track_id", "srt_path").join(done, "track_id", "left")
    return d.withColumn("error", F.when(F.col("srt").isNull(), F.coalesce("error", F.lit("no subtitles in the track"))))


def rip_pgs(spark: SparkSession, content: bytes, recogniser: Callable, language: str | None = None, ocr: recognise.OcrOptions = recognise.OcrOptions(), rules: Iterable = (), tags: Iterable[str] = ()) -> str:
    """The SRT text of one raw stream; ValueError with its error."""
    one = spark.createDataFrame([("stream", content)], "track_id string, content binary")
    row = texts(one, spark.createDataFrame([("stream", language)], "track_id string, language string"), recogniser, ocr, rules, tags).head()
    if row is None or row.srt is None:
        raise ValueError(row.error if row else "no subtitles in the track")
    return row.srt
