"""From recognised items to numbered, cleaned subtitles and their files."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphstream.functions.srt import apply_rules, chosen, srt_block  # noqa: F401 (chosen is used by callers)
from glyphstream.sources import filewriter
from glyphstream.sources.files import local


def _numbered(recognised: DataFrame, rules: Iterable) -> DataFrame:
    """recognised with text cleaned and idx, a subtitle's place by time from 1; idx is null for rows without text."""
    language = F.col("language") if "language" in recognised.columns else None
    d = recognised.withColumn("text", F.nullif(F.trim(apply_rules(F.col("text"), rules, language)), F.lit("")))
    w = Window.partitionBy("track_id").orderBy(F.col("text").isNull(), "start_ms", "end_ms", "item_id")
    return d.withColumn("idx", F.when(F.col("text").isNotNull(), F.row_number().over(w)))


def subtitles(recognised: DataFrame, rules: Iterable = ()) -> DataFrame:
    """(track_id, idx, start_ms, end_ms, text): cleaned, without empty ones, numbered by time from 1. Rules with languages need a column language."""
    return _numbered(recognised, rules).where("idx IS NOT NULL").select("track_id", "idx", "start_ms", "end_ms", "text")


def _srt(idx: Column) -> Column:
    blocks = F.array_sort(F.collect_list(F.when(idx.isNotNull(), F.struct(idx.alias("idx"), srt_block(idx, F.col("start_ms"), F.col("end_ms"), F.col("text")).alias("b")))))
    return F.array_join(F.transform(blocks, lambda x: x["b"]), "\n")


def documents(subs: DataFrame) -> DataFrame:
    """(track_id, srt): each track's whole SRT file."""
    return subs.groupBy("track_id").agg(_srt(F.col("idx")).alias("srt"))


def texts(recognised: DataFrame, rules: Iterable = ()) -> DataFrame:
    """(track_id, srt, error): each track's whole SRT file, empty if none of its items has a text; null with the error of any of its items."""
    made = _numbered(recognised, rules).groupBy("track_id").agg(_srt(F.col("idx")).alias("srt"), F.min("error").alias("error"))
    return made.select("track_id", F.when(F.col("error").isNull(), F.col("srt")).alias("srt"), "error")


def write_files(docs: DataFrame, path: str = "srt_path", encoding: str = "utf-8", overwrite: bool = True) -> DataFrame:
    """(path, error, written) after writing docs (srt_path, srt[, error]) to the paths named, each by rename from a name of its own, so that retries are safe.

    Rows without srt, or with an error, aren't written and keep their error; nor, without overwrite, is a file that has come to be since it was looked
    for. Paths are mounted on the workers, or on a file system that their scheme names.
    """
    import pyarrow as pa

    def put(at: str, data: bytes) -> bool:
        own = uuid.uuid4().hex
        if "://" in at and not at.startswith("file:"):
            from pyarrow import fs

            system, name = fs.FileSystem.from_uri(at)
            if not overwrite and system.get_file_info(name).type != fs.FileType.NotFound:
                return False
            other = f"{name}.{own}.tmp"
            with system.open_output_stream(other) as f:
                f.write(data)
            system.move(other, name)
            return True
        if not overwrite and os.path.exists(local(at)):
            return False
        with open(f"{local(at)}.{own}.tmp", "wb") as f:
            f.write(data)
        os.replace(f.name, local(at))
        return True

    def run(batches):
        for b in batches:
            out = []
            for at, text, error in zip(*(c.to_pylist() for c in b.columns)):
                done = False
                if error is None and text is not None:
                    try:
                        done = put(at, text.encode(encoding))
                    except (OSError, UnicodeError) as e:
                        error = str(e)
                out.append((at, error, done))
            kinds = (pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["path", "error", "written"])

    error = F.col("error") if "error" in docs.columns else F.lit(None).cast("string").alias("error")
    return docs.select(path, "srt", error).mapInArrow(run, "path string, error string, written boolean")


def save_files(docs: DataFrame, path: str = "srt_path", overwrite: bool = True) -> None:
    """Writes docs (srt_path, srt[, error]) as UTF-8 files on mounted paths, all of them or none (see sources.filewriter). Rows without srt, or with an error, have no file."""
    good = docs.where("srt IS NOT NULL" + (" AND error IS NULL" if "error" in docs.columns else ""))
    filewriter.save(good.select(F.col(path).alias("path"), F.encode("srt", "utf-8").alias("content")), keep=not overwrite)
