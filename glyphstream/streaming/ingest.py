"""Raw streams ripped as they arrive in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphstream import api
from glyphstream.operators import recognise, subtitles
from glyphstream.sources import files

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, root: str, recogniser: Callable, log: str, checkpoint: str, ocr: recognise.OcrOptions = recognise.OcrOptions(), rules: list[tuple[str, str]] = (), trigger: dict | None = None) -> StreamingQuery:
    """Write the subtitle file of each new raw stream under root; (path, error) of a batch goes to the folder log/batch=N, which a repeated batch overwrites."""

    def batch(arrived: DataFrame, k: int) -> None:
        content = arrived.select(F.col("path").alias("track_id"), "content")
        parts = files.path_parts(F.col("path"))
        names = arrived.select(F.col("path").alias("track_id"), parts["language"].alias("language"), files.render(parts, "srt").alias("srt_path"))
        docs = api.texts(content, names, recogniser, ocr, rules).join(names.select("track_id", "srt_path"), "track_id")
        subtitles.write_files(docs).write.mode("overwrite").parquet(f"{log}/batch={k}")

    stream = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", "*.[sS][uU][pP]").load(root)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
