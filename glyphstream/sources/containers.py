"""The tracks of Matroska containers as a Spark data source.

    spark.dataSource.register(Containers)
    spark.read.format("matroska").load("/media").where("type = 'subtitles' AND language = 'de'")

A row is a track of a file, or of a part of it where a large file is cut at clusters; parts of a track are put together by ``joined``. The work is dealt out by
bytes, largest first to the least burdened task, so the number of tasks doesn't depend on the rows. Filters on a track's own columns are pushed
down (set ``spark.sql.python.filterPushdown.enabled``): blocks of tracks that they leave out are not read.
"""

from __future__ import annotations

import heapq
import json
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith

from glyphstream.sources import files, matroska
from glyphstream.sources.kept import gone_at_exit, shared_dir

#: Bytes of a file that one part spans, about, and what opening a file counts as.
SPLIT, OPENING = 256 << 20, 64 << 10
PARTS = 200
EXTENSIONS = (".mkv", ".mks")
COLUMNS = "path string, id int, type string, codec string, language string, name string, is_default boolean, is_enabled boolean, is_forced boolean, start long, content binary, error string"
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
_TYPES = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.binary(), pa.string()]
_OWN = set(_NAMES) - {"path", "start", "content", "error"}


@dataclass
class Work(InputPartition):
    """Ranges (path, start, end, track identifiers or None) of one task."""

    ranges: list = field(default_factory=list)


def _passes(f: Filter, row: dict) -> bool:
    """Is the filter true of the row? A null makes a comparison not true."""
    if isinstance(f, Not):
        inner = f.child
        own = row[inner.attribute[0]]
        return (own is not None or isinstance(inner, (IsNull, IsNotNull, EqualNullSafe))) and not _passes(inner, row)
    own = row[f.attribute[0]]
    if isinstance(f, IsNull):
        return own is None
    if isinstance(f, IsNotNull):
        return own is not None
    if isinstance(f, EqualNullSafe):
        return own == f.value
    if own is None:
        return False
    tests = {EqualTo: lambda: own == f.value, In: lambda: own in f.value, GreaterThan: lambda: own > f.value, GreaterThanOrEqual: lambda: own >= f.value, LessThan: lambda: own < f.value, LessThanOrEqual: lambda: own <= f.value}
    tests |= {StringContains: lambda: f.value in own, StringStartsWith: lambda: own.startswith(f.value), StringEndsWith: lambda: own.endswith(f.value)}
    return tests[type(f)]()


def _supported(f: Filter) -> bool:
    inner = f.child if isinstance(f, Not) else f
    known = (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringContains, StringStartsWith, StringEndsWith)
    return isinstance(inner, known) and len(inner.attribute) == 1 and inner.attribute[0] in _OWN | {"path"} and not (isinstance(inner, In) and None in inner.value and f is not inner)


def described(track: dict) -> dict:
    """A track's own columns."""
    p = track["properties"]
    return {"id": track["id"], "type": track["type"], "codec": track["codec"], "language": files.tag(p["language_ietf"]) or files.tag(p["language"]), "name": p["track_name"], "is_default": p["default_track"], "is_enabled": p["enabled_track"], "is_forced": p["forced_track"]}


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.filters = dict(options), []
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT)))
        self.parts = int(options.get("parts", PARTS))
        self.content = str(options.get("content", "true")).lower() != "false"

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if _supported(f):
                self.filters.append(f)
            else:
                yield f

    def _ranges(self) -> Iterator[tuple]:
        """(path, start, end, ids) of a table of ranges, or of all containers below a path, which are cut here."""
        if "ranges" in self.options:
            for row in read_json(self.options["ranges"]):
                yield row["path"], row["start"], row["end"], row.get("ids")
            return
        for path in found(self.options["path"]):
            try:
                with matroska.opened(path) as f:
                    for start, end in matroska.cuts(f, self.split) if self.content else [(0, matroska.length(f))]:
                        yield path, start, end, None
            except (OSError, ValueError):
                yield path, 0, 0, None  # the reading task meets the error again and tells it

    def partitions(self) -> Sequence[InputPartition]:
        own = [f for f in self.filters if (f.child if isinstance(f, Not) else f).attribute == ("path",)]
        todo = [r for r in self._ranges() if all(_passes(f, {"path": r[0]}) for f in own)]
        weight = lambda r: OPENING + (r[2] - r[1] if self.content else 0)
        total = sum(map(weight, todo))
        n = max(1, min(len(todo), max(self.parts, total // max(1, self.split))))
        works = [Work([]) for _ in range(n)]
        load = [(0, k) for k in range(n)]
        for r in sorted(todo, key=weight, reverse=True):
            held, k = heapq.heappop(load)
            works[k].ranges.append(r)
            heapq.heappush(load, (held + weight(r), k))
        return works

    def read(self, partition: Work) -> Iterator[pa.RecordBatch]:
        for path, start, end, ids in partition.ranges:
            rows = []
            try:
                with matroska.opened(path) as f:
                    head = matroska.head(f)
                    kept = [d for d in map(described, head["tracks"]) if (ids is None or d["id"] in ids) and all(_passes(x, d | {"path": path}) for x in self.filters)]
                    got = matroska.part(f, {d["id"] for d in kept}, start, end, head) if self.content and kept else {}
                    rows = [d | {"path": path, "start": start, "content": got.get(d["id"])} for d in kept]
            except (OSError, ValueError, zlib.error, EOFError) as e:
                blank = dict.fromkeys(_NAMES) | {"path": path, "start": start, "error": f"{type(e).__name__}: {e}"}
                rows = [r for r in (blank | {"id": k} for k in (ids or [None])) if all(_passes(x, r) for x in self.filters)]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(_NAMES, _TYPES)], names=_NAMES)


class Containers(DataSource):
    """Options: path (a file or folder; load()'s argument), or ranges, a folder of JSON lines (path, start, end[, ids]); content (false: tracks are only described), splitBytes, parts (tasks, at least)."""

    @classmethod
    def name(cls) -> str:
        return "matroska"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> Reader:
        if "path" not in self.options and "ranges" not in self.options:
            raise ValueError("what is to be read? load() wants a path")
        return Reader(self.options)


def found(root: str) -> list[str]:
    """Containers below a path, in order; a file itself whatever its name."""
    if "://" in root and not root.startswith("file:"):
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(root)
        head = root[: root.index(at)] if at in root else root.split("://")[0] + "://"
        if system.get_file_info(at).type == fs.FileType.File:
            return [root]
        return sorted(head + i.path for i in system.get_file_info(fs.FileSelector(at, recursive=True)) if i.is_file and i.path.lower().endswith(EXTENSIONS))
    at = files.local(root)
    if not os.path.isdir(at):
        return [at]
    return sorted(os.path.join(d, n) for d, _, names in os.walk(at) for n in names if n.lower().endswith(EXTENSIONS))


def read_json(root: str) -> Iterator[dict]:
    """Rows of a folder of JSON lines as Spark writes them."""
    if "://" in root and not root.startswith("file:"):
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(root)
        parts = sorted(i.path for i in system.get_file_info(fs.FileSelector(at)) if i.is_file and i.base_name.startswith("part-"))
        lines = (line for p in parts for line in system.open_input_file(p).read().splitlines())
    else:
        at = files.local(root)
        lines = (line for n in sorted(os.listdir(at)) if n.startswith("part-") for line in open(os.path.join(at, n), "rb"))
    yield from map(json.loads, lines)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Containers)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def ranges(tracks: DataFrame, split: int = SPLIT) -> DataFrame:
    """(path, start, end, ids) of tracks (path, id): the parts in which their files are read. Only files larger than split are looked into."""

    def run(batches):
        for b in batches:
            rows = []
            for path, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    with matroska.opened(path) as f:
                        rows += [(path, start, end, ids) for start, end in matroska.cuts(f, split)]
                except (OSError, ValueError):
                    rows.append((path, 0, 0, ids))  # the reading task meets the error again and tells it
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["path", "start", "end", "ids"])

    per_file = tracks.groupBy("path").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    return matroska.spread(per_file).mapInArrow(run, "path string, start long, end long, ids array<int>")


def joined(parts: DataFrame) -> DataFrame:
    """(path, id, content, error) from rows of the source: a track's parts one after another, in the order of the file."""

    def run(batches):
        for b in batches:
            whole = [None if x is None else b"".join(p["content"] for p in x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(whole, pa.binary()), b.column(3)], names=["path", "id", "content", "error"])

    piece = F.when(F.col("content").isNotNull(), F.struct("start", "content"))
    d = parts.groupBy("path", "id").agg(F.array_sort(F.collect_list(piece)).alias("parts"), F.min("error").alias("error"))
    d = d.select("path", "id", F.when(F.col("error").isNull(), F.col("parts")).alias("parts"), "error")
    return d.mapInArrow(run, "path string, id int, content binary, error string")


def demuxed(tracks: DataFrame, split: int = SPLIT) -> DataFrame:
    """(path, id, content, error) of tracks (path, id): raw streams, read by parts of files. A part's error is its track's."""
    spark = tracks.sparkSession
    register(spark)
    at = f"{shared_dir(spark).rstrip('/')}/ranges-{uuid.uuid4().hex}"
    ranges(tracks, split).write.json(at)
    gone_at_exit(spark, at)
    return joined(spark.read.format("matroska").option("ranges", at).option("splitBytes", split).option("parts", 4 * spark.sparkContext.defaultParallelism).load())
