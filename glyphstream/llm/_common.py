"""Shared pieces of the training-data operators: scratch tables in the cluster's shared folder, word
splitting and vectorised word/shingle hashes."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word pattern of all word-based operators: runs without ASCII space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch that a Python worker is sent at most, but for a single longer row.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Have this session send Python workers batches of BATCH_BYTES at most, whatever the rows' length; a lower bound that is set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Where it is unset, a local session gets a temporary one; a cluster must set it."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='glyphstream-')}")
        at = sc.getCheckpointDir()
    return at


class Scratch:
    """Tables of one run in the shared folder. Writing one cuts lineage, and a lost executor costs a reread only.

    A table is dropped after its last reader; what a returned DataFrame still reads goes when the session's JVM ends, or at the end of a ``within`` block.
    """

    _nested: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("folders", default=None)

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.at: dict[int, tuple[DataFrame, str]] = {}
        self.made = 0
        bound_batches(spark)
        path, fs = self._files(spark, self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        own = Scratch._nested.get()
        if own is not None:
            own.append(self.root)

    @staticmethod
    def _files(spark: SparkSession, at: str):
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _new(self) -> str:
        self.made += 1
        return f"{self.root}/{self.made}"

    def keep(self, df: DataFrame, codec: str = "zstd", partition: str | None = None) -> DataFrame:
        """df as written and read again; partition: a last column whose values get folders of their own."""
        at = self._new()
        out = df.write.option("compression", codec)
        (out.partitionBy(partition) if partition else out).parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        self.at[id(out)] = (out, at)
        return out

    def bucketed(self, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """Like keep(), bucketed by key: later joins on it leave this side where it is. The catalog's entry goes at once, the files stay."""
        name, at = f"glyphstream_{uuid.uuid4().hex}", self._new()
        df.write.option("compression", "zstd").option("path", at).bucketBy(buckets, key).saveAsTable(name)
        out = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        self.at[id(out)] = (out, at)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete kept tables that nothing reads any more."""
        for df in tables:
            if df is not None and id(df) in self.at:
                path, fs = self._files(self.spark, self.at.pop(id(df))[1])
                fs.delete(path, True)

    def tidy(self) -> None:
        """Have the JVM find what nothing refers to any more: Spark then deletes finished shuffles' files, and the driver's heap shrinks. For after a large step."""
        self.spark._jvm.System.gc()

    @classmethod
    @contextlib.contextmanager
    def within(cls, spark: SparkSession):
        """Yields the folders made inside the block, in this thread; they are deleted at its end, when the caller has written elsewhere what it needs of them."""
        made: list[str] = []
        token = cls._nested.set(made)
        try:
            yield made
        finally:
            cls._nested.reset(token)
            for root in made:
                path, fs = cls._files(spark, root)
                fs.delete(path, True)


def release() -> None:
    """Give back to the system what this Python worker has let go of; a worker lives on between tasks, and its allocators keep what they had."""
    _POW.clear()
    _POW["n"] = 0
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def lean(run):
    """run(batches) for mapInArrow, with release() at the partition's end."""

    def of(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return of


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def word_count(text) -> F.Column:
    """Words of a text, JVM-side; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# ---- vectorised hashing -------------------------------------------------------------------------

_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POW = {"n": 0}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POW["n"] < n:
        _POW["n"] = n = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POW[name] = np.multiply.accumulate(p)
    return _POW["up"], _POW["down"]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's)."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Longer buffers are hashed in parts cut at white space, which bounds memory for very long texts.
PART = 1 << 20


def word_hashes(data: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of UTF-8 bytes: a polynomial over random byte values, mixed with the length."""
    if len(data) <= PART:
        return _word_hashes(data, lower)
    spaces, at, parts = np.flatnonzero(_SPACE[np.frombuffer(data, np.uint8)]), 0, []
    while at < len(data):
        k = np.searchsorted(spaces, at + PART)
        to = int(spaces[k]) + 1 if k < len(spaces) else len(data)
        h, start, end = _word_hashes(data[at:to], lower)
        parts.append((h, start + at, end + at))
        at = to
    return tuple(np.concatenate(x) for x in zip(*parts))


def _word_hashes(data: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = np.frombuffer(data, np.uint8)
    if lower:
        b = _LOWER[b]
    inside = np.zeros(len(b) + 2, np.int8)
    np.logical_not(_SPACE[b], out=inside[1:-1].view(bool))
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[: len(b)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start, end


def window_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes, in order."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    mult = np.uint64((0xC2B2AE3D27D4EB4F + 2 * seed * 0x165667B19E3779F9) % 2**64 | 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * mult + words[k : k + n]
    return mix(out, seed)
