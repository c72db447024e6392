"""Where intermediate tables stand: the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local session gets a temporary folder; a cluster must set it."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='glyphstream-')}")
        at = sc.getCheckpointDir()
    return at


def gone_at_exit(spark: SparkSession, at: str) -> None:
    """Have a folder deleted when the session's JVM ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(path)


class Kept:
    """Tables of one run below the shared folder: writing one cuts lineage. Dropped ones go at once, the rest when the session's JVM ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.at, self.made = spark, f"{shared_dir(spark).rstrip('/')}/kept-{uuid.uuid4().hex}", {}, 0
        gone_at_exit(spark, self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        self.made += 1
        at = f"{self.root}/{self.made}"
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        self.at[id(out)] = (out, at)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete kept tables that nothing reads any more."""
        for df in tables:
            if id(df) in self.at:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at.pop(id(df))[1])
                path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
