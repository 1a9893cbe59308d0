"""Intermediate tables in the folder that driver and executors share, and joins whose broadcast side is checked."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of bytes (rows times the stated width) that a side may have to be broadcast.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset: on one machine a folder of its own, on a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def small(df: DataFrame, rows: int, width: int) -> DataFrame:
    """Mark df for broadcast if rows x width bytes are few enough; otherwise Spark shuffles both sides."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


class Scratch:
    """A folder of written tables. Writing cuts lineage; a lost executor costs a reread, never a recomputation of the past.

    The folder is deleted when the application ends, unless `at` names it: then it is the caller's.
    """

    def __init__(self, spark: SparkSession, name: str, at: str | None = None):
        self.spark, self.at = spark, (at or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}").rstrip("/")
        if at is None:
            path, files = self._files(self.at)
            files.mkdirs(path)
            files.deleteOnExit(path)

    def _files(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.at}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def kept(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def names(self, name: str = "") -> list[str]:
        """What is in the folder, or in one below it; nothing if that is not there."""
        path, files = self._files(self.path(name).rstrip("/"))
        return sorted(x.getPath().getName() for x in files.listStatus(path)) if files.exists(path) else []

    def drop(self, *names: str) -> None:
        for name in names:
            path, files = self._files(self.path(name))
            files.delete(path, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
