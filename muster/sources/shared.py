"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a session of one machine may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a new shared folder and read back."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Versions:
    """Tables below a folder that are replaced while others read them.

    Each writing makes a new folder with the next number.  The current version is the
    last one that was finished, as its mark of success is written last: a reader sees
    a whole version or the one before, and a job that fails leaves no hole.  Who has
    opened a version reads on, as the last ``keep`` finished ones stay.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, path: str) -> list[str]:
        """What a folder holds; nothing if it is not there."""
        at = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _numbers(self, key: str) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self.names(f"{self.path}/{key}") if n.startswith("version="))

    def _finished(self, key: str) -> list[int]:
        return [v for v in self._numbers(key) if self._fs.exists(self._path(f"{self.path}/{key}/version={v}/_SUCCESS"))]

    def current(self, key: str) -> str | None:
        """The folder of the current version of ``key``."""
        done = self._finished(key)
        return f"{self.path}/{key}/version={done[-1]}" if done else None

    def write(self, key: str, df: DataFrame) -> str:
        number = max(self._numbers(key), default=0) + 1
        folder = f"{self.path}/{key}/version={number}"
        df.write.parquet(folder)
        for old in [v for v in self._numbers(key) if v < number and v not in self._finished(key)[-self.keep :]]:
            self._fs.delete(self._path(f"{self.path}/{key}/version={old}"), True)
        return folder

    def read(self, key: str) -> DataFrame | None:
        at = self.current(key)
        try:
            return self.spark.read.parquet(at) if at else None
        except AnalysisException:  # it went between the two steps, so there is a newer one
            return self.spark.read.parquet(self.current(key))

    def drop(self, key: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{key}"), True)
