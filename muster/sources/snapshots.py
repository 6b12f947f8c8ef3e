"""Published results as Parquet, one folder for each view and patch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.sources.shared import Versions


class SnapshotStore:
    """Views by key such as ``champions`` or ``champions@16.19``, in versions: readers see a
    whole view at any time, and go on reading one that is replaced meanwhile."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.versions = spark, Versions(spark, path, keep)

    @staticmethod
    def _folder(key: str) -> str:
        view, _, patch = key.partition("@")
        return f"view={view}/patch={patch or 'none'}"

    def write(self, key: str, df: DataFrame) -> None:
        """Replaces the view; it also notes when it was computed."""
        self.versions.write(self._folder(key), df.withColumn("computed_at", F.current_timestamp()))

    def has(self, key: str) -> bool:
        return self.versions.current(self._folder(key)) is not None

    def read(self, key: str, compute: Callable[[], DataFrame]) -> DataFrame:
        """The stored view, or what ``compute`` gives where there is none."""
        found = self.versions.read(self._folder(key))
        return found.drop("computed_at") if found is not None else compute()

    def is_fresh(self, key: str, hours: float) -> bool:
        """Whether the view was computed less than ``hours`` ago."""
        found = self.versions.read(self._folder(key))
        if found is None:
            return False
        age = found.agg((F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(F.max("computed_at"))).alias("s")).first()["s"]
        return age is not None and age < hours * 3600

    def prune(self, keep: set[str]) -> list[str]:
        """Deletes views whose key is not in ``keep``; gives their keys."""
        gone = []
        for view in self.versions.names(self.versions.path):
            for patch in self.versions.names(f"{self.versions.path}/{view}"):
                name, p = view.split("=", 1)[1], patch.split("=", 1)[1]
                key = name if p == "none" else f"{name}@{p}"
                if key not in keep:
                    self.versions.drop(f"{view}/{patch}")
                    gone.append(key)
        return gone


def write_dimension(df: DataFrame, path: str) -> None:
    """Replaces a reference table; it is one file, as it has hundreds of rows."""
    df.coalesce(1).write.mode("overwrite").parquet(path)
