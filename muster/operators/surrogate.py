"""Stable surrogate ids: a dictionary that only grows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from muster.sources.shared import written


def numbered(rows: DataFrame, by: str, name: str, first: int = 0) -> DataFrame:
    """``rows`` with numbers without gaps from ``first`` on, in the order of ``by`` (distinct values).

    Rows are dealt to stretches of ``by``, and each stretch starts where the rows of
    those before it end, so no task sorts all rows.
    """
    placed = rows.repartitionByRange(F.col(by)).withColumn("_stretch", F.spark_partition_id())
    placed = written(placed, "stretches")  # stretches are cut by a sample, which another reading might draw anew
    sizes = placed.groupBy("_stretch").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row for each partition
    place = F.row_number().over(Window.partitionBy("_stretch").orderBy(by))
    return placed.join(F.broadcast(starts), "_stretch").withColumn(name, (F.col("_start") + place - 1 + first).cast("long")).drop("_stretch", "_start")


class Dictionary:
    """Ids of keys (strings): old ones stay, new ones go on without gaps.

    Each batch is a folder of its own: it numbers the keys that no earlier batch has.
    Running a batch again replaces its folder by the same rows.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def rows(self) -> DataFrame:
        """key, id, batch."""
        try:
            return self.spark.read.schema("key string, id long, batch long").option("basePath", self.path).parquet(f"{self.path}/batch=*")
        except AnalysisException:
            return self.spark.createDataFrame([], "key string, id long, batch long")

    def add(self, keys: DataFrame, key: str, batch_id: int) -> DataFrame:
        """Gives ids to those ``keys`` that have none, as batch ``batch_id``, later than all but itself; key, id of all rows."""
        before = self.rows().where(F.col("batch") < batch_id)
        first = before.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]
        fresh = keys.select(F.col(key).alias("key")).where("key IS NOT NULL").distinct().join(before.select("key"), "key", "left_anti")
        numbered(fresh, "key", "id", first).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        return self.rows().select("key", "id")
