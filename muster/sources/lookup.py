"""Lookups that read a small part of a large table.

``NameIndex`` answers "which names contain this text" from postings of trigrams:
a row for each gram of a name, in folders by its first two characters and sorted in
them, so a search reads the row groups of its own grams only.  ``write_points``
lays a table out for equality on some columns: sorted by one of them, with Bloom
filters on all, so that readers skip the row groups that cannot hold a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.functions.text import folded

#: Folders of postings and of names.
BUCKETS = 64
#: Stands after the end of a name, so that its last two characters start grams as well.
END = "\x00"


def _bucket(x: Column) -> Column:
    return F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int")


def _characters(name: Column) -> Column:
    """A name in lower case without accents; that keeps the number of characters."""
    return F.concat(folded(name), F.lit(END * 2))


class NameIndex:
    """Substring search over names: ``build`` once, then ``search``.

    ``path`` holds ``grams`` (bucket, gram, key) and ``names`` (the rows, by bucket of
    their key).  Null names are in neither.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, name: str):
        self.spark, self.path, self.key, self.name = spark, path.rstrip("/"), key, name

    def build(self, rows: DataFrame) -> None:
        rows = rows.where(F.col(self.name).isNotNull())
        chars = rows.select(F.col(self.key).alias("key"), _characters(F.col(self.name)).alias("s"))
        grams = chars.select("key", "s", F.explode(F.sequence(F.lit(1), F.length("s") - 2)).alias("i")).where("length(s) > 2")
        grams = grams.select("key", F.substring("s", F.col("i"), F.lit(3)).alias("gram")).distinct()
        for name, df, first, by in (("grams", grams, F.substring("gram", 1, 2), "gram"), ("names", rows, F.col(self.key), self.key)):
            placed = df.withColumn("bucket", _bucket(first)).repartition("bucket").sortWithinPartitions("bucket", by)
            placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def postings(self, text: str) -> tuple[DataFrame, int]:
        """(key, gram) of the grams of ``text``, and how many there are; two characters are the start of grams."""
        sought = self.spark.range(1).select(folded(F.lit(text)).alias("s")).first()["s"]
        grams = sorted({sought[i : i + 3] for i in range(max(1, len(sought) - 2))})
        buckets = self.spark.createDataFrame([(g[:2],) for g in grams], "g string").select(_bucket(F.col("g")).alias("b")).distinct()
        rows = self.spark.read.parquet(f"{self.path}/grams").where(F.col("bucket").isin([r["b"] for r in buckets.collect()]))  # as many as the text has characters
        if len(sought) == 2:
            return rows.where((F.col("gram") >= sought) & (F.col("gram") < sought[0] + chr(ord(sought[1]) + 1))).select("key", F.lit(sought).alias("gram")).distinct(), 1
        return rows.where(F.col("gram").isin(grams)).select("key", "gram"), len(grams)

    def search(self, text: str) -> DataFrame:
        """The rows whose name contains ``text`` in any case, all characters literal; none for less than two characters.

        Rows that have all grams are candidates, and are then looked at.
        """
        names = self.spark.read.parquet(f"{self.path}/names")
        if len(text) < 2:
            return names.limit(0).drop("bucket")
        found, n = self.postings(text)
        keys = found.groupBy(F.col("key").alias(self.key)).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == n).withColumn("bucket", _bucket(F.col(self.key)))
        return names.join(keys, ["bucket", self.key], "left_semi").where(F.contains(F.lower(self.name), F.lit(text.lower()))).drop("bucket")


def write_points(df: DataFrame, path: str, by: str, also: tuple[str, ...] = ()) -> None:
    """Writes ``df`` sorted by ``by``, equal values in one file, with Bloom filters on that and the columns ``also``."""
    out = df.repartitionByRange(by).sortWithinPartitions(by).write.mode("overwrite")
    for c in (by, *also):
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.adaptive.enabled#{c}", "true")
    out.parquet(path)


def point(spark: SparkSession, path: str, column: str, value: object) -> DataFrame:
    """Rows of a table that ``write_points`` wrote; row groups whose range or filter lacks ``value`` are not read."""
    return spark.read.parquet(path).where(F.col(column) == F.lit(value))
