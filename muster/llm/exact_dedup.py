"""Exact dedup against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest.  A batch is
reduced to one row per digest (partial aggregation first, so a group of copies
that holds a third of all rows leaves each map task as one row), compared with
the index by a sort-merge anti-join and appended.  Only native expressions are
used.

Defined results: a null text counts as empty, and empty texts are equal to one
another.  Of equal texts in a batch the row with the largest doc_id stays
(null is smallest); of rows that also share the doc_id exactly one stays.  A
text that an earlier batch brought in is dropped whatever its doc_id, and its
keep_id is that batch's; group_size counts the rows of this batch.  A batch that is
run again under its own name finds its own digests and gives the same result.
Other columns are never looked at.  An empty batch gives an empty result.
"""

from __future__ import annotations

import string
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm.store import as_table, free_name, shared_dir, stored, with_row_id, with_rows

_LEAST = -(2**63)
#: Digests for which a bucket is made, and the fewest buckets.
BUCKET_ROWS, LEAST_BUCKETS = 2_000_000, 16


def normalised(text) -> F.Column:
    """Lower case for A-Z only.

    ``lower`` does the same for pure ASCII and is much faster than
    ``translate``, which other texts need as ``lower`` would change É or ß too.
    """
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))


_ROW = "digest BINARY, keep_id BIGINT, keep_row BIGINT, group_size BIGINT, batch STRING"
_LOG = "generation INT, folder STRING, buckets INT"


class DigestIndex:
    """Digests seen so far: (digest, keep_id, keep_row, group_size, batch).

    A folder below ``path`` holds the table, bucketed and sorted by digest.  The
    last row of ``log`` names that folder and its number of buckets, so opening
    the same path later continues the index.  Where each bucket is one file, as
    after the first batch and after ``compact``, the index side of a join is
    neither shuffled nor sorted; files that later batches add are sorted bucket
    by bucket.  A new index gets its buckets from the size of the first batch
    unless they are given, and an index that outgrows them is compacted into more.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        # the order of buckets of one file is trusted
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        self.wanted, self.name, self.generation, self.buckets = buckets, None, -1, buckets
        try:
            last = spark.read.schema(_LOG).parquet(f"{self.path}/log").orderBy(F.desc("generation")).first()
        except AnalysisException:
            last = None
        if last:
            if buckets not in (None, last["buckets"]):
                raise ValueError(f"the index at {path} has {last['buckets']} buckets, not {buckets}; compact() changes them")
            self._attach(last["generation"], last["folder"], last["buckets"])

    def _attach(self, generation: int, folder: str, buckets: int) -> None:
        self.close()
        self.generation, self.folder, self.buckets = generation, folder, buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {self.name} ({_ROW}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{folder}'")

    def _commit(self, generation: int, folder: str, buckets: int) -> None:
        self.spark.createDataFrame([(generation, folder, buckets)], _LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _write(self, rows: DataFrame) -> None:
        """Appends ``rows``; one file for each bucket, as a bucket is in one partition whatever their number."""
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets))
        (rows.select("digest", "keep_id", "keep_row", "group_size", "batch").repartition(4 * self.buckets, bucket).write.mode("append").format("parquet")
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name))
        self.spark.catalog.refreshTable(self.name)

    def ready(self, coming: int) -> None:
        """Makes the table, or gives it more buckets, for ``coming`` more rows."""
        need = max(LEAST_BUCKETS, -(-coming // BUCKET_ROWS))
        if self.name is None:
            self.buckets = self.wanted or need
            self._attach(0, f"{self.path}/data0", self.buckets)
            self._commit(0, self.folder, self.buckets)
        elif self.rows().count() + coming > 8 * BUCKET_ROWS * self.buckets:
            self.compact(4 * self.buckets)

    def compact(self, buckets: int | None = None) -> None:
        """Rewrites the index as one sorted file for each bucket."""
        rows, generation = self.unbucketed(), self.generation + 1
        self._attach(generation, f"{self.path}/data{generation}-{uuid.uuid4().hex[:8]}", buckets or self.buckets)
        self._write(rows)
        self._commit(generation, self.folder, self.buckets)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame, batch: str) -> DataFrame:
        """Adds the digests of ``groups`` (digest, keep_id, keep_row, group_size; a row for each) that the
        index lacks, and gives all of them with the keep_id, keep_row and batch that the index has."""
        fresh = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti").withColumn("batch", F.lit(batch))
        known = self.rows().select("digest", "keep_id", "keep_row", "batch").hint("merge").join(groups.select("digest", "group_size"), "digest")
        found = stored(fresh.withColumn("fresh", F.lit(True)).unionByName(known.withColumn("fresh", F.lit(False))), "groups")
        self._write(found.where("fresh"))
        return found.drop("fresh")

    def unbucketed(self) -> DataFrame:
        """The same rows as plain files, so that a join may split hot digests."""
        return self.spark.read.schema(_ROW).parquet(self.folder)

    def close(self) -> None:
        """Takes the table out of the catalog; its files stay."""
        if self.name:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
            self.name = None


def decisions(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, keep_id, group_size, kept, digest.

    ``row`` is the row id that ``with_row_id`` gives the stored table ``docs``.  ``batch``
    names the batch: what may run again, as a job whose driver died does, needs a name
    of its own.  The index meets one row for each digest of the batch; the rows then meet these.
    """
    rows = stored(
        with_row_id(docs.select("doc_id", "text"), "row").select("row", "doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest")),
        "digests",
    )
    batch = batch or uuid.uuid4().hex
    index.ready(rows.count())
    groups = rows.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"), F.max_by("row", F.coalesce("doc_id", F.lit(_LEAST))).alias("keep_row"), F.count(F.lit(1)).alias("group_size")
    )
    found = index.append(stored(groups, "batch"), batch)
    return rows.join(found.hint("merge"), "digest").select(
        "row", "doc_id", "keep_id", "group_size", ((F.col("batch") == batch) & (F.col("row") == F.col("keep_row"))).alias("kept"), "digest"
    )


def dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    spark, docs = docs.sparkSession, as_table(docs)
    own = index or DigestIndex(spark, f"{shared_dir(spark)}/index")
    row = free_name(docs, "row")
    out = with_rows(docs, row, decisions(docs, own, batch).where("kept").select(F.col("row").alias(row)), "left_semi")
    if index is None:
        own.close()
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
