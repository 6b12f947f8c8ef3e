"""Where operators keep intermediate tables.

Lineage is cut by writing Parquet to the shared folder named in
``spark.checkpoint.dir``, so a lost executor costs no recomputation of what
has been written.  Only a session of one machine that names no folder (as in
tests) gets one made; on a cluster that is an error.  Results read what is
written here, so it stays until the owner of the folder clears it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Seeds that are tried for hashes of paths without clashes.
SEEDS = 16
#: Rows of a few numbers, or of one path, up to which a counted side of a join is broadcast (some 10 MB).
SMALL = 200_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/muster-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most ``rows`` rows for the session's Python functions:
    whole texts in batches of Spark's default of 10,000 rows need much memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """Adds a row number that is the same whenever a stored table is read again.

    The number is made of a hash of the path of the row's file and of the row's
    place in the file.  So it does not depend on how a read packs files into
    partitions, which changes with the cores that are registered when a job is
    planned, and rows need not be joined with anything.  The place takes the bits
    that the longest file needs and the hash all others; the table's paths are
    looked through once for a seed without clashes (of a million files of a
    million rows, nineteen in twenty seeds are).  If there is none, files are
    numbered and joined.  What is not read from files gets its numbers in a copy
    that is written once.
    """
    path, at = free_name(df, "_path"), free_name(df, "_at")
    try:
        file = df.metadataColumn("_metadata")
        placed = df.select("*", file["file_path"].alias(path), file["row_index"].alias(at))
        placed.schema  # not every scan has a row index
    except AnalysisException:
        return stored(df.withColumn(name, F.monotonically_increasing_id()), "numbered")
    files = stored(placed.groupBy(path).agg(F.max(at).alias("last")), "files")  # reads no column
    n, last = files.agg(F.count(F.lit(1)), F.coalesce(F.max("last"), F.lit(0))).first()
    bits = last.bit_length()
    for seed in range(SEEDS):
        number = F.shiftrightunsigned(F.xxhash64(F.lit(seed), path), 1 + bits)
        if files.select(number.alias("h")).distinct().count() == n:
            numbered = placed
            break
    else:
        number = F.col(name)
        numbered = placed.join(if_small(stored(files.select(path, (F.row_number().over(Window.orderBy(path)) - 1).cast("long").alias(name)), "numbers")), path)
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns], (F.shiftleft(number, bits) + F.col(at)).alias(name))


def if_small(rows: DataFrame) -> DataFrame:
    """The stored narrow ``rows``, broadcast in a join if they are few; else the other side is shuffled as well."""
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def as_table(df: DataFrame) -> DataFrame:
    """``df`` if its rows have places in files, else a copy that is written once."""
    try:
        df.select(df.metadataColumn("_metadata")["row_index"]).schema  # not every scan has a row index
        return df
    except AnalysisException:
        return stored(df, "table")


def with_rows(docs: DataFrame, row: str, rows: DataFrame, how: str) -> DataFrame:
    """``docs`` (a stored table) joined with the narrow ``rows`` (``row`` and what goes with it).

    Few rows go to the documents; else both are shuffled.
    """
    return with_row_id(docs, row).join(if_small(stored(rows, "rows")), row, how)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores where ``df`` has that column already."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
