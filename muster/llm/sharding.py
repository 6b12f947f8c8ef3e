"""A uniform shuffle into shards of exact size.

Rows are dealt by a hash of their number in the stored table into blocks.  The number of rows
that block i sends to shard j is drawn exactly: the matrix of counts is
multivariate hypergeometric with the blocks' sizes and the shards' sizes as
margins, which is the distribution that a uniform shuffle of all rows has.
Each block is permuted and cut by its row of the matrix, rows go to their
shards, and each shard is permuted again.  Only native expressions run on the
rows; the driver draws the matrix, which has at most MAX_BLOCKS x shards cells.

Defined results: a null or empty text has size 16 and CRC 0.  Repeated rows are
dealt apart like others, and so are null doc_ids.  An empty table gives an empty
result.  The result depends on the stored table (rows and their places in its
files) and the seed only, not on how it is read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muster.llm.store import as_table, stored, with_row_id

MAX_BLOCKS = 8192
#: Rows that one block or one piece of a shard has on average.
BLOCK_ROWS = 50_000


def draw_matrix(block_rows: list[int], shards: int, seed: int) -> np.ndarray:
    """Counts from each block to each shard; shard totals differ by one at most."""
    n = sum(block_rows)
    left = np.array([n // shards + (j < n % shards) for j in range(shards)], np.int64)
    rng = np.random.default_rng(seed)
    rng.shuffle(left)  # which shards hold one more is random too
    out = np.zeros((len(block_rows), shards), np.int64)
    for i, m in enumerate(block_rows):
        out[i] = rng.multivariate_hypergeometric(left, m, method="marginals") if m else 0
        left -= out[i]
    return out


def shuffle_to_shards(rows: DataFrame, row: str, shards: int = 40, seed: int = 20, min_blocks: int = 64) -> DataFrame:
    """``rows`` (stored, narrow) with ``shard`` and ``slot``; slots are gapless from 0 in each shard.

    ``row`` is a column that is different in every row; the random order is made of it.
    """
    spark, cols = rows.sparkSession, rows.columns
    n = rows.count()
    blocks = int(min(MAX_BLOCKS, max(min_blocks, n // BLOCK_ROWS)))
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), row), F.lit(blocks)).cast("int"))
    local = F.row_number().over(Window.partitionBy("_block").orderBy(F.xxhash64(F.lit(seed + 1), row), row)) - 1
    dealt = stored(dealt.withColumn("_rank", local), "blocks")
    # at most `blocks` rows
    sizes = {r["_block"]: r["n"] for r in dealt.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).collect()}
    matrix = draw_matrix([sizes.get(b, 0) for b in range(blocks)], shards, seed)
    ends = spark.createDataFrame([(b, [int(x) for x in np.cumsum(matrix[b])]) for b in range(blocks)], "_block int, _ends array<long>")
    # at most MAX_BLOCKS rows of `shards` numbers
    placed = dealt.join(F.broadcast(ends), "_block").withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))).cast("int"))

    pieces = int(max(16, n // shards // BLOCK_ROWS))
    key = F.xxhash64(F.lit(seed + 2), row)
    placed = stored(placed.select(*cols, "shard", key.alias("_key"), F.pmod(F.shiftright(key, 7), F.lit(pieces)).cast("int").alias("_piece")), "placed")
    inside = F.row_number().over(Window.partitionBy("shard", "_piece").orderBy("_key", row)) - 1
    counts = placed.groupBy("shard", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "_piece", before.alias("_before"))
    return (placed.withColumn("_inside", inside).join(offsets, ["shard", "_piece"])
            .select(*cols, "shard", (F.col("_before") + F.col("_inside")).cast("long").alias("slot")))


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 20) -> DataFrame:
    """For ``docs`` (a stored table): doc_id, size (UTF-8 bytes plus 16), text_crc32, law ``rows``, shard, slot, grown_shard (null)."""
    t = F.coalesce("text", F.lit(""))
    rows = with_row_id(as_table(docs).select("doc_id", "text"), "row")
    narrow = stored(rows.select("row", "doc_id", (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32")), "sizes")
    return shuffle_to_shards(narrow, "row", shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
