"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should appear target / source_size times, a number
between 0 and 2.  The whole part is certain; the fraction is rounded by the
pivotal method: of two documents with fractional copies one gives mass to the
other, at random but fair and with the words kept constant, until one of the
two is integral.  A block of documents ends with one fractional document for
each source; these residuals meet again in wider blocks, a reduction tree,
until one document per source is left and rounded alone.  So a source's words
miss its target by less than one document.

Defined results: a null or empty text has size 0 and takes 0 words; null is a
source of its own, last in the order; rows that are equal are rounded as
separate documents; a source without words has target 0.  An empty table gives
an empty result.  Results depend on the stored table (rows and their places in
its files) and the seed, not on how it is read.  One row for each source has to
fit in a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muster.llm.store import as_table, free_name, stored, with_row_id, with_rows

#: Documents in a block of the first level, and blocks that meet in one of the next.
BLOCK_ROWS, FAN_IN = 500, 32
_TINY = 1e-12
_OUT = "row long, doc_id long, source string, size long, source_size long, target double, copies long, fraction double, block long"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target.

    Weights repeat along the sources in code-point order.  Sharing what stands
    above a limit again until none does ends where every target is the smaller
    of its limit and one common level times its weight; the level follows from
    the sources sorted by limit / weight.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # windows without a key: one row for each source
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1)
    by = by.withColumn("w", w).withColumn("limit", F.col("source_size") * most)
    by = by.withColumn("goal", F.sum("source_size").over(everything) * share)
    rising = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("full", F.coalesce(F.sum("limit").over(rising), F.lit(0.0)))
    by = by.withColumn("rest", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(rising), F.lit(0.0)))
    by = by.withColumn("level", (F.col("goal") - F.col("full")) / F.col("rest"))
    # the first source in this order that the level of it and those after it leaves below its limit
    fits = F.when(F.col("level") * F.col("w") <= F.col("limit"), F.struct((F.col("limit") / F.col("w")).alias("r"), "level"))
    level = F.min(fits).over(everything)["level"]
    return by.select("source", "source_size", F.coalesce(F.least(F.col("limit"), level * F.col("w")), F.col("limit")).alias("target"))


def pivotal(fractions: list[float], sizes: list[int], rng: np.random.Generator) -> tuple[list[float], int | None]:
    """Rounds all but one of the fractions, keeping the sum of size x fraction.

    Gives the new fractions and the place of the one that is left, if any.
    """
    out, left = list(fractions), None
    draws = rng.random(len(out))
    for j, b in enumerate(out):
        if b <= _TINY or b >= 1 - _TINY:
            out[j] = float(round(b))
            continue
        if left is None:
            left = j
            continue
        a, ratio = out[left], sizes[left] / sizes[j]
        up, down = min(1 - a, b / ratio), min(a, (1 - b) / ratio)
        step = up if draws[j] * (up + down) < down else -down
        a, b = a + step, b - step * ratio
        out[left], out[j] = (float(round(x)) if min(abs(x), abs(1 - x)) < 1e-9 else x for x in (a, b))
        if 0 < out[left] < 1:
            continue
        left = j if 0 < out[j] < 1 else None
    return out, left


def _round_blocks(batches: Iterator[pa.RecordBatch], seed: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Rounds each (block, source) of sorted rows; a residual keeps its fraction."""
    carry: dict | None = None

    def emit(rows: dict) -> pa.RecordBatch:
        key = f"{rows['block'][0]}|{rows['source'][0]}".encode("utf-8", "surrogatepass")
        rng = np.random.default_rng([seed, zlib.crc32(key), zlib.adler32(key)])
        done, left = pivotal(rows["fraction"], rows["size"], rng)
        if last and left is not None:
            done[left] = float(rng.random() < done[left])
        for i, f in enumerate(done):
            if f in (0.0, 1.0):
                rows["copies"][i] += int(f)
                f = 0.0
            rows["fraction"][i] = f
        return pa.RecordBatch.from_pydict(rows, schema=schema)

    schema = None
    for batch in batches:
        schema = batch.schema
        if not batch.num_rows:
            continue
        block, source = batch.column("block").to_pylist(), batch.column("source").to_pylist()
        cuts = [0] + [i for i in range(1, len(block)) if (block[i], source[i]) != (block[i - 1], source[i - 1])] + [len(block)]
        for lo, hi in zip(cuts, cuts[1:]):
            rows = batch.slice(lo, hi - lo).to_pydict()
            if carry and (carry["block"][0], carry["source"][0]) == (rows["block"][0], rows["source"][0]):
                for c in carry:
                    carry[c] += rows[c]
            else:
                if carry:
                    yield emit(carry)
                carry = rows
    if carry:
        yield emit(carry)


def copies(sized: DataFrame, seed: int = 4, **kw) -> DataFrame:
    """``sized`` (row, doc_id, source, size; stored) with source_size, target and copies."""
    rows = sized.join(targets(sized, **kw).withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    share = F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.col("target") / F.col("source_size")).otherwise(0.0)
    n = sized.count()
    blocks = max(1, n // BLOCK_ROWS)
    order = F.xxhash64(F.lit(seed), "row")  # equal rows are spread too
    rows = rows.select("row", "doc_id", "source", "size", "source_size", "target", F.floor(share).alias("copies"),
                       (share - F.floor(share)).alias("fraction"), F.pmod(order, F.lit(blocks)).alias("block"))
    parts, level = [], 0
    while True:
        last = blocks == 1
        salt = seed + level
        done = stored(
            rows.repartition("block", "source").sortWithinPartitions("block", "source", order)
            .mapInArrow(lambda it, s=salt, z=last: _round_blocks(it, s, z), _OUT),
            f"level{level}",
        )
        parts.append(done.where("fraction = 0"))
        if last:
            break
        blocks, level = -(-blocks // FAN_IN), level + 1
        rows = done.where("fraction > 0").withColumn("block", F.pmod(F.col("block"), F.lit(blocks)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("fraction", "block")


def sized(docs: DataFrame) -> DataFrame:
    n = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return stored(with_row_id(docs.select("doc_id", "text", "source"), "row").select("row", "doc_id", "source", n.alias("size")), "sizes")


def mix_report(docs: DataFrame, seed: int = 4) -> DataFrame:
    return copies(sized(docs), seed).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )


def mix(docs: DataFrame, seed: int = 4) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it."""
    docs = as_table(docs)
    row, times = free_name(docs, "row"), free_name(docs, "copies")
    taken = copies(sized(docs), seed).where("copies > 0").select(F.col("row").alias(row), F.col("copies").cast("int").alias(times))
    out = with_rows(docs, row, taken, "inner")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(times))).alias(times)).drop(times)
